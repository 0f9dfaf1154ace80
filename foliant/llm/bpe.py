"""Byte-level BPE over whole corpora (problem 7).

The merge loop keeps the symbols of one pre-token in a doubly linked list and
the possible merges in a heap ordered by (rank, position). A heap entry is
stale, and skipped, once either of its symbols has been merged away or has
grown. Pre-tokens repeat, so each Python worker keeps a bounded table of
encoded pre-tokens; the table only saves work, results never depend on it.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Folder of the public vocabularies; never copied into the repository.
TOKENIZER_DIR = os.environ.get("FOLIANT_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the published pre-tokenisation pattern of the 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries that a worker's table of encoded pre-tokens may hold before it is emptied.
CACHE_ENTRIES = 1 << 19


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def vocabulary_of(spark: SparkSession, path: str | None = None) -> Callable[[], str]:
    """What gives a worker its path of the rank file: the file of the driver, sent to every executor with the job."""
    name = path or f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
    if "://" not in name and not os.path.exists(name):
        raise FileNotFoundError(f"{name}: name the vocabulary by `path` or FOLIANT_TOKENIZERS")
    spark.sparkContext.addFile(name)
    base = os.path.basename(name)
    return lambda: SparkFiles.get(base)


class ByteBpe:
    """Encoder and decoder of one rank vocabulary."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES) -> None:
        import regex

        self.ranks = load_ranks(path)
        self.find = regex.compile(PATTERN).findall
        self.limit = cache_entries
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: merge the lowest-ranked adjacent pair, leftmost first, until none is left."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        symbols: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 1, 2))
        heapq.heapify(heap)
        while heap:
            _, left, right, length = heapq.heappop(heap)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or after[left] != right or len(a) + len(b) != length:
                continue
            symbols[left], symbols[right] = a + b, None
            following = after[right]
            after[left] = following
            if following < n:
                before[following] = left
                rank = ranks.get(a + b + symbols[following])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, following, length + len(symbols[following])))
            previous = before[left]
            if previous >= 0:
                rank = ranks.get(symbols[previous] + a + b)
                if rank is not None:
                    heapq.heappush(heap, (rank, previous, left, length + len(symbols[previous])))
        return [ranks[s] for s in symbols if s is not None]

    def packed(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian 32-bit integers."""
        known = self.known
        pieces = self.find(text)
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            out = []
            for p in pieces:
                ids = known.get(p)
                if ids is None:
                    ids = np.array(self.merge(p.encode("utf-8", "surrogatepass")), "<i4").tobytes()
                    known[p] = ids
                out.append(ids)
            return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; an empty or null text has none."""
        return np.frombuffer(self.packed(text), "<i4").tolist() if text else []

    def decode(self, ids: list[int]) -> str:
        """Concatenated vocabulary strings of ``ids``; bytes that are no UTF-8 become U+FFFD."""
        strings = {i: token for token, i in self.ranks.items()}
        return b"".join(strings[i] for i in ids).decode("utf-8", "replace")


def encode_column(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "ids", path: str | None = None
) -> DataFrame:
    """``id_col`` and the token ids (array<int>) of ``text_col``, one row per input row.

    No shuffle: a narrow Arrow map over the two columns that are read.

    * null, empty text: an empty list. Blank text is encoded like any other.
    * null ids, repeated rows, ties: every input row gives one output row.
    * very long text: encoded whole; memory is that of one text and its ids.
    * empty table: no rows. Further columns, whatever their names, are not read.
    """
    vocabulary = vocabulary_of(df.sparkSession, path)
    schema = df.select(F.col(id_col)).schema.add(out_col, ArrayType(IntegerType()), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(vocabulary())
        for batch in batches:
            rows = [bpe.packed(t) if t else b"" for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) // 4 for r in rows], out=ends[1:])
            ids = pa.array(np.frombuffer(b"".join(rows), "<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), ids)], [id_col, out_col])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
