"""Splitting oversized chunks at natural boundaries (problem 4).

Content-defined chunking over white-space tokens: a rolling hash of a few
tokens marks landmarks wherever the text itself asks for one, whatever comes
before; each landmark snaps to the nearest natural boundary between the
smallest and the largest piece. An edit therefore moves only the cuts near it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import word_count

#: Tokens in the window of the rolling hash.
WINDOW = 4
_TOKEN = re.compile(r"\S+")
_MASK, _BASE = (1 << 61) - 1, 1_000_003
#: Kinds of boundary, strongest first; a cut prefers the first three.
KINDS = ("paragraph", "line", "sentence", "clause", "token")
_SENTENCE = re.compile(r"[.!?…。]['\"”»’)\]]*$")
_CLAUSE = re.compile(r"[,;:–—]['\"”»’)\]]*$")


def boundaries(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Kind (index into KINDS) of the boundary after each token."""
    kinds = []
    for i, (start, end) in enumerate(spans):
        gap = text[end : spans[i + 1][0]] if i + 1 < len(spans) else "\n\n"
        lines = gap.count("\n")
        word = text[max(start, end - 8) : end]
        kinds.append(0 if lines > 1 else 1 if lines else 2 if _SENTENCE.search(word) else 3 if _CLAUSE.search(word) else 4)
    return kinds


def landmarks(tokens: list[str], every: int) -> list[bool]:
    """Whether the rolling hash of the WINDOW tokens that end at each token asks for a cut after it."""
    drop = pow(_BASE, WINDOW, _MASK)
    values = [crc32(t.encode("utf-8", "surrogatepass")) + 1 for t in tokens]
    h, marks = 0, []
    for i, v in enumerate(values):
        h = (h * _BASE + v - (values[i - WINDOW] * drop if i >= WINDOW else 0)) % _MASK
        marks.append(i >= WINDOW - 1 and (h * 0x9E3779B97F4A7C15 & _MASK) >> 20 & 0xFFFF < 65536 // every)
    return marks


def cuts(tokens: list[str], kinds: list[int], limit: int, overlap: int) -> list[int]:
    """End of each piece as a token position; a piece also repeats ``overlap`` tokens before its own."""
    n, fresh = len(tokens), limit - overlap
    if n <= limit:
        return [n]
    least = max(1, fresh // 2)
    marks = landmarks(tokens, max(2, fresh // 8))
    ends, at = [], 0
    while n - at > (limit if not ends else fresh):
        most = at + (limit if not ends else fresh)
        first = at + least
        mark = next((i for i in range(first, most + 1) if marks[i - 1]), most)
        # Nearest strong boundary, else nearest clause end, else the landmark itself; earlier before later.
        best = None
        for allowed in (2, 3):
            near = [i for i in range(first, most + 1) if kinds[i - 1] <= allowed]
            if near:
                best = min(near, key=lambda i: (abs(i - mark), i))
                break
        at = best or mark
        ends.append(at)
    return [*ends, n]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[str, int, str]]:
    """(text, tokens, kind of boundary at its end) of each piece."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    kinds = boundaries(text, spans)
    overlap = max(0, min(overlap, limit - 1))
    out, start = [], 0
    for end in cuts([text[a:b] for a, b in spans], kinds, limit, overlap):
        first = max(0, start - overlap)
        out.append((text[spans[first][0] : spans[end - 1][1]], end - first, KINDS[kinds[end - 1]]))
        start = end
    return out


def oversized(chunks: DataFrame, settings: DataFrame) -> DataFrame:
    """The chunks that exceed their notebook's ``chunk_size`` and that no other chunk names as its parent."""
    size = settings.filter(F.col("chunk_size") > 0).groupBy("notebook_id").agg(F.min("chunk_size").alias("limit"), F.min("chunk_overlap").alias("overlap"))
    parents = chunks.filter(F.col("parent_chunk_id").isNotNull() & ~F.col("parent_chunk_id").eqNullSafe(F.col("chunk_id"))).select(F.col("parent_chunk_id").alias("chunk_id"))
    # An outer join and a test, for an anti join would be pushed below the size test and shuffle every text.
    named = parents.distinct().withColumn("_named", F.lit(True))
    return (
        chunks.filter(F.col("chunk_id").isNotNull() & F.col("notebook_id").isNotNull())
        .select("chunk_id", "notebook_id", "section_header", "chunk_text")
        # settings: one row per notebook, far smaller than the chunks; the planner broadcasts it only if it is.
        .join(size, "notebook_id")
        # A text of n tokens has at least 2n - 1 characters, which spares most texts the regular expression.
        .filter((F.length("chunk_text") > 2 * F.col("limit")) & (word_count("chunk_text") > F.col("limit")))
        .dropDuplicates(["chunk_id"])
        .join(named, "chunk_id", "left")
        .filter(F.col("_named").isNull())
        .drop("_named")
    )


PIECES = "chunk_id string, parent_chunk_id string, piece_index int, section_header string, chunk_text string, token_count int, ends_at string"


def split_chunks(chunks: DataFrame, settings: DataFrame) -> DataFrame:
    """Pieces of every oversized chunk, each within the limit, repeating ``chunk_overlap`` tokens of the one before.

    * null text, null or unknown notebook, null or non-positive chunk_size: not cut. Null overlap: 0;
      an overlap of the limit or more counts as one token less than the limit, for each piece must add one.
    * a chunk delivered twice is cut once; repeated settings rows count once, the smallest size holds.
    * very long texts are cut whole; a text without white space is one token and never oversized.
    * empty tables: no pieces. Extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PIECES.split(", ")]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for i, (text, tokens, kind) in enumerate(split_text(r["chunk_text"], r["limit"], r["overlap"] or 0)):
                    rows.append((f"{r['chunk_id']}:{i}", r["chunk_id"], i, r["section_header"], text, tokens, kind))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            types = [pa.int32() if n in ("piece_index", "token_count") else pa.string() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return oversized(chunks, settings).select("chunk_id", "section_header", "chunk_text", "limit", "overlap").mapInArrow(run, PIECES)


def cut_chunks(pieces: DataFrame) -> DataFrame:
    """(chunk_id) of the chunks that came out in pieces; every one has exactly one piece 0."""
    return pieces.filter("piece_index = 0").select(F.col("parent_chunk_id").alias("chunk_id"))
