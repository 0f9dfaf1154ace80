"""Embedding of chunks through a pluggable client, in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import filled

Client = Callable[[list[str]], list[list[float] | None]]


def hashed_client(dim: int = 64) -> Client:
    """A deterministic stand-in without a model: signed hashes of the words, so equal texts have equal vectors."""

    def run(texts: list[str]) -> list[list[float] | None]:
        out = []
        for text in texts:
            v = np.zeros(dim)
            for w in text.lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                v[int.from_bytes(h[:4], "little") % dim] += 1 if h[4] & 1 else -1
            out.append(v.tolist())
        return out

    return run


#: Where embeddings are asked for, by kind of provider: path and shape of the request.
TARGETS = {"openai": [("/v1/embeddings", "openai")], "ollama": [("/embed", "native"), ("/embeddings", "legacy"), ("/v1/embeddings", "openai")]}


def targets(base: str, provider: str = "ollama", endpoint: str | None = None) -> list[tuple[str, str]]:
    """(address, shape) of the endpoints to try, in order; an endpoint of its own is the only one."""
    base = base.rstrip("/")
    if endpoint:
        return [(f"{base}/{endpoint.lstrip('/')}", "native")]
    if (provider or "ollama").lower() == "openai":
        return [(base + path, shape) for path, shape in TARGETS["openai"]]
    api = base if base.endswith("/api") else f"{base}/api"
    return [((base if path.startswith("/v1") else api) + path, shape) for path, shape in TARGETS["ollama"]]


class ModelMissing(RuntimeError):
    """No server has the model."""


def vectors_of(response: dict, size: int, dim: int) -> list[list[float]]:
    """``size`` vectors of a response in any of the three shapes; what isn't there is a zero vector."""
    zero = [0.0] * dim
    if isinstance(response.get("embeddings"), list):
        found = [v if isinstance(v, list) and v else zero for v in response["embeddings"]]
    elif isinstance(response.get("data"), list):
        found = [v["embedding"] if isinstance(v, dict) and isinstance(v.get("embedding"), list) else zero for v in response["data"]]
    else:
        found = [response["embedding"]] if isinstance(response.get("embedding"), list) else []
    return (found + [zero] * size)[:size]


def chained_client(post: Callable[[str, dict], dict], addresses: list[tuple[str, str]], models: list[str], dim: int) -> Client:
    """A client that tries each model at each address, through ``post(address, payload)``.

    What worked is tried first from then on. If nothing answers, the texts have no vector; once a model was
    missing everywhere, nothing is asked any more.
    """
    memory: dict = {"first": None, "off": False}

    def ask(address: str, shape: str, model: str, texts: list[str]) -> list[list[float] | None]:
        if shape == "legacy":
            return [vectors_of(post(address, {"model": model, "prompt": t}), 1, dim)[0] for t in texts]
        return vectors_of(post(address, {"model": model, "input": texts}), len(texts), dim)

    def run(texts: list[str]) -> list[list[float] | None]:
        if memory["off"]:
            return [None] * len(texts)
        every = [(m, a, s) for m in models if m for a, s in addresses]
        order = [memory["first"], *[x for x in every if x != memory["first"]]] if memory["first"] else every
        missing = bool(order)
        for model, address, shape in order:
            try:
                found = ask(address, shape, model, texts)
            except ModelMissing:
                continue
            except Exception:  # noqa: BLE001 - any failure of a remote client
                missing = False
                continue
            memory["first"] = (model, address, shape)
            return found
        memory["off"] = missing
        return [None] * len(texts)

    return run


def embedded_text(text: Column | str = "chunk_text", own: Column | str = "embedding_text") -> Column:
    return F.coalesce(filled(own), F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def embed(chunks: DataFrame, client: Client, dim: int = 64, key: str = "chunk_seq", batch: int = 16) -> DataFrame:
    """(key, embedding, failed): one unit vector per chunk, of its ``embedding_text`` or else its text.

    Vectors are cut or padded to ``dim``. A client that fails or answers nothing
    for a text gives the zero vector and ``failed``; the batch goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(1).to_pylist()
            vectors: list[np.ndarray] = []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                try:
                    found = client(part)
                except Exception:  # noqa: BLE001 - any failure of a remote client
                    found = [None] * len(part)
                for v in found:
                    x = np.zeros(dim, np.float32)
                    if v is not None:
                        x[: min(dim, len(v))] = v[:dim]
                    length = np.linalg.norm(x)
                    vectors.append(x / length if length > 0 else x)
            m = np.concatenate(vectors) if vectors else np.zeros(0, np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dim, pa.int32()), pa.array(m, pa.float32()))
            yield pa.RecordBatch.from_arrays([rows.column(0), lists, pa.array([not v.any() for v in vectors], pa.bool_())], [key, "embedding", "failed"])

    kind = dict(chunks.dtypes)[key]
    return chunks.select(key, embedded_text()).mapInArrow(run, f"{key} {kind}, embedding array<float>, failed boolean")


#: What a chat connector gets of a request and what it gives: its tokens.
Answerer = Callable[[str, str, list[dict[str, str]]], Iterator[str]]


def answer(requests: DataFrame, connector: Answerer, key: str = "qid") -> DataFrame:
    """(key, pos, token, error): the tokens of each request's answer in order, by a pluggable connector.

    requests: key, provider, model, messages (role, content). A connector that fails ends its request
    with a row that has the error and no token; an empty answer gives no row. One Arrow map; requests don't wait for each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, provider, model, messages in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = 0
                try:
                    for n, token in enumerate(connector(provider or "ollama", model or "", messages or []), 1):  # noqa: B007
                        out.append((k, n - 1, token, None))
                except Exception as error:  # noqa: BLE001 - any failure of a remote model
                    out.append((k, n, None, str(error)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [key, "pos", "token", "error"])

    kind = dict(requests.dtypes)[key]
    return requests.select(key, "provider", "model", "messages").mapInArrow(run, f"{key} {kind}, pos bigint, token string, error string")
