"""Vector and hybrid retrieval in batches of queries: filters, fusion, normalisation, thresholds, fallbacks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import basename, filled
from foliant.operators import fulltext
from foliant.session import cut

RRF_K = 60
# Least normalised score of each chat mode; other modes have none.
THRESHOLDS = {"rag": 0.75, "model": 0.50}


def candidate_depth(top_n: int) -> int:
    return max(top_n * 3, 10)


def searchable(chunks: DataFrame, documents: DataFrame, selected: list | None = None, disabled_tags: DataFrame | None = None, document_tags: DataFrame | None = None) -> DataFrame:
    """Enabled chunks of enabled documents, with the documents' columns prefixed ``d_``.

    selected: document ids; none or an empty list means all. A document with
    any disabled tag is left out.
    """
    docs = documents.filter(F.col("is_enabled"))
    if selected:
        docs = docs.filter(F.col("doc_id").isin(selected))
    if disabled_tags is not None and document_tags is not None:
        barred = document_tags.join(disabled_tags.select("tag"), "tag", "left_semi").select("doc_id")
        docs = docs.join(barred, "doc_id", "left_anti")
    docs = docs.select(*[F.col(c).alias(c if c == "doc_id" else f"d_{c}") for c in docs.columns if c != "text"])
    return chunks.filter(F.col("is_enabled")).join(docs, "doc_id")


def best(hits: DataFrame, k: int, by: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank from 1; the window keeps only k rows per group and partition before its shuffle."""
    return hits.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("bigint"))


#: Rows of vectors, and of queries, that meet in one task.
VECTOR_BLOCK, QUERY_BLOCK = 32_768, 2_048


def _padded(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, short ones padded with zeros, which changes neither products nor lengths."""
    lists = column.combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().fill_null(0).to_numpy().astype(np.float64)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)] = flat
    return out


def _block_top(k: int, key: str, names: list[str]) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        asked = t.filter(t["_asks"])
        there = t.filter(pc.invert(t["_asks"]))
        if not len(asked) or not len(there):
            return pa.Table.from_batches([], schema=t.select(names).schema.append(pa.field("score", pa.float64())))
        width = max(1, pc.max(pc.list_value_length(t["_v"])).as_py() or 1)
        q, v = _padded(asked["_v"], width), _padded(there["_v"], width)
        norms = [np.linalg.norm(m, axis=1) for m in (q, v)]
        q, v = (m / np.where(n == 0, 1.0, n)[:, None] for m, n in zip((q, v), norms, strict=True))
        keys = there[key].to_numpy()
        rows, cols, scores = [], [], []
        for at in range(0, len(q), 256):
            score = np.round(q[at : at + 256] @ v.T, 9)
            for i, line in enumerate(score, at):
                few = np.arange(len(line)) if len(line) <= k else np.flatnonzero(line >= np.partition(line, -k)[-k])
                top = few[np.lexsort((keys[few], -line[few]))][:k]
                rows.append(np.full(len(top), i))
                cols.append(top)
                scores.append(line[top])
        rows, cols = pa.array(np.concatenate(rows)), pa.array(np.concatenate(cols))
        out = {n: there[key].take(cols) if n == key else asked[n].take(rows) for n in names}
        return pa.table({**out, "score": pa.array(np.concatenate(scores))})

    return run


def vector_search(queries: DataFrame, vectors: DataFrame, k: int, group: str | None = "notebook_id", key: str = "chunk_seq") -> DataFrame:
    """(qid, group, key, score, rank): the k most similar vectors of each query's group by cosine; ties go to the smaller key.

    queries: qid, group, qvec; vectors: group, key, embedding. A group's vectors
    and queries are cut into blocks by their number; each pair of blocks is one
    matrix product that keeps k rows per query, so no task holds a whole group.
    Without a group every query meets every vector, in the same blocks.
    Zero vectors score 0; shorter ones count as padded with zeros; null vectors take no part.
    """
    if group is None:
        one = F.lit(0).alias("_all")
        return vector_search(queries.select("qid", "qvec", one), vectors.select(key, "embedding", one), k, "_all", key).drop("_all")
    q = queries.filter(F.col("qvec").isNotNull()).select("qid", group, F.col("qvec").cast("array<float>").alias("_v"))
    v = vectors.filter(F.col("embedding").isNotNull()).select(group, key, F.col("embedding").cast("array<float>").alias("_v"))
    blocks = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    sizes = v.groupBy(group).agg(F.count(F.lit(1)).alias("_nv")).join(q.groupBy(group).agg(F.count(F.lit(1)).alias("_nq")), group)
    sizes = sizes.select(group, blocks("_nv", VECTOR_BLOCK).alias("_vb"), blocks("_nq", QUERY_BLOCK).alias("_qb"))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n).cast("bigint")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    qs = q.join(sizes, group).select("qid", group, F.lit(None).cast(dict(v.dtypes)[key]).alias(key), "_v", F.lit(True).alias("_asks"), part("qid", "_qb").alias("_qi"), every("_vb").alias("_vi"))
    vs = v.join(sizes, group).select(F.lit(None).cast(dict(q.dtypes)["qid"]).alias("qid"), group, key, "_v", F.lit(False).alias("_asks"), part(key, "_vb").alias("_vi"), every("_qb").alias("_qi"))
    names = ["qid", group, key]
    schema = ", ".join(f"{n} {dict(qs.dtypes)[n]}" for n in names) + ", score double"
    scored = qs.unionByName(vs).groupBy(group, "_qi", "_vi").applyInArrow(_block_top(k, key, names), schema)
    return best(scored, k, ["qid"], [F.desc("score"), F.asc(key)])


def fuse(vector_hits: DataFrame, text_hits: DataFrame, top_n: int, key: str = "chunk_seq") -> DataFrame:
    """(qid, key, rrf, vec_rank, fts_rank, rank): reciprocal-rank fusion; ties by vector rank, then by text rank.

    A query without vector hits keeps its text order and has no fused score.
    """
    v = vector_hits.select("qid", key, F.col("rank").alias("vec_rank"))
    t = text_hits.select("qid", key, F.col("rank").alias("fts_rank"))
    merged = v.join(t, ["qid", key], "full")
    part = lambda c: F.coalesce(1 / (RRF_K + F.col(c)), F.lit(0.0))
    merged = merged.withColumn("_vectors", F.max(F.col("vec_rank").isNotNull()).over(Window.partitionBy("qid")))
    merged = merged.withColumn("rrf", F.when(F.col("_vectors"), F.round(part("vec_rank") + part("fts_rank"), 12)).otherwise(0.0))
    return best(merged.drop("_vectors"), top_n, ["qid"], [F.desc("rrf"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("fts_rank"), F.asc(key)])


def normalized_scores(hits: DataFrame, score: str = "rrf", by: str = "qid") -> DataFrame:
    """Scores relative to the query's best; all 1 where the best is not positive."""
    most = F.max(score).over(Window.partitionBy(by))
    return hits.withColumn("score", F.when(most <= 0, F.lit(1.0)).otherwise(F.round(F.col(score) / most, 9)))


def above(hits: DataFrame, mode: str, score: str = "score") -> DataFrame:
    return hits.filter(F.col(score) >= THRESHOLDS.get(mode, 0.0))


def result_columns(row: dict[str, Column] | None = None) -> list[Column]:
    """A hit's public columns from a ``searchable`` row: source, page, section, text and constant type."""
    page = F.when(F.col("page_number").isNull() | (F.col("page_number") == 0), 1).otherwise(F.col("page_number"))
    return [
        F.col("doc_id").alias("source_id"),
        F.coalesce(filled("d_filepath"), filled("d_filename"), F.lit("")).alias("source"),
        page.cast("bigint").alias("page"),
        F.col("chunk_id").alias("section_id"),
        F.coalesce(filled("section_header"), F.lit("__root__")).alias("section_title"),
        F.coalesce("chunk_text", F.lit("")).alias("text"),
        F.lit("text").alias("type"),
    ]


def citation_columns() -> list[Column]:
    """filename, page, section, snippet and clamped score of a result row."""
    return [
        F.coalesce(filled(basename("source")), F.lit("unknown")).alias("filename"),
        F.col("page"),
        F.coalesce(filled("section_title"), F.col("section_id")).alias("section"),
        F.col("text").substr(1, 280).alias("snippet"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))).alias("score"),
    ]


def text_hits(queries: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame], rows: DataFrame, k: int, group: str = "notebook_id", key: str = "chunk_seq") -> DataFrame:
    """(qid, key, rank, stage): the text hits of a batch of questions among ``rows`` (searchable chunks: group, key, chunk_text).

    A question that is no query of the grammar finds nothing. One without a full-text hit is searched as substrings, one
    without such a hit gets the newest rows of its group; only those questions take part in these stages. ``index`` covers all chunks, for its statistics.
    """
    order = [F.desc("score"), F.asc(key)]
    asked = cut(fulltext.plans(queries.select("qid", group, F.col("query").alias("_q"), "query")).withColumnRenamed("_q", "query"))
    keys = rows.select(key)
    found = fulltext.answered(asked.drop("query"), *index, group, key).join(keys, key, "left_semi")
    first = cut(best(found, k, ["qid"], order).select("qid", key, "rank", F.lit(0).alias("stage")))
    open_ = asked.filter(F.col("ok") & (F.size(F.split(F.trim("query"), r"\s+")) > 0)).select("qid", group, "query").join(first.select("qid").distinct(), "qid", "left_anti")
    second = cut(best(fulltext.like_hits(open_, index[0], rows, group, key), k, ["qid"], [F.asc(key)]).select("qid", key, "rank", F.lit(1).alias("stage")))
    rest = open_.join(second.select("qid").distinct(), "qid", "left_anti")
    newest = best(rows.select(group, key).join(rest.select(group).distinct(), group, "left_semi"), k, [group], [F.desc(key)])
    third = rest.select("qid", group).join(newest, group).select("qid", key, "rank", F.lit(2).alias("stage"))
    return first.unionByName(second).unionByName(third)


def fallback_chain(queries: DataFrame, text_hits: DataFrame, like_hits: DataFrame, rows: DataFrame, k: int, group: str = "notebook_id", key: str = "chunk_seq") -> DataFrame:
    """(qid, key, stage): full-text hits; for queries without any the substring hits; else the newest rows of the group."""
    first = text_hits.select("qid", key, "rank", F.lit(0).alias("stage"))
    second = best(like_hits, k, ["qid"], [F.asc(key)]).select("qid", key, "rank", F.lit(1).alias("stage"))
    newest = best(rows.select(group, key), k, [group], [F.desc(key)])
    third = queries.select("qid", group).join(newest, group).select("qid", key, "rank", F.lit(2).alias("stage"))
    every = first.unionByName(second).unionByName(third)
    return every.withColumn("_least", F.min("stage").over(Window.partitionBy("qid"))).filter("stage = _least").drop("_least")
