"""The pN_ queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.bpe import encode_column
from foliant.llm.labels import fit_profiles, label_segments, undeclared
from foliant.llm.mixture import mixture
from foliant.llm.neighbours import similar_pairs
from foliant.llm.pairs import broken_pairs
from foliant.llm.pieces import cut_chunks, split_chunks
from foliant.llm.reading import graded, reading_levels
from foliant.llm.scans import noise_kinds, repaired
from foliant.llm.survivors import PLACEHOLDERS, best_records, surviving_records
from foliant.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_pairs(table(spark, d, "chat_messages"), table(spark, d, "documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return undeclared(table(spark, d, "chunks"), table(spark, d, "parsing_settings"), table(spark, d, "documents"))


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = label_segments(table(spark, d, "chunks"), fit_profiles(table(spark, d, "documents")))
    return rows.dropDuplicates(["chunk_id", "segment"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(table(spark, d, "chunk_embeddings"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return cut_chunks(p4_pieces(spark, d))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_chunks(table(spark, d, "chunks"), table(spark, d, "parsing_settings"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return noise_kinds(table(spark, d, "chunks"), table(spark, d, "parsing_settings"), table(spark, d, "documents"))


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return repaired(table(spark, d, "chunks"), table(spark, d, "parsing_settings"), table(spark, d, "documents")).dropDuplicates(["chunk_id"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return best_records(table(spark, d, "documents")).select("group_doc_id", "best_doc_id")


def p6_survivors(spark: SparkSession, d: str) -> DataFrame:
    return surviving_records(table(spark, d, "documents"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(table(spark, d, "documents"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_raked(spark: SparkSession, d: str) -> DataFrame:
    """Languages and topics of the mixture: their shares in the sources, the wanted and the reached ones."""
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[2]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return graded(reading_levels(table(spark, d, "documents"), table(spark, d, "reading_samples"), mixed=False))


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(table(spark, d, "documents"), table(spark, d, "reading_samples"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_segments": p2_segments, "p3_found": p3_found, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p5_repaired": p5_repaired, "p6_found": p6_found, "p6_survivors": p6_survivors, "p7_ids": p7_ids, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_raked": p8_raked, "p9_found": p9_found, "p9_levels": p9_levels}


# White space and placeholders as in the operators.
_SP = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"
_NONE = ", ".join(f"'{p}'" for p in PLACEHOLDERS)


def _strip(c: str) -> str:
    return "regexp_replace(" + c + ", '^[" + _SP + "]+|[" + _SP + "]+$', '', 'g')"


def _blank(c: str) -> str:
    return "NOT coalesce(regexp_matches(" + c + ", '[^" + _SP + "]'), false)"


def _real(c: str) -> str:
    return f"coalesce(lower({_strip(c)}) NOT IN ({_NONE}), false)"


P4_SQL = rf"""WITH s AS (SELECT notebook_id, min(chunk_size) AS size FROM parsing_settings WHERE chunk_size > 0 GROUP BY 1)
SELECT DISTINCT c.chunk_id FROM chunks c JOIN s USING (notebook_id)
WHERE c.chunk_id IS NOT NULL AND len(list_filter(regexp_split_to_array(c.chunk_text, '[{_SP}]+'), lambda x: x <> '')) > s.size
AND NOT EXISTS (SELECT 1 FROM chunks o WHERE o.parent_chunk_id = c.chunk_id AND o.chunk_id IS DISTINCT FROM c.chunk_id)"""

P6_SQL = rf"""WITH RECURSIVE raw AS (SELECT *, regexp_replace(lower({_strip('file_hash')}), '^sha-?256\s*[:=\-]?\s*|^0x', '') AS x, nullif(lower(regexp_replace(text, '[{_SP}]+', '', 'g')), '') AS t FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT *, CASE WHEN regexp_full_match(x, '[0-9a-f]{{64}}') AND x <> repeat(x[1], 64) THEN x END AS h FROM raw),
loose AS (SELECT DISTINCT t FROM d WHERE h IS NULL AND t IS NOT NULL),
e AS (SELECT DISTINCT h, t FROM d SEMI JOIN loose USING (t) WHERE h IS NOT NULL),
reach(h, r) AS (SELECT h, h FROM e UNION SELECT reach.h, e2.h FROM reach JOIN e e1 ON e1.h = reach.r JOIN e e2 ON e2.t = e1.t),
label AS (SELECT h, min(r) AS l FROM reach GROUP BY 1),
via AS (SELECT t, min(l) AS v FROM e JOIN label USING (h) GROUP BY 1),
g AS (SELECT d.*, coalesce(l, d.h, v, 'text:' || d.t, 'doc:' || doc_id) AS g,
  NOT (coalesce(is_indexed, false) AND {_blank('index_error')}) AS unusable,
  {_real('title')}::INT + (len(list_filter(authors, lambda a: {_real('a')})) > 0)::INT + coalesce(year BETWEEN 1450 AND 2100, false)::INT AS filled
  FROM d LEFT JOIN label ON label.h = d.h LEFT JOIN via ON via.t = d.t AND d.h IS NULL)
SELECT min(doc_id) AS group_doc_id, arg_min(doc_id, k) AS best_doc_id FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY unusable, filled DESC, indexed_at DESC NULLS LAST, doc_id) AS k FROM (SELECT g, doc_id, unusable, coalesce(filled, 0) AS filled, indexed_at FROM g))
GROUP BY g HAVING min(doc_id) <> max(doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL, "p6_found": P6_SQL}
