"""The engine's queries over the test tables, each beside the DuckDB statement that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions import vectors as V
from foliant.operators import chat, chunkers, fulltext, retrieval, state
from foliant.session import cut, table
from foliant.sources import files
from foliant.streaming import events as E

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


class Part(str):
    """A piece of SQL with ``@`` for its argument."""

    def format(self, x: str) -> str:
        return self.replace("@", x)


# SQL building blocks. White space and line ends as in functions.text.
SP = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"
LINES = Part(
    rf"list_filter(list_transform(regexp_split_to_array(coalesce(@, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '^[{SP}]+|[{SP}]+$', '', 'g')), lambda x: x <> '')"
)
WORDS = Part(rf"list_filter(regexp_split_to_array(coalesce(@, ''), '[{SP}]+'), lambda x: x <> '')")
STRIP = Part(rf"regexp_replace(@, '^[{SP}]+|[{SP}]+$', '', 'g')")
FOLD = fulltext.fold_map()
TOKENS = Part(rf"regexp_extract_all(translate(lower(coalesce(@, '')), '{FOLD[0]}', '{FOLD[1]}'), '[\p{{L}}\p{{N}}\p{{Co}}]+')")
HEADER = rf"^(#{{1,6}}[{SP}]+.+|\p{{Nd}}+(?:\.\p{{Nd}}+)*[{SP}]+.+)$"
BLOCKS = rf"""
raw AS (SELECT doc_id, {LINES.format('text')} AS ls FROM documents),
lined AS (SELECT doc_id, ls[i] AS line, i - 1 AS pos FROM raw, unnest(range(1, len(ls) + 1)) AS u(i)),
marked AS (SELECT doc_id, pos, line, CASE WHEN regexp_matches(line, '{HEADER}') THEN regexp_replace(line, '^#{{1,6}}[{SP}]*', '') END AS h FROM lined),
blocks AS (SELECT doc_id, pos, coalesce(h, line) AS text, CASE WHEN h IS NULL THEN 'text' ELSE 'header' END AS chunk_type,
  last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section_header FROM marked)"""


def windows_sql(tokens: str, size: str, least: str) -> str:
    """Token windows with short ones doubled, as a list of strings."""
    part = f"({tokens})[o + 1 : o + {size}]"
    short = f"greatest(1, floor(len({part}) * 1.3::DOUBLE)) < {least} AND o + {size} < len({tokens})"
    return f"list_transform(range(0, len({tokens}), {size}), lambda o: array_to_string(CASE WHEN {short} THEN ({tokens})[o + 1 : o + 2 * {size}] ELSE {part} END, ' '))"


SIZE, OVERLAP, LEAST, CONTEXT = 60, 8, 20, 48
GENERAL = f"""
attached AS (SELECT *, CASE WHEN lag(chunk_type) OVER (PARTITION BY doc_id ORDER BY pos) = 'header' THEN lag(text) OVER (PARTITION BY doc_id ORDER BY pos) END AS b FROM blocks),
bodies AS (SELECT doc_id, pos, coalesce(b, section_header) AS section_header, {WORDS.format("concat_ws(chr(10), b, text)")} AS w FROM attached WHERE chunk_type <> 'header'),
pieces AS (SELECT doc_id, pos, section_header, {windows_sql('w', str(SIZE), str(LEAST))} AS ps FROM bodies),
chunks_ AS (SELECT doc_id, pos, section_header, i AS sub, ps[i] AS chunk_text FROM pieces, unnest(range(1, len(ps) + 1)) AS u(i)),
general AS (SELECT doc_id, row_number() OVER d - 1 AS chunk_index, section_header, chunk_text, lag(chunk_text) OVER d AS p, lead(chunk_text) OVER d AS n FROM chunks_ WINDOW d AS (PARTITION BY doc_id ORDER BY pos, sub))"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return chunkers.blocks(table(spark, d, "documents").select("doc_id", "text"))


@query(f"WITH {BLOCKS} SELECT doc_id, pos, text, chunk_type, section_header FROM blocks")
def block_parse(spark, d):
    return _blocks(spark, d)


@query(f"WITH {BLOCKS} SELECT doc_id, section_header, count(*) AS n_lines, min(pos) AS first_pos FROM blocks GROUP BY 1, 2")
def sticky_header(spark, d):
    return _blocks(spark, d).groupBy("doc_id", "section_header").agg(F.count(F.lit(1)).alias("n_lines"), F.min("pos").alias("first_pos"))


@query(f"WITH {BLOCKS}, {GENERAL} SELECT doc_id, chunk_index, section_header, chunk_text FROM general")
def chunk_general(spark, d):
    return chunkers.general(_blocks(spark, d), SIZE, OVERLAP, LEAST).select("doc_id", "chunk_index", "section_header", "chunk_text")


@query(
    f"""WITH {BLOCKS}, {GENERAL}, cut AS (SELECT *, {WORDS.format('p')} AS pw, {WORDS.format('n')} AS nw FROM general)
SELECT doc_id, chunk_index, CASE WHEN p IS NOT NULL THEN array_to_string(pw[greatest(1, len(pw) - {OVERLAP} + 1):len(pw)], ' ') END AS prev_chunk_tail,
CASE WHEN n IS NOT NULL THEN array_to_string(nw[1:{OVERLAP}], ' ') END AS next_chunk_head FROM cut"""
)
def chunk_overlap_ctx(spark, d):
    return chunkers.general(_blocks(spark, d), SIZE, OVERLAP, LEAST).select("doc_id", "chunk_index", "prev_chunk_tail", "next_chunk_head")


@query(
    f"""WITH {BLOCKS}, {GENERAL}, parts AS (SELECT *, list_filter([p[greatest(1, length(p) - {CONTEXT} + 1):length(p)], chunk_text, n[1:{CONTEXT}]], lambda x: x IS NOT NULL AND x <> '') AS xs FROM general)
SELECT doc_id, chunk_index, chunk_text, CASE WHEN len(xs) > 1 THEN array_to_string(xs, ' ') END AS embedding_text FROM parts"""
)
def chunk_context_enrichment(spark, d):
    return chunkers.context_enrichment(_blocks(spark, d), SIZE, OVERLAP, LEAST, CONTEXT).select("doc_id", "chunk_index", "chunk_text", "embedding_text")


@query(
    rf"""WITH {BLOCKS},
levelled AS (SELECT *, CASE WHEN chunk_type = 'header' THEN CASE WHEN regexp_matches(text, '^(?i:Глава|Chapter|РАЗДЕЛ|SECTION)\s+\d+') THEN 1 WHEN regexp_matches(text, '^\d+\.\d+\s+[А-ЯA-Z\w]') THEN 2 WHEN regexp_matches(text, '^\d+\.\d+\.\d+\s+') THEN 3 END END AS lv FROM blocks),
marks AS (SELECT *, count(lv) OVER w AS sec,
 last_value(CASE WHEN lv = 1 THEN text END IGNORE NULLS) OVER w AS t1, coalesce(max(CASE WHEN lv = 1 THEN pos END) OVER w, -1) AS p1,
 last_value(CASE WHEN lv = 2 THEN text END IGNORE NULLS) OVER w AS t2, coalesce(max(CASE WHEN lv = 2 THEN pos END) OVER w, -1) AS p2,
 last_value(CASE WHEN lv = 3 THEN text END IGNORE NULLS) OVER w AS t3, coalesce(max(CASE WHEN lv = 3 THEN pos END) OVER w, -1) AS p3
 FROM levelled WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
crumbs AS (SELECT doc_id, sec, pos, text, nullif(concat_ws(' > ', t1, CASE WHEN p2 > p1 THEN t2 END, CASE WHEN p3 > greatest(p1, p2) THEN t3 END), '') AS crumb FROM marks WHERE lv IS NULL),
sections AS (SELECT doc_id, sec, min_by(crumb, pos) AS c0, any_value(crumb) AS crumb, string_agg(text, chr(10) ORDER BY pos) AS body FROM crumbs GROUP BY 1, 2),
cut AS (SELECT doc_id, sec, crumb, body, {WORDS.format('body')} AS w FROM sections),
pieces AS (SELECT doc_id, sec, crumb, CASE WHEN (CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, floor(len(w) * 1.3::DOUBLE)) END) <= {SIZE} THEN [body] ELSE {windows_sql('w', str(SIZE), str(LEAST))} END AS ps FROM cut),
parts AS (SELECT doc_id, sec, crumb, i, ps[i] AS t FROM pieces, unnest(range(1, len(ps) + 1)) AS u(i))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec, i) - 1 AS chunk_index, crumb AS section_header, CASE WHEN crumb IS NULL THEN t ELSE {STRIP.format("concat_ws(chr(10) || chr(10), crumb, t)")} END AS chunk_text FROM parts"""
)
def chunk_hierarchy(spark, d):
    return chunkers.hierarchy(_blocks(spark, d), "technical_manual", SIZE, LEAST).drop("page_number")


WHOLE = "whole AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY pos) AS text FROM blocks WHERE chunk_type <> 'header' GROUP BY 1)"


@query(
    f"""WITH {BLOCKS}, {WHOLE}, w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM whole),
parents AS (SELECT doc_id, i AS p, array_to_string(w[i * 160 + 1 : i * 160 + 160], ' ') AS chunk_text, w[i * 160 + 1 : i * 160 + 160] AS pw FROM w, unnest(range(0, (len(w) + 159) // 160)) AS u(i)),
children AS (SELECT doc_id, p, chunk_text, i AS c, array_to_string(pw[i * 48 + 1 : i * 48 + 48], ' ') AS embedding_text FROM parents, unnest(range(0, (len(pw) + 47) // 48)) AS u(i))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, c) - 1 AS chunk_index, chunk_text, embedding_text, 'Блок ' || (p + 1) AS section_header, doc_id || ':pcr_parent:' || p AS parent_chunk_id FROM children"""
)
def chunk_pcr(spark, d):
    return chunkers.parent_child(_blocks(spark, d), 160, 48)


@query(
    f"""WITH {BLOCKS}, {WHOLE}, cut AS (SELECT doc_id, list_filter(list_transform(string_split(text, ';'), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS ps FROM whole)
SELECT doc_id, i - 1 AS chunk_index, ps[i] AS chunk_text FROM cut, unnest(range(1, len(ps) + 1)) AS u(i)"""
)
def chunk_symbol(spark, d):
    return chunkers.by_symbol(_blocks(spark, d), ";")


@query(
    rf"""WITH RECURSIVE t AS (SELECT DISTINCT ON (chunk_id) chunk_id, chunk_text, list_filter(regexp_split_to_array(coalesce(chunk_text, ''), '\r\n|[\n\r]'), lambda x: regexp_matches(x, '[^{SP}]')) AS ls FROM chunks WHERE chunk_type = 'table'),
packed(chunk_id, ls, i, cur, n, done) AS (
 SELECT chunk_id, ls, 3, []::VARCHAR[], 0, NULL::VARCHAR FROM t WHERE len(ls) > 2
 UNION ALL
 SELECT chunk_id, ls, i + 1,
  CASE WHEN i > len(ls) THEN [] WHEN full_ THEN [ls[i]] ELSE list_append(cur, ls[i]) END,
  CASE WHEN full_ OR i > len(ls) THEN n + 1 ELSE n END,
  CASE WHEN full_ OR i > len(ls) THEN array_to_string(list_concat(ls[1:2], cur), chr(10)) END
 FROM (SELECT *, i <= len(ls) AND len(cur) > 0 AND greatest(1, floor(len({WORDS.format("array_to_string(list_concat(ls[1:2], list_append(cur, ls[i])), chr(10))")}) * 1.3::DOUBLE)) > 40 AS full_ FROM packed WHERE i <= len(ls) + 1))
SELECT chunk_id, (n - 1)::BIGINT AS piece, done AS piece_text FROM packed WHERE done IS NOT NULL
UNION ALL SELECT chunk_id, 0::BIGINT, chunk_text FROM t WHERE len(ls) <= 2"""
)
def chunk_table_pack(spark, d):
    rows = table(spark, d, "chunks").filter("chunk_type = 'table'").dropDuplicates(["chunk_id"])
    return rows.select("chunk_id", F.posexplode(chunkers.packed_table(F.col("chunk_text"), F.lit(40))).alias("piece", "piece_text")).withColumn("piece", F.col("piece").cast("bigint"))


PER = """per AS (SELECT notebook_id, min(chunking_method) AS m, min(doc_type) AS doc_type, min(chunk_size) AS size, min(min_chunk_size) AS least, min(context_window) AS cw, min(parent_chunk_size) AS ps, min(child_chunk_size) AS cs, min(symbol_separator) AS sep FROM parsing_settings GROUP BY 1),
conf AS (SELECT doc_id, lower(trim(coalesce(m, 'general'))) AS method, coalesce(doc_type, 'technical_manual') AS doc_type, coalesce(size, 200) AS size, coalesce(least, 50) AS least, coalesce(cw, 128) AS cw, coalesce(ps, 800) AS ps, coalesce(cs, 96) AS cs, coalesce(nullif(sep, ''), '---chunk---') AS sep FROM documents LEFT JOIN per ON source = notebook_id)"""
LEVEL_SQL = "CASE " + " ".join(
    f"WHEN doc_type = '{kind}' THEN CASE " + " ".join(f"WHEN regexp_matches(text, '{pattern}') THEN {level}" for level, pattern in rules) + " END"
    for kind, rules in {**chunkers.LEVELS, "technical_manual": [(n, p.replace("^(?i)(?:", "(?i)^(?:")) for n, p in chunkers.LEVELS["technical_manual"]]}.items()
) + " END"


@query(
    rf"""WITH {BLOCKS}, {PER},
typed AS (SELECT b.*, CASE WHEN method IN ('context_enrichment', 'hierarchy', 'pcr', 'symbol') THEN method ELSE 'general' END AS method, CASE WHEN doc_type IN ('gost', 'technical_manual', 'api_docs', 'markdown') THEN doc_type ELSE 'technical_manual' END AS doc_type, size, least, cw, ps, cs, sep FROM blocks b JOIN conf USING (doc_id)),
attached AS (SELECT *, CASE WHEN lag(chunk_type) OVER w = 'header' THEN lag(text) OVER w END AS b FROM typed WHERE method IN ('general', 'context_enrichment') WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
bodies AS (SELECT *, coalesce(b, section_header) AS head, {WORDS.format("concat_ws(chr(10), b, text)")} AS w FROM attached WHERE chunk_type <> 'header'),
pieces AS (SELECT doc_id, pos, head, method, cw, {windows_sql('w', 'greatest(1, size)', 'least')} AS xs FROM bodies),
flat AS (SELECT doc_id, pos, head, method, cw, i AS sub, xs[i] AS t FROM pieces, unnest(range(1, len(xs) + 1)) AS u(i)),
near AS (SELECT *, row_number() OVER d - 1 AS idx, lag(t) OVER d AS p, lead(t) OVER d AS n FROM flat WINDOW d AS (PARTITION BY doc_id ORDER BY pos, sub)),
windows AS (SELECT doc_id, idx, t, head, method, list_filter([CASE WHEN cw > 0 THEN p[greatest(1, length(p) - cw + 1):length(p)] END, t, CASE WHEN cw > 0 THEN n[1:cw] END], lambda x: x IS NOT NULL AND x <> '') AS xs FROM near),
whole AS (SELECT doc_id, method, any_value(ps) AS ps, any_value(cs) AS cs, any_value(sep) AS sep, string_agg(text, chr(10) ORDER BY pos) AS text FROM typed WHERE method IN ('pcr', 'symbol') AND chunk_type <> 'header' GROUP BY ALL),
pw AS (SELECT doc_id, ps, cs, {WORDS.format('text')} AS w FROM whole WHERE method = 'pcr'),
parents AS (SELECT doc_id, cs, i AS p, w[i * ps + 1 : i * ps + ps] AS pw FROM pw, unnest(range(0, (len(w) + ps - 1) // ps)) AS u(i)),
children AS (SELECT doc_id, p, i AS c, array_to_string(pw, ' ') AS t, array_to_string(pw[i * cs + 1 : i * cs + cs], ' ') AS e FROM parents, unnest(range(0, (len(pw) + cs - 1) // cs)) AS u(i)),
signs AS (SELECT doc_id, list_filter(list_transform(string_split(text, sep), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS xs FROM whole WHERE method = 'symbol'),
levelled AS (SELECT *, CASE WHEN chunk_type = 'header' THEN {LEVEL_SQL} END AS lv FROM typed WHERE method = 'hierarchy'),
marks AS (SELECT *, count(lv) OVER w AS sec,
 last_value(CASE WHEN lv = 1 THEN text END IGNORE NULLS) OVER w AS t1, coalesce(max(CASE WHEN lv = 1 THEN pos END) OVER w, -1) AS p1, last_value(CASE WHEN lv = 2 THEN text END IGNORE NULLS) OVER w AS t2, coalesce(max(CASE WHEN lv = 2 THEN pos END) OVER w, -1) AS p2,
 last_value(CASE WHEN lv = 3 THEN text END IGNORE NULLS) OVER w AS t3, coalesce(max(CASE WHEN lv = 3 THEN pos END) OVER w, -1) AS p3, last_value(CASE WHEN lv = 4 THEN text END IGNORE NULLS) OVER w AS t4, coalesce(max(CASE WHEN lv = 4 THEN pos END) OVER w, -1) AS p4
 FROM levelled WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
crumbs AS (SELECT doc_id, sec, pos, text, size, least, nullif(concat_ws(' > ', t1, CASE WHEN p2 > p1 THEN t2 END, CASE WHEN p3 > greatest(p1, p2) THEN t3 END, CASE WHEN p4 > greatest(p1, p2, p3) THEN t4 END), '') AS crumb FROM marks WHERE lv IS NULL),
sections AS (SELECT doc_id, sec, any_value(crumb) AS crumb, any_value(size) AS size, any_value(least) AS least, string_agg(text, chr(10) ORDER BY pos) AS body FROM crumbs GROUP BY 1, 2),
cut AS (SELECT *, {WORDS.format('body')} AS w FROM sections),
parted AS (SELECT doc_id, sec, crumb, CASE WHEN (CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, floor(len(w) * 1.3::DOUBLE)) END) <= greatest(1, size) THEN [body] ELSE {windows_sql('w', 'greatest(1, size)', 'least')} END AS xs FROM cut),
leaves AS (SELECT doc_id, sec, crumb, i, xs[i] AS t FROM parted, unnest(range(1, len(xs) + 1)) AS u(i))
SELECT doc_id, idx AS chunk_index, t AS chunk_text, head AS section_header, CASE WHEN method = 'context_enrichment' AND len(xs) > 1 THEN array_to_string(xs, ' ') END AS embedding_text, method FROM windows
UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, c) - 1, t, 'Блок ' || (p + 1), e, 'pcr' FROM children
UNION ALL SELECT doc_id, i - 1, xs[i], NULL, NULL, 'symbol' FROM signs, unnest(range(1, len(xs) + 1)) AS u(i)
UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec, i) - 1, CASE WHEN crumb IS NULL THEN t ELSE {STRIP.format("concat_ws(chr(10) || chr(10), crumb, t)")} END, crumb, NULL, 'hierarchy' FROM leaves"""
)
def chunk_by_settings(spark, d):
    return chunkers.chunk_by_settings(table(spark, d, "documents"), table(spark, d, "parsing_settings"))


@query(
    f"""SELECT chunk_seq, len(w) AS n_words, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, floor(len(w) * 1.3::DOUBLE))::BIGINT END AS n_tokens, length(chunk_text) AS n_chars,
coalesce(token_count = len(w), false) AS stored_right FROM (SELECT *, {WORDS.format('chunk_text')} AS w FROM chunks)"""
)
def token_counts(spark, d):
    n = T.word_count("chunk_text")
    return table(spark, d, "chunks").select("chunk_seq", n.alias("n_words"), T.token_count("chunk_text").alias("n_tokens"), F.char_length("chunk_text").cast("bigint").alias("n_chars"), F.coalesce(F.col("token_count") == n, F.lit(False)).alias("stored_right"))


@query(
    f"""WITH s AS (SELECT notebook_id, min(chunk_size) AS chunk_size FROM parsing_settings GROUP BY 1),
t AS (SELECT doc_id, source, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, floor(len(w) * 1.3::DOUBLE)) END AS n FROM (SELECT *, {WORDS.format('text')} AS w FROM documents))
SELECT doc_id, greatest(1, floor(n / greatest(1, coalesce(chunk_size, 200))) + 1)::BIGINT AS estimate FROM t LEFT JOIN s ON source = notebook_id"""
)
def chunk_estimate(spark, d):
    sizes = table(spark, d, "parsing_settings").groupBy("notebook_id").agg(F.min("chunk_size").alias("chunk_size"))
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("notebook_id"), T.token_count("text").alias("tokens")).join(sizes, "notebook_id", "left").fillna({"chunk_size": 200})
    return rows.select("doc_id", state.chunk_estimate(rows).alias("estimate"))


ONE = "once AS (SELECT DISTINCT ON (chunk_id) * FROM chunks WHERE chunk_id IS NOT NULL ORDER BY chunk_id, chunk_seq)"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk once, the delivery of the smallest row id; only chunks delivered several times are sorted."""
    rows = table(spark, d, "chunks").filter(F.col("chunk_id").isNotNull())
    several = rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("chunk_id")
    first = F.row_number().over(Window.partitionBy("chunk_id").orderBy("chunk_seq"))
    again = rows.join(several, "chunk_id", "left_semi").withColumn("_r", first).filter("_r = 1").drop("_r")
    return rows.join(several, "chunk_id", "left_anti").unionByName(again)


POST = f"""{ONE}, tok AS (SELECT notebook_id, chunk_seq, {TOKENS.format('chunk_text')} AS ts FROM once WHERE notebook_id IS NOT NULL),
post AS (SELECT notebook_id, chunk_seq, term, count(*) AS tf FROM (SELECT notebook_id, chunk_seq, unnest(ts) AS term FROM tok) GROUP BY ALL),
lens AS (SELECT notebook_id, chunk_seq, len(ts) AS len FROM tok),
stats AS (SELECT notebook_id, count(*) AS n, avg(len) AS avgdl FROM lens GROUP BY 1),
dfs AS (SELECT notebook_id, term, count(*) AS df FROM post GROUP BY ALL)"""
HEADINGS = "asked AS (SELECT DISTINCT notebook_id || '/' || section_header AS qid, notebook_id, section_header AS query FROM once WHERE section_header <> '')"
BM25 = f"""need AS (SELECT qid, notebook_id, unnest(list_distinct(ts)) AS term, len(list_distinct(ts)) AS need FROM (SELECT *, {TOKENS.format('query')} AS ts FROM asked)),
parts AS (SELECT qid, p.notebook_id, p.chunk_seq, need, (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2::DOUBLE * (0.25 + 0.75 * len / avgdl)) AS part
 FROM need JOIN post p USING (notebook_id, term) JOIN dfs USING (notebook_id, term) JOIN lens l ON l.notebook_id = p.notebook_id AND l.chunk_seq = p.chunk_seq JOIN stats s ON s.notebook_id = p.notebook_id),
scored AS (SELECT qid, notebook_id, chunk_seq, round(sum(part), 9) AS score FROM parts GROUP BY ALL HAVING count(*) = any_value(need))"""


def _headings(chunks: DataFrame) -> DataFrame:
    return chunks.filter("section_header <> '' AND notebook_id IS NOT NULL").select(F.concat_ws("/", "notebook_id", "section_header").alias("qid"), "notebook_id", F.col("section_header").alias("query")).distinct()


@query(f"WITH {POST} SELECT notebook_id, term, df, n, round(avgdl, 6) AS avgdl FROM dfs JOIN stats USING (notebook_id)")
def fts_df_stats(spark, d):
    postings, _, stats = fulltext.index(_chunks(spark, d).filter("notebook_id IS NOT NULL"))
    df = postings.groupBy("notebook_id", "term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(stats, "notebook_id").select("notebook_id", "term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {POST}, {HEADINGS}, {BM25} SELECT qid, chunk_seq, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_seq) AS rank FROM scored) WHERE rank <= 15")
def fts_bm25_topk(spark, d):
    chunks = _chunks(spark, d)
    hits = fulltext.search(_headings(chunks), chunks.filter("notebook_id IS NOT NULL"))
    ranked = retrieval.best(hits, retrieval.candidate_depth(5), ["qid"], [F.desc("score"), F.asc("chunk_seq")])
    return ranked.select("qid", "chunk_seq", F.round("score", 6).alias("score"), "rank")


GRAMMAR = {
    "bare": ("warm water", "list_contains(ts, 'warm') AND list_contains(ts, 'water')"),
    "or_not": ("filter OR valve NOT pump", "list_contains(ts, 'filter') OR (list_contains(ts, 'valve') AND NOT list_contains(ts, 'pump'))"),
    "phrase": ('"delivery list"', "contains(s, ' delivery list ')"),
    "plus": ("control + sheet", "contains(s, ' control sheet ')"),
    "prefix": ("measur*", "contains(s, ' measur')"),
    "first": ("^the", "starts_with(s, ' the ')"),
    "group": ("(lamp OR door) AND warm", "(list_contains(ts, 'lamp') OR list_contains(ts, 'door')) AND list_contains(ts, 'warm')"),
    "near": ("NEAR(night team, 3)", "regexp_matches(s, ' night (\\S+ ){0,3}team ') OR regexp_matches(s, ' team (\\S+ ){0,3}night ')"),
    "accent": ("últíma VISITA", "list_contains(ts, 'ultima') AND list_contains(ts, 'visita')"),
}


@query(
    f"WITH t AS (SELECT chunk_seq, ts, ' ' || array_to_string(ts, ' ') || ' ' AS s FROM (SELECT chunk_seq, {TOKENS.format('chunk_text')} AS ts FROM chunks))\n"
    + "\nUNION ALL ".join(f"SELECT '{name}' AS qid, chunk_seq FROM t WHERE {where}" for name, (_, where) in GRAMMAR.items())
)
def fts_or_not_phrase_prefix(spark, d):
    rows = fulltext.token_rows(table(spark, d, "chunks"), ["chunk_seq"], "chunk_text").withColumnRenamed("_t", "ts")
    hits = F.filter(F.array(*[F.when(fulltext.matching(q, "ts"), F.lit(name)) for name, (q, _) in GRAMMAR.items()]), lambda x: x.isNotNull())
    return rows.select(F.explode(hits).alias("qid"), "chunk_seq")


ENABLED = f"{ONE}, enabled AS (SELECT c.*, d.filename, d.filepath, d.source AS d_source FROM once c JOIN documents d USING (doc_id) WHERE c.is_enabled AND d.is_enabled)"


@query(f"WITH {ENABLED} SELECT notebook_id, chunk_seq, rank FROM (SELECT *, row_number() OVER (PARTITION BY notebook_id ORDER BY chunk_seq DESC) AS rank FROM enabled) WHERE rank <= 15")
def newest_fallback(spark, d):
    rows = retrieval.searchable(_chunks(spark, d), table(spark, d, "documents"))
    return retrieval.best(rows, 15, ["notebook_id"], [F.desc("chunk_seq")]).select("notebook_id", "chunk_seq", "rank")


# Questions in every form: as they are, as a phrase, with OR, no query at all, words nobody has beside one that is there, words nobody has.
FORMS = """forms AS (SELECT *, CASE abs(k) % 7 WHEN 0 THEN query || '?' WHEN 1 THEN '"' || query || '"' WHEN 2 THEN 'qqzz ' || lower(string_split(query, ' ')[1]) WHEN 3 THEN 'qqzz' WHEN 4 THEN replace(query, ' ', ' OR ') ELSE query END AS said,
 CASE abs(k) % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'phrase' WHEN 2 THEN 'like' WHEN 3 THEN 'new' WHEN 4 THEN 'or' ELSE 'and' END AS kind FROM plain WHERE regexp_full_match(query, '[A-Za-zÀ-ÿ ]+') AND NOT regexp_matches(query, '(^| )(AND|OR|NOT|NEAR)( |$)'))"""
FOUND = f"""strung AS (SELECT notebook_id, chunk_seq, len(ts) AS len, ' ' || array_to_string(ts, '  ') || ' ' AS s FROM tok),
phrases AS (SELECT qid, notebook_id, kind, need, unnest(ps) AS p FROM (SELECT *, len(ps) AS need FROM (SELECT *, CASE WHEN kind = 'phrase' THEN [' ' || array_to_string(ws, '  ') || ' '] ELSE list_transform(ws, lambda x: ' ' || x || ' ') END AS ps FROM (SELECT *, {TOKENS.format('query')} AS ws FROM forms WHERE kind IN ('and', 'or', 'phrase'))))),
met AS (SELECT p.notebook_id, p, chunk_seq, len, (length(s) - length(replace(s, p, ''))) / length(p) AS f FROM (SELECT DISTINCT notebook_id, p FROM phrases) p JOIN strung c ON c.notebook_id = p.notebook_id AND contains(s, p)),
often AS (SELECT notebook_id, p, count(*) AS df FROM met GROUP BY ALL),
points AS (SELECT qid, notebook_id, kind, need, chunk_seq, (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * f * 2.2 / (f + 1.2::DOUBLE * (0.25 + 0.75 * len / avgdl)) AS part
 FROM phrases JOIN met USING (notebook_id, p) JOIN often USING (notebook_id, p) JOIN stats USING (notebook_id)),
found AS (SELECT qid, chunk_seq, round(sum(part), 9) AS score FROM points GROUP BY qid, kind, chunk_seq HAVING any_value(kind) = 'or' OR count(*) = any_value(need)),
f0 AS (SELECT qid, chunk_seq, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_seq) AS rank FROM found SEMI JOIN ok USING (chunk_seq)),
open1 AS (SELECT * FROM forms WHERE kind <> 'none' AND qid NOT IN (SELECT qid FROM f0)),
l1 AS (SELECT qid, chunk_seq, row_number() OVER (PARTITION BY qid ORDER BY chunk_seq) AS rank FROM (SELECT DISTINCT qid, chunk_seq FROM (SELECT qid, notebook_id, unnest(string_split(translate(said, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ')) AS t FROM open1) JOIN once USING (notebook_id) SEMI JOIN ok USING (chunk_seq) WHERE t <> '' AND contains(translate(chunk_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), t))),
n2 AS (SELECT qid, chunk_seq, row_number() OVER (PARTITION BY qid ORDER BY chunk_seq DESC) AS rank FROM open1 JOIN once USING (notebook_id) SEMI JOIN ok USING (chunk_seq) WHERE qid NOT IN (SELECT qid FROM l1)),
texthits AS (SELECT *, 0 AS stage FROM f0 WHERE rank <= 15 UNION ALL SELECT *, 1 FROM l1 WHERE rank <= 15 UNION ALL SELECT *, 2 FROM n2 WHERE rank <= 15)"""
#: Chunks that may be found: enabled ones of enabled documents without a disabled tag (here: a file type).
BARRED = r"coalesce(regexp_matches(lower(d.filename), '\.docx$'), false)"
OK = f"ok AS (SELECT c.chunk_seq FROM once c JOIN documents d USING (doc_id) WHERE c.is_enabled AND d.is_enabled AND NOT {BARRED})"


def _forms(rows: DataFrame, k: str) -> DataFrame:
    """(qid, group, query) in the forms of FORMS."""
    plain = r"^[A-Za-zÀ-ÿ ]+$"
    rows = rows.filter(F.col("query").rlike(plain) & ~F.col("query").rlike(r"(^| )(AND|OR|NOT|NEAR)( |$)"))
    form, q = F.abs(F.expr(k)) % 7, F.col("query")
    first = F.lower(F.get(F.split(q, " "), F.lit(0)))
    said = F.when(form == 0, F.concat(q, F.lit("?"))).when(form == 1, F.concat(F.lit('"'), q, F.lit('"'))).when(form == 2, F.concat(F.lit("qqzz "), first))
    return rows.withColumn("query", said.when(form == 3, "qqzz").when(form == 4, F.replace(q, F.lit(" "), F.lit(" OR "))).otherwise(q))


def _headed(chunks: DataFrame) -> DataFrame:
    """Every heading of a notebook as a question, in the forms of FORMS."""
    asked = chunks.filter("section_header <> ''").groupBy("notebook_id", "section_header").agg(F.min("chunk_seq").alias("k"))
    asked = asked.select(F.concat_ws("/", "notebook_id", "section_header").alias("qid"), "notebook_id", F.col("section_header").alias("query"), "k")
    return _forms(asked, "k").drop("k")


def _index(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored index of the chunks, from one scan of their texts."""
    return fulltext.index(chunks.filter("notebook_id IS NOT NULL"))


def _found(spark: SparkSession, d: str, chunks: DataFrame) -> DataFrame:
    """Searchable chunks with their documents' columns."""
    docs = table(spark, d, "documents")
    tags = docs.select("doc_id", F.regexp_extract(F.lower("filename"), r"\.([^.]+)$", 1).alias("tag"))
    return retrieval.searchable(chunks, docs, None, spark.createDataFrame([("docx",)], "tag string"), tags)


HEADED = "plain AS (SELECT min(chunk_seq) AS k, notebook_id || '/' || section_header AS qid, notebook_id, section_header AS query FROM once WHERE section_header <> '' AND notebook_id IS NOT NULL GROUP BY ALL)"


@query(
    f"""WITH {ONE}, {HEADED}, {FORMS}, hits AS (SELECT DISTINCT qid, chunk_seq FROM (SELECT qid, notebook_id, unnest(string_split(translate(said, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ')) AS t FROM forms WHERE kind IN ('like', 'new')) JOIN once USING (notebook_id)
 WHERE t <> '' AND contains(translate(chunk_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), t))
SELECT qid, chunk_seq, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY chunk_seq) AS rank FROM hits) WHERE rank <= 15"""
)
def like_fallback(spark, d):
    """The substring stage for questions without a full-text hit."""
    chunks = _chunks(spark, d).filter("notebook_id IS NOT NULL")
    asked = _headed(chunks).filter("query LIKE 'qqzz%'")
    return retrieval.best(fulltext.like_hits(asked, _index(chunks)[0], chunks), 15, ["qid"], [F.asc("chunk_seq")])


@query(
    f"""WITH {POST}, {OK}, {HEADED}, {FORMS}, {FOUND}
SELECT qid, chunk_seq, rank, stage FROM texthits"""
)
def fallback_chain(spark, d):
    chunks = _chunks(spark, d).filter("notebook_id IS NOT NULL")
    return retrieval.text_hits(_headed(chunks), _index(chunks), _found(spark, d, chunks), 15).select("qid", "chunk_seq", "rank", "stage")


VEC = """v AS (SELECT e.chunk_rowid, any_value(c.notebook_id) AS notebook_id, any_value(e.embedding::DOUBLE[]) AS v FROM chunk_embeddings e JOIN chunks c ON c.chunk_seq = e.chunk_rowid WHERE e.embedding IS NOT NULL GROUP BY 1),
n AS (SELECT *, coalesce(nullif(sqrt(list_sum(list_transform(v, lambda x: x * x))), 0), 1) AS len FROM v)"""
DOT = "list_sum(list_transform(list_zip(a.v[1:least(len(a.v), len(b.v))], b.v[1:least(len(a.v), len(b.v))]), lambda z: z[1] * z[2]))"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_seq, notebook_id, embedding): each chunk's vector once."""
    vectors = table(spark, d, "chunk_embeddings").filter("embedding IS NOT NULL").groupBy("chunk_rowid").agg(F.first("embedding").alias("embedding"))
    rows = table(spark, d, "chunks").groupBy("chunk_seq").agg(F.first("notebook_id").alias("notebook_id"))
    return rows.join(vectors.withColumnRenamed("chunk_rowid", "chunk_seq"), "chunk_seq")


@query(f"WITH {VEC}, q AS (SELECT * FROM n WHERE chunk_rowid = (SELECT min(chunk_rowid) FROM n)) SELECT b.chunk_rowid AS chunk_seq, round(coalesce({DOT}, 0) / (a.len * b.len), 6) AS score FROM q a, n b ORDER BY round(coalesce({DOT}, 0) / (a.len * b.len), 9) DESC, b.chunk_rowid LIMIT 15")
def vector_topk(spark, d):
    vectors = _vectors(spark, d)
    first = vectors.orderBy("chunk_seq").limit(1).select(F.lit(0).alias("qid"), F.col("embedding").alias("qvec"))
    return retrieval.vector_search(first, vectors, 15, None).select("chunk_seq", F.round("score", 6).alias("score"))


@query(
    f"""WITH {VEC}, pairs AS (SELECT a.chunk_rowid AS qid, b.chunk_rowid AS chunk_seq, round(coalesce({DOT}, 0) / (a.len * b.len), 9) AS score FROM n a JOIN n b ON a.notebook_id = b.notebook_id WHERE a.chunk_rowid % 20 = 0)
SELECT qid, chunk_seq, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_seq) AS rank FROM pairs) WHERE rank <= 15"""
)
def vector_batch_topk(spark, d):
    vectors = _vectors(spark, d)
    asked = vectors.filter("chunk_seq % 20 = 0").select(F.col("chunk_seq").alias("qid"), "notebook_id", F.col("embedding").alias("qvec"))
    return retrieval.vector_search(asked, vectors, 15).select("qid", "chunk_seq", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {VEC} SELECT chunk_rowid AS chunk_seq, len(v) AS dim, round(list_sum(list_transform(v, lambda x: (x / len)::FLOAT::DOUBLE)), 4) AS total, round(sqrt(list_sum(list_transform(v, lambda x: (x / len)::FLOAT::DOUBLE * (x / len)::FLOAT::DOUBLE))), 4) AS length FROM n")
def l2_normalize(spark, d):
    unit = _vectors(spark, d).select("chunk_seq", V.normalized("embedding").alias("u"))
    add = lambda f: F.aggregate("u", F.lit(0.0), lambda s, x: s + f(x.cast("double")))
    return unit.select("chunk_seq", F.size("u").cast("bigint").alias("dim"), F.round(add(lambda x: x), 4).alias("total"), F.round(F.sqrt(add(lambda x: x * x)), 4).alias("length"))


@query("SELECT c.chunk_seq, e.embedding IS NULL OR len(list_filter(e.embedding, lambda x: abs(x) > 0)) = 0 AS failed FROM (SELECT DISTINCT chunk_seq FROM chunks) c LEFT JOIN (SELECT chunk_rowid, any_value(embedding) AS embedding FROM chunk_embeddings WHERE embedding IS NOT NULL GROUP BY 1) e ON e.chunk_rowid = c.chunk_seq")
def failed_embeddings(spark, d):
    vectors = table(spark, d, "chunk_embeddings").filter("embedding IS NOT NULL").groupBy(F.col("chunk_rowid").alias("chunk_seq")).agg(F.first("embedding").alias("e"))
    return table(spark, d, "chunks").select("chunk_seq").distinct().join(vectors, "chunk_seq", "left").select("chunk_seq", (F.col("e").isNull() | V.all_zero("e")).alias("failed"))


# Hybrid queries: every chunk of a row id divisible by 20 that has a section header and a vector asks for its header's words and its vector.
HYBRID = f"""{POST}, {OK}, plain AS (SELECT c.chunk_seq AS qid, c.chunk_seq // 20 AS k, c.notebook_id, c.section_header AS query FROM once c JOIN v ON v.chunk_rowid = c.chunk_seq WHERE c.chunk_seq % 20 = 0 AND c.section_header <> '' AND c.notebook_id IS NOT NULL), {FORMS}, {FOUND},
fr AS (SELECT qid, chunk_seq, rank AS fts_rank FROM texthits),
vp AS (SELECT q.qid, b.chunk_rowid AS chunk_seq, round(coalesce({DOT}, 0) / (a.len * b.len), 9) AS score FROM forms q JOIN n a ON a.chunk_rowid = q.qid JOIN n b ON b.notebook_id = q.notebook_id SEMI JOIN ok ON ok.chunk_seq = b.chunk_rowid),
vr AS (SELECT * FROM (SELECT qid, chunk_seq, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_seq) AS vec_rank FROM vp) WHERE vec_rank <= 15),
fused AS (SELECT qid, chunk_seq, vec_rank, fts_rank, round(coalesce(1 / (60 + vec_rank)::DOUBLE, 0) + coalesce(1 / (60 + fts_rank)::DOUBLE, 0), 12) AS rrf0, max(vec_rank IS NOT NULL) OVER (PARTITION BY qid) AS hasv FROM vr FULL JOIN fr USING (qid, chunk_seq)),
top AS (SELECT *, CASE WHEN hasv THEN rrf0 ELSE 0 END AS rrf FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN hasv THEN rrf0 ELSE 0 END DESC, vec_rank NULLS LAST, fts_rank NULLS LAST, chunk_seq) AS rank FROM fused) WHERE rank <= 5),
normed AS (SELECT *, CASE WHEN max(rrf) OVER (PARTITION BY qid) <= 0 THEN 1.0 ELSE round(rrf / max(rrf) OVER (PARTITION BY qid), 9) END::DOUBLE AS score FROM top)"""


def _fused(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(fused and normalised hits, searchable chunks); only row ids, ranks and scores are written."""
    chunks, vectors = _chunks(spark, d).filter("notebook_id IS NOT NULL"), cut(_vectors(spark, d))
    rows = _found(spark, d, chunks)
    ok = cut(rows.select("chunk_seq"))
    asked = chunks.filter("chunk_seq % 20 = 0 AND section_header <> ''").select(F.col("chunk_seq").alias("qid"), "notebook_id", F.col("section_header").alias("query"))
    asked = cut(_forms(asked.join(vectors.select(F.col("chunk_seq").alias("qid"), F.col("embedding").alias("qvec")), "qid"), "qid div 20"))
    depth = retrieval.candidate_depth(5)
    near = retrieval.vector_search(asked, vectors.join(ok, "chunk_seq", "left_semi"), depth)
    texts = retrieval.text_hits(asked.drop("qvec"), _index(chunks), rows, depth)
    return cut(retrieval.normalized_scores(retrieval.fuse(near, texts, 5))), rows


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Fused and normalised hits with the chunk's result columns; texts are read for the hits alone."""
    fused, rows = _fused(spark, d)
    return fused.join(rows.select("chunk_seq", "notebook_id", *retrieval.result_columns()), "chunk_seq")


@query(f"WITH {VEC}, {HYBRID} SELECT qid, chunk_seq, vec_rank, fts_rank, round(rrf, 9) AS rrf, rank FROM top")
def rrf_merge(spark, d):
    return _fused(spark, d)[0].select("qid", "chunk_seq", "vec_rank", "fts_rank", F.round("rrf", 9).alias("rrf"), "rank")


RESULT = f"""result AS (SELECT t.qid, t.rank, t.chunk_seq, c.notebook_id, round(t.score, 6) AS score, c.doc_id AS source_id, coalesce(nullif(d.filepath, ''), nullif(d.filename, ''), '') AS source, CASE WHEN c.page_number IS NULL OR c.page_number = 0 THEN 1 ELSE c.page_number END::BIGINT AS page,
 c.chunk_id AS section_id, coalesce(nullif(c.section_header, ''), '__root__') AS section_title, coalesce(c.chunk_text, '') AS text FROM normed t JOIN once c USING (chunk_seq) JOIN documents d USING (doc_id))"""


@query(f"WITH {VEC}, {HYBRID}, {RESULT} SELECT qid, rank, score, source_id, source, page, section_id, section_title, text FROM result")
def hybrid_search(spark, d):
    return _hybrid(spark, d).select("qid", "rank", F.round("score", 6).alias("score"), "source_id", "source", "page", "section_id", "section_title", "text")


@query(f"WITH {VEC}, {HYBRID} SELECT qid, rank, round(score, 6) AS score FROM normed")
def score_normalize(spark, d):
    return _fused(spark, d)[0].select("qid", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {VEC}, {HYBRID} SELECT qid, count(*) FILTER (score >= 0.75) AS rag, count(*) FILTER (score >= 0.5) AS model, count(*) AS agent FROM normed GROUP BY 1")
def threshold_filter(spark, d):
    hits = _fused(spark, d)[0]
    count = lambda mode: F.count_if(F.col("score") >= retrieval.THRESHOLDS.get(mode, 0.0)).alias(mode)
    return hits.groupBy("qid").agg(count("rag"), count("model"), count("agent"))


@query(f"WITH {VEC}, {HYBRID}, {RESULT} SELECT qid, rank, coalesce(nullif(list_last(string_split(source, '/')), ''), 'unknown') AS filename, page, coalesce(nullif(section_title, ''), section_id) AS section, text[1:280] AS snippet, least(1.0, greatest(0.0, score))::DOUBLE AS score FROM result")
def citations(spark, d):
    rows = _hybrid(spark, d).withColumn("score", F.round("score", 6))
    return rows.select("qid", "rank", *retrieval.citation_columns())


ORDERED = "ordered AS (SELECT doc_id, source AS nb, row_number() OVER (PARTITION BY source ORDER BY created_at, doc_id) AS doc_order FROM documents WHERE source IS NOT NULL)"


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("source IS NOT NULL").select("doc_id", F.col("source").alias("notebook_id"), "created_at")
    return chat.source_order(docs, by=("created_at",), tie="doc_id")


@query(f"WITH {VEC}, {HYBRID}, {RESULT}, {ORDERED}, c AS (SELECT r.*, o.doc_order FROM result r JOIN ordered o ON o.doc_id = r.source_id) SELECT qid, doc_order, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_order ORDER BY score DESC, rank) AS k FROM c) WHERE k = 1")
def citation_dedupe(spark, d):
    order = _ordered(spark, d).select(F.col("doc_id").alias("source_id"), "doc_order")
    rows = _hybrid(spark, d).withColumn("score", F.round("score", 6)).join(order, "source_id")
    return chat.deduped_citations(rows, "qid", "rank").select("qid", "doc_order", "rank", "score")


@query(
    f"""WITH {VEC}, {HYBRID}, {RESULT}, {ORDERED}, p AS (SELECT qid, rank, '[' || coalesce(doc_order, row_number() OVER (PARTITION BY qid ORDER BY rank)) || '] ' || coalesce(nullif(list_last(string_split(source, '/')), ''), 'unknown') || ' (стр. ' || page || '):' || chr(10) || {STRIP.format('text')} AS part, {STRIP.format('text')} <> '' AS said
 FROM result LEFT JOIN ordered o ON o.doc_id = source_id) SELECT qid, coalesce(string_agg(CASE WHEN said THEN part END, chr(10) || chr(10) ORDER BY rank), '') AS context FROM p GROUP BY 1"""
)
def rag_context(spark, d):
    order = _ordered(spark, d).select(F.col("doc_id").alias("source_id"), "doc_order")
    return chat.context(_hybrid(spark, d).join(order, "source_id", "left"))


@query(r"SELECT chunk_seq, array_to_string(list_transform(regexp_extract_all(coalesce(chunk_text, ''), '\[(\d+)\]', 1), lambda x: x::HUGEINT::VARCHAR), ',') AS refs FROM chunks WHERE regexp_matches(chunk_text, '\[\d+\]')")
def citation_refs(spark, d):
    rows = table(spark, d, "chunks").select("chunk_seq", T.citation_refs("chunk_text").alias("refs"))
    return rows.filter(F.size("refs") > 0).select("chunk_seq", F.array_join(F.transform("refs", lambda x: x.cast("string")), ",").alias("refs"))


@query("SELECT chunk_seq, c.doc_id, c.is_enabled AND d.is_enabled AS searchable FROM chunks c JOIN documents d USING (doc_id) WHERE c.is_enabled AND d.is_enabled")
def enabled_filter(spark, d):
    return retrieval.searchable(table(spark, d, "chunks"), table(spark, d, "documents")).select("chunk_seq", "doc_id", F.lit(True).alias("searchable"))


@query("SELECT chunk_seq FROM chunks c JOIN documents d USING (doc_id) WHERE c.is_enabled AND d.is_enabled AND doc_id IN (3, 5, 8, 13, 21, 34, 55, 89)")
def selected_sources(spark, d):
    return retrieval.searchable(table(spark, d, "chunks"), table(spark, d, "documents"), [3, 5, 8, 13, 21, 34, 55, 89]).select("chunk_seq")


@query(r"SELECT chunk_seq FROM chunks c JOIN documents d USING (doc_id) WHERE c.is_enabled AND d.is_enabled AND NOT coalesce(regexp_matches(lower(filename), '\.(html|docx)$'), false)")
def disabled_tag_antijoin(spark, d):
    docs = table(spark, d, "documents")
    tags = docs.select("doc_id", F.regexp_replace(T.suffix("filename"), r"^\.", "").alias("tag"))
    disabled = spark.createDataFrame([("html",), ("docx",)], "tag string")
    return retrieval.searchable(table(spark, d, "chunks"), docs, None, disabled, tags).select("chunk_seq")


@query("SELECT chunk_seq, doc_id, coalesce(nullif(filepath, ''), nullif(filename, ''), '') AS source, CASE WHEN page_number IS NULL OR page_number = 0 THEN 1 ELSE page_number END::BIGINT AS page, coalesce(nullif(section_header, ''), '__root__') AS section_title FROM chunks c JOIN documents d USING (doc_id)")
def notebook_blocks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("filepath").alias("d_filepath"), F.col("filename").alias("d_filename"))
    rows = table(spark, d, "chunks").join(docs, "doc_id")
    return rows.select("chunk_seq", "doc_id", *[c for c in retrieval.result_columns()[1:5] if "section_id" not in str(c)])


MESSAGES = "m AS (SELECT DISTINCT ON (id) * FROM chat_messages WHERE id IS NOT NULL ORDER BY id, seq)"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("id").orderBy("seq")
    return table(spark, d, "chat_messages").filter("id IS NOT NULL").withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


@query(f"WITH {MESSAGES} SELECT id, seq, {STRIP.format('lower(role)')} AS role FROM (SELECT *, row_number() OVER (PARTITION BY notebook_id ORDER BY seq DESC) AS r FROM m) WHERE r <= 5 AND {STRIP.format("coalesce(content, '')")} <> ''")
def chat_history(spark, d):
    return chat.history(_messages(spark, d)).select("id", "seq", T.strip(F.lower("role")).alias("role"))


@query(f"WITH {ORDERED} SELECT doc_id, nb AS notebook_id, doc_order FROM ordered")
def source_order(spark, d):
    return _ordered(spark, d).select("doc_id", "notebook_id", "doc_order")


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY created_at, doc_id) AS sort_order FROM documents WHERE is_indexed")
def renumber(spark, d):
    return state.renumbered(table(spark, d, "documents").filter("is_indexed"), "source", ["created_at", "doc_id"]).select("doc_id", "source", "sort_order")


@query("SELECT doc_id, CASE doc_id WHEN 7 THEN 1 WHEN 3 THEN 2 WHEN 11 THEN 3 ELSE year END::BIGINT AS sort_order FROM documents")
def reorder(spark, d):
    wanted = spark.createDataFrame([(7, 1), (3, 2), (11, 3)], "doc_id bigint, position bigint")
    return state.reordered(table(spark, d, "documents").select("doc_id", F.col("year").cast("bigint").alias("sort_order")), wanted, "doc_id").select("doc_id", "sort_order")


STATUS = "CASE WHEN nullif(trim(index_error), '') IS NOT NULL THEN 'failed' WHEN is_indexed THEN 'indexed' WHEN indexed_at IS NULL THEN 'new' ELSE 'indexing' END"


@query(f"SELECT source, count(*) AS total, count(*) FILTER (s = 'new') AS n_new, count(*) FILTER (s = 'indexing') AS n_indexing, count(*) FILTER (s = 'indexed') AS n_indexed, count(*) FILTER (s = 'failed') AS n_failed FROM (SELECT *, {STATUS} AS s FROM documents) GROUP BY 1")
def index_status(spark, d):
    failed = F.nullif(F.trim("index_error"), F.lit("")).isNotNull()
    status = F.when(failed, "failed").when(F.col("is_indexed"), "indexed").when(F.col("indexed_at").isNull(), "new").otherwise("indexing")
    return state.index_status(table(spark, d, "documents"), "source", status)


@query("SELECT source, coalesce(max(year), 0)::BIGINT AS max_sort_order FROM documents GROUP BY 1")
def max_sort_order(spark, d):
    return state.next_order(table(spark, d, "documents"), "source", "year")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'new ' || coalesce(title, '') ELSE title END AS title, created_at, CASE WHEN doc_id % 7 = 0 THEN coalesce(created_at, indexed_at) ELSE indexed_at END AS indexed_at FROM (SELECT doc_id, title, created_at, indexed_at FROM documents) UNION ALL SELECT -1, 'added', NULL, NULL")
def upsert_document(spark, d):
    old = table(spark, d, "documents").select("doc_id", "title", "created_at", "indexed_at")
    new = old.filter("doc_id % 7 = 0").select("doc_id", F.concat(F.lit("new "), F.coalesce("title", F.lit(""))).alias("title"), F.col("indexed_at").alias("created_at"), F.coalesce("created_at", "indexed_at").alias("indexed_at"))
    new = new.unionByName(spark.createDataFrame([(-1, "added", None, None)], old.schema))
    return state.upsert(old, new, ["doc_id"], ["created_at"])


@query("SELECT 'documents' AS tab, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE doc_id % 3 <> 0 UNION ALL SELECT 'embeddings', count(*) FROM chunk_embeddings WHERE chunk_rowid IN (SELECT chunk_seq FROM chunks WHERE doc_id % 3 <> 0)")
def delete_cascade(spark, d):
    docs = table(spark, d, "documents")
    left = state.delete_documents(docs.filter("doc_id % 3 = 0"), docs, table(spark, d, "chunks"), table(spark, d, "chunk_embeddings"))
    out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tab"), "n") for name, df in left.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT chunk_id, c.doc_id + 1000000 AS doc_id, chunk_index FROM chunks c JOIN documents d USING (doc_id) WHERE d.source = 'nb-00-zeze'")
def duplicate_remap(spark, d):
    docs = table(spark, d, "documents")
    ids = docs.filter("source = 'nb-00-zeze'").select(F.col("doc_id").alias("old_id"), (F.col("doc_id") + 1_000_000).alias("new_id"))
    return state.duplicated(docs, table(spark, d, "chunks"), "nb-00-zeze", "copy", ids)[1].select("chunk_id", "doc_id", "chunk_index")


@query(
    """WITH s AS (SELECT notebook_id, min(chunk_size) AS chunk_size, min(ocr_enabled) AS ocr_enabled, min(ocr_language) AS ocr_language FROM parsing_settings GROUP BY 1)
SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN 77 END, 0), chunk_size) AS chunk_size, coalesce(CASE WHEN doc_id % 2 = 0 THEN false END, ocr_enabled) AS ocr_enabled, coalesce(nullif(CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END, ''), ocr_language) AS ocr_language FROM documents LEFT JOIN s ON source = notebook_id"""
)
def config_merge(spark, d):
    own = table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("notebook_id"),
        F.when(F.col("doc_id") % 3 == 0, 0).when(F.col("doc_id") % 3 == 1, 77).alias("chunk_size"),
        F.when(F.col("doc_id") % 2 == 0, F.lit(False)).alias("ocr_enabled"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("lang")).alias("ocr_language"),
    )
    fields = {"chunk_size": "int", "ocr_enabled": "boolean", "ocr_language": "string"}
    return state.merged_config(own, table(spark, d, "parsing_settings"), fields).drop("notebook_id")


@query(
    f"""WITH {ONE} SELECT doc_id, chunk_id, row_number() OVER w - 1 AS position, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id, count(*) OVER (PARTITION BY doc_id) AS total_chunks,
array_to_string(list_filter([parent_header, section_header], lambda x: x IS NOT NULL AND x <> ''), ' / ') AS heading_path, CASE WHEN chunk_type IN ('header', 'heading') THEN 'heading' WHEN chunk_type = 'table' THEN 'table' ELSE 'text' END AS content_type FROM once WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index, chunk_id)"""
)
def chunk_meta_links(spark, d):
    return state.chunk_links(_chunks(spark, d))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'client' ELSE 'app' END AS sink, coalesce(nullif(props, ''), '-')[1:500] AS props FROM events")
def client_event_split(spark, d):
    named = table(spark, d, "events").withColumn("event_type", F.when(F.col("event_type").isin("click", "view"), F.concat(F.lit("client."), "event_type")).otherwise(F.col("event_type")))
    app, client = E.routed(files.with_defaults(named, ["props"]))
    both = app.withColumn("sink", F.lit("app")).unionByName(client.withColumn("sink", F.lit("client")))
    return both.select("event_id", "sink", F.col("props").substr(1, 500).alias("props"))


@query("SELECT time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1")
def log_rotation_windows(spark, d):
    return E.rotation_windows(table(spark, d, "events")).withColumn("value", F.round("value", 4))


@query("SELECT DISTINCT m AS model, m <> '' AND NOT regexp_matches(lower(trim(m)), 'embed|rerank|bge-m3|bge-large|e5|gte') AS chat, NOT contains(lower(m), 'rerank') AND regexp_matches(lower(trim(m)), 'embed|bge|e5|gte') AS embedding FROM (SELECT p_name || CASE p_partkey % 5 WHEN 0 THEN '-embed' WHEN 1 THEN ':e5' WHEN 2 THEN '-reranker' WHEN 3 THEN '-BGE' ELSE '' END AS m FROM part)")
def model_filter(spark, d):
    k = F.col("p_partkey") % 5
    name = F.concat("p_name", F.when(k == 0, "-embed").when(k == 1, ":e5").when(k == 2, "-reranker").when(k == 3, "-BGE").otherwise(""))
    return table(spark, d, "part").select(name.alias("model")).select("model", chat.is_chat_model("model").alias("chat"), chat.is_embedding_model("model").alias("embedding")).distinct()


@query("SELECT s_suppkey::VARCHAR AS id, trim(s_name) AS name, '' AS description, '0.0.0' AS version, CASE WHEN s_suppkey % 2 = 0 THEN 'openai' ELSE 'ollama' END AS provider, '' AS model, 'agent' AS requires FROM supplier WHERE s_suppkey % 10 <> 0")
def agent_normalize(spark, d):
    raw = table(spark, d, "supplier").select(
        F.when(F.col("s_suppkey") % 10 == 0, " ").otherwise(F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit(" "), "s_name", F.lit(" ")).alias("name"), F.lit(None).cast("string").alias("description"),
        F.lit("").alias("version"), F.when(F.col("s_suppkey") % 2 == 0, " OpenAI ").alias("provider"), F.lit(None).cast("string").alias("model"), F.array(F.lit(" ")).alias("requires"),
    )
    return chat.normalized_agents(raw).withColumn("requires", F.array_join("requires", ","))


@query("SELECT p_partkey, CASE WHEN p_size * 20 < 1000 THEN 'none' WHEN p_size * p_partkey * 20 < 100000 THEN 'sq' ELSE 'pq' END AS advice, list_max(list_filter(range(1, least(p_size, 16) + 1), lambda x: p_size % x = 0)) AS divisor FROM part")
def quantization_advice(spark, d):
    n = F.when(F.col("p_size") * 20 < 1000, F.lit(0).cast("bigint")).otherwise(F.greatest(F.lit(1000).cast("bigint"), F.col("p_size") * F.col("p_partkey") * 20))
    return table(spark, d, "part").select("p_partkey", V.quantization_advice(n).alias("advice"), V.largest_divisor(F.col("p_size").cast("bigint"), F.lit(16).cast("bigint")).alias("divisor"))


@query(r"SELECT doc_id, filename, CASE WHEN e IN ('.txt', '.md') THEN 'text' WHEN e IN ('.docx', '.pdf', '.xlsx') THEN e[2:] ELSE 'unsupported' END AS reader, CASE WHEN e IN ('.pdf', '.docx', '.xlsx') THEN e[2:] ELSE 'other' END AS file_type FROM (SELECT *, lower(regexp_extract(coalesce(filename, ''), '.(\.[^.]+)$', 1)) AS e FROM documents)")
def format_dispatch(spark, d):
    return table(spark, d, "documents").select("doc_id", "filename", files.reader_of("filename").alias("reader"), files.file_type("filename").alias("file_type"))


@query("SELECT doc_id, sha256(text) AS file_hash, strlen(text) AS size_bytes FROM documents WHERE text IS NOT NULL")
def content_hash(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("file_hash"), F.octet_length("text").cast("bigint").alias("size_bytes"))


@query(
    r"""WITH RECURSIVE f AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(filename, '(.)\.[^.]+$', '\1') || '_1' || regexp_extract(filename, '.(\.[^.]+)$', 1) ELSE filename END AS name FROM documents WHERE filename IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM f),
step(source, k, doc_id, name, stored, taken) AS (
 SELECT source, k, doc_id, name, name, [name] FROM o WHERE k = 1
 UNION ALL
 SELECT source, k, doc_id, name, s, list_append(taken, s) FROM (SELECT o.source, o.k, o.doc_id, o.name, taken, CASE WHEN NOT list_contains(taken, o.name) THEN o.name ELSE
   list_filter(list_transform(range(1, len(taken) + 2), lambda n: regexp_replace(o.name, '(.)\.[^.]+$', '\1') || '_' || n || regexp_extract(o.name, '.(\.[^.]+)$', 1)), lambda x: NOT list_contains(taken, x))[1] END AS s
  FROM step JOIN o ON o.source IS NOT DISTINCT FROM step.source AND o.k = step.k + 1))
SELECT doc_id, stored AS stored_name FROM step"""
)
def name_conflicts(spark, d):
    numbered = F.concat(F.regexp_replace("filename", r"(.)\.[^.]+$", "$1"), F.lit("_1"), F.regexp_extract("filename", r".(\.[^.]+)$", 1))
    docs = table(spark, d, "documents").filter("filename IS NOT NULL").select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, numbered).otherwise(F.col("filename")).alias("filename"))
    return state.free_names(docs, "source", "filename", "doc_id").select("doc_id", "stored_name")


@query(
    f"""WITH {MESSAGES}, t AS (SELECT id, CASE WHEN seq % 4 = 0 THEN ' RAG ' WHEN seq % 4 = 1 THEN 'model' WHEN seq % 4 = 2 THEN 'qa' END AS raw, seq % 3 = 0 AS found FROM m)
SELECT id, coalesce(CASE WHEN lower(trim(raw)) IN ('rag', 'model', 'agent') THEN lower(trim(raw)) END, 'rag') AS mode, coalesce(CASE WHEN lower(trim(raw)) IN ('model', 'agent') THEN 0 END, CASE WHEN found THEN 0 ELSE 1 END) AS fixed_reply FROM t"""
)
def chat_mode(spark, d):
    raw = F.when(F.col("seq") % 4 == 0, " RAG ").when(F.col("seq") % 4 == 1, "model").when(F.col("seq") % 4 == 2, "qa")
    rows = _messages(spark, d).select("id", raw.alias("raw"), (F.col("seq") % 3 == 0).alias("found"))
    return rows.select("id", chat.normalized_mode("raw").alias("mode"), chat.reply_without_sources("raw", "found").isNotNull().cast("int").alias("fixed_reply"))


@query("SELECT id, 'event: token' || chr(10) || 'data: {\"seq\":' || seq || '}' || chr(10) || chr(10) AS frame FROM (SELECT DISTINCT ON (id) * FROM chat_messages WHERE id IS NOT NULL ORDER BY id, seq)")
def sse_frames(spark, d):
    return _messages(spark, d).select("id", chat.frame(F.lit("token"), F.struct("seq", F.lit(None).cast("string").alias("missing"))).alias("frame"))


@query("SELECT stream_id, pos, token FROM (SELECT event_id // 10 AS stream_id, event_id % 10 AS pos, event_type AS token FROM events) WHERE pos < 7 AND pos % 3 <> 1")
def stream_parse(spark, d):
    pos = F.col("event_id") % 10
    ollama = F.to_json(F.struct(F.struct(F.col("event_type").alias("content")).alias("message")))
    openai = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("event_type").alias("content")).alias("delta"))).alias("choices"))))
    line = F.when(pos == 7, "data: [DONE]").when(pos % 3 == 1, "{broken").when(pos % 2 == 0, ollama).otherwise(openai)
    return chat.stream_tokens(table(spark, d, "events").select(F.floor(F.col("event_id") / 10).alias("stream_id"), pos.alias("pos"), line.alias("line")))


@query("SELECT vec_id, round(list_sum(list_concat(embedding[1:48]::DOUBLE[], list_transform(range(0, 16), lambda x: 0.0::DOUBLE))), 4) AS total, 64 AS dim FROM embeddings")
def embedding_response(spark, d):
    short = F.transform(F.slice("embedding", 1, 48), lambda x: x.cast("double"))
    k = F.col("vec_id") % 3
    body = F.when(k == 0, F.to_json(F.struct(F.array(short).alias("embeddings")))).when(k == 1, F.to_json(F.struct(F.array(F.struct(short.alias("embedding"))).alias("data")))).otherwise(F.to_json(F.struct(short.alias("embedding"))))
    rows = table(spark, d, "embeddings").select("vec_id", chat.embedding_of(body, 64).alias("v"))
    return rows.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.size("v").alias("dim"))


@query("SELECT n_regionkey AS doc_id, n_nationkey AS pos, n_name AS text, 'header' AS chunk_type FROM nation WHERE false UNION ALL SELECT r, row_number() OVER (PARTITION BY r ORDER BY side, y) - 1, t, CASE WHEN side = 0 AND y = 0 THEN 'header' ELSE 'text' END FROM (SELECT n_regionkey AS r, n_name AS t, n_nationkey % 2 AS side, (row_number() OVER (PARTITION BY n_regionkey, n_nationkey % 2 ORDER BY n_nationkey) - 1) AS y FROM nation)")
def column_layout(spark, d):
    side = F.col("n_nationkey") % 2
    y = F.row_number().over(Window.partitionBy("n_regionkey", side).orderBy("n_nationkey")) - 1
    lines = table(spark, d, "nation").select(F.col("n_regionkey").alias("doc_id"), F.lit(1).alias("page"), y.cast("double").alias("y0"), (50.0 + 250 * side).alias("x0"), F.col("n_name").alias("text"), F.when((side == 0) & (y == 0), 16.0).otherwise(10.0).alias("size"))
    return files.page_lines(lines).select("doc_id", "pos", "text", "chunk_type")


@query(f"WITH {MESSAGES} SELECT id, version FROM (SELECT id, seq % 3 AS version, length(notebook_id) % 3 AS now_ FROM m) WHERE version = now_")
def version_fence(spark, d):
    rows = _messages(spark, d).withColumn("version", F.col("seq") % 3)
    versions = rows.select("notebook_id").distinct().withColumn("version", F.char_length("notebook_id") % 3)
    return E.fenced(rows, versions).select("id", "version")


@query(_SQL["log_rotation_windows"])
def stream_rotation_windows(spark, d):
    """The same windows from a stream of the events file, with a watermark."""
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return E.finished(E.rotation_windows(stream, late="1 day")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "events", F.round("value", 4).alias("value"))


@query("SELECT doc_id AS id, source AS notebook_id, list_last(string_split(coalesce(filepath, ''), '/')) AS filename, CASE WHEN e IN ('.pdf', '.docx', '.xlsx') THEN e[2:] ELSE 'other' END AS file_type, 'new' AS status, coalesce(m, 0) + row_number() OVER (PARTITION BY source ORDER BY doc_id) AS sort_order FROM (SELECT *, lower(regexp_extract(list_last(string_split(coalesce(filepath, ''), '/')), '.(\\.[^.]+)$', 1)) AS e FROM documents WHERE NOT is_indexed AND source IS NOT NULL) LEFT JOIN (SELECT source, max(year) AS m FROM documents WHERE is_indexed GROUP BY 1) USING (source)")
def register_sources(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("source", "notebook_id")
    have = docs.filter("is_indexed").select("notebook_id", F.col("year").cast("bigint").alias("sort_order"))
    new = docs.filter("NOT is_indexed AND notebook_id IS NOT NULL").select(F.col("doc_id").alias("id"), "notebook_id", F.col("filepath").alias("path"))
    return files.registered(new, have).select("id", "notebook_id", "filename", "file_type", "status", "sort_order")


@query("SELECT s_suppkey, coalesce(a.s_name, f.s_name) AS agent, CASE WHEN s_suppkey % 2 = 0 THEN 'asked' WHEN coalesce(a.n, f.n) % 3 = 0 THEN 'default' ELSE 'manifest' END AS provider FROM (SELECT s_suppkey, s_suppkey + 5 AS want FROM supplier) r LEFT JOIN (SELECT s_suppkey AS n, s_name FROM supplier WHERE s_suppkey <= 8) a ON a.n = want, (SELECT s_suppkey AS n, s_name FROM supplier WHERE s_suppkey <= 8 ORDER BY s_name LIMIT 1) f")
def agent_resolve(spark, d):
    rows = table(spark, d, "supplier")
    manifests = rows.filter("s_suppkey <= 8").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise("manifest").alias("provider"))
    asked = rows.select("s_suppkey", (F.col("s_suppkey") + 5).cast("string").alias("agent_id"), F.when(F.col("s_suppkey") % 2 == 0, "asked").otherwise("").alias("own"))
    return chat.resolved_agents(asked, manifests).select("s_suppkey", F.col("agent_name").alias("agent"), chat.by_precedence("own", "agent_provider", "default").alias("provider"))
