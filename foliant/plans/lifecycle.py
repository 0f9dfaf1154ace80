"""Queries of what changes the store or surrounds it: notebooks, sources, tags, files, streams, connectors."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions import vectors as V
from foliant.operators import chat, chunkers, embedding, state
from foliant.plans.catalog import BLOCKS, LEVEL_SQL, MESSAGES, ONE, STRIP, Query, _blocks, _chunks, _messages
from foliant.schemas import CONFIG
from foliant.session import checkpoint_dir, table, table_stream
from foliant.sources import files
from foliant.streaming import events as E

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid4().hex}"


# Documents as the registry's sources. The same in SQL.
SOURCES = f"sources AS (SELECT doc_id AS id, source AS notebook_id, filename, is_enabled, doc_id % 7 <> 0 AS has_docs, CASE doc_id % 4 WHEN 0 THEN 'indexing' WHEN 1 THEN 'indexed' ELSE 'new' END AS status, year::BIGINT AS sort_order FROM documents)"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    status = F.when(k == 0, "indexing").when(k == 1, "indexed").otherwise("new")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("notebook_id"), "filename", "is_enabled", (F.col("doc_id") % 7 != 0).alias("has_docs"), status.alias("status"), F.col("year").cast("bigint").alias("sort_order"))


# --- parsed and embedded documents


@query(f"WITH {ONE} SELECT doc_id::VARCHAR AS doc_id, chunk_index::BIGINT AS chunk_index, chunk_text AS text, chunk_type, page_number, section_header FROM once WHERE doc_id IS NOT NULL")
def parsed_round_trip(spark, d):
    """Chunks written as parsed documents and read again."""
    path = folder(spark, "parsed")
    rows = _chunks(spark, d).filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("chunk_text").alias("text"), "chunk_type", "page_number", "section_header")
    files.write_parsed(rows.select("doc_id").distinct(), rows, path)
    return files.read_parsed(spark, path, by_line=True)


@query("SELECT n_regionkey AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS chunk_index, n_name AS text, CASE WHEN n_nationkey % 2 = 0 THEN 'table' ELSE 'text' END AS chunk_type FROM nation")
def parsed_indented_files(spark, d):
    """Files of one indented document each, objects and bare lists."""
    path = folder(spark, "indented")
    kind = F.when(F.col("n_nationkey") % 2 == 0, "table").otherwise("text").alias("chunk_type")
    rows = table(spark, d, "nation").select("n_regionkey", F.struct("n_nationkey", F.col("n_name").alias("text"), kind, F.col("n_regionkey").alias("page_number")).alias("c"))
    listed = rows.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("c")).alias("chunks"))  # a few nations
    pretty = {"pretty": "true"}
    whole = F.when(F.col("n_regionkey") % 2 == 0, F.to_json(F.struct("chunks"), pretty)).otherwise(F.to_json("chunks", pretty))
    listed.select(F.col("n_regionkey").alias("r"), whole.alias("value")).write.partitionBy("r").text(path)
    read = files.read_parsed(spark, f"{path}/*")
    return read.select(F.col("page_number").alias("region"), F.col("chunk_index").cast("bigint").alias("chunk_index"), "text", "chunk_type")


@query(f"WITH {ONE} SELECT notebook_id, doc_id, count(*) AS chunk_count FROM once SEMI JOIN chunk_embeddings e ON e.chunk_rowid = once.chunk_seq WHERE notebook_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2")
def embedded_sink(spark, d):
    """Embedded chunks written with their registry."""
    vectors = table(spark, d, "chunk_embeddings").groupBy(F.col("chunk_rowid").alias("chunk_seq")).agg(F.first("embedding").alias("embedding"))
    rows = _chunks(spark, d).filter("notebook_id IS NOT NULL AND doc_id IS NOT NULL").select("notebook_id", "doc_id", "chunk_seq", "chunk_text").join(vectors, "chunk_seq")
    return state.write_embedded(spark, rows, folder(spark, "embedded"), ["notebook_id", "doc_id"])


@query("SELECT source AS notebook_id, doc_id, CASE WHEN doc_id % 3 = 0 THEN count(*) ELSE 7 END AS chunk_count FROM documents WHERE source IS NOT NULL GROUP BY source, doc_id")
def embedded_registry(spark, d):
    """The registry after a third of the documents were embedded anew."""
    docs = table(spark, d, "documents").filter("source IS NOT NULL").select(F.col("source").alias("notebook_id"), "doc_id")
    return state.embedded_registry(docs.withColumn("chunk_count", F.lit(7).cast("bigint")), docs.filter("doc_id % 3 = 0"), ["notebook_id", "doc_id"])


@query(
    f"""WITH {ONE}, t AS (SELECT chunk_seq, coalesce(nullif(embedding_text, ''), chunk_text, '') AS t FROM once)
SELECT chunk_seq, CASE WHEN contains(t, '###') OR t = '' THEN 0 ELSE round(length(t) / sqrt(length(t)::DOUBLE * length(t) + 1), 3) END AS first, contains(t, '###') OR t = '' AS failed FROM t"""
)
def embed_batches(spark, d):
    """Chunks embedded in batches by a client that fails on some texts."""

    def client(texts: list[str]) -> list[list[float] | None]:
        return [None if "###" in t or not t else [float(len(t)), 1.0] for t in texts]

    rows = embedding.embed(_chunks(spark, d).select("chunk_seq", "chunk_text", "embedding_text"), client, dim=4)
    return rows.select("chunk_seq", F.round(F.get("embedding", F.lit(0)).cast("double"), 3).alias("first"), "failed")


@query(f"WITH {ONE} SELECT chunk_seq, round(length(chunk_text) / sqrt(length(chunk_text)::DOUBLE * length(chunk_text) + 1), 3) AS first FROM once WHERE chunk_text <> ''")
def embedding_chain(spark, d):
    """A client whose first model and first address fail, so that the second model at the legacy address answers."""

    def post(address: str, payload: dict) -> dict:
        if payload["model"] == "gone":
            raise embedding.ModelMissing(address)
        if not address.endswith("/embeddings") or "/v1/" in address:
            raise OSError(address)
        return {"embedding": [float(len(payload["prompt"])), 1.0]}

    client = embedding.chained_client(post, embedding.targets("http://models/"), ["gone", "there"], 2)
    rows = _chunks(spark, d).filter("chunk_text <> ''").select("chunk_seq", "chunk_text", F.lit(None).cast("string").alias("embedding_text"))
    return embedding.embed(rows, client, dim=2).select("chunk_seq", F.round(F.get("embedding", F.lit(0)).cast("double"), 3).alias("first"))


# --- scans and rows of the registry


@query(
    "SELECT doc_id AS id, source AS notebook_id, CASE WHEN doc_id % 3 = 0 THEN 100 + doc_id % 5 END::INT AS chunk_size, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 END AS ocr_enabled FROM documents"
)
def source_scan(spark, d):
    """Sources with their configuration decoded from JSON, broken JSON as none."""
    good = F.to_json(F.struct((100 + F.col("doc_id") % 5).cast("int").alias("chunk_size"), (F.col("doc_id") % 2 == 0).alias("ocr_enabled")))
    raw = F.when(F.col("doc_id") % 3 == 0, good).when(F.col("doc_id") % 3 == 1, "{broken")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("notebook_id"), F.col("year").alias("sort_order"), F.col("created_at").alias("added_at"), raw.alias("individual_config"))
    return state.loaded_sources(rows, CONFIG).select("id", "notebook_id", "individual_config.chunk_size", "individual_config.ocr_enabled")


@query("SELECT id, notebook_id FROM (SELECT 'c' || chunk_seq AS id, notebook_id, chunk_seq FROM chunks WHERE chunk_seq % 20 = 0) WHERE chunk_seq % 5 = 0 AND chunk_seq % 60 <> 0 UNION ALL SELECT 'n' || doc_id, source FROM documents")
def saved_rows(spark, d):
    """Saved citations after some were deleted and others appended."""
    saved = table(spark, d, "chunks").filter("chunk_seq % 20 = 0").select(F.concat(F.lit("c"), "chunk_seq").alias("id"), "notebook_id")
    gone = table(spark, d, "chunks").filter("chunk_seq % 60 = 0").select(F.concat(F.lit("c"), "chunk_seq").alias("id"))
    new = table(spark, d, "documents").select(F.concat(F.lit("n"), "doc_id").alias("id"), F.col("source").alias("notebook_id"))
    return state.without(saved, gone, "id").unionByName(new)


@query("SELECT doc_id, source FROM documents WHERE source = 'nb-00-zeze' AND contains(lower(coalesce(filename, '')), 'pdf')")
def notebook_sources(spark, d):
    """Sources of one notebook whose name holds a text."""
    return state.matching_names(table(spark, d, "documents").filter("source = 'nb-00-zeze'"), " PDF ").select("doc_id", "source")


@query("SELECT chunk_seq, notebook_id FROM chunks WHERE notebook_id IN (SELECT notebook_id FROM parsing_settings)")
def orphan_drop(spark, d):
    return state.of_known(table(spark, d, "chunks").select("chunk_seq", "notebook_id"), table(spark, d, "parsing_settings"), "notebook_id", "notebook_id")


SELECTED = "doc_id % 3 = 0"


@query(f"SELECT doc_id AS id, coalesce(is_enabled, true) AND {SELECTED} AS chosen, NOT {SELECTED} AS rest FROM documents")
def selection(spark, d):
    """Which sources an explicit selection chooses, and which it leaves."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "is_enabled")
    picked = rows.filter("id % 3 = 0").select("id")
    chosen = state.default_selection(rows, picked).select("id", F.lit(True).alias("chosen"))
    rest = state.unselected(rows, picked).select("id", F.lit(True).alias("rest"))
    return rows.select("id").join(chosen, "id", "left").join(rest, "id", "left").fillna(False, ["chosen", "rest"])


@query("SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN list_filter([0, 1, 2], lambda x: x <> doc_id % 5) ELSE [0, 1, 2, doc_id % 5] END AS chosen, list_concat(list_filter([0, 1, 2, 3, 4], lambda x: x <> doc_id % 5)[1:2], list_concat([doc_id % 5], list_filter([0, 1, 2, 3, 4], lambda x: x <> doc_id % 5)[3:4])) AS moved FROM documents")
def selection_order(spark, d):
    """A selection with one id toggled, and an order with one item moved to the third place."""
    ids = lambda n: F.array(*[F.lit(i).cast("bigint") for i in range(n)])
    k = F.col("doc_id") % 5
    return table(spark, d, "documents").select("doc_id", state.toggled(ids(3), k).alias("chosen"), state.moved(ids(5), k, F.lit(3)).alias("moved"))


@query("SELECT doc_id, sort_order FROM (SELECT doc_id, source, year::BIGINT AS sort_order, min(doc_id) OVER (PARTITION BY source) AS least, source LIKE '%1%' AS bad FROM documents WHERE source IS NOT NULL) WHERE doc_id <> least OR bad UNION ALL SELECT min(doc_id), 999 FROM documents WHERE source IS NOT NULL AND NOT source LIKE '%1%' GROUP BY source")
def reorder_checked(spark, d):
    """A new place for the first source of each notebook; requests that name a foreign source change nothing."""
    rows = table(spark, d, "documents").filter("source IS NOT NULL").select("doc_id", "source", F.col("year").cast("bigint").alias("sort_order"))
    first = rows.groupBy("source").agg(F.min("doc_id").alias("doc_id")).withColumn("position", F.lit(999).cast("bigint"))
    foreign = first.filter("source LIKE '%1%'").select("source", F.lit(-1).cast("bigint").alias("doc_id"), F.lit(1).cast("bigint").alias("position"))
    return state.reordered(rows, first.unionByName(foreign, allowMissingColumns=True), "doc_id", "sort_order", "source").select("doc_id", "sort_order")


# --- updates of the store

TAG_SQL = "list_sort(list_distinct(list_filter([lang, regexp_extract(filename, '.(\\.[^.]+)$', 1), lang], lambda x: x IS NOT NULL)))"


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array("lang", F.regexp_extract("filename", r".(\.[^.]+)$", 1), "lang").alias("tags"))


@query(f"SELECT doc_id, unnest({TAG_SQL}) AS tag FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'old' FROM documents WHERE doc_id % 4 <> 0")
def document_tags(spark, d):
    """Tags of the documents after a quarter of them got new ones."""
    docs = table(spark, d, "documents")
    old = docs.select("doc_id", F.lit("old").alias("tag"))
    tags = spark.createDataFrame([("old", False)], "tag string, is_enabled boolean")
    return state.with_tags(old, _tagged(spark, d).filter("doc_id % 4 = 0"), tags)[0]


@query("SELECT DISTINCT coalesce(t.tag, n.tag) AS tag, CASE WHEN coalesce(t.tag, n.tag) = 'de' THEN false ELSE coalesce(t.is_enabled, true) END AS is_enabled FROM (SELECT 'en' AS tag, false AS is_enabled UNION ALL SELECT 'gone', true) t FULL JOIN (SELECT DISTINCT lang AS tag FROM documents WHERE lang IS NOT NULL UNION SELECT 'de') n ON n.tag = t.tag")
def tag_switch(spark, d):
    """Known tags keep their state, new ones are on; then one is switched off."""
    tags = spark.createDataFrame([("en", False), ("gone", True)], "tag string, is_enabled boolean")
    none = spark.createDataFrame([], "doc_id bigint, tag string")
    all_tags = state.with_tags(none, table(spark, d, "documents").select("doc_id", F.array("lang").alias("tags")), tags)[1]
    return state.toggled_tag(all_tags, "de", False)


@query(
    f"""WITH {ONE}, old AS (SELECT chunk_seq, chunk_id, doc_id FROM once), gone AS (SELECT chunk_seq FROM old WHERE doc_id % 9 = 0)
SELECT 'documents' AS tab, doc_id::VARCHAR AS key, CASE WHEN doc_id % 9 = 0 THEN 'new' ELSE title END AS value, created_at FROM documents
UNION ALL SELECT 'chunks', chunk_id, doc_id::VARCHAR, NULL FROM old WHERE doc_id % 9 <> 0 OR doc_id IS NULL UNION ALL SELECT 'chunks', 'n' || doc_id, doc_id::VARCHAR, NULL FROM documents WHERE doc_id % 9 = 0
UNION ALL SELECT 'embeddings', chunk_rowid::VARCHAR, NULL, NULL FROM (SELECT DISTINCT chunk_rowid FROM chunk_embeddings) ANTI JOIN gone ON gone.chunk_seq = chunk_rowid UNION ALL SELECT 'embeddings', (-doc_id - 1)::VARCHAR, NULL, NULL FROM documents WHERE doc_id % 9 = 0
UNION ALL SELECT 'document_tags', doc_id::VARCHAR, CASE WHEN doc_id % 9 = 0 THEN 'fresh' ELSE 'old' END, NULL FROM documents UNION ALL SELECT 'tags', 'old', 'true', NULL UNION ALL SELECT 'tags', 'fresh', 'true', NULL"""
)
def store_documents(spark, d):
    """Whole documents replaced with their chunks, vectors and tags; what was created when stays."""
    docs = table(spark, d, "documents").select("doc_id", "title", "created_at")
    chunks = _chunks(spark, d).select("chunk_seq", "chunk_id", "doc_id")
    again = docs.filter("doc_id % 9 = 0")
    store = {
        "documents": docs, "chunks": chunks, "embeddings": table(spark, d, "chunk_embeddings").groupBy("chunk_rowid").agg(F.first("embedding").alias("embedding")),
        "document_tags": docs.select("doc_id", F.lit("old").alias("tag")), "tags": spark.createDataFrame([("old", True)], "tag string, is_enabled boolean"),
    }
    new_docs = again.select("doc_id", F.lit("new").alias("title"), F.lit(None).cast("timestamp_ntz").alias("created_at"), F.array(F.lit("fresh"), F.lit("fresh")).alias("tags"))
    row = (-F.col("doc_id") - 1).alias("chunk_seq")
    new_chunks = again.select(row, F.concat(F.lit("n"), "doc_id").alias("chunk_id"), "doc_id")
    out = state.stored_documents(store, new_docs, new_chunks, again.select(row.alias("chunk_rowid"), F.array(F.lit(1.0).cast("float")).alias("embedding")))
    nil, at = F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz").alias("created_at")
    shape = lambda name, key, value, when=at: out[name].select(F.lit(name).alias("tab"), F.col(key).cast("string").alias("key"), value.alias("value"), when)
    parts = [shape("documents", "doc_id", F.col("title"), F.col("created_at")), shape("chunks", "chunk_id", F.col("doc_id").cast("string")), shape("embeddings", "chunk_rowid", nil), shape("document_tags", "doc_id", F.col("tag")), shape("tags", "tag", F.col("is_enabled").cast("string"))]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


@query("SELECT doc_id % 10 AS k, count(*) AS n, max(doc_id) AS last FROM documents WHERE source IS NOT NULL GROUP BY 1")
def upsert_repeated(spark, d):
    """Of several new rows of one key the last stays."""
    rows = table(spark, d, "documents").filter("source IS NOT NULL").select((F.col("doc_id") % 10).alias("k"), "doc_id")
    old = rows.select("k").distinct().select("k", F.lit(0).cast("bigint").alias("doc_id"))
    stored = state.upsert(old, rows, ["k"], order="doc_id").select("k", F.col("doc_id").alias("last"))
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(stored, "k")


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN false ELSE is_enabled END AS is_enabled FROM documents")
def enable_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "is_enabled")
    return state.set_enabled(docs, docs.filter("doc_id % 6 = 0"), False)


@query(
    f"""WITH {SOURCES}, s AS (SELECT * FROM sources WHERE id % 5 <> 0), c AS (SELECT chunk_seq FROM chunks WHERE doc_id % 5 <> 0 OR doc_id IS NULL)
SELECT 'sources' AS tab, id::VARCHAR AS key, row_number() OVER (PARTITION BY notebook_id ORDER BY sort_order NULLS FIRST, id) AS place FROM s
UNION ALL SELECT 'chunks', chunk_seq::VARCHAR, NULL FROM c UNION ALL SELECT 'embeddings', chunk_rowid::VARCHAR, NULL FROM chunk_embeddings SEMI JOIN c ON c.chunk_seq = chunk_rowid
UNION ALL SELECT 'citations', chunk_seq::VARCHAR, NULL FROM chunks WHERE chunk_seq % 20 = 0 AND (doc_id % 5 <> 0 OR doc_id IS NULL)"""
)
def delete_sources(spark, d):
    """Sources deleted with all that hangs on them; the others move up."""
    sources, chunks = _sources(spark, d), table(spark, d, "chunks")
    saved = chunks.filter("chunk_seq % 20 = 0").select("chunk_seq", F.col("doc_id").alias("source_id"))
    left = state.deleted_sources(sources.filter("id % 5 = 0"), sources, table(spark, d, "documents"), chunks, table(spark, d, "chunk_embeddings"), saved)
    shape = lambda name, key, place=F.lit(None).cast("bigint"): left[name].select(F.lit(name).alias("tab"), F.col(key).cast("string").alias("key"), place.alias("place"))
    return shape("sources", "id", F.col("sort_order")).unionByName(shape("chunks", "chunk_seq")).unionByName(shape("embeddings", "chunk_rowid")).unionByName(shape("citations", "chunk_seq"))


@query(f"WITH {SOURCES} SELECT notebook_id, count(*) FILTER (id % 2 = 0 AND has_docs) AS removed, count(*) FILTER (id % 2 <> 0 AND has_docs) AS there FROM sources GROUP BY 1")
def removed_files(spark, d):
    """Files removed by notebook, and those that are still there."""
    sources = _sources(spark, d)
    rows, counts = state.without_files(sources, sources.filter("id % 2 = 0"))
    there = rows.groupBy("notebook_id").agg(F.count_if("has_docs").alias("there")).withColumnRenamed("notebook_id", "_n")
    return counts.join(there, F.col("notebook_id").eqNullSafe(F.col("_n"))).drop("_n")


@query(f"WITH {SOURCES} SELECT id, CASE WHEN id % 3 = 0 THEN 'new' WHEN status = 'indexing' THEN 'failed' ELSE status END AS status, id % 2 = 0 AS has_docs FROM sources")
def erase_and_recover(spark, d):
    """Sources after some were erased and the service restarted: what was indexing has failed, files are looked for."""
    sources = _sources(spark, d)
    rows = state.erased(sources, sources.filter("id % 3 = 0"))
    return state.recovered(rows, sources.filter("id % 2 = 0")).select("id", "status", "has_docs")


@query(f"WITH {SOURCES} SELECT id, CASE WHEN coalesce(is_enabled, true) AND has_docs AND id % 2 = 0 THEN 'indexing' ELSE status END AS status, coalesce(is_enabled, true) AND has_docs AND id % 2 = 0 AS job FROM sources")
def parse_again(spark, d):
    """Selected sources that are indexed anew."""
    sources = _sources(spark, d)
    rows, jobs = state.to_parse_again(sources, sources.filter("id % 2 = 0"))
    return rows.join(jobs.select("id", F.lit(True).alias("job")), "id", "left").select("id", "status", F.coalesce("job", F.lit(False)).alias("job"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 64 ELSE 200 END AS chunk_size, CASE WHEN doc_id % 4 <> 0 THEN 20 END AS chunk_overlap FROM documents")
def config_patch(spark, d):
    """A patch replaces a configuration as a whole: what it leaves out becomes null."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(200).alias("chunk_size"), F.lit(20).alias("chunk_overlap"))
    patches = rows.filter("id % 4 = 0").select("id", F.lit(64).alias("chunk_size"))
    return state.patched_config(rows, patches, ["chunk_size", "chunk_overlap"])


@query(
    """WITH left_ AS (SELECT doc_id, source FROM documents WHERE source NOT LIKE '%0%' OR source IS NULL)
SELECT 'documents' AS tab, doc_id::VARCHAR AS key FROM left_ UNION ALL SELECT 'settings', notebook_id FROM parsing_settings WHERE notebook_id NOT LIKE '%0%' OR notebook_id IS NULL
UNION ALL SELECT 'chunks', chunk_seq::VARCHAR FROM chunks WHERE notebook_id NOT LIKE '%0%' OR notebook_id IS NULL"""
)
def delete_notebooks(spark, d):
    docs, settings, chunks = (table(spark, d, n) for n in ("documents", "parsing_settings", "chunks"))
    gone = docs.select(F.col("source").alias("id")).unionByName(settings.select(F.col("notebook_id").alias("id"))).unionByName(chunks.select(F.col("notebook_id").alias("id"))).filter("id LIKE '%0%'")
    left = state.without_notebooks(gone, {"documents": (docs, "source"), "settings": (settings, "notebook_id"), "chunks": (chunks, "notebook_id")})
    shape = lambda name, key: left[name].select(F.lit(name).alias("tab"), F.col(key).cast("string").alias("key"))
    return shape("documents", "doc_id").unionByName(shape("settings", "notebook_id")).unionByName(shape("chunks", "chunk_seq"))


NOTEBOOKS = "notebooks AS (SELECT source AS id, 'Notebook ' || source AS title, min(created_at) AS created_at, min(created_at) AS updated_at FROM documents WHERE source IS NOT NULL GROUP BY 1)"


def _notebooks(spark: SparkSession, d: str) -> DataFrame:
    first = F.min("created_at")
    return table(spark, d, "documents").filter("source IS NOT NULL").groupBy(F.col("source").alias("id")).agg(F.concat(F.lit("Notebook "), F.first("source")).alias("title"), first.alias("created_at"), first.alias("updated_at"))


@query(
    f"""WITH {NOTEBOOKS}, {ONE}, mine AS (SELECT *, (SELECT max(chunk_seq) FROM once) + row_number() OVER (ORDER BY chunk_seq) AS number FROM once JOIN (SELECT doc_id FROM documents WHERE source = 'nb-00-zeze') USING (doc_id))
SELECT 'notebooks' AS tab, 'copy' AS key, 'Копия: ' || title AS value FROM notebooks WHERE id = 'nb-00-zeze' UNION ALL SELECT 'settings', 'copy', chunk_size::VARCHAR FROM parsing_settings WHERE notebook_id = 'nb-00-zeze'
UNION ALL SELECT 'sources', (doc_id + 1000000)::VARCHAR, 'false' FROM documents WHERE source = 'nb-00-zeze' UNION ALL SELECT 'documents', (doc_id + 1000000)::VARCHAR, title FROM documents WHERE source = 'nb-00-zeze'
UNION ALL SELECT 'chunks', number::VARCHAR, chunk_id FROM mine UNION ALL SELECT DISTINCT 'embeddings', number::VARCHAR, NULL FROM mine JOIN chunk_embeddings ON chunk_rowid = chunk_seq"""
)
def duplicate_notebook(spark, d):
    """A notebook copied with settings, sources, documents, chunks and vectors."""
    docs = table(spark, d, "documents")
    store = {
        "notebooks": _notebooks(spark, d), "settings": table(spark, d, "parsing_settings"), "sources": _sources(spark, d).withColumn("has_base", F.lit(True)), "documents": docs,
        "chunks": _chunks(spark, d), "embeddings": table(spark, d, "chunk_embeddings").groupBy("chunk_rowid").agg(F.first("embedding").alias("embedding")),
    }
    ids = docs.filter("source = 'nb-00-zeze'").select(F.col("doc_id").alias("old_id"), (F.col("doc_id") + 1_000_000).alias("new_id"))
    copy = state.duplicated_notebook(store, "nb-00-zeze", "copy", ids)
    shape = lambda name, key, value: copy[name].select(F.lit(name).alias("tab"), F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value") if value else F.lit(None).cast("string").alias("value"))
    parts = [shape(*x) for x in (("notebooks", "id", "title"), ("settings", "notebook_id", "chunk_size"), ("sources", "id", "has_base"), ("documents", "doc_id", "title"), ("chunks", "chunk_seq", "chunk_id"), ("embeddings", "chunk_rowid", None))]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


@query(f"WITH {NOTEBOOKS} SELECT id, CASE WHEN id LIKE '%1%' THEN 'Renamed' ELSE title END AS title, created_at, CASE WHEN id LIKE '%1%' THEN TIMESTAMP '2030-01-01' ELSE updated_at END AS updated_at FROM notebooks UNION ALL SELECT 'fresh', 'Untitled notebook', TIMESTAMP '2030-01-01', TIMESTAMP '2030-01-01'")
def notebook_changes(spark, d):
    """Notebooks created and renamed."""
    old = _notebooks(spark, d)
    at = F.lit("2030-01-01").cast("timestamp_ntz")
    new = spark.createDataFrame([("fresh", " ")], "id string, title string").withColumn("created_at", at)
    return state.renamed_notebooks(state.created_notebooks(old, new), old.filter("id LIKE '%1%'").select("id", F.lit("Renamed").alias("title"), at.alias("updated_at")))


# --- messages and streams


@query(f"WITH {MESSAGES}, kept AS (SELECT id, notebook_id, seq FROM m WHERE notebook_id IS NOT NULL AND notebook_id NOT LIKE '%1%') SELECT id, seq FROM kept UNION ALL SELECT 'a' || notebook_id, max(seq) + 1 FROM kept GROUP BY notebook_id")
def message_changes(spark, d):
    """Conversations after some were cleared and one message was appended to each of the others."""
    rows = _messages(spark, d).filter("notebook_id IS NOT NULL").select("id", "notebook_id", "seq")
    versions = rows.select("notebook_id").distinct().withColumn("version", F.lit(0))
    left, _ = state.cleared(rows, versions, rows.filter("notebook_id LIKE '%1%'"))
    new = left.select("notebook_id").distinct().select(F.concat(F.lit("a"), "notebook_id").alias("id"), "notebook_id", F.lit(0).cast("bigint").alias("seq"))
    return state.appended_messages(left, new).select("id", "seq")


@query("SELECT DISTINCT notebook_id, CASE WHEN notebook_id LIKE '%1%' THEN 4 ELSE 3 END AS version FROM chat_messages WHERE notebook_id IS NOT NULL")
def conversation_versions(spark, d):
    rows = table(spark, d, "chat_messages").filter("notebook_id IS NOT NULL")
    versions = rows.select("notebook_id").distinct().withColumn("version", F.lit(3))
    return state.cleared(rows, versions, rows.filter("notebook_id LIKE '%1%'"))[1].withColumn("version", F.col("version").cast("int"))


@query("WITH c AS (SELECT notebook_id, max(created_at) AS last FROM chat_messages WHERE seq % 10 = 0 GROUP BY 1) SELECT seq FROM chat_messages m LEFT JOIN c USING (notebook_id) WHERE last IS NULL OR created_at > last")
def late_streams(spark, d):
    """Streams that began after their conversation's last clear."""
    rows = table(spark, d, "chat_messages").select("seq", "notebook_id", F.col("created_at").alias("started_at"))
    clears = rows.filter("seq % 10 = 0").select("notebook_id", F.col("started_at").alias("cleared_at"))
    return state.late_dropped(rows, clears).select("seq")


@query("SELECT event_id // 10 AS stream_id, count(*) AS packets, sum(length(event_type))::BIGINT AS chars FROM events GROUP BY 1")
def stream_totals(spark, d):
    tokens = table(spark, d, "events").select(F.floor(F.col("event_id") / 10).alias("stream_id"), F.col("event_type").alias("token"))
    return chat.stream_counters(tokens)


@query(
    r"""WITH t AS (SELECT event_id // 10 AS stream_id, event_id % 10 AS pos, event_type FROM events), ends AS (SELECT DISTINCT stream_id, stream_id % 3 = 0 AS bad, stream_id % 5 = 0 AS fenced FROM t),
f AS (SELECT stream_id, 0 AS s, pos, 'event: token' || chr(10) || 'data: {"text":"' || event_type || '"}' AS frame FROM t UNION ALL SELECT stream_id, 1, 0, CASE WHEN bad THEN 'event: error' || chr(10) || 'data: {"detail":"broken"}' ELSE 'event: citations' || chr(10) || 'data: []' END FROM ends
UNION ALL SELECT stream_id, 2, 0, 'event: done' || chr(10) || 'data: {"message_id":"' || CASE WHEN bad OR fenced THEN '' ELSE 'm' || stream_id END || '"}' FROM ends)
SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY s, pos) AS seq, frame || chr(10) || chr(10) AS frame FROM f"""
)
def stream_order(spark, d):
    """Tokens, then citations or an error, then done."""
    tokens = table(spark, d, "events").select(F.floor(F.col("event_id") / 10).alias("stream_id"), (F.col("event_id") % 10).alias("pos"), F.col("event_type").alias("token"))
    k = F.col("stream_id")
    ends = tokens.select("stream_id").distinct().select("stream_id", F.lit(None).cast("string").alias("citations"), F.concat(F.lit("m"), k).alias("message_id"), F.when(k % 3 == 0, "broken").alias("error"), (k % 5 == 0).alias("fenced"))
    return chat.answer_frames(tokens, ends)


@query(
    f"""WITH {MESSAGES}, c AS (SELECT id, seq, 'first' AS name FROM m WHERE seq % 2 = 0)
SELECT m.id, 0 AS place, m.seq % 4 AS ref, CASE WHEN m.seq % 2 = 0 AND m.seq % 4 = 2 THEN 'first' END AS name FROM m UNION ALL SELECT id, 1, 12345678901, NULL FROM m"""
)
def reference_lookup(spark, d):
    """The [N] of answers and the citations that they name."""
    rows = _messages(spark, d).select(F.col("id").alias("message_id"), "seq")
    answers = rows.select("message_id", F.concat(F.lit("See ["), F.col("seq") % 4, F.lit("] and [12345678901].")).alias("content"))
    even = rows.filter("seq % 2 = 0")
    citations = even.select("message_id", F.lit(2).cast("decimal(38,0)").alias("doc_order"), F.explode(F.array(F.struct(F.lit(1).alias("pos"), F.lit("second").alias("name")), F.struct(F.lit(0).alias("pos"), F.lit("first").alias("name")))).alias("x")).select("message_id", "doc_order", "x.*")
    return chat.cited(answers, citations).select(F.col("message_id").alias("id"), "place", F.col("ref").cast("bigint").alias("ref"), "name")


@query(f"WITH {MESSAGES} SELECT id, 'text:a |ref:' || seq || '|text: b' AS parts FROM m")
def answer_segments(spark, d):
    parts = T.answer_segments(F.concat(F.lit("a ["), "seq", F.lit("] b")))
    return _messages(spark, d).select("id", F.array_join(F.transform(parts, lambda x: F.concat(x["kind"], F.lit(":"), x["value"])), "|").alias("parts"))


@query(
    f"""WITH {MESSAGES}, r AS (SELECT id, seq, CASE seq % 3 WHEN 0 THEN 'rag' WHEN 1 THEN 'model' ELSE 'agent' END AS mode FROM m WHERE notebook_id IS NOT NULL)
SELECT id AS qid, CASE mode WHEN 'rag' THEN 'R c' WHEN 'agent' THEN 'A c' ELSE CASE WHEN seq % 2 = 0 THEN 'M c' ELSE 'N' END END || '|' || CASE WHEN seq % 5 = 0 THEN '' ELSE 'user:one,assistant:two' END AS said FROM r"""
)
def message_lists(spark, d):
    """The messages that a model gets in each mode."""
    rows = _messages(spark, d).filter("notebook_id IS NOT NULL").select(F.col("id").alias("qid"), "seq")
    k = F.col("seq") % 3
    asked = rows.select("qid", F.when(k == 0, "rag").when(k == 1, "model").otherwise("agent").alias("mode"), F.lit("c").alias("context"), (F.col("seq") % 2 == 0).alias("found"))
    turn = lambda n, role, text: F.struct(F.lit(n).alias("seq"), F.lit(role).alias("role"), F.lit(text).alias("content"))
    turns = rows.filter("seq % 5 <> 0").select("qid", F.explode(F.array(turn(2, "assistant", "two"), turn(1, "user", "one"))).alias("t")).select("qid", "t.*")
    templates = {"rag": "R {context}", "model": "M {context}", "model_no_sources": "N", "agent": "A {context}"}
    out = chat.message_lists(asked, turns, templates=templates)
    rest = F.transform(F.slice("messages", 2, 9), lambda x: F.concat(x["role"], F.lit(":"), x["content"]))
    return out.select("qid", F.concat(F.get("messages", F.lit(0))["content"], F.lit("|"), F.array_join(rest, ",")).alias("said"))


@query(f"WITH {MESSAGES} SELECT id AS qid, unnest(CASE WHEN seq % 4 = 0 THEN [0] ELSE [0, 1] END)::BIGINT AS pos, CASE WHEN seq % 4 = 0 THEN 'down' END AS error FROM m")
def model_answers(spark, d):
    """Answers by a connector that fails for some requests."""

    def connector(provider: str, model: str, messages: list[dict[str, str]]):
        if provider == "broken":
            raise OSError("down")
        yield from (model, messages[0]["content"])

    turn = F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("content")))
    rows = _messages(spark, d).select(F.col("id").alias("qid"), F.when(F.col("seq") % 4 == 0, "broken").alias("provider"), F.lit("m").alias("model"), turn.alias("messages"))
    return embedding.answer(rows, connector).select("qid", "pos", "error")


@query("SELECT s_suppkey, 'id=' || s_suppkey || chr(10) || 'name=' || s_name || chr(10) || 'description=' || chr(10) || 'tools=' || CASE WHEN s_suppkey % 2 = 0 THEN 'a, b' ELSE 'n/a' END || chr(10) || 'requires=n/a' AS card, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ' [' || s_suppkey || ']' ELSE s_suppkey::VARCHAR END AS label, CASE WHEN s_suppkey % 2 = 0 THEN 'm,m:1' ELSE 'm' END AS models FROM supplier")
def agent_cards(spark, d):
    even = F.col("s_suppkey") % 2 == 0
    rows = table(spark, d, "supplier")
    tools = F.when(even, F.array(F.lit("a"), F.lit("b")))
    models = F.array_sort(chat.model_candidates(F.when(even, "m:1").otherwise("m")))
    key = F.col("s_suppkey").cast("string")
    return rows.select("s_suppkey", chat.agent_card(key, "s_name", F.lit(None).cast("string"), tools, F.array().cast("array<string>")).alias("card"), chat.agent_label(F.when(even, F.col("s_name")).otherwise(" "), key).alias("label"), F.array_join(models, ",").alias("models"))


# --- scalars


@query("SELECT event_id, [x FOR x IN string_split(CASE event_id % 3 WHEN 0 THEN 'a,,b' WHEN 1 THEN '' ELSE event_type END, ',') IF x <> ''] AS ids, 'http://h/' || (event_id % 4) AS base, CASE event_id % 4 WHEN 0 THEN 7 WHEN 1 THEN 1 WHEN 2 THEN 50 ELSE 5 END AS history FROM events")
def request_parameters(spark, d):
    """Comma lists, base addresses and history lengths as clients send them."""
    k, m = F.col("event_id") % 3, F.col("event_id") % 4
    ids = F.when(k == 0, "a,,b").when(k == 1, "").otherwise(F.col("event_type"))
    history = F.when(m == 0, "7.9").when(m == 1, "-3").when(m == 2, "1e9").otherwise("many")
    return table(spark, d, "events").select("event_id", T.listed(ids).alias("ids"), T.base_url(F.concat(F.lit(" http://h/"), m, F.lit("// "))).alias("base"), T.clamped(history, 1, 50, 5).alias("history"))


@query("SELECT vec_id, len(embedding) AS dim, round(1000 + list_sum(embedding::DOUBLE[]), 3) AS total, false AS broken FROM embeddings")
def vector_codec(spark, d):
    """Vectors as JSON and back."""
    json = V.encoded(V.doubles("embedding"))
    back = V.decoded(json)
    return table(spark, d, "embeddings").select("vec_id", F.size(back).cast("bigint").alias("dim"), F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + x) + 1000, 3).alias("total"), V.decoded(F.concat(F.lit("x"), json)).isNotNull().alias("broken"))


@query("SELECT p_partkey, CASE WHEN n < 1000 THEN 'none' WHEN n < 100000 THEN 'sq' ELSE 'pq' END AS kind, CASE WHEN n >= 1000 THEN 8 END AS bits, CASE WHEN n >= 100000 THEN list_max(list_filter(range(1, 17), lambda x: p_size % x = 0 AND x <= p_size)) END AS m FROM (SELECT *, p_partkey * p_size * 20 AS n FROM part)")
def quantization_settings(spark, d):
    rows = table(spark, d, "part").select("p_partkey", V.product_quantization(F.col("p_partkey") * F.col("p_size") * 20, F.col("p_size").cast("bigint")).alias("q"))
    return rows.select("p_partkey", "q.kind", "q.bits", "q.m")


@query("SELECT chunk_seq, concat_ws(':', doc_id, chunk_index) AS chunk_key FROM chunks")
def chunk_keys(spark, d):
    return table(spark, d, "chunks").select("chunk_seq", T.chunk_key("doc_id", "chunk_index").alias("chunk_key"))


@query("SELECT event_id, props[1:5] AS cut, '-' AS missing FROM events")
def cut_metadata(spark, d):
    """Values of a client event's metadata cut to their greatest length; missing fields as a dash."""
    rows = table(spark, d, "events").select("event_id", E.cut_values(F.create_map(F.lit("p"), "props"), 5).alias("m"), F.lit("").alias("missing"))
    return files.with_defaults(rows, ["missing"]).select("event_id", F.element_at("m", F.lit("p")).alias("cut"), "missing")


@query("SELECT now_ok, id_ok FROM (SELECT true AS now_ok, true AS id_ok) WHERE (SELECT count(*) FROM region) > 0")
def generated_values(spark, d):
    """The time in ISO form, and ids that differ."""
    rows = table(spark, d, "region").select(T.now_iso().rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00$").alias("now_ok"), T.new_id().alias("i"))
    return rows.agg(F.bool_and("now_ok").alias("now_ok"), (F.count_distinct("i") == F.count(F.lit(1))).alias("id_ok"))


@query(f"WITH {BLOCKS}, h AS (SELECT doc_id, pos, text, CASE doc_id % 4 WHEN 0 THEN 'gost' WHEN 1 THEN 'technical_manual' WHEN 2 THEN 'api_docs' ELSE 'markdown' END AS doc_type FROM (SELECT doc_id, pos, CASE pos % 5 WHEN 0 THEN '## ' WHEN 1 THEN '1. ' WHEN 2 THEN '2.3 ' WHEN 3 THEN 'Chapter 7 ' ELSE '#### ' END || text AS text FROM blocks)) SELECT doc_id, pos, {LEVEL_SQL} AS level FROM h")
def header_levels(spark, d):
    """Levels of headers by the patterns of all four document types."""
    k, p = F.col("doc_id") % 4, F.col("pos") % 5
    mark = F.when(p == 0, "## ").when(p == 1, "1. ").when(p == 2, "2.3 ").when(p == 3, "Chapter 7 ").otherwise("#### ")
    kind = F.when(k == 0, "gost").when(k == 1, "technical_manual").when(k == 2, "api_docs").otherwise("markdown")
    rows = _blocks(spark, d).select("doc_id", "pos", F.concat(mark, "text").alias("t"), kind.alias("kind"))
    return rows.select("doc_id", "pos", chunkers.header_level(F.col("t"), F.col("kind")).alias("level"))


@query("SELECT doc_id, CASE WHEN n_chars > 0 THEN 'text' WHEN doc_id % 2 = 0 THEN 'ocr' ELSE 'failed' END AS branch, CASE WHEN n_chars > 0 OR doc_id % 2 = 0 THEN NULL ELSE 'no text layer and OCR is off' END AS error FROM documents")
def parse_branch(spark, d):
    """Text layer, OCR or a parse error."""
    branch, error = state.parse_state(F.col("n_chars") > 0, F.col("doc_id") % 2 == 0)
    return table(spark, d, "documents").select("doc_id", branch.alias("branch"), error.alias("error"))


@query("SELECT doc_id, CASE WHEN bool_or(coalesce(len(list_filter(embedding, lambda x: abs(x) > 0)) > 0, false)) THEN 'ok' ELSE 'failed' END AS embeddings_status FROM chunks JOIN chunk_embeddings ON chunk_rowid = chunk_seq GROUP BY 1")
def embeddings_status(spark, d):
    rows = table(spark, d, "chunks").select("doc_id", "chunk_seq").join(table(spark, d, "chunk_embeddings").withColumnRenamed("chunk_rowid", "chunk_seq"), "chunk_seq")
    return state.embedding_status(rows, "doc_id")


@query("SELECT doc_id, CASE WHEN text IS NULL OR NOT regexp_matches(text, '[^\\s\\p{Z}]') THEN 'unknown' WHEN regexp_matches(text[1:1000], '[а-яА-Я]') THEN 'cyrillic' ELSE 'other' END AS language FROM documents")
def language_column(spark, d):
    """A language per document by a pluggable detector of the first characters."""

    def detect(t: str) -> str:
        return "cyrillic" if any("а" <= c <= "я" or "А" <= c <= "Я" for c in t) else "other"

    return files.with_language(table(spark, d, "documents"), detect)


# --- files


def _as_files(spark: SparkSession, d: str, content: Column, ext: str) -> DataFrame:
    """Rows as the binary reader gives them, one file per document."""
    name = F.concat(F.lit("doc-"), "doc_id", F.lit(ext))
    return table(spark, d, "documents").select(F.concat(F.lit("/files/"), name).alias("path"), name.alias("filename"), F.col("size_bytes"), content.alias("content"))


@query(f"WITH {BLOCKS} SELECT '/files/doc-' || doc_id || '.txt' AS path, pos, text, chunk_type, section_header FROM blocks")
def text_files(spark, d):
    """Text files decoded and cut into blocks."""
    rows = files.decoded_text(_as_files(spark, d, F.encode("text", "UTF-8"), ".txt"))
    return chunkers.blocks(rows, "path").select("path", "pos", "text", "chunk_type", "section_header")


DOCX_LINE = rf"regexp_replace(coalesce(title, ''), '[^\p{{L}}\p{{N}} ]', '', 'g')"


@query(
    f"""WITH t AS (SELECT doc_id, {STRIP.format(DOCX_LINE)} AS h FROM documents),
b AS (SELECT doc_id, 0 AS k, h AS text, 'header' AS chunk_type, h AS section_header FROM t WHERE h <> '' UNION ALL SELECT doc_id, 1, '- item ' || doc_id, 'text', nullif(h, '') FROM t UNION ALL SELECT doc_id, 2, '| a | ' || doc_id || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| x\\|y | z |', 'table', nullif(h, '') FROM t)
SELECT '/files/doc-' || doc_id || '.docx' AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, text, chunk_type, section_header FROM b"""
)
def docx_files(spark, d):
    """Office documents with a heading, a list and a table."""
    import io
    import zipfile
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        p = lambda text, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
        cell = lambda text: f"<w:tc>{p(text)}</w:tc>"
        for batch in batches:
            out = []
            for key, title in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = p(title, "Heading1") + p(f"item {key}", "ListBullet") + f"<w:tbl><w:tr>{cell('a')}{cell(str(key))}</w:tr><w:tr>{cell('x|y')}{cell('z')}</w:tr></w:tbl>"
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
                out.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "content"])

    title = T.strip(F.regexp_replace(F.coalesce("title", F.lit("")), r"[^\p{L}\p{N} ]", ""))
    made = table(spark, d, "documents").select("doc_id", title.alias("title")).mapInArrow(run, "doc_id bigint, content binary")
    name = F.concat(F.lit("doc-"), "doc_id", F.lit(".docx"))
    return files.extracted_blocks(made.select(F.concat(F.lit("/files/"), name).alias("path"), name.alias("filename"), "content")).drop("page_number")


@query("SELECT '/files/doc-' || doc_id || e AS doc_id, CASE WHEN e = '.xlsx' THEN 'Table content placeholder for doc-' ELSE 'Extracted content from doc-' END || doc_id || e AS text, CASE WHEN e = '.xlsx' THEN 'table' ELSE 'text' END AS chunk_type FROM documents, (SELECT unnest(['.xlsx', '.pdf', '.docx']) AS e)")
def unreadable_files(spark, d):
    """Placeholders of files that can't be read here."""
    junk = F.encode(F.concat(F.lit("junk "), "doc_id"), "UTF-8")
    rows = _as_files(spark, d, junk, ".xlsx").unionByName(_as_files(spark, d, junk, ".pdf")).unionByName(_as_files(spark, d, junk, ".docx"))
    return files.extracted_blocks(rows).select("doc_id", "text", "chunk_type")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a b.txt' ELSE 'upload.bin' END AS name FROM documents WHERE size_bytes <= 4000")
def upload_checks(spark, d):
    """Uploads within the size limit under safe names."""
    raw = F.when(F.col("doc_id") % 2 == 0, "../x\\..a <b>?.txt").otherwise("../")
    return files.within_limit(table(spark, d, "documents"), 4000).select("doc_id", files.sanitized_name(raw).alias("name"))


@query("SELECT n_nationkey AS page, i AS image, '[FORMULA_IMAGE: page_' || n_nationkey || '_formula_' || i || ']' AS text FROM nation, unnest(range(1, n_regionkey + 2)) AS u(i)")
def formula_images(spark, d):
    images = table(spark, d, "nation").select(F.lit(1).alias("doc_id"), F.col("n_nationkey").alias("page"), F.explode(F.sequence(F.lit(1), F.col("n_regionkey") + 1)).alias("image"))
    marks = files.formula_marks(images).withColumn("image", F.regexp_extract("text", r"formula_(\d+)", 1).cast("bigint"))
    return marks.select("page", "image", "text")


@query("SELECT DISTINCT notebook_id, chunk_size FROM parsing_settings WHERE notebook_id IS NOT NULL AND chunk_size IS NOT NULL")
def json_files(spark, d):
    """One JSON object per file; a broken file is skipped."""
    path = folder(spark, "rows")
    rows = table(spark, d, "parsing_settings").filter("notebook_id IS NOT NULL AND chunk_size IS NOT NULL").select("notebook_id", "chunk_size").distinct()
    rows.select(F.concat_ws("-", "notebook_id", "chunk_size").alias("f"), F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.partitionBy("f").text(path)
    spark.range(1).select(F.lit("{broken").alias("value"), F.lit("z").alias("f")).write.mode("append").partitionBy("f").text(path)
    return files.json_rows(spark, path, "notebook_id string, chunk_size int", "notebook_id").filter("notebook_id IS NOT NULL")


@query("SELECT s_suppkey::VARCHAR AS id, s_name AS name, 'agent' AS requires FROM supplier WHERE s_suppkey <= 20")
def agent_files(spark, d):
    """Agents of a registry file."""
    path = folder(spark, "agents")
    listed = table(spark, d, "supplier").filter("s_suppkey <= 20").select(F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name")).alias("a"))
    one = listed.agg(F.to_json(F.struct(F.lit(1).alias("version"), F.collect_list("a").alias("agents")), {"pretty": "true"}).alias("value"))  # a registry lists a few agents
    one.write.text(f"{path}/registry.json")
    return chat.normalized_agents(files.agents(spark, path)).select("id", "name", F.array_join("requires", ",").alias("requires"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_load(spark, d):
    path = folder(spark, "csv")
    table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).csv(path)
    return files.csv_table(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT 'r=' || r_regionkey AS kind, 1::BIGINT AS files FROM region SEMI JOIN nation ON n_regionkey = r_regionkey")
def knowledge_listing(spark, d):
    """Files of a folder by their subfolder, without dot files."""
    path = folder(spark, "knowledge")
    table(spark, d, "nation").coalesce(1).select(F.col("n_regionkey").alias("r"), F.col("n_name").alias("value")).write.partitionBy("r").text(path)
    return files.knowledge_files(spark, path).filter("kind LIKE 'r=%'").groupBy("kind").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT '/logs/app-' || strftime(max(ts), '%Y-%m-%d-%H') || '.log' AS path FROM events")
def latest_log(spark, d):
    """The newest log file of a prefix."""
    logs = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd-HH").alias("h")).agg(F.max("ts").alias("modificationTime"))
    both = logs.select(F.concat(F.lit("/logs/app-"), "h", F.lit(".log")).alias("path"), "modificationTime").unionByName(logs.select(F.concat(F.lit("/logs/client-"), "h", F.lit(".log")).alias("path"), F.expr("modificationTime + INTERVAL 1 DAY").alias("modificationTime")))
    return files.latest_file(both, "app-").select("path")


@query("SELECT source, count(*) AS docs, count(*) FILTER (n_chars > 0) AS indexed FROM documents GROUP BY 1")
def index_by_stream(spark, d):
    """Documents indexed as they arrive: each batch is written under its number, so that one that is repeated replaces itself."""
    out = folder(spark, "indexed")
    docs = table_stream(spark, d, "documents")

    def index(batch: DataFrame, number: int) -> None:
        state_ = F.when(F.col("n_chars") > 0, "indexed").otherwise("failed")
        batch.select("doc_id", "source", state_.alias("status")).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    E.index_stream(docs, index, f"{out}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("status") == "indexed").alias("indexed"))


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 UNION SELECT doc_id FROM documents WHERE doc_id % 3 = 0 EXCEPT SELECT doc_id FROM documents WHERE doc_id % 5 = 0")
def set_operations(spark, d):
    """Union, difference and order of id lists."""
    ids = table(spark, d, "documents").select("doc_id")
    both = ids.filter("doc_id % 2 = 0").unionByName(ids.filter("doc_id % 3 = 0")).distinct()
    return state.unselected(both, ids.filter("doc_id % 5 = 0"), "doc_id").orderBy("doc_id")
