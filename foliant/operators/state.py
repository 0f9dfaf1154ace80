"""Bookkeeping of notebooks, sources, settings, tags and messages: key-level replaces on DataFrames.

Nothing is updated in place: each operator gives the next version of a table,
to be written to a new place or over the partitions it touches.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.text import filled


def last_of_each(rows: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """One row per key: the largest by ``order``, then by all columns; rows with a null in the key all stay."""
    by = [c for c in ([order] if order else []) + rows.columns]
    best = F.max_by(F.struct(*rows.columns), F.struct(*[F.col(c).cast("string") if dict(rows.dtypes)[c].startswith(("map", "array", "struct")) else F.col(c) for c in by]))
    whole = [F.col(k).isNotNull() for k in key]
    keyed = reduce(lambda a, b: a & b, whole)
    return rows.filter(keyed).groupBy(*key).agg(best.alias("_b")).select("_b.*").unionByName(rows.filter(~keyed))


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_old: list[str] | None = None, order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal key; columns ``keep_old`` stay as they were.

    Null keys never match and are appended. Of several new rows with one key the last by ``order`` is taken, else the largest.
    """
    new = last_of_each(new, key, order)
    kept = old.join(new.select(*key).distinct(), key, "left_anti")
    if keep_old:
        before = old.groupBy(*key).agg(*[F.min(c).alias(f"_{c}") for c in keep_old])
        new = new.join(before, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in keep_old}).select(*old.columns)
    return kept.unionByName(new, allowMissingColumns=True)


def without(rows: DataFrame, gone: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Rows whose key isn't among those of ``gone``; null keys stay."""
    return rows.join(gone.select(F.col(other or key).alias(key)).distinct(), key, "left_anti")


def delete_documents(gone: DataFrame, documents: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> dict[str, DataFrame]:
    """Documents, chunks and vectors after a delete; vectors of removed chunks go too, so none is orphaned."""
    left = without(chunks, gone, "doc_id")
    return {
        "documents": without(documents, gone, "doc_id"),
        "chunks": left,
        "embeddings": embeddings.join(left.select(F.col("chunk_seq").alias("chunk_rowid")).distinct(), "chunk_rowid", "left_semi"),
    }


def renumbered(rows: DataFrame, group: str, order: list[str | Column], column: str = "sort_order") -> DataFrame:
    """``column`` numbered 1..n in each group."""
    return rows.withColumn(column, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint"))


def reordered(rows: DataFrame, wanted: DataFrame, key: str, column: str = "sort_order", group: str | None = None) -> DataFrame:
    """Rows named in ``wanted`` (key, position from 1) take that number, the others keep theirs.

    With ``group`` (also in ``wanted``): a request that names a row which isn't in its group changes nothing there.
    """
    if group:
        foreign = wanted.join(rows.select(group, key), [group, key], "left_anti").select(group).distinct()
        wanted = wanted.join(foreign, group, "left_anti")
    return rows.join(wanted.select(key, F.col("position").alias("_p")), key, "left").withColumn(column, F.coalesce("_p", column)).drop("_p")


def next_order(rows: DataFrame, group: str, column: str = "sort_order") -> DataFrame:
    return rows.groupBy(group).agg(F.coalesce(F.max(column), F.lit(0)).cast("bigint").alias("max_sort_order"))


def index_status(rows: DataFrame, group: str, status: Column) -> DataFrame:
    """Total and counts by status of each group."""
    names = ("new", "indexing", "indexed", "failed")
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(status == n).alias(f"n_{n}") for n in names])


def merged_config(individual: DataFrame, settings: DataFrame, fields: dict[str, str], on: str = "notebook_id") -> DataFrame:
    """Each row's settings over its notebook's; empty strings and zeros fall back, booleans only where null."""
    base = settings.groupBy(on).agg(*[F.min(f).alias(f"_{f}") for f in fields])

    def pick(f: str) -> Column:
        own = F.col(f)
        if fields[f] == "boolean":
            return F.coalesce(own, F.col(f"_{f}"))
        return F.coalesce(filled(own) if fields[f] == "string" else F.when(own != 0, own), F.col(f"_{f}"))

    return individual.join(base, on, "left").select(*[c for c in individual.columns if c not in fields], *[pick(f).alias(f) for f in fields])


def duplicated(documents: DataFrame, chunks: DataFrame, source: str, target: str, mapping: DataFrame, group: str = "source") -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of one notebook under another's name and new ids (old_id, new_id); chunk ids stay."""
    docs = documents.filter(F.col(group) == source).join(mapping.select(F.col("old_id").alias("doc_id"), "new_id"), "doc_id")
    docs = docs.withColumn("doc_id", F.col("new_id")).withColumn(group, F.lit(target)).select(*documents.columns)
    copied = chunks.join(mapping.select(F.col("old_id").alias("doc_id"), "new_id"), "doc_id")
    return docs, copied.withColumn("doc_id", F.col("new_id")).select(*chunks.columns)


def free_names(files: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """``stored_name``: a name that is taken already becomes ``stem_N.ext`` with the smallest N from 1 that is free.

    Files come in order; a name counts as taken once an earlier file is stored under it, whether given or made up.
    Only files whose name, or whose made-up name, can clash meet in one place: those of one
    group and stem, where stems are compared without their ``_N`` endings.
    """
    stem = F.regexp_replace(name, r"(.)\.[^.]+$", "$1")
    family = F.concat_ws("\u0000", F.regexp_replace(stem, r"(_\d+)+$", ""), F.regexp_extract(name, r".(\.[^.]+)$", 1))
    rows = files.withColumn("_family", family)
    shared = rows.groupBy(group, "_family").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(shared.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")) & rows["_family"].eqNullSafe(shared["_family"])).drop("_g", shared["_family"])
    alone = rows.filter("_n = 1").withColumn("stored_name", F.col(name))

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_o", "ascending")])
        taken: set[str] = set()
        after: dict[str, int] = {}
        out = []
        for given in table["_name"].to_pylist():
            free = given
            if given in taken:
                m = re.match(r"^(.+)(\.[^.]+)$", given, re.DOTALL)
                first, ext = m.groups() if m else (given, "")
                n = after.get(given, 1)
                while f"{first}_{n}{ext}" in taken:
                    n += 1
                free, after[given] = f"{first}_{n}{ext}", n + 1
            taken.add(free)
            out.append(free)
        return pa.table({"_o": table["_o"], "stored_name": pa.array(out, pa.string())})

    kind = dict(files.dtypes)[order]
    met = rows.filter("_n > 1").select(F.col(group).alias("_g"), "_family", F.col(order).alias("_o"), F.col(name).alias("_name")).groupBy("_g", "_family").applyInArrow(settle, f"_o {kind}, stored_name string")
    clashing = rows.filter("_n > 1").join(met, F.col(order) == F.col("_o")).drop("_o")
    return alone.unionByName(clashing).drop("_n", "_family")


def toggled_tag(tags: DataFrame, tag: str, enabled: bool) -> DataFrame:
    """Tags with one switched, added if it is new."""
    one = tags.sparkSession.range(1).select(F.lit(tag).alias("tag"), F.lit(enabled).alias("is_enabled"))
    return upsert(tags.select("tag", "is_enabled"), one, ["tag"])


def chunk_links(chunks: DataFrame, doc: str = "doc_id", index: str = "chunk_index", key: str = "chunk_id") -> DataFrame:
    """Neighbours, totals, heading path and content type of each chunk of a document."""
    at = Window.partitionBy(doc).orderBy(index, key)
    kind = F.lower("chunk_type")
    path = F.filter(F.array("parent_header", "section_header"), lambda x: x.isNotNull() & (x != ""))
    return chunks.select(
        doc,
        key,
        (F.row_number().over(at).cast("bigint") - 1).alias("position"),
        F.lag(key).over(at).alias("prev_chunk_id"),
        F.lead(key).over(at).alias("next_chunk_id"),
        F.count(F.lit(1)).over(Window.partitionBy(doc)).alias("total_chunks"),
        F.array_join(path, " / ").alias("heading_path"),
        F.when(kind.isin("header", "heading"), "heading").when(kind == "table", "table").otherwise("text").alias("content_type"),
    )


def chunk_estimate(counts: DataFrame, tokens: str = "tokens", size: str = "chunk_size") -> Column:
    return F.greatest(F.lit(1), F.floor(F.col(tokens) / F.greatest(F.lit(1), F.col(size))) + 1).cast("bigint")


def moved(order: Column, item: Column, to: Column) -> Column:
    """An id array with one item taken out and put in at position ``to`` (from 1)."""
    rest = F.array_remove(order, item)
    at = F.least(F.greatest(to, F.lit(1)), F.size(rest) + 1)
    return F.when(F.array_contains(order, item), F.array_insert(rest, at, item)).otherwise(order)


def toggled(selection: Column, item: Column) -> Column:
    """A selection with one id switched in or out."""
    return F.when(F.array_contains(selection, item), F.array_remove(selection, item)).otherwise(F.array_append(selection, item))


def unselected(rows: DataFrame, selection: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(selection.select(key), key, "left_anti")


def default_selection(rows: DataFrame, selection: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Enabled sources; an explicit selection is cut to them."""
    enabled = rows.filter(F.coalesce("is_enabled", F.lit(True)))
    return enabled if selection is None else enabled.join(selection.select(key), key, "left_semi")


def patched_config(rows: DataFrame, patches: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Individual settings replaced as a whole where there is a patch: fields that it leaves out become null."""
    given = patches.select(key, F.lit(True).alias("_given"), *[(F.col(f) if f in patches.columns else F.lit(None)).alias(f"_{f}") for f in fields])
    joined = rows.join(given, key, "left")
    return joined.withColumns({f: F.when(F.col("_given"), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}).select(*rows.columns)


def erased(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Sources whose data was erased: the file stays, the status is new, no base and no parsing."""
    hit = gone.select(key, F.lit(True).alias("_hit"))
    new = {"status": F.lit("new"), "has_parsing": F.lit(False), "has_base": F.lit(False)}
    joined = rows.join(hit, key, "left")
    return joined.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in new.items() if c in rows.columns}).drop("_hit")


def recovered(rows: DataFrame, present: DataFrame, key: str = "id") -> DataFrame:
    """After a restart: what was indexing has failed; ``has_docs`` says whether the file is there."""
    there = present.select(key, F.lit(True).alias("_there")).distinct()
    status = F.when(F.col("status") == "indexing", "failed").otherwise(F.col("status"))
    return rows.join(there, key, "left").withColumns({"status": status, "has_docs": F.coalesce("_there", F.lit(False))}).drop("_there")


def embedding_status(chunks: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """(by, embeddings_status): ok if any vector of a source has a value, else failed."""
    good = F.exists(vector, lambda x: F.abs(x) > 0)
    return chunks.groupBy(by).agg(F.when(F.coalesce(F.bool_or(good), F.lit(False)), "ok").otherwise("failed").alias("embeddings_status"))


def appended_messages(messages: DataFrame, new: DataFrame, group: str = "notebook_id", order: str = "seq") -> DataFrame:
    """New messages after the last of their conversation, in their given order."""
    last = messages.groupBy(group).agg(F.max(order).alias("_last"))
    at = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return messages.unionByName(new.join(last, group, "left").withColumn(order, F.coalesce("_last", F.lit(0)) + at).select(*messages.columns))


def cleared(messages: DataFrame, versions: DataFrame, gone: DataFrame, group: str = "notebook_id") -> tuple[DataFrame, DataFrame]:
    """Messages without those of cleared conversations, and the versions, one higher for each."""
    hit = gone.select(group).distinct().withColumn("_hit", F.lit(1))
    new = versions.join(hit, group, "full").select(group, (F.coalesce("version", F.lit(0)) + F.coalesce("_hit", F.lit(0))).alias("version"))
    return without(messages, gone, group), new


def late_dropped(streams: DataFrame, clears: DataFrame, group: str = "notebook_id", started: str = "started_at") -> DataFrame:
    """Streams that began after their conversation's last clear."""
    last = clears.groupBy(group).agg(F.max("cleared_at").alias("_last"))
    return streams.join(last, group, "left").filter(F.col("_last").isNull() | (F.col(started) > F.col("_last"))).drop("_last")


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the rows of any key of ``new``, and the rows of ``new``."""
    return without(old, new, key).unionByName(new, allowMissingColumns=True)


def distinct_tags(c: str | Column = "tags") -> Column:
    """Tags once each, in order, without nulls."""
    return F.array_sort(F.array_distinct(F.array_compact(c)))


def with_tags(document_tags: DataFrame, wanted: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document tags, tags) after the documents of ``wanted`` (doc_id, tags array) got just these tags; new tags are enabled, known ones stay."""
    given = wanted.select("doc_id", F.explode(distinct_tags()).alias("tag"))
    left = without(document_tags, wanted, "doc_id").unionByName(given)
    new = given.select("tag").distinct().join(tags.select("tag"), "tag", "left_anti").withColumn("is_enabled", F.lit(True))
    return left, tags.select("tag", "is_enabled").unionByName(new)


def stored_documents(store: dict[str, DataFrame], documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, postings: DataFrame | None = None) -> dict[str, DataFrame]:
    """The store's next version after an upsert of whole documents.

    store: documents, chunks, embeddings, document_tags, tags and, if there is an index, postings. A document
    (with ``tags``) replaces the one of its id but for ``created_at``; its old chunks, their
    vectors and postings go, the new ones and its tags come in their place. All tables belong to one version:
    written to new places and switched together, a reader never sees half of it.
    """
    gone = store["chunks"].join(documents.select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("chunk_seq").alias("chunk_rowid"))
    document_tags, tags = with_tags(store["document_tags"], documents.select("doc_id", "tags"), store["tags"])
    out = {
        "documents": upsert(store["documents"], documents.drop("tags"), ["doc_id"], ["created_at"]),
        "chunks": without(store["chunks"], documents, "doc_id").unionByName(chunks, allowMissingColumns=True),
        "embeddings": without(without(store["embeddings"], gone, "chunk_rowid"), embeddings, "chunk_rowid").unionByName(embeddings),
        "document_tags": document_tags,
        "tags": tags,
    }
    if postings is not None:
        out["postings"] = without(store["postings"], gone, "chunk_seq", "chunk_rowid").unionByName(postings)
    return out


def set_enabled(rows: DataFrame, ids: DataFrame, enabled: bool, key: str = "doc_id") -> DataFrame:
    """Rows of the given ids switched on or off."""
    hit = ids.select(F.col(key)).distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, key, "left").withColumn("is_enabled", F.when(F.col("_hit"), F.lit(enabled)).otherwise(F.col("is_enabled"))).drop("_hit")


def deleted_sources(gone: DataFrame, sources: DataFrame, documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, citations: DataFrame, group: str = "notebook_id") -> dict[str, DataFrame]:
    """The tables after sources (id) were deleted with their documents, chunks, vectors and saved citations; the others are numbered anew."""
    left = renumbered(without(sources, gone, "id"), group, ["sort_order", "id"])
    stored = delete_documents(gone.select(F.col("id").alias("doc_id")), documents, chunks, embeddings)
    return {"sources": left, **stored, "citations": without(citations, gone, "source_id", "id")}


def without_files(sources: DataFrame, gone: DataFrame | None = None, group: str = "notebook_id") -> tuple[DataFrame, DataFrame]:
    """(sources, removed files by group) after the files of ``gone`` (id; all if None) were deleted; the rows stay."""
    hit = (gone if gone is not None else sources).select("id").distinct().withColumn("_hit", F.lit(True))
    rows = sources.join(hit, "id", "left").withColumn("_had", F.coalesce(F.col("_hit") & F.col("has_docs"), F.lit(False)))
    counts = rows.groupBy(group).agg(F.count_if("_had").alias("removed"))
    return rows.withColumn("has_docs", F.when(F.col("_hit"), F.lit(False)).otherwise(F.col("has_docs"))).drop("_hit", "_had"), counts


def without_notebooks(gone: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Each table (with the name of its notebook column) without the rows of the notebooks in ``gone`` (id); global notes aren't among them."""
    return {name: without(rows, gone, column, "id") for name, (rows, column) in tables.items()}


def duplicated_notebook(store: dict[str, DataFrame], source: str, target: str, mapping: DataFrame, prefix: str = "Копия: ") -> dict[str, DataFrame]:
    """The rows of a copy of notebook ``source``: notebook, settings, sources, documents, chunks, embeddings.

    mapping: old_id, new_id of its sources. Chunk ids stay as they are; row ids of chunks start after the
    largest in use; the copy's sources have no base yet.
    """
    ids = mapping.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new"))
    last = store["chunks"].agg(F.coalesce(F.max("chunk_seq"), F.lit(0)).alias("_last"))
    chunks = store["chunks"].join(ids, F.col("doc_id") == F.col("_old"))
    # One notebook's chunks are numbered in one task; only ids are sorted there.
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("chunk_seq"))
    numbers = chunks.select(F.col("chunk_seq").alias("_seq"), place.alias("_place")).crossJoin(F.broadcast(last)).select("_seq", (F.col("_last") + F.col("_place")).alias("_number"))
    chunks = chunks.join(numbers, F.col("chunk_seq") == F.col("_seq"))
    copy = lambda rows, **to: rows.withColumns(to).select(*[c for c in rows.columns if not c.startswith("_")])
    vectors = store["embeddings"].join(numbers, F.col("chunk_rowid") == F.col("_seq"))
    return {
        "notebooks": store["notebooks"].filter(F.col("id") == source).withColumns({"id": F.lit(target), "title": F.concat(F.lit(prefix), "title")}),
        "settings": store["settings"].filter(F.col("notebook_id") == source).withColumn("notebook_id", F.lit(target)),
        "sources": copy(store["sources"].filter(F.col("notebook_id") == source).join(ids, F.col("id") == F.col("_old")), id=F.col("_new"), notebook_id=F.lit(target), has_base=F.lit(False)),
        "documents": copy(store["documents"].join(ids, F.col("doc_id") == F.col("_old")), doc_id=F.col("_new")),
        "chunks": copy(chunks, doc_id=F.col("_new"), notebook_id=F.lit(target), chunk_seq=F.col("_number")),
        "embeddings": copy(vectors, chunk_rowid=F.col("_number")),
    }


def created_notebooks(notebooks: DataFrame, new: DataFrame) -> DataFrame:
    """Notebooks with new ones (id, title, created_at) appended; a blank title becomes a default one, known ids are left alone."""
    title = F.coalesce(filled(F.trim("title")), F.lit("Untitled notebook"))
    rows = new.withColumns({"title": title, "updated_at": F.col("created_at")}).join(notebooks.select("id"), "id", "left_anti")
    return notebooks.unionByName(rows.select(*notebooks.columns))


def renamed_notebooks(notebooks: DataFrame, titles: DataFrame) -> DataFrame:
    """Notebooks with the title and time of ``titles`` (id, title, updated_at) where there is one; ``created_at`` stays."""
    new = titles.select("id", F.col("title").alias("_title"), F.col("updated_at").alias("_at"))
    rows = notebooks.join(new, "id", "left")
    return rows.withColumns({"title": F.coalesce("_title", "title"), "updated_at": F.coalesce("_at", "updated_at")}).drop("_title", "_at")


def to_parse_again(sources: DataFrame, wanted: DataFrame | None = None, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(sources, jobs): the wanted enabled sources whose file is there (all if None) are indexing again, without error; jobs are their rows."""
    there = F.coalesce("is_enabled", F.lit(True)) & F.coalesce("has_docs", F.lit(False))
    jobs = sources.filter(there) if wanted is None else sources.filter(there).join(wanted.select(key).distinct(), key, "left_semi")
    hit = jobs.select(key, F.lit(True).alias("_hit"))
    rows = sources.join(hit, key, "left")
    changed = {"status": F.when(F.col("_hit"), "indexing").otherwise(F.col("status")), "index_warning": F.when(F.col("_hit").isNull(), F.col("index_warning"))}
    return rows.withColumns({c: v for c, v in changed.items() if c in rows.columns}).drop("_hit"), jobs


def of_known(rows: DataFrame, parents: DataFrame, column: str = "notebook_id", key: str = "id") -> DataFrame:
    """Rows whose parent exists; orphans are left out at load."""
    return rows.join(parents.select(F.col(key).alias(column)).distinct(), column, "left_semi")


def loaded_sources(rows: DataFrame, config: str, raw: str = "individual_config") -> DataFrame:
    """Sources in order, their configuration decoded; broken or missing JSON gives a configuration of nulls."""
    decoded = F.from_json(F.col(raw), config, {"mode": "PERMISSIVE"})
    empty = F.from_json(F.lit("{}"), config)
    return rows.withColumn(raw, F.coalesce(decoded, empty)).orderBy("notebook_id", "sort_order", "added_at", "id")


def matching_names(rows: DataFrame, asked: Column | str, name: str = "filename") -> DataFrame:
    """Rows whose file name holds the text, in any case; an empty text keeps all."""
    text = F.lower(F.trim(F.lit(asked) if isinstance(asked, str) else asked))
    return rows.filter(F.contains(F.lower(F.coalesce(name, F.lit(""))), text))


def parse_state(has_text: Column, ocr_enabled: Column) -> tuple[Column, Column]:
    """(branch, error): the text layer where there is one, else OCR if it is on, else a parse error."""
    text = F.coalesce(has_text, F.lit(False))
    branch = F.when(text, "text").when(F.coalesce(ocr_enabled, F.lit(False)), "ocr").otherwise("failed")
    return branch, F.when(branch == "failed", F.lit("no text layer and OCR is off"))


def embedded_registry(registry: DataFrame, chunks: DataFrame, by: list[str]) -> DataFrame:
    """The registry of embedded documents (by, chunk_count) after these documents' chunks were embedded."""
    return upsert(registry, chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("chunk_count")), by)


def write_embedded(spark: SparkSession, chunks: DataFrame, folder: str, by: list[str]) -> DataFrame:
    """Writes embedded chunks under ``folder/chunks`` and the next version of the registry beside them; gives that registry.

    The chunks are partitioned by notebook; the registry is replaced after them, so it never names what isn't there.
    """
    chunks.write.mode("overwrite").partitionBy(by[0]).parquet(f"{folder}/chunks")
    new = chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("chunk_count"))
    new.write.mode("overwrite").json(f"{folder}/registry")
    return spark.read.schema(new.schema).json(f"{folder}/registry")
