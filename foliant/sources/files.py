"""Files and registries as DataFrames, and the sinks that mirror them.

Binary formats are read as ``binaryFile`` rows and parsed in Arrow batches with
the standard library alone; a file that can't be read gives its placeholder.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.text import basename, filled, suffix

# Formats by extension.
READERS = {".txt": "text", ".md": "text", ".docx": "docx", ".pdf": "pdf", ".xlsx": "xlsx"}
FILE_TYPES = ("pdf", "docx", "xlsx")
BLOCKS = "doc_id string, pos bigint, text string, chunk_type string, page_number int, section_header string"


def reader_of(path: Column | str) -> Column:
    """text, docx, pdf, xlsx, or unsupported."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in READERS.items() for x in kv]), suffix(path)), F.lit("unsupported"))


def file_type(path: Column | str) -> Column:
    ext = F.regexp_replace(suffix(path), r"^\.", "")
    return F.when(ext.isin(*FILE_TYPES), ext).otherwise("other")


def binary_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, filename, size_bytes, file_hash, content) of a folder's files, dot files left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    rows = rows.filter(~basename("path").startswith("."))
    return rows.select("path", basename("path").alias("filename"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("file_hash"), "content")


def within_limit(files: DataFrame, most: int = 25 * 1024 * 1024) -> DataFrame:
    return files.filter(F.col("size_bytes") <= most)


def decoded_text(files: DataFrame) -> DataFrame:
    """``files`` with ``text``: UTF-8, malformed bytes dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([None if b is None else b.decode("utf-8", "ignore") for b in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(data: bytes, name: str) -> list[tuple[str, str, str | None]]:
    """(text, chunk_type, section_header): paragraphs by style, then the tables as Markdown; a placeholder if unreadable."""
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
        paragraphs = body.findall(f"{_W}p")
        tables = body.findall(f"{_W}tbl")
    except Exception:  # noqa: BLE001 - any unreadable file
        return [(f"Extracted content from {name}", "text", None)]
    joined = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    out: list[tuple[str, str, str | None]] = []
    header = None
    for p in paragraphs:
        text = joined(p).strip()
        if not text:
            continue
        style = p.find(f"{_W}pPr/{_W}pStyle")
        kind = (style.get(f"{_W}val") if style is not None else "").lower()
        if kind.startswith("heading"):
            header = text
            out.append((text, "header", header))
        else:
            out.append((f"- {text}" if "list" in kind else text, "text", header))
    for table in tables:
        rows = [[" ".join(joined(p).strip() for p in cell.findall(f"{_W}p")).strip().replace("|", "\\|") for cell in row.findall(f"{_W}tc")] for row in table.findall(f"{_W}tr")]
        rows = [r for r in rows if r]
        if rows:
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            out.append(("\n".join([lines[0], "| " + " | ".join("---" for _ in rows[0]) + " |", *lines[1:]]), "table", header))
    return out or [(f"Extracted content from {name}", "text", None)]


def extracted_blocks(files: DataFrame) -> DataFrame:
    """Blocks of docx and xlsx files and of unreadable ones (BLOCKS), one narrow map; text files go through ``blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()]
        for batch in batches:
            rows = []
            for path, name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ext = re.sub(r"^.*(\.[^.]+)$", r"\1", name).lower()
                if ext == ".docx":
                    rows += [(path, i, t, k, None, h) for i, (t, k, h) in enumerate(docx_blocks(data or b"", name))]
                elif ext == ".xlsx":
                    rows.append((path, 0, f"Table content placeholder for {name}", "table", 1, None))
                elif ext == ".pdf":
                    rows.append((path, 0, f"Extracted content from {name}", "text", 1, None))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return files.select("path", "filename", "content").mapInArrow(run, BLOCKS)


def page_lines(lines: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """Text-layer lines (doc, page, y0, x0, text, size) in reading order with header detection.

    Bare page numbers are dropped. A gap of at least 80 between neighbouring x
    splits the page into two columns. A line whose font is 1.5 above the page's
    smallest is a header and heads what follows, across pages.
    """
    rows = lines.filter(~F.col("text").rlike(r"^\s*\p{Nd}+\s*$"))
    by_page, by_x = Window.partitionBy(doc, page), Window.partitionBy(doc, page).orderBy("x0")
    rows = rows.withColumn("_gap", F.lead("x0").over(by_x) - F.col("x0")).withColumn("_at", F.row_number().over(by_x))
    split = F.max(F.struct(F.col("_gap"), (-F.col("_at")).alias("first"), (F.col("x0") + F.col("_gap") / 2).alias("x"))).over(by_page)
    rows = rows.withColumn("_split", split).withColumn("_n", F.count(F.lit(1)).over(by_page))
    two = (F.col("_n") >= 3) & (F.coalesce(F.col("_split._gap"), F.lit(0.0)) >= 80)
    side = F.when(two, (F.col("x0") > F.col("_split.x")).cast("int")).otherwise(0)
    order = F.row_number().over(Window.partitionBy(doc).orderBy(page, side, "y0", "x0"))
    header = F.col("size") >= F.min("size").over(by_page) + 1.5
    rows = rows.withColumn("_pos", order.cast("bigint") - 1).withColumn("_header", header)
    sticky = F.last(F.when(F.col("_header"), F.trim("text")), ignorenulls=True).over(Window.partitionBy(doc).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(doc, page, F.col("_pos").alias("pos"), F.trim("text").alias("text"), F.when(F.col("_header"), "header").otherwise("text").alias("chunk_type"), sticky.alias("section_header"))


def formula_marks(images: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """A formula block ``[FORMULA_IMAGE: page_P_formula_I]`` per image of a page (I from 1)."""
    i = F.row_number().over(Window.partitionBy(doc, page).orderBy("image"))
    return images.select(doc, page, F.format_string("[FORMULA_IMAGE: page_%d_formula_%d]", F.col(page), i).alias("text"), F.lit("formula").alias("chunk_type"))


CHUNK = "struct<chunk_index: bigint, text: string, chunk_type: string, page_number: int, section_header: string>"


def write_parsed(documents: DataFrame, chunks: DataFrame, path: str) -> None:
    """One JSON object per document: its metadata and its chunks in order."""
    ordered = F.sort_array(F.collect_list(F.struct("chunk_index", "text", "chunk_type", "page_number", "section_header")))
    documents.join(chunks.groupBy("doc_id").agg(ordered.alias("chunks")), "doc_id", "left").write.mode("overwrite").json(path)


def read_parsed(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """Chunks of parsed documents, from objects with ``chunks`` or from bare lists, one document a file or one a line.

    A file that is one JSON value, indented or not, is one document; else each of its lines is. Files of a
    document each are read whole; ``by_line`` is for the large ones of ``write_parsed``, which can be split.
    """
    raw = spark.read.text(path, wholetext=not by_line).withColumn("_file", F.input_file_name())
    shape = f"struct<doc_id: string, chunks: array<{CHUNK}>>"
    bare = f"array<{CHUNK}>"
    # Inside one value a bracket that closes is never followed by one that opens on the next line, without a comma.
    value = F.trim("value")
    one = ~value.rlike(r"[}\]]\s*[\r\n]+\s*[{\[]")
    lines = F.filter(F.split(value, r"[\r\n]+"), lambda x: F.trim(x) != "")
    rows = raw.select("_file", F.posexplode(F.when(one, F.array(value)).otherwise(lines)).alias("_line", "_json"))
    whole, listed_ = F.from_json("_json", shape), F.from_json("_json", bare)
    is_list = F.col("_json").rlike(r"^\s*\[")
    rows = rows.select(F.coalesce(F.when(~is_list, whole["doc_id"]), basename("_file")).alias("doc_id"), F.when(is_list, listed_).otherwise(whole["chunks"]).alias("chunks"))
    return rows.select("doc_id", F.posexplode("chunks").alias("_pos", "c")).select("doc_id", F.coalesce("c.chunk_index", "_pos").alias("chunk_index"), "c.text", "c.chunk_type", "c.page_number", "c.section_header")


def json_rows(spark: SparkSession, folder: str, schema: str, order: str = "created_at") -> DataFrame:
    """One JSON object per file, broken files skipped, in order."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(folder).orderBy(order)


def agent_registry(spark: SparkSession, path: str) -> DataFrame:
    """Manifests listed under ``agents`` of a registry file."""
    agent = "struct<id: string, name: string, description: string, version: string, provider: string, model: string, requires: array<string>>"
    return spark.read.schema(f"agents array<{agent}>").option("multiLine", True).json(path).select(F.explode("agents").alias("a")).select("a.*")


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def latest_file(files: DataFrame, prefix: str) -> DataFrame:
    """The newest file whose name begins with the prefix."""
    return files.filter(basename("path").startswith(prefix)).orderBy(F.desc("modificationTime"), "path").limit(1)


def with_defaults(rows: DataFrame, columns: list[str], mark: str = "-") -> DataFrame:
    """Missing log fields shown as a dash."""
    return rows.withColumns({c: F.coalesce(filled(F.col(c).cast("string")), F.lit(mark)) for c in columns})


def sanitized_name(c: Column | str) -> Column:
    """A file name without folders and unsafe characters; ``upload.bin`` if nothing is left."""
    base = F.element_at(F.split(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"[/\\]"), -1)
    return F.coalesce(filled(F.regexp_replace(base, r"^[.\s]+|[\x00-\x1f<>:\"|?*]", "")), F.lit("upload.bin"))


def registered(new: DataFrame, sources: DataFrame, group: str = "notebook_id") -> DataFrame:
    """New files (id, notebook, path) as source rows: name, type, status ``new`` and the next places of their notebook."""
    last = sources.groupBy(group).agg(F.max("sort_order").alias("_last"))
    at = F.row_number().over(Window.partitionBy(group).orderBy("id"))
    rows = new.join(last, group, "left")
    return rows.select("id", group, basename("path").alias("filename"), F.col("path").alias("file_path"), file_type("path").alias("file_type"), F.lit("new").alias("status"), F.lit(True).alias("is_enabled"), (F.coalesce("_last", F.lit(0)) + at).cast("bigint").alias("sort_order"))


def with_language(documents: DataFrame, detect, text: str = "text", key: str = "doc_id", head: int = 1000) -> DataFrame:
    """(key, language) by a pluggable detector of the first characters; empty texts and failures are ``unknown``."""
    kind = dict(documents.dtypes)[key]

    def one(t: str | None) -> str:
        try:
            return (detect(t) if t and t.strip() else None) or "unknown"
        except Exception:  # noqa: BLE001 - any failure of a detector
            return "unknown"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(t) for t in batch.column(1).to_pylist()], pa.string())], [key, "language"])

    return documents.select(key, F.substring(text, 1, head)).mapInArrow(run, f"{key} {kind}, language string")


def discovered_agents(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests of ``*/manifest.json`` in a folder, in order of path; broken ones are skipped."""
    schema = "id string, name string, description string, version string, provider string, model string, requires array<string>"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{folder}/*/manifest.json").withColumn("path", F.input_file_name()).orderBy("path")


def agents(spark: SparkSession, folder: str) -> DataFrame:
    """The registry's agents, or those found in the folders where there is no registry or an empty one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/registry.json")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        listed = agent_registry(spark, f"{folder}/registry.json")
        if not listed.isEmpty():
            return listed
    return discovered_agents(spark, folder).drop("path")


def first_folder(candidates: list[str | None]) -> str | None:
    """The first of the candidates that is a folder; the last one named if none is."""
    named = [c for c in candidates if c]
    return next((c for c in named if os.path.isdir(c)), named[-1] if named else None)


def knowledge_files(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, path): files by their subfolder, dot files left out."""
    rows = binary_files(spark, folder).select("path")
    return rows.select(F.element_at(F.split("path", "/"), -2).alias("kind"), "path")
