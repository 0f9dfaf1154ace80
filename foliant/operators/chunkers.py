"""Block builder and the five chunking strategies, DataFrame to DataFrame.

Everything is a projection plus windows over the document, which share one
shuffle by document. A configuration column (size, overlap and so on) may be a
number or a column, so documents of different notebooks chunk in one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import SPACE, lines, strip, token_count, words

# A line that is a header.
HEADER = rf"^(#{{1,6}}[{SPACE}]+.+|\p{{Nd}}+(?:\.\p{{Nd}}+)*[{SPACE}]+.+)$"
# Header patterns of each document type, level by level; first match counts.
LEVELS = {
    "gost": [(1, r"^\d+\.\s+[А-ЯA-Z\w]"), (2, r"^\d+\.\d+\.\s+"), (3, r"^\d+\.\d+\.\d+\.\s+")],
    "technical_manual": [(1, r"^(?i)(?:Глава|Chapter|РАЗДЕЛ|SECTION)\s+\d+"), (2, r"^\d+\.\d+\s+[А-ЯA-Z\w]"), (3, r"^\d+\.\d+\.\d+\s+")],
    "api_docs": [(1, r"^#{1,2}\s+"), (2, r"^#{3}\s+"), (3, r"^#{4,}\s+")],
    "markdown": [(1, r"^#\s+"), (2, r"^##\s+"), (3, r"^###\s+"), (4, r"^#{4,}\s+")],
}
DEFAULT_SEPARATOR = "---chunk---"


def number(value: int | str | Column) -> Column:
    return F.lit(value) if isinstance(value, int) else F.col(value) if isinstance(value, str) else value


def blocks(documents: DataFrame, doc: str = "doc_id", text: str = "text", keep_marks: bool = False) -> DataFrame:
    """(doc, pos, text, chunk_type, section_header, other columns): one row per non-blank line of plain text.

    A header line loses its ``#`` marks (unless ``keep_marks``) and heads the
    lines after it. Null and blank texts give no rows.
    """
    kept = [c for c in documents.columns if c not in (text, "pos", "line", "chunk_type", "section_header")]
    rows = documents.select(*kept, F.posexplode(lines(text)).alias("pos", "line"))
    is_header = F.col("line").rlike(HEADER)
    clean = F.col("line") if keep_marks else F.regexp_replace("line", rf"^#{{1,6}}[{SPACE}]*", "")
    over = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_header", F.when(is_header, clean))
    return rows.select(
        *kept,
        F.col("pos").cast("bigint").alias("pos"),
        F.coalesce("_header", "line").alias("text"),
        F.when(F.col("_header").isNotNull(), "header").otherwise("text").alias("chunk_type"),
        F.last("_header", ignorenulls=True).over(over).alias("section_header"),
    )


def carried(*values: int | str | Column) -> list[Column]:
    """Aggregates that keep configuration columns beside a document's text."""
    return [F.max(v).alias(v) for v in dict.fromkeys(v for v in values if isinstance(v, str))]


def token_windows(text: Column, size: Column, least: Column) -> Column:
    """Windows of ``size`` tokens; one that is short in tokens and not the last doubles, its successor doesn't move."""
    tokens = words(text)
    step = F.greatest(F.lit(1), size).cast("int")
    n = F.size(tokens)
    offsets = F.sequence(F.lit(0), n - 1, step)

    def window(o: Column) -> Column:
        part = F.slice(tokens, o + 1, step)
        short = F.greatest(F.lit(1), F.floor(F.size(part) * F.lit(1.3))) < least
        return F.array_join(F.when(short & (o + step < n), F.slice(tokens, o + 1, step * 2)).otherwise(part), " ")

    return F.when(n > 0, F.transform(offsets, window)).otherwise(F.array().cast("array<string>"))


def packed_table(text: Column, size: Column) -> Column:
    """A table's rows packed into pieces of at most ``size`` tokens, the first two lines repeated in each."""
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]"), lambda x: x.rlike(f"[^{SPACE}]"))
    head, body = F.slice(raw, 1, 2), F.slice(raw, 3, F.greatest(F.size(raw) - 2, F.lit(0)))

    def count(rows: Column) -> Column:
        return token_count(F.array_join(F.concat(head, rows), "\n"))

    start = F.struct(F.array().cast("array<array<string>>").alias("out"), F.array().cast("array<string>").alias("rows"))

    def add(acc: Column, row: Column) -> Column:
        full = (count(F.array_append(acc["rows"], row)) > size) & (F.size(acc["rows"]) > 0)
        return F.struct(
            F.when(full, F.array_append(acc["out"], acc["rows"])).otherwise(acc["out"]).alias("out"),
            F.when(full, F.array(row)).otherwise(F.array_append(acc["rows"], row)).alias("rows"),
        )

    def finish(acc: Column) -> Column:
        return F.transform(F.array_append(acc["out"], acc["rows"]), lambda rows: F.array_join(F.concat(head, rows), "\n"))

    return F.when(F.size(raw) <= 2, F.array(text)).otherwise(F.aggregate(body, start, add, finish))


def general(rows: DataFrame, size: int | str = 200, overlap: int | str = 20, least: int | str = 50, doc: str = "doc_id") -> DataFrame:
    """Fixed windows of each block; a header block heads the next block's text. Adds prev_chunk_tail and next_chunk_head.

    Of consecutive headers the last counts; one without a body is dropped.
    """
    order = Window.partitionBy(doc).orderBy("pos")
    body = rows.filter((F.col("chunk_type") == "header") | F.col("text").rlike(f"[^{SPACE}]"))
    before = F.when(F.lag("chunk_type").over(order) == "header", F.lag("text").over(order))
    body = body.withColumn("_before", before).filter(F.col("chunk_type") != "header")
    text = F.concat_ws("\n", "_before", strip("text"))
    pieces = F.when(F.col("chunk_type") == "table", packed_table(text, number(size))).otherwise(token_windows(text, number(size), number(least)))
    chunks = body.select(*[c for c in body.columns if c not in ("_before", "text", "section_header")], F.coalesce("_before", "section_header").alias("section_header"), F.posexplode(pieces).alias("_sub", "chunk_text"))
    at = Window.partitionBy(doc).orderBy("pos", "_sub")
    near = F.greatest(F.lit(0), number(overlap)).cast("int")
    last, following = words(F.lag("chunk_text").over(at)), words(F.lead("chunk_text").over(at))
    tail = F.slice(last, F.greatest(F.lit(1), F.size(last) - near + 1), near)
    return (
        chunks.withColumns(
            {
                "chunk_index": F.row_number().over(at).cast("bigint") - 1,
                "prev_chunk_tail": F.when((near > 0) & F.lag("pos").over(at).isNotNull(), F.array_join(tail, " ")),
                "next_chunk_head": F.when((near > 0) & F.lead("pos").over(at).isNotNull(), F.array_join(F.slice(following, 1, near), " ")),
            }
        ).drop("_sub")
    )


def context_enrichment(rows: DataFrame, size: int | str = 200, overlap: int | str = 20, least: int | str = 50, window: int | str = 128, doc: str = "doc_id") -> DataFrame:
    """``general`` with ``embedding_text``: the chunk between its neighbours' nearest characters; null without neighbours."""
    chunks = general(rows, size, overlap, least, doc)
    at = Window.partitionBy(doc).orderBy("chunk_index")
    w = F.greatest(F.lit(0), number(window)).cast("int")
    before = F.when(w > 0, F.lag("chunk_text").over(at))
    before = before.substr(F.greatest(F.lit(1), F.char_length(before) - w + 1), w)
    after = F.when(w > 0, F.lead("chunk_text").over(at)).substr(F.lit(1), w)
    parts = F.filter(F.array(before, F.col("chunk_text"), after), lambda x: x.isNotNull() & (x != ""))
    return chunks.withColumn("embedding_text", F.when(F.size(parts) > 1, F.array_join(parts, " ")))


def header_level(text: Column, doc_type: str | Column = "technical_manual") -> Column:
    """Level of a header by the patterns of its document type (unknown types count as technical manuals), null if none fits."""
    if isinstance(doc_type, Column):
        return reduce(lambda rest, kind: F.when(doc_type == kind, header_level(text, kind)).otherwise(rest), LEVELS, header_level(text))
    rules = LEVELS.get(doc_type, LEVELS["technical_manual"])
    return reduce(lambda rest, rule: F.when(text.rlike(rule[1]), F.lit(rule[0])).otherwise(rest), reversed(rules), F.lit(None).cast("int"))


def hierarchy(rows: DataFrame, doc_type: str | Column = "technical_manual", size: int | str = 200, least: int | str = 50, doc: str = "doc_id") -> DataFrame:
    """Sections between recognised headers, prefixed with their breadcrumb; sections over ``size`` tokens in windows.

    A section's page is that of its first block (null if the blocks have no ``page_number``).
    """
    order = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.when(F.col("chunk_type") == "header", header_level(F.col("text"), doc_type))
    body = rows.withColumn("_level", level).withColumn("_section", F.count("_level").over(order))
    names, positions = [], []
    for k in (1, 2, 3, 4):
        here = F.col("_level") == k
        body = body.withColumn(f"_text{k}", F.last(F.when(here, F.regexp_replace("text", r"^#{1,6}\s*", "")), ignorenulls=True).over(order))
        body = body.withColumn(f"_pos{k}", F.coalesce(F.last(F.when(here, F.col("pos")), ignorenulls=True).over(order), F.lit(-1)))
        # A level counts only while no higher level has begun since.
        names.append(reduce(lambda c, p, k=k: F.when(F.col(f"_pos{k}") > F.col(p), c), positions, F.col(f"_text{k}")))
        positions.append(f"_pos{k}")
    crumb = F.concat_ws(" > ", *[F.nullif(n, F.lit("")) for n in names])
    body = body.withColumn("_crumb", crumb).filter(F.col("_level").isNull())
    sections = body.groupBy(doc, "_section").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("_all"),
        F.min(F.struct("pos", "_crumb", (F.col("page_number") if "page_number" in rows.columns else F.lit(None)).cast("int").alias("_page"))).alias("_first"),
        *carried(size, least),
    )
    head = F.nullif(F.col("_first._crumb"), F.lit(""))
    fits = token_count("_all") <= F.greatest(F.lit(1), number(size))
    pieces = F.when(fits, F.array("_all")).otherwise(token_windows(F.col("_all"), number(size), number(least)))
    chunks = sections.select(doc, "_section", head.alias("section_header"), F.col("_first._page").alias("page_number"), F.posexplode(pieces).alias("_sub", "_text"))
    at = Window.partitionBy(doc).orderBy("_section", "_sub")
    # With a breadcrumb the whole is stripped; without one the section stays as it is.
    text = F.when(F.col("section_header").isNotNull(), strip(F.concat_ws("\n\n", "section_header", "_text"))).otherwise(F.col("_text"))
    return chunks.select(doc, (F.row_number().over(at).cast("bigint") - 1).alias("chunk_index"), "section_header", "page_number", text.alias("chunk_text"))


def whole_text(rows: DataFrame, doc: str = "doc_id", *config: int | str) -> DataFrame:
    """(doc, text, configuration columns): the non-header blocks of a document joined by line breaks."""
    body = rows.filter((F.col("chunk_type") != "header") & F.col("text").rlike(f"[^{SPACE}]"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "text")))
    return body.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"), *carried(*config))


def parent_child(rows: DataFrame, parent: int | str = 800, child: int | str = 96, doc: str = "doc_id") -> DataFrame:
    """Small children for embedding, each carrying the whole text of its parent window."""
    whole = whole_text(rows, doc, parent, child)
    parents = whole.select("*", F.posexplode(token_windows(F.col("text"), number(parent), F.lit(0))).alias("_p", "chunk_text"))
    children = parents.select("*", F.posexplode(token_windows(F.col("chunk_text"), number(child), F.lit(0))).alias("_c", "embedding_text"))
    at = Window.partitionBy(doc).orderBy("_p", "_c")
    return children.select(
        doc,
        (F.row_number().over(at).cast("bigint") - 1).alias("chunk_index"),
        "chunk_text",
        "embedding_text",
        F.concat(F.lit("Блок "), (F.col("_p") + 1).cast("string")).alias("section_header"),
        F.concat(F.col(doc).cast("string"), F.lit(":pcr_parent:"), F.col("_p").cast("string")).alias("parent_chunk_id"),
    )


def by_symbol(rows: DataFrame, separator: str | Column = DEFAULT_SEPARATOR, doc: str = "doc_id") -> DataFrame:
    """Pieces between a literal separator (the default one if empty), stripped, without empty ones; a Column names one per row."""
    config = () if isinstance(separator, str) else ("symbol_separator",)
    sign = F.lit(separator or DEFAULT_SEPARATOR) if isinstance(separator, str) else F.coalesce(F.nullif(separator, F.lit("")), F.lit(DEFAULT_SEPARATOR))
    quoted = F.concat(F.lit("\\Q"), F.replace(sign, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pieces = F.filter(F.transform(F.split("text", quoted), strip), lambda x: x != "")
    return whole_text(rows, doc, *config).select(doc, F.posexplode(pieces).alias("_i", "chunk_text")).select(doc, F.col("_i").cast("bigint").alias("chunk_index"), "chunk_text")


STRATEGIES = {"general": general, "context_enrichment": context_enrichment, "hierarchy": hierarchy, "pcr": parent_child, "symbol": by_symbol}


def chunker(name: str | None):
    """The strategy of a name; unknown names mean general."""
    return STRATEGIES.get((name or "").strip().lower(), general)


# The settings of a notebook that has none.
DEFAULTS = {
    "chunking_method": "general", "doc_type": "technical_manual", "chunk_size": 200, "chunk_overlap": 20, "min_chunk_size": 50,
    "context_window": 128, "parent_chunk_size": 800, "child_chunk_size": 96, "symbol_separator": DEFAULT_SEPARATOR,
}


def chunk_by_settings(documents: DataFrame, settings: DataFrame, doc: str = "doc_id", notebook: str = "source") -> DataFrame:
    """(doc, chunk_index, chunk_text, section_header, embedding_text, method): every document by its notebook's settings.

    One branch per kind of method; unknown methods and notebooks without
    settings are general. Of repeated settings the smallest values hold.
    """
    per = settings.groupBy("notebook_id").agg(*[F.min(c).alias(c) for c in DEFAULTS])
    joined = documents.select(doc, "text", F.col(notebook).alias("notebook_id")).join(per, "notebook_id", "left").fillna(DEFAULTS)
    rows = blocks(joined.drop("notebook_id"), doc)
    method = F.lower(strip("chunking_method"))
    known = [m for m in STRATEGIES if m not in ("general", "context_enrichment")]
    windows = context_enrichment(rows.filter(~method.isin(known)), "chunk_size", "chunk_overlap", "min_chunk_size", "context_window", doc)
    enriched = method == "context_enrichment"
    windows = windows.withColumns({"embedding_text": F.when(enriched, F.col("embedding_text")), "method": F.when(enriched, "context_enrichment").otherwise("general")})
    parts = [
        (None, windows),
        ("pcr", parent_child(rows.filter(method == "pcr"), "parent_chunk_size", "child_chunk_size", doc)),
        ("symbol", by_symbol(rows.filter(method == "symbol"), F.col("symbol_separator"), doc)),
        ("hierarchy", hierarchy(rows.filter(method == "hierarchy"), F.col("doc_type"), "chunk_size", "min_chunk_size", doc)),
    ]
    keep = [doc, "chunk_index", "chunk_text", "section_header", "embedding_text", "method"]
    shaped = []
    for name, df in parts:
        absent = {c: F.lit(None).cast("string") for c in ("section_header", "embedding_text") if c not in df.columns}
        shaped.append(df.withColumns(absent | ({"method": F.lit(name)} if name else {})).select(*keep))
    return reduce(DataFrame.unionByName, shaped)
