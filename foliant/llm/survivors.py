"""Best representative of each group of records of one file (problem 6).

Records belong together if their hashes are equal however written, or, where
one has no usable hash, if their texts are equal apart from white space and
case. Hash classes bridged by a text form one group; only the bridges go
through the iterative component search. Each group then gives its best record
and a surviving value for every field.

Field values follow currency reasoning: precedence between the values of a
field is learned from groups whose rows carry timestamps (value a is replaced
by value b), for every field. The learned steps form a graph; its cycles are
broken at their least supported steps, and each value's level is the longest
chain of steps that leads to it, so whatever replaces a value, directly or
through others, is above it. Of a group's values those with times are ordered
by them, the others by their level; the topologically latest survives. All
steps are aggregations with map-side combining on (group, field, value) and
joins on them, so no group is ever gathered and no pairs within it are made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import is_blank, squeezed, strip
from foliant.operators.ordering import previous_row
from foliant.session import cut

# Spellings that stand for "no value".
PLACEHOLDERS = ["", "-", "--", "?", "n/a", "na", "none", "null", "nil", "unknown", "undefined", "untitled", "untitled document", "no title", "tbd"]

#: Fields of the surviving record.
FIELDS = ("title", "authors", "year", "filename", "source", "size_bytes", "lang", "is_enabled", "is_indexed", "index_error")
#: Microseconds within which the values of one group and field are put in order together.
SPAN = 30 * 86_400_000_000


def clean_hash(c: Column) -> Column:
    """64 lower-case hexadecimal digits, or null for a missing, malformed or constant hash."""
    digits = F.regexp_replace(F.lower(strip(c)), r"^sha-?256\s*[:=\-]?\s*|^0x", "")
    return F.when(digits.rlike("^[0-9a-f]{64}$") & ~digits.rlike(r"^(.)\1{63}$"), digits)


def is_real(c: Column) -> Column:
    """Neither blank nor a placeholder."""
    return F.coalesce(~F.lower(strip(c)).isin(PLACEHOLDERS) & ~is_blank(c), F.lit(False))


def real_year(c: Column, last: int = 2100) -> Column:
    return F.coalesce(c.between(1450, last), F.lit(False))


def prepared(df: DataFrame) -> DataFrame:
    """One narrow row per record: keys, rank and the field values as strings."""
    present = set(df.columns)

    def get(name: str, kind: str) -> Column:
        return F.col(f"`{name}`").cast(kind) if name in present else F.lit(None).cast(kind)

    authors = F.filter(get("authors", "array<string>"), is_real)
    error = get("index_error", "string")
    values = {
        "title": F.when(is_real(get("title", "string")), strip(get("title", "string"))),
        "authors": F.when(F.size(authors) > 0, F.to_json(authors)),
        "year": F.when(real_year(get("year", "int")), get("year", "string")),
        "index_error": F.when(~is_blank(error), F.regexp_replace(error, r"\d+", "#")).otherwise("(none)"),
        "lang": F.when(is_real(get("lang", "string")), F.regexp_extract(F.lower(strip(get("lang", "string"))), r"^[a-z]+", 0)),
    }
    for name in FIELDS:
        values.setdefault(name, F.when(is_real(get(name, "string")), get(name, "string")))
    filled = sum((values[n].isNotNull().cast("int") for n in ("title", "authors", "year")), F.lit(0))
    squeezed_text = squeezed(get("text", "string"))
    text_key = F.when(F.length(squeezed_text) > 0, F.concat_ws("", F.hex(F.xxhash64(squeezed_text)), F.hex(F.xxhash64(F.lit(1), squeezed_text))))
    return df.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        clean_hash(get("file_hash", "string")).alias("h"),
        text_key.alias("t"),
        (~(F.coalesce(get("is_indexed", "boolean"), F.lit(False)) & is_blank(error))).alias("unusable"),
        (-filled).alias("unfilled"),
        get("indexed_at", "timestamp").alias("at"),
        F.struct(*[values[n].alias(n) for n in FIELDS]).alias("fields"),
    )


def _bridge_labels(edges: DataFrame, rounds: int = 40) -> DataFrame | None:
    """(h, label) for the hash classes that a text connects with others; None if there is no such text.

    Minimum labels over the hash-text links with pointer jumping, each round cut
    by a checkpoint, until nothing changes.
    """
    shared = edges.groupBy("t").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a < b").select("t")
    links = cut(edges.join(shared, "t", "left_semi"))
    if links.isEmpty():
        return None
    labels = cut(links.select("h").distinct().withColumn("label", F.col("h")))
    for _ in range(rounds):
        by_text = links.join(labels, "h").groupBy("t").agg(F.min("label").alias("label"))
        lower = links.join(by_text, "t").groupBy("h").agg(F.min("label").alias("label"))
        jump = lower.select(F.col("h").alias("label"), F.col("label").alias("further"))
        new = lower.join(jump, "label", "left").select("h", F.least("label", F.coalesce("further", "label")).alias("label"))
        new = cut(new)
        if new.join(labels, ["h", "label"], "left_anti").isEmpty():
            return new
        labels = new
    raise RuntimeError("component search did not settle; raise `rounds`")


def grouped(df: DataFrame, fields: bool = False) -> DataFrame:
    """``prepared(df)`` (with its ``fields`` if wanted) and the key ``g`` of each record's group; records without hash and text stay alone.

    The narrow rows are written once: texts are read and hashed a single time.
    """
    rows = cut(prepared(df) if fields else prepared(df).drop("fields"))
    loose = rows.filter(F.col("h").isNull() & F.col("t").isNotNull()).select("t").distinct()
    edges = rows.filter(F.col("h").isNotNull() & F.col("t").isNotNull()).select("h", "t").join(loose, "t", "left_semi").distinct()
    labels = _bridge_labels(edges)
    if labels is not None:
        edges = edges.join(labels, "h", "left").select("t", F.coalesce("label", "h").alias("h"))
    by_text = edges.groupBy("t").agg(F.min("h").alias("via"))
    rows = rows.join(by_text.withColumnRenamed("t", "tt"), F.col("h").isNull() & (F.col("t") == F.col("tt")), "left").drop("tt")
    if labels is not None:
        rows = rows.join(labels, "h", "left").withColumn("h", F.coalesce("label", "h")).drop("label")
    alone = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    g = F.coalesce("h", "via", F.when(F.col("t").isNotNull(), F.concat(F.lit("text:"), "t")), alone)
    return rows.withColumn("g", g).drop("h", "t", "via")


def best_records(df: DataFrame) -> DataFrame:
    """(g, group_doc_id, best_doc_id, records) of every group of two or more records.

    Best: indexed without error, then most of title, authors and year really
    filled, then the latest ``indexed_at`` (null last), then the smallest doc_id.

    * null hash and null or blank text: the record is in no group.
    * null doc_id: the row is no record. Rows repeated under one doc_id are one record.
    * ties: the smallest doc_id. Empty table: no groups. Unknown extra columns are ignored;
      absent optional columns count as null.
    """
    return _best(grouped(df))


def _best(rows: DataFrame) -> DataFrame:
    order = F.struct("unusable", "unfilled", F.col("at").isNull().alias("untimed"), (-F.unix_micros("at")).alias("age"), "doc_id")
    return (
        rows.groupBy("g")
        .agg(F.min("doc_id").alias("group_doc_id"), F.min(order).alias("best"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("records"))
        .filter(F.col("group_doc_id") < F.col("last"))
        .select("g", "group_doc_id", F.col("best.doc_id").alias("best_doc_id"), "records")
    )


def _values(rows: DataFrame) -> DataFrame:
    """(g, field, value, first, last, n): each distinct real value of each field in each group."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"fields.{n}").alias("value")) for n in FIELDS])
    return (
        rows.select("g", "at", F.explode(pairs).alias("p"))
        .filter(F.col("p.value").isNotNull())
        .groupBy("g", F.col("p.field").alias("field"), F.col("p.value").alias("value"))
        .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    )


def learn_precedence(values: DataFrame, support: int = 2) -> DataFrame:
    """(field, value, later, n): pairs of values of which the second followed the first in n groups, more often than the reverse.

    Of the values of a group that appeared at the same time the largest is followed.
    """
    timed = values.filter(F.col("first").isNotNull()).groupBy("g", "field", F.unix_micros("first").alias("at"))
    timed = timed.agg(F.max(F.struct("value", F.unix_micros("last").alias("last"))).alias("v")).select(F.struct("g", "field").alias("key"), "at", "v.value", "v.last")
    steps = (
        previous_row(timed.filter("at >= 0"), "key", "at", ["value", "last"], SPAN)
        .filter((F.col("prev_last") < F.col("at")) & (F.col("prev_value") != F.col("value")))
        .groupBy(F.col("key.field").alias("field"), F.col("prev_value").alias("value"), F.col("value").alias("later"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= support)
    )
    steps = cut(steps)
    back = steps.select("field", F.col("value").alias("later"), F.col("later").alias("value"), F.col("n").alias("against"))
    return steps.join(back, ["field", "value", "later"], "left").filter(F.col("n") > F.coalesce("against", F.lit(0))).select("field", "value", "later", "n")


def levels(steps: DataFrame) -> DataFrame:
    """(field, value, level): the longest chain of steps that leads to each value; later values are above.

    Values that nothing precedes are peeled off round by round. Where only cycles
    are left in a field, its least supported steps there are dropped.
    """
    spark = steps.sparkSession
    left = cut(steps)
    found = [spark.createDataFrame([], "field string, value string, level int")]
    passed = [spark.createDataFrame([], "field string, value string, level int")]
    level = 0
    while not left.isEmpty():
        heads = left.select("field", "value").distinct().join(left.select("field", F.col("later").alias("value")).distinct(), ["field", "value"], "left_anti")
        heads = cut(heads)
        # A field without heads has cycles only.
        stuck = left.join(heads.select("field").distinct(), "field", "left_anti")
        weakest = stuck.groupBy("field").agg(F.min("n").alias("n"))
        gone = left.join(heads, ["field", "value"], "left_semi")
        rest = left.join(heads, ["field", "value"], "left_anti").join(weakest, ["field", "n"], "left_anti")
        found.append(heads.withColumn("level", F.lit(level)))
        passed.append(cut(gone.select("field", F.col("later").alias("value"), F.lit(level + 1).alias("level")).distinct()))
        left = cut(rest)
        level += 1
    every = reduce(DataFrame.unionByName, found + passed)
    return every.groupBy("field", "value").agg(F.max("level").alias("level"))


def latest_values(values: DataFrame, order: DataFrame) -> DataFrame:
    """(g, field, value): the topologically latest value of each field of each group.

    Of values with times only the last seen takes part, beside those without. The highest level wins; a timed
    value of which no step is known stands above all others. Then: timed, most frequent, largest value.
    """
    last = values.groupBy("g", "field").agg(F.max("last").alias("top"))
    rows = values.join(last, ["g", "field"]).filter(F.col("last").isNull() | (F.col("last") == F.col("top"))).join(order, ["field", "value"], "left")
    timed = F.col("last").isNotNull()
    height = F.coalesce("level", F.when(timed, F.lit(2147483647)).otherwise(F.lit(-1)))
    return rows.groupBy("g", "field").agg(F.max(F.struct(height.alias("height"), timed.alias("timed"), "n", "value")).alias("x")).select("g", "field", "x.value")


def surviving_records(df: DataFrame) -> DataFrame:
    """Group ids, best record and one surviving value per field (strings; null where no record has a real one).

    * a field's value is its topologically latest one (``latest_values``), whichever record it stands in.
    * cyclic precedence is broken where it has least support; values never seen to follow each other are settled by the stated ties.
    * nulls, empty tables, repeated rows and absent columns: as in ``best_records``.
    """
    rows = grouped(df, fields=True)
    groups = cut(_best(rows))
    # Records that are alone in their group have no rival; only the others are taken apart into values.
    values = cut(_values(rows.join(groups.select("g"), "g", "left_semi")))
    latest = latest_values(values, levels(learn_precedence(values)))
    survivors = latest.groupBy("g").agg(*[F.max(F.when(F.col("field") == name, F.col("value"))).alias(name) for name in FIELDS])
    return groups.join(survivors, "g", "left").drop("g")
