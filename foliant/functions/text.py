"""Text helpers as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's ``str.split`` splits at; Java's ``\s`` is ASCII only.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: Column | str) -> Column:
    """White-space separated tokens; null gives none."""
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), f"[{SPACE}]+"), lambda x: x != "")


def word_count(c: Column | str) -> Column:
    """Number of white-space separated tokens, 0 for null."""
    return F.coalesce(F.regexp_count(col(c), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def strip(c: Column | str) -> Column:
    """Without white space at both ends, Unicode white space included."""
    return F.regexp_replace(col(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def squeezed(c: Column | str) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(col(c), f"[{SPACE}]+", ""))


def is_blank(c: Column | str) -> Column:
    """Null or nothing but white space."""
    return F.coalesce(~col(c).rlike(f"[^{SPACE}]"), F.lit(True))


#: What Python's ``str.splitlines`` splits at.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def lines(c: Column | str) -> Column:
    """Stripped non-blank lines of a text; null gives none."""
    split = F.split(F.coalesce(col(c), F.lit("")), LINE_END)
    return F.filter(F.transform(split, strip), lambda x: x != "")


def token_count(c: Column | str) -> Column:
    """Tokens by the word rule: 0 for blank text, else 1.3 per word rounded down, at least 1."""
    n = word_count(c)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n * F.lit(1.3)))).cast("bigint")


def basename(c: Column | str) -> Column:
    return F.element_at(F.split(F.coalesce(col(c), F.lit("")), "/"), -1)


def suffix(c: Column | str) -> Column:
    """Lower-case extension with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(basename(c), r".(\.[^.]+)$", 1))


def filled(c: Column | str) -> Column:
    """The value, or null where it is empty (truthiness of strings)."""
    return F.nullif(col(c), F.lit(""))


def citation_refs(c: Column | str) -> Column:
    """Numbers of the ``[N]`` references of an answer, in order; of any length that a decimal holds."""
    return F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("decimal(38,0)"))


def answer_segments(c: Column | str) -> Column:
    """An answer as a list of (kind, value): its texts and its ``[N]`` references, in order, without empty texts."""
    text = F.coalesce(col(c), F.lit(""))
    between = F.split(text, r"\[\d+\]")
    refs = F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1))
    part = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    both = F.transform(between, lambda t, i: F.array(part("text", t), part("ref", F.get(refs, i))))
    return F.filter(F.flatten(both), lambda x: x["value"].isNotNull() & ((x["kind"] == "ref") | (x["value"] != "")))


def listed(c: Column | str) -> Column:
    """The non-empty values of a comma-separated parameter."""
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), ","), lambda x: x != "")


def base_url(c: Column | str) -> Column:
    """An address without the slashes at its end."""
    return F.regexp_replace(strip(F.coalesce(col(c), F.lit(""))), "/+$", "")


def clamped(c: Column | str, low: int, high: int, default: int) -> Column:
    """A whole number between two bounds; what is no number gives the default."""
    number = col(c).try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(default)).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), F.signum(number) * F.floor(F.abs(number))))).cast("int")


def now_iso() -> Column:
    """The time of the query in ISO form, UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def new_id() -> Column:
    return F.uuid()


def chunk_key(doc: Column | str, index: Column | str) -> Column:
    return F.concat_ws(":", col(doc).cast("string"), col(index).cast("string"))
