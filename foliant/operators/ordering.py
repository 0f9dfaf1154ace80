"""Order-dependent operators that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def previous_row(df: DataFrame, key: str, order: str, columns: list[str], width: int = 1 << 16, prefix: str = "prev_") -> DataFrame:
    """``df`` with ``columns`` of the row before it by ``order`` (a unique non-negative number) among rows of equal ``key``.

    The same as ``lag`` over (partition by key order by order), but a key that
    holds a third of the table is cut into ranges of ``width`` numbers, each
    sorted on its own; only the last row of each range takes part in the second
    window. Rows with a null key or order have no predecessor and are dropped.
    """
    rows = df.filter(F.col(key).isNotNull() & F.col(order).isNotNull()).withColumn("_range", F.floor(F.col(order) / width))
    inside = Window.partitionBy(key, "_range").orderBy(order)
    whole = F.struct(F.lit(1).alias("_there"), *columns)
    last = rows.groupBy(key, "_range").agg(F.max_by(whole, order).alias("_last"))
    across = Window.partitionBy(key).orderBy("_range")
    before = last.select(key, "_range", F.lag("_last").over(across).alias("_before"))
    prior = F.coalesce("_prev", "_before")
    return (
        rows.withColumn("_prev", F.lag(whole).over(inside))
        .join(before, [key, "_range"])
        .select(*df.columns, *[prior[c].alias(prefix + c) for c in columns])
    )
