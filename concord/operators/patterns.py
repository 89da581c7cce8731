"""Frequent shapes of text values, counted exactly."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators.profile import columns_of, long_values

# What a run of letters or digits shows as, in this order.
SHAPES = ((r"\p{Lu}", "A"), (r"\p{L}", "a"), (r"\p{N}", "9"), (r"[\t\n\x0B\f\r ]", " "))
SLACK = 8  # counters for each shape that can reach the share


def shape(c: Column, runs: bool = True) -> Column:
    """The value with capitals as A, other letters as a, digits as 9; a run of one of them is shown once, with a plus."""
    # Marks of the private area stand in until all classes are told apart.
    for i, (kind, _) in enumerate(SHAPES):
        c = F.regexp_replace(c, kind, chr(0xE000 + i))
    marks = "".join(chr(0xE000 + i) for i in range(len(SHAPES)))
    if runs:
        c = F.regexp_replace(c, f"([{marks}])\\1+", "$1+")
    return F.translate(c, marks, "".join(s for _, s in SHAPES))


def frequent_patterns(df: DataFrame, share: float = 0.01, columns: Sequence[str] | None = None, runs: bool = True) -> DataFrame:
    """(column_name, pattern, value_count, percentage): every shape with at least this share of a column's values.

    Counts are exact and no shape is missed. The first pass keeps a bounded
    number of counters for each column, which fold on the map side; a shape that
    reaches the share always holds one of them. The second counts the few
    candidates, also on the map side. So neither moves the rare shapes, of which
    there may be as many as values. NULLs are no values; an empty text has an
    empty shape; columns without values, or tables without text columns, give no
    rows.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    cells = long_values(df, columns_of(df, ["text"], columns), "string").where(F.col("value").isNotNull())
    told = cells.select("column_name", shape(F.col("value"), runs).alias("pattern"))
    most = 1 << (ceil(SLACK / share) - 1).bit_length()
    tops = told.groupBy("column_name").agg(
        F.call_function("approx_top_k", F.col("pattern"), F.lit(most), F.lit(most)).alias("top"), F.count(F.lit(1)).alias("populated")
    )
    # Estimates are never too low, so that what stays below the share can go; at most ``most`` shapes a column.
    wanted = tops.select("column_name", "populated", F.explode("top").alias("t")).where(F.col("t.count") >= F.col("populated") * share)
    wanted = wanted.select("column_name", "populated", F.col("t.item").alias("pattern"))
    counts = told.join(F.broadcast(wanted), ["column_name", "pattern"]).groupBy("column_name", "populated", "pattern").agg(F.count(F.lit(1)).alias("value_count"))
    enough = F.col("value_count") >= F.col("populated") * share
    percentage = F.col("value_count").cast("double") / F.col("populated") * 100
    return counts.where(enough).select("column_name", "pattern", "value_count", percentage.alias("percentage"))
