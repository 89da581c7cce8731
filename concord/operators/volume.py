"""Row-count comparison, of whole sides and by dimension."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.normalize import Tolerance
from concord.functions.values import as_text, as_type, family, shared_type
from concord.operators.rows import Pair, require
from concord.sources.sides import Derived, derive

ALL_ROWS = "all rows"


def compare_volume(source: DataFrame, target: DataFrame, tolerance: Tolerance | None = None) -> DataFrame:
    """One row with both counts, their difference and its verdict.

    A percentage bound wins over an absolute one; without a bound any
    difference fails.
    """
    counts = (
        source.select(F.lit(1).alias("s"), F.lit(0).alias("t"))
        .unionAll(target.select(F.lit(0).alias("s"), F.lit(1).alias("t")))
        .agg(
            F.coalesce(F.sum("s"), F.lit(0)).alias("source_rows"),
            F.coalesce(F.sum("t"), F.lit(0)).alias("target_rows"),
        )
    )
    failed, bound = _bound(tolerance)
    return _judged(counts, failed, F.lit(bound))


def _bound(tolerance: Tolerance | None) -> tuple[Column, str]:
    """Whether a difference is beyond a tolerance, and the tolerance in words."""
    tolerance = tolerance or Tolerance()
    if tolerance.percentage is not None:
        return F.abs("difference_rate") > tolerance.percentage, f"{tolerance.percentage:.4f}% tolerance"
    if tolerance.absolute is not None:
        return F.abs("difference") > tolerance.absolute, f"{tolerance.absolute:g} row absolute tolerance"
    return F.col("difference") != 0, "exact equality (no tolerance configured)"


def _judged(counts: DataFrame, failed: Column, bound: Column) -> DataFrame:
    difference = F.col("target_rows") - F.col("source_rows")
    rate = F.when(F.col("source_rows") == 0, F.lit(0.0)).otherwise(
        F.col("difference").cast("double") / F.col("source_rows") * 100
    )
    outcome = F.when(failed, "FAIL").otherwise("PASS")
    message = F.concat(
        F.lit("Row count: source "), F.format_number("source_rows", 0),
        F.lit(", target "), F.format_number("target_rows", 0),
        F.lit(", difference "), F.format_number("difference", 0),
        F.format_string(" (%.4f%%)", "difference_rate"),
        F.lit(", evaluated against "), bound, F.lit(": "), outcome, F.lit("."),
    )
    severity = F.when(F.col("difference") == 0, "Pass").when(failed, "Failure").otherwise("Informational")
    return (
        counts.withColumn("difference", difference)
        .withColumn("difference_rate", rate)
        .withColumn("severity", severity)
        .withColumn("message", message)
    )


def _text(c: Column, own: T.DataType, other: T.DataType) -> Column:
    """A value as text, numbers of two types in the type that holds both."""
    if family(own) != family(other):
        return as_text(c, own)
    common = shared_type(own, other)
    return as_text(as_type(c, own, common), common)


def volume_by_dimension(
    source: DataFrame,
    target: DataFrame,
    dimensions: Sequence[Pair | Derived | tuple[str, str]],
    tolerance: Tolerance | None = None,
    tolerances: Mapping[str, Tolerance] | None = None,
) -> DataFrame:
    """Row counts of both sides for every value of every dimension, and of all rows.

    A dimension is a pair of columns, say that by which files are partitioned,
    or a derived one, say the month of a date; it is named as on the source. Rows:
    ``dimension`` (``all rows`` for the whole sides), ``dimension_value`` as
    text, ``category`` and the columns of ``compare_volume``. A value that one side lacks
    is missing from it and fails whatever the tolerance. ``tolerances`` go by
    dimension and replace ``tolerance`` there. NULL is a value like any other.
    Empty sides give the row of all rows alone.

    Both sides are tagged and counted in all dimensions by one pass of grouping
    sets, which fold before their one shuffle, so a value that most rows have
    costs no more than others. Only the columns of the dimensions are read;
    if all are partition columns of the files, these are not opened but for their row counts.
    """
    source, target, pairs = derive(source, target, dimensions)
    require(source, [p.source for p in pairs], "source")
    require(target, [p.target for p in pairs], "target")
    names = [f"d{i}" for i in range(len(pairs))]
    tagged = []
    types = [(source.schema[p.source].dataType, target.schema[p.target].dataType) for p in pairs]
    for df, columns, side, tags in ((source, [p.source for p in pairs], 0, (1, 0)), (target, [p.target for p in pairs], 1, (0, 1))):
        texts = [_text(df[c], own[side], own[1 - side]).alias(n) for n, c, own in zip(names, columns, types)]
        tagged.append(df.select(*texts, *[F.lit(x).cast("bigint").alias(n) for n, x in zip("st", tags)]))
    # One row that counts for nothing, so that empty sides have a total.
    none = source.sparkSession.range(1).select(*[F.lit(None).cast("string").alias(n) for n in names], *[F.lit(0).cast("bigint").alias(n) for n in "st"])
    rows = tagged[0].unionByName(tagged[1]).unionByName(none)
    sums = [F.sum("s").alias("source_rows"), F.sum("t").alias("target_rows")]
    if names:
        sets = [[F.col(n)] for n in names] + [[]]
        counted = rows.groupingSets(sets, *[F.col(n) for n in names]).agg(F.grouping_id().alias("set"), *sums)
    else:
        counted = rows.agg(F.lit(0).cast("bigint").alias("set"), *sums)
    whole = (1 << len(names)) - 1  # a bit is set for each column that is not grouped by, the first one highest
    named = dimension_value = F.lit(None).cast("string")
    for i, p in enumerate(pairs):
        mine = F.col("set") == whole - (1 << (len(names) - 1 - i))
        named = F.when(mine, F.lit(p.source)).otherwise(named)
        dimension_value = F.when(mine, F.col(names[i])).otherwise(dimension_value)
    total = F.col("set") == whole
    counts = counted.where(total | (F.col("source_rows") + F.col("target_rows") > 0)).select(
        F.when(total, ALL_ROWS).otherwise(named).alias("dimension"), F.when(~total, dimension_value).alias("dimension_value"),
        total.alias("total"), "source_rows", "target_rows",
    )
    failed, words = _bound(tolerance)
    bound = F.lit(words)
    for name, own in (tolerances or {}).items():
        if name not in (ALL_ROWS, *(p.source for p in pairs)):
            raise ValueError(f"tolerance for {name!r}, which is no dimension")
        here = F.col("dimension") == name
        failed, bound = F.when(here, _bound(own)[0]).otherwise(failed), F.when(here, F.lit(_bound(own)[1])).otherwise(bound)
    lacking = ~F.col("total") & ((F.col("source_rows") == 0) | (F.col("target_rows") == 0))
    category = (
        F.when(lacking & (F.col("source_rows") == 0), "missing-from-source")
        .when(lacking, "missing-from-target")
        .when(F.col("difference") == 0, "matching")
        .otherwise("differing-counts")
    )
    judged = _judged(counts, lacking | failed, bound).withColumn("category", category)
    return judged.select("dimension", "dimension_value", "category", *[c for c in judged.columns if c not in ("dimension", "dimension_value", "category", "total")])
