"""Column sketches that merge: distinct counts, overlaps, quantiles and the distance of two distributions.

A sketch of a column is a few kilobytes, whatever its rows. Sketches are made by
part of a table, kept, and merged; a later run reads only the parts that it has
no sketch of.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.values import as_text, family, number_text
from concord.operators.rows import require

LOG_ENTRIES = 14  # a theta sketch keeps 2^14 hashes, 128 KB at most
KLL_SIZE = 2048
SIGMAS = 3  # of a distinct count's bound
STORE_FIELDS = "part string, column_name string, row_count bigint, present bigint, theta binary, kll binary"


def distinct_error(log_entries: int = LOG_ENTRIES) -> float:
    """Relative error that a distinct count stays within, three standard errors; counts below 2^log_entries are exact."""
    return SIGMAS / (1 << log_entries) ** 0.5


def rank_error(size: int = KLL_SIZE) -> float:
    """Error of a rank, as a share of the values, that a quantile sketch of this size keeps in 99 of 100 cases."""
    return 2.296 / size**0.9723


def _value(df: DataFrame, column: str) -> Column:
    """Text of a value, never empty, because sketches pass over empty texts."""
    dtype = df.schema[column].dataType
    return F.concat(F.lit("="), number_text(df[column], dtype) if family(dtype) == "number" else as_text(df[column], dtype))


def sketch_columns(df: DataFrame, columns: Sequence[str] | None = None, part: str | None = None) -> DataFrame:
    """(part, column_name, row_count, present, theta, kll), one row for each value of ``part`` and column.

    One pass; sketches fold on the map side, so that only they move. Numbers
    have a quantile sketch too, as doubles and without NaN, other columns NULL.
    Equal numbers of different types are one value. NULLs count as rows only. A
    NULL part is a part of its own; without ``part`` there is one, and an empty
    table gives empty sketches.
    """
    chosen = [c for c in (columns or df.columns) if c != part]
    require(df, [*chosen, *([part] if part else [])], "given")
    folds = [F.count(F.lit(1)).alias("row_count")]
    for i, c in enumerate(chosen):
        number = family(df.schema[c].dataType) == "number"
        kll = F.kll_sketch_agg_double(df[c].cast("double"), F.lit(KLL_SIZE)) if number else F.first(F.lit(None).cast("binary"))
        folds += [F.count(df[c]).alias(f"n{i}"), F.theta_sketch_agg(_value(df, c), LOG_ENTRIES).alias(f"t{i}"), kll.alias(f"k{i}")]
    name = as_text(df[part], df.schema[part].dataType) if part else F.lit("")
    grouped = df.groupBy(name.alias("part")).agg(*folds) if part else df.agg(*folds).withColumn("part", F.lit(""))
    cells = [
        F.struct(F.lit(c).alias("column_name"), "row_count", F.col(f"n{i}").alias("present"), F.col(f"t{i}").alias("theta"), F.col(f"k{i}").alias("kll"))
        for i, c in enumerate(chosen)
    ]
    return grouped.select("part", F.inline(F.array(*cells)))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """(column_name, row_count, present, theta, kll) of all parts together, without their rows."""
    return sketches.groupBy("column_name").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("present").alias("present"),
        F.theta_union_agg("theta", LOG_ENTRIES).alias("theta"),
        F.when(F.count("kll") > 0, F.kll_merge_agg_double("kll", F.lit(KLL_SIZE))).alias("kll"),  # NULL where there are no numbers
    )


def stored_sketches(spark: SparkSession, root: str) -> DataFrame:
    """The kept sketches of a table, newest of each part."""
    try:
        kept = spark.read.schema(f"{STORE_FIELDS}, made bigint").parquet(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        kept = spark.createDataFrame([], f"{STORE_FIELDS}, made bigint")
    newest = F.max_by(F.struct("row_count", "present", "theta", "kll"), "made").alias("s")
    return kept.groupBy("part", "column_name").agg(newest).select("part", "column_name", "s.*")


def update_sketches(df: DataFrame, root: str, part: str, columns: Sequence[str] | None = None, again: Sequence[str | None] = ()) -> list[str | None]:
    """Sketch the parts that the store at ``root`` does not have, and those of ``again``; returns their names.

    Which parts there are is read from the part column alone; the others are
    left out by a filter on it, which reaches the scan. A part with a sketch is
    taken as unchanged. Parts are counted in days or regions: their names pass
    through the driver. A call that breaks off leaves the store as it was.
    """
    spark = df.sparkSession
    require(df, [part], "given")
    name = as_text(df[part], df.schema[part].dataType)
    known = {r.part for r in stored_sketches(spark, root).select("part").distinct().collect()} - set(again)
    there = df.select(df[part].alias("value"), name.alias("part")).distinct().collect()
    wanted = [r for r in there if r.part not in known]
    if wanted:
        some = [r.value for r in wanted if r.value is not None]
        test = df[part].isin(some) if some else F.lit(False)
        test = test | df[part].isNull() if len(some) < len(wanted) else test
        made = sketch_columns(df.where(test), columns, part)
        made.withColumn("made", F.unix_micros(F.current_timestamp())).coalesce(1).write.mode("append").parquet(root)
    return [r.part for r in wanted]


def distinct_estimates(sketches: DataFrame) -> DataFrame:
    """(column_name, distinct_estimate, low, high) of merged sketches; exact below 2^14 values."""
    n = F.theta_sketch_estimate("theta")
    spread = F.when(n < (1 << LOG_ENTRIES), 0.0).otherwise(n * distinct_error())
    return sketches.select("column_name", n.alias("distinct_estimate"), (n - spread).alias("low"), (n + spread).alias("high"))


def distinct_overlap(source: DataFrame, target: DataFrame) -> DataFrame:
    """How many values the sides share, from merged sketches of columns with one name.

    (column_name, source_distinct, target_distinct, shared, only_source,
    only_target, similarity, error): the error of each count is ``error``, three
    standard errors of the union. Two columns without values have a similarity
    of one.
    """
    both = source.select("column_name", F.col("theta").alias("s")).join(target.select("column_name", F.col("theta").alias("t")), "column_name")
    n = lambda sketch: F.theta_sketch_estimate(sketch)
    union, shared = n(F.theta_union("s", "t", LOG_ENTRIES)), n(F.theta_intersection("s", "t"))
    return both.select(
        "column_name",
        n("s").alias("source_distinct"),
        n("t").alias("target_distinct"),
        shared.alias("shared"),
        n(F.theta_difference("s", "t")).alias("only_source"),
        n(F.theta_difference("t", "s")).alias("only_target"),
        F.when(union > 0, shared / union).otherwise(1.0).alias("similarity"),
        F.when(union < (1 << LOG_ENTRIES), 0.0).otherwise(union * distinct_error()).alias("error"),
    )


def quantiles(sketches: DataFrame, ranks: Sequence[float]) -> DataFrame:
    """(column_name, rank, value, rank_error) from merged sketches; the true rank of a value is within the error.

    Columns without numbers give no rows.
    """
    there = sketches.where(F.col("kll").isNotNull() & (F.kll_sketch_get_n_double("kll") > 0))
    asked = F.array(*[F.lit(float(r)) for r in ranks])
    values = F.arrays_zip(asked.alias("rank"), F.kll_sketch_get_quantile_double("kll", asked).alias("value"))
    return there.select("column_name", F.inline(values)).toDF("column_name", "rank", "value").withColumn("rank_error", F.lit(rank_error()))


def distribution_distance(source: DataFrame, target: DataFrame, steps: int = 400) -> DataFrame:
    """(column_name, distance, error): the largest gap between the sides' cumulative shares, from merged sketches.

    Shares are read off ``steps`` quantiles of each side, at the quantiles of
    both. The true distance is from ``distance - error`` to ``distance + error``;
    the error is that of both sketches and of the steps between quantiles. A
    column that has values on one side only is at a distance of one.
    """
    places = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    named = lambda df, c: df.where(F.col("kll").isNotNull()).select("column_name", F.col("kll").alias(c))
    both = named(source, "s").join(named(target, "t"), "column_name")
    n, m = F.kll_sketch_get_n_double("s"), F.kll_sketch_get_n_double("t")
    full = both.where((n > 0) & (m > 0)).select("column_name", *[F.kll_sketch_get_quantile_double(c, places).alias(c) for c in "st"])
    below = lambda c, x: F.size(F.filter(c, lambda q: q <= x))
    gaps = F.transform(F.array_distinct(F.concat("s", "t")), lambda x: F.abs(below("s", x) - below("t", x)))
    told = full.select("column_name", (F.array_max(gaps) / steps).alias("distance"), F.lit(2 * rank_error() + 4 / steps).alias("error"))
    lonely = both.where((n > 0) != (m > 0)).select("column_name", F.lit(1.0).alias("distance"), F.lit(0.0).alias("error"))
    none = both.where((n == 0) & (m == 0)).select("column_name", F.lit(0.0).alias("distance"), F.lit(0.0).alias("error"))
    return told.unionByName(lonely).unionByName(none)
