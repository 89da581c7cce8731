"""Trend and change point of a figure over the recorded runs of each comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators.rows import require
from concord.operators.skew import best_rows

LAST_RUNS = 60
LEAST_RUNS = 8
SIGNIFICANCE = 0.01


def _median(values: str) -> str:
    """SQL for the median of an array, NULL if it is empty."""
    ordered = f"array_sort({values})"
    size = f"size({values})"
    return f"CASE WHEN {size} > 0 THEN (get({ordered}, CAST(({size} - 1) DIV 2 AS INT)) + get({ordered}, CAST({size} DIV 2 AS INT))) / 2 END"


def _enough(expression: str, least: int) -> Column:
    return F.when(F.col("runs") >= least, F.expr(expression))


def run_trends(
    runs: DataFrame,
    value: str = "failed",
    last: int = LAST_RUNS,
    least: int = LEAST_RUNS,
    significance: float = SIGNIFICANCE,
) -> DataFrame:
    """One row per comparison: how ``value`` moved over its ``last`` runs.

    ``runs`` is run history, as ``list_runs`` gives it: comparison, timestamp, run_id
    and the value. ``slope`` is the median of the slopes between any two
    runs, per run, which a few odd runs cannot bend. The change point is where the ranks of
    the values before and after differ most (Pettitt's statistic); of equal
    ones the first. ``change_at`` and ``change_run_id`` name the first run after it,
    ``shift`` is the median after less the median before, ``p_value`` how
    likely so large a difference is without a change, and ``changed`` whether
    that is at most ``significance``. Values that are all equal have no change point.

    Fewer than ``least`` runs with a value give NULLs, not zeros. Runs without a
    value are left out; a comparison that has none has no row. Runs
    follow by timestamp, then run id; a repeated row is a run of its own, and runs without a
    comparison are one comparison. An empty history gives no row.

    The last runs are found by input partition first, so a comparison with very many
    runs is no burden; all else works on the ``last`` values of one row.
    """
    require(runs, ["comparison", "timestamp", "run_id", value], "history")
    if not 2 <= least <= last:
        raise ValueError("a trend needs at least two runs, and no more than it looks at")
    known = runs.where(F.col(value).isNotNull()).select("comparison", "timestamp", "run_id", F.col(value).cast("double").alias("value"))
    order = [F.desc("timestamp"), F.desc("run_id"), F.desc("value")]
    recent = best_rows(known, "comparison", order, last, "place")
    listed = F.array_sort(F.collect_list(F.struct("timestamp", "run_id", "value")))  # at most ``last`` rows
    found = recent.groupBy("comparison").agg(listed.alias("h")).withColumn("runs", F.size("h").cast("bigint"))
    found = found.withColumn("v", F.col("h.value"))
    slopes = "flatten(transform(sequence(1, size(v) - 1), i -> transform(slice(v, i + 1, size(v)), (y, j) -> (y - v[i - 1]) / (j + 1))))"
    found = found.withColumn("slopes", _enough(slopes, least)).withColumn("slope", F.expr(_median("slopes")))
    signs = "transform(v, x -> aggregate(v, 0L, (a, y) -> a + CAST(sign(y - x) AS BIGINT)))"
    sums = "transform(sequence(1, size(v) - 1), k -> abs(aggregate(slice(signs, 1, k), 0L, (a, y) -> a + y)))"
    found = found.withColumn("signs", _enough(signs, least)).withColumn("sums", _enough(sums, least))
    found = found.withColumn("most", F.array_max("sums"))
    found = found.withColumn("k", F.when(F.col("most") > 0, F.expr("CAST(array_position(sums, most) AS INT)")))
    n = F.col("runs").cast("double")
    chance = F.least(F.lit(1.0), 2 * F.exp(-6 * F.col("most") * F.col("most") / (n * n * n + n * n)))
    p = F.when(F.col("most").isNotNull(), chance)
    after, before = "slice(v, k + 1, size(v))", "slice(v, 1, k)"
    return found.select(
        "comparison", "runs", "slope",
        F.expr("get(h, k).timestamp").alias("change_at"), F.expr("get(h, k).run_id").alias("change_run_id"),
        F.expr(f"{_median(after)} - {_median(before)}").alias("shift"), p.alias("p_value"), (p <= significance).alias("changed"),
    )
