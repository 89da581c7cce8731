"""Aggregate parity: counts, sums, averages and extremes of both sides, by group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.exactsum import Places, digits, magnitude, places, with_totals
from concord.functions.normalize import Tolerance, within
from concord.functions.values import family
from concord.operators.rows import Pair, as_pairs, key_columns, key_name, require, target_key
from concord.operators.skew import match_keys

METRICS = ("count", "sum", "avg", "min", "max")
SEVERITY = {"equal": "Pass", "within-tolerance": "Pass", "differing": "Failure", "missing-from-source": "Failure", "missing-from-target": "Failure"}


def grouping_sets(by: Sequence[str]) -> list[tuple[str, ...]]:
    """All subsets of the columns, the whole set first."""
    return [tuple(c for i, c in enumerate(by) if m >> i & 1) for m in reversed(range(1 << len(by)))]


def _measured(df: DataFrame, columns: Sequence[str], side: str) -> None:
    require(df, columns, side)
    wrong = [c for c in columns if family(df.schema[c].dataType) != "number"]
    if wrong:
        raise ValueError(f"measure(s) {wrong} of the {side} side are no numbers")


def _places(sides: list[tuple[DataFrame, Sequence[str]]]) -> list[Places]:
    """Where each measure's digits lie on both sides: one row of least and most magnitudes a side."""
    ranges = []
    for df, columns in sides:
        wanted = [f(magnitude(df[c])).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in (("low", F.min), ("high", F.max))]
        ranges.append(df.agg(*wanted).first())
    told = lambda name, i, pick: pick((r[f"{name}{i}"] for r in ranges if r[f"{name}{i}"] is not None), default=None)
    return [places(told("low", i, min), told("high", i, max)) for i in range(len(sides[0][1]))]


def _sum(i: int, side: str) -> Column:
    """The exact sum, or NaN and infinities as in any sum."""
    nan, up, down = (F.col(f"{side}_m{i}_{x}") for x in ("nan", "up", "down"))
    odd = (
        F.when((nan > 0) | ((up > 0) & (down > 0)), F.lit(float("nan")))
        .when(up > 0, F.lit(float("inf")))
        .when(down > 0, F.lit(float("-inf")))
    )
    finite = F.col(f"{side}_m{i}_finite")
    return F.struct(F.coalesce(odd, finite["value"]).alias("value"), F.coalesce(odd.cast("string"), finite["exact"]).alias("exact"))


def aggregate_parity(
    source: DataFrame,
    target: DataFrame,
    measures: Sequence[str],
    by: Sequence[str] = (),
    mapping: Sequence[Pair | tuple[str, str]] | None = None,
    tolerances: Mapping[str, Tolerance] | None = None,
    sets: Sequence[Sequence[str]] | None = None,
) -> DataFrame:
    """Every metric of every measure and group of both sides, with what became of it.

    Columns are named as on the source; ``sets`` are the grouping sets, all
    subsets of ``by`` unless given. A result row has the group columns (NULL
    where they are not grouped by), ``grouping`` (the names grouped by),
    ``column_name``, ``metric``, both values as doubles, ``category`` and
    ``severity``. Sums are exact before any tolerance: ``equal`` means the same
    real number, whatever the order of the rows. An average is the rounded sum
    over the count of values. Tolerances go by target name and never concern
    counts.

    A first pass finds the range of each measure. The second folds both sides
    into all grouping sets at once, before the one shuffle of their partial
    sums. Numbers of all types count as the doubles nearest to them. NULLs are
    left out of a measure and are a value of a group column; a group without
    values has NULL metrics but a count of zero. Empty sides give the one group
    of the empty set, if it is asked for.
    """
    pairs, tolerances = as_pairs(mapping), tolerances or {}
    named = {m: target_key(m, pairs) for m in measures}
    _measured(source, measures, "source")
    _measured(target, list(named.values()), "target")
    sides = [(source, list(measures)), (target, list(named.values()))]
    at = _places(sides)
    wanted = [tuple(s) for s in (sets if sets is not None else grouping_sets(by))]
    left, right, families = key_columns(source, target, by, pairs) if by else ([], [], [])

    tagged = []
    for (df, columns), group, is_source in zip(sides, (left, right), (True, False)):
        parts = []
        for i, c in enumerate(columns):
            value = df[c].cast("double")
            parts.append(value.alias(f"m{i}"))
            parts += [d.alias(f"m{i}_d{j}") for j, d in enumerate(digits(value, at[i]))]
        tagged.append(df.select(*group, *parts, F.lit(is_source).alias("in_source")))
    both = tagged[0].unionByName(tagged[1])

    # One copy of a row for each grouping set, folded in the same task.
    keys = [key_name(k) for k in by]
    own = {k: families if not families else [f for f in families if f == f"key_family_{i}"] for i, k in enumerate(by)}
    layouts = []
    for n, s in enumerate(wanted):
        held = [F.when(F.lit(k in s), F.col(key_name(k))).alias(key_name(k)) for k in by]
        held += [F.when(F.lit(any(f in own[k] for k in s)), F.col(f)).alias(f) for f in families]
        layouts.append(F.struct(F.lit(n).alias("set"), *held))
    spread = both.withColumn("group", F.explode(F.array(*layouts))).select("group.*", *[c for c in both.columns if c not in (*keys, *families)])
    aggregates = []
    for side, mine in (("source", F.col("in_source")), ("target", ~F.col("in_source"))):
        aggregates.append(F.count_if(mine).alias(f"{side}_rows"))
        for i, a in enumerate(at):
            v = F.when(mine, F.col(f"m{i}"))
            finite = F.abs(v) < float("inf")
            odd = {"nan": F.isnan(v), "up": v == float("inf"), "down": v == float("-inf")}
            aggregates += [F.count(v).alias(f"{side}_m{i}_n"), F.min(v).alias(f"{side}_m{i}_min"), F.max(v).alias(f"{side}_m{i}_max")]
            aggregates += [F.count_if(test).alias(f"{side}_m{i}_{name}") for name, test in odd.items()]
            aggregates += [F.sum(F.when(mine & finite, F.col(f"m{i}_d{j}"))).alias(f"{side}_m{i}_d{j}") for j in range(a.digits)]
    grouped = spread.groupBy("set", *keys, *families).agg(*aggregates)
    if () in wanted:  # the grand total is there even without rows
        seed = source.sparkSession.createDataFrame([(wanted.index(()),)], "set int")
        grouped = match_keys(seed, grouped, ["set"], "left_anti", broadcast=False).unionByName(grouped, allowMissingColumns=True)

    entries = []
    for i, m in enumerate(measures):
        tolerance = tolerances.get(named[m])
        for metric in METRICS:
            s, t = (_metric(metric, i, side) for side in ("source", "target"))
            close = within(s["value"], t["value"], tolerance) if tolerance and tolerance.is_set and metric != "count" else F.lit(False)
            equal = s["exact"].eqNullSafe(t["exact"])
            found = F.when(equal, "equal").when(F.coalesce(close, F.lit(False)), "within-tolerance").otherwise("differing")
            entries.append(F.struct(F.lit(m).alias("column_name"), F.lit(metric).alias("metric"), s["value"].alias("source_value"), t["value"].alias("target_value"), found.alias("category")))
    labels = F.array(*[F.lit(",".join(s)) for s in wanted])
    rows = {side: F.coalesce(F.col(f"{side}_rows"), F.lit(0)) for side in ("source", "target")}
    alone = F.when((rows["source"] == 0) & (rows["target"] > 0), "missing-from-source").when((rows["target"] == 0) & (rows["source"] > 0), "missing-from-target")
    wide = {f"{side}_m{i}_finite": ([f"{side}_m{i}_d{j}" for j in range(a.digits)], a) for side in rows for i, a in enumerate(at)}
    out = with_totals(grouped, wide).withColumns({f"{side}_m{i}_sum": _sum(i, side) for side in rows for i in range(len(at))})
    out = out.select(*keys, F.get(labels, F.col("set")).alias("grouping"), alone.alias("alone"), F.explode(F.array(*entries)).alias("entry"))
    category = F.coalesce("alone", "entry.category")
    severity = reduce(lambda rest, x: F.when(category == x[0], x[1]).otherwise(rest), SEVERITY.items(), F.lit(None).cast("string"))
    return out.select(*keys, "grouping", "entry.column_name", "entry.metric", "entry.source_value", "entry.target_value", category.alias("category"), severity.alias("severity"))


def _metric(metric: str, i: int, side: str) -> Column:
    """(value, exact) of one metric; a side without values has only a count."""
    n = F.coalesce(F.col(f"{side}_m{i}_n"), F.lit(0))
    if metric == "count":
        return F.struct(n.cast("double").alias("value"), n.cast("string").alias("exact"))
    if metric in ("min", "max"):
        value = F.col(f"{side}_m{i}_{metric}")
        plain = F.when(value == 0, F.lit(0.0)).otherwise(value)
        return F.struct(plain.alias("value"), plain.cast("string").alias("exact"))
    found = F.col(f"{side}_m{i}_sum")
    if metric == "sum":
        return F.when(n > 0, found)
    exact = F.concat_ws("/", found["exact"], n.cast("string"))
    return F.when(n > 0, F.struct((found["value"] / n).alias("value"), exact.alias("exact")))
