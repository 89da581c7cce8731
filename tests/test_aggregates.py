"""Aggregate parity: exact sums, grouping sets, tolerances."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.functions.exactsum import digits, magnitude, places, with_totals
from concord.functions.normalize import Tolerance
from concord.operators.aggregates import aggregate_parity, grouping_sets


def exact(values):
    return float(sum(map(Fraction, values), Fraction(0)))


def summed(spark, values, partitions=3):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(partitions)
    row = df.agg(F.min(magnitude(F.col("x"))), F.max(magnitude(F.col("x")))).first()
    at = places(*row)
    names = [f"d{i}" for i in range(at.digits)]
    sums = df.select(*[d.alias(n) for d, n in zip(digits(F.col("x"), at), names)]).agg(*[F.sum(n).alias(n) for n in names])
    return with_totals(sums, {"t": (names, at)}).first().t


CASES = {
    "cancelling": [1e300, 1.0, -1e300, 1e-300, 3.0, 0.1, 0.2, -5e-324],
    "smallest": [5e-324] * 7 + [-5e-324] * 3,
    "largest": [1.7976931348623157e308, -1.7976931348623157e308, 1e292],
    "negative": [-0.1] * 10,
    "zero": [0.0, -0.0],
    "none": [],
    "tie": [2.0**53, 1.0, 2.0**-40],
    "tie down": [2.0**53, 1.0],
    "half": [1.0, 2.0**-53, 2.0**-105],
    "all ones": [float(2**53 - 1), 2.0**-30 * (2**53 - 1), -1.0],
}


@pytest.mark.parametrize("name", CASES)
def test_sums_are_rounded_once(spark, name):
    assert summed(spark, CASES[name]).value == exact(CASES[name])


def test_random_sums_under_any_partitioning(spark):
    rng = np.random.default_rng(1)
    for seed in range(3):
        values = (rng.normal(size=400) * 10.0 ** rng.integers(-5 * 10**seed, 5 * 10**seed, 400).clip(-300, 300)).tolist()
        found = [summed(spark, order, parts) for order, parts in ((values, 1), (values[::-1], 7))]
        assert found[0] == found[1] and found[0].value == exact(values)
        assert found[0].exact != summed(spark, [*values, 5e-324]).exact


def parity(*args, **options):
    df = aggregate_parity(*args, **options)
    by = df.columns[: df.columns.index("grouping")]
    return {(tuple(r[c] for c in by), r.grouping, r.column_name, r.metric): r for r in df.collect()}


def test_grouping_sets_with_nulls_and_lonely_groups(spark):
    source = spark.createDataFrame([("a", 1, 1.5), ("a", 2, None), (None, 1, 2.0), ("b", 1, 4.0)], "g string, h int, v double")
    target = spark.createDataFrame([("a", 1, 1.5), ("a", 2, None), (None, 1, 2.5), ("c", 1, 4.0)], "g string, h int, v double")
    assert sorted(grouping_sets(["g", "h"])) == [(), ("g",), ("g", "h"), ("h",)]
    got = parity(source, target, ["v"], ["g", "h"])
    one = lambda g, h, sets, metric: got[(g, h), sets, "v", metric]
    assert one("a", 1, "g,h", "sum").category == "equal"
    assert (one("a", 2, "g,h", "sum").source_value, one("a", 2, "g,h", "count").source_value) == (None, 0.0)
    assert one("a", 2, "g,h", "sum").category == "equal"  # nothing on both sides
    assert one(None, 1, "g,h", "sum").category == "differing" and one(None, None, "g", "sum").category == "differing"
    assert one("b", None, "g", "sum").category == "missing-from-target" and one("c", None, "g", "max").category == "missing-from-source"
    total = one(None, None, "", "sum")
    assert (total.source_value, total.target_value, total.severity) == (7.5, 8.0, "Failure")


def test_sums_agree_bit_for_bit_before_any_tolerance(spark):
    values = [0.1, 0.2, 0.3, 1e16, -1e16, 1e-9]
    source = spark.createDataFrame([(v,) for v in values], "v double")
    target = spark.createDataFrame([(v,) for v in reversed(values)], "v double").repartition(6)
    assert {r.category for r in parity(source, target, ["v"]).values()} == {"equal"}
    moved = target.union(spark.createDataFrame([(1e-9,)], "v double"))
    got = parity(source, moved, ["v"], tolerances={"v": Tolerance(absolute=1e-6)})
    assert got[(), "", "v", "sum"].category == "within-tolerance" and got[(), "", "v", "count"].category == "differing"


def test_odd_numbers_empty_sides_and_other_types(spark):
    odd = spark.createDataFrame([(math.nan, 1.0, math.inf), (1.0, math.inf, -math.inf)], "a double, b double, c double")
    got = parity(odd, odd, ["a", "b", "c"])
    assert math.isnan(got[(), "", "a", "sum"].source_value) and got[(), "", "b", "sum"].source_value == math.inf
    assert math.isnan(got[(), "", "c", "sum"].source_value) and {r.category for r in got.values()} == {"equal"}
    empty = odd.limit(0)
    got = parity(empty, empty, ["a"])
    assert got[(), "", "a", "count"].source_value == 0 and got[(), "", "a", "sum"].source_value is None
    assert got[(), "", "a", "sum"].category == "equal"
    assert parity(odd, empty, ["a"])[(), "", "a", "count"].category == "missing-from-target"
    whole = spark.createDataFrame([(2**40, 7), (1, 8)], "k bigint, n int")
    number = spark.createDataFrame([(float(2**40), 7.0), (1.0, 8.0)], "k double, m double")
    assert {r.category for r in parity(whole, number, ["k", "n"], mapping=[("n", "m")]).values()} == {"equal"}
    with pytest.raises(ValueError, match="no numbers"):
        aggregate_parity(spark.createDataFrame([("x",)], "v string"), number, ["v"], mapping=[("v", "m")])


def test_one_exchange_folds_all_sets(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") % 5).alias("h"), F.col("id").cast("double").alias("v"))
    plan = aggregate_parity(df, df, ["v"], ["g", "h"], sets=[("g", "h"), ("g",)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_hot_group(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), (F.col("id") * 0.1).alias("v"))
    got = aggregate_parity(df, df.repartition(9), ["v"], ["g"], sets=[("g",)]).groupBy("category").count().collect()
    assert [r.category for r in got] == ["equal"]
