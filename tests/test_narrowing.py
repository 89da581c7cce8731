"""The descent to differing rows against the plain row comparison."""

import datetime

import pytest
from pyspark.sql import functions as F

from concord.functions.normalize import Rule, Tolerance
from concord.operators import narrowing
from concord.operators.narrowing import narrow_differences
from concord.operators.rows import compare_rows
from concord.suite import inputs

SF = "/root/testdata/sf0.01"
PLAIN = [("k", "k"), ("v", "v")]


def found(result, *columns):
    return sorted(tuple(map(str, r)) for r in result.select(*columns, "category").collect())


def plain(source, target, keys, mapping, rules=None):
    return found(compare_rows(source, target, keys, mapping, rules).where("category <> 'matching'"), *keys)


def both(spark, rows, changed, kind="k bigint, v string"):
    return spark.createDataFrame(rows, kind), spark.createDataFrame(changed, kind)


def test_levels_shrink_and_equal_the_row_comparison(spark):
    source = inputs.orders(spark, SF)
    spots = [70, 71, 4000, 9000]
    price = F.when(F.col("o_orderkey").isin(spots), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    target = source.withColumn("o_totalprice", price).where("o_orderkey <> 12000")
    mapping = [(c, c) for c in source.columns]
    got = narrow_differences(source, target, ["o_orderkey"], mapping, row_goal=100)
    assert found(got.result, "o_orderkey") == plain(source, target, ["o_orderkey"], mapping)
    first, *rest = got.levels
    assert first.rows == source.count() + target.count() and first.unequal <= 4 < first.parts
    assert rest and all(b.rows == a.unequal_rows for a, b in zip(got.levels, rest))  # equal ranges are not read again
    assert got.levels[-1].unequal_rows < first.rows / 50
    assert got.source.count() + got.target.count() == got.levels[-1].unequal_rows


def test_partitions_reach_the_scan(spark, tmp_path):
    sides = []
    for name, sql in (("s", "SELECT * FROM {orders}"), ("t", inputs.ORDERS_DRIFTED)):
        df = inputs.from_sql(spark, SF, sql, "orders").withColumn("order_year", F.year("o_orderdate"))
        df.write.partitionBy("order_year").parquet(f"{tmp_path}/{name}")
        sides.append(spark.read.parquet(f"{tmp_path}/{name}"))
    mapping = [(c, c) for c in sides[0].columns]
    got = narrow_differences(*sides, ["o_orderkey"], mapping, partition_column="order_year", row_goal=100)
    assert got.levels[0].name == "partition" and got.levels[0].unequal == 2
    assert sum(level.rows for level in got.levels[1:]) < got.levels[0].rows
    plan = got.source._jdf.queryExecution().executedPlan().toString()
    assert "order_year" in plan.split("PartitionFilters: [")[1].split("]")[0] and "1995" in plan.split("PartitionFilters: [")[1]
    assert plan.split("PushedFilters: [")[1].startswith("Or(") and "o_orderkey" in plan.split("DataFilters: [")[1]
    assert found(got.result, "o_orderkey") == plain(*sides, ["o_orderkey"], mapping)


def test_nulls_ties_repeats_and_hot_keys(spark):
    rows = [(None, "a"), (None, "b"), (1, "a"), (1, "a"), (2, None), (3, ""), (4, "x" * 100_000), (5, "same"), (5, "same")] + [(9, "hot")] * 500
    changed = [(None, "a"), (None, "c"), (1, "a"), (2, ""), (3, ""), (4, "x" * 99_999 + "y"), (5, "same"), (5, "same"), (6, "new")] + [(9, "hot")] * 499
    source, target = both(spark, rows, changed)
    got = narrow_differences(source, target, ["k"], PLAIN, row_goal=0, fanout=4)
    # Key 5 is repeated alike on both sides, and so no difference.
    assert found(got.result, "k") == [x for x in plain(source, target, ["k"], PLAIN) if x[0] != "5"]


@pytest.mark.parametrize("partition", [None, "p"])
def test_empty_and_equal_sides(spark, partition):
    kind, mapping = "k bigint, v string, p string", [*PLAIN, ("p", "p")]
    full = spark.createDataFrame([(i, str(i), "AB"[i % 2]) for i in range(50)] + [(None, None, None)], kind)
    empty = full.limit(0)
    options = {"partition_column": partition, "row_goal": 0, "fanout": 8}
    assert narrow_differences(full, full, ["k"], mapping, **options).result.collect() == []
    assert narrow_differences(empty, empty, ["k"], mapping, **options).result.collect() == []
    for sides in ((full, empty), (empty, full)):
        assert found(narrow_differences(*sides, ["k"], mapping, **options).result, "k") == plain(*sides, ["k"], mapping)


def test_null_partition(spark):
    kind, mapping = "k bigint, v string, p string", [*PLAIN, ("p", "p")]
    source = spark.createDataFrame([(i, "v", None if i < 20 else "q") for i in range(40)], kind)
    target = source.withColumn("v", F.when(F.col("k") == 7, "w").otherwise(F.col("v")))
    got = narrow_differences(source, target, ["k"], mapping, partition_column="p", row_goal=0, fanout=4)
    assert [x.unequal for x in got.levels][0] == 1 and found(got.result, "k") == [("7", "matched-key-differing-values")]


@pytest.mark.parametrize(
    "make",
    [lambda i: f"key-{i:04}", lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(i), lambda i: i / 2, lambda i: i % 3 == 0 and f"é{i}" or f"漢{i}"],
    ids=["text", "date", "double", "unicode"],
)
def test_other_keys(spark, make):
    source = spark.createDataFrame([(make(i), i) for i in range(300)], ["k", "v"])
    target = spark.createDataFrame([(make(i), i + (i in (5, 299))) for i in range(300) if i != 100], ["k", "v"])
    got = narrow_differences(source, target, ["k"], PLAIN, row_goal=10, fanout=16)
    assert found(got.result, "k") == plain(source, target, ["k"], PLAIN) and len(found(got.result, "k")) == 3


def test_keys_of_two_families_and_renamed_composite_keys(spark):
    source = spark.createDataFrame([(i, "x", i * 1.0) for i in range(60)], "a int, b string, v double")
    target = spark.createDataFrame([(i, "x", i + 0.004 + (i == 30)) for i in range(60)], "c bigint, d string, w double")
    mapping, rules = [("a", "c"), ("b", "d"), ("v", "w")], {"w": Rule(numeric_tolerance=Tolerance(absolute=0.01))}
    got = narrow_differences(source, target, ["a", "b"], mapping, rules, row_goal=5, fanout=8)
    assert found(got.result, "a", "b") == plain(source, target, ["a", "b"], mapping, rules) == [("30", "x", "matched-key-differing-values")]
    text = target.withColumn("c", F.concat(F.lit("n"), "c"))
    assert found(narrow_differences(source, text, ["a", "b"], mapping, rules).result, "a", "b") == plain(source, text, ["a", "b"], mapping, rules)


def test_more_unequal_partitions_than_a_predicate_names(spark, monkeypatch):
    monkeypatch.setattr(narrowing, "MAX_PARTS", 5)
    source = spark.range(40).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.col("id").alias("p"))
    target = source.withColumn("v", F.when(F.col("k") < 20, "b").otherwise("a"))
    got = narrow_differences(source, target, ["k"], [*PLAIN, ("p", "p")], partition_column="p", row_goal=0, fanout=4)
    assert len(found(got.result, "k")) == 20
