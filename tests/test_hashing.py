import pytest
from pyspark.sql import functions as F

from concord.functions.digest import significant_figures
from concord.functions.normalize import Rule, Tolerance
from concord.operators.hashing import HashSpec, compare_by_hash, hash_columns, hash_row_compare, hash_rows
from concord.operators.skew import expand, global_rank, hot_keys
from seeded import pair

COLUMNS = ["CUSTOMER_ID", "ORDER_TOTAL", "ORDER_STATUS"]


def test_orders_pair(spark):
    source, target = pair(spark, "orders")
    table = compare_by_hash(source, target, "table", COLUMNS).result.first()
    assert not table.matched and table.source_hash != table.target_hash
    parts = compare_by_hash(source, target, "partition", COLUMNS, partition_column="ORDER_STATUS")
    found = {r.partition_value: r for r in parts.mismatches.collect()}
    assert {k: (r.source_rows, r.target_rows) for k, r in found.items()} == {"PENDING": (1, 0), "SHIPPED": (3, 3)}
    assert found["PENDING"].target_hash is None and found["SHIPPED"].target_hash is not None
    rows = {r.ORDER_ID: r for r in compare_by_hash(source, target, "row", COLUMNS, ["ORDER_ID"]).mismatches.collect()}
    assert set(rows) == {101, 103} and rows[101].target_hash and rows[103].target_hash is None
    columns = compare_by_hash(source, target, "column", COLUMNS, ["ORDER_ID"]).mismatches.collect()
    assert [r.column_name for r in columns] == ["ORDER_TOTAL"]
    ranges = compare_by_hash(source, target, "key-range", COLUMNS, ["ORDER_ID"], range_size=2)
    assert sorted((r.range_start, r.range_end) for r in ranges.mismatches.collect()) == [(101, 102), (103, 104)]
    assert ranges.result.first().mismatch_count == 2


def test_order_and_copies(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    shuffled = spark.createDataFrame([(2, "b"), (1, "a"), (2, "b")], "k int, v string")
    fewer = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    matched = lambda a, b: compare_by_hash(a, b, "table", ["k", "v"]).result.first().matched
    assert matched(one, shuffled) and not matched(one, fewer)
    empty = one.limit(0)
    assert matched(empty, empty) and not matched(one, empty)
    for level, extra in (("partition", {"partition_column": "v"}), ("row", {}), ("column", {}), ("key-range", {"range_size": 1})):
        keys = [] if level == "partition" else ["k"]
        verdict = compare_by_hash(one, shuffled, level, ["v"], keys, **extra).result.first()
        assert verdict.matched and verdict.mismatch_count == 0


def test_texts_are_injective_and_typed(spark):
    matched = lambda a, b, **o: compare_by_hash(a, b, "table", a.columns, **o).result.first().matched
    frame = lambda *rows, schema="a string, b string": spark.createDataFrame(list(rows), schema)
    assert not matched(frame(("ab", "c")), frame(("a", "bc")))
    assert not matched(frame((None, "n")), frame(("n", None)))
    assert not matched(frame(("", "x")), frame((None, "x")))
    numbers = spark.sql("SELECT 1 AS a"), spark.sql("SELECT CAST(1.00 AS DECIMAL(9,2)) AS a"), spark.sql("SELECT 1.0D AS a")
    assert matched(numbers[0], numbers[1]) and matched(numbers[1], numbers[2]) and matched(numbers[0], numbers[2])
    assert not matched(numbers[0], spark.sql("SELECT '1' AS a"))
    zero = spark.sql("SELECT -0.0D AS a"), spark.sql("SELECT 0.0D AS a")
    assert matched(*zero)
    close = spark.sql("SELECT 1.00001D AS a"), spark.sql("SELECT 1.00002D AS a")
    assert not matched(*close) and matched(*close, float_scale=4)


def test_rules_and_tolerance(spark):
    source = spark.sql("SELECT 125.364D AS n, ' X' AS s")
    target = spark.sql("SELECT 125.3600D AS n, 'x' AS s")
    rules = {"n": Rule(numeric_tolerance=Tolerance(absolute=0.01)), "s": Rule(trim=True, case_sensitive=False)}
    assert compare_by_hash(source, target, "table", ["n", "s"], rules=rules).result.first().matched
    as_text = spark.sql("SELECT '125.36' AS n, 'x' AS s")
    assert compare_by_hash(source, as_text, "table", ["n", "s"], rules=rules).result.first().matched
    split = spark.sql("SELECT 125.370D AS n, 'x' AS s")
    assert not compare_by_hash(source, split, "table", ["n", "s"], rules=rules).result.first().matched
    percent = {"n": Rule(numeric_tolerance=Tolerance(percentage=1.0))}
    rounded = spark.sql("SELECT 125.4D AS n")
    assert compare_by_hash(source.select("n"), rounded, "table", ["n"], rules=percent).result.first().matched
    huge = spark.sql("SELECT 1e20D AS n"), spark.sql("SELECT 2e20D AS n")
    assert not compare_by_hash(*huge, "table", ["n"], rules=rules).result.first().matched


@pytest.mark.parametrize(("percentage", "figures"), [(100, 2), (1, 4), (0.5, 4), (0.01, 6), (1e-20, 15), (1e4, 1)])
def test_significant_figures(percentage, figures):
    assert significant_figures(percentage) == figures


def test_mapping_and_guards(spark):
    source = spark.createDataFrame([(1, "a")], "k int, v string")
    target = spark.createDataFrame([(1, "a")], "id int, w string")
    mapping = [("k", "id"), ("v", "w")]
    assert compare_by_hash(source, target, "row", ["v"], ["k"], mapping).result.first().matched
    for options, message in (
        ({"level": "table", "columns": ["q"]}, "source side"),
        ({"level": "table", "columns": ["v"], "mapping": [("v", "zz")]}, "target side"),
        ({"level": "partition", "columns": ["v"]}, "partition_column"),
        ({"level": "key-range", "columns": ["v"], "keys": ["k", "v"]}, "exactly one"),
        ({"level": "key-range", "columns": ["v"], "keys": ["k"]}, "range_size"),
        ({"level": "row", "columns": ["v"]}, "key columns"),
        ({"level": "column", "columns": ["v"]}, "key columns"),
        ({"level": "other", "columns": ["v"]}, "unknown level"),
    ):
        with pytest.raises(ValueError, match=message):
            compare_by_hash(source, target, **{"mapping": mapping, **options})


def test_key_ranges_need_a_number_as_key(spark):
    source = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    target = spark.createDataFrame([("a", "CHANGED")], "k string, v string")
    with pytest.raises(ValueError, match="number"):
        compare_by_hash(source, target, "key-range", ["v"], ["k"], range_size=5)


def test_rows_without_a_key_are_a_range_of_their_own(spark):
    source = spark.createDataFrame([(1, "a"), (None, "extra")], "k int, v string")
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    compared = compare_by_hash(source, target, "key-range", ["v"], ["k"], range_size=5)
    (found,) = compared.mismatches.collect()
    assert (found.range_start, found.range_end, found.source_rows, found.target_rows) == (None, None, 1, 0)
    assert not compared.result.first().matched
    assert compare_by_hash(source, source, "key-range", ["v"], ["k"], range_size=5).result.first().matched


def test_key_ranges_keep_number_order_when_the_other_side_has_text(spark):
    source = spark.createDataFrame([(2, "a"), (10, "b"), (9, "c")], "k int, v string")
    target = spark.createDataFrame([("2", "a"), ("x", "b")], "k string, v string")
    found = compare_by_hash(source, target, "key-range", ["v"], ["k"], range_size=2).mismatches.collect()
    assert sorted(map(repr, ((r.range_start, r.range_end, r.source_rows, r.target_rows) for r in found))) == [
        "(10, 10, 1, 0)", "(2, 9, 2, 0)", "(None, None, 0, 2)",
    ]


def test_ranges_do_not_depend_on_partitions(spark):
    source = spark.range(500).select((F.col("id") * 3).alias("k"), F.col("id").cast("string").alias("v"))
    target = source.where("k % 7 <> 0")
    rows = []
    for n in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(repr, compare_by_hash(source, target, "key-range", ["v"], ["k"], range_size=10).mismatches.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1] and len(rows[0]) == 50


def test_column_hashes_shuffle_once_and_never_join(spark):
    source = spark.range(50).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit("b").alias("w"))
    spec = HashSpec(("v", "w"), (), {}, None)
    plan = hash_columns(source, source, spec, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_hot_keys_pair_like_ordinary_ones(spark):
    base = spark.range(600).select((F.col("id") % 3).alias("k"), (F.col("id") % 7).cast("string").alias("v"))
    nulls = spark.range(40).select(F.lit(None).cast("bigint").alias("k"), (F.col("id") % 2).cast("string").alias("v"))
    source = base.union(nulls)
    target = base.where("v <> '3'").union(nulls.limit(30)).union(spark.sql("SELECT 99L AS k, 'z' AS v"))
    spec = HashSpec(("v",), (), {}, None)
    ordinary = hash_row_compare(source, target, spec, ["k"])
    hot = hash_row_compare(source, target, spec, ["k"], hot_rows=10)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(hot) == rows(ordinary) and len(rows(hot)) > 50


def test_hot_keys_are_found(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    assert [r.k for r in hot_keys(df, ["k"], 1_000).collect()] == [-1]
    assert hot_keys(df, ["k"], 10_000) is None


def test_global_rank(spark):
    df = spark.range(5_000).select(((F.col("id") * 7919) % 5_003).alias("v"))
    ranked = global_rank(df, ["v"], "rank").orderBy("v").collect()
    assert [r["rank"] for r in ranked] == list(range(5_000))


def test_expand(spark):
    df = spark.createDataFrame([("a", 1), ("b", 25_001)], "k string, n bigint")
    assert {r.k: r["count"] for r in expand(df, "n", ["k"]).groupBy("k").count().collect()} == {"a": 1, "b": 25_001}


def test_row_hash_is_sha256_of_the_row_text(spark):
    row = hash_rows(spark.sql("SELECT 'ab' AS a, CAST(NULL AS STRING) AS b, 7 AS c"), ["a", "b", "c"])
    assert row.select((F.col("row_hash") == F.sha2(F.lit("v2:abnv1:7"), 256)).alias("same")).first().same
