import pytest
from pyspark.sql import functions as F

from concord.functions.normalize import Rule, Tolerance
from concord.operators.rows import (
    Pair, category_counts, column_differences, compare_rows, duplicate_rows, key_name, missing_rows, paired_rows,
)
from concord.operators.hashing import compare_by_hash
from concord.operators.sampling import stratified_sample
from concord.plans.run import Checks, Definition, run_comparison
from concord.sources.sides import Derived, derive
from seeded import CUSTOMER_MAPPING, by_key, pair

M, D = "matching", "matched-key-differing-values"


def test_customer_pair(spark):
    source, target = pair(spark, "customer")
    compared = compare_rows(source, target, ["CustomerID"], CUSTOMER_MAPPING)
    assert by_key(compared, "CustomerID") == {
        1: [(M, 1)], 2: [(D, 1)], 3: [(M, 1)], 4: [("missing-from-target", 1)], 5: [("duplicate-in-target", 2)],
        6: [(M, 1)], 7: [("missing-from-source", 1)],
    }
    changed = [tuple(r) for r in column_differences(compared, ["CustomerID"]).collect()]
    assert changed == [(2, "CUSTOMER_NAME", "Jane Roe", "Jane R. Doe")]
    counts = {r.category: (r.severity, r.findings) for r in category_counts(compared).collect()}
    assert counts["duplicate-in-target"] == ("Warning", 2) and counts[M] == ("Pass", 3)


def test_orders_pair(spark):
    source, target = pair(spark, "orders")
    mapping = [(c, c) for c in ("CUSTOMER_ID", "ORDER_TOTAL", "ORDER_STATUS")]
    compared = compare_rows(source, target, ["ORDER_ID"], mapping)
    found = by_key(compared, "ORDER_ID")
    assert found == {101: [(D, 1)], 102: [(M, 1)], 103: [("missing-from-target", 1)], 104: [(M, 1)], 105: [(M, 1)]}
    message = compared.where("ORDER_ID = 101").first().message
    assert message == "Column(s) differ after normalization: ORDER_TOTAL."


def test_products_pair(spark):
    source, target = pair(spark, "products")
    mapping = [("price", "price"), ("in_stock", "in_stock")]
    found = by_key(compare_rows(source, target, ["product_id"], mapping), "product_id")
    assert found == {
        1: [(M, 1)], 2: [("duplicate-in-target", 2)], 3: [("missing-from-target", 1)], 4: [(M, 1)], 5: [(M, 1)],
        6: [("missing-from-source", 1)],
    }
    with_sku = by_key(compare_rows(source, target, ["product_id"], [*mapping, ("sku", "sku")]), "product_id")
    assert [with_sku[i] for i in (1, 4, 5)] == [[(D, 1)]] * 3


def test_worked_example(spark):
    names = "ORDER_ID int, STATUS string, AMOUNT string, DAY string, CUSTOMER_NAME string"
    source = spark.createDataFrame([(1008924, "Shipped", "125.3700", "2026-07-20 00:00:00", "Acme Inc.")], names)
    target = spark.createDataFrame([(1008924, "SHIPPED", "125.37", "2026-07-20", "Acme, Inc.")], names)
    rules = {
        "STATUS": Rule(case_sensitive=False),
        "AMOUNT": Rule(numeric_tolerance=Tolerance(absolute=0.01)),
        "DAY": Rule(truncate_to="day"),
        "CUSTOMER_NAME": Rule(trim=True),
    }
    compared = compare_rows(source, target, ["ORDER_ID"], [(c, c) for c in source.columns[1:]], rules)
    row = compared.first()
    assert [tuple(d) for d in row.differences] == [("CUSTOMER_NAME", "Acme Inc.", "Acme, Inc.")]


def test_composite_and_null_keys(spark):
    names = "o int, l int, sku string"
    source = spark.createDataFrame([(100, 1, "A"), (100, 2, "B"), (None, 1, "N"), (None, None, "Z")], names)
    target = spark.createDataFrame([(100, 1, "A"), (100, 2, "C"), (None, 1, "N"), (None, 2, "Z")], names)
    rows = compare_rows(source, target, ["o", "l"], [("sku", "sku")]).collect()
    assert {(r.o, r.l): r.category for r in rows} == {
        (100, 1): M, (100, 2): D, (None, 1): M, (None, None): "missing-from-target", (None, 2): "missing-from-source",
    }


def test_duplicates_on_both_sides_silence_the_key(spark):
    source = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x")], "k int, v string")
    target = spark.createDataFrame([(1, "a"), (1, "a"), (1, "c"), (2, "x"), (2, "x")], "k int, v string")
    found = by_key(compare_rows(source, target, ["k"], [("v", "v")]), "k")
    assert found == {1: [("duplicate-in-source", 2), ("duplicate-in-target", 3)], 2: [("duplicate-in-target", 2)]}


def test_columns_absent_ignored_or_unmapped(spark):
    source = spark.createDataFrame([(1, "a", "x")], "k int, v string, w string")
    target = spark.createDataFrame([(1, "b", "x")], "k int, v string, w string")
    absent = compare_rows(source, target, ["k"], [("w", "w"), ("q", "nope"), ("r", "other")]).first()
    assert (absent.category, absent.severity) == ("unable-to-compare", "Error")
    assert absent.message == 'Column "nope" could not be normalized or compared.'
    assert compare_rows(source, target, ["k"], []).first().category == M
    assert compare_rows(source, target, ["k"], [("v", "v")], ignore_columns=["v"]).first().category == M
    assert compare_rows(source, target, ["k"], [("v", "v")]).first().category == D


def test_option_tolerance_overrides_the_rule(spark):
    source = spark.createDataFrame([(1, 1.0)], "k int, v double")
    target = spark.createDataFrame([(1, 1.5)], "k int, v double")
    rules = {"v": Rule(numeric_tolerance=Tolerance(absolute=0.1))}
    assert compare_rows(source, target, ["k"], [("v", "v")], rules).first().category == D
    wide = {"v": Tolerance(absolute=1.0)}
    assert compare_rows(source, target, ["k"], [("v", "v")], rules, numeric_tolerance=wide).first().category == M


def test_keys_of_two_families_never_meet(spark):
    source = spark.createDataFrame([(1, "a")], "k int, v string")
    target = spark.createDataFrame([("1", "a")], "k string, v string")
    found = sorted(r.category for r in compare_rows(source, target, ["k"], [("v", "v")]).collect())
    assert found == ["missing-from-source", "missing-from-target"]
    decimal = target.select(F.lit(1).cast("decimal(9,2)").alias("k"), "v")
    assert compare_rows(source, decimal, ["k"], [("v", "v")]).first().category == M


def test_missing_key_column_is_an_error(spark):
    source = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError, match="target side"):
        compare_rows(source, source.drop("k"), ["k"], [("v", "v")])


def test_derived_columns_and_exclusion(spark):
    source = spark.createDataFrame([(1, "Ann", "Lee", "x")], "k int, first string, last string, note string")
    target = spark.createDataFrame([(1, "ann lee", "y")], "k int, full_name string, note string")
    mapping = [
        Derived("name", "name", "lower(concat(first, ' ', last))", "full_name"),
        Pair("note", "note"),
    ]
    s, t, pairs = derive(source, target, mapping)
    assert compare_rows(s, t, ["k"], pairs).first().differences[0].column_name == "note"
    s, t, pairs = derive(source, target, mapping, exclude=["note"])
    assert "note" not in s.columns and compare_rows(s, t, ["k"], pairs).first().category == M


def test_missing_and_duplicate_rows(spark):
    source = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "n")], "k int, v string")
    target = spark.createDataFrame([(1, "a"), (5, "e")], "id int, v string")
    missing = missing_rows(source, target, ["k"], [Pair("k", "id")]).collect()
    assert [tuple(r) for r in missing] == [(None, "n")]
    back = missing_rows(target, source, ["id"], [Pair("id", "k")]).collect()
    assert [tuple(r) for r in back] == [(5, "e")]
    assert sorted(tuple(r) for r in duplicate_rows(source, ["k"]).collect()) == [(2, "b"), (2, "c")]


def test_null_keys_can_be_duplicates(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c")], "k int, v string")
    assert sorted(r.v for r in duplicate_rows(df, ["k"]).collect()) == ["a", "b"]


@pytest.mark.parametrize("key", ["category", "s", "position", "row_hash", "text0", "copies", "in_source"])
def test_any_key_name_works(spark, key):
    source = spark.createDataFrame([(1, "a"), (2, "b")], ["id", "v"]).withColumnRenamed("id", key)
    target = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], ["id", "v"]).withColumnRenamed("id", key)
    found = by_key(compare_rows(source, target, [key], [("v", "v")]), key_name(key))
    assert found == {1: [(M, 1)], 2: [(D, 1)], 3: [("missing-from-source", 1)]}
    assert duplicate_rows(source.union(source.limit(1)), [key]).count() == 2
    for level, extra in (("row", {}), ("column", {}), ("key-range", {"range_size": 1}), ("partition", {"partition_column": key})):
        found = compare_by_hash(source, target, level, ["v"], [key], **extra).mismatches
        assert found.count() == {"row": 2, "column": 1, "key-range": 2, "partition": 2}[level]
    checks = Checks(row_level=True, strategy="hash")
    run = run_comparison(spark, Definition("n", source, target, [key], [("v", "v")], checks=checks))
    assert run.summary.first().failed == 2
    sample = stratified_sample(source.withColumn("salt", F.lit("keep")), key, 1)
    assert sample.columns == [key, "v", "salt"] and {r.salt for r in sample.collect()} == {"keep"}


def test_hot_keys_fold_like_ordinary_ones(spark):
    source = spark.range(300).select((F.col("id") % 5 * (F.col("id") % 2)).alias("k"), F.col("id").cast("string").alias("v"))
    target = source.where("v > '2'").unionByName(spark.sql("SELECT 77L AS k, 'x' AS v UNION ALL SELECT NULL, 'y'"))
    values = {"v": F.col("v")}
    args = (source, target, ["k"], [], values, values)
    ordinary, hot = (paired_rows(*args, hot_rows=n) for n in (1_000_000, 20))
    counts = lambda df: sorted(map(repr, df.select("k", "source_rows", "target_rows").collect()))
    assert counts(ordinary) == counts(hot) and len(counts(hot)) == 7


def test_rows_are_sorted_once(spark):
    source = spark.range(50).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
    plan = compare_rows(source, source, ["k"], [Pair("v", "v")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "string"])
def test_time_tolerance(spark, kind):
    pairs = [
        ("1997-01-01 00:00:00", "1996-12-31 23:59:59", True),  # two days, one second apart
        ("1997-01-01 00:00:00", "1997-01-01 00:01:00", True),
        ("1997-01-01 00:00:00", "1997-01-01 00:01:00.000001", False),
        ("1997-01-01 00:00:00", None, False),
        (None, None, True),
    ]
    rows = [(i, a, b) for i, (a, b, _) in enumerate(pairs)]
    both = spark.createDataFrame(rows, "k bigint, a string, b string")
    sides = [both.select("k", F.col(c).cast(kind).alias("at")) for c in "ab"]
    found = by_key(compare_rows(*sides, ["k"], [("at", "at")], time_tolerance={"at": 60}), "k")
    assert found == {i: [(M if near else D, 1)] for i, (_, _, near) in enumerate(pairs)}
    assert compare_rows(sides[0].limit(0), sides[1].limit(0), ["k"], [("at", "at")], time_tolerance={"at": 60}).isEmpty()


def test_time_tolerance_takes_dates_and_repeated_keys_but_no_numbers_or_bad_text(spark):
    source = spark.sql("SELECT 1L AS k, DATE'1997-01-02' AS at UNION ALL SELECT 2L, DATE'1997-01-02' UNION ALL SELECT 2L, DATE'1997-01-02'")
    target = spark.sql("SELECT 1L AS k, 'soon' AS at UNION ALL SELECT 2L, '1997-01-01'")
    found = by_key(compare_rows(source, target, ["k"], [("at", "at")], time_tolerance={"at": 86400}), "k")
    assert found == {1: [(D, 1)], 2: [("duplicate-in-source", 2)]}
    with pytest.raises(ValueError, match="time tolerance"):
        compare_rows(source, source, ["k"], [("k", "k")], time_tolerance={"k": 1})
