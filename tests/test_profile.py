import random
import statistics

import pytest
from pyspark.sql import functions as F

from concord.operators import profile
from concord.operators.profile import exact_median, profile_columns
from concord.operators.rows import Pair
from seeded import CUSTOMER_MAPPING, pair

NOW = "2024-06-01 00:00:00"


def rows(df, key="column_name"):
    return {r[key]: r for r in df.collect()}


def test_products_pair(spark):
    source, _ = pair(spark, "products")
    price = rows(profile.profile_numeric(source))["price"]
    assert (price.min_value, price.max_value, price.median_value) == (9.99, 89.0, 19.99)
    assert price.mean_value == pytest.approx(36.694) and price.stddev_value == pytest.approx(33.156455329241695)
    stock = {r.value: (r.value_count, r.percentage, r.cardinality) for r in profile.profile_boolean(source).collect()}
    assert stock == {"true": (4, 80.0, 2), "false": (1, 20.0, 2)}
    general = rows(profile.profile_general(source))["description"]
    assert (general.row_count, general.populated_count, general.null_count, general.null_percentage) == (5, 3, 2, 40.0)


def test_customer_pair(spark):
    source, _ = pair(spark, "customer")
    name = rows(profile_columns(source, NOW))["CustomerName"]
    assert (name.distinct_count, name.null_count, name.min_length, name.max_length) == (6, 0, 7, 17)
    created = rows(profile.profile_date(source, NOW))["CreatedDate"]
    assert (str(created.earliest_value), created.future_count) == ("2024-01-15 10:30:00", 1)
    table = profile.profile_table(source).first()
    assert (table.total_count, table.CreditLimit_non_null_count, table.IsActive_distinct_count) == (6, 5, 2)


def test_text_metrics(spark):
    df = spark.createDataFrame([("",), ("  ",), ("ABC",), ("abc",), ("Abc",), ("123",), (None,)], "s string")
    found = profile.profile_string(df).first()
    assert (found.empty_count, found.blank_count, found.min_length, found.max_length) == (1, 1, 0, 3)
    assert (found.upper_count, found.lower_count, found.mixed_count) == (1, 1, 4)
    assert found.avg_length == pytest.approx(14 / 6)


def test_most_common_breaks_ties_by_value_order(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (10, "b"), (9, "a"), (100, None)], "n int, s string")
    assert {r.column_name: (r.value, r.value_count) for r in profile.most_common(df).collect()} == {
        "n": ("9", 2), "s": ("a", 2),
    }
    top = profile.top_values(df, 2).where("column_name = 'n'").orderBy("place").collect()
    assert [(r.place, r.value, r.value_count) for r in top] == [(1, "9", 2), (2, "10", 2)]


def test_table_without_rows(spark):
    df = spark.createDataFrame([], "n int, s string, t timestamp_ntz, b boolean")
    found = rows(profile_columns(df, NOW))
    assert set(found) == {"n", "s", "t", "b"}
    assert all((r.row_count, r.distinct_count, r.null_percentage) == (0, 0, 0.0) for r in found.values())
    assert (found["n"].median_value, found["n"].min_value, found["s"].max_length) == (0.0, 0.0, 0)


def test_column_of_nulls(spark):
    df = spark.sql("SELECT CAST(NULL AS DOUBLE) AS n, CAST(NULL AS STRING) AS s FROM range(3)")
    found = rows(profile_columns(df, NOW))
    assert (found["n"].null_percentage, found["n"].mean_value, found["s"].mixed_count) == (100.0, 0.0, 0)


@pytest.mark.parametrize("size", [1, 2, 5, 1_000, 4_001])
@pytest.mark.parametrize("kind", ["uniform", "skewed", "constant", "half"])
def test_median_against_brute_force(spark, size, kind):
    rng = random.Random(size)
    make = {
        "uniform": lambda i: rng.uniform(-1e6, 1e6),
        "skewed": lambda i: rng.paretovariate(0.4),
        "constant": lambda i: 7.0,
        "half": lambda i: 3.0 if i % 2 else rng.random(),
    }[kind]
    values = [make(i) for i in range(size)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    assert profile.profile_numeric(df).first().median_value == pytest.approx(statistics.median(values), rel=1e-15)


@pytest.mark.parametrize("band", [(-9.0, -5.0), (2000.0, 3000.0), (0.0, 10.0), (499.0, 499.0), (0.0, 999.0)])
def test_median_survives_a_wrong_band(spark, band):
    df = spark.range(1_000).select(F.col("id").cast("double").alias("v"))
    assert exact_median(df, {"v": (1_000, *band)}).first().median_value == 499.5


def test_diff(spark):
    source = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "b", True)], "id int, s string, f boolean")
    target = spark.createDataFrame([(1, None, True), (2, "c", True), (3, "c", True)], "id int, t string, f boolean")
    found = {(r.column_name, r.metric): r for r in profile.profile_diff(source, target, [Pair("s", "t")]).collect()}
    assert {k: r.severity for k, r in found.items()} == {
        ("s", "distinctCount"): "Informational", ("s", "nullPercentage"): "Warning", ("s", "mostCommonValue"): "Warning",
        ("f", "distinctCount"): "Informational", ("f", "missingTargetValue"): "Warning",
    }
    assert found["s", "nullPercentage"].message == (
        'Column "s": null percentage changed from 0.00% (source) to 33.33% (target).'
    )
    assert found["s", "mostCommonValue"].message.endswith('from "b" (source) to "c" (target).')
    assert profile.profile_diff(source, target, [Pair("s", "t")], exclude=["f"]).where("column_name = 'f'").isEmpty()


def test_diff_against_an_empty_side(spark):
    source, _ = pair(spark, "customer")
    found = profile.profile_diff(source, source.limit(0))
    messages = {r.message for r in found.where("metric = 'mostCommonValue' AND column_name = 'CustomerID'").collect()}
    assert messages == {'Column "CustomerID": most common value changed from "1" (source) to (none) (target).'}


def test_pairs_follow_the_mapping(spark):
    source, target = pair(spark, "customer")
    assert profile.column_pairs(source, target, CUSTOMER_MAPPING) == CUSTOMER_MAPPING
