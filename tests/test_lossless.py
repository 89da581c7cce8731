"""Keys, values and instants that a careless conversion would merge or move."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.normalize import Rule, normalize
from concord.functions.values import as_text, number_text, shared_type
from concord.operators.profile import profile_date, profile_general
from concord.operators.rows import Pair, compare_rows, duplicate_rows
from concord.operators.sampling import date_window, stratified_sample

D = decimal.Decimal


def _categories(source, target):
    return sorted((r.k, r.category) for r in compare_rows(source, target, ["k"]).collect())


def test_whole_keys_beyond_exact_doubles_stay_apart(spark):
    source = spark.createDataFrame([(9007199254740992,), (9007199254740993,)], "k bigint")
    target = spark.createDataFrame([(9007199254740992.0,)], "k double")
    assert _categories(source, target) == [("9007199254740992", "matching"), ("9007199254740993", "missing-from-target")]


def test_decimals_that_cannot_widen_meet(spark):
    source = spark.createDataFrame([(D("12345678901234567890"),), (D("5"),)], "k decimal(38,0)")
    target = spark.createDataFrame([(D("5.00000000000000000000"),), (D("0.5"),)], "k decimal(38,20)")
    assert _categories(source, target) == [
        ("0.5", "missing-from-source"), ("12345678901234567890", "missing-from-target"), ("5", "matching"),
    ]


def test_number_texts(spark):
    df = spark.createDataFrame(
        [(7, 7.0, D("7.000"), -0.0), (0, 0.1, D("0.100"), float("nan")), (None, 1e300, D("0.001"), float("inf"))],
        "i bigint, d double, x decimal(10,3), o double",
    )
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rows = df.select(*[number_text(F.col(c), kinds[c]).alias(c) for c in df.columns]).collect()
    assert [r.i for r in rows] == ["7", "0", None]
    assert [r.d for r in rows][:2] == ["7", "0.1"] and [r.x for r in rows] == ["7", "0.1", "0.001"]
    assert [r.o for r in rows] == ["0", "NaN", "Infinity"]
    assert shared_type(T.LongType(), T.DecimalType(12, 2)) == T.DecimalType(21, 2)


def test_values_of_mixed_number_types(spark):
    source = spark.createDataFrame([(1, 9007199254740993), (2, 4)], "k int, v bigint")
    target = spark.createDataFrame([(1, 9007199254740992.0), (2, 4.0)], "k int, v double")
    found = {r.k: r.category for r in compare_rows(source, target, ["k"], [Pair("v", "v")]).collect()}
    assert found == {1: "matched-key-differing-values", 2: "matching"}


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/New_York"])
def test_instants_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.range(1).select(F.timestamp_micros(F.lit(1_700_000_000_123_456)).alias("t"))
        kind = T.TimestampType()
        shifted, _ = normalize(df.t, kind, Rule(timezone="America/New_York"))
        shown = df.select(as_text(df.t, kind), shifted.cast("string")).first()
        assert tuple(shown) == ("2023-11-14 22:13:20.123456", "2023-11-15 03:13:20.123456")
        dates = profile_date(df, "2023-11-14 22:13:19").first()
        assert dates.earliest_value == datetime.datetime(2023, 11, 14, 22, 13, 20, 123456) and dates.future_count == 1
        assert date_window(df, "t", "2023-11-14 22:13:20", "2023-11-14 22:13:21").count() == 1
        assert date_window(df, "t", "2023-11-14 22:13:21", "2023-11-15").count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_equal_maps_are_one_value(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1)")
    assert profile_general(df).first().distinct_count == 1


def test_duplicate_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, v string")
    assert sorted(r.v for r in duplicate_rows(df, ["k"]).collect()) == ["a", "b", "d", "e"]
    assert duplicate_rows(df.where("k = 2"), ["k"]).isEmpty() and duplicate_rows(df, ["k"]).columns == ["k", "v"]


def test_large_strata_shuffle_winners_only(spark):
    df = spark.range(40_000).select((F.col("id") % 2).alias("g"), F.col("id"))
    sample = stratified_sample(df, "g", 2000, "id")
    assert sample.groupBy("g").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).orderBy("g").collect() == [
        (0, 3998, 2000), (1, 3999, 2000),
    ]
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Scan")[0].split("Exchange")[-1]


def test_wall_clocks_that_occur_twice_or_not_at_all(spark):
    """The earlier instant of a doubled hour, and what a skipped hour would have been."""
    clocks = {
        "1995-10-29 00:30:00": "1995-10-29 04:30:00", "1995-10-29 01:13:20": "1995-10-29 05:13:20", "1995-10-29 02:00:00": "1995-10-29 07:00:00",
        "1996-10-27 01:59:59": "1996-10-27 05:59:59", "1996-04-07 01:59:59": "1996-04-07 06:59:59", "1996-04-07 02:13:20": "1996-04-07 07:13:20",
        "1996-04-07 03:00:00": "1996-04-07 07:00:00", "1997-04-06 02:30:00": "1997-04-06 07:30:00",
    }
    df = spark.createDataFrame([(k,) for k in clocks], "t string")
    wall = df.select("t", F.col("t").cast("timestamp_ntz").alias("w"))
    rule = Rule(timezone="America/New_York")
    value, _ = normalize(wall.w, T.TimestampNTZType(), rule)
    assert {r.t: str(r.v) for r in wall.select("t", value.alias("v")).collect()} == clocks
    text, _ = normalize(df.t, T.StringType(), rule)
    assert {r.t: r.v for r in df.select("t", text.alias("v")).collect()} == {k: v.replace(" ", "T") + ".000Z" for k, v in clocks.items()}
