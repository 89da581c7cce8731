"""Sketches and frequent shapes against exact counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.operators import sketches as S
from concord.operators.patterns import frequent_patterns, shape


@pytest.fixture(scope="module")
def peaked(spark):
    """Two peaks far apart, a hot value, NULLs and a part column with a NULL."""
    v = F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 2 == 0, F.col("id") * 1e-6).otherwise(1e9 + F.col("id"))
    part = F.when(F.col("id") % 7 > 0, F.concat(F.lit("p"), F.col("id") % 7))
    return spark.range(60_000).select(v.alias("v"), F.col("id").cast("string").alias("s"), part.alias("p"))


def test_distinct_counts_within_the_error_and_merged_like_the_whole(spark, peaked):
    whole = S.merge_sketches(S.sketch_columns(peaked, ["v", "s"]))
    merged = S.merge_sketches(S.sketch_columns(peaked, ["v", "s"], "p"))
    exact = {"v": peaked.select("v").distinct().count() - 1, "s": 60_000}
    for df in (whole, merged):
        for r in S.distinct_estimates(df).collect():
            assert r.low <= exact[r.column_name] <= r.high and r.high - r.low <= 2 * S.distinct_error() * r.distinct_estimate + 1
        told = {r.column_name: (r.row_count, r.present) for r in df.collect()}
        assert told == {"v": (60_000, 54_000), "s": (60_000, 60_000)}


def test_overlap_of_sides(spark, peaked):
    other = spark.range(30_000, 90_000).select(F.lit(7).alias("v"), F.col("id").cast("string").alias("s"))
    a, b = (S.merge_sketches(S.sketch_columns(df, ["v", "s"])) for df in (peaked, other))
    got = {r.column_name: r for r in S.distinct_overlap(a, b).collect()}
    s = got["s"]
    assert abs(s.shared - 30_000) <= s.error and abs(s.only_source - 30_000) <= s.error and abs(s.similarity - 1 / 3) < 0.05
    assert got["v"].shared <= 1 + got["v"].error


def test_equal_numbers_of_two_types_are_one_value(spark):
    a, b = (S.merge_sketches(S.sketch_columns(spark.range(900).select(F.col("id").cast(kind).alias("v")))) for kind in ("int", "double"))
    assert S.distinct_overlap(a, b).first().shared == 900


def test_quantiles_of_two_peaks(spark, peaked):
    merged = S.merge_sketches(S.sketch_columns(peaked, ["v"], "p"))
    values = np.sort(np.array([r.v for r in peaked.where("v IS NOT NULL").collect()]))
    for r in S.quantiles(merged, [0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0]).collect():
        low, high = (np.searchsorted(values, r.value, side) / len(values) for side in ("left", "right"))
        assert low - r.rank_error <= r.rank <= high + r.rank_error


def test_distance_of_distributions(spark, peaked):
    merged = S.merge_sketches(S.sketch_columns(peaked, ["v", "s"], "p"))
    for shift in (0.0, 0.2, 1.0):
        moved = peaked.select(F.when(F.col("s").cast("int") % 100 < shift * 100, F.col("v") - 1e12).otherwise(F.col("v")).alias("v"), "s")
        (r,) = S.distribution_distance(merged, S.merge_sketches(S.sketch_columns(moved, ["v", "s"]))).collect()
        a, b = (np.sort([x.v for x in df.where("v IS NOT NULL").collect()]) for df in (peaked, moved))
        at = np.concatenate([a, b])
        exact = np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max()
        assert r.column_name == "v" and abs(r.distance - exact) <= r.error


def test_odd_columns(spark):
    df = spark.createDataFrame([(None, float("nan"), "", None), (None, None, None, b"x")], "a double, b double, c string, d binary")
    merged = S.merge_sketches(S.sketch_columns(df))
    assert {r.column_name: r.distinct_estimate for r in S.distinct_estimates(merged).collect()} == {"a": 0, "b": 1, "c": 1, "d": 1}
    assert S.quantiles(merged, [0.5]).collect() == []
    none = S.merge_sketches(S.sketch_columns(df.limit(0)))
    assert {r.row_count for r in none.collect()} == {0} and S.distinct_estimates(none).where("distinct_estimate > 0").collect() == []
    full = S.merge_sketches(S.sketch_columns(spark.createDataFrame([(1.0, 2.0, "x", b"y")], df.schema)))
    assert {(r.column_name, r.distance) for r in S.distribution_distance(merged, full).collect()} == {("a", 1.0), ("b", 1.0)}
    assert {r.similarity for r in S.distinct_overlap(none, merged).where("column_name = 'a'").collect()} == {1.0}


def test_store_reads_new_parts_only(spark, tmp_path, peaked):
    root, data = f"{tmp_path}/store", f"{tmp_path}/data"
    assert S.stored_sketches(spark, root).collect() == []
    old = peaked.where("p IS NULL OR p < 'p4'")
    old.write.partitionBy("p").parquet(data)
    assert len(S.update_sketches(spark.read.parquet(data), root, "p", ["v", "s"])) == 4
    peaked.where("p >= 'p4'").write.partitionBy("p").mode("append").parquet(data)
    table = spark.read.parquet(data)
    assert sorted(S.update_sketches(table, root, "p", ["v", "s"])) == ["p4", "p5", "p6"]
    assert S.update_sketches(table, root, "p", ["v", "s"]) == []
    kept = S.merge_sketches(S.stored_sketches(spark, root))
    whole = S.merge_sketches(S.sketch_columns(table, ["v", "s"]))
    assert {r.column_name: r.row_count for r in kept.collect()} == {r.column_name: r.row_count for r in whole.collect()} == {"v": 60_000, "s": 60_000}
    for r in S.distinct_estimates(kept).where("column_name = 's'").collect():
        assert r.low <= 60_000 <= r.high
    assert S.update_sketches(table, root, "p", ["v", "s"], again=[None, "p4"]) in ([None, "p4"], ["p4", None])
    assert S.merge_sketches(S.stored_sketches(spark, root)).first().row_count == 60_000  # a part sketched again counts once


def test_shapes(spark):
    rows = ["Ab-12", "ÉÉté 9", "", " \t x", "漢字Ⅷ", "a+A", "ABCdef123"]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    assert [r[0] for r in df.select(shape(F.col("s"))).collect()] == ["Aa-9+", "A+a+ 9", "", " +a", "a+9", "a+A", "A+a+9+"]
    assert [r[0] for r in df.select(shape(F.col("s"), runs=False)).collect()][0] == "Aa-99"


def test_patterns_are_exact_among_many_rare_ones(spark):
    rare = F.concat(F.lit("x"), F.repeat(F.lit("-"), (F.col("id") % 997).cast("int")), F.lit("1"), F.repeat(F.lit("."), (F.col("id") % 13).cast("int")))
    value = F.when(F.col("id") % 3 == 0, "hot 1").when(F.col("id") % 25 == 1, "B2").when(F.col("id") % 11 == 0, None).otherwise(rare)
    df = spark.range(60_000).select(value.alias("s"), F.lit(None).cast("string").alias("none"), F.col("id"))
    for share in (0.03, 0.2, 1.0):
        exact = df.where("s IS NOT NULL").groupBy(shape(F.col("s")).alias("pattern")).count().collect()
        n = sum(r["count"] for r in exact)
        got = {r.pattern: r.value_count for r in frequent_patterns(df, share).collect()}
        assert got == {r.pattern: r["count"] for r in exact if r["count"] >= share * n}
    assert frequent_patterns(df.limit(0)).collect() == [] and frequent_patterns(df.select("id")).collect() == []
    with pytest.raises(ValueError):
        frequent_patterns(df, 0)
