import pytest
from pyspark.sql import functions as F

from concord.functions.normalize import Tolerance
from concord.operators import sampling
from concord.operators.volume import ALL_ROWS, compare_volume, volume_by_dimension
from seeded import pair


def test_first_n(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("v"))
    assert [r.v for r in sampling.first_n(df, 3, "v").collect()] == [0, 1, 2]
    assert sampling.first_n(df, 5).count() == 5


def test_random_is_bounded_and_without_repeats(spark):
    df = spark.range(10_000)
    drawn = [r.id for r in sampling.random_sample(df, 100, seed=1).collect()]
    assert len(drawn) == len(set(drawn)) == 100
    assert sampling.random_sample(df.limit(7), 100).count() == 7


def test_hash_buckets_are_disjoint_and_complete(spark):
    df = spark.range(1_000).select(F.concat(F.lit("k"), "id").alias("k"))
    buckets = [{r.k for r in sampling.hash_sample(df, "k", 4, b).collect()} for b in range(4)]
    assert sum(map(len, buckets)) == 1_000 == len(set().union(*buckets)) and all(buckets)
    again = {r.k for r in sampling.hash_sample(df.repartition(7), "k", 4, 2).collect()}
    assert again == buckets[2]


@pytest.mark.parametrize("partitions", [1, 8])
def test_stratified(spark, partitions):
    df = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("s"), "id")
    found = {}
    for r in sampling.stratified_sample(df.repartition(partitions), "s", 4, "id").collect():
        found.setdefault(r.s, []).append(r.id)
    assert sorted(found["hot"]) == [0, 3, 6, 9] and {len(v) for v in found.values()} == {4} and len(found) == 6


def test_stratified_with_copies_and_null_stratum(spark):
    df = spark.sql("SELECT CAST(NULL AS STRING) AS s, 1 AS v FROM range(50)").repartition(5)
    assert sampling.stratified_sample(df, "s", 7, "v").count() == 7


def test_windows_include_both_ends(spark):
    df = spark.sql("SELECT id, TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(CAST(id AS INT)) AS t FROM range(10)")
    assert sampling.date_window(df, "t", "2024-01-03", "2024-01-05").count() == 3
    assert [r.id for r in sampling.key_range(df, "id", 2, 4).collect()] == [2, 3, 4]
    source, _ = pair(spark, "orders")
    assert sorted(r.ORDER_ID for r in sampling.key_range(source, "ORDER_ID", 102, 104).collect()) == [102, 103, 104]
    assert source.where("ORDER_STATUS >= 'A'").count() == sampling.key_range(source, "ORDER_STATUS", "A", "Z").count()


def test_bad_parameters(spark):
    df = spark.range(3)
    for call in (
        lambda: sampling.first_n(df, 0),
        lambda: sampling.first_n(df, 1.5),
        lambda: sampling.random_sample(df, -1),
        lambda: sampling.hash_sample(df, "id", 0, 0),
        lambda: sampling.hash_sample(df, "id", 4, 4),
        lambda: sampling.hash_sample(df, "id", 4, -1),
        lambda: sampling.stratified_sample(df, "id", 0),
        lambda: sampling.key_range(df, "id", float("inf"), 3),
    ):
        with pytest.raises(ValueError):
            call()


def volume(spark, source, target, tolerance=None):
    return compare_volume(spark.range(source), spark.range(target), tolerance).first()


def test_worked_volume_example(spark):
    row = volume(spark, 12_405_128, 12_402_991, Tolerance(percentage=0.01))
    assert (row.difference, row.severity) == (-2_137, "Failure")
    assert row.difference_rate == pytest.approx(-0.01723, abs=1e-5)
    assert row.message == (
        "Row count: source 12,405,128, target 12,402,991, difference -2,137 (-0.0172%), "
        "evaluated against 0.0100% tolerance: FAIL."
    )


@pytest.mark.parametrize(
    ("source", "target", "tolerance", "severity"),
    [
        (5, 5, None, "Pass"),
        (5, 4, None, "Failure"),
        (5, 4, Tolerance(absolute=1), "Informational"),
        (5, 3, Tolerance(absolute=1), "Failure"),
        (5, 4, Tolerance(percentage=10, absolute=5), "Failure"),
        (0, 4, Tolerance(percentage=1), "Informational"),
        (0, 4, None, "Failure"),
        (0, 0, None, "Pass"),
    ],
)
def test_volume_severity(spark, source, target, tolerance, severity):
    assert volume(spark, source, target, tolerance).severity == severity


def test_seeded_volumes(spark):
    found = {n: compare_volume(*pair(spark, n)).first() for n in ("customer", "orders")}
    assert (found["customer"].difference, round(found["customer"].difference_rate, 4)) == (1, 16.6667)
    assert (found["orders"].difference, found["orders"].difference_rate) == (-1, -20.0)


COUNTED = "flag string, day int"


def by_dimension(spark, source, target, **options):
    sides = [spark.createDataFrame(rows, COUNTED) for rows in (source, target)]
    found = volume_by_dimension(*sides, [("flag", "flag"), ("day", "day")], **options).collect()
    return {(r.dimension, r.dimension_value): (r.category, r.source_rows, r.target_rows, r.severity) for r in found}


def test_counts_by_dimension(spark):
    source = [("a", 1), ("a", 1), ("a", 2), ("b", 2), (None, 3), ("", None)]
    target = [("a", 1), ("a", 2), ("b", 2), ("b", 2), (None, 4), ("", None)]
    assert by_dimension(spark, source, target, tolerances={"flag": Tolerance(absolute=1)}) == {
        (ALL_ROWS, None): ("matching", 6, 6, "Pass"),
        ("flag", "a"): ("differing-counts", 3, 2, "Informational"),
        ("flag", "b"): ("differing-counts", 1, 2, "Informational"),
        ("flag", None): ("matching", 1, 1, "Pass"),
        ("flag", ""): ("matching", 1, 1, "Pass"),
        ("day", "1"): ("differing-counts", 2, 1, "Failure"),
        ("day", "2"): ("differing-counts", 2, 3, "Failure"),
        ("day", "3"): ("missing-from-target", 1, 0, "Failure"),
        ("day", "4"): ("missing-from-source", 0, 1, "Failure"),
        ("day", None): ("matching", 1, 1, "Pass"),
    }


def test_counts_of_empty_sides(spark):
    assert by_dimension(spark, [], []) == {(ALL_ROWS, None): ("matching", 0, 0, "Pass")}
    found = by_dimension(spark, [], [("a", None)], tolerance=Tolerance(absolute=9))
    assert found[("flag", "a")] == ("missing-from-source", 0, 1, "Failure") and found[(ALL_ROWS, None)][3] == "Informational"
    assert ("day", None) in found and len(found) == 3


def test_a_tolerance_needs_its_dimension(spark):
    with pytest.raises(ValueError, match="no dimension"):
        by_dimension(spark, [], [], tolerances={"other": Tolerance(absolute=1)})
    with pytest.raises(ValueError, match="target side"):
        volume_by_dimension(spark.range(1), spark.range(1), [("id", "gone")])


def test_counts_take_one_shuffle_of_folded_rows(spark, tmp_path):
    hot = spark.range(200_000).select(F.lit(1).alias("part"), F.when(F.col("id") > 10, F.lit("hot")).alias("flag"), "id")
    for side in ("source", "target"):
        hot.write.partitionBy("part").parquet(str(tmp_path / side))
    sides = [spark.read.parquet(str(tmp_path / side)) for side in ("source", "target")]
    found = volume_by_dimension(*sides, [("part", "part"), ("flag", "flag")])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ReadSchema: struct<flag:string>" in plan
    rows = {(r.dimension, r.dimension_value): (r.source_rows, r.target_rows) for r in found.collect()}
    assert rows == {(ALL_ROWS, None): (200_000,) * 2, ("part", "1"): (200_000,) * 2, ("flag", "hot"): (199_989,) * 2, ("flag", None): (11, 11)}
    parts = volume_by_dimension(*sides, [("part", "part")])._jdf.queryExecution().executedPlan().toString()
    assert parts.count("ReadSchema: struct<>") == 2


def test_dimensions_of_two_number_types(spark):
    source = spark.createDataFrame([(1,), (2,)], "day int")
    target = spark.createDataFrame([(1.0,), (2.5,)], "day double")
    found = {(r.dimension, r.category) for r in volume_by_dimension(source, target, [("day", "day")]).collect()}
    assert found == {(ALL_ROWS, "matching"), *(("day", c) for c in ("matching", "missing-from-source", "missing-from-target"))}
