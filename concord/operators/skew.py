"""Helpers that keep one hot key, or one huge order, from landing in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.session import pinned

HOT_ROWS = 1_000_000
BROADCAST_KEYS = 100_000
BROADCAST_BYTES = 64 << 20  # of those keys, as text
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
BLOCK = 10_000
SALTS = 64
POSITION_BITS = 33  # monotonically_increasing_id keeps the row position in these


def match_keys(df: DataFrame, keyset: DataFrame, keys: list[str], how: str, broadcast: bool = False) -> DataFrame:
    """Rows whose key is (left_semi) or is not (left_anti) in a key set; NULLs match."""
    renamed = keyset.select(*[F.col(k).alias(f"{k}__key") for k in keys])
    on = reduce(Column.__and__, (df[k].eqNullSafe(renamed[f"{k}__key"]) for k in keys))
    return df.join(F.broadcast(renamed) if broadcast else renamed, on, how)


def hot_keys(df: DataFrame, keys: list[str], min_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with at least ``min_rows`` rows, or None if there are none.

    Only keys are read, and their counts fold on the map side. The few that
    remain are pinned, so that every later use sees the same ones.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__copies")).where(F.col("__copies") >= min_rows)
    found = pinned(counted.select(*keys))
    return None if found.isEmpty() else found


def split_hot(df: DataFrame, hot: DataFrame | None, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys and rows of hot keys.

    Few hot keys, which is what to expect, are broadcast; more of them are left
    to a join that Spark splits at run time.
    """
    if hot is None:
        return df, None
    width = F.coalesce(F.sum(F.length(F.to_json(F.struct(*keys)))), F.lit(0))
    n, size = hot.limit(BROADCAST_KEYS + 1).agg(F.count(F.lit(1)), width).first()
    few = n <= BROADCAST_KEYS and size <= BROADCAST_BYTES
    return match_keys(df, hot, keys, "left_anti", few), match_keys(df, hot, keys, "left_semi", few)


def expand(df: DataFrame, count: str, by: list[str]) -> DataFrame:
    """Repeat each row ``count`` times; a large count is spread over many tasks."""
    blocks = df.withColumn("block", F.explode(F.sequence(F.lit(0), F.col(count) - 1, F.lit(BLOCK))))
    spread = blocks.repartition(*by, "block")
    last = F.least(F.col(count), F.col("block") + BLOCK) - 1
    return spread.withColumn("copy", F.explode(F.sequence(F.col("block"), last))).drop("block", "copy")


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Exact zero-based position in a total order, without a one-task window.

    Rows are range-partitioned and sorted, and their positions within each
    partition pinned; the few partition sizes give the offsets.
    """
    local = F.monotonically_increasing_id()
    pinned_rows = pinned(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", local))
    part = F.shiftrightunsigned("place", POSITION_BITS)
    rows = pinned_rows.withColumn("part", part)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("size"))  # one row per partition
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    position = F.col("place").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)) + F.col("offset")
    return rows.join(F.broadcast(offsets), "part").withColumn(name, position).drop("part", "place", "offset")


def best_rows(df: DataFrame, group: str, order: list[Column], n: int, place: str) -> DataFrame:
    """The first n rows of each group with their places, counted from one.

    Winners are found per input partition, then per group of partitions, then
    overall, so a group that holds most of the rows is ranked by many tasks
    and no task sees more than the winners of the step before. Spark cuts each
    partition to its winners before it shuffles, up to a limit that this raises
    to n for the session.
    """
    conf = df.sparkSession.conf
    if int(conf.get(GROUP_LIMIT)) < n:
        conf.set(GROUP_LIMIT, str(n))
    found = df.withColumn("__salt", F.spark_partition_id())
    for part in (F.col("__salt"), F.col("__salt") % SALTS, F.lit(0)):
        ranking = Window.partitionBy(group, part).orderBy(*order)
        found = found.withColumn(place, F.row_number().over(ranking)).where(F.col(place) <= n)
    return found.drop("__salt")
