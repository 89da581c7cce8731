"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.session import pinned

LINKS_PER_TASK = 200_000  # a few MB of pairs of numbers


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).head())


def _with_least(sides: DataFrame) -> DataFrame:
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return sides.join(least, F.col("a") == F.col("u"))


def _star(links: DataFrame, large: bool, few: bool) -> DataFrame:
    """Tie the neighbours of every node to the smallest of them.

    The large star moves neighbours above a node, the small star the node
    and its neighbours below. Minima fold on the map side; the join that brings
    them back to the links can be split by Spark where a node has very many. A
    ``few`` links lie in one partition, where a window needs no shuffle.
    """
    if large:
        both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        sides = links.select(F.inline(both))
    else:
        sides = links
    if few:
        joined = sides.withColumn("m", F.least("a", F.min("b").over(Window.partitionBy("a"))))
    else:
        joined = _with_least(sides)
    if large:
        found = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = F.explode(F.array(F.col("b"), F.col("a")))
        found = joined.select(moved.alias("a"), F.col("m").alias("b"))
    return found.where(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of a link table (a, b), roots included, with the least node reachable.

    Alternating large and small stars keep every set connected and end after
    few rounds, when each node hangs on its root. Each round is pinned in the
    shared folder. Up to ``LINKS_PER_TASK`` links are one partition, so that a
    round over few of them is one task rather than a row of shuffles; more keep
    the session's partitions. No links give no rows; links of a node to itself
    and repeated links change nothing.
    """
    ordered = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    found = pinned(ordered.distinct())
    before = _state(found)
    while True:
        few = before[0] <= LINKS_PER_TASK
        sized = found.coalesce(1) if few else found
        found = pinned(_star(_star(sized, True, few), False, few))
        now = _state(found)
        if now == before:
            break
        before = now
    roots = found.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return found.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
