"""Merkle fixity audit of archived web records.

A manifest lays records into archive files of SEGMENT records each and states
every record's offset, length and SHA-256. Leaves are records in archive
order; a node of the next level digests the digests of FANOUT neighbours, that
is, of one ordered offset range. Two replicas are compared from the root down,
and only the branches that differ are opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.operators.skew import global_rank
from concord.session import pinned

FANOUT = 16
SEGMENT = 4096


def warc_record(url: Column, body: Column) -> Column:
    """The stored text of a resource record; NULL parts count as empty."""
    content = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(content).cast("string"),
        F.lit("\r\n\r\n"),
        content,
        F.lit("\r\n\r\n"),
    )


def lay_out(records: DataFrame, order: list[str], size: str, segment: int = SEGMENT) -> DataFrame:
    """Add (ordinal, segment, offset): archive order by the given columns, NULLs first.

    Positions come from a range-partitioned order, offsets from a running sum
    within an archive file, which holds ``segment`` records at most.
    """
    ranked = global_rank(records, order, "ordinal").withColumn("segment", F.expr(f"ordinal DIV {segment}"))
    running = Window.partitionBy("segment").orderBy("ordinal")
    return ranked.withColumn("offset", F.sum(size).over(running) - F.col(size))


def levels(leaves: DataFrame, top: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Trees as (node, digest) by level, leaves first, up to the level whose only node is the root."""
    leaf = F.sha2(F.concat_ws(":", F.col("length").cast("string"), "digest"), 256)
    found = [leaves.select(F.col("ordinal").alias("node"), leaf.alias("digest"))]
    for _ in range(top):
        children = F.sort_array(F.collect_list(F.struct("node", "digest")))  # fanout members at most
        text = F.concat_ws("", F.transform(children, lambda x: F.concat_ws(":", (x["node"] % fanout).cast("string"), x["digest"])))
        parents = found[-1].groupBy(F.expr(f"node DIV {fanout}").alias("parent")).agg(F.sha2(text, 256).alias("digest"))
        found.append(pinned(parents.withColumnRenamed("parent", "node")))
    return found


def audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Ordinals whose records differ: (ordinal, problem).

    Both sides have (ordinal, length, digest), one row per ordinal. ``problem``
    is ``changed`` (other bytes), ``length`` (another length), ``missing`` (no
    such record on the right) or ``extra`` (none on the left). Equal roots, as
    of two empty sides, give no row; nothing below an equal node is read again.
    """
    left, right = (pinned(x.select("ordinal", "length", "digest")) for x in (left, right))
    last = left.select("ordinal").union(right.select("ordinal")).agg(F.max("ordinal")).head()[0]
    top = 0
    while last is not None and last >= fanout**top:
        top += 1
    trees = [levels(x, top, fanout) for x in (left, right)]
    frontier = None
    for level in range(top, -1, -1):
        a, b = (t[level] for t in trees)
        if frontier is not None:
            opened = frontier.select(F.col("node").alias("open"))
            a, b = (x.join(opened, F.expr(f"node DIV {fanout}") == F.col("open"), "left_semi") for x in (a, b))
        a = a.withColumnRenamed("digest", "here")
        b = b.withColumnRenamed("digest", "there")
        differ = a.join(b, "node", "full_outer").where(~F.col("here").eqNullSafe(F.col("there")))
        frontier = pinned(differ.select("node"))
    spots = frontier.withColumnRenamed("node", "ordinal")
    pairs = spots.join(left, "ordinal", "left").join(
        right.select("ordinal", F.col("length").alias("found_length"), F.col("digest").alias("found_digest")), "ordinal", "left"
    )
    problem = (
        F.when(F.col("found_digest").isNull(), "missing")
        .when(F.col("digest").isNull(), "extra")
        .when(F.col("length") != F.col("found_length"), "length")
        .otherwise("changed")
    )
    return pairs.select("ordinal", problem.alias("problem"), "digest", "found_digest", "found_length")
