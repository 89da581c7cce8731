"""Proportional stratified interleaving: every shard carries the mixture of the whole.

Rows take a seeded-shuffled rank within their stratum. All strata are then laid
side by side by fractional rank (rank + 1/2 over the stratum's size) and the
combined order is cut into shards of equal row counts. Both ranks are exact
positions in a range-partitioned order, so no stratum, however large, is ranked
by one task; only keys, sizes and checksums move, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.common import category
from concord.operators.skew import global_rank

SEED = "shards-1"
OVERHEAD = 8  # bytes that a stored row takes besides its text


def _rows(docs: DataFrame, key: str, stratum: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("key"),
        category(F.col(stratum)).alias("stratum"),
        (F.octet_length(body).cast("long") + OVERHEAD).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("text_hash"),
    )


def interleave(
    docs: DataFrame,
    shards: int,
    key: str = "doc_id",
    stratum: str = "source",
    text: str = "text",
    seed: str = SEED,
) -> DataFrame:
    """One row (key, stratum, size, text_crc32, text_hash, shard, slot) for each row of ``docs``.

    The law is ``rows``: shard sizes differ by one row at most, and slots count
    from 0 without gaps. Within a shard every stratum has its share of rows to
    within a row or two. NULL keys and texts are rows like any other (a NULL
    text has the size of an empty one), NULL is a stratum of its own, repeated
    rows each take a slot, an empty table gives no row. Other columns of
    ``docs`` are not read.
    """
    shuffled = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("key").cast("string"), F.lit(""))))
    rows = _rows(docs, key, stratum, text).withColumn("shuffled", shuffled)
    ranked = global_rank(rows, ["stratum", "shuffled", "key", "text_crc32", "text_hash", "size"], "drawn")
    strata = ranked.groupBy("stratum").agg(F.min("drawn").alias("first"), F.count(F.lit(1)).alias("members"))
    fraction = (F.lit(2) * (F.col("drawn") - F.col("first")) + 1) / (F.lit(2.0) * F.col("members"))
    mixed = ranked.join(strata, "stratum").select(*rows.columns, "drawn", fraction.alias("fraction"))
    placed = global_rank(mixed.drop("shuffled"), ["fraction", "stratum", "drawn"], "position")
    total = ranked.count()
    shard = F.expr(f"CAST(position * {shards} DIV {max(total, 1)} AS INT)")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) DIV {shards}")
    return placed.withColumn("shard", shard).select(
        "key", "stratum", "size", "text_crc32", "text_hash", "shard", (F.col("position") - first).alias("slot")
    )


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", stratum: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``shard`` and ``slot`` added (replacing columns of these names).

    Equal rows are told apart by an occurrence number on both sides.
    """
    copies = Window.partitionBy("__key", "__hash").orderBy("__order")
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    placed = interleave(docs, shards, key, stratum, text).select(
        F.col("key").alias("__key"), F.col("text_hash").alias("__hash"), "stratum", "shard", "slot"
    )
    left = docs.select(
        *names,
        F.col(key).alias("__key"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__hash"),
        category(F.col(stratum)).alias("__order"),
    ).withColumn("__copy", F.row_number().over(copies))
    right = placed.withColumnRenamed("stratum", "__order").withColumn("__copy", F.row_number().over(copies))
    right = right.select(
        F.col("__key").alias("__rkey"), F.col("__hash").alias("__rhash"), F.col("__copy").alias("__rcopy"), "shard", "slot"
    )
    on = (
        F.col("__key").eqNullSafe(F.col("__rkey"))
        & (F.col("__hash") == F.col("__rhash"))
        & (F.col("__copy") == F.col("__rcopy"))
    )
    return left.join(right, on).select(*names, "shard", "slot")
