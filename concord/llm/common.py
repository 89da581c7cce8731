"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"  # fixed value: a word is a run of anything but ASCII white space


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, n: int) -> Column:
    """crc32 of a key's text modulo n; a NULL key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n


def category(value: Column) -> Column:
    """A text that tells NULL, the empty text and every other value apart."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def unit_interval(seed: str, key: Column) -> Column:
    """A repeatable number in [0, 1) from a seed and a key, with 52 random bits."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
