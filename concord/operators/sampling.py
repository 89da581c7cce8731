"""Comparable samples of a DataFrame."""

from __future__ import annotations

import math
from datetime import datetime, timezone
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators.skew import best_rows

PLACE = "__place"  # helper column, dropped from the result


def _positive(value: int, name: str) -> None:
    if not isinstance(value, int) or isinstance(value, bool) or value <= 0:
        raise ValueError(f"{name} must be a positive integer; got {value}")


def first_n(df: DataFrame, n: int, order_by: str | None = None, tie_break: Sequence[str] = ()) -> DataFrame:
    """The first n rows, in order of a column if one is given."""
    _positive(n, "n")
    return (df.orderBy(order_by, *tie_break) if order_by else df).limit(n)


def random_sample(df: DataFrame, sample_size: int, seed: int | None = None) -> DataFrame:
    """At most ``sample_size`` random rows.

    A Bernoulli draw a little above the wanted size comes first, so that the
    final top-k sees about ``sample_size`` rows and not that many per partition.
    """
    _positive(sample_size, "sample_size")
    rows = max(1, df.count())
    fraction = min(1.0, (sample_size + 8 * math.sqrt(sample_size) + 64) / rows)
    drawn = df if fraction == 1.0 else df.sample(fraction, seed)
    return drawn.orderBy(F.rand(seed)).limit(sample_size)


def hash_bucket(key: Column, modulus: int) -> Column:
    """Stable bucket of a key: 60 bits of its md5, modulo."""
    bits = F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("bigint")
    return F.pmod(bits, F.lit(modulus).cast("bigint"))


def hash_sample(df: DataFrame, key: str, modulus: int, bucket: int) -> DataFrame:
    """The rows of one of ``modulus`` disjoint buckets; same keys on any side."""
    _positive(modulus, "modulus")
    if not isinstance(bucket, int) or not 0 <= bucket < modulus:
        raise ValueError(f"bucket must be an integer in [0, {modulus}); got {bucket}")
    return df.where(hash_bucket(F.col(key), modulus) == bucket)


def stratified_sample(
    df: DataFrame, stratify_by: str, per_stratum: int, order_by: str | None = None, tie_break: Sequence[str] = ()
) -> DataFrame:
    """At most ``per_stratum`` rows of each value of a column.

    Rows rank by the given columns; equal ones are interchangeable.
    """
    _positive(per_stratum, "per_stratum")
    order = [F.col(c) for c in dict.fromkeys([order_by or stratify_by, *tie_break])]
    return best_rows(df, stratify_by, order, per_stratum, PLACE).drop(PLACE)


def date_window(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows whose date lies between two timestamps, both included; instants are meant in UTC."""
    kind = df.schema[column].dataType.simpleString()
    if kind == "timestamp":
        low, high = (F.lit(datetime.fromisoformat(v).replace(tzinfo=timezone.utc)) for v in (start, end))
        return df.where(F.col(column).between(low, high))
    low, high = (F.lit(v).cast("timestamp_ntz").cast(kind if kind != "string" else "timestamp_ntz") for v in (start, end))
    return df.where(F.col(column).between(low, high))


def key_range(df: DataFrame, key: str, start: float | int | str, end: float | int | str) -> DataFrame:
    """Rows whose key lies between two bounds, both included."""
    for bound in (start, end):
        if isinstance(bound, float) and not math.isfinite(bound):
            raise ValueError(f"a key bound must be a finite number; got {bound}")
    return df.where(F.col(key).between(F.lit(start), F.lit(end)))
