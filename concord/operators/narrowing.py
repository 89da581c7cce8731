"""Progressive narrowing: from digests of large parts down to the rows that differ.

Each level compares order-free digests of the parts that are left: partition
values first, then ranges of the first key column, cut anew at every level from
a sample of the keys still in question. The unequal parts become a predicate on
the columns themselves, so that it reaches the scan, and what was equal once is
not read again. The last level compares rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.normalize import Rule
from concord.operators.hashing import HashSpec, _both_sides, _side_digest, _side_rows, _side_sums, _with_lanes, hash_row_compare
from concord.operators.rows import Pair, as_pairs, compare_rows, key_columns, key_name, target_key
from concord.operators.skew import match_keys
from concord.session import pinned

FANOUT = 64  # ranges that one level cuts
SAMPLED = 16  # sampled keys for each of them
MAX_PARTS = 1000  # unequal partition values that a predicate names
ROW_GOAL = 100_000  # rows that are compared without more levels
SHRINK = 0.7  # a level that leaves more of its rows than this is the last
RANGE_TYPES = (T.IntegralType, T.DecimalType, T.StringType, T.DateType, T.TimestampNTZType)


@dataclass(frozen=True)
class Level:
    """What one level read: parts and rows of both sides, and how many of each were unequal."""

    name: str
    parts: int
    unequal: int
    rows: int
    unequal_rows: int


@dataclass(frozen=True)
class Narrowing:
    """Differing keys with their categories, the levels that led there, and the sides as the last level reads them."""

    result: DataFrame
    levels: tuple[Level, ...]
    source: DataFrame
    target: DataFrame


@dataclass(frozen=True)
class _Digests:
    level: Level
    unequal: list  # rows (value, low, high)


def _digests(source: DataFrame, target: DataFrame, spec: HashSpec, left: list[Column], right: list[Column], value: Column, key: str, name: str) -> _Digests:
    """Digests of both sides by ``value``; at most MAX_PARTS + 1 unequal parts come back."""
    tagged = _with_lanes(_both_sides(source, target, spec, left, right), "row_hash").withColumn("value", value)
    bounds = [F.min(key).alias("low"), F.max(key).alias("high")]
    parts = tagged.groupBy("value").agg(*_side_rows(), *_side_sums(), *bounds)
    rows = F.col("source_rows") + F.col("target_rows")
    unequal = _side_digest("source") != _side_digest("target")
    told = parts.select("value", "low", "high", rows.alias("rows"), unequal.alias("unequal"))
    told = pinned(told)  # a row for each part, read for the totals and again for the unequal ones
    sums = [F.count(F.lit(1)), F.count_if("unequal"), F.sum("rows"), F.sum(F.when(F.col("unequal"), F.col("rows")))]
    level = Level(name, *[n or 0 for n in told.agg(*sums).first()])
    return _Digests(level, told.where("unequal").select("value", "low", "high").limit(MAX_PARTS + 1).collect())


def _sides(frames, columns: Sequence[str], test) -> list[DataFrame]:
    """Both sides where a test of their own column holds."""
    return [df.where(test(df[c], df.schema[c].dataType)) for df, c in zip(frames, columns)]


def _any(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests, F.lit(False))


def _cuts(frames, left: list[Column], right: list[Column], key: str, fanout: int) -> list:
    """Ascending keys that cut a sample of both sides into ranges of like size."""
    keys = frames[0].select(*left).unionByName(frames[1].select(*right)).select(key).where(F.col(key).isNotNull())
    drawn = keys.orderBy(F.xxhash64(key, F.monotonically_increasing_id())).limit(fanout * SAMPLED).distinct()
    found = sorted(r[0] for r in drawn.collect())  # a bounded sample
    return sorted({found[len(found) * i // fanout] for i in range(fanout)}) if found else []


def narrow_differences(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    mapping: Sequence[Pair | tuple[str, str]],
    rules: Mapping[str, Rule] | None = None,
    partition_column: str | None = None,
    float_scale: int | None = None,
    fanout: int = FANOUT,
    row_goal: int = ROW_GOAL,
    max_levels: int = 6,
) -> Narrowing:
    """Keys whose rows differ between the sides, as ``compare_rows`` classifies them, found by descent.

    The levels run when this is called; the comparison of the rows that are left
    runs when the result is read. A key whose rows are alike on both sides, also
    if it is repeated, is equal; all others come as ``compare_rows`` gives them.
    ``partition_column`` must be the same for all rows of a key on a side; leave
    it out otherwise. Ranges need a first key of one whole-number, decimal, text,
    date or zoneless time type on both sides, and are left out for others. NULL
    keys, and NULL partition values, are parts of their own. Differences spread
    over all ranges end the descent early. Empty sides give no rows.
    """
    pairs, rules = as_pairs(mapping), rules or {}
    columns = tuple(dict.fromkeys([*keys, *[p.source for p in pairs]]))
    spec = HashSpec(columns, tuple(pairs), rules, float_scale)
    frames, levels = [source, target], []

    if partition_column:
        names = [partition_column, target_key(partition_column, pairs)]
        left, right, families = key_columns(source, target, [partition_column], pairs)
        if not families:
            part = key_name(partition_column)
            found = _digests(*frames, spec, left, right, F.col(part), part, "partition")
            levels.append(found.level)
            if found.level.unequal <= MAX_PARTS:
                values = [r.value for r in found.unequal]
                some = [v for v in values if v is not None]

                def test(column: Column, dtype: T.DataType) -> Column:
                    inside = column.isin(some) if some else F.lit(False)
                    return inside | column.isNull() if len(some) < len(values) else inside

                frames = _sides(frames, names, test)

    left, right, families = key_columns(source, target, keys[:1], pairs)
    key, names = key_name(keys[0]), [keys[0], target_key(keys[0], pairs)]
    kind = source.select(*left).schema[key].dataType
    while not families and isinstance(kind, RANGE_TYPES) and len(levels) < max_levels:
        if levels and levels[-1].unequal_rows <= row_goal:
            break
        cuts = _cuts(frames, left, right, key, fanout)
        if not cuts:
            break
        bounds = F.array(*[F.lit(c).cast(kind) for c in cuts])
        value = F.when(F.col(key).isNotNull(), F.size(F.filter(bounds, lambda c: c <= F.col(key))))
        found = _digests(*frames, spec, left, right, value, key, f"range {len(levels)}")
        levels.append(found.level)

        def test(column: Column, dtype: T.DataType) -> Column:
            own = [column.between(r.low, r.high) if r.value is not None else column.isNull() for r in found.unequal]
            return _any(own)

        frames = _sides(frames, names, test)
        if found.level.unequal_rows > SHRINK * found.level.rows or all(r.low == r.high for r in found.unequal):
            break

    named = [key_name(k) for k in keys]
    unlike = hash_row_compare(*frames, spec, keys).select(*named).distinct()
    compared = compare_rows(*frames, keys, pairs, rules).where(F.col("category") != "matching")
    return Narrowing(match_keys(compared, unlike, named, "left_semi"), tuple(levels), *frames)
