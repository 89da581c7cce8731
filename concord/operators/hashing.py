"""Hash comparison at table, partition, key-range, row and column level."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from concord.functions.digest import LANES, LIMBS, canonical_text, digest, lanes, limbs, row_hash
from concord.functions.normalize import Rule, normalize
from concord.functions.values import family, shared_type
from concord.operators.rows import Pair, as_pairs, key_columns, key_name, require, target_key
from concord.operators.skew import HOT_ROWS, global_rank, hot_keys, split_hot

LEVELS = ("table", "partition", "key-range", "row", "column")


@dataclass(frozen=True)
class HashComparison:
    """One-row verdict and the mismatches behind it (None at table level)."""

    level: str
    result: DataFrame
    mismatches: DataFrame | None


@dataclass(frozen=True)
class HashSpec:
    """What both sides hash: compared columns, their rules and how they pair."""

    columns: tuple[str, ...]
    pairs: tuple[Pair, ...]
    rules: Mapping[str, Rule]
    float_scale: int | None

    def target_name(self, column: str) -> str:
        return target_key(column, list(self.pairs))


def hash_texts(df: DataFrame, other: DataFrame, spec: HashSpec, side: str) -> list[Column]:
    """Canonical text of each compared column of one side."""
    name = (lambda c: c) if side == "source" else spec.target_name
    facing = spec.target_name if side == "source" else (lambda c: c)
    require(df, [name(c) for c in spec.columns], side)
    texts = []
    for c in spec.columns:
        rule = spec.rules.get(spec.target_name(c))
        own, own_type = normalize(df[name(c)], df.schema[name(c)].dataType, rule)
        _, other_type = normalize(other[facing(c)], other.schema[facing(c)].dataType, rule)
        texts.append(canonical_text(own, own_type, other_type, rule, spec.float_scale))
    return texts


def hash_rows(df: DataFrame, columns: Sequence[str], rules: Mapping[str, Rule] | None = None, float_scale=None):
    """The rows of one side with the hash of their compared columns."""
    spec = HashSpec(tuple(columns), (), rules or {}, float_scale)
    return df.withColumn("row_hash", row_hash(hash_texts(df, df, spec, "source")))


def _both_sides(source, target, spec, left: list[Column], right: list[Column]) -> DataFrame:
    """Both sides' rows as (extra columns, row_hash, in_source)."""
    require(target, [spec.target_name(c) for c in spec.columns], "target")
    require(source, spec.columns, "source")
    names = [f"text{i}" for i in range(len(spec.columns))]
    sides = []
    for df, other, extra, side in ((source, target, left, "source"), (target, source, right, "target")):
        # The texts are columns of their own first, because the hash refers to each of them twice.
        texts = df.select(*extra, *[t.alias(n) for t, n in zip(hash_texts(df, other, spec, side), names)])
        hashed = texts.withColumn("row_hash", row_hash([F.col(n) for n in names])).drop(*names)
        sides.append(hashed.withColumn("in_source", F.lit(side == "source")))
    return sides[0].unionByName(sides[1])


def _with_lanes(df: DataFrame, hashed: str, prefix: str = "") -> DataFrame:
    names = [f"{prefix}lane{i}" for i in range(LANES)]
    return df.withColumns(dict(zip(names, lanes(F.col(hashed)))))


def _sides() -> dict[str, Column]:
    return {"source": F.col("in_source"), "target": ~F.col("in_source")}


def _side_rows() -> list[Column]:
    return [F.count_if(mine).alias(f"{side}_rows") for side, mine in _sides().items()]


def _side_sums(prefix: str = "") -> list[Column]:
    """Limb sums per side, as aggregates of tagged rows."""
    return [
        F.sum(F.when(mine, limb)).alias(f"{side}_{prefix}sum{n}")
        for side, mine in _sides().items()
        for n, limb in enumerate(limb for i in range(LANES) for limb in limbs(F.col(f"{prefix}lane{i}")))
    ]


def _merged_sums(prefixes: Sequence[str] = ("",)) -> list[Column]:
    """The same columns, from partial rows that already hold them."""
    parts = ["rows", *[f"{p}sum{i}" for p in prefixes for i in range(LANES * LIMBS)]]
    return [F.sum(f"{side}_{part}").alias(f"{side}_{part}") for side in _sides() for part in parts]


def _side_digest(side: str, prefix: str = "") -> Column:
    return digest(F.col(f"{side}_rows"), [F.col(f"{side}_{prefix}sum{i}") for i in range(LANES * LIMBS)])


def _unequal(grouped: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Groups whose digests differ; a side without rows shows no hash."""
    return (
        grouped.withColumn("source_hash", _side_digest("source"))
        .withColumn("target_hash", _side_digest("target"))
        .where("source_hash <> target_hash")
        .select(
            *keep,
            "source_rows",
            "target_rows",
            F.when(F.col("source_rows") > 0, F.col("source_hash")).alias("source_hash"),
            F.when(F.col("target_rows") > 0, F.col("target_hash")).alias("target_hash"),
        )
    )


def hash_table(source: DataFrame, target: DataFrame, spec: HashSpec) -> DataFrame:
    """One row: both table hashes and whether they agree. No shuffle of rows."""
    tagged = _with_lanes(_both_sides(source, target, spec, [], []), "row_hash")
    return (
        tagged.agg(*_side_rows(), *_side_sums())
        .select(
            F.lit("table").alias("level"),
            "source_rows",
            "target_rows",
            _side_digest("source").alias("source_hash"),
            _side_digest("target").alias("target_hash"),
        )
        .withColumn("matched", F.col("source_hash") == F.col("target_hash"))
    )


def hash_partitions(source: DataFrame, target: DataFrame, spec: HashSpec, partition_column: str) -> DataFrame:
    """Partition values whose rows hash differently, over the union of values."""
    left, right, families = key_columns(source, target, [partition_column], list(spec.pairs))
    tagged = _with_lanes(_both_sides(source, target, spec, left, right), "row_hash")
    value = F.col(key_name(partition_column)).alias("partition_value")
    grouped = tagged.groupBy(value, *families).agg(*_side_rows(), *_side_sums())
    return _unequal(grouped, ["partition_value"])


def hash_key_ranges(source: DataFrame, target: DataFrame, spec: HashSpec, key: str, range_size: int) -> DataFrame:
    """Ranges of ``range_size`` consecutive distinct keys that hash differently.

    The key of at least one side must be a number. Rows whose key is NULL or is
    text on the other side have no place in the order; all of them form one more
    range whose bounds are NULL.

    Only keys are ranked and pinned, exactly and without a one-task window. Rows
    fold to one digest per key, so a hot key is one row, and meet the ranks in
    the partitioning of that fold.
    """
    if range_size <= 0:
        raise ValueError("range_size must be positive")
    left, right, families = key_columns(source, target, [key], list(spec.pairs))
    kinds = [source.schema[key].dataType, target.schema[target_key(key, list(spec.pairs))].dataType]
    numbers = [k for k in kinds if family(k) == "number"]
    if not numbers:
        raise ValueError(f"the key-range level requires a number as key; {key} is {kinds[0].simpleString()}")
    range_key = F.col(key_name(key))
    if families:  # one side has number keys, and both show their keys as text
        range_key = F.when(F.col(families[0]) == "number", range_key.try_cast(numbers[0]))
    elif isinstance(shared_type(*kinds), T.StringType):  # two kinds of numbers that meet as text
        range_key = range_key.try_cast("decimal(38,10)")
    keyed = source.select(*left).unionByName(target.select(*right)).select(range_key.alias("range_key"))
    distinct = keyed.where(F.col("range_key").isNotNull()).distinct()
    ranked = global_rank(distinct, ["range_key"], "rank")
    buckets = ranked.select(F.col("range_key").alias("ranked_key"), F.floor(F.col("rank") / range_size).alias("bucket"))
    tagged = _both_sides(source, target, spec, left, right)
    per_key = (
        _with_lanes(tagged, "row_hash").groupBy(range_key.alias("range_key")).agg(*_side_rows(), *_side_sums())
    )
    grouped = (
        per_key.join(buckets, F.col("range_key") == F.col("ranked_key"), "left")
        .groupBy("bucket")
        .agg(F.min("range_key").alias("range_start"), F.max("range_key").alias("range_end"), *_merged_sums())
    )
    return _unequal(grouped, ["range_start", "range_end"])


def hash_row_compare(
    source: DataFrame, target: DataFrame, spec: HashSpec, keys: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Row pairs of one key whose hashes differ; an absent row has no hash.

    Rows of a repeated key pair up by position in hash order. Ordinary keys
    number their rows in one shuffle by key; the rows of hot keys take their
    positions from a range-partitioned order that splits a key over many tasks.
    """
    if not keys:
        raise ValueError("this level requires key columns")
    left, right, families = key_columns(source, target, keys, list(spec.pairs))
    by = [*map(key_name, keys), *families]
    tagged = _both_sides(source, target, spec, left, right)
    cold, hot = split_hot(tagged, hot_keys(tagged, by, hot_rows), by)
    place = F.row_number().over(Window.partitionBy(*by, "in_source").orderBy("row_hash"))
    placed = cold.repartition(*by).withColumn("position", place.cast("bigint"))
    if hot is not None:
        placed = placed.unionByName(_place_hot(hot, by))
    value = lambda mine: F.max(F.when(mine, F.col("row_hash")))
    return (
        placed.groupBy(*by, "position")
        .agg(value(F.col("in_source")).alias("source_hash"), value(~F.col("in_source")).alias("target_hash"))
        .where(~F.col("source_hash").eqNullSafe(F.col("target_hash")))
        .select(*map(key_name, keys), "position", "source_hash", "target_hash")
    )


def _place_hot(hot: DataFrame, by: list[str]) -> DataFrame:
    """Positions within hot keys; equal hashes split by an arbitrary tie-break."""
    order = [*by, "in_source", "row_hash", "tie"]
    ranked = global_rank(hot.withColumn("tie", F.monotonically_increasing_id()), order, "rank")
    group = [*by, "in_source"]
    starts = ranked.groupBy(*[F.col(c).alias(f"{c}__key") for c in group]).agg(F.min("rank").alias("start"))
    on = [F.col(c).eqNullSafe(F.col(f"{c}__key")) for c in group]
    joined = ranked.join(starts, on)  # two rows per hot key at most
    position = F.col("rank") - F.col("start") + 1
    return joined.select(*by, "row_hash", "in_source", position.alias("position"))


def hash_columns(source: DataFrame, target: DataFrame, spec: HashSpec, keys: Sequence[str]) -> DataFrame:
    """Columns whose values differ over the keys that both sides have.

    Rows fold to one digest per key and column before the only shuffle, so a hot
    key is one row by then; keys of one side alone are left out of the final sums.
    """
    if not keys:
        raise ValueError("this level requires key columns")
    left, right, families = key_columns(source, target, keys, list(spec.pairs))
    by = [*map(key_name, keys), *families]
    prefixes = [f"c{i}_" for i in range(len(spec.columns))]
    key_text = [F.col(key_name(k)).cast("string") for k in keys]
    sides = []
    for df, other, cols, side in ((source, target, left, "source"), (target, source, right, "target")):
        names = [f"text{i}" for i in range(len(spec.columns))]
        texts = df.select(*cols, *[t.alias(n) for t, n in zip(hash_texts(df, other, spec, side), names)])
        hashes = [row_hash([*key_text, F.col(n)]).alias(f"{p}hash") for n, p in zip(names, prefixes)]
        sides.append(texts.select(*by, *hashes, F.lit(side == "source").alias("in_source")))
    tagged = sides[0].unionByName(sides[1])
    for p in prefixes:
        tagged = _with_lanes(tagged, f"{p}hash", p)
    per_key = tagged.groupBy(*by).agg(*_side_rows(), *[c for p in prefixes for c in _side_sums(p)])
    totals = per_key.where("source_rows > 0 AND target_rows > 0").agg(*_merged_sums(prefixes))
    verdicts = [
        F.struct(
            F.lit(spec.target_name(column)).alias("column_name"),
            _side_digest("source", f"c{i}_").alias("source_hash"),
            _side_digest("target", f"c{i}_").alias("target_hash"),
        )
        for i, column in enumerate(spec.columns)
    ]
    return totals.select(F.inline(F.array(*verdicts))).where("source_hash <> target_hash")


def compare_by_hash(
    source: DataFrame,
    target: DataFrame,
    level: str,
    columns: Sequence[str],
    keys: Sequence[str] = (),
    mapping: Sequence[Pair | tuple[str, str]] | None = None,
    rules: Mapping[str, Rule] | None = None,
    partition_column: str | None = None,
    range_size: int | None = None,
    float_scale: int | None = None,
) -> HashComparison:
    """Compare at one level; ``matched`` below table level means no mismatches."""
    spec = HashSpec(tuple(columns), tuple(as_pairs(mapping)), rules or {}, float_scale)
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}; known: {LEVELS}")
    require(source, columns, "source")
    require(target, [spec.target_name(c) for c in columns], "target")
    table = hash_table(source, target, spec)
    if level == "table":
        return HashComparison(level, table, None)
    if level == "partition":
        if not partition_column:
            raise ValueError("the partition level requires partition_column")
        found = hash_partitions(source, target, spec, partition_column)
    elif level == "key-range":
        if len(keys) != 1:
            raise ValueError("the key-range level requires exactly one key column")
        if not range_size:
            raise ValueError("the key-range level requires a positive range_size")
        found = hash_key_ranges(source, target, spec, keys[0], range_size)
    elif level == "row":
        found = hash_row_compare(source, target, spec, keys)
    else:
        found = hash_columns(source, target, spec, keys)
    return HashComparison(level, _verdict(table, found, level), found)


def _verdict(table: DataFrame, found: DataFrame, level: str) -> DataFrame:
    """The table hashes with the number of mismatches, from two one-row frames."""
    none = F.lit(None).cast(T.StringType())
    hashes = table.select("source_hash", "target_hash", F.lit(0).cast("bigint").alias("mismatch_count"))
    counts = found.agg(F.count(F.lit(1)).alias("mismatch_count")).select(
        none.alias("source_hash"), none.alias("target_hash"), "mismatch_count"
    )
    return (
        hashes.unionByName(counts)
        .agg(F.max("source_hash").alias("source_hash"), F.max("target_hash").alias("target_hash"),
             F.sum("mismatch_count").alias("mismatch_count"))
        .select(F.lit(level).alias("level"), (F.col("mismatch_count") == 0).alias("matched"),
                "source_hash", "target_hash", "mismatch_count")
    )
