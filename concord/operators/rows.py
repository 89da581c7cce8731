"""Keyed row comparison of two DataFrames."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.normalize import Rule, Tolerance, normalize, times_within, values_equal
from concord.functions.values import as_text, as_type, family, shared_type
from concord.operators.skew import HOT_ROWS, hot_keys, split_hot

# Severity of each row category.
ROW_SEVERITY = {
    "matching": "Pass",
    "missing-from-source": "Failure",
    "missing-from-target": "Failure",
    "duplicate-in-source": "Warning",
    "duplicate-in-target": "Warning",
    "matched-key-differing-values": "Failure",
    "unable-to-compare": "Error",
    "ignored-by-rule": "Skipped",
}
# Message of each row category whose text does not vary.
ROW_MESSAGE = {
    "matching": "All mapped columns match after normalization.",
    "missing-from-source": "Key present in target but not found in source.",
    "missing-from-target": "Key present in source but not found in target.",
    "duplicate-in-source": "Key appears more than once in the source record set.",
    "duplicate-in-target": "Key appears more than once in the target record set.",
}
DIFFERENCE = "struct<column_name:string,source_value:string,target_value:string>"


@dataclass(frozen=True)
class Pair:
    """One mapped column: its name on the source and on the target."""

    source: str
    target: str


def as_pairs(mapping: Sequence[Pair | tuple[str, str]] | None) -> list[Pair]:
    return [m if isinstance(m, Pair) else Pair(*m) for m in mapping or ()]


def target_key(key: str, pairs: list[Pair]) -> str:
    """A key is declared by its source name; the mapping may rename it."""
    return next((p.target for p in pairs if p.source == key), key)


def require(df: DataFrame, columns: Sequence[str], side: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"column(s) {missing} not found on the {side} side; it has {df.columns}")


def literal_map(values: Mapping[str, str], key: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


# Names that results and intermediate frames use themselves.
RESERVED = {
    "s", "t", "in_source", "in_target", "source_rows", "target_rows", "differences", "entry", "category", "severity",
    "findings", "message", "row_hash", "hash", "position", "source_hash", "target_hash", "rank", "part", "place", "offset",
    "size", "bucket", "tie", "start", "only_s", "d", "column_name", "source_value", "target_value", "block", "copy",
}


def key_name(key: str) -> str:
    """Name of a key in a result: its own, unless the result uses that name itself."""
    taken = key.lower() in RESERVED or re.fullmatch(r"(text|lane|c\d+_lane|key_family_)\d+", key.lower())
    return f"key_{key}" if taken else key


def key_columns(source: DataFrame, target: DataFrame, keys: Sequence[str], pairs: list[Pair]):
    """Key expressions of both sides under their result names, of one type each.

    Keys of two families can never meet, so each side of such a key also gets
    a part that names its family.
    """
    if not keys:
        raise ValueError("at least one key column is required")
    target_keys = [target_key(k, pairs) for k in keys]
    require(source, keys, "source")
    require(target, target_keys, "target")
    left, right, families = [], [], []
    for i, (k, tk) in enumerate(zip(keys, target_keys)):
        a, b = source.schema[k].dataType, target.schema[tk].dataType
        if family(a) == family(b):
            common = shared_type(a, b)
            left.append(as_type(source[k], a, common).alias(key_name(k)))
            right.append(as_type(target[tk], b, common).alias(key_name(k)))
        else:
            mark = f"key_family_{i}"
            families.append(mark)
            left += [as_text(source[k], a).alias(key_name(k)), F.lit(family(a)).alias(mark)]
            right += [as_text(target[tk], b).alias(key_name(k)), F.lit(family(b)).alias(mark)]
    return left, right, families


def paired_rows(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    pairs: list[Pair],
    left: dict,
    right: dict,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per key: rows on each side and, if single, each side's values.

    Both sides go through one aggregation by key rather than a join: rows move
    once and NULL keys meet. Rows are not hash-aggregated, as they hold texts, so
    ordinary keys, which have a row or two and would not fold, are shuffled first
    and sorted once. Keys with very many rows are found first, from counts that
    fold on the map side, when this is called; their rows fold before they move.
    """
    left_keys, right_keys, families = key_columns(source, target, keys, pairs)
    s = F.struct(*[c.alias(n) for n, c in left.items()]) if left else F.struct(F.lit(1).alias("row"))
    t = F.struct(*[c.alias(n) for n, c in right.items()]) if right else F.struct(F.lit(1).alias("row"))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    sides = source.select(*left_keys, one.alias("in_source"), zero.alias("in_target"), s.alias("s"))
    other = target.select(*right_keys, zero.alias("in_source"), one.alias("in_target"), t.alias("t"))
    tagged = sides.unionByName(other, allowMissingColumns=True)
    by = [*map(key_name, keys), *families]
    folds = [
        F.sum("in_source").alias("source_rows"),
        F.sum("in_target").alias("target_rows"),
        F.first("s", ignorenulls=True).alias("s"),
        F.first("t", ignorenulls=True).alias("t"),
    ]
    cold, hot = split_hot(tagged, hot_keys(tagged, by, hot_rows), by)
    folded = cold.repartition(*by).groupBy(*by).agg(*folds)
    if hot is not None:
        folded = folded.unionByName(hot.groupBy(*by).agg(*folds))
    return folded.drop(*families)


def compare_rows(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    mapping: Sequence[Pair | tuple[str, str]] | None = None,
    rules: Mapping[str, Rule] | None = None,
    numeric_tolerance: Mapping[str, Tolerance] | None = None,
    ignore_columns: Sequence[str] = (),
    time_tolerance: Mapping[str, float] | None = None,
) -> DataFrame:
    """Classify every key; one output row per key and category.

    ``findings`` counts the findings a row stands for: one, or the number of
    rows of a duplicated key. Rules and tolerances go by target column name;
    ``time_tolerance`` gives seconds for columns of dates, times or their texts.
    Rows already meet by key, so that a gap is measured itself and no pair is
    lost at the edge of a time bucket.
    """
    rules, tolerances = rules or {}, numeric_tolerance or {}
    pairs, named = as_pairs(mapping), [key_name(k) for k in keys]
    active = [p for p in pairs if p.target not in set(ignore_columns)]
    absent = next((p for p in active if p.source not in source.columns or p.target not in target.columns), None)
    left, right, types = {}, {}, []
    for i, p in enumerate([] if absent else active):
        rule = rules.get(p.target)
        left[f"v{i}"], a = normalize(source[p.source], source.schema[p.source].dataType, rule)
        right[f"v{i}"], b = normalize(target[p.target], target.schema[p.target].dataType, rule)
        types.append((a, b))

    keyed = paired_rows(source, target, keys, pairs, left, right)
    differences = []
    for i, (p, (a, b)) in enumerate(zip(active, types)):
        rule = rules.get(p.target)
        tolerance = tolerances.get(p.target) or (rule.numeric_tolerance if rule else None)
        s, t = F.col(f"s.v{i}"), F.col(f"t.v{i}")
        equal = values_equal(s, a, t, b, tolerance)
        if p.target in (time_tolerance or {}):
            for kind in (a, b):
                if family(kind) not in ("time", "text"):
                    raise ValueError(f"a time tolerance needs dates, times or text; {p.target} is {kind.simpleString()}")
            equal = equal | times_within(s, a, t, b, time_tolerance[p.target])
        found = F.struct(
            F.lit(p.target).alias("column_name"),
            as_text(s, a).alias("source_value"),
            as_text(t, b).alias("target_value"),
        )
        differences.append(F.when(~equal, found))
    none = F.array().cast(f"array<{DIFFERENCE}>")
    differing = F.array_compact(F.array(*differences)) if differences else none

    ns, nt = F.col("source_rows"), F.col("target_rows")
    alone = (ns == 1) & (nt == 1)
    single = (
        F.when(nt == 0, "missing-from-target")
        .when(ns == 0, "missing-from-source")
        .when(F.lit(absent is not None), "unable-to-compare")
        .when(F.size("differences") == 0, "matching")
        .otherwise("matched-key-differing-values")
    )
    entry = lambda name, n: F.struct(name.alias("category"), n.alias("findings"))
    entries = F.when((ns <= 1) & (nt <= 1), F.array(entry(single, F.lit(1).cast("bigint")))).otherwise(
        F.array_compact(
            F.array(
                F.when(ns > 1, entry(F.lit("duplicate-in-source"), ns)),
                F.when(nt > 1, entry(F.lit("duplicate-in-target"), nt)),
            )
        )
    )
    category = F.col("entry.category")
    changed = F.concat(
        F.lit("Column(s) differ after normalization: "), F.array_join("differences.column_name", ", "), F.lit(".")
    )
    broken = F.lit(f'Column "{absent.target}" could not be normalized or compared.' if absent else None)
    message = (
        F.when(category == "matched-key-differing-values", changed)
        .when(category == "unable-to-compare", broken)
        .otherwise(literal_map(ROW_MESSAGE, category))
    )
    return (
        keyed.withColumn("differences", F.when(alone, differing).otherwise(none))
        .select(*named, ns, nt, "differences", F.explode(entries).alias("entry"))
        .select(
            *named,
            "source_rows",
            "target_rows",
            category.alias("category"),
            literal_map(ROW_SEVERITY, category).alias("severity"),
            F.col("entry.findings").alias("findings"),
            message.alias("message"),
            "differences",
        )
    )


def column_differences(compared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per differing column of a matched pair of rows."""
    named = [key_name(k) for k in keys]
    return compared.select(*named, F.explode("differences").alias("d")).select(*named, "d.*")


def category_counts(compared: DataFrame) -> DataFrame:
    """Findings per category with the category's severity."""
    return compared.groupBy("category", "severity").agg(F.sum("findings").alias("findings"))


def missing_rows(
    rows: DataFrame, other: DataFrame, keys: Sequence[str], mapping: Sequence[Pair | tuple[str, str]] | None = None
) -> DataFrame:
    """Whole rows that are alone on a key the other side never has.

    ``keys`` and ``mapping`` are read from the side of ``rows``. Because such a
    row is alone it survives the aggregation by key; no join is needed.
    """
    whole = {f"v{i}": rows[c] for i, c in enumerate(rows.columns)}
    keyed = paired_rows(rows, other, keys, as_pairs(mapping), whole, {})
    lonely = keyed.where("source_rows = 1 AND target_rows = 0")
    return lonely.select(*[F.col(f"s.v{i}").alias(c) for i, c in enumerate(rows.columns)])


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row of a key that this side has more than once.

    Only keys are counted, when this is called, and their counts fold before the
    shuffle. Few repeated keys are broadcast to the rows, which then do not move;
    many are joined, and Spark splits the side of the rows if a key is hot.
    """
    keys = list(keys)
    require(df, keys, "given")
    repeated = hot_keys(df, keys, min_rows=2)
    return df.limit(0) if repeated is None else split_hot(df, repeated, keys)[1]


def key_values(df: DataFrame, keys: Sequence[str]) -> Column:
    """The key as an array of texts, as findings carry it."""
    return F.array(*[as_text(df[k], df.schema[k].dataType) for k in keys]).cast(T.ArrayType(T.StringType()))
