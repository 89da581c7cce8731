"""A comparison definition and the run of its enabled checks."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.normalize import Rule, Tolerance
from concord.operators.hashing import HashSpec, hash_texts
from concord.functions.digest import row_hash
from concord.operators.profile import profile_diff, top_values
from concord.operators.rows import DIFFERENCE, Pair, compare_rows, key_name, key_values, target_key
from concord.operators.schema import SchemaSeverities, compare_schemas
from concord.operators.volume import compare_volume
from concord.sources.catalog import describe
from concord.sources.sides import Derived, Side, derive, label, load

CHECKS = ("schema", "profile", "row_count", "row_level")
FINDING_FIELDS = {
    "kind": "string",
    "severity": "string",
    "category": "string",
    "column_name": "string",
    "key_values": "array<string>",
    "source_value": "string",
    "target_value": "string",
    "message": "string",
    "column_differences": f"array<{DIFFERENCE}>",
    "findings": "bigint",
}
FINDINGS = ", ".join(f"{name} {kind}" for name, kind in FINDING_FIELDS.items())
PASSED = ("Pass", "Informational", "Skipped")
FAILED = ("Failure", "Error")


@dataclass(frozen=True)
class Checks:
    """Which checks run and how; every check is off unless enabled.

    ``strategy="hash"`` compares one digest per row instead of its columns, so
    only keys and digests move; columns under a numeric tolerance, which digests
    cannot express, move as values and are compared as such, so both strategies
    give the same categories. A mapped column that a side lacks makes every pair
    of rows unable to compare under either; ``max_differences`` caps the row findings that
    are listed, never those that are counted.
    """

    schema: bool = False
    profile: bool = False
    row_count: bool = False
    row_level: bool = False
    row_count_tolerance: Tolerance | None = None
    top_values: int | None = None
    strategy: str = "full"
    max_differences: int | None = None

    def enabled(self) -> list[str]:
        return [c for c in CHECKS if getattr(self, c)]

    def only(self, chosen: Collection[str]) -> Checks:
        unknown = set(chosen) - set(CHECKS)
        if unknown:
            raise ValueError(f"unknown checks {sorted(unknown)}; known: {CHECKS}")
        return replace(self, **{c: getattr(self, c) and c in chosen for c in CHECKS})


@dataclass(frozen=True)
class Definition:
    """What is compared, by which key, under which rules and checks."""

    name: str
    source: Side | DataFrame
    target: Side | DataFrame
    keys: Sequence[str] = ()
    mapping: Sequence[Pair | Derived | tuple[str, str]] = ()
    exclude_columns: Sequence[str] = ()
    rules: Mapping[str, Rule] = field(default_factory=dict)
    checks: Checks = Checks()
    schema_severities: SchemaSeverities | None = None
    schema_uses_mapping: bool = False
    version: int = 1


@dataclass(frozen=True)
class Run:
    """Lazy results: a frame per enabled check, all findings, and a summary."""

    name: str
    findings: DataFrame
    summary: DataFrame
    labels: tuple[str, str]
    schema: DataFrame | None = None
    profile: DataFrame | None = None
    volume: DataFrame | None = None
    rows: DataFrame | None = None
    keys: tuple[str, ...] = ()
    top_values: DataFrame | None = None
    readable: bool = True


def run_comparison(spark: SparkSession, definition: Definition, only: Collection[str] | None = None) -> Run:
    """Build the frames of every enabled check.

    The row check counts its keys now, to find hot ones; all else runs when a
    frame is read.

    A side that cannot be read gives a failed run without findings.
    """
    checks = definition.checks if only is None else definition.checks.only(only)
    labels = label(definition.source), label(definition.target)
    try:
        source, target = load(spark, definition.source), load(spark, definition.target)
    except AnalysisException:
        none = spark.createDataFrame([], FINDINGS)
        summary = summarize(none, definition.name, labels)
        failed = summary.withColumns({"status": F.lit("failed"), "failed": F.lit(1).cast("bigint")})
        return Run(definition.name, none, failed, labels, readable=False)
    source, target, pairs = derive(source, target, definition.mapping, definition.exclude_columns)

    frames: dict[str, DataFrame] = {}
    if checks.schema:
        mapped = pairs if definition.schema_uses_mapping else ()
        frames["schema"] = compare_schemas(
            describe(source, definition.name), describe(target, definition.name), definition.schema_severities, mapped
        )
    if checks.profile:
        frames["profile"] = profile_diff(source, target, pairs)
    if checks.row_count:
        frames["volume"] = compare_volume(source, target, checks.row_count_tolerance)
    if checks.row_level:
        frames["rows"] = _compare(source, target, definition, checks, pairs)

    keys = tuple(key_name(k) for k in definition.keys)
    listed = [_as_findings(kind, frame, keys, checks.max_differences) for kind, frame in frames.items()]
    findings = _union(listed) if listed else spark.createDataFrame([], FINDINGS)
    tops = top_values(source, checks.top_values) if checks.profile and checks.top_values else None
    summary = summarize(findings, definition.name, labels)
    return Run(definition.name, findings, summary, labels, keys=keys, top_values=tops, **frames)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _compare(source: DataFrame, target: DataFrame, definition: Definition, checks: Checks, pairs: list[Pair]):
    keys = list(definition.keys)
    if checks.strategy == "full":
        return compare_rows(source, target, keys, pairs, definition.rules)
    if checks.strategy != "hash":
        raise ValueError(f"unknown strategy {checks.strategy!r}; known: full, hash")
    if any(p.source not in source.columns or p.target not in target.columns for p in pairs):
        return compare_rows(source, target, keys, pairs, definition.rules)  # reads keys alone: no pair can be compared
    tolerant = lambda p: (r := definition.rules.get(p.target)) and r.numeric_tolerance and r.numeric_tolerance.is_set
    loose = [p for p in pairs if tolerant(p)]
    strict = [p for p in pairs if not tolerant(p)]
    spec = HashSpec(tuple(p.source for p in strict), tuple(strict), definition.rules, None)
    sides = []
    for df, other, side in ((source, target, "source"), (target, source, "target")):
        name = lambda p: getattr(p, side)  # noqa: B023, E731
        named = keys if side == "source" else [target_key(k, pairs) for k in keys]
        sides.append(
            df.select(
                *[F.col(k).alias(key_name(n)) for k, n in zip(named, keys)],
                row_hash(hash_texts(df, other, spec, side)).alias("row_hash"),
                *[df[name(p)].alias(f"value_{p.target}") for p in loose],
            )
        )
    carried = [Pair(f"value_{p.target}", f"value_{p.target}") for p in loose]
    rules = {f"value_{p.target}": definition.rules[p.target] for p in loose}
    return compare_rows(*sides, [key_name(k) for k in keys], [Pair("row_hash", "row_hash"), *carried], rules)


def _as_findings(kind: str, frame: DataFrame, keys: Sequence[str], max_differences: int | None) -> DataFrame:
    """A check's own frame in the shape that all findings share."""
    given: dict[str, Column] = {"severity": F.col("severity"), "message": F.col("message")}
    if kind == "schema":
        given |= {"category": F.col("kind"), "column_name": F.col("column_name")}
        given |= {"source_value": F.col("source_type"), "target_value": F.col("target_type")}
    elif kind == "profile":
        given |= {"category": F.col("metric"), "column_name": F.col("column_name")}
        given |= {"source_value": F.col("source_value"), "target_value": F.col("target_value")}
    elif kind == "volume":
        given |= {"category": F.lit("row-count")}
        given |= {"source_value": F.col("source_rows"), "target_value": F.col("target_rows")}
    else:
        return _row_findings(frame, keys, max_differences)
    return frame.select(*_shaped(kind, given))


def each_finding(kind: str, frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per finding of a check, matching rows included, in the shape that all findings share."""
    if kind != "rows":
        return _as_findings(kind, frame, keys, None).drop("findings")
    given = {c: F.col(c) for c in ("severity", "message", "category")}
    each = {**given, "key_values": key_values(frame, keys), "column_differences": F.col("differences")}
    return frame.select(*_shaped("rows", each)).drop("findings")


def _shaped(kind: str, given: dict[str, Column]) -> list[Column]:
    fixed = {"kind": F.lit(kind), "findings": F.lit(1)}
    values = {**fixed, **given}
    return [values.get(name, F.lit(None)).cast(t).alias(name) for name, t in FINDING_FIELDS.items()]


def _row_findings(frame: DataFrame, keys: Sequence[str], max_differences: int | None) -> DataFrame:
    """One row per key and category; rows that are not listed are counted in one per category.

    Matching rows are never listed, nor are differences beyond a limit, so the
    findings always add up to all rows.
    """
    given = {c: F.col(c) for c in ("severity", "message", "category", "findings")}
    listed = frame.where("category <> 'matching'")
    rest = frame.where("category = 'matching'").select(*given)
    if max_differences is not None:
        everything = listed
        listed = listed.orderBy(*keys, "category").limit(max_differences)
        negative = listed.withColumn("findings", -F.col("findings"))
        unlisted = F.lit("Further findings beyond the listed ones.")
        beyond = everything.select(*given).unionByName(negative.select(*given)).withColumn("message", unlisted)
        rest = rest.unionByName(beyond)
    counted = rest.groupBy("category", "severity", "message").agg(F.sum("findings").alias("findings"))
    each = {**given, "key_values": key_values(listed, keys), "column_differences": F.col("differences")}
    return listed.select(*_shaped("rows", each)).unionByName(counted.where("findings > 0").select(*_shaped("rows", given)))


def summarize(findings: DataFrame, name: str, labels: tuple[str, str]) -> DataFrame:
    """One row: status, finding counts by outcome, row counts and side labels."""
    severity, n = F.col("severity"), F.col("findings")
    total = lambda test, value: F.coalesce(F.sum(F.when(test, value)), F.lit(0)).cast("bigint")
    counted = F.col("category") == "row-count"
    sums = findings.agg(
        total(severity.isin(*PASSED), n).alias("passed"),
        total(severity == "Warning", n).alias("warnings"),
        total(severity.isin(*FAILED), n).alias("failed"),
        total(counted, F.col("source_value").try_cast("bigint")).alias("source_rows"),
        total(counted, F.col("target_value").try_cast("bigint")).alias("target_rows"),
    )
    status = F.when(F.col("failed") > 0, "failed").when(F.col("warnings") > 0, "warning").otherwise("passed")
    return sums.select(
        F.lit(name).alias("comparison"),
        status.alias("status"),
        *sums.columns,
        (F.col("target_rows") - F.col("source_rows")).alias("difference"),
        F.lit(labels[0]).alias("source_label"),
        F.lit(labels[1]).alias("target_label"),
    )
