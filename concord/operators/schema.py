"""Schema comparison over column catalogs, for many tables at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.functions.nativetypes import COMPATIBILITY_SEVERITY, type_compatibility
from concord.operators.rows import Pair, literal_map


@dataclass(frozen=True)
class SchemaSeverities:
    """Severities that a comparison may set for itself."""

    missing_in_target: str = "Failure"
    missing_in_source: str = "Failure"
    nullable_to_required: str = "Warning"
    required_to_nullable: str = "Informational"
    increased_length: str = "Informational"
    decreased_length: str = "Failure"
    order_mismatch: str = "Informational"


PRECISION_SEVERITY = "Warning"
# Names of the mapping strategies, in the order they are tried.
MAPPING_STRATEGIES = ("exact", "case-insensitive", "snake-camel", "ordinal")


def rename_source(catalog: DataFrame, mapping: Sequence[Pair]) -> DataFrame:
    """Give mapped source columns their target names, so that they pair up."""
    name = F.col("column_name")
    names = {p.source: p.target for p in mapping}
    return catalog.withColumn("column_name", F.coalesce(literal_map(names, name), name)) if names else catalog


def paired_columns(source: DataFrame, target: DataFrame) -> DataFrame:
    """Catalog rows of both sides next to each other, by table and column name."""
    details = ["ordinal", "native_type", "canonical_type", "nullable", "length", "precision", "scale"]
    side = lambda df, tag: df.select("table_name", "column_name", F.struct(*details).alias(tag))
    return side(source, "s").join(side(target, "t"), ["table_name", "column_name"], "full_outer")


def _finding(kind: str, severity: Column | str, message: Column, typed: bool = True) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("kind"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        (F.col("s.native_type") if typed else none).alias("source_type"),
        (F.col("t.native_type") if typed else none).alias("target_type"),
        F.concat(F.lit('Column "'), F.col("column_name"), F.lit('"'), message).alias("message"),
    )


def _versus(label: str, a: Column, b: Column) -> Column:
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    return F.concat(F.lit(f": {label}"), shown(a), F.lit(" (source) vs "), F.lit(label if "=" in label else ""), shown(b), F.lit(" (target)."))


def compare_schemas(
    source: DataFrame, target: DataFrame, severities: SchemaSeverities | None = None, mapping: Sequence[Pair] = ()
) -> DataFrame:
    """All schema findings between two catalogs, order findings included.

    Columns pair by exact name; with a mapping, renamed columns pair as well.
    """
    pairs = paired_columns(rename_source(source, mapping), target)
    return _pair_findings(pairs, severities or SchemaSeverities()).unionByName(
        _order_findings(pairs, severities or SchemaSeverities())
    )


def _pair_findings(pairs: DataFrame, severities: SchemaSeverities) -> DataFrame:
    s, t = F.col("s"), F.col("t")
    compatibility = type_compatibility(s.canonical_type, t.canonical_type)
    type_message = F.concat(
        F.lit(': native type "'), s.native_type, F.lit('" ('), s.canonical_type, F.lit(') vs "'), t.native_type,
        F.lit('" ('), t.canonical_type, F.lit(") is "), compatibility, F.lit("."),
    )
    longer = F.coalesce(t.length, F.lit(0)) > F.coalesce(s.length, F.lit(0))
    narrowed = s.nullable & ~t.nullable
    gone = _finding("missing-in-target", severities.missing_in_target, F.lit(" is present on the source but missing on the target."))
    new = _finding("missing-in-source", severities.missing_in_source, F.lit(" is present on the target but missing on the source."))
    checks = F.array_compact(
        F.array(
            F.when(
                (s.native_type != t.native_type) & (compatibility != "Compatible"),
                _finding("type-mismatch", literal_map(COMPATIBILITY_SEVERITY, compatibility), type_message),
            ),
            F.when(
                ~s.length.eqNullSafe(t.length),
                _finding(
                    "length-mismatch",
                    F.when(longer, severities.increased_length).otherwise(severities.decreased_length),
                    _versus("length ", s.length, t.length),
                ),
            ),
            F.when(
                ~s.precision.eqNullSafe(t.precision),
                _finding("precision-mismatch", PRECISION_SEVERITY, _versus("precision ", s.precision, t.precision)),
            ),
            F.when(
                ~s.scale.eqNullSafe(t.scale),
                _finding("scale-mismatch", PRECISION_SEVERITY, _versus("scale ", s.scale, t.scale)),
            ),
            F.when(
                s.nullable != t.nullable,
                _finding(
                    "nullability-mismatch",
                    F.when(narrowed, severities.nullable_to_required).otherwise(severities.required_to_nullable),
                    _versus("nullable=", s.nullable, t.nullable),
                ),
            ),
        )
    )
    found = F.when(t.isNull(), F.array(gone)).when(s.isNull(), F.array(new)).otherwise(checks)
    return pairs.select("table_name", "column_name", F.inline(found))


def _order_findings(pairs: DataFrame, severities: SchemaSeverities) -> DataFrame:
    """Common columns whose rank among the common columns differs.

    A window holds the columns of one table, so its size does not grow with data.
    """
    common = pairs.where("s IS NOT NULL AND t IS NOT NULL")
    rank = lambda side: F.row_number().over(
        Window.partitionBy("table_name").orderBy(f"{side}.ordinal", "column_name")
    )
    ranked = common.withColumn("source_rank", rank("s")).withColumn("target_rank", rank("t"))
    message = F.concat(
        F.lit(": relative position "), F.col("source_rank").cast("string"),
        F.lit(" among common columns on the source does not match its relative position on the target."),
    )
    moved = ranked.where("source_rank <> target_rank")
    finding = _finding("order-mismatch", severities.order_mismatch, message, typed=False)
    return moved.select("table_name", "column_name", F.inline(F.array(finding)))


def compare_column_order(source: DataFrame, target: DataFrame, severities: SchemaSeverities | None = None) -> DataFrame:
    return _order_findings(paired_columns(source, target), severities or SchemaSeverities())


def suggest_mappings(source: DataFrame, target: DataFrame) -> DataFrame:
    """Suggested column pairs per table, each target column used once.

    Source columns choose in order among the targets still free: same name,
    same name but for case, same but for case and separators, same ordinal. The
    choice is greedy, so it folds over one table's columns; an array holds no
    more than the columns of a table.
    """

    def columns(df: DataFrame, name: str) -> DataFrame:
        lower = F.lower("column_name")
        folded = F.regexp_replace(lower, "[_-]", "")
        entry = F.struct("ordinal", "column_name", lower.alias("lower"), folded.alias("folded"))
        return df.groupBy("table_name").agg(F.array_sort(F.collect_list(entry)).alias(name))

    def choose(state: Column, c: Column) -> Column:
        rank = lambda t: (
            F.when(t.column_name == c.column_name, 1)
            .when(t.lower == c.lower, 2)
            .when(t.folded == c.folded, 3)
            .when(t.ordinal == c.ordinal, 4)
        )
        ranked = F.transform(state.free, lambda t: F.struct(rank(t).alias("rank"), t.ordinal.alias("at"), t.column_name))
        best = F.array_min(F.filter(ranked, lambda t: t["rank"].isNotNull()))
        # A one-element array binds the choice, so that it is found once per column.
        return F.transform(F.array(best), lambda b: F.when(b.isNull(), state).otherwise(taken(state, c, b)))[0]

    def taken(state: Column, c: Column, b: Column) -> Column:
        strategies = F.array(*map(F.lit, MAPPING_STRATEGIES))
        pair = F.struct(
            c.column_name.alias("source_column"),
            b.column_name.alias("target_column"),
            F.element_at(strategies, b["rank"]).alias("strategy"),
        )
        free = F.filter(state.free, lambda t: t.column_name != b.column_name)
        return F.struct(free.alias("free"), F.array_append(state.pairs, pair).alias("pairs"))

    both = columns(source, "s").join(columns(target, "t"), "table_name")
    none = F.array().cast("array<struct<source_column:string,target_column:string,strategy:string>>")
    start = F.struct(F.col("t").alias("free"), none.alias("pairs"))
    return both.select("table_name", F.inline(F.aggregate("s", start, choose).pairs))
