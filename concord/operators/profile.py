"""Column profiles and the meaningful changes between two of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from concord.functions.values import as_text, comparable, family, wall
from concord.operators.rows import Pair, require
from concord.operators.skew import best_rows

NULL_CHANGE_POINTS = 0.5
MEDIAN_BAND = 2e-4  # half-width, in rank share, of the band sketched around a median
SKETCH_ACCURACY = 10_000
MEDIAN_ZONES = 1_024  # equal steps the band is counted in
# Typed slots of the value-frequency table.
SLOTS = {"long": "bigint", "double": "double", "decimal": None, "text": "string", "time": "timestamp_ntz", "bool": "boolean"}


def _slot(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    return {"number": "long", "time": "time", "boolean": "bool"}.get(family(dtype), "text")


def columns_of(df: DataFrame, families: Sequence[str], columns: Sequence[str] | None = None) -> list[str]:
    chosen = list(columns) if columns is not None else df.columns
    require(df, chosen, "given")
    return [c for c in chosen if family(df.schema[c].dataType) in families]


def long_values(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """One row per cell as (column_name, value), from one scan."""
    typed = lambda c: wall(df[c], df.schema[c].dataType) if kind == SLOTS["time"] else df[c].cast(kind)
    cells = [F.struct(F.lit(c).alias("column_name"), typed(c).alias("value")) for c in columns]
    # One NULL cell per column, so that a table without rows has a profile too.
    seeds = df.sparkSession.createDataFrame([(c, None) for c in columns], "column_name string, value void")
    seeds = seeds.select("column_name", F.col("value").cast(kind).alias("value"))
    return df.select(F.inline(F.array(*cells))).unionByName(seeds) if cells else seeds


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each value of each column occurs: one scan, one shuffle.

    Every value sits in the slot of its type, so one frame holds all columns
    and keeps their own order and equality. Only slots whose type occurs are
    there, and a number stands for the column until the counts are folded.
    Repeats fold before the shuffle.
    """
    require(df, columns, "given")
    kinds = slots_of(df, columns)
    counts = _cells(df, columns, kinds).groupBy("column", "present", *kinds).agg(F.sum("n").alias("copies"))
    return named_columns(counts, columns)


def value_counts_of_both(source: DataFrame, target: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The same for two sides with equal column names, out of one common shuffle."""
    kinds = slots_of(source, columns, target)
    left = _cells(source, columns, kinds).withColumnRenamed("n", "source").withColumn("target", F.lit(0))
    right = _cells(target, columns, kinds).withColumnRenamed("n", "target").withColumn("source", F.lit(0))
    sums = [F.sum(side).alias(side) for side in ("source", "target")]
    counts = named_columns(left.unionByName(right).groupBy("column", "present", *kinds).agg(*sums), columns)
    own = lambda side: counts.withColumn("copies", F.col(side)).where("copies > 0 OR NOT present")
    return own("source").drop("source", "target"), own("target").drop("source", "target")


def slots_of(df: DataFrame, columns: Sequence[str], *others: DataFrame) -> dict[str, str]:
    """The slots that these columns need, with their types, in the fixed order."""
    types = [x.schema[c].dataType for x in (df, *others) for c in columns]
    scale = max((t.scale for t in types if isinstance(t, T.DecimalType)), default=0)
    used = {_slot(t) for t in types}
    return {s: k or f"decimal(38,{scale})" for s, k in SLOTS.items() if s in used}


def _cells(df: DataFrame, columns: Sequence[str], kinds: dict[str, str]) -> DataFrame:
    """One row (column number, present, slots, n) for each cell, and one of n zero for each column."""
    cells = []
    for i, c in enumerate(columns):
        dtype = df.schema[c].dataType
        own = _slot(dtype)
        value = as_text(df[c], dtype) if own == "text" else wall(df[c], dtype) if own == "time" else df[c]
        slots = [(value if s == own else F.lit(None)).cast(k).alias(s) for s, k in kinds.items()]
        cells.append(F.struct(F.lit(i).alias("column"), df[c].isNotNull().alias("present"), *slots))
    # A count of zero per column, so that a table without rows has a profile too.
    fields = "".join(f", {s} {k}" for s, k in kinds.items())
    seeds = df.sparkSession.createDataFrame(
        [(i, False, *[None] * len(kinds), 0) for i in range(len(columns))], f"column int, present boolean{fields}, n int"
    )
    return df.select(F.inline(F.array(*cells)), F.lit(1).alias("n")).unionByName(seeds) if cells else seeds


def named_columns(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    names = F.array(*map(F.lit, columns)) if columns else F.array().cast("array<string>")
    return counts.withColumn("column_name", F.get(names, F.col("column"))).drop("column")


def slots_in(counts: DataFrame) -> list[Column]:
    return [F.col(s) for s in SLOTS if s in counts.columns]


def slot_text(counts: DataFrame) -> Column:
    texts = [c.cast("string") for c in slots_in(counts)]
    return F.coalesce(*texts) if texts else F.lit(None).cast("string")


def general_metrics(counts: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Rows, populated, nulls, distinct, duplicates and the most common value.

    The most common value is the smallest among the most frequent; it comes
    from an aggregate that folds on the map side, not from a ranking window.
    """
    populated = F.coalesce(F.sum(F.when(F.col("present"), F.col("copies"))), F.lit(0))
    first = F.min_by(
        F.when(F.col("present"), slot_text(counts)),
        F.when(F.col("present"), F.struct(-F.col("copies"), *slots_in(counts))),
    )
    metrics = counts.groupBy(*also, "column_name").agg(
        F.sum("copies").alias("row_count"),
        populated.alias("populated_count"),
        F.count_if("present").alias("distinct_count"),
        first.alias("most_common_value"),
        F.max(F.when(F.col("present"), F.col("copies"))).alias("most_common_count"),
    )
    nulls = F.col("row_count") - F.col("populated_count")
    return metrics.select(
        *also,
        "column_name",
        "row_count",
        "populated_count",
        nulls.alias("null_count"),
        F.when(F.col("row_count") == 0, F.lit(0.0))
        .otherwise(nulls.cast("double") / F.col("row_count") * 100)
        .alias("null_percentage"),
        "distinct_count",
        F.greatest(F.lit(0), F.col("populated_count") - F.col("distinct_count")).alias("duplicate_count"),
        "most_common_value",
        "most_common_count",
    )


def profile_general(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    metrics = general_metrics(value_counts(df, list(columns or df.columns)))
    return metrics.drop("most_common_value", "most_common_count")


def most_common(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The most frequent value of each column, the smallest one if tied."""
    metrics = general_metrics(value_counts(df, list(columns or df.columns)))
    return metrics.where("populated_count > 0").select(
        "column_name", F.col("most_common_value").alias("value"), F.col("most_common_count").alias("value_count")
    )


def top_values(df: DataFrame, n: int, columns: Sequence[str] | None = None) -> DataFrame:
    """The n most frequent values of each column, in order."""
    chosen = list(columns or df.columns)
    counts = value_counts(df, chosen).where("present")
    order = [F.col("copies").desc(), *slots_in(counts)]
    return best_rows(counts, "column_name", order, n, "place").select(
        "column_name", "place", slot_text(counts).alias("value"), F.col("copies").alias("value_count")
    )


def profile_string(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Emptiness, length and letter case of text columns."""
    v = F.col("value")
    upper = (v == F.upper(v)) & (v != F.lower(v))
    lower = (v == F.lower(v)) & (v != F.upper(v))
    stats = long_values(df, columns_of(df, ["text"], columns), "string").groupBy("column_name").agg(
        F.count_if(v == "").alias("empty_count"),
        F.count_if((F.trim(v) == "") & (v != "")).alias("blank_count"),
        F.coalesce(F.min(F.length(v)), F.lit(0)).cast("bigint").alias("min_length"),
        F.coalesce(F.max(F.length(v)), F.lit(0)).cast("bigint").alias("max_length"),
        F.coalesce(F.avg(F.length(v)), F.lit(0.0)).alias("avg_length"),
        F.count_if(upper).alias("upper_count"),
        F.count_if(lower).alias("lower_count"),
        F.count(v).alias("populated"),
    )
    mixed = F.col("populated") - F.col("upper_count") - F.col("lower_count")
    return stats.withColumn("mixed_count", mixed).drop("populated")


NUMERIC_METRICS = {
    "min_value": F.min,
    "max_value": F.max,
    "mean_value": F.avg,
    "stddev_value": F.stddev_samp,
    "zero_count": lambda v: F.count_if(v == 0),
    "negative_count": lambda v: F.count_if(v < 0),
    "positive_count": lambda v: F.count_if(v > 0),
    "populated": F.count,
    "band": lambda v: F.percentile_approx(v, [0.5 - MEDIAN_BAND, 0.5 + MEDIAN_BAND], SKETCH_ACCURACY),
}
NUMERIC_FIELDS = (
    "column_name string, min_value double, max_value double, mean_value double, stddev_value double, "
    "zero_count bigint, negative_count bigint, positive_count bigint, populated bigint, band array<double>"
)


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Range, mean, exact median, sample deviation and sign of number columns.

    A first pass reads all metrics but the median as one row per table; it runs
    when this is called, so that the median's pass has its band as constants.
    """
    chosen = columns_of(df, ["number"], columns)
    wide = [
        f(df[c].cast("double")).alias(f"{m}_{i}") for i, c in enumerate(chosen) for m, f in NUMERIC_METRICS.items()
    ]
    row = df.agg(*wide).first() if chosen else {}
    rows = [(c, *[row[f"{m}_{i}"] for m in NUMERIC_METRICS]) for i, c in enumerate(chosen)]
    stats = df.sparkSession.createDataFrame(rows, NUMERIC_FIELDS)
    bands = {r[0]: (r[-2], *r[-1]) for r in rows if r[-2]}
    median = exact_median(df, bands)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    doubles = [zero(c) for c in ("min_value", "max_value", "mean_value", "median_value", "stddev_value")]
    signs = ["zero_count", "negative_count", "positive_count"]
    return stats.join(F.broadcast(median), "column_name", "left").select("column_name", *doubles, *signs)


def exact_median(df: DataFrame, bands: dict[str, tuple[int, float, float]]) -> DataFrame:
    """Exact median of columns, from the few values around each.

    ``bands`` gives a column's count and a sketched (low, high) around its
    middle. One pass counts the cells below and above the band and the values
    inside it, in zones of equal width; zone sizes tell which zones hold the
    middle ranks, and only their values are ranked. Should the sketch miss, the
    values outside the band are read too; else Spark drops that branch at run
    time, because the zones it asks for are none.
    """
    if not bands:
        return df.sparkSession.createDataFrame([], "column_name string, median_value double")
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            df[c].cast("double").alias("value"),
            F.lit(n).cast("bigint").alias("populated"),
            F.lit(low).alias("low"),
            F.lit(high).alias("high"),
        )
        for c, (n, low, high) in bands.items()
    ]
    v, low, high = F.col("value"), F.col("low"), F.col("high")
    step = F.when(high > low, F.floor((v - low) / (high - low) * MEDIAN_ZONES)).otherwise(0)
    inside = F.least(F.greatest(step, F.lit(0)), F.lit(MEDIAN_ZONES - 1)) + 1
    zone = F.when(v < low, 0).when(v > high, MEDIAN_ZONES + 1).otherwise(inside)
    is_inside = F.col("zone").between(1, MEDIAN_ZONES)
    zoned = df.select(F.inline(F.array(*cells))).where("value IS NOT NULL").withColumn("zone", zone)
    frequency = (
        zoned.withColumn("value", F.when(is_inside, v))
        .groupBy("column_name", "populated", "zone", "value")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    ranks = F.array(F.expr("(populated - 1) div 2"), F.expr("populated div 2"))
    by_column = Window.partitionBy("column_name").orderBy("zone")  # at most MEDIAN_ZONES + 2 rows per column
    zones = (
        frequency.groupBy("column_name", "populated", "zone")
        .agg(F.sum("copies").alias("size"))
        .withColumn("before", F.sum("size").over(by_column) - F.col("size"))
    )
    holds = F.exists(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("size")))
    wanted = zones.where(holds).select("column_name", "zone", "before")
    near = frequency.join(F.broadcast(wanted.where(is_inside)), ["column_name", "zone"])
    far = (
        zoned.where(~is_inside)
        .join(F.broadcast(wanted.where(~is_inside)), ["column_name", "zone"])
        .groupBy("column_name", "zone", "populated", "before", "value")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    order = Window.partitionBy("column_name", "zone").orderBy("value")
    ranked = near.unionByName(far).withColumn("end", F.col("before") + F.sum("copies").over(order))
    hits = F.size(F.filter(ranks, lambda r: (r >= F.col("end") - F.col("copies")) & (r < F.col("end"))))
    picked = ranked.withColumn("hits", hits).where("hits > 0")
    return picked.groupBy("column_name").agg((F.sum(v * F.col("hits")) / 2).alias("median_value"))


def profile_date(df: DataFrame, now: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Earliest and latest value of time columns, and how many lie after ``now``."""
    v = F.col("value")
    later = v > F.lit(now).cast("timestamp_ntz")
    return (
        long_values(df, columns_of(df, ["time"], columns), "timestamp_ntz")
        .groupBy("column_name")
        .agg(F.min(v).alias("earliest_value"), F.max(v).alias("latest_value"), F.count_if(later).alias("future_count"))
    )


def profile_boolean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count and share of each value, with the column's cardinality."""
    counts = value_counts(df, columns_of(df, ["boolean"], columns)).where("present")
    totals = counts.groupBy("column_name").agg(
        F.sum("copies").alias("populated"), F.count(F.lit(1)).alias("cardinality")
    )
    share = F.col("copies").cast("double") / F.col("populated") * 100
    return counts.join(F.broadcast(totals), "column_name").select(
        "column_name",
        slot_text(counts).alias("value"),
        F.col("copies").alias("value_count"),
        share.alias("percentage"),
        "cardinality",
    )


def profile_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Total, non-null and distinct counts of the whole table in one row."""
    chosen = list(columns or df.columns)
    require(df, chosen, "given")
    metrics = [F.count(F.lit(1)).alias("total_count")]
    for c in chosen:
        value = comparable(df[c], df.schema[c].dataType)
        metrics += [F.count(df[c]).alias(f"{c}_non_null_count"), F.count_distinct(value).alias(f"{c}_distinct_count")]
    return df.agg(*metrics)


def profile_columns(df: DataFrame, now: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The whole profile: general metrics and the group that fits each column.

    Every joined frame has one row per column of the schema.
    """
    chosen = list(columns or df.columns)
    profile = general_metrics(value_counts(df, chosen))
    values = profile_boolean(df, chosen).groupBy("column_name").agg(
        F.sort_array(F.collect_list(F.struct("value", "value_count", "percentage"))).alias("boolean_values")
    )
    for part in (profile_string(df, chosen), profile_numeric(df, chosen), profile_date(df, now, chosen), values):
        profile = profile.join(F.broadcast(part), "column_name", "left")
    return profile


def column_pairs(
    source: DataFrame, target: DataFrame, mapping: Sequence[Pair] = (), exclude: Sequence[str] = ()
) -> list[Pair]:
    """Source columns with their mapped, else same-named, target column."""
    named = {p.source: p.target for p in mapping}
    pairs = [Pair(c, named.get(c, c)) for c in source.columns if c not in exclude]
    return [p for p in pairs if p.target in target.columns and p.target not in exclude]


def profile_diff(
    source: DataFrame, target: DataFrame, mapping: Sequence[Pair] = (), exclude: Sequence[str] = ()
) -> DataFrame:
    """Findings for columns whose profiles differ in a way that matters."""
    pairs = column_pairs(source, target, mapping, exclude)
    changes = _metric_changes(source, target, pairs)
    return changes.unionByName(category_changes(source, target, pairs))


def _finding(name, metric, severity, message, source_value, target_value) -> Column:
    return F.struct(
        name.alias("column_name"),
        F.lit(metric).alias("metric"),
        F.lit(severity).alias("severity"),
        source_value.cast("string").alias("source_value"),
        target_value.cast("string").alias("target_value"),
        F.concat(F.lit('Column "'), name, F.lit('": '), message).alias("message"),
    )


def _metric_changes(source: DataFrame, target: DataFrame, pairs: list[Pair]) -> DataFrame:
    """Both sides' value counts shuffle together; a side-by-side row per column."""
    renamed = target.select(*[target[p.target].alias(p.source) for p in pairs])
    left, right = value_counts_of_both(source, renamed, [p.source for p in pairs])
    s, t = general_metrics(left), general_metrics(right)
    kept = ["distinct_count", "null_percentage", "most_common_value"]
    side = lambda df, tag: df.select("column_name", F.struct(*kept).alias(tag))
    both = side(s, "s").join(side(t, "t"), "column_name")
    name, s, t = F.col("column_name"), F.col("s"), F.col("t")
    percent = lambda c: F.format_string("%.2f%%", c)
    shown = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("(none)"))

    def changed(what: str, a: Column, b: Column) -> Column:
        return F.concat(F.lit(f"{what} changed from "), a, F.lit(" (source) to "), b, F.lit(" (target)."))

    distinct = _finding(
        name, "distinctCount", "Informational",
        changed("distinct value count", s.distinct_count.cast("string"), t.distinct_count.cast("string")),
        s.distinct_count, t.distinct_count,
    )
    nulls = _finding(
        name, "nullPercentage", "Warning",
        changed("null percentage", percent(s.null_percentage), percent(t.null_percentage)),
        s.null_percentage, t.null_percentage,
    )
    common = _finding(
        name, "mostCommonValue", "Warning",
        changed("most common value", shown(s.most_common_value), shown(t.most_common_value)),
        s.most_common_value, t.most_common_value,
    )
    found = F.array_compact(
        F.array(
            F.when(s.distinct_count != t.distinct_count, distinct),
            F.when(F.abs(s.null_percentage - t.null_percentage) >= NULL_CHANGE_POINTS, nulls),
            F.when(~s.most_common_value.eqNullSafe(t.most_common_value), common),
        )
    )
    return both.select(F.inline(found))


def category_changes(source: DataFrame, target: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    """Values that only one side of a boolean column shows."""
    boolean = lambda df, c: family(df.schema[c].dataType) == "boolean"
    left = [p.source for p in pairs if boolean(source, p.source)]
    right = [target[p.target].alias(p.source) for p in pairs if boolean(target, p.target)]
    facing = target.select(*right)
    seen = lambda df: value_counts(df, df.columns).where("present")
    tagged = lambda df, s, t: (c := seen(df)).select(
        "column_name", slot_text(c).alias("value"), F.lit(s).alias("s"), F.lit(t).alias("t")
    )
    sides = tagged(source.select(*left), 1, 0).unionByName(tagged(facing, 0, 1))
    where = sides.groupBy("column_name", "value").agg(F.max("s").alias("s"), F.max("t").alias("t")).where("s <> t")
    name, value, none = F.col("column_name"), F.col("value"), F.lit(None)
    quoted = F.concat(F.lit('value "'), value, F.lit('" '))
    new = _finding(
        name, "newTargetValue", "Warning",
        F.concat(quoted, F.lit("is present on the target but was not observed on the source.")), none, value,
    )
    gone = _finding(
        name, "missingTargetValue", "Warning",
        F.concat(quoted, F.lit("was observed on the source but is missing on the target.")), value, none,
    )
    return where.select(F.inline(F.array(F.when(F.col("t") == 1, new).otherwise(gone))))
