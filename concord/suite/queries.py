"""The registered queries: one per operator, over whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.digest import canonical_text
from concord.functions.nativetypes import canonical_type, type_compatibility, type_modifiers
from concord.functions.normalize import Rule, Tolerance, normalize, values_equal
from concord.operators import aggregates, hashing, narrowing, patterns, profile, rows, sampling, schema, sketches
from concord.operators.rows import Pair
from concord.operators.trend import run_trends
from concord.operators.volume import ALL_ROWS, compare_volume, volume_by_dimension as count_by_dimension
from concord.plans.run import FINDINGS, Checks, Definition, Run, run_comparison
from concord.session import shared_dir
from concord.sinks import exports, history
from concord.sources.catalog import from_information_schema
from concord.sources.sides import Derived, ParquetFiles, Query, SqlFile, capped, derive, load
from concord.suite import inputs
from concord.suite.inputs import FLOAT_SCALE, HASHED, LINE_MAPPING, ORDER_MAPPING, ORDER_RULES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KEY = ["o_orderkey"]
PROFILED = ("customer", "orders", "events")
TEXT_PROFILED = ("customer", "orders", "events", "documents", "conversations")
DERIVED_PRIORITY = Derived(
    "priority", "priority_text", source_expression="upper(o_orderpriority)", target_expression="upper(order_priority)"
)


def registered(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _order_sides(spark, sf):
    return inputs.orders(spark, sf), inputs.orders_target(spark, sf)


# --- sources ---------------------------------------------------------------


@registered
def scan_table(spark, sf):
    return load(spark, ParquetFiles(f"{sf}/orders.parquet"))


@registered
def scan_query(spark, sf):
    inputs.orders(spark, sf).createOrReplaceTempView("orders")
    return load(spark, Query("SELECT o_orderstatus, o_orderkey, o_totalprice * 2 AS double_price FROM orders; "))


@registered
def scan_sql_file(spark, sf):
    inputs.orders(spark, sf).createOrReplaceTempView("orders")
    return load(spark, SqlFile("orders_scan.sql", base_dir=str(Path(__file__).parent)))


@registered
def scan_where(spark, sf):
    return load(spark, ParquetFiles(f"{sf}/orders.parquet", where="o_orderstatus = 'F'"))


@registered
def scan_limit(spark, sf):
    return capped(inputs.orders(spark, sf).orderBy("o_orderkey"), 100)


# --- row comparison --------------------------------------------------------


def _compared(spark, sf, mapping=ORDER_MAPPING, rules=ORDER_RULES, **options):
    source, target = _order_sides(spark, sf)
    return rows.compare_rows(source, target, KEY, mapping, rules, **options)


def _flat(compared: DataFrame, keys: list[str]) -> DataFrame:
    """Results without nested columns, so that any engine can compare them."""
    names = F.array_join("differences.column_name", ",").alias("differing_columns")
    return compared.select(*keys, "category", "severity", "findings", "source_rows", "target_rows", names, "message")


@registered
def row_compare(spark, sf):
    return _flat(_compared(spark, sf), KEY)


@registered
def row_column_diffs(spark, sf):
    return rows.column_differences(_compared(spark, sf), KEY)


@registered
def row_severity_summary(spark, sf):
    return rows.category_counts(_compared(spark, sf))


@registered
def rows_missing_from_target(spark, sf):
    source, target = _order_sides(spark, sf)
    return rows.missing_rows(source, target, KEY, ORDER_MAPPING)


@registered
def rows_missing_from_source(spark, sf):
    source, target = _order_sides(spark, sf)
    return rows.missing_rows(target, source, ["order_key"], [Pair(p.target, p.source) for p in ORDER_MAPPING])


@registered
def rows_duplicate_keys(spark, sf):
    source, target = inputs.lines(spark, sf), inputs.lines_target(spark, sf)
    key = ["l_orderkey", "l_linenumber"]
    named = target.withColumnsRenamed({p.target: p.source for p in LINE_MAPPING})
    columns = [p.source for p in LINE_MAPPING]
    found = [
        rows.duplicate_rows(df.select(*columns), key).withColumn("category", F.lit(f"duplicate-in-{side}"))
        for df, side in ((source, "source"), (named, "target"))
    ]
    return found[0].unionByName(found[1])


@registered
def row_compare_mixed_keys(spark, sf):
    """Whole keys beyond a double's exact range meet floating ones, and fractions meet decimals."""
    big = F.lit(9007199254740992)
    left = inputs.orders(spark, sf).select((big + F.col("o_orderkey")).alias("id"), "o_orderstatus")
    right = inputs.orders(spark, sf).select((big + F.col("o_orderkey")).cast("double").alias("id"), "o_orderstatus")
    compared = rows.compare_rows(left, right, ["id"], [Pair("o_orderstatus", "o_orderstatus")])
    return compared.select("id", "category", "findings")


@registered
def row_compare_composite(spark, sf):
    keys = ["l_orderkey", "l_linenumber"]
    compared = rows.compare_rows(inputs.lines(spark, sf), inputs.lines_target(spark, sf), keys, LINE_MAPPING)
    return _flat(compared, keys)


@registered
def row_compare_derived(spark, sf):
    source, target, pairs = derive(*_order_sides(spark, sf), [ORDER_MAPPING[0], DERIVED_PRIORITY])
    return _flat(rows.compare_rows(source, target, KEY, pairs), KEY)


@registered
def row_compare_ignore(spark, sf):
    return _flat(_compared(spark, sf, ignore_columns=["order_priority", "order_date"]), KEY)


@registered
def row_compare_time_tolerance(spark, sf):
    """A second before midnight and midnight are near each other, whatever bucket they fall in."""
    target = inputs.from_sql(spark, sf, inputs.ORDERS_SHIFTED, "orders")
    pairs = [Pair("o_orderdate", "order_date")]
    return _flat(rows.compare_rows(inputs.orders(spark, sf), target, KEY, pairs, time_tolerance={"order_date": 60}), KEY)


@registered
def row_unable_to_compare(spark, sf):
    return _flat(_compared(spark, sf, mapping=[*ORDER_MAPPING, Pair("o_clerk", "clerk")]), KEY)


# --- normalization ---------------------------------------------------------


def _normalized(df: DataFrame, key: str, column: str, rule: Rule) -> DataFrame:
    value, _ = normalize(df[column], df.schema[column].dataType, rule)
    return df.select(key, F.col(column).alias("raw_value"), value.alias("value"))


@registered
def norm_null_equivalents(spark, sf):
    rule = Rule(null_equivalents=("N/A", "unknown"))
    return _normalized(inputs.orders_target(spark, sf), "order_key", "order_priority", rule)


@registered
def norm_string(spark, sf):
    rule = Rule(trim=True, case_sensitive=False, collapse_whitespace=True)
    return _normalized(inputs.table(spark, sf, "documents"), "doc_id", "text", rule)


@registered
def norm_instant(spark, sf):
    """Order dates as instants, read as wall clocks of a zone; the session's zone has no part in it."""
    instants = inputs.orders(spark, sf).select(
        "o_orderkey", F.timestamp_seconds(F.lit(800_000_000) + F.col("o_orderkey") * 3600).alias("instant")
    )
    rule = Rule(timezone="America/New_York", truncate_to="hour")
    value, _ = normalize(instants.instant, T.TimestampType(), rule)
    return instants.select("o_orderkey", value.cast("string").alias("value"))


@registered
def norm_full_rule(spark, sf):
    rule = Rule(
        trim=True, case_sensitive=False, collapse_whitespace=True, null_equivalents=("  f ",),
        timezone="America/New_York", truncate_to="second",
    )
    return _normalized(inputs.orders_target(spark, sf), "order_key", "order_status", rule)


def _event_text(spark, sf):
    return inputs.table(spark, sf, "events").select("event_id", F.col("ts").cast("string").alias("ts_text"))


@registered
def norm_timezone(spark, sf):
    rule = Rule(timezone="America/New_York", truncate_to="second")
    return _normalized(_event_text(spark, sf), "event_id", "ts_text", rule)


@registered
def norm_truncate(spark, sf):
    text = _normalized(_event_text(spark, sf), "event_id", "ts_text", Rule(truncate_to="day"))
    native = normalize(F.col("ts"), T.TimestampNTZType(), Rule(truncate_to="hour"))[0]
    events = inputs.table(spark, sf, "events").select("event_id", native.alias("hour"))
    return text.join(events, "event_id")


@registered
def tolerance_equal(spark, sf):
    source, target = _order_sides(spark, sf)
    pairs = rows.paired_rows(source, target, KEY, ORDER_MAPPING, {"a": source.o_totalprice}, {"b": target.total_price})
    a, b, kind = F.col("s.a"), F.col("t.b"), T.DoubleType()
    text = lambda c: c.cast("decimal(18,4)").cast("string")
    return pairs.where("source_rows = 1 AND target_rows = 1").select(
        *KEY,
        values_equal(a, kind, b, kind).alias("strict"),
        values_equal(a, kind, b, kind, Tolerance(absolute=0.01)).alias("within_absolute"),
        values_equal(a, kind, b, kind, Tolerance(percentage=0.005)).alias("within_percentage"),
        values_equal(text(a), T.StringType(), b, kind, Tolerance(absolute=0.01)).alias("text_within_absolute"),
    )


# --- catalogs and schemas --------------------------------------------------


@registered
def catalog_describe(spark, sf):
    return inputs.source_catalog(spark, sf)


@registered
def type_map(spark, sf):
    dump = inputs.from_sql(spark, sf, inputs.SOURCE_DUMP, "part")
    native = F.col("data_type")
    return dump.select("table_name", "column_name", "data_type", canonical_type(native).alias("canonical_type"))


@registered
def type_modifiers_(spark, sf):
    dump = inputs.from_sql(spark, sf, inputs.SOURCE_DUMP, "part")
    parts = type_modifiers(F.col("data_type"))
    return dump.select("table_name", "column_name", "data_type", *[c.alias(k) for k, c in parts.items()])


QUERIES["type_modifiers"] = QUERIES.pop("type_modifiers_")


@registered
def type_compat(spark, sf):
    pairs = schema.paired_columns(inputs.source_catalog(spark, sf), inputs.target_catalog(spark, sf))
    a, b = F.col("s.canonical_type"), F.col("t.canonical_type")
    return pairs.where("s IS NOT NULL AND t IS NOT NULL").select(
        "table_name",
        "column_name",
        a.alias("source_type"),
        b.alias("target_type"),
        type_compatibility(a, b).alias("compatibility"),
        type_compatibility(b, a).alias("reverse_compatibility"),
    )


@registered
def schema_diff(spark, sf):
    return schema.compare_schemas(inputs.source_catalog(spark, sf), inputs.target_catalog(spark, sf))


@registered
def schema_order(spark, sf):
    return schema.compare_column_order(inputs.source_catalog(spark, sf), inputs.target_catalog(spark, sf))


@registered
def suggest_mappings(spark, sf):
    return schema.suggest_mappings(inputs.source_catalog(spark, sf), inputs.target_catalog(spark, sf))


# --- hashes ----------------------------------------------------------------


def _by_hash(spark, sf, level, **options):
    source, target = _order_sides(spark, sf)
    return hashing.compare_by_hash(
        source, target, level, HASHED, KEY, ORDER_MAPPING, ORDER_RULES, float_scale=FLOAT_SCALE, **options
    )


@registered
def hash_rows(spark, sf):
    rules = {"o_orderstatus": ORDER_RULES["order_status"]}
    return hashing.hash_rows(inputs.orders(spark, sf), HASHED, rules, FLOAT_SCALE).select("o_orderkey", "row_hash")


@registered
def hash_table(spark, sf):
    return _by_hash(spark, sf, "table").result


@registered
def hash_partitions(spark, sf):
    return _by_hash(spark, sf, "partition", partition_column="o_orderstatus").mismatches


@registered
def hash_key_ranges(spark, sf):
    return _by_hash(spark, sf, "key-range", range_size=1000).mismatches


@registered
def hash_key_ranges_null_keys(spark, sf):
    """One key in fifty is NULL on both sides."""
    source, target = _order_sides(spark, sf)
    source = source.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderkey")))
    target = target.withColumn("order_key", F.when(F.col("order_key") % 50 != 0, F.col("order_key")))
    options = {"float_scale": FLOAT_SCALE, "range_size": 1000}
    return hashing.compare_by_hash(
        source, target, "key-range", HASHED, KEY, ORDER_MAPPING, ORDER_RULES, **options
    ).mismatches


@registered
def hash_row_compare(spark, sf):
    return _by_hash(spark, sf, "row").mismatches


@registered
def hash_columns(spark, sf):
    return _by_hash(spark, sf, "column").mismatches


@registered
def hash_verdict(spark, sf):
    return _by_hash(spark, sf, "row").result


@registered
def hash_tolerance(spark, sf):
    target = inputs.orders_target(spark, sf)
    price, kind = target.total_price, T.DoubleType()
    text = lambda t: canonical_text(price, kind, kind, Rule(numeric_tolerance=t), FLOAT_SCALE)
    return target.select(
        "order_key",
        "total_price",
        text(Tolerance(absolute=0.01)).alias("absolute_text"),
        text(Tolerance(percentage=0.5)).cast("double").alias("percentage_value"),
    )


# --- samples ---------------------------------------------------------------


@registered
def sample_first_n(spark, sf):
    return sampling.first_n(inputs.orders(spark, sf), 50, "o_totalprice", ["o_orderkey"])


@registered
def sample_random(spark, sf):
    drawn = sampling.random_sample(inputs.orders(spark, sf), 500, seed=7)
    return drawn.agg(F.count(F.lit(1)).alias("sampled"), F.count_distinct("o_orderkey").alias("distinct_keys"))


@registered
def sample_hash(spark, sf):
    return sampling.hash_sample(inputs.orders(spark, sf), "o_orderkey", 10, 3)


@registered
def sample_stratified(spark, sf):
    return sampling.stratified_sample(inputs.orders(spark, sf), "o_orderstatus", 5, "o_totalprice", ["o_orderkey"])


@registered
def sample_stratified_large(spark, sf):
    return sampling.stratified_sample(inputs.orders(spark, sf), "o_orderstatus", 2000, "o_totalprice", ["o_orderkey"])


@registered
def sample_date_window(spark, sf):
    return sampling.date_window(inputs.orders(spark, sf), "o_orderdate", "1997-01-01 00:00:00", "1997-12-31 23:59:59")


@registered
def sample_key_range(spark, sf):
    return sampling.key_range(inputs.orders(spark, sf), "o_orderkey", 100, 200)


# --- volume and profiles ---------------------------------------------------


@registered
def volume_compare(spark, sf):
    source, target = _order_sides(spark, sf)
    bounds = {"percentage": Tolerance(percentage=0.01), "absolute": Tolerance(absolute=200), "exact": None}
    parts = [compare_volume(source, target, t).withColumn("bound", F.lit(n)) for n, t in bounds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


LINE_DIMENSIONS = [
    Pair("l_returnflag", "return_flag"),
    Pair("l_quantity", "quantity"),
    Derived("ship_month", "ship_month", "date_format(l_shipdate, 'yyyy-MM')", "date_format(ship_date, 'yyyy-MM')"),
]


@registered
def volume_by_dimension(spark, sf):
    """Counts by flag, quantity and month of both sides, in one pass."""
    bounds = {ALL_ROWS: Tolerance(absolute=100), "ship_month": Tolerance(percentage=5)}
    return count_by_dimension(inputs.lines(spark, sf), inputs.lines_target(spark, sf), LINE_DIMENSIONS, Tolerance(percentage=2), bounds)


def _profiled(spark, sf, operator, tables=PROFILED):
    parts = [operator(inputs.table(spark, sf, t)).withColumn("table_name", F.lit(t)) for t in tables]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@registered
def profile_general(spark, sf):
    return _profiled(spark, sf, profile.profile_general)


@registered
def profile_most_common(spark, sf):
    return _profiled(spark, sf, profile.most_common)


@registered
def profile_string(spark, sf):
    return _profiled(spark, sf, profile.profile_string, TEXT_PROFILED)


@registered
def profile_numeric(spark, sf):
    found = _profiled(spark, sf, profile.profile_numeric, (*PROFILED, "lineitem"))
    rounded = {c: F.round(c, 4) for c in ("mean_value", "median_value", "stddev_value")}
    return found.withColumns(rounded)


@registered
def profile_date(spark, sf):
    return _profiled(spark, sf, lambda df: profile.profile_date(df, "2000-01-01 00:00:00"), ("orders", "events", "lineitem"))


@registered
def profile_boolean(spark, sf):
    flagged = inputs.orders(spark, sf).withColumn("is_large", F.col("o_totalprice") > 250000)
    return profile.profile_boolean(flagged)


@registered
def profile_table(spark, sf):
    return profile.profile_table(inputs.orders(spark, sf))


@registered
def profile_top_values(spark, sf):
    return _profiled(spark, sf, lambda df: profile.top_values(df, 3))


def _flagged_sides(spark, sf):
    source, target = _order_sides(spark, sf)
    return source.withColumn("is_large", F.col("o_totalprice") > 250000), target.withColumn(
        "is_large", F.col("total_price") > 0
    )


@registered
def profile_diff(spark, sf):
    return profile.profile_diff(*_flagged_sides(spark, sf), ORDER_MAPPING)


@registered
def profile_category_diff(spark, sf):
    source, target = _flagged_sides(spark, sf)
    return profile.category_changes(source, target, profile.column_pairs(source, target, ORDER_MAPPING))


# --- runs and sinks --------------------------------------------------------


def _definition(spark, sf, name="orders migration") -> Definition:
    source, target = _order_sides(spark, sf)
    checks = Checks(
        schema=True, profile=True, row_count=True, row_level=True, row_count_tolerance=Tolerance(percentage=2.0)
    )
    return Definition(name, source, target, KEY, ORDER_MAPPING, rules=ORDER_RULES, checks=checks)


def _run(spark, sf, only=None) -> Run:
    return run_comparison(spark, _definition(spark, sf), only)


def _flat_findings(findings: DataFrame) -> DataFrame:
    change = lambda d: F.concat_ws(":", d.column_name, d.source_value, d.target_value)
    changes = F.array_join(F.transform("column_differences", change), ";")
    return findings.withColumn("key_values", F.array_join("key_values", ";")).withColumn("column_differences", changes)


@registered
def run_findings(spark, sf):
    return _flat_findings(_run(spark, sf).findings)


@registered
def run_summary(spark, sf):
    return _run(spark, sf).summary


@registered
def run_subset(spark, sf):
    return _flat_findings(_run(spark, sf, ["schema", "profile"]).findings)


@registered
def run_hash_strategy(spark, sf):
    definition = _definition(spark, sf)
    checks = Checks(row_level=True, strategy="hash")
    exact = Definition(definition.name, definition.source, definition.target, KEY, ORDER_MAPPING, checks=checks)
    return rows.category_counts(run_comparison(spark, exact).rows)


@registered
def run_hash_tolerance(spark, sf):
    definition = _definition(spark, sf)
    checks = Checks(row_level=True, strategy="hash")
    loose = Definition(
        definition.name, definition.source, definition.target, KEY, ORDER_MAPPING, rules=ORDER_RULES, checks=checks
    )
    return rows.category_counts(run_comparison(spark, loose).rows)


@registered
def export_csv_rows(spark, sf):
    """All lines of the document that the sink has written."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    exports.write_csv(_run(spark, sf, ["row_level"]), path, "run-1")
    return spark.read.text(path).withColumnRenamed("value", "line")


@registered
def export_json_rows(spark, sf):
    """What the sink has written, counted by kind of finding."""
    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    exports.write_json(_run(spark, sf, ["row_level", "row_count"]), path, "run-1", "2026-01-01T00:00:00.000Z")
    found = spark.read.schema(FINDINGS + ", run_id string").json(f"{path}/findings")
    return found.groupBy("run_id", "kind", "category", "severity").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.size(F.coalesce("column_differences", F.array()))).alias("differences")
    )


@registered
def export_markdown_rows(spark, sf):
    run = _run(spark, sf, ["row_level"])
    return exports.markdown_rows("rows", exports.section_frames(run)["rows"], KEY)


def _recorded(spark, sf) -> str:
    """Three runs in a fresh folder of the shared one."""
    root = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    for stamp, only in (
        ("2026-01-01T00:00:00.000Z", ["row_count"]),
        ("2026-01-02T00:00:00.000Z", ["schema", "row_count"]),
        ("2026-01-03T00:00:00.000Z", ["row_level", "row_count"]),
    ):
        history.persist_run(_run(spark, sf, only), root, stamp)
    return root


@registered
def run_history(spark, sf):
    return history.list_runs(spark, _recorded(spark, sf))


@registered
def run_history_latest(spark, sf):
    root = _recorded(spark, sf)
    latest = history.latest_runs(spark, root, "orders migration")
    newest = history.run_id_for("orders migration", "2026-01-03T00:00:00.000Z")
    listed = history.load_run(spark, root, newest).groupBy("run_id").agg(F.sum("findings").alias("findings"))
    return latest.join(listed, "run_id")


# --- narrowing, aggregates, sketches ---------------------------------------


@registered
def narrow_differences(spark, sf):
    """Defects all over the key range: the descent ends early."""
    source, target = _order_sides(spark, sf)
    found = narrowing.narrow_differences(source, target, KEY, ORDER_MAPPING, ORDER_RULES, float_scale=FLOAT_SCALE)
    return found.result.select(*KEY, "category", "severity", "findings", "source_rows", "target_rows")


@registered
def narrow_differences_partitioned(spark, sf):
    """Two tables partitioned by year, of which two years differ in few rows; the other years are read once."""
    folder = f"{shared_dir(spark)}/narrow-{uuid.uuid4().hex}"
    sides = []
    for name, df in (("source", inputs.orders(spark, sf)), ("target", inputs.from_sql(spark, sf, inputs.ORDERS_DRIFTED, "orders"))):
        df.withColumn("order_year", F.year("o_orderdate")).write.partitionBy("order_year").parquet(f"{folder}/{name}")
        sides.append(spark.read.parquet(f"{folder}/{name}"))
    mapping = [(c, c) for c in sides[0].columns]
    found = narrowing.narrow_differences(*sides, KEY, mapping, partition_column="order_year", row_goal=1000)
    return found.result.select(*KEY, "category", "source_rows", "target_rows")


@registered
def aggregate_parity(spark, sf):
    """All grouping sets of two columns; sums are exact before the tolerance."""
    source = inputs.lines(spark, sf)
    target = inputs.from_sql(spark, sf, inputs.LINES_DRIFTED, "lineitem")
    measures, by = ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag", "l_linestatus"]
    return aggregates.aggregate_parity(source, target, measures, by, tolerances={"l_extendedprice": Tolerance(percentage=0.0001)})


@registered
def profile_distinct_sketch(spark, sf):
    """Estimates from sketches of eight parts, merged, against the exact counts of distinct values."""

    def checked(df):
        parts = df.withColumn("__part", F.pmod(F.xxhash64(df.columns[0]), F.lit(8)))
        merged = sketches.merge_sketches(sketches.sketch_columns(parts, df.columns, "__part"))
        exact = profile.profile_general(df).select("column_name", "distinct_count")
        both = exact.join(sketches.distinct_estimates(merged), "column_name")
        return both.select("column_name", "distinct_count", F.col("distinct_count").between(F.col("low"), F.col("high")).alias("within_error"))

    return _profiled(spark, sf, checked, (*PROFILED, "lineitem"))


@registered
def profile_quantiles(spark, sf):
    """Quantiles from merged sketches, each checked against the exact rank of its value."""
    ranks = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)

    def checked(df):
        parts = df.withColumn("__part", F.pmod(F.xxhash64(df.columns[0]), F.lit(8)))
        found = sketches.quantiles(sketches.merge_sketches(sketches.sketch_columns(parts, df.columns, "__part")), ranks)
        found = found.withColumnRenamed("value", "quantile")
        cells = profile.long_values(df, profile.columns_of(df, ["number"]), "double").where("value IS NOT NULL")
        v, q = F.col("value"), F.col("quantile")
        placed = cells.join(F.broadcast(found), "column_name").groupBy("column_name", "rank", "rank_error").agg(
            F.count_if(v < q).alias("below"), F.count_if(v <= q).alias("upto"), F.count(F.lit(1)).alias("populated")
        )
        share = lambda c: F.col(c) / F.col("populated")
        inside = (share("below") - F.col("rank_error") <= F.col("rank")) & (F.col("rank") <= share("upto") + F.col("rank_error"))
        return placed.select("column_name", "rank", "populated", inside.alias("within_error"))

    return _profiled(spark, sf, checked, (*PROFILED, "lineitem"))


@registered
def profile_patterns(spark, sf):
    return _profiled(spark, sf, lambda df: patterns.frequent_patterns(df, 0.05), ("customer", "orders", "events", "conversations"))


@registered
def run_trend(spark, sf):
    """Slope and change point of the failures of monthly runs, from a history with a planted jump."""
    found = run_trends(inputs.from_sql(spark, sf, inputs.MONTHLY_RUNS, "orders"))
    return found.withColumns({c: F.round(c, 9) for c in ("slope", "p_value")})
