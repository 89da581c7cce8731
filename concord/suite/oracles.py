"""SQL twins of the registered queries, for a database that checks them."""

from __future__ import annotations

import hashlib

from concord.operators.patterns import SHAPES
from concord.suite import inputs

ORDERS_TARGET = inputs.ORDERS_TARGET.replace("{orders}", "orders")
LINES_TARGET = inputs.LINES_TARGET.replace("{lineitem}", "lineitem")
SOURCE_DUMP = inputs.SOURCE_DUMP.replace("{part}", "part")
TARGET_DUMP = inputs.TARGET_DUMP.replace("{part}", "part")
SPACES = [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
SPACE_CHARS = "concat(" + ", ".join(f"chr({c})" for c in SPACES) + ")"
SPACE_RUN = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"

# --- rows ------------------------------------------------------------------

SEVERITY = """CASE category WHEN 'matching' THEN 'Pass' WHEN 'duplicate-in-source' THEN 'Warning'
 WHEN 'duplicate-in-target' THEN 'Warning' WHEN 'unable-to-compare' THEN 'Error' ELSE 'Failure' END"""
MESSAGE = """CASE category WHEN 'matching' THEN 'All mapped columns match after normalization.'
 WHEN 'missing-from-source' THEN 'Key present in target but not found in source.'
 WHEN 'missing-from-target' THEN 'Key present in source but not found in target.'
 WHEN 'duplicate-in-source' THEN 'Key appears more than once in the source record set.'
 WHEN 'duplicate-in-target' THEN 'Key appears more than once in the target record set.'
 WHEN 'unable-to-compare' THEN 'Column "clerk" could not be normalized or compared.'
 ELSE concat('Column(s) differ after normalization: ', replace(differing_columns, ',', ', '), '.') END"""


def _row_ctes(source: str, target: str, keys: list[tuple[str, str]], columns: dict[str, tuple[str, str, str]], unable=False):
    """CTEs up to ``entries``; columns map a name to (source, target, equality of s and t)."""
    k = [a for a, _ in keys]
    picked = lambda pick: "".join(f", any_value({c[pick]}) AS v{i}" for i, c in enumerate(columns.values()))
    on = " AND ".join(f"s.{a} IS NOT DISTINCT FROM t.{a}" for a in k)
    values = "".join(f", s.v{i} AS s{i}, t.v{i} AS t{i}" for i in range(len(columns)))
    equal = [c[2].replace("$s", f"s{i}").replace("$t", f"t{i}") for i, c in enumerate(columns.values())]
    differing = ", ".join(f"CASE WHEN NOT ({e}) THEN '{n}' END" for n, e in zip(columns, equal))
    diff = f"concat_ws(',', {differing})" if columns else "''"
    if unable:
        diff = "''"
    single = "'unable-to-compare'" if unable else "CASE WHEN d = '' THEN 'matching' ELSE 'matched-key-differing-values' END"
    key_list = ", ".join(k)
    return f"""WITH src AS ({source}), tgt AS ({target}),
sk AS (SELECT {", ".join(f"{a}" for a, _ in keys)}, count(*) AS n{picked(0)} FROM src GROUP BY {key_list}),
tk AS (SELECT {", ".join(f"{b} AS {a}" for a, b in keys)}, count(*) AS n{picked(1)} FROM tgt GROUP BY {", ".join(b for _, b in keys)}),
keyed AS (SELECT {", ".join(f"coalesce(s.{a}, t.{a}) AS {a}" for a in k)}, coalesce(s.n, 0) AS source_rows,
 coalesce(t.n, 0) AS target_rows{values} FROM sk s FULL JOIN tk t ON {on}),
checked AS (SELECT *, CASE WHEN source_rows = 1 AND target_rows = 1 THEN {diff} ELSE '' END AS d FROM keyed),
entries AS (
SELECT *, 'duplicate-in-source' AS category, source_rows AS findings FROM checked WHERE source_rows > 1
UNION ALL SELECT *, 'duplicate-in-target', target_rows FROM checked WHERE target_rows > 1
UNION ALL SELECT *, CASE WHEN target_rows = 0 THEN 'missing-from-target' WHEN source_rows = 0 THEN 'missing-from-source'
 ELSE {single} END, 1 FROM checked WHERE source_rows <= 1 AND target_rows <= 1),
found AS (SELECT {key_list}, category, {SEVERITY} AS severity, CAST(findings AS BIGINT) AS findings,
 CAST(source_rows AS BIGINT) AS source_rows, CAST(target_rows AS BIGINT) AS target_rows, d AS differing_columns,
 * EXCLUDE ({key_list}, category, findings, source_rows, target_rows, d) FROM entries)
"""  # noqa: E501


FLAT = "category, severity, findings, source_rows, target_rows, differing_columns, " + MESSAGE + " AS message FROM found"
SAME = "$s IS NOT DISTINCT FROM $t"
ORDER_KEY = [("o_orderkey", "order_key")]
ORDER_COLUMNS = {
    "order_key": ("o_orderkey", "order_key", SAME),
    "order_status": ("lower(trim(o_orderstatus))", "lower(trim(order_status))", SAME),
    "total_price": ("o_totalprice", "total_price", f"({SAME}) OR coalesce(abs($s - $t) <= 0.01, false)"),
    "order_date": ("o_orderdate", "order_date", SAME),
    "order_priority": ("o_orderpriority", "order_priority", SAME),
}
EXACT_COLUMNS = {
    "order_key": ("o_orderkey", "order_key", SAME),
    "order_status": ("o_orderstatus", "order_status", SAME),
    "total_price": ("o_totalprice", "total_price", SAME),
    "order_date": ("o_orderdate", "order_date", SAME),
    "order_priority": ("o_orderpriority", "order_priority", SAME),
}
LINE_COLUMNS = {
    "order_key": ("l_orderkey", "order_key", SAME),
    "line_number": ("l_linenumber", "line_number", SAME),
    "quantity": ("l_quantity", "quantity", SAME),
    "return_flag": ("l_returnflag", "return_flag", SAME),
    "ship_date": ("l_shipdate", "ship_date", SAME),
}


def _orders(columns=None, **options) -> str:
    return _row_ctes("SELECT * FROM orders", ORDERS_TARGET, ORDER_KEY, columns or ORDER_COLUMNS, **options)


def _column_diffs() -> str:
    parts = []
    for i, (name, (_, _, equal)) in enumerate(ORDER_COLUMNS.items()):
        test = equal.replace("$s", f"s{i}").replace("$t", f"t{i}")
        parts.append(
            f"SELECT o_orderkey, '{name}' AS column_name, CAST(s{i} AS VARCHAR) AS source_value, "
            f"CAST(t{i} AS VARCHAR) AS target_value FROM checked WHERE source_rows = 1 AND target_rows = 1 AND NOT ({test})"
        )
    return " UNION ALL ".join(parts)


def _duplicates() -> str:
    named = "SELECT order_key AS l_orderkey, line_number AS l_linenumber, quantity AS l_quantity, return_flag AS l_returnflag, ship_date AS l_shipdate FROM tgt"  # noqa: E501
    return f"""WITH tgt AS ({LINES_TARGET}), rows AS (
 SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_shipdate, 'duplicate-in-source' AS category FROM lineitem
 UNION ALL SELECT *, 'duplicate-in-target' FROM ({named}))
SELECT * FROM rows QUALIFY count(*) OVER (PARTITION BY category, l_orderkey, l_linenumber) > 1"""


# --- types and schemas -----------------------------------------------------


# Type names by category, here without their arguments; those of the second list may carry a length.
PLAIN_NAMES = {
    "Integer": "TINYINT SMALLINT INT INTEGER BIGINT MEDIUMINT INT2 INT4 INT8 SERIAL BIGSERIAL SMALLSERIAL NUMBER".split(),
    "Decimal": ["MONEY", "SMALLMONEY", "DECIMAL", "NUMERIC"],
    "FloatingPoint": ["FLOAT", "FLOAT4", "FLOAT8", "REAL", "DOUBLE", "DOUBLE PRECISION"],
    "Boolean": ["BIT", "BOOLEAN", "BOOL"],
    "JSON": ["JSON", "JSONB", "VARIANT"],
    "Array": ["ARRAY"],
    "Object": ["OBJECT", "STRUCT", "RECORD"],
    "Geospatial": ["GEOGRAPHY", "GEOMETRY", "GEOMETRYCOLLECTION", "POINT", "POLYGON", "LINESTRING"],
    "TimestampWithTimezone": ["TIMESTAMPTZ", "TIMESTAMP_TZ", "TIMESTAMP WITH TIME ZONE", "DATETIMEOFFSET"],
    "Date": ["DATE"],
}
SIZED_NAMES = {
    "String": "VARCHAR NVARCHAR CHAR NCHAR CHARACTER TEXT STRING CLOB BPCHAR".split() + ["CHARACTER VARYING"],
    "Binary": ["BINARY", "VARBINARY", "BYTEA", "BLOB", "IMAGE", "RAW"],
    "Time": ["TIME"],
    "Timestamp": "TIMESTAMP TIMESTAMP_NTZ TIMESTAMPNTZ DATETIME DATETIME2 SMALLDATETIME".split() + ["TIMESTAMP WITHOUT TIME ZONE"],
}
RISKS = {"Decimal": ["FloatingPoint"], "FloatingPoint": ["Decimal", "Integer"], "Integer": ["FloatingPoint"],
         "String": ["Binary"], "Binary": ["String"]}
REVIEWS = {
    "Integer": ["Decimal"], "Decimal": ["Integer"], "Date": ["Timestamp", "TimestampWithTimezone"],
    "Time": ["Timestamp", "TimestampWithTimezone"], "Timestamp": ["Date", "Time", "TimestampWithTimezone"],
    "TimestampWithTimezone": ["Date", "Time", "Timestamp"], "JSON": ["String", "Array", "Object"],
    "Array": ["JSON", "String", "Object"], "Object": ["JSON", "Array", "String"], "String": ["JSON", "Array", "Object"],
}


def _canonical(native: str) -> str:
    """Splits a name into its words and its arguments and looks the words up."""
    name = f"regexp_replace(upper(trim({native})), '\\s+', ' ', 'g')"
    words = f"trim(regexp_replace({name}, ' ?\\([^()]*\\)', ''))"
    inside = f"trim(regexp_extract({name}, '\\(([^()]*)\\)$', 1))"
    bare = f"{name} NOT LIKE '%(%'"
    number = "regexp_full_match({0}, '[0-9]+')"
    first, second = (f"trim(split_part({inside}, ',', {i}))" for i in (1, 2))
    digits = f"{number.format(first)} AND ({number.format(second)} OR ({second} = '' AND {inside} NOT LIKE '%,%'))"
    among = lambda names: f"{words} IN ({', '.join(repr(n) for n in names)})"
    whens = [
        f"WHEN {name} LIKE '%[]' THEN 'Array' WHEN {name} LIKE 'STRUCT(%' THEN 'Object'",
        f"WHEN {words} = 'NUMBER' AND {digits} THEN CASE WHEN TRY_CAST({second} AS INTEGER) > 0 THEN 'Decimal' ELSE 'Integer' END",
        f"WHEN {words} IN ('DECIMAL', 'NUMERIC') AND {digits} THEN 'Decimal'",
        f"WHEN regexp_full_match({name}, 'TIMESTAMP\\([0-9]+\\) WITH TIME ZONE') THEN 'TimestampWithTimezone'",
        f"WHEN {among(SIZED_NAMES['Binary'])} AND {inside} = 'MAX' THEN 'Binary'",
    ]
    whens += [f"WHEN {bare} AND {among(n)} THEN '{c}'" for c, n in (PLAIN_NAMES | SIZED_NAMES).items()]
    whens += [f"WHEN {name} LIKE '%)' AND {number.format(inside)} AND {among(n)} THEN '{c}'" for c, n in SIZED_NAMES.items()]
    return f"CASE {' '.join(whens)} ELSE 'Unknown' END"


def _modifier(native: str, pattern: str, group: int) -> str:
    return f"TRY_CAST(nullif(regexp_extract(upper(trim({native})), '{pattern}', {group}), '') AS INTEGER)"


NUMBER_MODIFIER = r"^(?:DECIMAL|NUMERIC|NUMBER)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)$"
TEXT_MODIFIER = r"^(?:N?VARCHAR|N?CHAR|BPCHAR|CHARACTER(?:\s+VARYING)?|BINARY|VARBINARY)\s*\(\s*(\d+)\s*\)$"
PRECISION = _modifier("data_type", NUMBER_MODIFIER, 1)
MODIFIERS = f"""{_modifier("data_type", TEXT_MODIFIER, 1)} AS length, {PRECISION} AS precision,
 CASE WHEN {PRECISION} IS NOT NULL THEN coalesce({_modifier("data_type", NUMBER_MODIFIER, 2)}, 0) END AS scale"""


def _catalog(dump: str) -> str:
    return f"""SELECT table_name, column_name, ordinal_position AS ordinal, data_type AS native_type,
 {_canonical("data_type")} AS canonical_type, is_nullable = 'YES' AS nullable,
 coalesce(ordinal_position = min(CASE WHEN lower(column_name) LIKE '%id' THEN ordinal_position END)
  OVER (PARTITION BY table_name), false) AS is_pk_candidate, {MODIFIERS} FROM ({dump})"""


def _compatible(a: str, b: str) -> str:
    listed = lambda table: " OR ".join(
        f"({a} = '{x}' AND {b} IN ({', '.join(repr(y) for y in ys)}))" for x, ys in table.items()
    )
    return f"""CASE WHEN {a} = 'Unknown' OR {b} = 'Unknown' THEN 'Review'
 WHEN {a} = {b} THEN CASE WHEN {a} IN ('Timestamp', 'Time') THEN 'Review' ELSE 'Compatible' END
 WHEN {listed(RISKS)} THEN 'Risk' WHEN {listed(REVIEWS)} THEN 'Review'
 WHEN {a} = 'Geospatial' OR {b} = 'Geospatial' THEN 'Review' ELSE 'Risk' END"""


CATALOGS = f"""WITH s AS ({_catalog(SOURCE_DUMP)}), t AS ({_catalog(TARGET_DUMP)}),
p AS (SELECT s.table_name, s.column_name, s.ordinal AS so, t.ordinal AS t_o, s.native_type AS sn, t.native_type AS tn,
 s.canonical_type AS sc, t.canonical_type AS tc, s.nullable AS s_null, t.nullable AS t_null, s.length AS sl, t.length AS tl,
 s.precision AS sp, t.precision AS tp, s.scale AS ss, t.scale AS ts
 FROM s JOIN t ON s.table_name = t.table_name AND s.column_name = t.column_name)"""


def _versus(label: str, a: str, b: str, second: str = "") -> str:
    text = lambda c: f"coalesce(CAST({c} AS VARCHAR), '(none)')"
    return f"""concat('Column "', column_name, '": {label}', {text(a)}, ' (source) vs {second}', {text(b)}, ' (target).')"""


ORDER_CHANGES = """SELECT table_name, column_name, 'order-mismatch' AS kind, 'Informational' AS severity,
 CAST(NULL AS VARCHAR) AS source_type, CAST(NULL AS VARCHAR) AS target_type, concat('Column "', column_name,
 '": relative position ', sr, ' among common columns on the source does not match its relative position on the target.') AS message
 FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY so, column_name) AS sr,
 row_number() OVER (PARTITION BY table_name ORDER BY t_o, column_name) AS tr FROM p) WHERE sr <> tr"""  # noqa: E501


def _schema_diff() -> str:
    typed = f"""SELECT table_name, column_name, 'type-mismatch' AS kind,
 CASE c WHEN 'Risk' THEN 'Failure' ELSE 'Warning' END AS severity, sn AS source_type, tn AS target_type,
 concat('Column "', column_name, '": native type "', sn, '" (', sc, ') vs "', tn, '" (', tc, ') is ', c, '.') AS message
 FROM (SELECT *, {_compatible("sc", "tc")} AS c FROM p) WHERE sn <> tn AND c <> 'Compatible'"""
    pair = lambda kind, severity, message, test: (
        f"SELECT table_name, column_name, '{kind}', {severity}, sn, tn, {message} FROM p WHERE {test}"
    )
    lone = lambda kind, a, b, types, text: (
        f"SELECT table_name, column_name, '{kind}', 'Failure', {types}, concat('Column \"', column_name, '\" {text}') "
        f"FROM {a} WHERE NOT EXISTS (SELECT 1 FROM {b} WHERE {a}.table_name = {b}.table_name AND {a}.column_name = {b}.column_name)"  # noqa: E501
    )
    parts = [
        typed,
        pair("length-mismatch", "CASE WHEN coalesce(tl, 0) > coalesce(sl, 0) THEN 'Informational' ELSE 'Failure' END",
             _versus("length ", "sl", "tl"), "sl IS DISTINCT FROM tl"),
        pair("precision-mismatch", "'Warning'", _versus("precision ", "sp", "tp"), "sp IS DISTINCT FROM tp"),
        pair("scale-mismatch", "'Warning'", _versus("scale ", "ss", "ts"), "ss IS DISTINCT FROM ts"),
        pair("nullability-mismatch", "CASE WHEN s_null THEN 'Warning' ELSE 'Informational' END",
             _versus("nullable=", "s_null", "t_null", "nullable="), "s_null <> t_null"),
        lone("missing-in-target", "s", "t", "native_type, NULL", "is present on the source but missing on the target."),
        lone("missing-in-source", "t", "s", "NULL, native_type", "is present on the target but missing on the source."),
        ORDER_CHANGES,
    ]
    return f"{CATALOGS} {' UNION ALL '.join(parts)}"


# One step per source column, in order: the state is the list of targets already taken.
SUGGEST = f"""WITH RECURSIVE s AS ({_catalog(SOURCE_DUMP)}), t AS ({_catalog(TARGET_DUMP)}),
fold AS (SELECT *, lower(replace(replace(column_name, '_', ''), '-', '')) AS folded FROM t),
o AS (SELECT table_name, column_name, ordinal, lower(replace(replace(column_name, '_', ''), '-', '')) AS folded,
 row_number() OVER (PARTITION BY table_name ORDER BY ordinal, column_name) AS step FROM s),
walk AS (
SELECT DISTINCT table_name, CAST(0 AS BIGINT) AS step, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS source_column,
 CAST(NULL AS VARCHAR) AS target_column, CAST(NULL AS VARCHAR) AS strategy FROM o
UNION ALL
SELECT table_name, step, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick.c) END, source_column, pick.c,
 CASE pick.r WHEN 1 THEN 'exact' WHEN 2 THEN 'case-insensitive' WHEN 3 THEN 'snake-camel' WHEN 4 THEN 'ordinal' END
FROM (
 SELECT w.table_name, o.step, any_value(w.taken) AS taken, o.column_name AS source_column,
  min(CASE WHEN f.column_name = o.column_name THEN {{'r': 1, 'o': f.ordinal, 'c': f.column_name}}
   WHEN lower(f.column_name) = lower(o.column_name) THEN {{'r': 2, 'o': f.ordinal, 'c': f.column_name}}
   WHEN f.folded = o.folded THEN {{'r': 3, 'o': f.ordinal, 'c': f.column_name}}
   WHEN f.ordinal = o.ordinal THEN {{'r': 4, 'o': f.ordinal, 'c': f.column_name}} END) AS pick
 FROM walk w JOIN o ON o.table_name = w.table_name AND o.step = w.step + 1
 LEFT JOIN fold f ON f.table_name = w.table_name AND NOT list_contains(w.taken, f.column_name)
 GROUP BY w.table_name, o.step, o.column_name))
SELECT table_name, source_column, target_column, strategy FROM walk WHERE target_column IS NOT NULL"""


# --- hashes ----------------------------------------------------------------


def _part(text: str) -> str:
    return f"CASE WHEN {text} IS NULL THEN 'n' ELSE concat('v', length({text}), ':', {text}) END"


def _hash(*texts: str) -> str:
    return f"sha256(concat({', '.join(_part(t) for t in texts)}))"


def _lanes(hashed: str, where: str = "true") -> list[str]:
    return [
        f"coalesce(sum(CAST(concat('0x', substr({hashed}, {1 + 15 * i}, 15)) AS BIGINT)) FILTER (WHERE {where}), 0)" for i in range(4)
    ]  # noqa: E501


def _digest(hashed: str, where: str = "true") -> str:
    return f"sha256(concat_ws(':', count(*) FILTER (WHERE {where}), {', '.join(_lanes(hashed, where))}))"


STEP = "CAST(CAST(floor({0} / 0.01 + 0.5) * 0.01 AS DECIMAL(38,4)) AS VARCHAR)"
SOURCE_TEXTS = ("lower(trim(o_orderstatus))", STEP.format("o_totalprice"), "o_orderpriority")
TARGET_TEXTS = ("lower(trim(order_status))", STEP.format("total_price"), "order_priority")
HASHED = f"""WITH tgt AS ({ORDERS_TARGET}), h AS (
SELECT o_orderkey AS k, o_orderstatus AS p, true AS src, {_hash(*SOURCE_TEXTS)} AS h,
 {", ".join(_hash("CAST(o_orderkey AS VARCHAR)", t) + f" AS h{i}" for i, t in enumerate(SOURCE_TEXTS))} FROM orders
UNION ALL SELECT order_key, order_status, false, {_hash(*TARGET_TEXTS)},
 {", ".join(_hash("CAST(order_key AS VARCHAR)", t) for t in TARGET_TEXTS)} FROM tgt)"""
HASHED_NULLS = f"{HASHED}, hn AS (SELECT CASE WHEN k % 50 <> 0 THEN k END AS k, src, h FROM h)"
SIDES = f"""count(*) FILTER (WHERE src) AS source_rows, count(*) FILTER (WHERE NOT src) AS target_rows,
 {_digest("h", "src")} AS source_hash, {_digest("h", "NOT src")} AS target_hash"""
UNEQUAL = """source_rows, target_rows, CASE WHEN source_rows > 0 THEN source_hash END AS source_hash,
 CASE WHEN target_rows > 0 THEN target_hash END AS target_hash FROM g WHERE source_hash <> target_hash"""
ROW_HASHES = """placed AS (SELECT k, src, h, row_number() OVER (PARTITION BY k, src ORDER BY h) AS position FROM h),
m AS (SELECT k AS o_orderkey, position, max(h) FILTER (WHERE src) AS source_hash,
 max(h) FILTER (WHERE NOT src) AS target_hash FROM placed GROUP BY k, position
 HAVING max(h) FILTER (WHERE src) IS DISTINCT FROM max(h) FILTER (WHERE NOT src))"""


def _hash_columns() -> str:
    names = ("order_status", "total_price", "order_priority")
    parts = [
        f"SELECT '{n}' AS column_name, {_digest(f'h{i}', 'src')} AS source_hash, {_digest(f'h{i}', 'NOT src')} AS target_hash FROM shared"  # noqa: E501
        for i, n in enumerate(names)
    ]
    return f"""{HASHED}, shared AS (SELECT * FROM h WHERE k IN (SELECT k FROM h WHERE src) AND k IN (SELECT k FROM h WHERE NOT src))
SELECT * FROM ({" UNION ALL ".join(parts)}) WHERE source_hash <> target_hash"""  # noqa: E501


# --- profiles --------------------------------------------------------------

TEXT, NUMBER, TIME = "text", "number", "time"
COLUMNS = {
    "customer": {"c_custkey": NUMBER, "c_name": TEXT, "c_nationkey": NUMBER, "c_acctbal": NUMBER, "c_mktsegment": TEXT},
    "orders": {
        "o_orderkey": NUMBER, "o_custkey": NUMBER, "o_orderstatus": TEXT, "o_totalprice": NUMBER, "o_orderdate": TIME,
        "o_orderpriority": TEXT,
    },
    "events": {"event_id": NUMBER, "ts": TIME, "user_id": NUMBER, "event_type": TEXT, "value": NUMBER, "props": TEXT},
    "documents": {"doc_id": NUMBER, "text": TEXT, "lang": TEXT, "source": TEXT, "n_chars": NUMBER},
    "conversations": {"conv_id": NUMBER, "turn": NUMBER, "role": TEXT, "text": TEXT},
    "lineitem": {
        "l_orderkey": NUMBER, "l_partkey": NUMBER, "l_suppkey": NUMBER, "l_linenumber": NUMBER, "l_quantity": NUMBER,
        "l_extendedprice": NUMBER, "l_discount": NUMBER, "l_tax": NUMBER, "l_returnflag": TEXT, "l_linestatus": TEXT,
        "l_shipdate": TIME,
    },
}
PROFILED = ("customer", "orders", "events")


def _per_column(tables, kinds, select: str, tail: str = "") -> str:
    parts = [
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, {select.replace('$c', f'{t}.{c}')} FROM {t} {tail.replace('$c', f'{t}.{c}')}"
        for t in tables
        for c, kind in COLUMNS[t].items()
        if kind in kinds
    ]
    return " UNION ALL ".join(f"({p})" for p in parts)


GENERAL = """count(*) AS row_count, count($c) AS populated_count, count(*) - count($c) AS null_count,
 CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE (count(*) - count($c))::DOUBLE / count(*) * 100 END AS null_percentage,
 count(DISTINCT $c) AS distinct_count, greatest(0, count($c) - count(DISTINCT $c)) AS duplicate_count"""
STRINGS = """count(*) FILTER (WHERE $c = '') AS empty_count,
 count(*) FILTER (WHERE trim($c) = '' AND $c <> '') AS blank_count,
 coalesce(min(length($c)), 0) AS min_length, coalesce(max(length($c)), 0) AS max_length,
 coalesce(avg(length($c)), 0.0::DOUBLE) AS avg_length,
 count(*) FILTER (WHERE $c = upper($c) AND $c <> lower($c)) AS upper_count,
 count(*) FILTER (WHERE $c = lower($c) AND $c <> upper($c)) AS lower_count,
 count($c) - count(*) FILTER (WHERE $c = upper($c) AND $c <> lower($c))
  - count(*) FILTER (WHERE $c = lower($c) AND $c <> upper($c)) AS mixed_count"""
NUMBERS = """min($c)::DOUBLE AS min_value, max($c)::DOUBLE AS max_value, round(avg($c::DOUBLE), 4) AS mean_value,
 round(median($c::DOUBLE), 4) AS median_value, round(stddev_samp($c::DOUBLE), 4) AS stddev_value,
 count(*) FILTER (WHERE $c = 0) AS zero_count, count(*) FILTER (WHERE $c < 0) AS negative_count,
 count(*) FILTER (WHERE $c > 0) AS positive_count"""
DATES = """min($c) AS earliest_value, max($c) AS latest_value,
 count(*) FILTER (WHERE $c > TIMESTAMP '2000-01-01 00:00:00') AS future_count"""
COMMON = "CAST($c AS VARCHAR) AS value, count(*) AS value_count"
COMMON_TAIL = "WHERE $c IS NOT NULL GROUP BY $c ORDER BY count(*) DESC, $c LIMIT 1"
TOP = "row_number() OVER (ORDER BY count(*) DESC, $c)::INTEGER AS place, CAST($c AS VARCHAR) AS value, count(*) AS value_count"  # noqa: E501
TOP_TAIL = "WHERE $c IS NOT NULL GROUP BY $c ORDER BY count(*) DESC, $c LIMIT 3"
EVERY = (TEXT, NUMBER, TIME)


RANKS = ", (SELECT unnest([0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]::DOUBLE[]) AS rank) WHERE $c IS NOT NULL GROUP BY rank"


def _patterns() -> tuple[str, str]:
    """Shapes by the same classes; there are no references within a pattern here, so each class folds on its own."""
    shape, marks = "$c", [(kind, chr(0xE000 + i), sign) for i, (kind, sign) in enumerate(SHAPES)]
    for kind, mark, _ in marks:
        shape = f"regexp_replace({shape}, '{kind}', '{mark}', 'g')"
    for _, mark, _ in marks:
        shape = f"regexp_replace({shape}, '{mark}{{2,}}', '{mark}+', 'g')"
    for _, mark, sign in marks:
        shape = f"replace({shape}, '{mark}', '{sign}')"
    picked = f"{shape} AS pattern, count(*) AS value_count, count(*)::DOUBLE / sum(count(*)) OVER () * 100 AS percentage"
    return picked, f"WHERE $c IS NOT NULL GROUP BY {shape} QUALIFY count(*) >= sum(count(*)) OVER () * 0.05"


def _aggregates() -> str:
    """Sums are exact as whole numbers of units of a power of two; a double is made of two exact parts, so that it is rounded once."""
    units = {"l_quantity": 20, "l_extendedprice": 45, "l_discount": 62}
    parts = []
    for side, table in (("s", "lineitem"), ("t", "drifted")):
        measured = ", ".join(
            f"count({c}) AS {c}_n, sum(CAST({c} * pow(2.0, {u}) AS HUGEINT)) AS {c}_u, min({c}) AS {c}_min, max({c}) AS {c}_max"
            for c, u in units.items()
        )
        parts.append(
            f"{side} AS (SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag, l_linestatus) AS g, {measured} FROM {table} "
            "GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ()))"
        )
    rows = []
    label = "CASE g WHEN 0 THEN 'l_returnflag,l_linestatus' WHEN 1 THEN 'l_returnflag' WHEN 2 THEN 'l_linestatus' ELSE '' END"
    on = "s.g = t.g AND s.l_returnflag IS NOT DISTINCT FROM t.l_returnflag AND s.l_linestatus IS NOT DISTINCT FROM t.l_linestatus"
    for c, u in units.items():
        total = f"((CAST($.{c}_u // 1099511627776 AS DOUBLE) * 1099511627776.0 + CAST($.{c}_u % 1099511627776 AS DOUBLE)) / pow(2.0, {u}))"
        metrics = {
            "count": (f"CAST($.{c}_n AS DOUBLE)", f"s.{c}_n = t.{c}_n", False),
            "sum": (total, f"s.{c}_u = t.{c}_u", True),
            "avg": (f"({total} / $.{c}_n)", f"s.{c}_u = t.{c}_u AND s.{c}_n = t.{c}_n", True),
            "min": (f"$.{c}_min", f"s.{c}_min = t.{c}_min", True),
            "max": (f"$.{c}_max", f"s.{c}_max = t.{c}_max", True),
        }
        for metric, (value, equal, tolerant) in metrics.items():
            a, b = value.replace("$", "s"), value.replace("$", "t")
            close = f"abs({a} - {b}) / greatest(abs({a}), abs({b})) * 100 <= 0.0001" if tolerant and c == "l_extendedprice" else "false"
            rows.append(
                f"SELECT s.l_returnflag, s.l_linestatus, {label.replace('g WHEN', 's.g WHEN', 1)} AS grouping, '{c}' AS column_name, '{metric}' AS metric, "
                f"{a} AS source_value, {b} AS target_value, CASE WHEN {equal} THEN 'equal' WHEN {close} THEN 'within-tolerance' "
                f"ELSE 'differing' END AS category FROM s JOIN t ON {on}"
            )
    drifted = inputs.LINES_DRIFTED.replace("{lineitem}", "lineitem")
    return (
        f"WITH drifted AS ({drifted}), {', '.join(parts)}, found AS ({' UNION ALL '.join(rows)}) "
        "SELECT *, CASE category WHEN 'differing' THEN 'Failure' ELSE 'Pass' END AS severity FROM found"
    )


def _profile_table() -> str:
    each = ", ".join(f"count({c}) AS {c}_non_null_count, count(DISTINCT {c}) AS {c}_distinct_count" for c in COLUMNS["orders"])
    return f"SELECT count(*) AS total_count, {each} FROM orders"


def _profile_diff(flag: bool) -> str:
    pairs = {
        "o_orderkey": "order_key", "o_orderstatus": "order_status", "o_totalprice": "total_price",
        "o_orderdate": "order_date", "o_orderpriority": "order_priority",
    }
    if flag:
        pairs["is_large"] = "is_large"
    parts = []
    for s, t in pairs.items():
        side = lambda c, table: (
            f"(SELECT count(DISTINCT {c}) AS d, (count(*) - count({c}))::DOUBLE / count(*) * 100 AS n, "
            f"(SELECT CAST({c} AS VARCHAR) FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS m "  # noqa: E501
            f"FROM {table})"
        )
        parts.append(f"SELECT '{s}' AS column_name, a.*, b.d AS d2, b.n AS n2, b.m AS m2 FROM {side(s, 'src')} a, {side(t, 'tgt')} b")
    quoted = lambda c: f"""coalesce(concat('"', {c}, '"'), '(none)')"""
    percent = lambda c: f"printf('%.2f%%', {c})"
    text = lambda what, a, b: f"""concat('Column "', column_name, '": {what} changed from ', {a}, ' (source) to ', {b}, ' (target).') AS message"""  # noqa: E731,E501
    return f"""WITH src AS (SELECT *, o_totalprice > 250000 AS is_large FROM orders),
tgt AS (SELECT *, total_price > 0 AS is_large FROM ({ORDERS_TARGET})), m AS ({" UNION ALL ".join(parts)}),
flags AS (SELECT CAST(is_large AS VARCHAR) AS v, true AS s FROM src UNION SELECT CAST(is_large AS VARCHAR), false FROM tgt),
lone AS (SELECT v, bool_or(s) AS s FROM flags WHERE v IS NOT NULL GROUP BY v HAVING count(*) = 1),
category AS (SELECT 'is_large' AS column_name, CASE WHEN s THEN 'missingTargetValue' ELSE 'newTargetValue' END AS metric,
 'Warning' AS severity, CASE WHEN s THEN v END AS source_value, CASE WHEN NOT s THEN v END AS target_value,
 CASE WHEN s THEN concat('Column "is_large": value "', v, '" was observed on the source but is missing on the target.')
 ELSE concat('Column "is_large": value "', v, '" is present on the target but was not observed on the source.') END AS message
 FROM lone),
diff AS (
SELECT column_name, 'distinctCount' AS metric, 'Informational' AS severity, CAST(d AS VARCHAR) AS source_value,
 CAST(d2 AS VARCHAR) AS target_value, {text("distinct value count", "d", "d2")} FROM m WHERE d <> d2
UNION ALL SELECT column_name, 'nullPercentage', 'Warning', CAST(n AS VARCHAR), CAST(n2 AS VARCHAR),
 {text("null percentage", percent("n"), percent("n2"))} FROM m WHERE abs(n - n2) >= 0.5
UNION ALL SELECT column_name, 'mostCommonValue', 'Warning', m, m2, {text("most common value", quoted("m"), quoted("m2"))}
 FROM m WHERE m IS DISTINCT FROM m2)"""  # noqa: E501


# --- volume and runs -------------------------------------------------------


def _volume(bound: str, test: str) -> str:
    return f"""SELECT source_rows, target_rows, difference, difference_rate,
 CASE WHEN difference = 0 THEN 'Pass' WHEN {test} THEN 'Failure' ELSE 'Informational' END AS severity,
 concat('Row count: source ', format('{{:,}}', source_rows), ', target ', format('{{:,}}', target_rows), ', difference ',
 format('{{:,}}', difference), printf(' (%.4f%%)', difference_rate), ', evaluated against {bound}: ',
 CASE WHEN {test} THEN 'FAIL' ELSE 'PASS' END, '.') AS message"""


COUNTS = f"""counts AS (SELECT *, target_rows - source_rows AS difference, CASE WHEN source_rows = 0 THEN 0.0::DOUBLE ELSE
 (target_rows - source_rows)::DOUBLE / source_rows * 100 END AS difference_rate FROM (SELECT
 (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM ({ORDERS_TARGET})) AS target_rows))"""
NO_TOLERANCE = ("exact equality (no tolerance configured)", "difference <> 0")


def _volume_by_dimension() -> str:
    dimensions = {
        "l_returnflag": ("l_returnflag", "return_flag", "2.0000% tolerance", "abs(difference_rate) > 2"),
        "l_quantity": ("CAST(l_quantity AS VARCHAR)", "CAST(quantity AS VARCHAR)", "2.0000% tolerance", "abs(difference_rate) > 2"),
        "ship_month": ("strftime(l_shipdate, '%Y-%m')", "strftime(ship_date, '%Y-%m')", "5.0000% tolerance", "abs(difference_rate) > 5"),
        "all rows": ("CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "100 row absolute tolerance", "abs(difference) > 100"),
    }
    parts = []
    for name, (a, b, words, test) in dimensions.items():
        counted = (
            f"SELECT coalesce(s.v, t.v) AS v, coalesce(s.n, 0) AS source_rows, coalesce(t.n, 0) AS target_rows FROM "
            f"(SELECT {a} AS v, count(*) AS n FROM lineitem GROUP BY ALL) s FULL JOIN "
            f"(SELECT {b} AS v, count(*) AS n FROM tgt GROUP BY ALL) t ON s.v IS NOT DISTINCT FROM t.v"
        )
        lacking = "source_rows = 0 OR target_rows = 0"
        parts.append(
            f"SELECT '{name}' AS dimension, v AS dimension_value, CASE WHEN source_rows = 0 THEN 'missing-from-source' "
            "WHEN target_rows = 0 THEN 'missing-from-target' WHEN difference = 0 THEN 'matching' ELSE 'differing-counts' END AS category, "
            f"* EXCLUDE (v) FROM ({_volume(words, f'({lacking} OR {test})').replace('SELECT ', 'SELECT v, ', 1)} FROM "
            "(SELECT *, target_rows - source_rows AS difference, CASE WHEN source_rows = 0 THEN 0.0::DOUBLE ELSE "
            f"(target_rows - source_rows)::DOUBLE / source_rows * 100 END AS difference_rate FROM ({counted})))"
        )
    return f"WITH tgt AS ({LINES_TARGET}) " + " UNION ALL ".join(parts)


RUN_SCHEMA = {
    "o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_orderstatus": "STRING", "o_totalprice": "DOUBLE",
    "o_orderdate": "TIMESTAMP", "o_orderpriority": "STRING",
}
RUN_TARGET_SCHEMA = {
    "order_key": "BIGINT", "cust_key": "BIGINT", "order_status": "STRING", "total_price": "DOUBLE",
    "order_date": "TIMESTAMP", "order_priority": "STRING",
}


def _run_schema() -> str:
    none = "CAST(NULL AS VARCHAR)"
    rows = []
    for side, other, columns in (("source", "target", RUN_SCHEMA), ("target", "source", RUN_TARGET_SCHEMA)):
        for c, kind in columns.items():
            types = (f"'{kind}'", none) if side == "source" else (none, f"'{kind}'")
            rows.append(
                f"""SELECT 'schema' AS kind, 'Failure' AS severity, 'missing-in-{other}' AS category, '{c}' AS column_name,
 {none} AS key_values, {types[0]} AS source_value, {types[1]} AS target_value,
 'Column "{c}" is present on the {side} but missing on the {other}.' AS message, {none} AS column_differences,
 CAST(1 AS BIGINT) AS findings"""
            )
    return " UNION ALL ".join(rows)


def _row_findings() -> str:
    change = ", ".join(
        f"CASE WHEN NOT ({e.replace('$s', f's{i}').replace('$t', f't{i}')}) THEN concat_ws(':', '{n}', CAST(s{i} AS VARCHAR), CAST(t{i} AS VARCHAR)) END"  # noqa: E501
        for i, (n, (_, _, e)) in enumerate(ORDER_COLUMNS.items())
    )
    return f"""SELECT 'rows', severity, category, NULL, CAST(o_orderkey AS VARCHAR), NULL, NULL, {MESSAGE},
 CASE WHEN category = 'matched-key-differing-values' THEN concat_ws(';', {change}) ELSE '' END, findings
 FROM found WHERE category <> 'matching'
UNION ALL SELECT 'rows', 'Pass', 'matching', NULL, NULL, NULL, NULL, 'All mapped columns match after normalization.', NULL,
 CAST(sum(findings) AS BIGINT) FROM found WHERE category = 'matching' HAVING count(*) > 0"""


def _run(parts: str) -> str:
    """CTE ``run`` with the findings of the chosen checks, in the shape of a run's findings."""
    rows = _orders()
    profile = _profile_diff(False)[len("WITH ") :].replace("src AS", "psrc AS").replace("tgt AS", "ptgt AS")
    profile = profile.replace("FROM src", "FROM psrc").replace("FROM tgt", "FROM ptgt")
    pieces = {
        "schema": _run_schema(),
        "profile": "SELECT 'profile', severity, metric, column_name, NULL, source_value, target_value, message, NULL, 1 FROM diff",
        "volume": f"""SELECT 'volume', severity, 'row-count', NULL, NULL, CAST(source_rows AS VARCHAR), CAST(target_rows AS VARCHAR),
 message, NULL, 1 FROM ({_volume("2.0000% tolerance", "abs(difference_rate) > 2.0")} FROM counts)""",
        "rows": _row_findings(),
    }  # noqa: E501
    chosen = [pieces[p] for p in parts.split()]
    names = "kind, severity, category, column_name, key_values, source_value, target_value, message, column_differences, findings"
    return f"{rows}, {profile}, {COUNTS}, run({names}) AS ({' UNION ALL '.join(chosen)})"


def _summed(parts: str, extra: str = "") -> str:
    return f"""{_run(parts)}, total AS (SELECT
 CAST(coalesce(sum(findings) FILTER (WHERE severity IN ('Pass', 'Informational', 'Skipped')), 0) AS BIGINT) AS passed,
 CAST(coalesce(sum(findings) FILTER (WHERE severity = 'Warning'), 0) AS BIGINT) AS warnings,
 CAST(coalesce(sum(findings) FILTER (WHERE severity IN ('Failure', 'Error')), 0) AS BIGINT) AS failed FROM run)
SELECT 'orders migration' AS comparison, CASE WHEN failed > 0 THEN 'failed' WHEN warnings > 0 THEN 'warning' ELSE 'passed' END
 AS status, passed, warnings, failed, source_rows, target_rows, difference, '(custom query)' AS source_label,
 '(custom query)' AS target_label{extra} FROM total, counts"""  # noqa: E501


def _history() -> str:
    stamps = ("2026-01-01T00:00:00.000Z", "2026-01-02T00:00:00.000Z", "2026-01-03T00:00:00.000Z")
    parts = ("volume", "schema volume", "rows volume")
    tagged = lambda s: f", '{s}' AS timestamp, '{_run_id(s)}' AS run_id"
    return " UNION ALL ".join(f"(SELECT * FROM ({_summed(p, tagged(s))}))" for s, p in zip(stamps, parts))


def _trend() -> str:
    """Medians and signs over all pairs of runs of a comparison."""
    return f"""WITH hist AS ({inputs.MONTHLY_RUNS.replace("{orders}", "orders")}),
r AS (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY comparison ORDER BY timestamp DESC, run_id DESC) <= 60),
o AS (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY timestamp, run_id) AS i, count(*) OVER (PARTITION BY comparison) AS n FROM r),
s AS (SELECT a.comparison, median((b.failed - a.failed)::DOUBLE / (b.i - a.i)) AS slope FROM o a JOIN o b ON a.comparison = b.comparison AND a.i < b.i GROUP BY 1),
v AS (SELECT a.comparison, a.i, a.n, sum(sign(b.failed - a.failed)) AS v FROM o a JOIN o b USING (comparison) GROUP BY ALL),
u AS (SELECT comparison, i, n, abs(sum(v) OVER (PARTITION BY comparison ORDER BY i)) AS u FROM v),
k AS (SELECT comparison, n, i AS k, CAST(u AS DOUBLE) AS most FROM u WHERE i < n AND n >= 8 QUALIFY row_number() OVER (PARTITION BY comparison ORDER BY u DESC, i) = 1),
m AS (SELECT o.comparison, median(CASE WHEN o.i > k.k THEN failed END) - median(CASE WHEN o.i <= k.k THEN failed END) AS shift,
 max(CASE WHEN o.i = k.k + 1 THEN timestamp END) AS change_at, max(CASE WHEN o.i = k.k + 1 THEN run_id END) AS change_run_id
 FROM o JOIN k USING (comparison) WHERE most > 0 GROUP BY 1),
p AS (SELECT comparison, least(1.0::DOUBLE, 2 * exp(-6 * most * most / (n::DOUBLE * n * n + n * n))) AS p FROM k)
SELECT c.comparison, c.runs, CASE WHEN runs >= 8 THEN round(slope, 9) END AS slope, change_at, change_run_id, CAST(shift AS DOUBLE) AS shift,
 round(p, 9) AS p_value, p <= 0.01 AS changed FROM (SELECT comparison, count(*) AS runs FROM o GROUP BY 1) c
 LEFT JOIN s USING (comparison) LEFT JOIN m USING (comparison) LEFT JOIN p USING (comparison)"""  # noqa: E501


def _run_id(stamp: str) -> str:
    digest = hashlib.md5(b"orders migration", usedforsecurity=False).hexdigest()[:8]
    return f"orders_migration-{digest}-" + stamp.replace(":", "-").replace(".", "-")


def _export(line: str) -> str:
    change = ", ".join(
        f"CASE WHEN NOT ({e.replace('$s', f's{i}').replace('$t', f't{i}')}) THEN concat('{n}: ', "
        f"coalesce(CAST(s{i} AS VARCHAR), 'null'), ' -> ', coalesce(CAST(t{i} AS VARCHAR), 'null')) END"
        for i, (n, (_, _, e)) in enumerate(ORDER_COLUMNS.items())
    )
    return f"""{_orders()}, listed AS (SELECT severity, category, CAST(o_orderkey AS VARCHAR) AS k, {MESSAGE} AS message,
 CASE WHEN category = 'matched-key-differing-values' THEN concat_ws('; ', {change}) ELSE '' END AS changes,
 unnest(generate_series(1, findings)) AS copy FROM found) SELECT {line} AS line FROM listed"""


# The lines of a CSV document that do not depend on findings.
CSV_FIXED = (
    "Section,Comparison,RunId,Status", "Summary,orders migration,run-1,failed", "", "Schema Differences",
    "Severity,ColumnName,Kind,SourceType,TargetType,Message", "", "Profile Differences",
    "Severity,ColumnName,Metric,SourceValue,TargetValue,Message", "", "Volume (Aggregate) Differences",
    "Severity,SourceCount,TargetCount,Difference,DifferenceRate,Message", "", "Row-Level Differences",
    "Severity,Category,KeyValues,Message,ColumnDifferences",
)


def _csv(c: str) -> str:
    return f"""CASE WHEN regexp_matches({c}, '[",\\n\\r]') THEN concat('"', replace({c}, '"', '""'), '"') ELSE {c} END"""


def _markdown(c: str) -> str:
    return f"replace(replace({c}, '|', '\\|'), chr(10), ' ')"


LISTED = ("severity", "category", "k", "message", "changes")


def oracles() -> dict[str, str]:
    in_unit = "strftime(timezone('UTC', timezone('America/New_York', date_trunc('second', ts))), '%Y-%m-%dT%H:%M:%S.000Z')"
    hour_bucket = "CAST(concat('0x', substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15)) AS BIGINT) % 10 = 3"
    price = "(a - b)"
    magnitude = "greatest(0, 4 - (CAST(floor(log10(abs(total_price))) AS INTEGER) + 1))"
    return {
        "scan_table": "SELECT * FROM orders",
        "scan_query": "SELECT o_orderstatus, o_orderkey, o_totalprice * 2 AS double_price FROM orders",
        "scan_sql_file": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
        "scan_where": "SELECT * FROM orders WHERE o_orderstatus = 'F'",
        "scan_limit": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100",
        "row_compare": f"{_orders()} SELECT o_orderkey, {FLAT}",
        "row_column_diffs": f"{_orders()} {_column_diffs()}",
        "row_severity_summary": f"{_orders()} SELECT category, severity, CAST(sum(findings) AS BIGINT) AS findings FROM found GROUP BY ALL",  # noqa: E501
        "rows_missing_from_target": f"SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT order_key FROM ({ORDERS_TARGET})) QUALIFY count(*) OVER (PARTITION BY o_orderkey) = 1",  # noqa: E501
        "rows_missing_from_source": f"SELECT * FROM ({ORDERS_TARGET}) WHERE order_key NOT IN (SELECT o_orderkey FROM orders) QUALIFY count(*) OVER (PARTITION BY order_key) = 1",  # noqa: E501
        "rows_duplicate_keys": _duplicates(),
        "row_compare_composite": _row_ctes(
            "SELECT * FROM lineitem", LINES_TARGET, [("l_orderkey", "order_key"), ("l_linenumber", "line_number")], LINE_COLUMNS
        )
        + f"SELECT l_orderkey, l_linenumber, {FLAT}",
        "row_compare_derived": _orders(
            {"order_key": ORDER_COLUMNS["order_key"], "priority_text": ("upper(o_orderpriority)", "upper(order_priority)", SAME)}
        )
        + f"SELECT o_orderkey, {FLAT}",
        "row_compare_ignore": _orders({c: v for c, v in ORDER_COLUMNS.items() if c not in ("order_priority", "order_date")})
        + f"SELECT o_orderkey, {FLAT}",
        "row_compare_time_tolerance": _row_ctes(
            "SELECT * FROM orders", inputs.ORDERS_SHIFTED.replace("{orders}", "orders"), [("o_orderkey", "o_orderkey")],
            {"order_date": ("o_orderdate", "order_date", f"({SAME}) OR coalesce(abs(epoch_us($s) - epoch_us($t)) <= 60000000, false)")},
        )
        + f"SELECT o_orderkey, {FLAT}",
        "row_unable_to_compare": f"{_orders(unable=True)} SELECT o_orderkey, {FLAT}",
        "norm_null_equivalents": f"SELECT order_key, order_priority AS raw_value, CASE WHEN order_priority NOT IN ('N/A', 'unknown') THEN order_priority END AS value FROM ({ORDERS_TARGET})",  # noqa: E501
        "norm_string": f"SELECT doc_id, text AS raw_value, regexp_replace(lower(trim(text, {SPACE_CHARS})), '{SPACE_RUN}', ' ', 'g') AS value FROM documents",  # noqa: E501
        "norm_full_rule": f"SELECT order_key, order_status AS raw_value, CASE WHEN order_status <> '  f ' THEN lower(trim(order_status)) END AS value FROM ({ORDERS_TARGET})",  # noqa: E501
        "norm_timezone": f"SELECT event_id, CAST(ts AS VARCHAR) AS raw_value, {in_unit} AS value FROM events",
        "norm_truncate": "SELECT event_id, CAST(ts AS VARCHAR) AS raw_value, strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S.000Z') AS value, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour FROM events",  # noqa: E501
        "tolerance_equal": f"""{_orders({"total_price": ("o_totalprice", "total_price", SAME)})}, v AS (
 SELECT o_orderkey, s0 AS a, t0 AS b, CAST(CAST(s0 AS DECIMAL(18,4)) AS DOUBLE) AS x FROM checked WHERE source_rows = 1 AND target_rows = 1)
 SELECT o_orderkey, a = b AS strict, abs{price} <= 0.01 AS within_absolute,
 a = b OR abs{price} / greatest(abs(a), abs(b)) * 100 <= 0.005 AS within_percentage,
 abs(x - b) <= 0.01 AS text_within_absolute FROM v""",  # noqa: E501
        "catalog_describe": _catalog(SOURCE_DUMP),
        "type_map": f"SELECT table_name, column_name, data_type, {_canonical('data_type')} AS canonical_type FROM ({SOURCE_DUMP})",
        "type_modifiers": f"SELECT table_name, column_name, data_type, {MODIFIERS} FROM ({SOURCE_DUMP})",
        "type_compat": f"{CATALOGS} SELECT table_name, column_name, sc AS source_type, tc AS target_type, {_compatible('sc', 'tc')} AS compatibility, {_compatible('tc', 'sc')} AS reverse_compatibility FROM p",  # noqa: E501
        "schema_diff": _schema_diff(),
        "schema_order": f"{CATALOGS} {ORDER_CHANGES}",
        "suggest_mappings": SUGGEST,
        "hash_rows": f"SELECT o_orderkey, {_hash('lower(trim(o_orderstatus))', 'CAST(CAST(o_totalprice AS DECIMAL(38,4)) AS VARCHAR)', 'o_orderpriority')} AS row_hash FROM orders",  # noqa: E501
        "hash_table": f"{HASHED}, g AS (SELECT {SIDES} FROM h) SELECT 'table' AS level, *, source_hash = target_hash AS matched FROM g",  # noqa: E501
        "hash_partitions": f"{HASHED}, g AS (SELECT p AS partition_value, {SIDES} FROM h GROUP BY p) SELECT partition_value, {UNEQUAL}",  # noqa: E501
        "hash_key_ranges": f"{HASHED}, ranked AS (SELECT *, (dense_rank() OVER (ORDER BY k) - 1) // 1000 AS bucket FROM h), g AS (SELECT min(k) AS range_start, max(k) AS range_end, {SIDES} FROM ranked GROUP BY bucket) SELECT range_start, range_end, {UNEQUAL}",  # noqa: E501
        "hash_key_ranges_null_keys": f"{HASHED_NULLS}, ranked AS (SELECT *, CASE WHEN k IS NOT NULL THEN (dense_rank() OVER (ORDER BY k NULLS LAST) - 1) // 1000 END AS bucket FROM hn), g AS (SELECT min(k) AS range_start, max(k) AS range_end, {SIDES} FROM ranked GROUP BY bucket) SELECT range_start, range_end, {UNEQUAL}",  # noqa: E501
        "hash_row_compare": f"{HASHED}, {ROW_HASHES} SELECT * FROM m",
        "hash_verdict": f"{HASHED}, {ROW_HASHES}, g AS (SELECT {SIDES} FROM h), c AS (SELECT count(*) AS mismatch_count FROM m) SELECT 'row' AS level, mismatch_count = 0 AS matched, source_hash, target_hash, mismatch_count FROM g, c",  # noqa: E501
        "hash_columns": _hash_columns(),
        "row_compare_mixed_keys": """WITH s AS (SELECT 9007199254740992 + o_orderkey AS id, o_orderstatus AS v FROM orders),
t AS (SELECT CAST(CAST(9007199254740992 + o_orderkey AS DOUBLE) AS BIGINT) AS id, o_orderstatus AS v FROM orders),
sk AS (SELECT id, count(*) AS n, any_value(v) AS v FROM s GROUP BY id), tk AS (SELECT id, count(*) AS n, any_value(v) AS v FROM t GROUP BY id),
b AS (SELECT coalesce(sk.id, tk.id) AS id, coalesce(sk.n, 0) AS ns, coalesce(tk.n, 0) AS nt, sk.v AS a, tk.v AS c FROM sk FULL JOIN tk ON sk.id = tk.id)
SELECT CAST(id AS VARCHAR) AS id, CASE WHEN nt > 1 THEN 'duplicate-in-target' WHEN nt = 0 THEN 'missing-from-target'
 WHEN ns = 0 THEN 'missing-from-source' WHEN a = c THEN 'matching' ELSE 'matched-key-differing-values' END AS category,
 greatest(nt, 1) AS findings FROM b""",  # noqa: E501
        # Of a wall clock that occurs twice the earlier instant counts, which is an hour before the one that is given here.
        "norm_instant": """WITH w AS (SELECT o_orderkey, CAST(make_timestamp((800000000 + o_orderkey * 3600) * 1000000) AS TIMESTAMP) AS wall FROM orders),
i AS (SELECT *, wall AT TIME ZONE 'America/New_York' AS later FROM w),
e AS (SELECT o_orderkey, CASE WHEN (later - INTERVAL 1 HOUR) AT TIME ZONE 'America/New_York' = wall THEN later - INTERVAL 1 HOUR ELSE later END AS instant FROM i)
SELECT o_orderkey, strftime(date_trunc('hour', instant AT TIME ZONE 'UTC'), '%Y-%m-%d %H:%M:%S') AS value FROM e""",  # noqa: E501
        "hash_tolerance": f"SELECT order_key, total_price, {STEP.format('total_price')} AS absolute_text, floor(total_price * pow(10.0, {magnitude}) + 0.5) / pow(10.0, {magnitude}) AS percentage_value FROM ({ORDERS_TARGET})",  # noqa: E501
        "sample_first_n": "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50",
        "sample_random": "SELECT least(500, count(*)) AS sampled, least(500, count(*)) AS distinct_keys FROM orders",
        "sample_hash": f"SELECT * FROM orders WHERE {hour_bucket}",
        "sample_stratified": "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) <= 5",  # noqa: E501
        "sample_stratified_large": "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) <= 2000",  # noqa: E501
        "sample_date_window": "SELECT * FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31 23:59:59'",  # noqa: E501
        "sample_key_range": "SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 200",
        "volume_compare": f"WITH {COUNTS} "
        + " UNION ALL ".join(
            f"{_volume(label, test)}, '{name}' AS bound FROM counts"
            for name, label, test in (
                ("percentage", "0.0100% tolerance", "abs(difference_rate) > 0.01"),
                ("absolute", "200 row absolute tolerance", "abs(difference) > 200"),
                ("exact", *NO_TOLERANCE),
            )
        ),
        "volume_by_dimension": _volume_by_dimension(),
        "profile_general": _per_column(PROFILED, EVERY, GENERAL),
        "profile_most_common": _per_column(PROFILED, EVERY, COMMON, COMMON_TAIL),
        "profile_top_values": _per_column(PROFILED, EVERY, TOP, TOP_TAIL),
        "profile_string": _per_column((*PROFILED, "documents", "conversations"), (TEXT,), STRINGS),
        "profile_numeric": _per_column((*PROFILED, "lineitem"), (NUMBER,), NUMBERS),
        "profile_date": _per_column(("orders", "events", "lineitem"), (TIME,), DATES),
        "profile_boolean": "SELECT 'is_large' AS column_name, CAST(o_totalprice > 250000 AS VARCHAR) AS value, count(*) AS value_count, count(*)::DOUBLE / sum(count(*)) OVER () * 100 AS percentage, count(*) OVER () AS cardinality FROM orders GROUP BY o_totalprice > 250000",  # noqa: E501
        "profile_table": _profile_table(),
        "profile_diff": f"{_profile_diff(True)} SELECT * FROM diff UNION ALL SELECT * FROM category",
        "profile_category_diff": f"{_profile_diff(True)} SELECT * FROM category",
        "run_findings": f"{_run('schema profile volume rows')} SELECT * FROM run",
        "run_subset": f"{_run('schema profile')} SELECT * FROM run",
        "run_summary": _summed("schema profile volume rows"),
        "run_hash_strategy": _orders(EXACT_COLUMNS)
        + "SELECT category, severity, CAST(sum(findings) AS BIGINT) AS findings FROM found GROUP BY ALL",
        "run_hash_tolerance": _orders()
        + "SELECT category, severity, CAST(sum(findings) AS BIGINT) AS findings FROM found GROUP BY ALL",
        "export_json_rows": _orders()
        + ", volume AS (SELECT (SELECT count(*) FROM orders) AS s, (SELECT count(*) FROM tgt) AS t)"
        + " SELECT 'run-1' AS run_id, 'rows' AS kind, category, severity, CAST(sum(findings) AS BIGINT) AS records,"
        + " CAST(sum(CASE WHEN category = 'matched-key-differing-values' THEN len(string_split(differing_columns, ',')) ELSE 0 END) AS BIGINT) AS differences"  # noqa: E501
        + " FROM found GROUP BY ALL UNION ALL SELECT 'run-1', 'volume', 'row-count',"
        + " CASE WHEN t = s THEN 'Pass' WHEN abs(t - s) / s * 100 > 2 THEN 'Failure' ELSE 'Informational' END, 1, 0 FROM volume",
        "export_csv_rows": _export("concat_ws(',', " + ", ".join(_csv(c) for c in LISTED) + ")")
        + f" UNION ALL SELECT unnest({list(CSV_FIXED)})",
        "export_markdown_rows": _export("concat('| ', concat_ws(' | ', " + ", ".join(_markdown(c) for c in LISTED) + "), ' |')"),
        "run_history": _history(),
        "run_trend": _trend(),
        "narrow_differences": f"{_orders()} SELECT o_orderkey, category, {SEVERITY} AS severity, findings, source_rows, target_rows FROM found WHERE category <> 'matching'",  # noqa: E501
        "narrow_differences_partitioned": f"""WITH t AS ({inputs.ORDERS_DRIFTED.replace("{orders}", "orders")})
SELECT s.o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'missing-from-target' ELSE 'matched-key-differing-values' END AS category,
 CAST(1 AS BIGINT) AS source_rows, CAST(t.o_orderkey IS NOT NULL AS BIGINT) AS target_rows
FROM orders s LEFT JOIN t USING (o_orderkey) WHERE t.o_orderkey IS NULL OR t.o_totalprice <> s.o_totalprice""",
        "aggregate_parity": _aggregates(),
        "profile_distinct_sketch": _per_column((*PROFILED, "lineitem"), EVERY, "count(DISTINCT $c) AS distinct_count, true AS within_error"),
        "profile_quantiles": _per_column((*PROFILED, "lineitem"), (NUMBER,), "rank, count($c) AS populated, true AS within_error", RANKS),
        "profile_patterns": _per_column(("customer", "orders", "events", "conversations"), (TEXT,), *_patterns()),
        "run_history_latest": f"{_run('rows volume')}, total AS (SELECT CAST(sum(findings) AS BIGINT) AS findings, count(*) FILTER (WHERE severity IN ('Failure', 'Error')) AS failed FROM run) SELECT '{_run_id('2026-01-03T00:00:00.000Z')}' AS run_id, 'orders migration' AS comparison, CASE WHEN failed > 0 THEN 'failed' ELSE 'warning' END AS status, '2026-01-03T00:00:00.000Z' AS timestamp, findings FROM total",  # noqa: E501
    }
