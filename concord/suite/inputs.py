"""Inputs of the registered queries, derived from the given tables.

Perturbed targets are SQL text that Spark and the checking database both run;
table names stand in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concord.functions.normalize import Rule, Tolerance
from concord.operators.rows import Pair
from concord.sources.catalog import from_information_schema
from concord.sources.sides import ParquetFiles, load

ORDERS_TARGET = """
SELECT o_orderkey AS order_key, o_custkey AS cust_key,
 CASE WHEN o_orderkey % 11 = 0 THEN concat('  ', lower(o_orderstatus), ' ') ELSE o_orderstatus END AS order_status,
 CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 0.004 WHEN o_orderkey % 17 = 0 THEN o_totalprice + 25.0
  ELSE o_totalprice END AS total_price,
 CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderdate END AS order_date,
 CASE WHEN o_orderkey % 29 = 0 THEN 'N/A' ELSE o_orderpriority END AS order_priority
FROM {orders} WHERE o_orderkey % 97 <> 0
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 101 = 0
UNION ALL
SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 89 = 0
"""

LINES_TARGET = """
SELECT l_orderkey AS order_key, l_linenumber AS line_number,
 CASE WHEN l_partkey % 19 = 0 THEN l_quantity + 1 ELSE l_quantity END AS quantity,
 CASE WHEN l_partkey % 23 = 0 THEN lower(l_returnflag) ELSE l_returnflag END AS return_flag,
 l_shipdate AS ship_date
FROM {lineitem} WHERE l_partkey % 31 <> 0
UNION ALL
SELECT l_orderkey + 100000000, l_linenumber, l_quantity, l_returnflag, l_shipdate
FROM {lineitem} WHERE l_partkey % 37 = 0
"""

# Order dates moved by up to a minute, and some by more.
ORDERS_SHIFTED = """
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate - INTERVAL '61' SECOND
 WHEN o_orderkey % 7 = 0 THEN o_orderdate + INTERVAL '60' SECOND WHEN o_orderkey % 5 = 0 THEN o_orderdate - INTERVAL '1' SECOND
 WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderdate END AS order_date
FROM {orders} WHERE o_orderkey % 97 <> 0
"""

# A copy of orders in which two years have defects and the others are alike.
ORDERS_DRIFTED = """
SELECT o_orderkey, o_custkey, o_orderstatus,
 CASE WHEN year(o_orderdate) = 1995 AND o_orderkey % 97 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
 o_orderdate, o_orderpriority
FROM {orders} WHERE NOT (year(o_orderdate) = 1997 AND o_orderkey % 101 = 0)
"""

# A copy of lineitem whose measures drift: one within a tolerance, one beyond it, and one group with fewer rows.
LINES_DRIFTED = """
SELECT l_orderkey, l_returnflag, l_linestatus, l_discount,
 CASE WHEN l_partkey % 19 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
 CASE WHEN l_partkey % 23 = 0 THEN l_extendedprice + 0.004 ELSE l_extendedprice END AS l_extendedprice
FROM {lineitem} WHERE NOT (l_returnflag = 'A' AND l_partkey % 31 = 0)
"""

# A run of each priority a month: one with a jump, one that rises, one with a short history.
MONTHLY_RUNS = """
SELECT o_orderpriority AS comparison, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS STRING) AS timestamp,
 concat(o_orderpriority, '-', CAST(year(o_orderdate) * 100 + month(o_orderdate) AS STRING)) AS run_id,
 CAST(count(CASE WHEN o_orderkey % 23 = 0 THEN 1 END)
  + max(CASE WHEN o_orderpriority = '1-URGENT' AND year(o_orderdate) >= 1997 THEN 1000 ELSE 0 END)
  + max(CASE WHEN o_orderpriority = '2-HIGH' THEN (year(o_orderdate) * 12 + month(o_orderdate)) * 3 ELSE 0 END) AS BIGINT) AS failed
FROM {orders} WHERE NOT (o_orderpriority = '5-LOW' AND year(o_orderdate) * 100 + month(o_orderdate) > 199205)
GROUP BY o_orderpriority, year(o_orderdate), month(o_orderdate)
"""

# Spellings of native types that the derived column dumps use.
NATIVE_TYPES = (
    "NUMBER(38,0)", "NUMBER(12,2)", "number", "INTEGER", "bigint", "SMALLINT", "DECIMAL(12,2)", "DECIMAL(10,2)",
    "NUMERIC", "money", "FLOAT", "double precision", "REAL", "BIT", "BOOLEAN", "VARCHAR(100)", "VARCHAR(255)",
    "nvarchar(50)", " CHAR(3) ", "TEXT", "character varying", "VARCHAR(MAX)", "BINARY", "VARBINARY(MAX)", "BYTEA",
    "JSON", "variant", "ARRAY", "INTEGER[]", "STRUCT", "STRUCT(a INTEGER)", "GEOGRAPHY", "POINT", "TIMESTAMPTZ",
    "TIMESTAMP(3) WITH TIME ZONE", "datetimeoffset", "DATE", "TIME", "TIME(6)", "TIMESTAMP", "TIMESTAMP_NTZ",
    "DATETIME2(7)", "smalldatetime", "XML", "VARCHAR(20) COLLATE x",
)


def _type_case(index: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(NATIVE_TYPES))
    return f"CASE ({index}) % {len(NATIVE_TYPES)} {whens} END"


_TABLE_NAME = "concat('table_', CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS STRING))"
_COLUMN_NAME = "CASE WHEN p_partkey % 20 = 6 THEN 'row_id' ELSE concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey % 20 AS STRING)) END"  # noqa: E501

# A dump of information_schema.columns with one row per part: twenty columns a table.
SOURCE_DUMP = f"""
SELECT {_TABLE_NAME} AS table_name, {_COLUMN_NAME} AS column_name,
 CAST(p_partkey % 20 + 1 AS INT) AS ordinal_position, {_type_case("p_size")} AS data_type,
 CASE WHEN p_partkey % 3 = 0 THEN 'NO' ELSE 'YES' END AS is_nullable
FROM {{part}}
"""
# The same tables after a migration: columns renamed, retyped, dropped and reordered.
TARGET_DUMP = f"""
SELECT {_TABLE_NAME} AS table_name,
 CASE WHEN p_partkey % 17 = 0 THEN upper({_COLUMN_NAME}) WHEN p_partkey % 19 = 0 THEN replace({_COLUMN_NAME}, '_', '')
  WHEN p_partkey % 23 = 0 THEN concat('new_', p_brand) ELSE {_COLUMN_NAME} END AS column_name,
 CAST(CASE WHEN CAST(floor(p_partkey / 20) AS BIGINT) % 5 = 0 THEN 20 - p_partkey % 20 ELSE p_partkey % 20 + 1 END
  AS INT) AS ordinal_position,
 {_type_case("p_size + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END")} AS data_type,
 CASE WHEN p_partkey % 5 = 0 THEN 'NO' ELSE 'YES' END AS is_nullable
FROM {{part}} WHERE p_partkey % 13 <> 0
"""

ORDER_MAPPING = [
    Pair("o_orderkey", "order_key"),
    Pair("o_orderstatus", "order_status"),
    Pair("o_totalprice", "total_price"),
    Pair("o_orderdate", "order_date"),
    Pair("o_orderpriority", "order_priority"),
]
ORDER_RULES = {
    "order_status": Rule(trim=True, case_sensitive=False),
    "total_price": Rule(numeric_tolerance=Tolerance(absolute=0.01)),
}
LINE_MAPPING = [
    Pair("l_orderkey", "order_key"),
    Pair("l_linenumber", "line_number"),
    Pair("l_quantity", "quantity"),
    Pair("l_returnflag", "return_flag"),
    Pair("l_shipdate", "ship_date"),
]
HASHED = ["o_orderstatus", "o_totalprice", "o_orderpriority"]
FLOAT_SCALE = 4


def table(spark: SparkSession, sf_dir: str, name: str, where: str | None = None) -> DataFrame:
    return load(spark, ParquetFiles(f"{sf_dir}/{name}.parquet", where))


def from_sql(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def orders_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, ORDERS_TARGET, "orders")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def lines_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, LINES_TARGET, "lineitem")


def source_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_information_schema(from_sql(spark, sf_dir, SOURCE_DUMP, "part"))


def target_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_information_schema(from_sql(spark, sf_dir, TARGET_DUMP, "part"))
