"""Column catalogs: one row per column of every described table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.nativetypes import canonical_type, type_modifiers

CATALOG = (
    "table_name string, column_name string, ordinal int, native_type string, canonical_type string, "
    "nullable boolean, is_pk_candidate boolean, length int, precision int, scale int"
)


def _native_name(dtype: T.DataType) -> str:
    if isinstance(dtype, T.ArrayType):
        return "ARRAY"
    if isinstance(dtype, (T.StructType, T.MapType)):
        return "STRUCT"
    names = {"timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP"}
    return names.get(dtype.simpleString(), dtype.simpleString().upper())


def describe(df: DataFrame, table_name: str, primary_key: tuple[str, ...] | None = None) -> DataFrame:
    """The catalog of a DataFrame, from its schema alone.

    Without a declared key the first column whose name ends in ``id`` is the
    key candidate.
    """
    if primary_key is None:
        primary_key = tuple([f.name for f in df.schema.fields if f.name.lower().endswith("id")][:1])
    rows = [
        (table_name, f.name, i, _native_name(f.dataType), f.nullable, f.name in primary_key)
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    raw = df.sparkSession.createDataFrame(
        rows, "table_name string, column_name string, ordinal int, native_type string, nullable boolean, is_key boolean"
    )
    return _catalog(raw, F.col("is_key"), type_modifiers(F.col("native_type")))


def from_information_schema(columns: DataFrame, key_columns: DataFrame | None = None) -> DataFrame:
    """The catalog of many tables from a dump of ``information_schema.columns``.

    ``key_columns`` lists (table_name, column_name) of declared keys. Without it
    the first column of a table whose name ends in ``id`` is the candidate.
    """
    present = set(columns.columns)
    declared = {
        name: F.col(origin).cast("int") if origin in present else F.lit(None).cast("int")
        for name, origin in (
            ("length", "character_maximum_length"),
            ("precision", "numeric_precision"),
            ("scale", "numeric_scale"),
        )
    }
    written = type_modifiers(F.col("data_type"))
    raw = columns.select(
        "table_name",
        "column_name",
        F.col("ordinal_position").cast("int").alias("ordinal"),
        F.col("data_type").alias("native_type"),
        (F.upper("is_nullable") == "YES").alias("nullable"),
        *[F.coalesce(declared[k], written[k]).alias(k) for k in declared],
    )
    if key_columns is None:
        named = F.when(F.lower("column_name").endswith("id"), F.col("ordinal"))
        first = raw.groupBy("table_name").agg(F.min(named).alias("key_ordinal"))
        raw = raw.join(first, "table_name", "left").withColumn(
            "is_key", F.coalesce(F.col("ordinal") == F.col("key_ordinal"), F.lit(False))
        )
    else:
        keys = key_columns.select("table_name", "column_name", F.lit(True).alias("declared_key")).distinct()
        raw = raw.join(keys, ["table_name", "column_name"], "left").withColumn(
            "is_key", F.coalesce("declared_key", F.lit(False))
        )
    return _catalog(raw, F.col("is_key"), {k: F.col(k) for k in declared})


def _catalog(raw: DataFrame, is_key: Column, modifiers: dict[str, Column]) -> DataFrame:
    return raw.select(
        "table_name",
        "column_name",
        "ordinal",
        "native_type",
        canonical_type(F.col("native_type")).alias("canonical_type"),
        "nullable",
        is_key.alias("is_pk_candidate"),
        *[c.alias(k) for k, c in modifiers.items()],
    )
