import itertools

import pytest
from pyspark.sql import functions as F

from concord.functions.nativetypes import canonical_type, type_compatibility, type_modifiers
from concord.operators.schema import SchemaSeverities, compare_column_order, compare_schemas, suggest_mappings
from concord.sources.catalog import CATALOG, describe, from_information_schema
from seeded import CUSTOMER_MAPPING, pair

TYPES = {
    "NUMBER(38,0)": "Integer", "NUMBER(10)": "Integer", "NUMBER(12,2)": "Decimal", "number": "Integer", " int ": "Integer",
    "BIGSERIAL": "Integer", "DECIMAL(10,0)": "Decimal", "NUMERIC": "Decimal", "MONEY": "Decimal", "float8": "FloatingPoint",
    "DOUBLE PRECISION": "FloatingPoint", "BIT": "Boolean", "NVARCHAR(20)": "String", "VARCHAR(MAX)": "Unknown",
    "CHARACTER VARYING": "String", "VARBINARY(MAX)": "Binary", "JSONB": "JSON", "INTEGER[]": "Array", "ARRAY": "Array",
    "STRUCT(a INT)": "Object", "RECORD": "Object", "POINT": "Geospatial", "TIMESTAMPTZ": "TimestampWithTimezone",
    "TIMESTAMP(3) WITH TIME ZONE": "TimestampWithTimezone", "DATETIMEOFFSET": "TimestampWithTimezone", "DATE": "Date",
    "TIME(6)": "Time", "TIMESTAMP WITHOUT TIME ZONE": "Timestamp", "DATETIME2(7)": "Timestamp", "XML": "Unknown",
    "VARCHAR(20) COLLATE x": "Unknown", "FLOAT(53)": "Unknown",
}


def test_native_types(spark):
    df = spark.createDataFrame([(t,) for t in TYPES], "t string")
    assert {r.t: r.c for r in df.select("t", canonical_type(F.col("t")).alias("c")).collect()} == TYPES


def test_modifiers(spark):
    df = spark.createDataFrame([("DECIMAL(12,2)",), ("varchar(255)",), ("NUMBER(9)",), ("TEXT",)], "t string")
    parts = [c.alias(k) for k, c in type_modifiers(F.col("t")).items()]
    found = {r[0]: tuple(r)[1:] for r in df.select("t", *parts).collect()}
    assert found == {
        "DECIMAL(12,2)": (None, 12, 2), "varchar(255)": (255, None, None), "NUMBER(9)": (None, 9, 0), "TEXT": (None,) * 3,
    }


CATEGORIES = sorted({*TYPES.values()})


def test_compatibility(spark):
    assert len(CATEGORIES) == 15
    df = spark.createDataFrame(list(itertools.product(CATEGORIES, CATEGORIES)), "a string, b string")
    found = {(r.a, r.b): r.c for r in df.withColumn("c", type_compatibility(F.col("a"), F.col("b"))).collect()}
    assert all(found[a, b] == found[b, a] for a, b in found)
    expected = {
        ("Decimal", "FloatingPoint"): "Risk", ("Integer", "FloatingPoint"): "Risk", ("String", "Binary"): "Risk",
        ("Integer", "Decimal"): "Review", ("Timestamp", "Timestamp"): "Review", ("Time", "Time"): "Review",
        ("Date", "Date"): "Compatible", ("Geospatial", "Geospatial"): "Compatible", ("Geospatial", "Integer"): "Review",
        ("Unknown", "Unknown"): "Review", ("Boolean", "Integer"): "Risk", ("Array", "Object"): "Review",
        ("Date", "Time"): "Risk", ("Object", "String"): "Review", ("JSON", "Binary"): "Risk",
    }
    assert {k: found[k] for k in expected} == expected


def catalog(spark, *columns, table="t"):
    rows = [
        (table, name, i, kind, nullable, length, precision, scale)
        for i, (name, kind, nullable, length, precision, scale) in enumerate(columns, start=1)
    ]
    df = spark.createDataFrame(
        rows, "table_name string, column_name string, ordinal int, native_type string, nullable boolean, length int, precision int, scale int"  # noqa: E501
    )
    kind = canonical_type(F.col("native_type"))
    return df.withColumns({"canonical_type": kind, "is_pk_candidate": F.lit(False)})


def findings(df):
    return sorted((r.column_name, r.kind, r.severity) for r in df.collect())


def test_customer_pair_by_name_and_by_mapping(spark):
    source = catalog(
        spark, ("CustomerID", "INTEGER", False, None, None, None), ("CustomerName", "VARCHAR(100)", False, 100, None, None),
        ("CreatedDate", "TIMESTAMP", True, None, None, None), ("IsActive", "BOOLEAN", False, None, None, None),
        ("CreditLimit", "DECIMAL(19,4)", True, None, 19, 4),
    )
    target = catalog(
        spark, ("CUSTOMER_ID", "INTEGER", False, None, None, None), ("CUSTOMER_NAME", "VARCHAR(255)", False, 255, None, None),
        ("CREATED_AT", "TIMESTAMP", True, None, None, None), ("IS_ACTIVE", "BOOLEAN", False, None, None, None),
    )
    exact = findings(compare_schemas(source, target))
    assert [k for _, k, _ in exact].count("missing-in-target") == 5
    assert [k for _, k, _ in exact].count("missing-in-source") == 4 and {s for *_, s in exact} == {"Failure"}
    assert findings(compare_schemas(source, target, mapping=CUSTOMER_MAPPING)) == [
        ("CUSTOMER_NAME", "length-mismatch", "Informational"),
        ("CreditLimit", "missing-in-target", "Failure"),
    ]


def test_each_kind_and_severity(spark):
    source = catalog(
        spark, ("a", "VARCHAR(20)", True, 20, None, None), ("b", "DECIMAL(12,2)", False, None, 12, 2),
        ("c", "MONEY", True, None, None, None), ("d", "DATETIME2", True, None, None, None), ("e", "TEXT", True, None, None, None),
    )
    target = catalog(
        spark, ("b", "DECIMAL(10,3)", True, None, 10, 3), ("a", "VARCHAR(10)", False, 10, None, None),
        ("c", "FLOAT", True, None, None, None), ("d", "DATETIME2", True, None, None, None),
        ("e", "VARCHAR(5)", True, 5, None, None),
    )
    expected = [
        ("a", "length-mismatch", "Failure"), ("a", "nullability-mismatch", "Warning"), ("a", "order-mismatch", "Informational"),
        ("b", "nullability-mismatch", "Informational"), ("b", "order-mismatch", "Informational"),
        ("b", "precision-mismatch", "Warning"), ("b", "scale-mismatch", "Warning"), ("c", "type-mismatch", "Failure"),
        ("e", "length-mismatch", "Informational"),
    ]
    compared = compare_schemas(source, target)
    assert findings(compared) == expected
    messages = {(r.column_name, r.kind): r.message for r in compared.collect()}
    assert messages["a", "length-mismatch"] == 'Column "a": length 20 (source) vs 10 (target).'
    assert messages["e", "length-mismatch"] == 'Column "e": length (none) (source) vs 5 (target).'
    assert messages["a", "nullability-mismatch"] == 'Column "a": nullable=true (source) vs nullable=false (target).'
    assert messages["c", "type-mismatch"] == 'Column "c": native type "MONEY" (Decimal) vs "FLOAT" (FloatingPoint) is Risk.'
    custom = SchemaSeverities(decreased_length="Pass", nullable_to_required="Error", order_mismatch="Skipped")
    changed = findings(compare_schemas(source, target, custom))
    assert ("a", "length-mismatch", "Pass") in changed and ("a", "nullability-mismatch", "Error") in changed
    assert len(compare_column_order(source, target, custom).where("severity = 'Skipped'").collect()) == 2


def test_tables_do_not_mix(spark):
    one = catalog(spark, ("a", "INT", True, None, None, None), table="x")
    two = catalog(spark, ("a", "INT", True, None, None, None), table="y")
    assert findings(compare_schemas(one.union(two), one)) == [("a", "missing-in-target", "Failure")]


@pytest.mark.parametrize(
    ("left", "right", "expected"),
    [
        (["id"], ["id"], [("id", "id", "exact")]),
        (["CustomerName"], ["CUSTOMERNAME"], [("CustomerName", "CUSTOMERNAME", "case-insensitive")]),
        (["CustomerName"], ["CUSTOMER_NAME"], [("CustomerName", "CUSTOMER_NAME", "snake-camel")]),
        (["a"], ["b"], [("a", "b", "ordinal")]),
        (["x", "y"], ["y", "z"], [("x", "y", "ordinal"), ("y", "z", "ordinal")]),
        (["x", "y", "z"], ["z", "q"], [("x", "z", "ordinal"), ("y", "q", "ordinal")]),
        (["a", "A"], ["A", "a"], [("a", "a", "exact"), ("A", "A", "exact")]),
        (["a", "b"], ["a"], [("a", "a", "exact")]),
    ],
)
def test_suggested_mappings(spark, left, right, expected):
    make = lambda names: catalog(spark, *[(n, "INT", True, None, None, None) for n in names])
    found = suggest_mappings(make(left), make(right)).collect()
    assert [(r.source_column, r.target_column, r.strategy) for r in found] == expected


def test_describe(spark):
    source, _ = pair(spark, "customer")
    rows = describe(source, "customer").collect()
    assert describe(source, "customer").columns == [f.split()[0] for f in CATALOG.split(", ")]
    assert [(r.column_name, r.canonical_type, r.is_pk_candidate) for r in rows] == [
        ("CustomerID", "Integer", True), ("CustomerName", "String", False), ("CreatedDate", "Timestamp", False),
        ("IsActive", "Boolean", False), ("CreditLimit", "Decimal", False),
    ]
    assert (rows[4].precision, rows[4].scale, rows[0].ordinal) == (19, 4, 1)


def test_information_schema(spark):
    dump = spark.createDataFrame(
        [("t", "order_id", 2, "INT", "NO", None), ("t", "CustID", 1, "INT", "YES", None), ("u", "x", 1, "VARCHAR", "YES", 9)],
        "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string, character_maximum_length int",  # noqa: E501
    )
    by_name = {r.column_name: r for r in from_information_schema(dump).collect()}
    assert (by_name["CustID"].is_pk_candidate, by_name["order_id"].is_pk_candidate, by_name["x"].length) == (True, False, 9)
    keys = spark.createDataFrame([("t", "order_id")], "table_name string, column_name string")
    declared = {r.column_name: r.is_pk_candidate for r in from_information_schema(dump, keys).collect()}
    assert declared == {"order_id": True, "CustID": False, "x": False}
