"""Native type names, their categories and how two categories agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "number with a scale"  # an integer or a decimal, as its scale says

# Category of a native type name, trimmed and upper-cased, by the first pattern that fits.
TYPE_PATTERNS = (
    (NUMBER, r"^NUMBER\s*\(\s*\d+\s*(,\s*\d+\s*)?\)$"),
    ("Integer", r"^(TINYINT|SMALLINT|INT|INTEGER|BIGINT|MEDIUMINT|INT2|INT4|INT8|SERIAL|BIGSERIAL|SMALLSERIAL|NUMBER)$"),
    ("Decimal", r"^((DECIMAL|NUMERIC)(\(\s*\d+\s*(,\s*\d+\s*)?\))?|MONEY|SMALLMONEY)$"),
    ("FloatingPoint", r"^(FLOAT|FLOAT4|FLOAT8|REAL|DOUBLE|DOUBLE\s+PRECISION)$"),
    ("Boolean", r"^(BIT|BOOLEAN|BOOL)$"),
    ("String", r"^(N?VARCHAR|N?CHAR|CHARACTER(\s+VARYING)?|TEXT|STRING|CLOB|BPCHAR)(\(\d+\))?$"),
    ("Binary", r"^(BINARY|VARBINARY|BYTEA|BLOB|IMAGE|RAW)(\((\d+|MAX)\))?$"),
    ("JSON", r"^(JSON|JSONB|VARIANT)$"),
    ("Array", r"^ARRAY$|\[\]$"),
    ("Object", r"^(OBJECT|STRUCT|RECORD)$|^STRUCT\("),
    ("Geospatial", r"^(GEOGRAPHY|GEOMETRY|GEOMETRYCOLLECTION|POINT|POLYGON|LINESTRING)$"),
    ("TimestampWithTimezone", r"^(TIMESTAMPTZ|TIMESTAMP_TZ|TIMESTAMP(\(\d+\))?\s+WITH\s+TIME\s+ZONE|DATETIMEOFFSET)$"),
    ("Date", r"^DATE$"),
    ("Time", r"^TIME(\(\d+\))?$"),
    ("Timestamp", r"^(TIMESTAMP|TIMESTAMP_NTZ|TIMESTAMPNTZ|TIMESTAMP\s+WITHOUT\s+TIME\s+ZONE|DATETIME|DATETIME2|SMALLDATETIME)(\(\d+\))?$"),
)
UNKNOWN = "Unknown"
# Pairs of different categories that are a risk, and those to review.
RISK_PAIRS = (("Decimal", "FloatingPoint"), ("Integer", "FloatingPoint"), ("String", "Binary"))
REVIEW_PAIRS = (
    ("Integer", "Decimal"),
    ("Date", "Timestamp"),
    ("Date", "TimestampWithTimezone"),
    ("Time", "Timestamp"),
    ("Time", "TimestampWithTimezone"),
    ("Timestamp", "TimestampWithTimezone"),
    ("JSON", "String"),
    ("JSON", "Array"),
    ("JSON", "Object"),
    ("Array", "String"),
    ("Array", "Object"),
    ("Object", "String"),
)
# Equal categories that still need a look at precision.
REVIEW_SAME = ("Timestamp", "Time")
# Severity of a compatibility.
COMPATIBILITY_SEVERITY = {"Compatible": "Pass", "Review": "Warning", "Risk": "Failure"}
DECIMAL_MODIFIERS = r"(?i)^(?:DECIMAL|NUMERIC|NUMBER)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)$"
LENGTH_MODIFIER = r"(?i)^(?:N?VARCHAR|N?CHAR|BPCHAR|CHARACTER(?:\s+VARYING)?|BINARY|VARBINARY)\s*\(\s*(\d+)\s*\)$"


def canonical_type(native: Column) -> Column:
    """Category of a native type name; never NULL for a non-NULL name."""
    name = F.upper(F.trim(native))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for category, pattern in TYPE_PATTERNS:
        scaled = F.when(type_modifiers(native)["scale"] > 0, "Decimal").otherwise("Integer")
        out = out.when(name.rlike(pattern), scaled if category == NUMBER else category)
    return out.otherwise(UNKNOWN)


def type_modifiers(native: Column) -> dict[str, Column]:
    """Length, precision and scale written in a type name; NULL where absent."""
    name = F.trim(native)
    number = lambda pattern, group: F.regexp_extract(name, pattern, group).try_cast("int")
    precision = number(DECIMAL_MODIFIERS, 1)
    scale = F.when(precision.isNotNull(), F.coalesce(number(DECIMAL_MODIFIERS, 2), F.lit(0)))
    return {"length": number(LENGTH_MODIFIER, 1), "precision": precision, "scale": scale}


def _is_pair(a: Column, b: Column, pairs) -> Column:
    found = F.lit(False)
    for x, y in pairs:
        found = found | ((a == x) & (b == y)) | ((a == y) & (b == x))
    return found


def type_compatibility(a: Column, b: Column) -> Column:
    """Compatible, Review or Risk for two categories, in either order."""
    return (
        F.when((a == UNKNOWN) | (b == UNKNOWN), "Review")
        .when(a == b, F.when(a.isin(*REVIEW_SAME), "Review").otherwise("Compatible"))
        .when(_is_pair(a, b, RISK_PAIRS), "Risk")
        .when(_is_pair(a, b, REVIEW_PAIRS), "Review")
        .when((a == "Geospatial") | (b == "Geospatial"), "Review")
        .otherwise("Risk")
    )
