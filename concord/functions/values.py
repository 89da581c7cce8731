"""Value families and text forms shared by the comparing operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATING = (T.FloatType, T.DoubleType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def family(dtype: T.DataType) -> str:
    """Values of two different families never compare as equal."""
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, _TEMPORAL):
        return "time"
    return dtype.simpleString()


def is_floating(*dtypes: T.DataType) -> bool:
    return any(isinstance(t, _FLOATING) for t in dtypes)


_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def _digits(dtype: T.DataType) -> tuple[int, int]:
    """Digits before and after the point of an exact number type."""
    if isinstance(dtype, T.DecimalType):
        return dtype.precision - dtype.scale, dtype.scale
    return _DIGITS[type(dtype)], 0


def shared_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type in which two values of one family are compared without loss.

    Numbers that no one type holds (exact with floating ones, decimals that
    need over 38 digits together) meet as the text that ``number_text`` gives.
    """
    if a == b and not isinstance(a, _FLOATING):
        return a
    if family(a) == "number":
        floating = [isinstance(t, _FLOATING) for t in (a, b)]
        if all(floating):
            return T.DoubleType()
        if any(floating):
            return T.StringType()
        if not any(isinstance(t, T.DecimalType) for t in (a, b)):
            return T.LongType()
        before, after = (max(x) for x in zip(_digits(a), _digits(b)))
        return T.DecimalType(before + after, after) if before + after <= 38 else T.StringType()
    if family(a) == "time" and type(a) is not type(b):
        return T.TimestampNTZType()
    if family(a) == "text":
        return T.StringType()
    return a


def number_text(c: Column, dtype: T.DataType) -> Column:
    """A text that equal numbers of any types share and different numbers do not.

    Whole numbers show their digits, whatever their type. A fraction shows the
    shortest text of a double; a decimal that no double equals shows itself.
    """
    if isinstance(dtype, _FLOATING):
        x = c.cast("double")
        whole = (F.floor(x) == x) & (F.abs(x) < 1e37)
        text = F.when(whole, x.try_cast("decimal(38,0)").cast("string"))
        return F.coalesce(text, F.when(x == 0, "0").otherwise(x.cast("string")))
    if not isinstance(dtype, T.DecimalType):
        return c.cast("string")
    exact = c.cast("string")
    near = c.cast("double")
    plain = F.regexp_replace(F.regexp_replace(exact, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(plain.contains(".") & (near.try_cast(dtype) == c), near.cast("string")).otherwise(plain)


def utc_wall(c: Column) -> Column:
    """The wall clock of an instant in UTC, whatever the session's zone is."""
    seconds = (F.unix_micros(c).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def wall(c: Column, dtype: T.DataType) -> Column:
    """A date or time as a wall clock; instants show theirs in UTC."""
    return utc_wall(c) if isinstance(dtype, T.TimestampType) else c.cast("timestamp_ntz")


def as_type(c: Column, dtype: T.DataType, shared: T.DataType) -> Column:
    """A value in the type of ``shared_type``."""
    if family(dtype) == "number" and isinstance(shared, T.StringType):
        return number_text(c, dtype)
    if isinstance(shared, T.TimestampNTZType):
        return wall(c, dtype)
    return c.cast(shared)


def comparable(c: Column, dtype: T.DataType) -> Column:
    """Maps have no equality in Spark; their sorted entries do."""
    return F.array_sort(F.map_entries(c)) if isinstance(dtype, T.MapType) else c


def as_text(c: Column, dtype: T.DataType) -> Column:
    """Readable text of a value; NULL stays NULL, equal maps give equal texts."""
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(comparable(c, dtype) if isinstance(dtype, T.MapType) else c)
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    if isinstance(dtype, T.TimestampType):
        return utc_wall(c).cast("string")
    return c.cast("string")
