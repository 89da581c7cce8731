"""Row text, row hash and an order-free digest of many rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.normalize import Rule, Tolerance, as_number
from concord.functions.values import as_text, as_type, comparable, family, is_floating, shared_type

LANES = 4
LANE_DIGITS = 15  # hex digits; 60 bits fit a signed 64-bit integer
LIMBS = 3  # numbers a lane is summed in
LIMB_BITS = 20
MAX_DECIMALS = 12
MAX_SIGNIFICANT = 15


def tolerance_bucket(number: Column, tolerance: Tolerance) -> tuple[Column, int]:
    """Bucket a number so that close values share one text, with its decimals."""
    if tolerance.absolute:
        step = tolerance.absolute
        decimals = min(MAX_DECIMALS, max(0, math.ceil(-math.log10(step)) + 2))
        return _half_up(number, number / step, lambda whole: whole * step), decimals
    figures = significant_figures(tolerance.percentage)
    magnitude = F.floor(F.log10(F.abs(number))).cast("int") + 1
    decimals = F.least(F.lit(MAX_DECIMALS), F.greatest(F.lit(0), F.lit(figures) - magnitude))
    factor = F.pow(F.lit(10.0), decimals)
    rounded = _half_up(number, number * factor, lambda whole: whole / factor)
    return F.when(number == 0, F.lit(0.0)).otherwise(rounded), MAX_DECIMALS


def _half_up(number: Column, scaled: Column, back) -> Column:
    """Round half up; beyond 2**53 a double has no fraction left to round."""
    whole = F.floor(scaled + 0.5).cast("double")
    return F.when(F.abs(scaled) < 2.0**53, back(whole)).otherwise(number)


def significant_figures(percentage: float) -> int:
    """Figures kept under a percentage tolerance: finer tolerance, more figures."""
    figures = math.floor(2 - math.log10(percentage / 100) + 0.5)
    return min(MAX_SIGNIFICANT, max(1, figures))


def buckets(tolerance: Tolerance | None) -> bool:
    """Whether a tolerance changes what is hashed; zero bounds do not."""
    return tolerance is not None and bool(tolerance.absolute or tolerance.percentage)


def canonical_text(
    c: Column, dtype: T.DataType, other: T.DataType, rule: Rule | None, float_scale: int | None
) -> Column:
    """One text per value, equal on both sides exactly when the values agree.

    Numbers are first brought to the type shared with the other side. With a
    ``float_scale`` doubles are rounded to that many decimals before hashing.
    """
    plain = _plain_text(c, dtype, other, float_scale)
    is_number = F.lit(family(dtype) == "number")
    tolerance = rule.numeric_tolerance if rule else None
    number = as_number(c, dtype) if buckets(tolerance) else None
    if number is not None:
        value, decimals = tolerance_bucket(number, tolerance)
        finite = F.abs(number) < F.lit(float("inf"))
        fixed = F.coalesce(value.try_cast(T.DecimalType(38, decimals)).cast("string"), value.cast("string"))
        plain = F.when(finite, fixed).otherwise(plain)
        is_number = is_number | F.coalesce(finite, F.lit(False))
    if family(dtype) == family(other) and number is None:
        return plain
    if family(dtype) == family(other) == "number":
        return plain
    # Text and number may meet in one column: mark which of the two this is.
    return F.concat(F.when(is_number, F.lit("#")).otherwise(F.lit("$")), plain)


def _plain_text(c: Column, dtype: T.DataType, other: T.DataType, float_scale: int | None) -> Column:
    shared = shared_type(dtype, other) if family(dtype) == family(other) else shared_type(dtype, dtype)
    floating = isinstance(shared, T.DoubleType) or float_scale is not None and is_floating(dtype, other)
    if floating and family(dtype) == "number":
        value = F.when(c == 0, F.lit(0.0)).otherwise(c.cast("double"))
        if float_scale is None:
            return value.cast("string")
        fixed = value.try_cast(T.DecimalType(38, float_scale))
        return F.coalesce(fixed.cast("string"), value.cast("string"))
    if family(dtype) in ("number", "time", "boolean"):
        return as_text(as_type(c, dtype, shared), shared)
    return as_text(comparable(c, dtype), dtype if not isinstance(dtype, T.MapType) else T.ArrayType(T.StringType()))


def row_text(texts: list[Column]) -> Column:
    """Injective text of a tuple: each part carries its length, NULL is ``n``."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.length(t), F.lit(":"), t), F.lit("n")) for t in texts]
    return F.concat(*parts) if parts else F.lit("")


def row_hash(texts: list[Column]) -> Column:
    return F.sha2(row_text(texts), 256)


def lanes(row_hash_column: Column) -> list[Column]:
    """The hash cut into integers whose sums make an order-free digest."""
    return [
        F.conv(F.substring(row_hash_column, 1 + LANE_DIGITS * i, LANE_DIGITS), 16, 10).cast("bigint") for i in range(LANES)
    ]


def limbs(lane: Column) -> list[Column]:
    """A 60-bit lane as three 20-bit numbers, high to low.

    Their plain 64-bit sums cannot overflow below 2**43 rows, and they add up
    much faster than wide decimals.
    """
    mask = F.lit((1 << LIMB_BITS) - 1).cast("bigint")
    return [F.shiftright(lane, LIMB_BITS * i).bitwiseAND(mask) for i in reversed(range(LIMBS))]


def digest(count: Column, limb_sums: list[Column]) -> Column:
    """Hash of a row multiset from its count and limb sums, also when empty."""
    wide = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(20,0)")
    scale = F.lit(1 << LIMB_BITS).cast("decimal(8,0)")
    texts = []
    for i in range(LANES):
        high, middle, low = (wide(c) for c in limb_sums[LIMBS * i : LIMBS * (i + 1)])
        total = (high * scale + middle) * scale + low
        texts.append(total.cast("decimal(38,0)").cast("string"))
    return F.sha2(F.concat_ws(":", F.coalesce(count, F.lit(0)).cast("string"), *texts), 256)
