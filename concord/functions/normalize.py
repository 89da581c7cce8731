"""Normalization rules and tolerant equality, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.values import as_type, comparable, family, shared_type, wall

# The white space trimmed and collapsed by the string rules.
WHITESPACE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WHITESPACE_RUN = (
    r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
)
# Accepted date text (date, time, fraction, offset) and number text.
DATE_TEXT = (
    r"^(\d{4}-\d{2}-\d{2})"
    r"(?:[T ](\d{2}:\d{2}(?::\d{2})?)(?:(?<=:\d{2}:\d{2})\.(\d{1,9}))?(Z|[+-](?:0\d|1[0-7]):?[0-5]\d)?)?$"
)
NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# The units a timestamp can be cut to, from coarse to fine.
TRUNCATION_UNITS = ("year", "month", "day", "hour", "minute", "second")


@dataclass(frozen=True)
class Tolerance:
    """Two numbers agree within either bound; no bound means strict equality."""

    absolute: float | None = None
    percentage: float | None = None

    @property
    def is_set(self) -> bool:
        return self.absolute is not None or self.percentage is not None


@dataclass(frozen=True)
class Rule:
    """How one column is normalized before it is compared or hashed."""

    trim: bool = False
    case_sensitive: bool = True
    collapse_whitespace: bool = False
    numeric_tolerance: Tolerance | None = None
    timezone: str | None = None
    truncate_to: str | None = None
    null_equivalents: tuple[str, ...] = ()

    @property
    def has_date_rule(self) -> bool:
        return bool(self.timezone or self.truncate_to)


def normalize(c: Column, dtype: T.DataType, rule: Rule | None) -> tuple[Column, T.DataType]:
    """Apply a rule in its fixed order and return the new value with its type."""
    if rule is None:
        return c, dtype
    if family(dtype) == "text":
        return _normalize_text(c, rule), dtype
    if family(dtype) == "time" and rule.has_date_rule:
        return shift_and_truncate(wall(c, dtype), rule), T.TimestampNTZType()
    return c, dtype


def _normalize_text(c: Column, rule: Rule) -> Column:
    out = c
    if rule.trim:
        out = F.btrim(out, F.lit(WHITESPACE))
    if not rule.case_sensitive:
        out = F.lower(out)
    if rule.collapse_whitespace:
        out = F.regexp_replace(out, WHITESPACE_RUN, " ")
    if rule.has_date_rule:
        out = normalize_date_text(out, rule)
    if rule.null_equivalents:
        out = F.when(~c.isin(*rule.null_equivalents), out)
    return out


def normalize_date_text(c: Column, rule: Rule) -> Column:
    """ISO text of a recognised date; any other text passes through.

    Zones and offsets move whole seconds only, so the milliseconds are kept as
    text, and a cut to a unit is a cut of the text. Each step refers to the one
    before once, which keeps the expression small.
    """
    date, clock, fraction, offset = (F.regexp_extract(c, DATE_TEXT, i) for i in range(1, 5))
    full_clock = F.overlay(F.lit("00:00:00"), clock, F.lit(1))
    wall = F.concat(date, F.lit(" "), full_clock).try_cast("timestamp_ntz")
    wall = F.when(offset == "", wall).otherwise(F.convert_timezone(offset, F.lit("UTC"), wall))
    if rule.timezone:
        wall = F.convert_timezone(F.lit(rule.timezone), F.lit("UTC"), wall)
    text = F.translate(wall.cast("string"), " ", "T")
    if rule.truncate_to in TRUNCATION_UNITS:
        kept = (4, 7, 10, 13, 16, 19)[TRUNCATION_UNITS.index(rule.truncate_to)]
        out = F.concat(F.substring(text, 1, kept), F.lit("0000-01-01T00:00:00.000Z"[kept:]))
    else:
        out = F.concat(text, F.lit("."), F.substring(F.rpad(fraction, 3, "0"), 1, 3), F.lit("Z"))
    return F.coalesce(out, c)


def shift_and_truncate(wall: Column, rule: Rule) -> Column:
    """Wall clock of the rule's zone to UTC, then cut to the rule's unit."""
    if rule.timezone:
        wall = F.convert_timezone(F.lit(rule.timezone), F.lit("UTC"), wall)
    return truncate(wall, rule.truncate_to) if rule.truncate_to else wall


def truncate(wall: Column, unit: str) -> Column:
    """Zero every part finer than the unit; an unknown unit changes nothing."""
    if unit not in TRUNCATION_UNITS:
        return wall
    kept = TRUNCATION_UNITS.index(unit)
    parts = [F.year, F.month, F.dayofmonth, F.hour, F.minute, F.second]
    zero = [1, 1, 1, 0, 0, 0]
    return F.make_timestamp_ntz(*[f(wall) if i <= kept else F.lit(zero[i]) for i, f in enumerate(parts)])


def as_number(c: Column, dtype: T.DataType) -> Column | None:
    """Double of a number or of numeric-looking text; None for other families."""
    if family(dtype) == "number":
        return c.cast("double")
    if family(dtype) != "text":
        return None
    text = F.btrim(c, F.lit(WHITESPACE))
    number = F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def within(a: Column, b: Column, tolerance: Tolerance) -> Column:
    """Numbers agree by absolute gap or by gap relative to the larger one."""
    gap = F.abs(a - b)
    close = F.lit(False)
    if tolerance.absolute is not None:
        close = close | (gap <= tolerance.absolute)
    if tolerance.percentage is not None:
        base = F.greatest(F.abs(a), F.abs(b))
        close = close | F.when(base > 0, gap / base * 100 <= tolerance.percentage).otherwise(gap == 0)
    return close


def times_within(a: Column, a_type: T.DataType, b: Column, b_type: T.DataType, seconds: float) -> Column:
    """Whether two wall clocks lie at most so far apart, both ends included; never NULL.

    Dates count as their midnight, instants as their UTC wall clock, and text as
    the time it shows. What is NULL or no time on either side is not within.
    """
    clocks = [c.try_cast("timestamp_ntz") if family(t) == "text" else wall(c, t) for c, t in ((a, a_type), (b, b_type))]
    bound = F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    return F.coalesce((clocks[0] <= clocks[1] + bound) & (clocks[1] <= clocks[0] + bound), F.lit(False))


def values_equal(
    a: Column, a_type: T.DataType, b: Column, b_type: T.DataType, tolerance: Tolerance | None = None
) -> Column:
    """True or False, never NULL: strict equality, loosened by a tolerance."""
    if family(a_type) == family(b_type) and family(a_type) in ("number", "time"):
        shared = shared_type(a_type, b_type)
        strict = as_type(a, a_type, shared).eqNullSafe(as_type(b, b_type, shared))
    elif family(a_type) == family(b_type):
        strict = comparable(a, a_type).eqNullSafe(comparable(b, b_type))
    else:
        strict = a.isNull() & b.isNull()
    if tolerance is None or not tolerance.is_set:
        return strict
    x, y = as_number(a, a_type), as_number(b, b_type)
    if x is None or y is None:
        return strict
    return strict | F.coalesce(within(x, y, tolerance), F.lit(False))
