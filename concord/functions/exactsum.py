"""Exact sums of doubles, whatever the order and partitioning of the rows.

A finite double is a whole number of units of some power of two. It is cut into
digits of 22 bits at fixed places, and each place is summed as a 64-bit whole
number, which no table of below 2^41 rows overflows. The carried digits name the
exact sum, equal for equal sums bit for bit; the double nearest to it follows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGIT_BITS = 22
BASE = 1 << DIGIT_BITS
MANTISSA = 53
LEAST_UNIT = -1074  # the exponent of the smallest double
LARGEST = 1024


@dataclass(frozen=True)
class Places:
    """The unit's exponent and the number of digits that hold every value of a column."""

    unit: int
    digits: int


def places(least: float | None, most: float | None) -> Places:
    """From the least and the most of the magnitudes above zero; none of them gives one digit."""
    if not least or not most:
        return Places(0, 1)
    unit = max(LEAST_UNIT, math.frexp(least)[1] - MANTISSA)
    return Places(unit, -(-(math.frexp(most)[1] - unit) // DIGIT_BITS))


def magnitude(c: Column) -> Column:
    """The magnitude of a finite value above zero, else NULL."""
    size = F.abs(c.cast("double"))
    return F.when((size > 0) & (size < float("inf")), size)


def _scaled(c: Column, exponent: int) -> Column:
    """Times a power of two, in steps that a double can hold."""
    while exponent:
        step = max(-1000, min(1000, exponent))
        c, exponent = c * F.lit(2.0**step), exponent - step
    return c


def digits(c: Column, at: Places) -> list[Column]:
    """The signed digits of a finite value from the unit up; zero for values that are not finite, NULL for NULL."""
    value = c.cast("double")
    size = F.when(F.abs(value) < float("inf"), F.abs(value)).when(value.isNotNull(), F.lit(0.0))
    power = lambda e: F.lit(2.0**e if e < LARGEST else float("inf"))
    own = []
    for low in range(at.unit, at.unit + DIGIT_BITS * at.digits, DIGIT_BITS):
        own.append(F.floor(_scaled(size % power(low + DIGIT_BITS), -low)))  # remainders of doubles are exact
    return [F.when(value < 0, -d).otherwise(d) for d in own]


def _carried(sums: Column) -> Column:
    """(digits from 0 to BASE - 1, carry) of sums from the unit up."""
    none = F.struct(F.array().cast("array<bigint>").alias("digits"), F.lit(0).cast("bigint").alias("carry"))
    return F.aggregate(
        sums,
        none,
        lambda done, x: F.struct(
            F.concat(done["digits"], F.array((x + done["carry"]).bitwiseAND(F.lit(BASE - 1)))).alias("digits"),
            F.shiftright(x + done["carry"], DIGIT_BITS).alias("carry"),
        ),
    )


def with_totals(df: DataFrame, wanted: Mapping[str, tuple[Sequence[str], Places]]) -> DataFrame:
    """Adds, for each name, (value, exact): the double nearest to the sum of its digit columns, and a name of the sum.

    Every step is a column of its own, because the next refers to it more than once.
    """
    zero = F.lit(0).cast("bigint")
    col = lambda name, step: F.col(f"__{step}_{name}")
    digit = lambda name, at: F.when(at >= 0, F.get(col(name, "own"), at)).otherwise(zero)

    def step(df: DataFrame, label: str, made) -> DataFrame:
        return df.withColumns({f"__{label}_{name}": made(name) for name in wanted})

    room = lambda name: F.array(*[F.coalesce(F.col(c), zero) for c in wanted[name][0]], zero, zero, zero)
    df = step(df, "sums", room)  # with room for what many rows carry
    df = step(df, "plain", lambda name: _carried(col(name, "sums")))
    mirrored = lambda name: F.transform(col(name, "sums"), lambda x: -x)
    negative = lambda name: col(name, "plain")["carry"] < 0
    own = lambda name: F.when(negative(name), _carried(mirrored(name))["digits"]).otherwise(col(name, "plain")["digits"])
    df = step(df, "own", own)
    df = step(df, "top", lambda name: F.coalesce(F.array_max(F.transform(col(name, "own"), lambda d, i: F.when(d > 0, i))), F.lit(-1)))
    # Two numbers of 44 bits, the lower one odd if anything follows: their sum is rounded once, and rightly.
    df = step(df, "upper", lambda name: digit(name, col(name, "top")) * BASE + digit(name, col(name, "top") - 1))

    def lower(name: str) -> Column:
        top = col(name, "top")
        rest = F.exists(F.slice(col(name, "own"), F.lit(1), F.greatest(F.lit(0), top - 3)), lambda d: d > 0)
        plain = digit(name, top - 2) * BASE + digit(name, top - 3)
        return plain.bitwiseOR(F.when(rest, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))

    df = step(df, "lower", lower)

    def told(name: str) -> Column:
        at, top = wanted[name][1], col(name, "top")
        exponents = [at.unit + DIGIT_BITS * (i - 3) for i in range(at.digits + 3)]
        first = [max(-1000, min(1000, e)) for e in exponents]
        one, two = (F.array(*[F.lit(2.0**e) for e in own]) for own in (first, [e - f for e, f in zip(exponents, first)]))
        size = (col(name, "upper").cast("double") * float(1 << 44) + col(name, "lower").cast("double")) * F.get(one, top) * F.get(two, top)
        value = F.when(top < 0, F.lit(0.0)).when(negative(name), -size).otherwise(size)
        sign = F.when(top < 0, "0").when(negative(name), "-").otherwise("+")
        return F.struct(value.alias("value"), F.concat(sign, F.to_json(col(name, "own"))).alias("exact"))

    df = df.withColumns({name: told(name) for name in wanted})
    return df.drop(*[f"__{label}_{name}" for name in wanted for label in ("sums", "plain", "own", "top", "upper", "lower")])
