"""Rounding, sums that do not depend on the order of rows, and reproducible random draws."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Doubles of this size and more have no fraction.
_WHOLE = float(2**52)
# Splits a double into two halves of 26 bits, whose products are exact.
_SPLITTER = float(2**27 + 1)
# A sum's limbs of 32 bits, from 2^64 down to 2^-96.
_LIMB_BITS = 32
_LIMBS = (2, 1, 0, -1, -2, -3)


def _halves(x: Column) -> tuple[Column, Column]:
    wide = x * _SPLITTER
    high = wide - (wide - x)
    return high, x - high


def round2(x: Column) -> Column:
    """Two places, ties to even, decided by the exact binary value: 2.135 lies below its decimal and gives 2.13.

    The product with 100 is taken with its rounding error, which tells a tie from its neighbours.  Numbers without a fraction,
    infinities and NaN stay; a zero has no sign.
    """
    product = x * 100.0
    high, low = _halves(x)
    # 100 is its own upper half.
    error = (high * 100.0 - product) + low * 100.0
    whole = F.floor(product).cast("double")
    rest = product - whole
    odd = F.abs(whole % 2.0) == 1.0
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & odd)))
    rounded = (whole + F.when(up, 1.0).otherwise(0.0)) / 100.0 + 0.0
    return F.when(F.abs(x) < _WHOLE / 100, rounded).otherwise(x)


def exact_sum(x: Column) -> Column:
    """An aggregate: the sum of doubles, rounded once, whatever the order of the rows and however they are divided.

    Each value is cut into limbs of 32 bits, exactly, and limbs add up as whole numbers.  The bits from 2^95 down to 2^-96
    count: smaller ones are dropped from each value, and a value of 2^96 or more makes the sum a plain one, as infinities and NaN do.
    Nulls do not count; the sum of none is null.
    """
    held = F.when(F.abs(x) < 2.0**96, x)
    sums = []
    for limb in _LIMBS:
        # Scaling by a power of two and remainders are exact, and signed as the value is.
        scaled = held / 2.0 ** (_LIMB_BITS * limb)
        part = (scaled - scaled % 1.0) % 2.0**_LIMB_BITS
        sums.append(F.sum(part.cast("bigint").cast("decimal(18,0)")))
    plain = F.max(F.when(F.abs(x) >= 2.0**96, 1).otherwise(0)) == 1
    exact = _from_limbs([F.coalesce(s, F.lit(0).cast("decimal(28,0)")) for s in sums])
    return F.when(F.count(x) > 0, F.when(plain, F.sum(x)).otherwise(exact))


def _from_limbs(limbs: list[Column]) -> Column:
    """The double of a number given by signed limbs, the highest first.

    With the sign taken out all digits are positive; added from the lowest up, only the last additions round.
    """
    number = F.array(*[s.cast("decimal(38,0)") for s in reversed(limbs)])
    base = F.lit(2**_LIMB_BITS).cast("decimal(38,0)")
    unit = 2.0 ** (_LIMB_BITS * _LIMBS[-1])
    start = F.struct(F.lit(0).cast("decimal(38,0)").alias("carry"), F.lit(0.0).alias("value"), F.lit(unit).alias("unit"))

    def digits(number: Column, sign: Column) -> Column:
        def step(state: Column, limb: Column) -> Column:
            held = (limb * sign + state["carry"]).cast("decimal(38,0)")
            digit = F.pmod(held, base).cast("decimal(38,0)")
            carry = ((held - digit) / base).cast("decimal(38,0)")
            value = state["value"] + digit.cast("double") * state["unit"]
            return F.struct(carry.alias("carry"), value.alias("value"), (state["unit"] * 2.0**_LIMB_BITS).alias("unit"))

        return F.aggregate(number, start, step)

    def value(number: Column) -> Column:
        one = F.lit(1).cast("decimal(1,0)")
        sign = F.when(digits(number, one)["carry"] < 0, -1).otherwise(1).cast("decimal(1,0)")
        return _bound(sign, lambda g: _bound(digits(number, g), lambda s: g.cast("double") * (s["value"] + s["carry"].cast("double") * s["unit"])))

    return _bound(number, value)


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` worked out once, however often it is used."""
    return F.transform(F.array(x), use)[0]


def uniform(key: Column, draw: str, seed: int = 0) -> Column:
    """A number in [0, 1) fixed by (seed, draw, key).

    Being a hash of the row's key and not of its place, it does not change with the
    partitioning or when a lost task runs again.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:{draw}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def exponential(key: Column, draw: str, mean: float, seed: int = 0) -> Column:
    return -F.lit(float(mean)) * F.log(1 - uniform(key, draw, seed))


def gaussian(key: Column, draw: str, mean: float, deviation: float, seed: int = 0) -> Column:
    """Normal draw from two uniform ones (Box-Muller)."""
    radius = F.sqrt(-2.0 * F.log(1 - uniform(key, draw + ".r", seed)))
    angle = 2.0 * math.pi * uniform(key, draw + ".a", seed)
    return F.lit(float(mean)) + F.lit(float(deviation)) * radius * F.cos(angle)
