"""Scalar expressions whose corner cases Spark's own operators treat otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def is_finite(x: Column) -> Column:
    """True for finite numbers; false for NaN, infinities and null."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(INFINITY)), F.lit(False))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den; 0 / 0 is 0, x / 0 is infinite, and so is any ratio with a
    number that is not finite."""
    return F.when(~is_finite(num) | ~is_finite(den), F.lit(INFINITY)).when(den != 0, F.try_divide(num, den)).when(num == 0, F.lit(0.0)).otherwise(F.lit(INFINITY))


def ratio_or_zero(num: Column, den: Column) -> Column:
    """|num| / den where den is positive; else 0 if num is 0, infinite if not."""
    return F.when(den > 0, F.try_divide(F.abs(num), den)).when(F.abs(num) > 0, F.lit(INFINITY)).otherwise(F.lit(0.0))


# Powers of two between which squares neither over- nor underflow, and by which
# larger and smaller numbers are scaled before they are squared.
_BIG, _BIG_SCALE, _SMALL, _SMALL_SCALE = 486, -538, -511, 537


def square_sums(x: Column) -> Column:
    """One aggregate of three sums of squares (big, middle, small): of numbers
    scaled down, as they are, and scaled up, by their size.  One pass is enough
    for a norm that does not overflow on the way."""
    size = F.abs(x)
    power = lambda k: F.lit(2.0**k)
    total = lambda when, scale: F.coalesce(F.sum(F.when(when, F.pow(x * power(scale), F.lit(2.0)))), F.lit(0.0))
    big, small = size > power(_BIG), size < power(_SMALL)
    return F.struct(total(big, _BIG_SCALE).alias("big"), total(~big & ~small, 0).alias("middle"), total(small, _SMALL_SCALE).alias("small"))


def _root(sums: str) -> tuple[Column, Column]:
    """A norm as a number and the power of two that it is to be scaled by."""
    big, middle, small = (F.col(f"{sums}.{k}") for k in ("big", "middle", "small"))
    down = lambda k: F.lit(2.0**k)
    root = F.when(big > 0, F.sqrt(big + middle * down(_BIG_SCALE) * down(_BIG_SCALE))).when(middle > 0, F.sqrt(middle + small * down(-_SMALL_SCALE) * down(-_SMALL_SCALE))).otherwise(F.sqrt(small))
    return root, F.when(big > 0, F.lit(-_BIG_SCALE)).when(middle > 0, F.lit(0)).otherwise(F.lit(-_SMALL_SCALE))


def norm_ratio(num: str, den: str, num_max: Column, den_max: Column) -> Column:
    """A ratio of L2 norms from their columns of ``square_sums``; of the magnitudes
    only zero and what is not finite count."""
    (top, up), (bottom, down) = _root(num), _root(den)
    # The scale is put on in two halves, so that it neither over- nor underflows early.
    half = F.pow(F.lit(2.0), (up - down) / F.lit(2.0))
    return F.when((num_max == 0) | (den_max == 0), safe_ratio(num_max, den_max)).when(~is_finite(num_max) | ~is_finite(den_max), F.lit(INFINITY)).otherwise(top / bottom * half * half)


def largest(x: Column) -> Column:
    """The largest magnitude of a column; 0 over no rows."""
    return F.coalesce(F.max(F.abs(x)), F.lit(0.0))


def short_general(x: Column) -> Column:
    """A number in the general form of six significant digits, trailing zeros cut."""
    exponent = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(x)) + F.lit(1e-12))).cast("int")
    digits = F.round(x / F.pow(F.lit(10.0), exponent), 5)
    mantissa = F.regexp_replace(F.regexp_replace(F.format_string("%.5f", digits), "0+$", ""), r"\.$", "")
    scientific = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", x), "0+$", ""), r"\.$", "")
    return F.when((exponent < -4) | (exponent >= 6), scientific).otherwise(plain)
