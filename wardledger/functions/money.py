"""Ratios and percentages of amounts, amounts in hundredths; exact sums are in ``sums``."""

from decimal import Decimal

from pyspark.sql import Column, functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient in DOUBLE; NULL for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """Quotient in DOUBLE; 0 where the denominator is not positive."""
    return F.when(denominator > 0, ratio(numerator, denominator)).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100


def percent_change(new: Column, old: Column) -> Column:
    return ratio(new - old, old) * 100


def hundredths(value: Column, precision: int) -> Column:
    """An amount in hundredths as BIGINT: what a cast to DECIMAL(``precision``, 2) holds.

    The cast goes through the text of a DOUBLE. A DOUBLE that is the nearest to a number of whole
    hundredths of at most 15 digits, as money is, needs no text; all others, NaN and what does
    not fit go through the cast, with its rounding and its errors.
    """
    near = F.rint(value * 100.0)
    plain = (near / 100.0 == value) & (F.abs(near) < 10.0 ** min(precision, 15))
    exact = (value.cast(f"decimal({precision},2)") * 100).cast("bigint")
    return F.when(plain, near.cast("bigint")).otherwise(exact)


def from_units(units: Column, precision: int, scale: int) -> Column:
    """Whole units of 10 ** -``scale`` as DECIMAL."""
    return (units.cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal({precision},{scale})")
