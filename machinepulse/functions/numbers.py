"""Rounding and number texts that come out the same on every engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Nine decimals absorb the last-bit noise of double sums, whose order differs
# from run to run, before a tie is decided.
_EXACT = "decimal(28,9)"
_TEXT = "decimal(28,4)"


def rounded(value: Column, digits: int) -> Column:
    """Half-up rounding through a decimal; doubles that do not fit one (huge,
    NaN, infinite) are rounded as they are instead of failing the job."""
    exact = F.round(value.try_cast(_EXACT), digits).cast("double")
    return F.coalesce(exact, F.round(value.cast("double"), digits))


def rounded_rows(value: Column, digits: int) -> Column:
    """Same result as `rounded`, for columns of very many rows.

    Away from a tie the nearest multiple is plain double arithmetic, and the
    quotient of two exact doubles is the double a decimal would give. Only
    values close to a tie, or large, take the decimal way.
    """
    scale = F.lit(10.0**digits)
    scaled = value * scale
    nearest = F.rint(scaled)
    clear = (F.abs(scaled) < 1e9) & (F.abs(scaled - nearest) < 0.4999)
    # Adding zero turns a negative zero into zero.
    return F.when(clear, nearest / scale + F.lit(0.0)).otherwise(rounded(value, digits))


def whole_half_up(value: Column) -> Column:
    """Nearest integer, halves upwards."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def number_text(value: Column, missing: str = "n/a") -> Column:
    """Shortest plain notation with at most four decimals: 60, 61.4, 0.0125."""
    plain = F.regexp_replace(value.try_cast(_TEXT).cast("string"), r"\.?0+$", "")
    return F.coalesce(plain, value.cast("string"), F.lit(missing))


def shown(value: Column, missing: str = "n/a") -> Column:
    """Any value as text, with a mark where it is missing."""
    return F.coalesce(value.cast("string"), F.lit(missing))
