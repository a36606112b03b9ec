"""Periods, and the two time encodings (timestamp, epoch nanoseconds)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from machinepulse.schemas import MONTH, YEAR

# Month names as shown to users.
MONTH_NAMES = (
    "Jan", "Feb", "Mar", "Apr", "May", "Jun",
    "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
)

_LONG_MAX = 2**63 - 1


def _micros(year: int, month: int) -> int:
    if year > 9999:
        return _LONG_MAX // 1000
    start = datetime(year, month, 1, tzinfo=timezone.utc)
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    return int((start - epoch).total_seconds()) * 1_000_000


@dataclass(frozen=True)
class Period:
    """An optional month and an optional year, independent of each other.

    A month without a year means that month of every year. None and 0 both
    mean "no restriction".

    `years` tells the first and last year of a table, see `within`.
    """

    month: int | None = None
    year: int | None = None
    years: tuple[int, int] | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "month", self.month or None)
        object.__setattr__(self, "year", self.year or None)
        if self.month is not None and not 1 <= self.month <= 12:
            raise ValueError(f"month must be 1-12, got {self.month}")
        if self.year is not None and not 1 <= self.year <= 9999:
            raise ValueError(f"year must be 1-9999, got {self.year}")

    def within(self, years: tuple[int, int] | None) -> Period:
        """The same period for a table whose rows lie in these years.

        A month of every year then becomes a range per year, which reaches the
        readers of any source. Rows in other years are still found, only not
        pruned, so years that have become too narrow do no harm.
        """
        return replace(self, years=years)

    @property
    def label(self) -> str:
        """A month alone is labelled like no restriction at all."""
        if self.month and self.year:
            return f"{MONTH_NAMES[self.month - 1]} {self.year}"
        return f"Year {self.year}" if self.year else "All time"

    def micros(self) -> tuple[int, int] | None:
        """Start and end (exclusive) in epoch microseconds, if a year is given."""
        if self.year is None:
            return None
        if self.month is None:
            return _micros(self.year, 1), _micros(self.year + 1, 1)
        after = (self.year + 1, 1) if self.month == 12 else (self.year, self.month + 1)
        return _micros(self.year, self.month), _micros(*after)


    def yearly_micros(self) -> list[tuple[int | None, int | None]] | None:
        """For a month of every year: its range in each of the known years, and what lies
        before and after those years."""
        if self.year or not self.month or not self.years:
            return None
        first, last = self.years
        inner = [Period(self.month, year).micros() for year in range(first, last + 1)]
        return [(None, _micros(first, 1)), *inner, (_micros(last + 1, 1), None)]


ALL_TIME = Period()


def period_label(month: Column, year: Column) -> Column:
    """`Period.label` for columns."""
    names = F.array(*[F.lit(name) for name in MONTH_NAMES])
    return (
        F.when(
            month.isNotNull() & year.isNotNull(),
            F.concat_ws(" ", F.get(names, month.cast("int") - 1), year.cast("string")),
        )
        .when(year.isNotNull(), F.concat(F.lit("Year "), year.cast("string")))
        .otherwise(F.lit("All time"))
    )


def nanos_to_timestamp(nanos: Column) -> Column:
    """Nanoseconds cut to microseconds, in integers; a double would lose digits."""
    return F.timestamp_micros(F.call_function("div", nanos, F.lit(1000)))


def whole_second_nanos(timestamp: Column) -> Column:
    """The whole second of a timestamp, in nanoseconds."""
    return F.unix_seconds(timestamp) * F.lit(1_000_000_000)


def _layout(df: DataFrame, period: Period) -> list[Column]:
    """Conditions on the year and month partition columns, where a table has them."""
    conditions = []
    if period.year and YEAR in df.columns:
        conditions.append(F.col(YEAR) == period.year)
    if period.month and MONTH in df.columns:
        conditions.append(F.col(MONTH) == period.month)
    return conditions


def _all(df: DataFrame, conditions: list[Column]) -> DataFrame:
    for condition in conditions:
        df = df.filter(condition)
    return df


def months_in(df: DataFrame, period: Period) -> DataFrame:
    """Rows of a table by month, cut by its layout columns alone."""
    return _all(df, _layout(df, period))


def _yearly(column: str, period: Period, bound: Callable[[int], Column]) -> list[Column]:
    ranges = []
    for start, end in period.yearly_micros() or ():
        low = None if start is None else F.col(column) >= bound(start)
        high = None if end is None else F.col(column) < bound(end)
        ranges.append(reduce(Column.__and__, [c for c in (low, high) if c is not None]))
    return [reduce(Column.__or__, ranges)] if ranges else []


def readings_in(df: DataFrame, period: Period, column: str = "timestamp") -> DataFrame:
    """Rows whose timestamp lies in the period.

    With a year the condition is a range on the bare column, which reaches the
    Parquet reader; a month alone is pruned through the layout, or through
    ranges for the years that `Period.within` was told.
    """
    conditions = _layout(df, period)
    bounds = period.micros()
    bound = lambda micros: F.timestamp_micros(F.lit(micros))
    if bounds:
        start, end = map(bound, bounds)
        conditions += [F.col(column) >= start, F.col(column) < end]
    elif period.month:
        conditions += _yearly(column, period, bound)
        conditions.append(F.month(column) == period.month)
    return _all(df, conditions)


def verdicts_in(df: DataFrame, period: Period, column: str = "timestamp") -> DataFrame:
    """Same for a column of epoch nanoseconds; the range is on the raw long."""
    conditions = _layout(df, period)
    bounds = period.micros()
    bound = lambda micros: F.lit(max(-_LONG_MAX, min(_LONG_MAX, micros * 1000)))
    if bounds:
        start, end = map(bound, bounds)
        conditions += [F.col(column) >= start, F.col(column) < end]
    elif period.month:
        conditions += _yearly(column, period, bound)
        conditions.append(F.month(nanos_to_timestamp(F.col(column))) == period.month)
    return _all(df, conditions)


def of_machine(df: DataFrame, machine_id: str | None) -> DataFrame:
    """One machine, or all when none is named."""
    return df if machine_id is None else df.filter(F.col("machine_id") == machine_id)
