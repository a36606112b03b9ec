"""Late, repeated and corrected rows: merging a batch into the stored facts.

Both tables are stored by year and month. A batch touches the months its rows
lie in; these are written anew, all others keep their files. A row is known by
machine and time, and the row of a batch takes the place of a stored one, so
writing a batch twice leaves the table as after the first time. That also mends
a merge that was cut off between two months: it is run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from machinepulse.schemas import EVENT_TIME, LAYOUT, MONTH, READINGS, VERDICTS, YEAR, conform
from machinepulse.sources import facts
from machinepulse.sources.staging import exists, staging

Months = list[tuple[int, int]]

_KEY = ("machine_id", "timestamp")


def with_month(df: DataFrame) -> DataFrame:
    """The table with its layout columns; verdicts get their instant as well."""
    if YEAR in df.columns and MONTH in df.columns:
        return df
    timed = facts.with_event_time(df) if dict(df.dtypes)["timestamp"] == "bigint" else df
    time = EVENT_TIME if EVENT_TIME in timed.columns else "timestamp"
    return timed.withColumns(
        {YEAR: F.year(time).cast("int"), MONTH: F.month(time).cast("int")}
    )


def months_of(df: DataFrame) -> Months:
    """The months the rows lie in; at most as many as the calendar has."""
    found = with_month(df).select(YEAR, MONTH).distinct().collect()
    return sorted((row[0], row[1]) for row in found)


def in_months(df: DataFrame, months: Months) -> DataFrame:
    """Rows of these months, by the layout columns alone, so that directories are pruned."""
    return df.filter((F.col(YEAR) * 12 + F.col(MONTH)).isin([y * 12 + m for y, m in months]))


def replace_months(rows: DataFrame, path: str, time: str, files: int | None = None) -> None:
    """Write rows over the months they lie in; months without rows stay as they are."""
    facts.write_by_month(rows, time, path, "overwrite", files, dynamic=True)


def merge_readings(batch: DataFrame, path: str, files: int | None = None) -> Months:
    """Merge a batch into the readings at path and return the months it touched.

    Of rows of the batch with one machine and time the greatest by the other
    columns counts, so a re-run takes the same. A missing machine or time fails
    the merge before anything is written. Without a table one is made.
    """
    rows = facts.checked(conform(batch, READINGS, "readings"), "readings")
    return _merge(rows, facts.read_readings, READINGS.names, "timestamp", path, files)


def merge_verdicts(batch: DataFrame, path: str, files: int | None = None) -> Months:
    """`merge_readings` for verdicts."""
    rows = facts.checked(conform(batch, VERDICTS, "verdicts"), "verdicts")
    return _merge(rows, facts.read_verdicts, VERDICTS.names, EVENT_TIME, path, files)


def _merge(
    batch: DataFrame,
    read: Callable[[SparkSession, str], DataFrame],
    names: list[str],
    time: str,
    path: str,
    files: int | None,
) -> Months:
    spark = batch.sparkSession
    if batch.isEmpty():
        return []
    one_each = _one_of_each_key(batch.drop(*LAYOUT), names)
    with staging(spark, "batch") as arrived, staging(spark, "merged") as merged:
        # Checked and cut once; what follows reads it three times.
        facts.write_by_month(with_month(one_each), time, arrived, "errorifexists", files)
        new = read(spark, arrived)
        months = months_of(new)
        rows = new
        if exists(spark, path):
            kept = in_months(read(spark, path), months).join(
                new.select(*_KEY), list(_KEY), "left_anti"
            )
            rows = new.unionByName(kept)
        # Written beside the table first, since the table is read for it.
        facts.write_by_month(rows, time, merged, "errorifexists", files)
        replace_months(read(spark, merged), path, time, files)
    return months


def _one_of_each_key(batch: DataFrame, names: list[str]) -> DataFrame:
    """One row per machine and time. The key holds the time, so no machine is one group."""
    others = [name for name in names if name not in _KEY]
    greatest: Column = F.max(F.struct(*others)).alias("machinepulse_row")
    return batch.groupBy(*_KEY).agg(greatest).select(
        *[name if name in _KEY else F.col(f"machinepulse_row.{name}") for name in names]
    )
