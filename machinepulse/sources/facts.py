"""The two fact tables: loading, and two layouts to store them in.

`write_readings` / `write_verdicts` lay files out by year and month, ranged by
(machine, time) within. Ranging on time as well as machine lets one machine with
a large share of the rows spread over many files, keeps row groups narrow in both
columns, and lets a period prune directories.

`save_for_matching` buckets both tables by (machine, time), the key on which
readings and verdicts are matched, so that join needs no shuffle. Bucketing by
machine alone would put a dominant machine into one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from machinepulse.functions.periods import nanos_to_timestamp
from machinepulse.schemas import EVENT_TIME, MONTH, READINGS, VERDICTS, YEAR, conform
from machinepulse.session import use_utc

_TIMESTAMP_TYPE = "spark.sql.parquet.outputTimestampType"


def read_readings(
    spark: SparkSession, path: str | None = None, fmt: str = "parquet", **options: str
) -> DataFrame:
    """Sensor readings from any source Spark can read.

    Columns and types are checked here; that no machine or time is null is
    checked by the writers and by `quality.require_times`, which a job that
    reads an unchecked source runs first. A check in this place would keep
    filters from reaching the source.
    """
    raw = use_utc(spark).read.format(fmt).options(**options).load(path)
    return conform(raw, READINGS, "readings")


def read_verdicts(
    spark: SparkSession, path: str | None = None, fmt: str = "parquet", **options: str
) -> DataFrame:
    """Anomaly verdicts from any source Spark can read."""
    raw = use_utc(spark).read.format(fmt).options(**options).load(path)
    return conform(raw, VERDICTS, "verdicts")


def years_of(df: DataFrame) -> tuple[int, int] | None:
    """First and last year of a fact table, for `Period.within`; None without rows.

    One pass over the time column.
    """
    first, last = df.agg(F.min("timestamp"), F.max("timestamp")).first()
    if first is None:
        return None
    if isinstance(first, int):
        first, last = (_instant(nanos) for nanos in (first, last))
    return first.year, last.year


def _instant(nanos: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=nanos // 1000)


def register_views(readings: DataFrame, verdicts: DataFrame) -> None:
    """Make the tables available to `spark.sql(text, args=[...])`."""
    readings.createOrReplaceTempView("readings")
    verdicts.createOrReplaceTempView("anomalies")


def with_event_time(verdicts: DataFrame) -> DataFrame:
    """Verdicts with their instant as a timestamp, unless stored that way."""
    if EVENT_TIME in verdicts.columns:
        return verdicts
    return verdicts.withColumn(EVENT_TIME, nanos_to_timestamp(F.col("timestamp")))


def _required(name: str, table: str) -> Column:
    """The column, failing the write at the first row where it is missing."""
    message = F.lit(f"{table}.{name} must not be null")
    return F.when(F.col(name).isNull(), F.raise_error(message)).otherwise(F.col(name))


def checked(df: DataFrame, table: str) -> DataFrame:
    """The table, failing at the first row without machine or time."""
    return df.withColumns(
        {name: _required(name, table) for name in ("machine_id", "timestamp")}
    )


@contextmanager
def _microsecond_files(spark: SparkSession) -> Iterator[None]:
    """Parquet keeps min/max statistics for microsecond timestamps, not for the
    default 96-bit ones; without them a time range cannot skip row groups."""
    before = spark.conf.get(_TIMESTAMP_TYPE)
    spark.conf.set(_TIMESTAMP_TYPE, "TIMESTAMP_MICROS")
    try:
        yield
    finally:
        spark.conf.set(_TIMESTAMP_TYPE, before)


def write_by_month(
    df: DataFrame, time: str, path: str, mode: str, files: int | None, dynamic: bool = False
) -> None:
    """Store rows by the year and month of a time column, ranged by machine and time.

    `dynamic`: overwriting replaces only the months that have rows.
    """
    laid_out = df.withColumns(
        {
            YEAR: F.year(F.col(time)).cast("int"),
            MONTH: F.month(F.col(time)).cast("int"),
        }
    )
    keys = (YEAR, MONTH, "machine_id", time)
    ranged = (
        laid_out.repartitionByRange(files, *keys)
        if files
        else laid_out.repartitionByRange(*keys)
    )
    overwritten = "dynamic" if dynamic else "static"
    with _microsecond_files(df.sparkSession):
        (
            ranged.sortWithinPartitions(*keys)
            .write.mode(mode)
            .option("partitionOverwriteMode", overwritten)
            .partitionBy(YEAR, MONTH)
            .parquet(path)
        )


def write_readings(
    readings: DataFrame, path: str, mode: str = "errorifexists", files: int | None = None
) -> None:
    """Store readings by period; rejects a missing machine or time."""
    write_by_month(checked(readings, "readings"), "timestamp", path, mode, files)


def machine_table(readings: DataFrame) -> DataFrame:
    """The distinct (machine_id, machine_type) of the readings."""
    return readings.select("machine_id", "machine_type").distinct()


def write_machines(readings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store the machine table beside the facts.

    Operators that list all machines take it, and then read no reading outside
    their period; without it they derive it from all readings.
    """
    machine_table(readings).write.mode(mode).parquet(path)


def read_machines(spark: SparkSession, path: str) -> DataFrame:
    return use_utc(spark).read.parquet(path).select("machine_id", "machine_type")


def write_verdicts(
    verdicts: DataFrame, path: str, mode: str = "errorifexists", files: int | None = None
) -> None:
    """Store verdicts by period, with their instant beside the nanoseconds."""
    timed = with_event_time(checked(verdicts, "verdicts"))
    write_by_month(timed, EVENT_TIME, path, mode, files)


def save_for_matching(
    readings: DataFrame,
    verdicts: DataFrame,
    buckets: int,
    readings_table: str,
    verdicts_table: str,
    mode: str = "errorifexists",
) -> None:
    """Store both as catalog tables bucketed on the matching key.

    They land in the session's warehouse, which on a cluster must be storage
    that all executors share.
    One file per bucket; choose `buckets` so that one holds a few GB at most.
    """
    timed = with_event_time(checked(verdicts, "verdicts"))
    for df, time, table in (
        (checked(readings, "readings"), "timestamp", readings_table),
        (timed, EVENT_TIME, verdicts_table),
    ):
        with _microsecond_files(df.sparkSession):
            (
                df.repartition(buckets, "machine_id", time)
                .write.mode(mode)
                .bucketBy(buckets, "machine_id", time)
                .sortBy("machine_id", time)
                .saveAsTable(table)
            )
