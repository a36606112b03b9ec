"""Monthly summaries of the facts, kept beside them.

Four tables, each by year and month like the facts themselves:

- the newest readings of each machine in each month, and its newest verdicts.
  Both have the columns of the facts, so an operator that looks at newest rows
  only takes them in place of the facts, for any period. Rows equal in time are
  all kept, since operators settle those by different columns;
- verdict counts per machine and month;
- moments of the sensors per machine type and month, for the type baselines.

A summary of a month depends on the facts of that month alone. After a merge
into the facts, `refresh` makes the summaries of the months it touched anew,
whatever was late, repeated or corrected. A batch of new rows can also be
merged into newest rows without reading the facts (`merge_newest`), since the
newest of newest rows are the newest; only corrections need a refresh.

Sizes: machines times months for the first three, machine types times months
for the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from machinepulse.functions.moments import mean, merged, moments, stddev_samp
from machinepulse.schemas import LAYOUT, MONTH, READINGS, SENSOR_FLAGS, SENSORS, VERDICTS, YEAR, conform
from machinepulse.session import use_utc
from machinepulse.sources.staging import exists, staging
from machinepulse.sources.upsert import Months, in_months, months_of, with_month

Build = Callable[[DataFrame], DataFrame]

# Files of a month. A machine's summary is some hundred bytes, so this serves up
# to about a hundred million machines.
FILES = 16


def newest_by_month(facts: DataFrame) -> DataFrame:
    """The rows of each machine that no other of its rows in the month is after.

    Made from readings or from verdicts. Repeated rows count once.
    """
    newest = Window.partitionBy("machine_id", YEAR, MONTH).orderBy(F.desc("timestamp"))
    return (
        with_month(facts)
        .withColumn("machinepulse_place", F.rank().over(newest))
        .filter(F.col("machinepulse_place") == 1)
        .drop("machinepulse_place")
        .distinct()
    )


def counts_by_month(verdicts: DataFrame) -> DataFrame:
    """Anomalous verdicts, verdicts per sensor flag, and first and last anomaly, by machine."""
    anomalous = F.when(F.col("is_anomaly"), F.col("timestamp"))
    return (
        with_month(verdicts)
        .groupBy("machine_id", YEAR, MONTH)
        .agg(
            F.count_if("is_anomaly").alias("is_anomaly"),
            *[F.count_if(flag).alias(flag) for flag in SENSOR_FLAGS],
            F.min(anomalous).alias("first_anomaly"),
            F.max(anomalous).alias("last_anomaly"),
        )
    )


def moments_by_month(readings: DataFrame) -> DataFrame:
    """Count, mean and squared distance of each sensor, by machine type."""
    return (
        with_month(readings)
        .groupBy("machine_type", YEAR, MONTH)
        .agg(*[moments(sensor).alias(sensor) for sensor in SENSORS])
    )


def type_baselines(by_month: DataFrame) -> DataFrame:
    """Mean and sample deviation of each sensor per machine type, over all months.

    A group has one row for each month of the calendar at most; they are merged
    in order of time, so that a re-run adds up the same.
    """
    parts = F.array_sort(F.collect_list(F.struct(YEAR, MONTH, *SENSORS)))
    known = by_month.groupBy("machine_type").agg(parts.alias("parts"))
    known = known.select(
        "machine_type", *[merged(F.col(f"parts.{sensor}")).alias(sensor) for sensor in SENSORS]
    )
    return known.select(
        "machine_type",
        *[mean(F.col(sensor)).alias(f"avg_{sensor}") for sensor in SENSORS],
        *[stddev_samp(F.col(sensor)).alias(f"std_{sensor}") for sensor in SENSORS],
    )


def write(summary: DataFrame, path: str, months: bool = False, files: int = FILES) -> None:
    """Store a summary, each month in up to `files` files.

    `months`: over the months it has rows of, leaving others as they are.
    """
    by_month = summary.repartition(YEAR, MONTH, *_spread(summary, files))
    (
        by_month.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if months else "static")
        .partitionBy(YEAR, MONTH)
        .parquet(path)
    )


def _spread(summary: DataFrame, files: int) -> list:
    """Months of many machines go into several files, those of types into one."""
    if "machine_id" not in summary.columns:
        return []
    return [F.pmod(F.xxhash64("machine_id"), F.lit(files))]


def refresh(
    build: Build, facts: DataFrame, path: str, months: Months, files: int = FILES
) -> None:
    """Make the summary of these months anew, from the facts of these months alone."""
    if months:
        write(build(in_months(with_month(facts), months)), path, months=True, files=files)


def merge_newest(batch: DataFrame, path: str, files: int = FILES) -> Months:
    """Merge a batch of facts into the newest rows at path; gives the months it touched.

    Reads the newest rows of these months and no facts. Late rows and rows
    delivered again change nothing that is newer; merging a batch twice leaves
    the table as after the first time.
    """
    spark = batch.sparkSession
    schema = READINGS if dict(batch.dtypes)["timestamp"] == "timestamp" else VERDICTS
    rows = with_month(conform(batch.drop(*LAYOUT), schema, "batch"))
    months = months_of(rows)
    if not months:
        return months
    if exists(spark, path):
        rows = rows.unionByName(in_months(read_newest(spark, path, schema), months))
    with staging(spark, "newest") as merged_path:
        write(newest_by_month(rows), merged_path, files=files)
        write(read_newest(spark, merged_path, schema), path, months=True, files=files)
    return months


def read_newest(spark: SparkSession, path: str, schema=READINGS) -> DataFrame:
    """Newest readings, or with the schema VERDICTS newest verdicts, in place of the facts."""
    return conform(use_utc(spark).read.parquet(path), schema, "newest rows")


def read(spark: SparkSession, path: str) -> DataFrame:
    return use_utc(spark).read.parquet(path)
