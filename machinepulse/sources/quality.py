"""Checks on the fact tables, each a distributed aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from machinepulse.functions.rules import status_from_health
from machinepulse.schemas import SENSOR_FLAGS, SchemaError


def status_conflicts(readings: DataFrame) -> DataFrame:
    """How often each stored status meets each status implied by the health
    percentage; reported only, never corrected."""
    return (
        readings.groupBy(
            F.col("health_status").alias("stored_status"),
            status_from_health(F.col("health_pct")).alias("implied_status"),
        )
        .agg(F.count(F.lit(1)).alias("reading_count"))
        .withColumn(
            "agrees", F.col("stored_status").eqNullSafe(F.col("implied_status"))
        )
    )


def repeated_readings(readings: DataFrame) -> DataFrame:
    """(machine, timestamp) pairs that occur more than once."""
    return (
        readings.groupBy("machine_id", "timestamp")
        .agg(F.count(F.lit(1)).alias("reading_count"))
        .filter(F.col("reading_count") > 1)
    )


def machines_of_several_types(readings: DataFrame) -> DataFrame:
    """Machines listed under more than one type; the anomaly summary counts
    their events once per type."""
    return (
        readings.select("machine_id", "machine_type")
        .distinct()
        .groupBy("machine_id")
        .agg(F.count(F.lit(1)).alias("type_count"))
        .filter(F.col("type_count") > 1)
    )


def repeated_pages(pages: DataFrame) -> DataFrame:
    """(guide, page) pairs that occur more than once; lookups expect one."""
    return (
        pages.groupBy("guide_id", "page")
        .agg(F.count(F.lit(1)).alias("page_count"))
        .filter(F.col("page_count") > 1)
    )


def require_times(df: DataFrame, table: str) -> None:
    """Raise if any row lacks its machine or time. Runs a job."""
    missing = df.filter(F.col("machine_id").isNull() | F.col("timestamp").isNull())
    if not missing.isEmpty():
        raise SchemaError(f"{table}: rows without machine_id or timestamp")


def observed_readings(readings: DataFrame, name: str = "readings") -> tuple[DataFrame, Observation]:
    """The readings, and figures about them that come with the next job that reads them all.

    No pass of its own: `observation.get` waits for that job. rows; rows without
    machine or time (what `require_times` looks for); rows whose stored status
    is not the one that their health implies (what `status_conflicts` lists);
    rows without health; first and last time. A limit above the observed rows
    would make the figures those of the rows that were read.
    """
    agrees = F.col("health_status").eqNullSafe(status_from_health(F.col("health_pct")))
    observation = Observation(name)
    return readings.observe(observation, *_figures(), F.count_if(~agrees).alias("status_conflicts"),
        F.count_if(F.col("health_pct").isNull()).alias("without_health")), observation


def observed_verdicts(verdicts: DataFrame, name: str = "verdicts") -> tuple[DataFrame, Observation]:
    """`observed_readings` for verdicts: rows of unknown outcome, and flags without an anomaly."""
    flagged = F.greatest(*[F.coalesce(flag, F.lit(False)) for flag in SENSOR_FLAGS])
    observation = Observation(name)
    return verdicts.observe(observation, *_figures(), F.count_if(F.col("is_anomaly").isNull())
        .alias("unknown_outcomes"), F.count_if(flagged & ~F.col("is_anomaly"))
        .alias("flags_without_anomaly")), observation


def _figures() -> list[Column]:
    unkeyed = F.col("machine_id").isNull() | F.col("timestamp").isNull()
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(unkeyed).alias("without_key"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    ]


def require_keys(observation: Observation, table: str) -> dict[str, object]:
    """The figures of an observation, once its job has run; raises if rows lacked machine or time."""
    figures = observation.get
    if figures["without_key"]:
        raise SchemaError(f"{table}: {figures['without_key']} rows without machine_id or timestamp")
    return figures
