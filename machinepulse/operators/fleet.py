"""Fleet-wide figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from machinepulse.functions.numbers import rounded, whole_half_up
from machinepulse.functions.periods import (
    ALL_TIME,
    Period,
    period_label,
    readings_in,
    verdicts_in,
)
from machinepulse.operators.latest import latest_rows

# The statuses that are counted; BORDERLINE is not among them, so
# the three counts need not add up to the number of machines.
COUNTED_STATUSES = ("HEALTHY", "WARNING", "CRITICAL")


def _status_counts(status: Column) -> list[Column]:
    return [
        F.count_if(status == name).alias(f"{name.lower()}_count")
        for name in COUNTED_STATUSES
    ]


def _newest_health(readings: DataFrame, period: Period) -> DataFrame:
    """One row per machine: its newest health. A limited window keeps one row per
    machine and task, without comparing structs under a sorted aggregate."""
    return latest_rows(readings_in(readings, period), ["health_pct", "health_status"])


def health_figures(health: str, status: str) -> list[Column]:
    """Aggregates over one row per machine: mean health, status counts, machines."""
    return [
        rounded(F.avg(health), 1).alias("avg_health"),
        *_status_counts(F.col(status)),
        F.count(F.lit(1)).alias("total_machines"),
    ]


_LATEST_FIGURES = ("health_pct", "health_status")


def kpi_latest(readings: DataFrame, period: Period = ALL_TIME) -> DataFrame:
    """One row over the newest reading of each machine."""
    return _newest_health(readings, period).agg(*health_figures(*_LATEST_FIGURES))


def kpi_anomaly_count(verdicts: DataFrame, period: Period = ALL_TIME) -> DataFrame:
    """Number of anomalous verdicts."""
    return (
        verdicts_in(verdicts, period)
        .filter(F.col("is_anomaly"))
        .agg(F.count(F.lit(1)).alias("anomaly_count"))
    )


def kpi_reading_count(readings: DataFrame, period: Period = ALL_TIME) -> DataFrame:
    """Number of readings."""
    return readings_in(readings, period).agg(F.count(F.lit(1)).alias("total_readings"))


def kpi_summary(
    readings: DataFrame, verdicts: DataFrame, period: Period = ALL_TIME
) -> DataFrame:
    """The three figures above in one row, zeros for an empty period.

    Their number is counted apart: it needs no column beyond the period's.
    """
    figures = kpi_latest(readings, period)
    return figures.select(
        F.coalesce("avg_health", F.lit(0.0)).alias("avg_health"),
        *[f"{name.lower()}_count" for name in COUNTED_STATUSES],
        "total_machines",
        kpi_anomaly_count(verdicts, period).scalar().alias("anomaly_count"),
        kpi_reading_count(readings, period).scalar().alias("total_readings"),
    )


def kpi_filtered(assets: DataFrame) -> DataFrame:
    """The figures over a (filtered) asset overview.

    Differs from `kpi_summary` on purpose: health is averaged from the rounded
    values to a whole number and a missing one counts as 0, anomalies are
    machines whose newest verdict is anomalous, and each machine counts as one
    reading.
    """
    mean = F.avg(F.coalesce("health_pct", F.lit(0.0)))
    return assets.agg(
        F.coalesce(whole_half_up(mean), F.lit(0)).alias("avg_health"),
        *_status_counts(F.col("health_status")),
        F.count(F.lit(1)).alias("total_machines"),
        F.count_if(F.col("is_anomaly")).alias("anomaly_count"),
        F.count(F.lit(1)).alias("total_readings"),
    )


def readings_per_machine(readings: DataFrame) -> DataFrame:
    """Row count by machine and type."""
    return (
        readings.groupBy("machine_id", "machine_type")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .orderBy("machine_id", "machine_type")
    )


def reading_periods(readings: DataFrame) -> DataFrame:
    """Every period one can select (month, year, both, neither) with its label
    and number of readings."""
    by_month = readings.groupBy(
        F.year("timestamp").alias("year"), F.month("timestamp").alias("month")
    ).agg(F.count(F.lit(1)).alias("reading_count"))
    return (
        by_month.cube("year", "month")
        .agg(F.sum("reading_count").alias("reading_count"))
        .withColumn("label", period_label(F.col("month"), F.col("year")))
    )
