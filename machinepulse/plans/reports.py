"""Per-machine report: snapshot, anomaly history and the rules on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from machinepulse.functions import rules
from machinepulse.functions.periods import ALL_TIME, Period
from machinepulse.functions.ranges import out_of_range_count
from machinepulse.operators.anomalies import flagged_history
from machinepulse.operators.machines import FLAG_COUNTS, machine_snapshot
from machinepulse.schemas import SENSORS


def machine_report(
    readings: DataFrame,
    verdicts: DataFrame,
    period: Period = ALL_TIME,
    machine_id: str | None = None,
) -> DataFrame:
    """Snapshot with anomaly history, one row per machine seen in the period."""
    snapshot = machine_snapshot(readings, verdicts, period, machine_id)
    history = flagged_history(readings, verdicts, period, machine_id)
    others = [name for name in history.columns if name not in ("machine_id", *FLAG_COUNTS)]
    return snapshot.join(history, "machine_id", "left").select(
        *snapshot.columns,
        *[F.coalesce(name, F.lit(0)).alias(name) for name in FLAG_COUNTS],
        *others,
    )


def with_rules(report: DataFrame) -> DataFrame:
    """Task mode, report format and priority of each machine."""
    is_anomaly, health = F.col("is_anomaly"), F.col("health_pct")
    past = F.col("anomaly_history_count")
    outside = out_of_range_count(
        F.col("machine_type"), {sensor: F.col(sensor) for sensor in SENSORS}
    )
    return report.withColumns(
        {
            "sensors_out_of_range": outside,
            "task_mode": rules.task_mode(is_anomaly, health, past),
            "report_format": rules.report_format(is_anomaly, health, past, outside),
            "priority": rules.priority(health, is_anomaly),
        }
    )


def recommendation_snapshot(report: DataFrame) -> DataFrame:
    """The record handed on per machine, sensors nested, with its JSON form.

    Numbers go through decimals, which JSON shows plainly (0.0002, 100).
    """

    def plain(name: str) -> Column:
        return F.col(name).try_cast("decimal(28,4)").alias(name)

    snapshot = F.struct(*[plain(name) for name in (*SENSORS, "health_pct")])
    record = F.struct(
        "machine_id",
        "machine_type",
        "is_anomaly",
        plain("health_pct"),
        snapshot.alias("sensor_snapshot"),
    )
    return report.select(
        "machine_id",
        "machine_type",
        "is_anomaly",
        "health_pct",
        F.struct(*SENSORS, "health_pct").alias("sensor_snapshot"),
        F.to_json(F.to_variant_object(record)).alias("record"),
    )
