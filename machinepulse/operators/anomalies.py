"""Anomaly summaries, statistics, histories and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from machinepulse.functions.numbers import rounded
from machinepulse.functions.periods import (
    ALL_TIME,
    Period,
    nanos_to_timestamp,
    of_machine,
    readings_in,
    verdicts_in,
)
from machinepulse.functions.rules import severity
from machinepulse.operators.latest import latest_rows, matched, newest_rows, ordered
from machinepulse.operators.machines import (
    DIGITS,
    FLAG_COUNTS,
    MEASURES,
    SHORT,
    anomaly_span,
    flag_counts,
    measure,
)
from machinepulse.operators.reduction import may_match
from machinepulse.schemas import EVENT_TIME, SENSOR_FLAGS, SENSORS, VERDICT_FLAGS
from machinepulse.sources.facts import machine_table, with_event_time

# Default lengths of the event lists, per machine.
HISTORY_LIMIT = 500
EVENT_LIMIT = 50
RECENT_LIMIT = 20


def _limit(limit: int | None) -> int | None:
    """None means no limit: counts are made of all events, lists of the newest."""
    if limit is not None and limit < 1:
        raise ValueError(f"limit must be positive, got {limit}")
    return limit


def _both_in(
    readings: DataFrame, verdicts: DataFrame, period: Period, machine_id: str | None
) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to the period. Matched rows share their microsecond, so
    the cut on one side implies the other and both scans are pruned."""
    return (
        readings_in(of_machine(readings, machine_id), period),
        verdicts_in(of_machine(verdicts, machine_id), period),
    )


def _for_all_machines(
    stats: DataFrame,
    readings: DataFrame,
    machine_id: str | None,
    counts: tuple[str, ...],
    listed: DataFrame | None,
) -> DataFrame:
    """Adds machines that have nothing to count, with zero counts.

    They come from the machine table if there is one, else from all readings.
    """
    source = readings if listed is None else listed
    machines = of_machine(source, machine_id).select("machine_id").distinct()
    others = [name for name in stats.columns if name not in ("machine_id", *counts)]
    return machines.join(stats, "machine_id", "left").select(
        "machine_id",
        *[F.coalesce(name, F.lit(0)).alias(name) for name in counts],
        *others,
    )


def _means(condition: Column, suffix: str) -> list[Column]:
    return [
        rounded(F.avg(F.when(condition, F.col(name))), DIGITS[name]).alias(
            f"avg_{SHORT[name]}_{suffix}"
        )
        for name in MEASURES
    ]


def anomaly_summary(
    readings: DataFrame,
    verdicts: DataFrame,
    period: Period = ALL_TIME,
    listed: DataFrame | None = None,
) -> DataFrame:
    """Machines with anomalous verdicts: counts, scores and last event, highest
    score first.

    Verdicts are reduced to one row per machine before the types are joined. A
    machine listed under two types appears under both, with the same figures.
    `listed` is the machine table; without it the types come from all readings.
    """
    per_machine = (
        verdicts_in(verdicts, period)
        .filter("is_anomaly")
        .groupBy("machine_id")
        .agg(
            *flag_counts(),
            rounded(F.max("anomaly_score"), 4).alias("max_score"),
            rounded(F.avg("anomaly_score"), 4).alias("avg_score"),
            F.max("timestamp").alias("latest_anomaly_ts"),
        )
        .withColumnRenamed("anomaly_history_count", "anomaly_count")
    )
    types = machine_table(readings) if listed is None else listed
    return (
        per_machine.join(types, "machine_id")
        .select("machine_id", "machine_type", *per_machine.columns[1:])
        .orderBy(F.col("max_score").desc_nulls_first(), "machine_id", "machine_type")
    )


def anomaly_total(summary: DataFrame) -> DataFrame:
    """Sum of the anomaly counts of a summary."""
    return summary.agg(F.coalesce(F.sum("anomaly_count"), F.lit(0)).alias("total_anomalies"))


def anomaly_severity(summary: DataFrame) -> DataFrame:
    """Severity per machine: its highest score scaled between the lowest and
    highest of all. Equal scores everywhere scale to 0."""
    ends = summary.agg(
        F.struct(F.min("max_score").alias("low"), F.max("max_score").alias("high"))
    ).scalar()
    spread = ends.getField("high") - ends.getField("low")
    ratio = (F.col("max_score") - ends.getField("low")) / F.when(spread == 0, 1.0).otherwise(
        spread
    )
    return summary.select(
        "machine_id",
        "machine_type",
        "max_score",
        rounded(ratio, 4).alias("score_ratio"),
        severity(ratio).alias("severity"),
        F.date_format(
            nanos_to_timestamp(F.col("latest_anomaly_ts")), "dd MMM, HH:mm"
        ).alias("latest_label"),
    )


def anomaly_stats(
    readings: DataFrame,
    verdicts: DataFrame,
    period: Period = ALL_TIME,
    machine_id: str | None = None,
    listed: DataFrame | None = None,
) -> DataFrame:
    """Per machine, over readings that have a verdict: counts, share, scores,
    first and last anomaly, and mean sensor values in anomaly and normal
    operation. A verdict of unknown outcome is in neither mean."""
    own_readings, own_verdicts = _both_in(readings, verdicts, period, machine_id)
    counts = ("total_readings", *FLAG_COUNTS)
    anomalous = F.col("is_anomaly")
    stats = (
        matched(own_verdicts, own_readings, ["anomaly_score", *VERDICT_FLAGS], MEASURES)
        .groupBy("machine_id")
        .agg(
            F.count(F.lit(1)).alias("total_readings"),
            *flag_counts(),
            rounded(F.max("anomaly_score"), 4).alias("max_score"),
            rounded(F.min("anomaly_score"), 4).alias("min_score"),
            rounded(F.avg("anomaly_score"), 4).alias("avg_score"),
            *anomaly_span("nanos"),
            *_means(anomalous, "anomaly"),
            *_means(~anomalous, "normal"),
        )
    )
    share = F.try_divide(F.col("anomaly_count") * 100.0, F.col("total_readings"))
    return (
        _for_all_machines(stats, readings, machine_id, counts, listed)
        .withColumnRenamed("anomaly_history_count", "anomaly_count")
        .withColumn("anomaly_pct", rounded(share, 2))
    )


def anomaly_type_share(stats: DataFrame) -> DataFrame:
    """Each sensor's anomalies as a percentage of the readings."""
    sensors = F.array(
        *[
            F.struct(
                F.lit(sensor).alias("sensor"),
                F.col(f"{SHORT[sensor]}_anomaly_count").alias("anomaly_count"),
            )
            for sensor in SENSORS
        ]
    )
    return stats.select("machine_id", "total_readings", F.inline(sensors)).withColumn(
        "share_pct",
        rounded(F.try_divide(F.col("anomaly_count") * 100.0, F.col("total_readings")), 1),
    )


def anomaly_vs_normal(stats: DataFrame) -> DataFrame:
    """Means in anomaly and normal operation side by side. For health lower is
    worse; for a sensor any difference is."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("measure"),
                F.col(f"avg_{SHORT[name]}_anomaly").alias("anomaly_mean"),
                F.col(f"avg_{SHORT[name]}_normal").alias("normal_mean"),
            )
            for name in MEASURES
        ]
    )
    delta = F.col("anomaly_mean") - F.col("normal_mean")
    worse = F.when(F.col("measure") == "health_pct", delta < 0).otherwise(delta != 0)
    return stats.select("machine_id", F.inline(rows)).select(
        "machine_id",
        "measure",
        "anomaly_mean",
        "normal_mean",
        rounded(delta, 2).alias("delta"),
        worse.alias("is_worse"),
    )


def anomaly_events(
    verdicts: DataFrame,
    period: Period = ALL_TIME,
    machine_id: str | None = None,
    limit: int | None = EVENT_LIMIT,
) -> DataFrame:
    """The newest anomalous verdicts of each machine."""
    events = newest_rows(
        verdicts_in(of_machine(verdicts, machine_id), period).filter("is_anomaly"),
        ["machine_id"],
        _limit(limit),
        ["timestamp", "anomaly_score", *VERDICT_FLAGS],
    ).select("machine_id", "timestamp", measure("anomaly_score"), *VERDICT_FLAGS)
    return ordered(events, machine_id, F.col("timestamp").desc())


def _anomalous_readings(
    readings: DataFrame,
    verdicts: DataFrame,
    period: Period,
    machine_id: str | None,
    limit: int | None,
    verdict_columns: tuple[str, ...],
    reading_columns: tuple[str, ...],
    reduced: bool,
) -> DataFrame:
    own_readings, own_verdicts = _both_in(readings, verdicts, period, machine_id)
    anomalous = own_verdicts.filter("is_anomaly")
    if reduced:
        keys = with_event_time(anomalous).select("machine_id", F.col(EVENT_TIME).alias("timestamp"))
        own_readings = own_readings.filter(may_match(keys, ["machine_id", "timestamp"]))
    events = matched(anomalous, own_readings, verdict_columns, reading_columns)
    return newest_rows(
        events, ["machine_id"], _limit(limit), ["nanos", *verdict_columns, *reading_columns]
    )


def anomaly_history(
    readings: DataFrame,
    verdicts: DataFrame,
    period: Period = ALL_TIME,
    machine_id: str | None = None,
    limit: int | None = HISTORY_LIMIT,
    reduced: bool = False,
) -> DataFrame:
    """The newest anomalous verdicts of each machine with their readings.

    `reduced` leaves out readings without an anomalous verdict before they are
    shuffled: worth its two passes over the verdicts where few of many readings
    are anomalous and the tables are not stored for matching.
    """
    events = _anomalous_readings(
        readings, verdicts, period, machine_id, limit, SENSOR_FLAGS, MEASURES, reduced
    ).select("machine_id", "timestamp", *[measure(name) for name in MEASURES], *SENSOR_FLAGS)
    return ordered(events, machine_id, F.col("timestamp").desc())


def anomaly_recent(
    readings: DataFrame,
    verdicts: DataFrame,
    period: Period = ALL_TIME,
    machine_id: str | None = None,
    limit: int | None = RECENT_LIMIT,
    reduced: bool = False,
) -> DataFrame:
    """As `anomaly_history`, shorter, with score and status."""
    events = _anomalous_readings(
        readings,
        verdicts,
        period,
        machine_id,
        limit,
        ("anomaly_score", *VERDICT_FLAGS),
        (*MEASURES, "health_status"),
        reduced,
    ).select(
        "machine_id",
        "timestamp",
        measure("anomaly_score"),
        *VERDICT_FLAGS,
        *[measure(name) for name in MEASURES],
        "health_status",
    )
    return ordered(events, machine_id, F.col("timestamp").desc())


def anomaly_latest_reading(
    readings: DataFrame,
    verdicts: DataFrame,
    period: Period = ALL_TIME,
    machine_id: str | None = None,
) -> DataFrame:
    """The newest reading of each machine that has a verdict."""
    own_readings, own_verdicts = _both_in(readings, verdicts, period, machine_id)
    reading_columns = ["machine_type", *MEASURES, "health_status"]
    verdict_columns = ["anomaly_score", *VERDICT_FLAGS]
    pairs = matched(own_verdicts, own_readings, verdict_columns, reading_columns)
    return latest_rows(pairs, [*reading_columns, *verdict_columns]).select(
        "machine_id",
        "machine_type",
        *[measure(name) for name in MEASURES],
        "health_status",
        measure("anomaly_score"),
        *VERDICT_FLAGS,
        "timestamp",
    )


def flagged_history(
    readings: DataFrame,
    verdicts: DataFrame,
    period: Period = ALL_TIME,
    machine_id: str | None = None,
) -> DataFrame:
    """Counts, span and mean sensor values of the anomalies of each machine that
    has any. Verdicts with no flag set add to none of these and stay out of the
    join."""
    own_readings, own_verdicts = _both_in(readings, verdicts, period, machine_id)
    flagged = own_verdicts.filter(" OR ".join(VERDICT_FLAGS))
    return (
        matched(flagged, own_readings, VERDICT_FLAGS, MEASURES)
        .groupBy("machine_id")
        .agg(*flag_counts(), *anomaly_span("nanos"), *_means(F.col("is_anomaly"), "anomaly"))
    )


def machine_anomaly_history(
    readings: DataFrame,
    verdicts: DataFrame,
    period: Period = ALL_TIME,
    machine_id: str | None = None,
    listed: DataFrame | None = None,
) -> DataFrame:
    """`flagged_history` for every machine, zero counts included."""
    history = flagged_history(readings, verdicts, period, machine_id)
    return _for_all_machines(history, readings, machine_id, FLAG_COUNTS, listed)


def history_by_month(history: DataFrame) -> DataFrame:
    """Events of a history per machine and month, newest month first."""
    month = F.date_format("timestamp", "yyyy-MM")
    return (
        history.groupBy("machine_id", month.alias("event_month"))
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.date_format(F.max("timestamp"), "MMM yyyy").alias("month_label"),
        )
        .orderBy("machine_id", F.col("event_month").desc())
    )


def event_labels(events: DataFrame) -> DataFrame:
    """Event times cut to the minute and to the day."""
    return events.select(
        "machine_id",
        "timestamp",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("minute_label"),
        F.date_format("timestamp", "yyyy-MM-dd").alias("day_label"),
    )
