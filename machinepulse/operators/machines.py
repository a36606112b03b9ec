"""Per-machine tables: overviews, detail, snapshot, time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from machinepulse.functions.numbers import rounded, rounded_rows
from machinepulse.functions.periods import (
    ALL_TIME,
    Period,
    months_in,
    nanos_to_timestamp,
    of_machine,
    readings_in,
    verdicts_in,
    whole_second_nanos,
)
from machinepulse.functions.rules import asset_state, count_true, rul_days, trend_direction
from machinepulse.operators.latest import latest_rows, newest, ordered
from machinepulse.schemas import MONTH, READINGS, SENSOR_FLAGS, SENSORS, VERDICT_FLAGS, YEAR

# Decimals shown per measure.
DIGITS = {
    "temperature": 2,
    "vibration": 4,
    "pressure": 4,
    "health_pct": 1,
    "avg_deviation_pct": 2,
    "anomaly_score": 4,
}
MEASURES = (*SENSORS, "health_pct")
READING_VALUES = tuple(
    name for name in READINGS.names if name not in ("machine_id", "timestamp")
)
SHORT = {"temperature": "temp", "vibration": "vib", "pressure": "press", "health_pct": "health"}

# The trend compares with the last reading at least this far back.
TREND_DAYS = 7


def measure(name: str, source: str | None = None) -> Column:
    """A measure rounded for display."""
    return rounded(F.col(source or name), DIGITS[name]).alias(name)


def flag_counts() -> list[Column]:
    """Aggregates: anomalous verdicts, and verdicts per sensor flag."""
    return [
        F.count_if("is_anomaly").alias("anomaly_history_count"),
        *[
            F.count_if(f"is_{sensor}_anomaly").alias(f"{SHORT[sensor]}_anomaly_count")
            for sensor in SENSORS
        ],
    ]


FLAG_COUNTS = (
    "anomaly_history_count",
    *[f"{SHORT[sensor]}_anomaly_count" for sensor in SENSORS],
)


def anomaly_span(nanos: str = "timestamp") -> list[Column]:
    """Aggregates: first and last anomalous verdict, as timestamps."""
    when_anomalous = F.when(F.col("is_anomaly"), F.col(nanos))
    return [
        nanos_to_timestamp(F.min(when_anomalous)).alias("first_anomaly_ts"),
        nanos_to_timestamp(F.max(when_anomalous)).alias("last_anomaly_ts"),
    ]


def _newest_verdict(
    verdicts: DataFrame, period: Period, machine_id: str | None, *more: Column
) -> DataFrame:
    """One row per machine: its newest verdict and any further aggregates, in
    one pass."""
    return (
        verdicts_in(of_machine(verdicts, machine_id), period)
        .groupBy("machine_id")
        .agg(newest(["anomaly_score", *VERDICT_FLAGS]).alias("verdict"), *more)
    )


def by_health(df: DataFrame) -> DataFrame:
    """Lowest health first, by the value before rounding."""
    return df.orderBy(F.col("health_order").asc_nulls_last(), "machine_id")


def _assets(readings: DataFrame, verdicts: DataFrame, period: Period) -> DataFrame:
    selected = readings_in(readings, period)
    judged = _newest_verdict(verdicts, period, None, *flag_counts(), *anomaly_span())
    return _overview(selected.withColumn("is_past", F.col("timestamp") <= _bound(selected)), judged)


def _bound(selected: DataFrame) -> Column:
    """The trend compares with the last reading up to this time."""
    return selected.agg(F.max("timestamp")).scalar() - F.make_dt_interval(F.lit(TREND_DAYS))


def _overview(marked: DataFrame, judged: DataFrame) -> DataFrame:
    """The overview from readings marked as past or not, and one row of verdicts per machine."""
    # At most two rows per machine: its newest one since the bound and its
    # newest one before. The later of them is the present.
    ends = latest_rows(marked, READING_VALUES, "is_past")
    latest = ends.groupBy("machine_id").agg(
        newest(READING_VALUES).alias("now"),
        newest(["health_pct"], where=F.col("is_past")).alias("past"),
    )
    return latest.join(judged, "machine_id", "left").select(
        "machine_id",
        "now.machine_type",
        measure("health_pct", "now.health_pct"),
        "now.health_status",
        *[measure(name, f"now.{name}") for name in SENSORS],
        "now.operational_time",
        "now.is_running",
        measure("avg_deviation_pct", "now.avg_deviation_pct"),
        "now.timestamp",
        rounded(F.col("past.health_pct"), 1).alias("health_past_ago"),
        rounded(F.col("now.health_pct") - F.col("past.health_pct"), 1).alias("trend_pct"),
        measure("anomaly_score", "verdict.anomaly_score"),
        *[F.col(f"verdict.{flag}").alias(flag) for flag in VERDICT_FLAGS],
        *[F.coalesce(name, F.lit(0)).alias(name) for name in FLAG_COUNTS],
        "first_anomaly_ts",
        "last_anomaly_ts",
        F.col("now.health_pct").alias("health_order"),
    )


def asset_overview_from_summaries(
    readings: DataFrame,
    newest_readings: DataFrame,
    newest_verdicts: DataFrame,
    verdict_counts: DataFrame,
    period: Period = ALL_TIME,
) -> DataFrame:
    """`asset_overview` from the monthly summaries of `sources.summaries`.

    Of the readings it reads one month: that of the bound a week before the
    newest reading, whose newest row may lie after the bound. Newest rows of
    earlier months and of the present are in the summary.
    """
    candidates = readings_in(newest_readings, period)
    bound = _bound(candidates)
    columns = ("machine_id", "timestamp", *READING_VALUES)
    months = readings_in(readings, period).filter(
        (F.col("timestamp") <= bound) & (F.col("timestamp") >= F.date_trunc("month", bound))
    )
    if YEAR in readings.columns and MONTH in readings.columns:
        months = months.filter(
            (F.col(YEAR) == F.year(bound)) & (F.col(MONTH) == F.month(bound))
        )
    marked = (
        candidates.select(*columns)
        .unionAll(months.select(*columns))
        .withColumn("is_past", F.col("timestamp") <= bound)
    )
    counted = (
        months_in(verdict_counts, period)
        .groupBy("machine_id")
        .agg(
            *[
                F.sum(flag).alias(name)
                for flag, name in zip(VERDICT_FLAGS, FLAG_COUNTS, strict=True)
            ],
            nanos_to_timestamp(F.min("first_anomaly")).alias("first_anomaly_ts"),
            nanos_to_timestamp(F.max("last_anomaly")).alias("last_anomaly_ts"),
        )
    )
    judged = _newest_verdict(newest_verdicts, period, None).join(counted, "machine_id")
    return by_health(_overview(marked, judged)).drop("health_order")


def assets(readings: DataFrame, verdicts: DataFrame, period: Period = ALL_TIME) -> DataFrame:
    """`asset_overview` in no order, for whatever is derived from it."""
    return _assets(readings, verdicts, period).drop("health_order")


def asset_overview(
    readings: DataFrame, verdicts: DataFrame, period: Period = ALL_TIME
) -> DataFrame:
    """All machines, lowest health first: newest reading, change over a week,
    newest verdict and verdict counts.

    The week is counted back from the newest reading of the whole fleet within
    the period, and the earlier reading must lie in the period too; where there
    is none the trend is null. Each table is aggregated in one pass to one row
    per machine, and only those rows are joined.
    """
    return by_health(_assets(readings, verdicts, period)).drop("health_order")


def focus_machine(
    readings: DataFrame, verdicts: DataFrame, period: Period = ALL_TIME
) -> DataFrame:
    """The machine to look at first: of those anomalous now the one of lowest
    health, or without any the one of lowest health."""
    return (
        _assets(readings, verdicts, period)
        .orderBy(
            F.coalesce("is_anomaly", F.lit(False)).desc(),
            F.col("health_order").asc_nulls_last(),
            "machine_id",
        )
        .limit(1)
        .drop("health_order")
    )


def fleet_rows(readings: DataFrame, verdicts: DataFrame, period: Period) -> DataFrame:
    """`machine_overview` unsorted, with the health it is sorted by."""
    latest = latest_rows(
        readings_in(readings, period), ["machine_type", "health_pct", "health_status", *SENSORS]
    )
    judged = _newest_verdict(
        verdicts, period, None, F.count_if("is_anomaly").alias("anomaly_history_count")
    )
    return latest.join(judged, "machine_id", "left").select(
        "machine_id",
        "machine_type",
        measure("health_pct"),
        "health_status",
        *[measure(name) for name in SENSORS],
        *[F.coalesce(f"verdict.{flag}", F.lit(False)).alias(flag) for flag in VERDICT_FLAGS],
        F.coalesce("anomaly_history_count", F.lit(0)).alias("anomaly_history_count"),
        F.col("health_pct").alias("health_order"),
    )


def machine_overview(
    readings: DataFrame, verdicts: DataFrame, period: Period = ALL_TIME
) -> DataFrame:
    """Like `asset_overview` without the trend; missing flags count as false."""
    return by_health(fleet_rows(readings, verdicts, period)).drop("health_order")


def machine_snapshot(
    readings: DataFrame,
    verdicts: DataFrame,
    period: Period = ALL_TIME,
    machine_id: str | None = None,
) -> DataFrame:
    """Newest reading and newest verdict per machine."""
    latest = latest_rows(
        readings_in(of_machine(readings, machine_id), period),
        ["machine_type", *MEASURES, "health_status", "operational_time"],
    )
    return latest.join(
        _newest_verdict(verdicts, period, machine_id), "machine_id", "left"
    ).select(
        "machine_id",
        "machine_type",
        *[measure(name) for name in MEASURES],
        "health_status",
        "operational_time",
        measure("anomaly_score", "verdict.anomaly_score"),
        *[F.col(f"verdict.{flag}").alias(flag) for flag in VERDICT_FLAGS],
    )


def type_baselines(readings: DataFrame) -> DataFrame:
    """Mean and sample deviation of each sensor per machine type."""
    return readings.groupBy("machine_type").agg(
        *[F.avg(sensor).alias(f"avg_{sensor}") for sensor in SENSORS],
        *[F.stddev_samp(sensor).alias(f"std_{sensor}") for sensor in SENSORS],
    )


def asset_detail(
    readings: DataFrame,
    verdicts: DataFrame,
    period: Period = ALL_TIME,
    machine_id: str | None = None,
    baselines: DataFrame | None = None,
) -> DataFrame:
    """Newest reading and verdict per machine, each sensor's distance from its
    type's all-time mean in hundredths of a standard deviation, and remaining
    life.

    `baselines` are the means and deviations of `summaries.type_baselines`;
    without them they come from all readings of all time.
    """
    latest = latest_rows(
        readings_in(of_machine(readings, machine_id), period), READING_VALUES
    ).join(_newest_verdict(verdicts, period, machine_id), "machine_id", "left")
    if baselines is None:
        baselines = type_baselines(readings)

    def deviation(sensor: str) -> Column:
        distance = F.abs(F.col(sensor) - F.col(f"avg_{sensor}"))
        spread = F.nullif(F.col(f"std_{sensor}"), F.lit(0.0))
        return rounded(distance / spread * 100, 2).alias(f"{SHORT[sensor]}_deviation_pct")

    return latest.join(baselines, "machine_type", "left").select(
        "machine_id",
        "machine_type",
        "timestamp",
        *[measure(name) for name in MEASURES],
        "health_status",
        "operational_time",
        "is_running",
        measure("avg_deviation_pct"),
        *[deviation(sensor) for sensor in SENSORS],
        measure("anomaly_score", "verdict.anomaly_score"),
        *[F.col(f"verdict.{flag}").alias(flag) for flag in VERDICT_FLAGS],
        rul_days(F.col("health_pct")).alias("rul_days"),
    )


def rul_table(assets: DataFrame) -> DataFrame:
    """Remaining life per machine; `is_estimated` marks the value given for a
    missing health."""
    return assets.select(
        "machine_id",
        "health_pct",
        rul_days(F.col("health_pct")).alias("rul_days"),
        F.col("health_pct").isNull().alias("is_estimated"),
    )


def asset_trend(
    readings: DataFrame,
    verdicts: DataFrame,
    period: Period = ALL_TIME,
    machine_id: str | None = None,
) -> DataFrame:
    """Time series with verdict flags.

    A verdict belongs to the readings of its second, and only verdicts on a
    whole second can match; the others are dropped before the join.
    """
    series = readings_in(of_machine(readings, machine_id), period).select(
        "machine_id",
        "timestamp",
        *MEASURES,
        whole_second_nanos(F.col("timestamp")).alias("nanos"),
    )
    flags = (
        verdicts_in(of_machine(verdicts, machine_id), period)
        .filter(F.col("timestamp") % 1_000_000_000 == 0)
        .select("machine_id", F.col("timestamp").alias("nanos"), *VERDICT_FLAGS)
    )
    points = series.join(flags, ["machine_id", "nanos"], "left").select(
        "machine_id",
        "timestamp",
        *[rounded_rows(F.col(name), DIGITS[name]).alias(name) for name in MEASURES],
        *VERDICT_FLAGS,
    )
    return ordered(points, machine_id, F.col("timestamp").asc())


def trend_markers(trend: DataFrame) -> DataFrame:
    """The anomalous points of a time series."""
    return trend.filter("is_anomaly").select("machine_id", "timestamp", "health_pct")


def trend_labels(trend: DataFrame) -> DataFrame:
    """Axis label of each point."""
    return trend.select(
        "machine_id",
        "timestamp",
        F.date_format("timestamp", "dd MMM, HH:mm").alias("time_label"),
        "health_pct",
    )


def trend_points(trend: DataFrame) -> DataFrame:
    """Number of points per machine."""
    return trend.groupBy("machine_id").agg(F.count(F.lit(1)).alias("point_count"))


def assets_filtered(
    assets: DataFrame,
    machine_type: str | None = None,
    health_status: str | None = None,
    anomaly_only: bool = False,
) -> DataFrame:
    """The overview narrowed down; "All" and None restrict nothing."""
    if machine_type not in (None, "All"):
        assets = assets.filter(F.col("machine_type") == machine_type)
    if health_status not in (None, "All"):
        assets = assets.filter(F.col("health_status") == health_status)
    return assets.filter("is_anomaly") if anomaly_only else assets


def asset_states(assets: DataFrame) -> DataFrame:
    """Display state per machine with its label."""
    active = count_true(*[F.col(flag) for flag in SENSOR_FLAGS])
    state = asset_state(active, F.col("anomaly_history_count"))
    past = F.concat(F.col("anomaly_history_count").cast("string"), F.lit(" past"))
    return assets.select(
        "machine_id",
        active.alias("active_flags"),
        "anomaly_history_count",
        state.alias("state"),
        F.when(state == "past", past).otherwise(state).alias("state_label"),
    )


def trend_directions(assets: DataFrame) -> DataFrame:
    """Direction of the weekly change per machine."""
    return assets.select(
        "machine_id", "trend_pct", trend_direction(F.col("trend_pct")).alias("direction")
    )
