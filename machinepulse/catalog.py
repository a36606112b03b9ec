"""Every query by name, over the test tables of a directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from machinepulse.functions.periods import ALL_TIME, Period
from machinepulse.functions.rules import health_band, priority
from machinepulse.operators import anomalies, asof, charts, fleet, guide, machines, sensors, turns
from machinepulse.plans import context, reports
from machinepulse.schemas import VERDICTS
from machinepulse.sources import quality, sqlapi, staging, summaries, testdata

Query = Callable[[SparkSession, str], DataFrame]

# The three forms of a period take different paths: a range over a year, a
# range over a month, and a month of every year.
PERIODS = {
    "": ALL_TIME,
    "_2024": Period(year=2024),
    "_m06": Period(month=6),
    "_2024_06": Period(month=6, year=2024),
}

SMALL_LIMIT = 5

# The form that shows one machine, for one that every scale factor has.
ONE_MACHINE = "M00001"


class Tables:
    """The input tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self._place = (spark, sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        return getattr(testdata, name)(*self._place)


Build = Callable[[Tables, Period], DataFrame]


def _overview(t: Tables, p: Period) -> DataFrame:
    return machines.asset_overview(t.readings, t.verdicts, p)


def _assets(t: Tables, p: Period) -> DataFrame:
    return machines.assets(t.readings, t.verdicts, p)


def _stats(t: Tables, p: Period) -> DataFrame:
    return anomalies.anomaly_stats(t.readings, t.verdicts, p)


def _summary(t: Tables, p: Period) -> DataFrame:
    return anomalies.anomaly_summary(t.readings, t.verdicts, p)


def _trend(t: Tables, p: Period) -> DataFrame:
    return machines.asset_trend(t.readings, t.verdicts, p)


def _report(t: Tables, p: Period) -> DataFrame:
    return reports.with_rules(reports.machine_report(t.readings, t.verdicts, p))


def _stored(build: Callable[[DataFrame], DataFrame], facts: DataFrame) -> str:
    """A summary written to the shared folder, as a job that answers many queries keeps it."""
    path = staging.new_path(facts.sparkSession, "summary")
    summaries.write(build(facts), path)
    return path


def _kpi_from_state(t: Tables, p: Period) -> DataFrame:
    path = _stored(summaries.newest_by_month, t.readings)
    return fleet.kpi_latest(summaries.read_newest(t.spark, path), p)


def _detail_from_summary(t: Tables, p: Period) -> DataFrame:
    path = _stored(summaries.moments_by_month, t.readings)
    baselines = summaries.type_baselines(summaries.read(t.spark, path))
    return machines.asset_detail(t.readings, t.verdicts, p, baselines=baselines)


def _overview_from_state(t: Tables, p: Period) -> DataFrame:
    newest, judged, counts = (
        _stored(summaries.newest_by_month, t.readings),
        _stored(summaries.newest_by_month, t.verdicts),
        _stored(summaries.counts_by_month, t.verdicts),
    )
    return machines.asset_overview_from_summaries(
        t.readings,
        summaries.read_newest(t.spark, newest),
        summaries.read_newest(t.spark, judged, VERDICTS),
        summaries.read(t.spark, counts),
        p,
    )


def _sql(t: Tables, function: str, p: Period) -> DataFrame:
    spark = sqlapi.register(t.readings, t.verdicts)
    return sqlapi.call(spark, function, month=p.month, year=p.year)


def _reading_checks(t: Tables, p: Period) -> DataFrame:
    """Figures observed while another query reads the readings."""
    readings, observed = quality.observed_readings(t.readings)
    fleet.readings_per_machine(readings).write.format("noop").mode("overwrite").save()
    figures = quality.require_keys(observed, "readings")
    counts = ("rows", "without_key", "status_conflicts", "without_health")
    return t.spark.createDataFrame(
        [tuple(figures[name] for name in counts)], ", ".join(f"{name} long" for name in counts)
    )


# Queries that take a period; registered once per period above.
BY_PERIOD: dict[str, Build] = {
    "kpi_latest": lambda t, p: fleet.kpi_latest(t.readings, p),
    "kpi_anomaly_count": lambda t, p: fleet.kpi_anomaly_count(t.verdicts, p),
    "kpi_reading_count": lambda t, p: fleet.kpi_reading_count(t.readings, p),
    "kpi_summary": lambda t, p: fleet.kpi_summary(t.readings, t.verdicts, p),
    "asset_overview": _overview,
    "asset_detail": lambda t, p: machines.asset_detail(t.readings, t.verdicts, p),
    "asset_trend": _trend,
    "anomaly_history": lambda t, p: anomalies.anomaly_history(t.readings, t.verdicts, p),
    "anomaly_events": lambda t, p: anomalies.anomaly_events(t.verdicts, p),
    "anomaly_summary": _summary,
    "anomaly_stats": _stats,
    "anomaly_recent": lambda t, p: anomalies.anomaly_recent(t.readings, t.verdicts, p),
    "anomaly_latest_reading": lambda t, p: anomalies.anomaly_latest_reading(
        t.readings, t.verdicts, p
    ),
    "machine_overview": lambda t, p: machines.machine_overview(t.readings, t.verdicts, p),
    "machine_snapshot": lambda t, p: machines.machine_snapshot(t.readings, t.verdicts, p),
    "machine_anomaly_history": lambda t, p: anomalies.machine_anomaly_history(
        t.readings, t.verdicts, p
    ),
    "task_mode": lambda t, p: _report(t, p).select(
        "machine_id", "is_anomaly", "health_pct", "anomaly_history_count", "task_mode"
    ),
    "report_format": lambda t, p: _report(t, p).select(
        "machine_id", "task_mode", "sensors_out_of_range", "report_format"
    ),
    "anomaly_history_reduced": lambda t, p: anomalies.anomaly_history(
        t.readings, t.verdicts, p, reduced=True
    ),
    "trend_asof": lambda t, p: asof.trend_asof(t.readings, t.verdicts, p),
    "asset_trend_sql": lambda t, p: _sql(t, "asset_trend", p),
    "anomaly_events_sql": lambda t, p: _sql(t, "anomaly_events", p),
    "kpi_latest_from_state": _kpi_from_state,
    "asset_overview_from_state": _overview_from_state,
    "asset_detail_from_summary": _detail_from_summary,
    "fleet_context": lambda t, p: context.fleet_context(t.readings, t.verdicts, p),
    "machine_context": lambda t, p: context.machine_context(t.readings, t.verdicts, p),
}

# Queries registered over all time only.
ALL_TIME_ONLY: dict[str, Build] = {
    "readings_per_machine": lambda t, p: fleet.readings_per_machine(t.readings),
    "asset_detail_one": lambda t, p: machines.asset_detail(
        t.readings, t.verdicts, p, machine_id=ONE_MACHINE
    ),
    "asset_trend_one": lambda t, p: machines.asset_trend(
        t.readings, t.verdicts, p, machine_id=ONE_MACHINE
    ),
    "anomaly_history_one": lambda t, p: anomalies.anomaly_history(
        t.readings, t.verdicts, p, machine_id=ONE_MACHINE
    ),
    "anomaly_history_top5": lambda t, p: anomalies.anomaly_history(
        t.readings, t.verdicts, p, limit=SMALL_LIMIT
    ),
    "anomaly_events_top5": lambda t, p: anomalies.anomaly_events(
        t.verdicts, p, limit=SMALL_LIMIT
    ),
    "anomaly_recent_top5": lambda t, p: anomalies.anomaly_recent(
        t.readings, t.verdicts, p, limit=SMALL_LIMIT
    ),
    "assets_filtered": lambda t, p: machines.assets_filtered(
        _overview(t, p), machine_type="furnace", health_status="WARNING"
    ),
    "assets_anomalous": lambda t, p: machines.assets_filtered(
        _overview(t, p), machine_type="All", anomaly_only=True
    ),
    "kpi_filtered": lambda t, p: fleet.kpi_filtered(
        machines.assets_filtered(_assets(t, p), machine_type="furnace")
    ),
    "kpi_filtered_all": lambda t, p: fleet.kpi_filtered(_assets(t, p)),
    "focus_machine": lambda t, p: machines.focus_machine(t.readings, t.verdicts, p),
    "active_sensor_flags": lambda t, p: machines.asset_states(_assets(t, p)).select(
        "machine_id", "active_flags"
    ),
    "asset_state": lambda t, p: machines.asset_states(_assets(t, p)),
    "sensor_range_check": lambda t, p: sensors.sensor_range_check(_assets(t, p)),
    "sensor_explanation": lambda t, p: sensors.sensor_explanation(_assets(t, p)),
    "health_band": lambda t, p: _assets(t, p).select(
        "machine_id", "health_pct", health_band(F.col("health_pct")).alias("band")
    ),
    "status_from_health": lambda t, p: quality.status_conflicts(t.readings),
    "reading_checks": _reading_checks,
    "sensor_baselines_sql": lambda t, p: _sql(t, "sensor_baselines", p),
    "trend_direction": lambda t, p: machines.trend_directions(_assets(t, p)),
    "history_by_month": lambda t, p: anomalies.history_by_month(
        anomalies.anomaly_history(t.readings, t.verdicts, p, limit=None)
    ),
    "trend_markers": lambda t, p: machines.trend_markers(_trend(t, p)),
    "trend_labels": lambda t, p: machines.trend_labels(_trend(t, p)),
    "trend_points": lambda t, p: machines.trend_points(_trend(t, p)),
    "anomaly_severity": lambda t, p: anomalies.anomaly_severity(_summary(t, p)),
    "anomaly_total": lambda t, p: anomalies.anomaly_total(_summary(t, p)),
    "anomaly_type_share": lambda t, p: anomalies.anomaly_type_share(_stats(t, p)),
    "anomaly_vs_normal": lambda t, p: anomalies.anomaly_vs_normal(_stats(t, p)),
    "event_labels": lambda t, p: anomalies.event_labels(
        anomalies.anomaly_recent(t.readings, t.verdicts, p, limit=None)
    ),
    "guide_pages": lambda t, p: t.guide_pages,
    "guide_for_type": lambda t, p: guide.guide_for_type(t.guide_pages),
    "guide_all": lambda t, p: guide.guide_all(t.guide_pages),
    "guide_page_list": lambda t, p: guide.guide_page_list(t.readings).select(
        "machine_type",
        F.array_join("own_pages", ",").alias("own_pages"),
        F.array_join("pages", ",").alias("pages"),
    ),
    "guide_page_profile": lambda t, p: guide.guide_page_profile(t.guide_pages),
    "guide_size": lambda t, p: guide.guide_size(t.guide_pages),
    "period_label": lambda t, p: fleet.reading_periods(t.readings),
    "priority": lambda t, p: _assets(t, p).select(
        "machine_id",
        "health_pct",
        "is_anomaly",
        priority(F.col("health_pct"), F.col("is_anomaly")).alias("priority"),
    ),
    "rul_days": lambda t, p: machines.rul_table(_assets(t, p)),
    "recommendation_context": lambda t, p: context.recommendation_context(
        t.readings, t.verdicts, t.guide_pages, t.machine_guides, p
    ),
    "prompt_context": lambda t, p: context.prompt_context(
        t.readings,
        t.verdicts,
        t.guide_pages,
        t.messages,
        t.conversation_machines,
        t.machine_guides,
        p,
    ),
    "recent_turns": lambda t, p: turns.recent_turns(t.messages),
    "recommendation_snapshot": lambda t, p: reports.recommendation_snapshot(
        reports.machine_report(t.readings, t.verdicts, p)
    ).select("machine_id", "record"),
    "chart_blocks": lambda t, p: charts.chart_blocks(t.chart_messages).select(
        "message_id",
        "block_no",
        "lang",
        "chart_type",
        "title",
        "x_key",
        "y_key",
        F.size("data").cast("bigint").alias("point_count"),
    ),
    "chart_points": lambda t, p: charts.chart_points(charts.chart_blocks(t.chart_messages)),
}


def _query(build: Build, period: Period) -> Query:
    return lambda spark, sf_dir: build(Tables(spark, sf_dir), period)


def queries() -> dict[str, Query]:
    """All queries by key."""
    found = {
        f"{name}{suffix}": _query(build, period)
        for name, build in BY_PERIOD.items()
        for suffix, period in PERIODS.items()
    }
    found.update({name: _query(build, ALL_TIME) for name, build in ALL_TIME_ONLY.items()})
    return found
