"""Queries with parameters in SQL: temporary table functions over the two facts.

    sqlapi.register(readings, verdicts)
    spark.sql("SELECT * FROM asset_trend('M00042', 6, 2024)")
    spark.sql("SELECT * FROM anomaly_events(:m, :month, :year)", args={...})

Each function takes a machine, a month and a year; null restricts nothing. They
are views with arguments, so Spark sees through them: a call with literals is
planned like the text with the literals in it, and its conditions reach the
files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from machinepulse.operators.anomalies import EVENT_LIMIT
from machinepulse.operators.machines import DIGITS, MEASURES
from machinepulse.schemas import SENSORS, VERDICT_FLAGS
from machinepulse.session import use_utc
from machinepulse.sources.facts import register_views

_ARGUMENTS = "machine STRING DEFAULT NULL, month INT DEFAULT NULL, year INT DEFAULT NULL"
_FLAGS = ", ".join(f"{flag} BOOLEAN" for flag in VERDICT_FLAGS)
_NANOS = 1_000_000_000


def _in_period(time: str, micros: str, scale: int) -> str:
    """The conditions on a column: a range if a year is given, else the month of any year.

    micros turns the column into a timestamp, scale microseconds into its unit.
    """
    start = "make_timestamp({}, coalesce({}, 1), 1, 0, 0, 0)"
    first = start.format("year", "month")
    after = f"{first} + CASE WHEN month IS NULL THEN INTERVAL 1 YEAR ELSE INTERVAL 1 MONTH END"
    low, high = (f"unix_micros({t}) * {scale}" if scale else t for t in (first, after))
    return (
        f"(year IS NULL OR ({time} >= {low} AND {time} < {high})) "
        f"AND (month IS NULL OR year IS NOT NULL OR month({micros}) = month)"
    )


def _rounded(column: str, digits: int) -> str:
    """Half up through a decimal; what fits none is rounded as it is."""
    exact = f"CAST(round(try_cast({column} AS DECIMAL(28,9)), {digits}) AS DOUBLE)"
    return f"coalesce({exact}, round({column}, {digits}))"


def _shown(alias: str) -> str:
    return ", ".join(f"{_rounded(f'{alias}.{name}', DIGITS[name])} AS {name}" for name in MEASURES)


def _statements() -> list[str]:
    of_reading = _in_period("r.timestamp", "r.timestamp", 0)
    of_verdict = _in_period("a.timestamp", "timestamp_micros(a.timestamp div 1000)", 1000)
    own = "(machine IS NULL OR {}.machine_id = machine)".format
    measures = ", ".join(f"{name} DOUBLE" for name in MEASURES)
    flags = ", ".join(VERDICT_FLAGS)
    order = ", ".join(f"a.{name} DESC NULLS LAST" for name in ("timestamp", "anomaly_score", *VERDICT_FLAGS))
    return [
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION asset_trend({_ARGUMENTS})
        RETURNS TABLE(machine_id STRING, timestamp TIMESTAMP, {measures}, {_FLAGS})
        RETURN SELECT r.machine_id, r.timestamp, {_shown('r')},
                      {', '.join(f'v.{flag}' for flag in VERDICT_FLAGS)}
        FROM (SELECT * FROM readings r WHERE {own('r')} AND {of_reading}) r
        LEFT JOIN (SELECT * FROM anomalies a
                   WHERE {own('a')} AND {of_verdict} AND a.timestamp % {_NANOS} = 0) v
          ON v.machine_id = r.machine_id AND v.timestamp = unix_seconds(r.timestamp) * {_NANOS}""",
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION anomaly_events({_ARGUMENTS})
        RETURNS TABLE(machine_id STRING, timestamp BIGINT, anomaly_score DOUBLE, {_FLAGS})
        RETURN SELECT machine_id, timestamp, {_rounded('anomaly_score', DIGITS['anomaly_score'])}, {flags}
        FROM (SELECT a.*, row_number() OVER (PARTITION BY a.machine_id ORDER BY {order}) AS place
              FROM anomalies a WHERE a.is_anomaly AND {own('a')} AND {of_verdict})
        WHERE place <= {EVENT_LIMIT}""",
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION sensor_baselines({_ARGUMENTS})
        RETURNS TABLE(machine_type STRING, reading_count BIGINT,
                      {', '.join(f'avg_{s} DOUBLE, std_{s} DOUBLE' for s in SENSORS)})
        RETURN SELECT r.machine_type, count(*),
                      {', '.join(f'{_rounded(f"avg(r.{s})", 4)}, {_rounded(f"stddev_samp(r.{s})", 4)}' for s in SENSORS)}
        FROM readings r WHERE {own('r')} AND {of_reading} GROUP BY r.machine_type""",
    ]


def register(readings: DataFrame, verdicts: DataFrame) -> SparkSession:
    """Make the views `readings` and `anomalies` and the functions over them, in this session."""
    spark = use_utc(readings.sparkSession)
    register_views(readings, verdicts)
    for statement in _statements():
        spark.sql(statement)
    return spark


def call(
    spark: SparkSession,
    function: str,
    machine: str | None = None,
    month: int | None = None,
    year: int | None = None,
) -> DataFrame:
    """A function with its arguments bound as parameters."""
    arguments = {"machine": machine, "month": month, "year": year}
    return spark.sql(
        f"SELECT * FROM {function}(:machine, CAST(:month AS INT), CAST(:year AS INT))",
        args=arguments,
    )
