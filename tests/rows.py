"""Literal rows for small fixtures."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession

from machinepulse.schemas import GUIDE_PAGES, MESSAGES, READINGS, VERDICTS

NOON = datetime(2024, 6, 15, 12, tzinfo=timezone.utc)


def at(days: float = 0, seconds: float = 0) -> datetime:
    return NOON + timedelta(days=days, seconds=seconds)


def nanos(moment: datetime, extra: int = 0) -> int:
    delta = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    micros = (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds
    return micros * 1000 + extra


def reading(machine: str = "M1", moment: datetime = NOON, **values) -> tuple:
    row = {
        "machine_id": machine,
        "machine_type": "motor",
        "timestamp": moment,
        "temperature": 50.0,
        "vibration": 1.0,
        "pressure": 5.0,
        "health_pct": 90.0,
        "health_status": "HEALTHY",
        "operational_time": 100,
        "is_running": True,
        "avg_deviation_pct": 1.0,
        **values,
    }
    return tuple(row[name] for name in READINGS.names)


def verdict(machine: str = "M1", moment: datetime | int = NOON, **values) -> tuple:
    row = {
        "machine_id": machine,
        "timestamp": moment if isinstance(moment, int) else nanos(moment),
        "anomaly_score": 0.5,
        "is_anomaly": True,
        "is_temperature_anomaly": False,
        "is_vibration_anomaly": False,
        "is_pressure_anomaly": False,
        **values,
    }
    return tuple(row[name] for name in VERDICTS.names)


def readings(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), READINGS)


def verdicts(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), VERDICTS)


def pages(spark: SparkSession, contents: dict[int, str | None], guide: int = 1) -> DataFrame:
    rows = [
        (guide, position, page, content)
        for position, (page, content) in enumerate(contents.items(), start=1)
    ]
    return spark.createDataFrame(rows, GUIDE_PAGES)


def messages(spark: SparkSession, *turns: tuple[int, int, str, str]) -> DataFrame:
    return spark.createDataFrame(list(turns), MESSAGES)


def only(df: DataFrame):
    """The one row of a result."""
    found = df.collect()
    assert len(found) == 1, found
    return found[0]


def by(df: DataFrame, *keys: str) -> dict:
    """Rows by key; a key that repeats is an error."""
    found = {}
    for row in df.collect():
        key = tuple(row[name] for name in keys)
        key = key[0] if len(keys) == 1 else key
        assert key not in found, key
        found[key] = row
    return found
