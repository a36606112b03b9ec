"""Sensor values against the normal ranges, one row per machine and sensor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from machinepulse.functions.ranges import (
    UNITS,
    explanation,
    range_deviation,
    range_max,
    range_min,
    range_position,
)
from machinepulse.schemas import SENSORS


def _unpivoted(assets: DataFrame, *fields) -> DataFrame:
    """One row per asset and sensor; `fields` make columns from a sensor name."""
    rows = F.array(
        *[
            F.struct(F.lit(sensor).alias("sensor"), *[make(sensor) for make in fields])
            for sensor in SENSORS
        ]
    )
    return assets.select("machine_id", "machine_type", F.inline(rows))


def _bounds(sensor: str) -> tuple[Column, Column, Column]:
    kind = F.col("machine_type")
    return F.col(sensor), range_min(kind, sensor), range_max(kind, sensor)


def _value(sensor: str) -> Column:
    return F.col(sensor).alias("value")


def _low(sensor: str) -> Column:
    return _bounds(sensor)[1].alias("range_min")


def _high(sensor: str) -> Column:
    return _bounds(sensor)[2].alias("range_max")


def _unit(sensor: str) -> Column:
    return F.lit(UNITS[sensor]).alias("unit")


def _flagged(sensor: str) -> Column:
    return F.col(f"is_{sensor}_anomaly").alias("is_flagged")


def _explanation(sensor: str) -> Column:
    value, low, high = _bounds(sensor)
    return explanation(sensor, F.col("machine_type"), value, low, high).alias("explanation")


def sensor_range_check(assets: DataFrame) -> DataFrame:
    """Place of each sensor value in the normal range of its machine type, and
    percent beyond the crossed bound."""
    value, low, high = F.col("value"), F.col("range_min"), F.col("range_max")
    return _unpivoted(assets, _value, _low, _high, _unit, _flagged).select(
        "*",
        range_position(value, low, high).alias("range_state"),
        range_deviation(value, low, high).alias("deviation_pct"),
    )


def sensor_explanation(assets: DataFrame) -> DataFrame:
    """A sentence for each sensor flagged by the newest verdict."""
    return (
        _unpivoted(assets, _value, _flagged, _explanation)
        .filter("is_flagged")
        .drop("is_flagged")
    )
