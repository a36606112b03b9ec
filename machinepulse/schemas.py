"""Declared schemas of the input tables, and the check against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

READINGS = T.StructType(
    [
        T.StructField("machine_id", T.StringType(), False),
        T.StructField("machine_type", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("vibration", T.DoubleType()),
        T.StructField("pressure", T.DoubleType()),
        T.StructField("health_pct", T.DoubleType()),
        T.StructField("health_status", T.StringType()),
        T.StructField("operational_time", T.LongType()),
        T.StructField("is_running", T.BooleanType()),
        T.StructField("avg_deviation_pct", T.DoubleType()),
    ]
)

# `timestamp` is epoch nanoseconds.
VERDICTS = T.StructType(
    [
        T.StructField("machine_id", T.StringType(), False),
        T.StructField("timestamp", T.LongType(), False),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("is_anomaly", T.BooleanType()),
        T.StructField("is_temperature_anomaly", T.BooleanType()),
        T.StructField("is_vibration_anomaly", T.BooleanType()),
        T.StructField("is_pressure_anomaly", T.BooleanType()),
    ]
)

# `position` is the place of the page in its document.
GUIDE_PAGES = T.StructType(
    [
        T.StructField("guide_id", T.LongType(), False),
        T.StructField("position", T.IntegerType(), False),
        T.StructField("page", T.IntegerType(), False),
        T.StructField("content", T.StringType()),
    ]
)

MESSAGES = T.StructType(
    [
        T.StructField("conv_id", T.LongType(), False),
        T.StructField("turn", T.LongType(), False),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

# What the writers add to stored tables. Sources do not use these names, so a
# source's own `year` or `event_time` is never taken for them.
YEAR, MONTH = "machinepulse_year", "machinepulse_month"
EVENT_TIME = "machinepulse_event_time"
LAYOUT = (YEAR, MONTH, EVENT_TIME)

SENSORS = ("temperature", "vibration", "pressure")
SENSOR_FLAGS = tuple(f"is_{sensor}_anomaly" for sensor in SENSORS)
VERDICT_FLAGS = ("is_anomaly", *SENSOR_FLAGS)


class SchemaError(ValueError):
    """An input table does not have the declared columns."""


def conform(df: DataFrame, schema: T.StructType, table: str) -> DataFrame:
    """The declared columns, in order, plus the layout columns of stored tables.

    Any other column is dropped, so that it cannot clash with computed ones.
    Zone-less timestamps are taken as UTC; any other type difference and any
    missing column raise before a job starts.
    """
    found = {field.name: field.dataType for field in df.schema.fields}
    missing = [name for name in schema.names if name not in found]
    if missing:
        raise SchemaError(f"{table}: missing column(s) {', '.join(missing)}")
    columns = []
    for field in schema.fields:
        actual = found[field.name]
        column = F.col(field.name)
        if actual != field.dataType:
            if isinstance(field.dataType, T.TimestampType) and isinstance(
                actual, T.TimestampNTZType
            ):
                column = column.cast("timestamp").alias(field.name)
            else:
                raise SchemaError(
                    f"{table}.{field.name}: expected {field.dataType.simpleString()}, "
                    f"found {actual.simpleString()}"
                )
        columns.append(column)
    extra = [F.col(name) for name in df.columns if name in LAYOUT]
    return df.select(*columns, *extra)
