"""The given test tables as readings, verdicts, guide pages and messages.

`events` stands for both fact tables: a user is a machine and an event is a
reading. Time is stretched 24-fold from 2024-01-01 and cut to whole seconds.
Every tenth event has no verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from machinepulse.schemas import GUIDE_PAGES, MESSAGES, READINGS, VERDICTS, conform
from machinepulse.session import use_utc

# Columns as stored; stating them spares the reader a look into the files.
_EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, "
    "event_type string, value double, props string"
)
_DOCUMENTS = "doc_id bigint, text string"
_CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"

_START = 1_704_067_200
_PAGES_PER_GUIDE = 22
_MACHINES_PER_GUIDE = 3


def _machine_id(number: Column) -> Column:
    """At least five digits; lpad alone would cut longer numbers and merge machines."""
    digits = number.cast("string")
    width = F.greatest(F.lit(5), F.length(digits))
    return F.concat(F.lit("M"), F.lpad(digits, width, F.lit("0")))


def _read(spark: SparkSession, sf_dir: str, table: str, schema: str) -> DataFrame:
    return use_utc(spark).read.schema(schema).parquet(f"{sf_dir}/{table}.parquet")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events", _EVENTS)
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(_START * 1_000_000)
    return events.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.lit(_START) + F.call_function("div", micros * 24, F.lit(1_000_000))).alias("ts_s"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, value, k = F.col("user_id"), F.col("value"), F.col("k")
    health = F.lit(100.0) - value * 0.8
    table = _base(spark, sf_dir).select(
        _machine_id(user).alias("machine_id"),
        F.when(user % 4 == 0, "furnace")
        .when(user % 4 == 1, "conveyor")
        .when(user % 4 == 2, "motor")
        .otherwise("slurry_pump")
        .alias("machine_type"),
        F.timestamp_seconds("ts_s").alias("timestamp"),
        F.when(user % 4 == 0, F.lit(1100.0) + k * 2.0)
        .otherwise(F.lit(30.0) + k * 0.6)
        .alias("temperature"),
        (value * 0.02).alias("vibration"),
        # Some sensors fail to report.
        F.when(F.col("event_id") % 11 != 5, F.lit(4.0) + (k % 25) * 0.1).alias("pressure"),
        F.greatest(F.lit(0.0), health).alias("health_pct"),
        F.when(health >= 80, "HEALTHY")
        .when(health >= 55, "WARNING")
        .when(health >= 30, "BORDERLINE")
        .otherwise("CRITICAL")
        .alias("health_status"),
        F.col("event_id").alias("operational_time"),
        (F.col("event_type") != "error").alias("is_running"),
        (F.abs(value - 50.0) / 50.0 * 100.0).alias("avg_deviation_pct"),
    )
    return conform(table, READINGS, "readings")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, value, k = F.col("user_id"), F.col("value"), F.col("k")
    eligible = user % 3 != 2
    table = (
        _base(spark, sf_dir)
        .filter(F.col("event_id") % 10 != 9)
        .select(
            _machine_id(user).alias("machine_id"),
            # Some verdicts come within the microsecond of their reading but not
            # on the whole second, so histories match them and time series do not.
            (
                F.col("ts_s") * 1_000_000_000
                + F.when(F.col("event_id") % 7 == 3, F.lit(300)).otherwise(0)
            ).alias("timestamp"),
            (value / (value + 100.0)).alias("anomaly_score"),
            ((value > 100.0) & eligible).alias("is_anomaly"),
            ((value > 100.0) & eligible & (k % 3 == 0)).alias("is_temperature_anomaly"),
            ((value > 150.0) & eligible).alias("is_vibration_anomaly"),
            ((value > 100.0) & eligible & (k % 5 == 0)).alias("is_pressure_anomaly"),
        )
    )
    return conform(table, VERDICTS, "verdicts")


def guide_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the pages of guides of 22 pages each."""
    page = (F.col("doc_id") % _PAGES_PER_GUIDE + 1).cast("int")
    table = _read(spark, sf_dir, "documents", _DOCUMENTS).select(
        F.call_function("div", F.col("doc_id"), F.lit(_PAGES_PER_GUIDE)).alias("guide_id"),
        page.alias("position"),
        page.alias("page"),
        F.col("text").alias("content"),
    )
    return conform(table, GUIDE_PAGES, "guide_pages")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(
        _read(spark, sf_dir, "conversations", _CONVERSATIONS), MESSAGES, "messages"
    )


def machine_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which guide applies to which machine: three machines share one."""
    users = _read(spark, sf_dir, "events", _EVENTS).select("user_id").distinct()
    return users.select(
        _machine_id(F.col("user_id")).alias("machine_id"),
        F.call_function("div", F.col("user_id"), F.lit(_MACHINES_PER_GUIDE)).alias("guide_id"),
    )


def conversation_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which machine a conversation is about: the one of the same number."""
    conversations = (
        _read(spark, sf_dir, "conversations", _CONVERSATIONS).select("conv_id").distinct()
    )
    return conversations.select("conv_id", _machine_id(F.col("conv_id")).alias("machine_id"))


def chart_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with fenced blocks: charts, broken JSON, other languages, a quote."""
    events = _read(spark, sf_dir, "events", _EVENTS)
    number = F.col("event_id")
    language = (
        F.when(number % 4 == 1, "json").when(number % 4 == 2, "sql").otherwise("chart")
    )
    body = (
        F.when(number % 4 == 3, "{broken")
        .when(number % 8 == 1, '{"type":"bar","data":[{"name":"a","v":1}]}')
        .when(
            number % 8 == 4,
            F.concat(
                F.lit('{"type":"pie","data":[{"name":"a","v":'),
                F.col("user_id").cast("string"),
                F.lit('},{"name":"b","v":3}],"colors":["#111111"],"xKey":"name","yKey":"v"}'),
            ),
        )
        .otherwise(
            F.concat(
                F.lit('{"type":"bar","data":[{"name":"'),
                F.col("event_type"),
                F.lit('","v":'),
                F.col("user_id").cast("string"),
                F.lit('}],"xKey":"name","yKey":"v"}'),
            )
        )
    )
    return events.select(
        number.alias("message_id"),
        F.concat(
            F.lit("Report\n```"),
            language,
            F.lit("\n"),
            body,
            F.lit("\n```\nend"),
            # A second block, quoted and fenced with tildes.
            F.when(
                number % 8 == 0,
                F.lit(
                    '\n> ~~~json\n> {"type":"line","type":"area","data":[],'
                    '"xKey":"t","yKey":"v"}\n> ~~~'
                ),
            ).otherwise(""),
        ).alias("text"),
    )
