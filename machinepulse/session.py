"""Session settings the package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Calendar functions (month, date_format) follow the session zone, and all
# timestamps of the package are UTC.
# A JSON object that repeats a key is read as its last value.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Adaptive execution picks broadcast joins from measured sizes, splits skewed
# join partitions and merges small ones; nothing in the package forces a
# broadcast of data that grows.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def use_utc(spark: SparkSession) -> SparkSession:
    """Set what results depend on; safe to call on a session made elsewhere."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", **extra: str) -> SparkSession:
    """A session for tests and the bench. On a cluster the job brings its own."""
    settings = {
        **REQUIRED,
        **ADAPTIVE,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        **extra,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("machinepulse")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return use_utc(spark)
