"""Small tables with nulls, and with extra columns whose names the operators use inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CLASHING = (
    "id sha part head body leads kept digest version words place n print node gram component "
    "score secrets ids decoded language same first copy address host rule"
).split()


def documents(spark: SparkSession, rows: list[tuple], clash: bool = True) -> DataFrame:
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return table.withColumns({name: F.lit(name) for name in CLASHING}) if clash else table


def texts(spark: SparkSession, *pairs: tuple) -> DataFrame:
    return documents(spark, [(i, t, "en", "s") for i, t in pairs])


def pages(spark: SparkSession, *rows: tuple) -> DataFrame:
    table = spark.createDataFrame(list(rows), "page_id long, url string, html string")
    return table.withColumns({name: F.lit(name) for name in CLASHING if name not in ("text",)})


def found(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted(
        (tuple(row) for row in df.select(*columns).collect()),
        key=lambda row: tuple((v is not None, str(v)) for v in row),
    )
