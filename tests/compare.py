"""Order-insensitive comparison of a Spark result with its SQL twin."""

from __future__ import annotations

import datetime
import math

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _sorted(names: list[str], rows: list[tuple]) -> list[tuple]:
    places = [names.index(name) for name in sorted(names)]
    plain = [tuple(_plain(row[place]) for place in places) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is not None, str(v)) for v in row))


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), _sorted(df.columns, [tuple(row) for row in df.collect()])


def duck_rows(
    connection: duckdb.DuckDBPyConnection, sql: str
) -> tuple[list[str], list[tuple]]:
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    return sorted(names), _sorted(names, cursor.fetchall())
