from __future__ import annotations

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from machinepulse.functions.periods import (
    ALL_TIME,
    Period,
    nanos_to_timestamp,
    period_label,
    readings_in,
    verdicts_in,
    whole_second_nanos,
)
from machinepulse.operators import fleet
from tests.rows import nanos, only, reading, readings, verdict, verdicts


def utc(*parts: int) -> datetime:
    return datetime(*parts, tzinfo=timezone.utc)


@pytest.mark.parametrize("month,year", [(13, None), (-1, 2024), (None, 10000), (None, -5)])
def test_impossible_periods_are_rejected(month, year):
    with pytest.raises(ValueError):
        Period(month, year)


def test_zero_means_no_restriction():
    assert Period(0, 0) == ALL_TIME


@pytest.mark.parametrize(
    "period,label",
    [
        (Period(6, 2024), "Jun 2024"),
        (Period(year=2024), "Year 2024"),
        (Period(), "All time"),
        (Period(month=6), "All time"),
    ],
)
def test_labels(spark, period, label):
    assert period.label == label
    row = spark.range(1).select(
        period_label(
            F.lit(period.month).cast("int"), F.lit(period.year).cast("int")
        ).alias("label")
    )
    assert only(row).label == label


EDGES = [
    utc(2023, 12, 31, 23, 59, 59, 999999),
    utc(2024, 1, 1),
    utc(2024, 6, 1),
    utc(2024, 6, 30, 23, 59, 59, 999999),
    utc(2024, 7, 1),
    utc(2024, 12, 31, 23, 59, 59, 999999),
    utc(2025, 1, 1),
    utc(2025, 6, 15),
]


@pytest.mark.parametrize(
    "period",
    [Period(), Period(6, 2024), Period(12, 2024), Period(year=2024), Period(month=6),
     Period(year=9999), Period(1, 1)],
)
def test_both_filters_select_what_the_calendar_says(spark, period):
    expected = sum(
        (period.year in (None, edge.year)) and (period.month in (None, edge.month))
        for edge in EDGES
    )
    r = readings(spark, *[reading(moment=edge) for edge in EDGES])
    v = verdicts(spark, *[verdict(moment=edge) for edge in EDGES])
    assert readings_in(r, period).count() == expected
    assert verdicts_in(v, period).count() == expected


def test_month_alone_takes_every_year(spark):
    r = readings(
        spark,
        reading(moment=utc(2024, 6, 1)),
        reading(moment=utc(2025, 6, 1)),
        reading(moment=utc(2025, 7, 1)),
    )
    assert only(fleet.kpi_reading_count(r, Period(month=6))).total_readings == 2


def test_nanoseconds_are_cut_to_microseconds_exactly(spark):
    value = 1_704_067_200_123_456_789
    row = spark.createDataFrame([(value,)], "ns bigint").select(
        F.unix_micros(nanos_to_timestamp(F.col("ns"))).alias("micros")
    )
    assert only(row).micros == 1_704_067_200_123_456


def test_whole_second(spark):
    moment = utc(2024, 6, 1, 12, 0, 0, 500_000)
    row = readings(spark, reading(moment=moment)).select(
        whole_second_nanos(F.col("timestamp")).alias("ns")
    )
    assert only(row).ns == nanos(utc(2024, 6, 1, 12))


def test_reading_periods_count_like_the_filters(spark):
    r = readings(spark, *[reading(moment=edge) for edge in EDGES])
    for row in fleet.reading_periods(r).collect():
        period = Period(row.month, row.year)
        assert row.label == period.label
        assert row.reading_count == only(fleet.kpi_reading_count(r, period)).total_readings
