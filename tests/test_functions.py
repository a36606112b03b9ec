from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from machinepulse.functions import rules
from machinepulse.functions.numbers import number_text, rounded, rounded_rows, whole_half_up
from machinepulse.functions.ranges import (
    out_of_range_count,
    range_deviation,
    range_max,
    range_min,
    range_position,
)
from tests.rows import only

HEALTHS = [None, 0.0, 29.9, 30.0, 54.9, 55.0, 79.9, 79.96, 80.0, 100.0]


def mapped(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    rows = df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()
    return [row.y for row in rows]


def test_bands(spark):
    assert mapped(spark, HEALTHS, "double", rules.status_from_health) == [
        None, "CRITICAL", "CRITICAL", "BORDERLINE", "BORDERLINE", "WARNING", "WARNING",
        "WARNING", "HEALTHY", "HEALTHY",
    ]
    assert mapped(spark, HEALTHS, "double", rules.health_band) == [
        "poor", "poor", "poor", "poor", "poor", "fair", "fair", "fair", "good", "good",
    ]
    assert mapped(spark, HEALTHS, "double", rules.rul_days) == [
        90, 3, 3, 7, 7, 30, 30, 30, 90, 90,
    ]


def test_priority(spark):
    def anomalous(x):
        return rules.priority(x, F.lit(True))

    def calm(x):
        return rules.priority(x, F.lit(None).cast("boolean"))

    assert mapped(spark, HEALTHS[1:], "double", anomalous) == [
        "Urgent", "Urgent", "High", "High", "Medium", "Medium", "Medium", "Low", "Low",
    ]
    assert mapped(spark, HEALTHS, "double", calm)[:3] == [None, "High", "High"]


@pytest.mark.parametrize(
    "anomaly,health,past,outside,mode,report",
    [
        (True, 95.0, 0, 0, "A", "A"),
        (False, 79.9, 0, 0, "B", "B"),
        (None, 80.0, 1, 0, "B", "B"),
        (False, 80.0, 0, 0, "C", "C"),
        (False, 80.0, 0, 1, "C", "B"),
        (False, None, 0, 0, "B", "B"),
        (False, 80.0, None, 0, "C", "C"),
    ],
)
def test_task_mode_and_report_format(spark, anomaly, health, past, outside, mode, report):
    df = spark.createDataFrame(
        [(anomaly, health, past, outside)], "a boolean, h double, p bigint, o int"
    )
    row = only(
        df.select(
            rules.task_mode(F.col("a"), F.col("h"), F.col("p")).alias("mode"),
            rules.report_format(F.col("a"), F.col("h"), F.col("p"), F.col("o")).alias("report"),
        )
    )
    assert (row.mode, row.report) == (mode, report)


def test_trend_direction_and_severity(spark):
    assert mapped(spark, [-0.6, -0.5, None, 0.5, 0.6], "double", rules.trend_direction) == [
        "down", "flat", "flat", "flat", "up",
    ]
    assert mapped(spark, [0.0, 0.33, 0.65, 0.66, 1.0], "double", rules.severity) == [
        "low", "medium", "medium", "high", "high",
    ]


def test_rounding_breaks_ties_upwards(spark):
    values = [0.125, 1.005, 2.675, -0.125, 1175.125 - 2e-13]
    assert mapped(spark, values, "double", lambda x: rounded(x, 2)) == [
        0.13, 1.01, 2.68, -0.13, 1175.13,
    ]


def test_rounding_survives_values_beyond_the_decimal(spark):
    found = mapped(
        spark, [1e30, float("inf"), float("nan"), None], "double", lambda x: rounded(x, 1)
    )
    assert found[0] == 1e30 and found[1] == float("inf") and found[2] != found[2]
    assert found[3] is None


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.data())
def test_rounding_of_many_rows_is_the_same(spark, data):
    ties = st.integers(-10**7, 10**7).map(lambda i: (2 * i + 1) / 2000)
    values = data.draw(
        st.lists(st.one_of(st.floats(-1e12, 1e12), st.floats(-2, 2), ties, st.none()),
                 min_size=20, max_size=60)
    )
    for digits in (1, 2, 4):
        exact = mapped(spark, values, "double", lambda x: rounded(x, digits))
        quick = mapped(spark, values, "double", lambda x: rounded_rows(x, digits))
        assert [repr(x) for x in quick] == [repr(x) for x in exact]


def test_rounding_of_many_rows_handles_odd_values(spark):
    values = [-0.0, -0.001, float("inf"), float("nan"), 1e300, 0.125, -0.125]
    exact = mapped(spark, values, "double", lambda x: rounded(x, 2))
    quick = mapped(spark, values, "double", lambda x: rounded_rows(x, 2))
    assert [repr(x) for x in quick] == [repr(x) for x in exact]


def test_whole_half_up(spark):
    assert mapped(spark, [0.4, 0.5, 1.5, 2.5, None], "double", whole_half_up) == [
        0, 1, 2, 3, None,
    ]


@settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.decimals(-10**6, 10**6, places=4, allow_nan=False, allow_infinity=False),
        min_size=1, max_size=30,
    )
)
def test_number_text_reads_back(spark, values):
    texts = mapped(spark, [float(v) for v in values], "double", number_text)
    for text, value in zip(texts, values):
        expected = Decimal(repr(float(value))).quantize(Decimal("0.0001"), ROUND_HALF_UP)
        assert Decimal(text) == expected
        assert "E" not in text and not (("." in text) and text.endswith("0"))


def test_number_text(spark):
    assert mapped(spark, [60.0, 61.4, 0.0125, 100.0, 0.0, None], "double", number_text) == [
        "60", "61.4", "0.0125", "100", "0", "n/a",
    ]


@pytest.mark.parametrize(
    "kind,sensor,value,state,deviation",
    [
        ("slurry_pump", "pressure", 4.5, "within", 0.0),
        ("slurry_pump", "pressure", 5.5, "within", 0.0),
        ("slurry_pump", "pressure", 4.4, "below", 2.2),
        ("slurry_pump", "pressure", 5.6, "above", 1.8),
        ("SLURRY_PUMP", "pressure", 6.6, "above", 20.0),
        ("motor", "temperature", -1.0, "below", None),
        ("motor", "pressure", 5.0, "no spec", None),
        ("furnace", "temperature", 1149.0, "below", 0.1),
        ("crusher", "temperature", 5.0, "no spec", None),
        ("motor", "temperature", None, None, None),
    ],
)
def test_ranges(spark, kind, sensor, value, state, deviation):
    df = spark.createDataFrame([(kind, value)], "kind string, x double")
    low, high = range_min(F.col("kind"), sensor), range_max(F.col("kind"), sensor)
    row = only(
        df.select(
            range_position(F.col("x"), low, high).alias("state"),
            range_deviation(F.col("x"), low, high).alias("deviation"),
            out_of_range_count(F.col("kind"), {sensor: F.col("x")}).alias("outside"),
        )
    )
    assert (row.state, row.deviation) == (state, deviation)
    assert row.outside == int(state in ("above", "below"))
