"""As-of matching, rows left out before a shuffle, observed figures, SQL functions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from machinepulse import catalog
from machinepulse.functions.periods import ALL_TIME, Period
from machinepulse.operators import anomalies, asof, charts, machines
from machinepulse.operators.reduction import may_match
from machinepulse.schemas import SchemaError
from machinepulse.sources import facts, quality, sqlapi, testdata
from tests.rows import at, by, messages, only, reading, readings, verdict, verdicts
from tests.test_plans import formatted, no_broadcast, plan, stored  # noqa: F401
from tests.test_summaries import rows

SF = "/root/testdata/sf0.001"


# --- as of ---------------------------------------------------------------------


def brute(left, right, tolerance):
    out = []
    for key, time, name in left:
        seen = [
            (t, v)
            for k, t, v in right
            if key is not None and k == key and time is not None and t is not None and t <= time
        ]
        best = max(seen, default=None)
        if best and tolerance is not None and time - best[0] > tolerance:
            best = None
        out.append((key, time, name, best))
    return sorted(out, key=str)


@pytest.mark.parametrize("tolerance", [None, 0, 40, 1000])
@pytest.mark.parametrize("piece", [1, 60, 10_000])
def test_the_newest_row_before_each(spark, tolerance, piece):
    rng = random.Random(piece)
    keys = ["a", "a", "a", "b", None]
    row = lambda i: (rng.choice(keys), rng.choice([None, *range(0, 900, 7)]), i)
    left, right = [row(i) for i in range(150)], [row(i) for i in range(60)]
    # Ties in time, repeated rows, and a stretch without rows of the right side.
    left += [("a", 5000, 1), ("a", 5000, 1), ("c", 10, 2)]
    right += [("a", 700, 3), ("a", 700, 9), ("a", 700, 9), ("d", 1, 4)]

    def table(data, value):
        df = spark.createDataFrame(data, f"key string, s long, {value} long")
        return df.withColumn("timestamp", F.timestamp_seconds("s")).drop("s")

    got = asof.as_of(
        table(left, "name").withColumn("machinepulse_row", F.lit(1)), table(right, "value"),
        ["key"], ["value"], tolerance, piece,
    )
    assert got.columns == ["key", "name", "timestamp", "machinepulse_row", "found"]
    found = [
        (r.key, r.t, r.name, None if r.found is None else (r.ft, r.found.value))
        for r in got.withColumns(
            {"t": F.unix_seconds("timestamp"), "ft": F.unix_seconds("found.timestamp")}
        ).collect()
    ]
    assert sorted(found, key=str) == brute(left, right, tolerance)


def test_as_of_of_empty_tables(spark):
    r, v = readings(spark, reading()), verdicts(spark, verdict())
    assert asof.trend_asof(r.limit(0), v).collect() == []
    row = only(asof.trend_asof(r, v.limit(0)))
    assert row.verdict_ts is None and row.is_anomaly is None and row.health_pct == 90.0
    with pytest.raises(ValueError, match="negative"):
        asof.as_of(r, r, ["machine_id"], [], tolerance=-1)
    with pytest.raises(ValueError, match="second"):
        asof.as_of(r, r, ["machine_id"], [], piece=0)


def test_a_verdict_holds_for_a_week(spark):
    r = readings(spark, *[reading(moment=at(d)) for d in (0, 6.9, 7, 7.1)])
    v = verdicts(spark, verdict(moment=at(0)), verdict("M2", at(3)))
    ages = [row.verdict_age_s for row in asof.trend_asof(r, v, machine_id="M1").collect()]
    assert ages == [0, 596_160, 604_800, None]
    every = asof.trend_asof(r, v, tolerance=None)
    assert every.where("verdict_ts IS NULL").count() == 0


def test_a_dominant_machine_is_many_groups(spark, no_broadcast):  # noqa: F811
    text = plan(asof.trend_asof(testdata.readings(spark, SF), testdata.verdicts(spark, SF)))
    windows = [line for line in text.splitlines() if "Exchange hashpartitioning(machine_id" in line]
    assert any("machinepulse_piece" in line for line in windows)
    # Only one row for each piece is put together by machine alone.
    r = readings(spark, *[reading(moment=at(seconds=60 * k)) for k in range(20_000)])
    v = verdicts(spark, *[verdict(moment=at(seconds=60 * k)) for k in range(0, 20_000, 5)])
    spread = (
        asof.trend_asof(r, v)
        .groupBy(F.to_date("timestamp")).count()
    )
    assert spread.count() >= 14
    assert only(asof.trend_asof(r, v).agg(F.max("verdict_age_s").alias("m"))).m == 240


# --- rows left out before the shuffle --------------------------------------------


def test_every_key_passes_and_few_others(spark):
    keys = spark.range(20_000).select((F.col("id") * 3).alias("k"), F.lit("x").alias("s"))
    keys = keys.unionAll(keys.limit(100))
    other = spark.range(60_000).select(F.col("id").alias("k"), F.lit("x").alias("s"))
    passed = other.where(may_match(keys, ["k", "s"]))
    assert passed.join(keys.distinct(), ["k", "s"]).count() == 20_000
    assert passed.count() < 20_000 + 0.03 * 40_000
    assert other.where(may_match(keys.limit(0), ["k", "s"])).count() == 0


def test_a_filter_of_bounded_size_loses_nothing(spark, monkeypatch):
    from machinepulse.operators import reduction

    monkeypatch.setattr(reduction, "MOST_BITS", 64 * 64)
    keys = spark.range(0, 3000, 2).withColumnRenamed("id", "k")
    other = spark.range(3000).withColumnRenamed("id", "k")
    assert other.where(may_match(keys, ["k"])).join(keys, "k").count() == 1500


def test_shuffled_readings_fall_to_the_anomalous_share(spark, no_broadcast):  # noqa: F811
    sf = "/root/testdata/sf0.1"
    r, v = testdata.readings(spark, sf), testdata.verdicts(spark, sf)
    keys = v.where("is_anomaly")
    share = keys.count() / v.count()
    reduced = anomalies.anomaly_history(r, v, reduced=True)
    text = plan(reduced)
    below = text.split("Exchange hashpartitioning(machine_id")
    assert any("getbit" in part and "Subquery" in part for part in below)
    timed = facts.with_event_time(keys).selectExpr(
        "machine_id", "machinepulse_event_time AS timestamp"
    )
    shuffled = r.where(may_match(timed, ["machine_id", "timestamp"])).count() / r.count()
    assert share / 2 < shuffled < share + 0.02


@pytest.mark.parametrize("period", [ALL_TIME, Period(6, 2024), Period(month=6)])
def test_reduced_lists_are_the_same(spark, stored, period):  # noqa: F811
    for query in (anomalies.anomaly_history, anomalies.anomaly_recent):
        for limit in (None, 3):
            got = query(*stored, period, limit=limit, reduced=True)
            assert rows(got) == rows(query(*stored, period, limit=limit))
    one = anomalies.anomaly_recent(*stored, period, machine_id="M00001", reduced=True)
    assert one.collect() == anomalies.anomaly_recent(*stored, period, machine_id="M00001").collect()


# --- observed figures --------------------------------------------------------------


def test_figures_come_with_the_job_that_reads(spark):
    r = readings(
        spark, reading(), reading("M2", health_status="CRITICAL"), reading("M3", health_pct=None),
        reading("M4", health_pct=None, health_status=None), reading("M5", at(3), health_pct=10.0),
    )
    observed, observation = quality.observed_readings(r)
    counted = observed.groupBy("machine_type").count()
    assert "CollectMetrics" in plan(counted) and plan(counted).count("Scan") == 1
    assert only(counted)["count"] == 5
    figures = quality.require_keys(observation, "readings")
    conflicts = quality.status_conflicts(r).where("not agrees").agg(F.sum("reading_count").alias("n"))
    assert figures["status_conflicts"] == only(conflicts).n == 3
    assert figures["rows"] == 5 and figures["without_health"] == 2
    assert figures["last_time"] == at(3).replace(tzinfo=None)


def test_rows_without_a_key_are_told(spark):
    r = readings(spark, reading()).withColumn("machine_id", F.lit(None).cast("string"))
    observed, observation = quality.observed_readings(r)
    assert observed.count() == 1
    with pytest.raises(SchemaError, match="1 rows without"):
        quality.require_keys(observation, "readings")
    with pytest.raises(SchemaError):
        quality.require_times(r, "readings")
    v = verdicts(spark, verdict(is_anomaly=None), verdict("M2", is_anomaly=False, is_pressure_anomaly=True))
    observed, observation = quality.observed_verdicts(v)
    assert observed.count() == 2
    assert observation.get["unknown_outcomes"] == 1 and observation.get["flags_without_anomaly"] == 1
    observed, observation = quality.observed_verdicts(v.limit(0))
    assert observed.count() == 0 and observation.get["rows"] == 0


# --- SQL functions -----------------------------------------------------------------

ASKED = [(None, None, None), ("M00001", None, None), ("M00001", 6, 2024), (None, 6, None), (None, None, 2024), (None, 12, 2024)]


@pytest.mark.parametrize(("machine", "month", "year"), ASKED)
def test_functions_give_what_the_operators_give(stored, machine, month, year):  # noqa: F811
    spark = sqlapi.register(*stored)
    period = Period(month, year)
    assert rows(sqlapi.call(spark, "asset_trend", machine, month, year)) == rows(
        machines.asset_trend(*stored, period, machine)
    )
    assert rows(sqlapi.call(spark, "anomaly_events", machine, month, year)) == rows(
        anomalies.anomaly_events(stored[1], period, machine)
    )


def test_arguments_reach_the_files(stored):  # noqa: F811
    spark = sqlapi.register(*stored)
    text = formatted(spark.sql("SELECT * FROM asset_trend('M00001', 6, 2024)"))
    assert text.count("EqualTo(machine_id,M00001)") == 2
    assert "GreaterThanOrEqual(timestamp,2024-06-01" in text
    assert "GreaterThanOrEqual(timestamp,1717200000000000000)" in text
    bound = formatted(sqlapi.call(spark, "anomaly_events", "M00001", 6, 2024))
    assert "EqualTo(machine_id,M00001)" in bound and "LessThan(timestamp,1719792000000000000)" in bound
    assert rows(spark.sql("SELECT * FROM anomaly_events()")) == rows(anomalies.anomaly_events(stored[1]))


def test_functions_compose_with_other_sql(stored):  # noqa: F811
    spark = sqlapi.register(*stored)
    got = spark.sql(
        "SELECT b.machine_type, t.c FROM sensor_baselines() b JOIN "
        "(SELECT count(*) c FROM asset_trend(machine => 'M00001', year => 2024)) t"
    )
    counted = machines.asset_trend(*stored, Period(year=2024), "M00001").count()
    assert {r.c for r in got.collect()} == {counted}
    injected = sqlapi.call(spark, "asset_trend", "x' OR '1'='1")
    assert injected.collect() == []


# --- fences ------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "blocks"),
    [
        ("```chart\n{a}\n```", [("chart", "{a}")]),
        ("```chart\n{a}", [("chart", "{a}")]),
        ("```chart", []),
        ("```chart\n", [("chart", "")]),
        ("~~~ json x\r\n{a}\r\n~~~~\r\nb", [("json", "{a}\r")]),
        ("````chart\n```\n{a}\n`````\n```json\n{b}\n```", [("chart", "```\n{a}"), ("json", "{b}")]),
        ("```a`b\n{a}\n```\n", [("", "")]),
        ("> ```chart\n> {a}\n> {b}\n> ```\nx", [("chart", "{a}\n{b}")]),
        ("    ```chart\n{a}\n```", []),
        ("    ```chart\n{a}\n```\n", [("", "")]),
        ("- item\n      ```chart\n      {a}\n      ```", [("chart", "      {a}")]),
        ("1. ```json\n{a}\n   ```", [("json", "{a}")]),
        ("```\n~~~\n```\n~~~x\n```\n~~~", [("", "~~~"), ("x", "```")]),
        ("no fence", []),
        ("", []),
        (None, None),
    ],
)
def test_fences_open_and_close(spark, text, blocks):
    table = messages(spark, (1, 1, "user", text))
    got = only(table.select(charts._fenced(F.col("text")).alias("blocks"))).blocks
    # An unclosed fence at the end opens a block without a body.
    want = None if blocks is None else [tuple(b) for b in blocks]
    assert (None if got is None else [(b.lang, b.body.rstrip("\n")) for b in got]) == want


@pytest.mark.parametrize(
    "body",
    ['{"type":"bar"},{"a":1}', '{"a":1}],[{"b":2}', '{"a":1},0', '{"a":1}}', "[1]", "{", '{"a":1} x', ""],
)
def test_what_is_more_or_less_than_one_object_is_no_chart(spark, body):
    whole = '{"type":"bar","data":[],"xKey":"x","yKey":"y"}'
    texts = [f"```json\n{body}\n```", f"```json\n{whole}{body}\n```" if body else "x", f"```json\n {whole} \n```"]
    table = messages(spark, *[(1, k, "user", t) for k, t in enumerate(texts)]).withColumn(
        "message_id", F.col("turn")
    )
    assert {r.message_id for r in charts.chart_blocks(table).collect()} == {2}


def test_new_keys_are_registered():
    keys = set(catalog.queries())
    for name in ("trend_asof", "anomaly_history_reduced", "asset_trend_sql", "anomaly_events_sql"):
        assert {f"{name}{suffix}" for suffix in catalog.PERIODS} <= keys
    assert {"reading_checks", "sensor_baselines_sql"} <= keys
    assert by is not None
