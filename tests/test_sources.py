from __future__ import annotations

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from machinepulse.functions.periods import Period
from machinepulse.operators import anomalies, fleet, machines
from machinepulse.plans import reports
from machinepulse.schemas import READINGS, SchemaError, conform
from machinepulse.sources import documents, facts, quality, testdata
from oracle import statements
from tests.rows import at, nanos, only, reading, readings, verdict, verdicts


def test_missing_column_and_wrong_type_are_named(spark):
    r = readings(spark, reading())
    with pytest.raises(SchemaError, match="pressure"):
        conform(r.drop("pressure"), READINGS, "readings")
    with pytest.raises(SchemaError, match="readings.pressure: expected double, found string"):
        conform(r.withColumn("pressure", F.lit("5")), READINGS, "readings")


def test_zoneless_times_are_utc(spark):
    r = readings(spark, reading())
    zoneless = r.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    assert only(conform(zoneless, READINGS, "readings")) == only(r)


def test_rows_without_time_are_rejected(spark, tmp_path):
    bad = readings(spark, reading()).withColumn("timestamp", F.lit(None).cast("timestamp"))
    with pytest.raises(SchemaError, match="without"):
        quality.require_times(bad, "readings")
    with pytest.raises(Exception, match="timestamp must not be null"):
        facts.write_readings(bad, str(tmp_path / "bad"))
    quality.require_times(readings(spark, reading()), "readings")


def history(spark):
    r = readings(spark, *[reading(f"M{m}", at(d)) for m in range(3) for d in range(0, 400, 40)])
    v = verdicts(spark, *[verdict(f"M{m}", at(d)) for m in range(3) for d in range(0, 400, 40)])
    return r, v


def test_stored_tables_give_the_same_results(spark, tmp_path):
    r, v = history(spark)
    facts.write_readings(r, str(tmp_path / "r"), files=3)
    facts.write_verdicts(v, str(tmp_path / "v"))
    stored_r = facts.read_readings(spark, str(tmp_path / "r"))
    stored_v = facts.read_verdicts(spark, str(tmp_path / "v"))
    for period in (Period(), Period(year=2024), Period(month=6), Period(6, 2024)):
        for query in (machines.asset_overview, anomalies.anomaly_stats, fleet.kpi_summary):
            expected = sorted(query(r, v, period).collect(), key=str)
            assert sorted(query(stored_r, stored_v, period).collect(), key=str) == expected


def test_bucketed_tables_give_the_same_results(spark):
    r, v = history(spark)
    facts.save_for_matching(r, v, 4, "readings_same", "verdicts_same")
    stored_r, stored_v = spark.table("readings_same"), spark.table("verdicts_same")
    expected = sorted(anomalies.anomaly_history(r, v).collect(), key=str)
    assert sorted(anomalies.anomaly_history(stored_r, stored_v).collect(), key=str) == expected


def test_any_format_can_be_read(spark, tmp_path):
    r, v = history(spark)
    r.write.orc(str(tmp_path / "r"))
    assert facts.read_readings(spark, str(tmp_path / "r"), fmt="orc").count() == r.count()


def test_sql_with_bound_values(spark):
    facts.register_views(*history(spark))
    row = only(
        spark.sql(
            "SELECT count(*) AS n FROM readings WHERE machine_id = ? AND year(timestamp) = ?",
            args=["M1", 2024],
        )
    )
    assert row.n == 5


def test_results_can_be_stored_as_json(spark, tmp_path):
    report = reports.machine_report(*history(spark))
    reports.recommendation_snapshot(report).drop("record").write.json(str(tmp_path / "out"))
    stored = spark.read.json(str(tmp_path / "out"))
    assert {row.machine_id for row in stored.collect()} == {"M0", "M1", "M2"}
    assert stored.select("sensor_snapshot.temperature").distinct().collect()[0][0] == 50.0


def test_guide_documents(spark, tmp_path):
    for name, numbers in (("a", (5, 2)), ("b", (1,))):
        document = {
            "source": name,
            "total_pages": len(numbers),
            "pages": [{"page": n, "content": f"{name}{n}\nmore"} for n in numbers],
        }
        (tmp_path / f"{name}.json").write_text(json.dumps(document, indent=1))
    rows = documents.read_guides(spark, str(tmp_path)).orderBy("content").collect()
    assert [(row.position, row.page, row.content) for row in rows] == [
        (2, 2, "a2\nmore"), (1, 5, "a5\nmore"), (1, 1, "b1\nmore"),
    ]
    assert rows[0].guide_id == rows[1].guide_id != rows[2].guide_id


def test_quality_reports(spark):
    r = readings(
        spark, reading(), reading(), reading("M2", health_pct=10.0, health_status="WARNING")
    )
    assert only(quality.repeated_readings(r)).reading_count == 2
    conflict = only(quality.status_conflicts(r).filter("not agrees"))
    assert (conflict.stored_status, conflict.implied_status) == ("WARNING", "CRITICAL")


def test_nanoseconds_survive_storage(spark, tmp_path):
    v = verdicts(spark, verdict(moment=nanos(at(), extra=1)))
    facts.write_verdicts(v, str(tmp_path / "v"))
    row = only(facts.read_verdicts(spark, str(tmp_path / "v")))
    assert row.timestamp == nanos(at(), extra=1)


def test_own_columns_named_like_a_layout_change_nothing(spark):
    r = readings(spark, reading("M1"), reading("M2"))
    v = verdicts(spark, verdict("M1"))
    clash = {"year": F.lit(1998), "month": F.lit(1), "event_time": F.lit("2001-01-01")}
    r2, v2 = r.withColumns(clash), v.withColumns(clash)
    for period in (Period(), Period(year=2024), Period(month=6), Period(6, 2024)):
        assert only(fleet.kpi_reading_count(r2, period)) == only(fleet.kpi_reading_count(r, period))
        assert (
            anomalies.anomaly_history(r2, v2, period).collect()
            == anomalies.anomaly_history(r, v, period).collect()
            != []
        )
    assert conform(r2, READINGS, "readings").columns == READINGS.names


@pytest.mark.parametrize("number", [7, 10000, 100000, 1234567])
def test_long_numbers_keep_their_digits(spark, number):
    made = spark.range(number, number + 1).select(testdata._machine_id(F.col("id"))).first()[0]
    sql = next(
        line for line in statements.all_statements()["readings_per_machine"].splitlines()
        if "lpad" in line
    )
    expression = sql.strip().removeprefix("SELECT ").split(" AS machine_id")[0]
    twin = duckdb.sql(f"SELECT {expression} FROM (SELECT {number} AS user_id)").fetchall()[0][0]
    assert made == twin == f"M{number:05d}"
