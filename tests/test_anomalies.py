from __future__ import annotations

import pytest

from machinepulse.functions.periods import Period
from machinepulse.operators import anomalies, fleet
from machinepulse.sources import quality
from tests.rows import at, by, nanos, only, reading, readings, verdict, verdicts


def test_histories_match_microseconds(spark):
    r = readings(spark, reading(moment=at(seconds=0.5)))
    v = verdicts(
        spark,
        verdict(moment=at(), anomaly_score=0.1),
        verdict(moment=nanos(at(seconds=0.5), extra=999), anomaly_score=0.2),
    )
    assert only(anomalies.anomaly_history(r, v)).timestamp.microsecond == 500_000
    assert only(anomalies.anomaly_recent(r, v)).anomaly_score == 0.2
    assert only(anomalies.anomaly_stats(r, v)).total_readings == 1


def test_unknown_outcome_is_in_neither_mean(spark):
    r = readings(
        spark, *[reading(moment=at(d), temperature=t) for d, t in enumerate((10.0, 20.0, 90.0))]
    )
    v = verdicts(
        spark,
        verdict(moment=at(0), is_anomaly=True),
        verdict(moment=at(1), is_anomaly=False),
        verdict(moment=at(2), is_anomaly=None),
    )
    row = only(anomalies.anomaly_stats(r, v))
    assert (row.avg_temp_anomaly, row.avg_temp_normal) == (10.0, 20.0)
    assert (row.total_readings, row.anomaly_count, row.anomaly_pct) == (3, 1, 33.33)


def test_machine_with_nothing_to_count(spark):
    r = readings(spark, reading("M1"), reading("M2"))
    v = verdicts(spark, verdict("M1"))
    stats = by(anomalies.anomaly_stats(r, v), "machine_id")["M2"]
    assert stats.total_readings == 0 and stats.anomaly_pct is None
    shares = anomalies.anomaly_type_share(anomalies.anomaly_stats(r, v, machine_id="M2"))
    assert {row.share_pct for row in shares.collect()} == {None}
    history = by(anomalies.machine_anomaly_history(r, v), "machine_id")["M2"]
    assert history.anomaly_history_count == 0 and history.last_anomaly_ts is None
    empty = by(anomalies.anomaly_stats(r, v, Period(year=1999)), "machine_id")
    assert set(empty) == {"M1", "M2"} and empty["M1"].total_readings == 0


def test_sensor_flags_count_without_the_general_flag(spark):
    r = readings(spark, reading(), reading(moment=at(1)))
    v = verdicts(
        spark,
        verdict(is_anomaly=False, is_pressure_anomaly=True),
        verdict(moment=at(1), is_anomaly=True),
    )
    row = only(anomalies.machine_anomaly_history(r, v))
    assert (row.anomaly_history_count, row.press_anomaly_count) == (1, 1)
    assert only(anomalies.anomaly_stats(r, v)).press_anomaly_count == 1


def test_summary_is_over_anomalous_verdicts_only(spark):
    r = readings(spark, reading("M1"), reading("M2"), reading("M3"))
    v = verdicts(
        spark,
        verdict("M1", at(0), anomaly_score=0.4),
        verdict("M1", at(1), anomaly_score=0.6),
        verdict("M1", at(2), anomaly_score=0.9, is_anomaly=False),
        verdict("M2", at(0), anomaly_score=0.8),
        verdict("M3", at(0), is_anomaly=False),
    )
    summary = anomalies.anomaly_summary(r, v)
    assert [row.machine_id for row in summary.collect()] == ["M2", "M1"]
    row = by(summary, "machine_id")["M1"]
    assert (row.anomaly_count, row.max_score, row.avg_score) == (2, 0.6, 0.5)
    assert row.latest_anomaly_ts == nanos(at(1))
    assert only(anomalies.anomaly_total(summary)).total_anomalies == 3


def test_machine_of_two_types_appears_under_both(spark):
    r = readings(
        spark, reading("M1"), reading("M1", at(1)), reading("M1", at(2), machine_type="furnace")
    )
    summary = anomalies.anomaly_summary(r, verdicts(spark, verdict("M1"), verdict("M1", at(1))))
    assert {(row.machine_type, row.anomaly_count) for row in summary.collect()} == {
        ("motor", 2), ("furnace", 2),
    }
    assert only(quality.machines_of_several_types(r)).machine_id == "M1"


def test_severity(spark):
    machines = [f"M{i}" for i in range(4)]
    r = readings(spark, *[reading(m) for m in machines])
    scores = (0.2, 0.5, 0.8, 1.0)
    v = verdicts(spark, *[verdict(m, anomaly_score=s) for m, s in zip(machines, scores)])
    found = by(anomalies.anomaly_severity(anomalies.anomaly_summary(r, v)), "machine_id")
    assert [found[m].severity for m in machines] == ["low", "medium", "high", "high"]
    assert found["M0"].latest_label == "15 Jun, 12:00"


def test_equal_scores_are_all_low(spark):
    r = readings(spark, reading("M1"), reading("M2"))
    v = verdicts(spark, verdict("M1"), verdict("M2"))
    rows = anomalies.anomaly_severity(anomalies.anomaly_summary(r, v)).collect()
    assert [(row.severity, row.score_ratio) for row in rows] == [("low", 0.0)] * 2


def many(spark, count: int):
    r = readings(spark, *[reading(moment=at(seconds=i)) for i in range(count)])
    v = verdicts(spark, *[verdict(moment=at(seconds=i)) for i in range(count)])
    return r, v


def test_event_lists_keep_the_newest(spark):
    r, v = many(spark, 510)
    for query, limit in (
        (lambda **k: anomalies.anomaly_history(r, v, **k), 500),
        (lambda **k: anomalies.anomaly_recent(r, v, **k), 20),
        (lambda **k: anomalies.anomaly_events(v, **k), 50),
    ):
        rows = query(machine_id="M1").collect()
        assert len(rows) == limit
        times = [row.timestamp for row in rows]
        assert times == sorted(times, reverse=True)
        assert query(limit=3).count() == 3
    newest = anomalies.anomaly_recent(r, v, machine_id="M1").first().timestamp
    assert newest.timestamp() % 3600 == 509


@pytest.mark.parametrize("limit", [0, -1])
def test_limits_must_be_positive(spark, limit):
    r, v = many(spark, 1)
    with pytest.raises(ValueError):
        anomalies.anomaly_history(r, v, limit=limit)


def test_latest_reading_with_a_verdict(spark):
    r = readings(spark, reading(moment=at(0), temperature=1.0), reading(moment=at(1)))
    row = only(anomalies.anomaly_latest_reading(r, verdicts(spark, verdict(moment=at(0)))))
    assert row.temperature == 1.0


def test_anomaly_against_normal(spark):
    r = readings(
        spark,
        reading(moment=at(0), temperature=60.0, health_pct=40.0),
        reading(moment=at(1), temperature=50.0, health_pct=90.0),
    )
    v = verdicts(spark, verdict(moment=at(0)), verdict(moment=at(1), is_anomaly=False))
    found = by(anomalies.anomaly_vs_normal(anomalies.anomaly_stats(r, v)), "measure")
    assert (found["temperature"].delta, found["temperature"].is_worse) == (10.0, True)
    assert (found["vibration"].delta, found["vibration"].is_worse) == (0.0, False)
    assert (found["health_pct"].delta, found["health_pct"].is_worse) == (-50.0, True)


def test_history_by_month(spark):
    r = readings(spark, *[reading(moment=at(d)) for d in (0, 1, 30)])
    v = verdicts(spark, *[verdict(moment=at(d)) for d in (0, 1, 30)])
    rows = anomalies.history_by_month(anomalies.anomaly_history(r, v)).collect()
    assert [(row.event_month, row.month_label, row.event_count) for row in rows] == [
        ("2024-07", "Jul 2024", 1), ("2024-06", "Jun 2024", 2),
    ]


def test_event_labels(spark):
    r, v = many(spark, 1)
    row = only(anomalies.event_labels(anomalies.anomaly_recent(r, v)))
    assert (row.minute_label, row.day_label) == ("2024-06-15 12:00", "2024-06-15")


def test_anomaly_count_needs_no_reading(spark):
    assert only(fleet.kpi_anomaly_count(verdicts(spark, verdict(), verdict("X")))).anomaly_count == 2


def test_months_count_all_events_of_a_machine(spark):
    moments = [at(days=-(i % 60), seconds=i) for i in range(640)]
    r = readings(spark, *[reading("M1", m) for m in moments])
    v = verdicts(spark, *[verdict("M1", m) for m in moments])
    history = anomalies.anomaly_history(r, v, limit=None)
    months = anomalies.history_by_month(history).collect()
    assert sum(row.event_count for row in months) == 640
    assert anomalies.anomaly_history(r, v).count() == 500
    assert anomalies.event_labels(anomalies.anomaly_recent(r, v, limit=None)).count() == 640
