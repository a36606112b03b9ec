from __future__ import annotations

from machinepulse.functions.periods import Period
from machinepulse.operators import fleet, machines, sensors
from tests.rows import at, by, only, reading, readings, verdict, verdicts


def test_equal_times_give_the_same_row_whatever_the_order(spark):
    rows = [
        reading(moment=at(), temperature=1.0, health_pct=70.0),
        reading(moment=at(), temperature=2.0, health_pct=10.0),
        reading(moment=at(-1), temperature=9.0),
    ]
    v = verdicts(spark, verdict())
    found = {
        tuple(only(machines.machine_snapshot(readings(spark, *order), v)).asDict().items())
        for order in (rows, rows[::-1])
    }
    assert len(found) == 1
    row = dict(found.pop())
    assert (row["temperature"], row["health_pct"]) == (2.0, 10.0)


def test_missing_values(spark):
    r = readings(
        spark,
        reading("M1", temperature=None),
        reading("M2", health_pct=None, health_status=None),
        reading("M3", health_pct=10.0),
    )
    v = verdicts(spark, verdict())
    overview = machines.asset_overview(r, v).collect()
    assert [row.machine_id for row in overview] == ["M3", "M1", "M2"]
    detail = by(machines.asset_detail(r, v), "machine_id")
    assert detail["M1"].temperature is None and detail["M1"].temp_deviation_pct is None
    assert detail["M2"].rul_days == 90
    rul = by(machines.rul_table(machines.asset_overview(r, v)), "machine_id")
    assert rul["M2"].is_estimated and not rul["M1"].is_estimated
    assert only(fleet.kpi_latest(r)).avg_health == 50.0


def test_week_back_from_the_newest_reading_of_the_fleet(spark):
    r = readings(
        spark,
        reading("M1", at(0), health_pct=80.0),
        reading("M1", at(-7), health_pct=90.0),
        reading("M1", at(-7, seconds=1), health_pct=1.0),
        reading("M1", at(-9), health_pct=2.0),
        # Its own last reading is older than the bound: it is its own past.
        reading("M2", at(-8), health_pct=40.0),
        # Nothing old enough.
        reading("M3", at(-1), health_pct=50.0),
    )
    found = by(machines.asset_overview(r, verdicts(spark, verdict())), "machine_id")
    assert (found["M1"].health_past_ago, found["M1"].trend_pct) == (90.0, -10.0)
    assert (found["M2"].health_past_ago, found["M2"].trend_pct) == (40.0, 0.0)
    assert found["M3"].health_past_ago is None and found["M3"].trend_pct is None


def test_the_earlier_reading_must_lie_in_the_period(spark):
    r = readings(spark, reading("M1", at(0)), reading("M1", at(-30)))
    v = verdicts(spark, verdict())
    assert only(machines.asset_overview(r, v)).health_past_ago == 90.0
    assert only(machines.asset_overview(r, v, Period(6, 2024))).health_past_ago is None


def test_machine_without_verdict(spark):
    r = readings(spark, reading("M1"), reading("M2"))
    v = verdicts(spark, verdict("M2"))
    asset = by(machines.asset_overview(r, v), "machine_id")["M1"]
    assert asset.is_anomaly is None and asset.anomaly_score is None
    assert asset.anomaly_history_count == 0 and asset.first_anomaly_ts is None
    overview = by(machines.machine_overview(r, v), "machine_id")["M1"]
    assert overview.is_anomaly is False and overview.anomaly_history_count == 0


def test_type_without_spread_has_no_deviation(spark):
    r = readings(
        spark,
        reading("M1", at(0)),
        reading("M1", at(1)),
        reading("F1", machine_type="furnace"),
    )
    for row in machines.asset_detail(r, verdicts(spark, verdict())).collect():
        assert row.temp_deviation_pct is None


def test_deviation_counts_hundredths_of_a_deviation(spark):
    r = readings(
        spark, *[reading("M1", at(day), temperature=float(x)) for day, x in enumerate((2, 4, 9))]
    )
    # Mean 5, sample deviation sqrt(13), newest value 9.
    assert only(machines.asset_detail(r, verdicts(spark, verdict()))).temp_deviation_pct == 110.94


def test_baseline_covers_all_time(spark):
    r = readings(
        spark,
        reading("M1", at(0), temperature=2.0),
        reading("M1", at(60), temperature=4.0),
        reading("M1", at(61), temperature=9.0),
    )
    row = only(machines.asset_detail(r, verdicts(spark, verdict()), Period(6, 2024)))
    assert row.temperature == 2.0 and row.temp_deviation_pct == 83.21


def test_trend_matches_whole_seconds(spark):
    r = readings(spark, reading(moment=at(seconds=0.5)), reading(moment=at(seconds=2)))
    v = verdicts(
        spark,
        verdict(moment=at(), anomaly_score=0.1, is_vibration_anomaly=True),
        verdict(moment=at(seconds=0.5), anomaly_score=0.2, is_pressure_anomaly=True),
    )
    first, second = machines.asset_trend(r, v, machine_id="M1").collect()
    assert first.is_vibration_anomaly and not first.is_pressure_anomaly
    assert second.is_anomaly is None
    trend = machines.asset_trend(r, v)
    assert only(machines.trend_markers(trend)).timestamp == first.timestamp
    assert only(machines.trend_points(trend)).point_count == 2
    labels = {row.time_label for row in machines.trend_labels(trend).collect()}
    assert labels == {"15 Jun, 12:00"}


def test_unknown_machine_gives_no_rows(spark):
    r, v = readings(spark, reading()), verdicts(spark, verdict())
    assert machines.machine_snapshot(r, v, machine_id="X").isEmpty()
    assert machines.asset_detail(r, v, machine_id="X").isEmpty()
    assert machines.asset_trend(r, v, machine_id="X").isEmpty()


def test_one_machine_is_the_same_row_as_among_all(spark):
    r = readings(spark, reading("M1"), reading("M2", health_pct=20.0))
    v = verdicts(spark, verdict("M1"), verdict("M2", anomaly_score=0.9))
    for query in (machines.machine_snapshot, machines.asset_detail):
        assert only(query(r, v, machine_id="M2")) == by(query(r, v), "machine_id")["M2"]


def assets(spark):
    r = readings(
        spark,
        reading("M1", health_pct=81.24),
        reading("M2", health_pct=10.0, health_status="CRITICAL", machine_type="furnace"),
        reading("M3", health_pct=60.04, health_status="WARNING"),
        reading("M4", health_pct=40.0, health_status="BORDERLINE"),
    )
    v = verdicts(
        spark,
        verdict("M1", at(0), is_anomaly=True, is_temperature_anomaly=True,
                is_pressure_anomaly=True),
        verdict("M3", at(-1), is_anomaly=True),
        verdict("M3", at(0), is_anomaly=False),
        verdict("M4", at(0), is_anomaly=True),
    )
    return r, v


def test_filters(spark):
    overview = machines.asset_overview(*assets(spark))

    def ids(**choice):
        return [row.machine_id for row in machines.assets_filtered(overview, **choice).collect()]

    assert ids() == ids(machine_type="All", health_status="All") == ["M2", "M4", "M3", "M1"]
    assert ids(machine_type="motor", health_status="WARNING") == ["M3"]
    assert ids(anomaly_only=True) == ["M4", "M1"]


def test_filtered_figures(spark):
    overview = machines.asset_overview(*assets(spark))
    row = only(fleet.kpi_filtered(overview))
    # 81.2, 10, 60 and 40 average to 47.8.
    assert (row.avg_health, row.total_machines, row.anomaly_count) == (48, 4, 2)
    assert (row.healthy_count, row.warning_count, row.critical_count) == (1, 1, 1)
    none = only(fleet.kpi_filtered(machines.assets_filtered(overview, machine_type="x")))
    assert none.avg_health == 0 and none.total_machines == 0
    r = readings(spark, reading("M1", health_pct=91.0), reading("M2", health_pct=None))
    partly = machines.asset_overview(r, verdicts(spark, verdict()))
    assert only(fleet.kpi_filtered(partly)).avg_health == 46


def test_focus_prefers_anomalous_machines(spark):
    r, v = assets(spark)
    assert only(machines.focus_machine(r, v)).machine_id == "M4"
    calm = verdicts(spark, verdict("M1", is_anomaly=False))
    assert only(machines.focus_machine(r, calm)).machine_id == "M2"


def test_focus_and_order_use_health_before_rounding(spark):
    r = readings(spark, reading("M1", health_pct=50.04), reading("M2", health_pct=50.01))
    v = verdicts(spark, verdict("M9"))
    assert only(machines.focus_machine(r, v)).machine_id == "M2"
    assert machines.asset_overview(r, v).first().machine_id == "M2"


def test_states(spark):
    found = by(machines.asset_states(machines.asset_overview(*assets(spark))), "machine_id")
    assert (found["M1"].state_label, found["M1"].active_flags) == ("flagged", 2)
    assert (found["M2"].state_label, found["M2"].active_flags) == ("normal", 0)
    assert (found["M3"].state, found["M3"].state_label) == ("past", "1 past")


def test_sensor_checks_and_explanations(spark):
    r = readings(spark, reading("P1", machine_type="slurry_pump", temperature=77.0, pressure=4.0))
    flags = dict(is_temperature_anomaly=True, is_vibration_anomaly=True)
    v = verdicts(spark, verdict("P1", **flags))
    overview = machines.asset_overview(r, v)
    checks = by(sensors.sensor_range_check(overview), "sensor")
    assert (checks["temperature"].range_state, checks["temperature"].deviation_pct) == (
        "above", 10.0,
    )
    assert (checks["pressure"].range_state, checks["pressure"].deviation_pct) == ("below", 11.1)
    texts = by(sensors.sensor_explanation(overview), "sensor")
    assert set(texts) == {"temperature", "vibration"}
    assert "77 °C, over the upper limit of 70 °C" in texts["temperature"].explanation
    assert "inside the usual 0 to 4.5 mm/s" in texts["vibration"].explanation


def test_empty_period(spark):
    r, v = readings(spark, reading()), verdicts(spark, verdict())
    row = only(fleet.kpi_summary(r, v, Period(year=1999)))
    assert set(row.asDict().values()) == {0}
    assert only(fleet.kpi_latest(r, Period(year=1999))).avg_health is None
    assert machines.asset_overview(r, v, Period(year=1999)).isEmpty()
