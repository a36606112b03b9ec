"""Merging into the stored facts, and the monthly summaries kept beside them."""

from __future__ import annotations

import os
import statistics
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from machinepulse import catalog
from machinepulse.functions import moments
from machinepulse.functions.periods import ALL_TIME, Period
from machinepulse.operators import anomalies, fleet, machines
from machinepulse.schemas import READINGS, VERDICTS
from machinepulse.sources import facts, summaries, testdata, upsert
from tests.rows import at, by, nanos, only, reading, readings, verdict, verdicts
from tests.test_plans import formatted

SF = "/root/testdata/sf0.001"
PERIODS = [ALL_TIME, Period(year=2024), Period(month=6), Period(6, 2024), Period(1, 2030)]


def rows(df):
    columns = sorted(c for c in df.columns if not c.startswith("machinepulse_"))
    return sorted(map(str, df.select(*columns).collect()))


def files(path: Path) -> dict[str, float]:
    return {str(f): os.stat(f).st_mtime_ns for f in path.rglob("*.parquet")}


@pytest.fixture
def place(tmp_path):
    return lambda name: str(tmp_path / name)


# --- merging into the facts ----------------------------------------------------


def test_a_batch_written_twice_leaves_the_same_table(spark, place, tmp_path):
    first = readings(spark, reading(), reading("M2"), reading("M2", at(-60)))
    assert upsert.merge_readings(first, place("r")) == [(2024, 4), (2024, 6)]
    april = {f: t for f, t in files(tmp_path / "r").items() if "month=4" in f}
    batch = readings(
        spark, reading("M2", temperature=99.0), reading("M3"), reading("M3"), reading("M2", at(1))
    )
    for _ in range(2):
        assert upsert.merge_readings(batch, place("r")) == [(2024, 6)]
        stored = facts.read_readings(spark, place("r"))
        assert rows(stored) == rows(
            readings(
                spark, reading(), reading("M2", at(-60)), reading("M2", temperature=99.0),
                reading("M2", at(1)), reading("M3"),
            )
        )
    # The month no row lay in keeps its file.
    assert april == {f: t for f, t in files(tmp_path / "r").items() if "month=4" in f}


def test_of_equal_keys_in_a_batch_the_greatest_row_counts(spark, place):
    batch = readings(spark, *[reading(temperature=t) for t in (3.0, 9.0, None)])
    upsert.merge_readings(batch, place("r"))
    assert only(facts.read_readings(spark, place("r"))).temperature == 9.0


def test_verdicts_are_merged_by_nanosecond(spark, place):
    one, later = verdict(), verdict(moment=nanos(at(), 300))
    assert upsert.merge_verdicts(verdicts(spark, one), place("v")) == [(2024, 6)]
    changed = verdict(is_anomaly=False)
    upsert.merge_verdicts(verdicts(spark, later, changed, verdict(moment=at(400))), place("v"))
    stored = facts.read_verdicts(spark, place("v"))
    assert rows(stored) == rows(verdicts(spark, later, changed, verdict(moment=at(400))))


def test_nothing_and_null_keys(spark, place):
    none = readings(spark, reading()).limit(0)
    assert upsert.merge_readings(none, place("r")) == []
    assert not Path(place("r")).exists()
    upsert.merge_readings(readings(spark, reading()), place("r"))
    before = files(Path(place("r")))
    assert upsert.merge_readings(none, place("r")) == []
    bad = readings(spark, reading()).withColumn("machine_id", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="machine_id must not be null"):
        upsert.merge_readings(bad, place("r"))
    assert files(Path(place("r"))) == before


def test_only_the_touched_months_are_read(spark, place):
    upsert.merge_readings(
        readings(spark, reading(), reading(moment=at(-60)), reading(moment=at(365))), place("r")
    )
    stored = upsert.in_months(facts.read_readings(spark, place("r")), [(2024, 6)])
    assert only(stored).timestamp == at().replace(tzinfo=None)
    scanned = formatted(stored).split("PartitionFilters:")[1].split("\n")[0]
    assert "machinepulse_year" in scanned and "machinepulse_month" in scanned


# --- moments -------------------------------------------------------------------


def test_moments_merge_to_those_of_all_values(spark):
    # Large values and a small spread: sums of squares would lose the spread.
    values = [1e9 + x / 7 for x in range(100)]
    parts = [values[:1], values[1:40], [], values[40:], [None, None]]
    table = spark.createDataFrame(
        [(k, v) for k, part in enumerate(parts) for v in part], "part int, x double"
    )
    each = table.groupBy("part").agg(moments.moments("x").alias("m"))
    whole = moments.merged(F.array_sort(F.collect_list("m")))
    row = only(each.agg(whole.alias("m")).select(
        "m.n", moments.mean(F.col("m")).alias("mean"), moments.stddev_samp(F.col("m")).alias("std")
    ))
    assert row.n == 100
    assert row["mean"] == pytest.approx(statistics.fmean(values), rel=1e-15)
    assert row.std == pytest.approx(statistics.stdev(values), rel=1e-6)


def test_moments_of_nothing_and_of_one_value(spark):
    table = spark.createDataFrame([(1, None), (2, 5.0)], "k int, x double")
    known = moments.merged(F.array(F.col("m")))
    got = table.groupBy("k").agg(moments.moments("x").alias("m")).select(
        "k", moments.mean(known).alias("mean"), moments.stddev_samp(known).alias("std")
    )
    assert {r.k: (r["mean"], r.std) for r in got.collect()} == {1: (None, None), 2: (5.0, None)}


# --- newest rows ---------------------------------------------------------------


def batches(spark):
    """Three batches with late rows, rows delivered again, and rows equal in time."""
    all_ = testdata.readings(spark, SF)
    part = F.pmod(F.xxhash64("machine_id", "timestamp"), F.lit(3))
    again = all_.where(F.pmod(F.xxhash64("timestamp"), F.lit(7)) == 1)
    ties = all_.where("operational_time % 5 = 0").withColumn("health_pct", F.lit(1.0))
    own = all_.unionAll(ties)
    return own, [own.where(part == k).unionAll(again.where(part < k)) for k in (2, 0, 1)]


def test_newest_rows_after_three_batches_are_those_of_a_full_scan(spark, place):
    everything, delivered = batches(spark)
    for batch in [*delivered, delivered[0]]:
        summaries.merge_newest(batch, place("newest"))
    newest = summaries.read_newest(spark, place("newest"))
    assert rows(newest) == rows(summaries.newest_by_month(everything))
    for period in PERIODS:
        for query in (
            lambda r: fleet.kpi_latest(r, period),
            lambda r: machines.machine_snapshot(r, testdata.verdicts(spark, SF), period),
            lambda r: machines.machine_overview(r, testdata.verdicts(spark, SF), period),
        ):
            assert rows(query(newest)) == rows(query(everything))
    months = upsert.with_month(everything).select("machine_id", *upsert.with_month(newest).columns[-2:])
    assert newest.select("machine_id", "timestamp").distinct().count() == months.distinct().count()


def test_newest_verdicts_serve_as_verdicts(spark, place):
    judged = testdata.verdicts(spark, SF)
    for part in (judged.where("timestamp % 2 = 0"), judged.where("timestamp % 3 <> 0"), judged):
        summaries.merge_newest(part, place("v"))
    newest = summaries.read_newest(spark, place("v"), VERDICTS)
    r = testdata.readings(spark, SF)
    for period in PERIODS:
        assert rows(machines.machine_snapshot(r, newest, period)) == rows(
            machines.machine_snapshot(r, judged, period)
        )


def test_a_correction_reaches_the_summaries_by_a_refresh(spark, place):
    upsert.merge_readings(
        readings(spark, reading(), reading(moment=at(2)), reading(moment=at(-60))), place("r")
    )
    stored = lambda: facts.read_readings(spark, place("r"))
    builds = {"n": summaries.newest_by_month, "m": summaries.moments_by_month}
    for name, build in builds.items():
        summaries.write(build(stored()), place(name))
    april = {name: {f: t for f, t in files(Path(place(name))).items() if "month=4" in f} for name in builds}
    fix = readings(spark, reading(moment=at(2), health_pct=1.0, temperature=-5.0))
    months = upsert.merge_readings(fix, place("r"))
    for name, build in builds.items():
        summaries.refresh(build, stored(), place(name), months)
        assert rows(summaries.read(spark, place(name))) == rows(build(stored()))
        kept = {f: t for f, t in files(Path(place(name))).items() if "month=4" in f}
        assert kept == april[name]
    assert only(machines.latest_rows(summaries.read_newest(spark, place("n")), ["health_pct"])).health_pct == 1.0


def test_empty_batches_and_tables(spark, place):
    none = readings(spark, reading()).limit(0)
    assert summaries.merge_newest(none, place("n")) == []
    summaries.refresh(summaries.newest_by_month, none, place("n"), [])
    assert not Path(place("n")).exists()
    assert summaries.type_baselines(summaries.moments_by_month(none)).collect() == []


# --- queries over them ---------------------------------------------------------


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("summaries")
    r, v = testdata.readings(spark, SF), testdata.verdicts(spark, SF)
    facts.write_readings(r, str(place / "r"))
    facts.write_verdicts(v, str(place / "v"))
    r, v = facts.read_readings(spark, str(place / "r")), facts.read_verdicts(spark, str(place / "v"))
    for name, summary in {
        "nr": summaries.newest_by_month(r),
        "nv": summaries.newest_by_month(v),
        "c": summaries.counts_by_month(v),
        "m": summaries.moments_by_month(r),
    }.items():
        summaries.write(summary, str(place / name))
    return {
        "facts": (r, v),
        "overview": (
            r,
            summaries.read_newest(spark, str(place / "nr")),
            summaries.read_newest(spark, str(place / "nv"), VERDICTS),
            summaries.read(spark, str(place / "c")),
        ),
        "baselines": summaries.type_baselines(summaries.read(spark, str(place / "m"))),
    }


@pytest.mark.parametrize("period", PERIODS)
def test_the_overview_from_summaries_is_that_of_the_facts(stored, period):
    got = machines.asset_overview_from_summaries(*stored["overview"], period)
    assert got.collect() == machines.asset_overview(*stored["facts"], period).collect()


def test_the_overview_over_the_edge_of_a_month(spark):
    """The bound lies in the middle of a month whose newest row is after it."""
    june = datetime(2024, 6, 30, tzinfo=timezone.utc)
    r = readings(
        spark,
        reading("M1", june.replace(day=2), health_pct=80.0),
        reading("M1", june.replace(day=20), health_pct=70.0),
        reading("M1", june.replace(day=28), health_pct=60.0),
        # Nothing in the month of the bound: the month before has the past.
        reading("M2", june.replace(month=5), health_pct=50.0),
        reading("M2", june, health_pct=40.0),
        # Nothing before the bound.
        reading("M3", june.replace(day=29), health_pct=30.0),
    )
    v = verdicts(spark, verdict("M1"), verdict("M2", june.replace(month=5)))
    for period in (ALL_TIME, Period(6, 2024), Period(5, 2024), Period(month=6)):
        got = machines.asset_overview_from_summaries(
            upsert.with_month(r),
            summaries.newest_by_month(r),
            summaries.newest_by_month(v),
            summaries.counts_by_month(v),
            period,
        )
        assert got.collect() == machines.asset_overview(r, v, period).collect()
        bare = machines.asset_overview_from_summaries(
            r,
            summaries.newest_by_month(r),
            summaries.newest_by_month(v),
            summaries.counts_by_month(v),
            period,
        )
        assert bare.collect() == got.collect()
    past = by(got, "machine_id")
    assert past["M1"].health_past_ago == 70.0 and past["M3"].health_past_ago is None


def test_the_overview_reads_one_month_of_readings(stored):
    text = formatted(machines.asset_overview_from_summaries(*stored["overview"]))
    scans = [s.split("\n\n")[0] for s in text.split("Scan parquet")[1:] if "Location" in s[:900]]
    of_readings = [s for s in scans if "/r]" in s]
    assert of_readings
    for scan in of_readings:
        partition = scan.split("PartitionFilters:")[1].split("\n")[0]
        assert "machinepulse_year" in partition and "subquery" in partition.lower()


@pytest.mark.parametrize("period", PERIODS)
def test_details_from_the_moments_are_those_of_all_readings(stored, period):
    got = machines.asset_detail(*stored["facts"], period, baselines=stored["baselines"])
    assert rows(got) == rows(machines.asset_detail(*stored["facts"], period))


def test_details_from_the_moments_read_no_reading_outside_the_period(stored):
    period = Period(6, 2024)
    text = formatted(machines.asset_detail(*stored["facts"], period, baselines=stored["baselines"]))
    scans = [s.split("\n\n")[0] for s in text.split("Scan parquet")[1:] if "PartitionFilters" in s.split("\n\n")[0] or "/r]" in s.split("\n\n")[0]]
    of_readings = [s for s in scans if "/r]" in s]
    assert len(of_readings) == 1 and "machinepulse_year" in of_readings[0].split("PartitionFilters:")[1]


# --- a month of every year -----------------------------------------------------


def test_a_month_of_every_year_reaches_unpartitioned_files(spark, tmp_path):
    r = testdata.readings(spark, SF)
    v = testdata.verdicts(spark, SF)
    with facts._microsecond_files(spark):
        r.write.parquet(str(tmp_path / "r"))
        v.write.parquet(str(tmp_path / "v"))
    r, v = (
        facts.read_readings(spark, str(tmp_path / "r")),
        facts.read_verdicts(spark, str(tmp_path / "v")),
    )
    years = facts.years_of(r)
    assert years == facts.years_of(v) == (2024, 2025)
    period, known = Period(month=6), Period(month=6).within(years)
    assert known.label == period.label
    for query in (
        lambda p: fleet.kpi_latest(r, p),
        lambda p: anomalies.anomaly_events(v, p),
        lambda p: machines.asset_trend(r, v, p),
    ):
        assert rows(query(known)) == rows(query(period))
        pushed = [line for line in formatted(query(known)).splitlines() if "PushedFilters" in line]
        assert pushed and all("Or(" in line and "GreaterThanOrEqual(timestamp," in line for line in pushed)
        assert not any("Or(" in line for line in formatted(query(period)).splitlines() if "PushedFilters" in line)


def test_rows_outside_of_the_known_years_are_still_found(spark):
    r = readings(spark, *[reading(moment=at(365.25 * k)) for k in range(-3, 4)], reading(moment=at(40)))
    v = verdicts(spark, *[verdict(moment=at(365.25 * k)) for k in range(-3, 4)], verdict(moment=at(40)))
    narrow = Period(month=6).within((2024, 2024))
    assert only(fleet.kpi_reading_count(r, narrow)).total_readings == 7
    assert only(fleet.kpi_anomaly_count(v, narrow)).anomaly_count == 7
    assert facts.years_of(r) == (2021, 2027)
    assert facts.years_of(r.limit(0)) is None and facts.years_of(v.limit(0)) is None


def test_every_key_from_summaries_is_registered_with_its_twin():
    keys = [k for k in catalog.queries() if "_from_s" in k]
    assert len(keys) == 12
    assert READINGS.names[0] == "machine_id"
