"""Plans over stored tables: what is pushed down, shuffled, sorted."""

from __future__ import annotations

import pytest

from machinepulse import catalog
from machinepulse.functions.periods import Period
from machinepulse.operators import anomalies, fleet, guide, machines, turns
from machinepulse.plans import context
from machinepulse.sources import facts, testdata

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("facts")
    facts.write_readings(testdata.readings(spark, SF), str(place / "r"))
    facts.write_verdicts(testdata.verdicts(spark, SF), str(place / "v"))
    return (
        facts.read_readings(spark, str(place / "r")),
        facts.read_verdicts(spark, str(place / "v")),
    )


@pytest.fixture(scope="module")
def bucketed(spark):
    facts.save_for_matching(
        testdata.readings(spark, SF), testdata.verdicts(spark, SF), 4, "plan_r", "plan_v"
    )
    return spark.table("plan_r"), spark.table("plan_v")


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    query = df._jdf.queryExecution()
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return query.explainString(mode)


def test_a_year_reaches_the_files(stored):
    r, v = stored
    text = formatted(fleet.kpi_latest(r, Period(year=2024)))
    assert "GreaterThanOrEqual(timestamp," in text and "LessThan(timestamp," in text
    assert "(machinepulse_year#" in text.split("PartitionFilters:")[1].split("\n")[0]
    text = formatted(fleet.kpi_anomaly_count(v, Period(6, 2024)))
    assert "GreaterThanOrEqual(timestamp,1717200000000000000)" in text
    assert "EqualTo(is_anomaly,true)" in text
    partition = text.split("PartitionFilters:")[1].split("\n")[0]
    assert "machinepulse_year#" in partition and "machinepulse_month#" in partition


def test_a_month_of_every_year_prunes_directories(stored):
    partition = formatted(fleet.kpi_reading_count(stored[0], Period(month=6)))
    assert "machinepulse_month#" in partition.split("PartitionFilters:")[1].split("\n")[0]


def test_a_machine_reaches_the_files(stored):
    text = formatted(machines.asset_trend(*stored, machine_id="M00001"))
    assert text.count("EqualTo(machine_id,M00001)") == 2


def test_only_needed_columns_are_read(stored):
    text = formatted(fleet.kpi_latest(stored[0]))
    schema = text.split("ReadSchema:")[1].split("\n")[0]
    assert "temperature" not in schema and "health_pct" in schema
    for name in ("is_running", "operational_time"):
        assert name not in formatted(anomalies.anomaly_stats(*stored)).split("ReadSchema:")[1]


def test_machines_are_reduced_before_the_shuffle(stored, no_broadcast):
    text = plan(machines.machine_snapshot(*stored))
    assert text.count("Exchange hashpartitioning(machine_id") == 2
    assert "row_number(), 1, Partial" in text and text.count("partial_max(struct(") == 1


def test_matching_spreads_a_machine_over_its_times(stored, no_broadcast):
    text = plan(anomalies.anomaly_history(*stored))
    joined = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("machine_id" in line and "timestamp" in line for line in joined) == 2


def test_bucketed_tables_are_matched_without_a_shuffle(bucketed, no_broadcast):
    text = plan(anomalies.anomaly_latest_reading(*bucketed))
    assert "SortMergeJoin" in text
    below = text.split("SortMergeJoin")[1]
    assert "Exchange" not in below and below.count("Bucketed: true") == 2


@pytest.mark.parametrize("limit", [5, 500])
def test_limits_apply_before_the_shuffle(stored, limit):
    text = plan(anomalies.anomaly_history(*stored, limit=limit))
    assert f"row_number(), {limit}, Partial" in text
    assert f"row_number(), {limit}, Final" in text


@pytest.mark.parametrize("limit", [500, 5000])
def test_a_group_is_cut_in_pieces_before_its_last_shuffle(stored, limit):
    text = plan(anomalies.anomaly_events(stored[1], limit=limit))
    last, pieces = text.split("Exchange hashpartitioning(machine_id")[1:]
    assert f"machinepulse_place#" in last and f"<= {limit})" in last
    assert "machinepulse_piece" in pieces.splitlines()[0]


def test_two_steps_keep_the_rows_of_one(stored):
    def rows(limit):
        found = anomalies.anomaly_events(stored[1], limit=limit).collect()
        return {(row.machine_id, row.timestamp) for row in found}

    newest = {}
    for machine, timestamp in rows(None):
        newest.setdefault(machine, []).append(timestamp)
    expected = {(m, t) for m, times in newest.items() for t in sorted(times)[-3:]}
    assert rows(3) == expected and rows(5000) == rows(None)


DERIVED = (
    "kpi_filtered kpi_filtered_all active_sensor_flags asset_state sensor_range_check "
    "sensor_explanation health_band trend_direction rul_days priority"
).split()


@pytest.mark.parametrize("name", DERIVED)
def test_what_is_derived_from_assets_sorts_nothing(spark, name):
    assert "rangepartitioning" not in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("query", [fleet.kpi_latest, lambda r: fleet.kpi_summary(r, r)])
def test_newest_health_is_no_sorted_aggregate(stored, query):
    if query is not fleet.kpi_latest:
        text = plan(fleet.kpi_summary(*stored))
    else:
        text = plan(query(stored[0]))
    assert "SortAggregate" not in text and "row_number(), 1, Partial" in text


def test_a_machine_table_spares_readings_outside_the_period(spark, stored, tmp_path):
    facts.write_machines(stored[0], str(tmp_path / "m"))
    listed = facts.read_machines(spark, str(tmp_path / "m"))
    period = Period(6, 2024)
    for build in (
        anomalies.anomaly_stats, anomalies.machine_anomaly_history, anomalies.anomaly_summary
    ):
        with_table = build(*stored, period, listed=listed)
        scans = [
            scan.split("\n(")[0]
            for scan in formatted(with_table).split("Scan parquet")[1:]
            if "PartitionFilters" in scan.split("\n\n")[0]
        ]
        assert scans and all("machinepulse_year#" in scan for scan in scans)
        key = lambda row: tuple(map(str, row))
        plain = build(*stored, period)
        assert sorted(with_table.collect(), key=key) == sorted(plain.collect(), key=key)


def test_prompts_reduce_only_the_asked_machines(spark, no_broadcast):
    text = plan(QUERIES["prompt_context"](spark, SF))
    # Both facts are cut to the asked machines before they are reduced or matched.
    assert text.count("LeftSemi") >= 2


def test_turns_are_limited_before_their_one_shuffle(spark):
    text = plan(turns.recent_turns(testdata.messages(spark, SF)))
    assert "row_number(), 6, Partial" in text
    assert text.count("Exchange") == 1


def test_guide_texts_are_shuffled_once(spark):
    assert plan(guide.guide_for_type(testdata.guide_pages(spark, SF))).count("Exchange") == 1


def test_profiles_join_no_texts(spark, no_broadcast):
    text = plan(guide.guide_page_profile(testdata.guide_pages(spark, SF)))
    exchanged = [line for line in text.splitlines() if "Exchange" in line]
    assert exchanged and "content" not in "".join(exchanged)


def test_fleet_lines_share_the_rows_of_the_figures(stored):
    df = context.fleet_context(*stored)
    df.collect()
    # The figures need no verdicts per machine, so the readings are all there
    # is to share.
    assert "ReusedExchange" in plan(df)


def test_an_asset_is_focused_without_a_total_sort(stored):
    text = plan(machines.focus_machine(*stored))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


QUERIES = catalog.queries()
# A period adds filters to the scans and nothing else.
SUFFIXES = tuple(suffix for suffix in catalog.PERIODS if suffix)


@pytest.mark.parametrize("name", [name for name in QUERIES if not name.endswith(SUFFIXES)])
def test_no_python_and_no_pairing_of_all_rows(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for node in ("Python", "Pandas", "NestedLoop", "CartesianProduct", "MapInArrow"):
        assert node not in text, node


