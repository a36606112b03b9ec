"""Every registered query against its SQL twin, and invariants between queries."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from machinepulse import catalog
from machinepulse.functions.periods import Period
from machinepulse.operators import anomalies, fleet, machines
from machinepulse.sources import testdata
from oracle import statements
from tests.compare import duck, duck_rows, spark_rows
from tests.rows import by, only

# The smallest tables lack cases that the larger ones have, such as a newest
# reading without pressure.
SIZES = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]
SF = SIZES[0]
QUERIES = catalog.queries()
STATEMENTS = statements.all_statements()


@pytest.fixture(scope="module")
def connections():
    return {sf: duck(sf) for sf in SIZES}


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(STATEMENTS)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(STATEMENTS) <= set(entry_points.oracle_sql())


# A period adds filters and nothing else, so the larger tables suffice for it.
PERIODS = tuple(suffix for suffix in catalog.PERIODS if suffix)
CASES = [(n, sf) for n in QUERIES for sf in SIZES if sf != SF or not n.endswith(PERIODS)]


@pytest.mark.parametrize(("name", "sf"), CASES)
def test_twin(spark, connections, name, sf):
    assert spark_rows(QUERIES[name](spark, sf)) == duck_rows(connections[sf], STATEMENTS[name])


def test_entry(spark):
    assert entry_points.entry(spark).count() == 15


@pytest.fixture(scope="module")
def tables(spark):
    return testdata.readings(spark, SF).cache(), testdata.verdicts(spark, SF).cache()


def test_figures_and_overview_agree(tables):
    r, v = tables
    for period in (Period(), Period(6, 2024)):
        figures = only(fleet.kpi_summary(r, v, period))
        overview = machines.asset_overview(r, v, period)
        assert figures.total_machines == overview.count()
        statuses = overview.groupBy("health_status").count().collect()
        assert sum(row["count"] for row in statuses) == figures.total_machines
        summary = anomalies.anomaly_summary(r, v, period)
        assert only(anomalies.anomaly_total(summary)).total_anomalies == figures.anomaly_count
        assert only(fleet.kpi_filtered(overview)).total_machines == figures.total_machines


def test_histories_and_overview_agree(tables):
    r, v = tables
    counted = by(machines.asset_overview(r, v), "machine_id")
    listed = by(anomalies.anomaly_history(r, v).groupBy("machine_id").count(), "machine_id")
    for machine, row in counted.items():
        assert row.anomaly_history_count == (listed[machine]["count"] if machine in listed else 0)


def test_a_year_is_its_months(tables):
    r, v = tables
    for count in (
        lambda p: only(fleet.kpi_reading_count(r, p)).total_readings,
        lambda p: only(fleet.kpi_anomaly_count(v, p)).anomaly_count,
    ):
        months = sum(count(Period(month, 2024)) for month in range(1, 13))
        assert count(Period(year=2024)) == months
