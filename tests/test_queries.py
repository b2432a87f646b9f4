"""Every registered query against its check SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from tidemark.operators.skew import large_groups
from tidemark.plans import ports, voyages
from tools.check import compare, open_db
from workload.inputs import Inputs

SF = "/root/testdata/sf0.001"
# Grouped scans, run again with every group of more than 3 rows in slices.
SLICED = [
    "k08_voyages_from_legs", "k40_stop_durations", "k38_plausible_stops", "k39_close_stops_joined",
    "e4_e5_fills", "e1_e2_neighbours",
]


@pytest.fixture(scope="module")
def db():
    return open_db(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, db, name):
    status, rows, note = compare(spark, db, name, SF)
    assert status in ("ok", "rows"), note
    assert rows > 0


@pytest.mark.parametrize("name", SLICED)
def test_query_in_slices(spark, db, small_groups, name):
    status, rows, note = compare(spark, db, name, SF)
    assert status == "ok", note


def test_the_slice_limit_is_exceeded(spark, small_groups):
    q = Inputs(spark, SF)
    assert large_groups(q.table("orders"), ["o_custkey"]).count() > 10
    assert large_groups(q.legs(), voyages.KEY).count() > 10
    assert large_groups(ports.explode_events(q.port_visits()), ports.VISIT).count() > 10


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_names_are_paired():
    assert set(entry.oracle_sql()) <= set(entry.queries())
