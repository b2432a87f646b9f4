"""Stored voyages are read without an exchange on their side, and give the same results."""

import uuid

import pytest

from tidemark.params import EncounterParams
from tidemark.plans import encounters, ports, voyages
from workload.inputs import ENCOUNTERS, VOYAGES, Inputs
from workload.voyage_queries import attributes, good

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def q(spark):
    return Inputs(spark, SF)


@pytest.fixture(scope="module")
def core(q):
    return voyages.voyages_from_legs(q.legs(), q.anchorages(), VOYAGES)


@pytest.fixture(scope="module")
def stored(spark, core, tmp_path_factory):
    name = f"voyages_{uuid.uuid4().hex}"
    yield voyages.store_voyages(core, name, str(tmp_path_factory.mktemp("stored") / "v"))
    spark.sql(f"DROP TABLE {name}")


@pytest.fixture
def no_broadcast(spark):
    """Small tables are joined like large ones, without filters worked out beforehand."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.optimizer.runtime.bloomFilter.enabled")


def steps_above_scans(df, table):
    """Operators from each scan of the table up to the first join."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    found = []
    for i, line in enumerate(lines):
        if "Scan parquet" in line and table in line:
            steps, at = [], depth[i]
            for j in range(i - 1, -1, -1):
                if depth[j] < at:
                    at = depth[j]
                    steps.append(lines[j].strip(" :+-*"))
                    if "Join" in lines[j]:
                        break
            found.append(steps)
    return found


def check(df, stored):
    table = stored._jdf.queryExecution().analyzed().toString().split("voyages_")[1][:32]
    scans = steps_above_scans(df, table)
    assert scans
    for steps in scans:
        assert "Join" in steps[-1] and not any("Exchange" in s for s in steps), steps


def rows(df):
    return sorted(map(str, df.collect()))


def test_it_is_the_same_table(core, stored):
    assert rows(core.select(*sorted(core.columns))) == rows(stored.select(*sorted(core.columns)))


def test_fishing_features(q, core, stored, no_broadcast):
    def build(trips):
        return voyages.fishing_features_of(trips, q.anchorages(), q.port_risk(), good(q), attributes(q), VOYAGES)

    check(build(stored), stored)
    assert rows(build(stored)) == rows(build(core)) != []


def test_carrier_features(q, core, stored, no_broadcast):
    pairs = encounters.encounter_pairs(
        q.encounters(), q.encounter_daily(), q.carriers(), q.vessel_info(), q.anchorages(), ENCOUNTERS
    )
    check(encounters.encounters_in_trips(stored, pairs), stored)

    def build(trips):
        return encounters.carrier_features_of(
            trips, q.anchorages(), q.port_risk(), q.encounters(), q.encounter_daily(), q.carriers(), q.vessel_info(),
            q.country_codes(), ENCOUNTERS,
        )

    assert rows(build(stored)) == rows(build(core)) != []
    assert isinstance(ENCOUNTERS, EncounterParams)


def test_visits_touching_voyages(q, core, stored, no_broadcast):
    visits = q.study_visits().withColumnRenamed("vessel_id", "ssvid")
    got = ports.touching_voyages(visits, stored)
    check(got, stored)
    assert rows(got) == rows(ports.touching_voyages(visits, core))
