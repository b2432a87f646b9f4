"""Running sums and exact quantiles against plain Python, with ties, nulls and hot values."""

import itertools
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.ranking import exact_quantiles, running_sums
from tidemark.plans import policy

P = (0.0, 0.025, 0.3, 0.5, 0.95, 1.0)


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, descending):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, 1, 2, 5])) for _ in range(500)] + [(7, 3)] * 300
    df = spark.createDataFrame(rows, "k int, v int").repartition(6)
    got, total = running_sums(df, "k", F.col("v"), descending=descending)
    keys = sorted({k for k, _ in rows if k is not None}, reverse=descending)
    steps = [sum(v or 0 for k, v in rows if k == key) for key in keys]
    want = dict(zip(keys, itertools.accumulate(steps)))
    assert {r.k: r.running for r in got.collect()} == want and total == sum(steps)
    assert {r.k: r.rows for r in got.collect()} == {k: sum(q == k for q, _ in rows) for k in keys}


def test_running_sums_of_decimals_and_of_nothing(spark):
    df = spark.createDataFrame([(Decimal("1.10"),), (Decimal("2.20"),), (Decimal("2.20"),)], "x decimal(10,2)")
    got, total = running_sums(df, "x", F.col("x"))
    assert [r.running for r in got.orderBy("x").collect()] == [Decimal("1.10"), Decimal("5.50")] and total == Decimal("5.50")
    none, total = running_sums(df.where("x > 9"), "x", F.col("x"))
    assert none.count() == 0 and total == 0


def test_running_sums_use_many_tasks(spark):
    """No window over one partition: neither plan holds a single-partition exchange but for totals."""
    df = spark.range(5000).withColumn("v", F.lit(1))
    got, _ = running_sums(df, "id", F.col("v"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan
    assert [r.running for r in got.orderBy("id").collect()] == list(range(1, 5001))


def test_trim_equals_the_window_form(spark):
    rng = random.Random(11)
    for _ in range(3):
        rows = [(y, f"p{i}", rng.choice([1, 2, 3, 50, 400]), 0, y - 1) for i in range(30) for y in (1, 2)]
        df = spark.createDataFrame(rows, "year int, port_iso3 string, n_visits long, policy int, after int")
        counts = sorted((r[2] for r in rows), reverse=True)
        total = sum(counts)
        cut = next((c for c in counts if sum(x for x in counts if x >= c) > 0.95 * total), None)
        small = {r[1] for r in rows if r[2] < cut}
        got = {tuple(r) for r in policy.trim_small_ports(df).collect()}
        assert got == {r for r in rows if r[1] not in small}
    assert policy.trim_small_ports(df.where("n_visits > 999")).count() == 0


def expected(rows):
    out = {}
    for g, v in rows:
        if v is not None and v == v:
            out.setdefault(g, []).append(v)
    return {g: (len(v), np.quantile(v, P).tolist()) for g, v in out.items()}


def check(df, rows, **more):
    got = {r.g: (r.n, r.quantiles) for r in exact_quantiles(df, "v", P, ["g"], **more).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    for g, (n, q) in want.items():
        assert got[g][0] == n and got[g][1] == pytest.approx(q, rel=1e-12, abs=1e-300), g


def test_quantiles_by_narrowing(spark):
    rng = random.Random(5)
    rows = [("wide", rng.choice([-1, 1]) * 10.0 ** rng.uniform(-200, 200)) for _ in range(6000)]
    rows += [("hot", rng.choice([1.0, 1.0, 1.0, 1.0 + 2**-52, 5.0, rng.random()])) for _ in range(5000)]
    rows += [("same", 3.25)] * 1000 + [("one", 7.0), ("two", -1.0), ("two", 4.0), (None, 2.0), (None, 3.0)]
    rows += [("one", None), ("void", None), ("one", float("nan"))]
    rows += [("edge", float(v)) for v in [0] * 700 + [1] * 700 + list(range(2, 300))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    check(df, rows, most=20)


def test_quantiles_of_the_whole_and_of_nothing(spark):
    df = spark.createDataFrame([(i * 37 % 1001, 1) for i in range(1001)], "q long, n int")
    (row,) = exact_quantiles(df, "q", [0.5, 0.9995]).collect()
    assert (row.n, row.quantiles) == (1001, pytest.approx([500.0, 999.5]))
    assert exact_quantiles(df.where("q < 0"), "q", [0.5]).count() == 0
    with pytest.raises(ValueError):
        exact_quantiles(df, "q", [1.5])


def test_group_names_may_clash(spark):
    rows = [(i % 2, i % 3, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, n int, lo double")
    got = exact_quantiles(df, "lo", [0.5], ["k", "n"]).toDF("k", "n", "count", "q").collect()
    assert {(r.k, r.n): r.q[0] for r in got} == {
        (a, b): float(np.median([v for x, y, v in rows if (x, y) == (a, b)])) for a in range(2) for b in range(3)
    }
