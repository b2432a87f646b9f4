"""Ordered scans and run merging, plain and in slices, against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators.sequences import merge_runs, ordered_scan
from tidemark.operators.skew import SLICE, large_groups, slice_groups


def rows(seed=1, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        # One key holds most rows; orders repeat and are missing now and then.
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", "c", None])
        t = None if rng.random() < 0.03 else rng.randrange(150)
        out.append((key, t, i, None if rng.random() < 0.6 else rng.randrange(9), rng.random() < 0.3))
    return out


SCHEMA = "k string, t int, id int, x int, glued boolean"


def position(r):
    return (r[1] is not None, r[1] or 0, r[2])


def grouped(data):
    groups = {}
    for r in sorted(data, key=position):
        groups.setdefault(r[0], []).append(r)
    return groups


def expected_scan(data):
    out = {}
    for group in grouped(data).values():
        for i, r in enumerate(group):
            before = [g[3] for g in group[: i + 1] if g[3] is not None]
            after = [g[3] for g in group[i:] if g[3] is not None]
            out[r[2]] = (
                group[i - 1][3] if i else None,
                group[i + 1][3] if i + 1 < len(group) else None,
                before[-1] if before else None,
                after[0] if after else None,
            )
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limit", [10**6, 25])
def test_scan_matches_brute_force(spark, seed, limit):
    data = rows(seed)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    sliced = slice_groups(df, ["k"], ["t", "id"], limit=limit)
    assert (SLICE in sliced.columns) == (limit == 25)
    got = ordered_scan(
        sliced, ["k"], ["t", "id"],
        previous={"p": "x"}, following={"n": "x"}, fill_forward={"f": "x"}, fill_backward={"b": "x"},
    )
    assert {r.id: (r.p, r.n, r.f, r.b) for r in got.collect()} == expected_scan(data)
    assert got.count() == len(data)


def test_only_large_groups_are_sliced(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    counts = {}
    for r in data:
        counts[r[0]] = counts.get(r[0], 0) + 1
    large = {k for k, n in counts.items() if n > 45}
    got = slice_groups(df, ["k"], ["t", "id"], limit=45).collect()
    assert len(got) == len(data)
    assert {r.k for r in got if r[SLICE] >= 0} == large
    assert {r.k for r in got if r[SLICE] < 0} == set(counts) - large
    assert len({r[SLICE] for r in got if r.k == "hot"}) > 2


def test_many_large_keys_of_three_columns(spark):
    """The keys are a table, not literals: planning does not depend on their number."""
    df = spark.range(100_000).select(
        (F.col("id") % 50_000).alias("a"), F.lit("b").alias("b"), F.lit(None).cast("int").alias("c"), "id"
    )
    assert large_groups(df, ["a", "b", "c"], limit=1).count() == 50_000
    began = time.time()
    cut = slice_groups(df, ["a", "b", "c"], ["id"], limit=1, slice_rows=10_000)
    scanned = ordered_scan(cut, ["a", "b", "c"], ["id"], previous={"p": "id"})
    assert len(scanned._jdf.queryExecution().optimizedPlan().toString()) < 50_000
    assert scanned.where("p = id - 50000").count() == 50_000
    assert time.time() - began < 120


@pytest.mark.parametrize("limit", [10**6, 25])
def test_merge_runs(spark, limit):
    data = rows(3)
    df = spark.createDataFrame(data, SCHEMA).withColumn("e", F.col("t") + 1).repartition(4)
    df = slice_groups(df, ["k"], ["t", "id"], limit=limit)
    merged = merge_runs(
        df, ["k"], ["t", "id"], start="t", end="e", glued="glued",
        first=["id"], last=["x"], last_by=["t", "id"],
    )
    want = set()
    for key, group in grouped(data).items():
        marks = []
        for i, r in enumerate(group):
            marks.append(
                (None if i and group[i - 1][4] else r[1], None if r[4] or r[1] is None else r[1] + 1, r)
            )
        runs = {}
        for i, (s, e, r) in enumerate(marks):
            start = next((m[0] for m in reversed(marks[: i + 1]) if m[0] is not None), None)
            end = next((m[1] for m in marks[i:] if m[1] is not None), None)
            runs.setdefault((start, end), []).append(r)
        for (start, end), members in runs.items():
            want.add((key, start, end, members[0][2], members[-1][3]))
    got = [tuple(r) for r in merged.select("k", "t", "e", "id", "x").collect()]
    assert set(got) == want and len(got) == len(want)
