"""Boosted trees on cells: splits and leaves by brute force, column draws, unseen combinations."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import classes
from tidemark.plans import boosting, risk


def plain_tree(rows, columns, depth, penalty, rate):
    """Prediction of a tree grown by trying every split; rows: (bits, weight, residual)."""

    def value(part):
        return rate * sum(w * r for _, w, r in part) / (sum(w for _, w, _ in part) + penalty)

    def strength(part):
        return sum(w * r for _, w, r in part) ** 2 / (sum(w for _, w, _ in part) + penalty)

    def build(part, left):
        best = (1e-9, None)
        for c in columns if left else ():
            on, off = [p for p in part if p[0] >> c & 1], [p for p in part if not p[0] >> c & 1]
            if sum(w for _, w, _ in on) >= 1 and sum(w for _, w, _ in off) >= 1:
                gain = strength(on) + strength(off) - strength(part)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, c)
        if best[1] is None:
            return lambda bits: value(part)
        c = best[1]
        on, off = (build([p for p in part if (p[0] >> c & 1) == b], left - 1) for b in (1, 0))
        return lambda bits: on(bits) if bits >> c & 1 else off(bits)

    return build(rows, depth)


@pytest.mark.parametrize("seed", range(6))
def test_a_tree_equals_exhaustive_search(seed):
    rng = np.random.default_rng(seed)
    masks = rng.choice(1 << 6, 30, replace=False)
    weight, residual = rng.integers(1, 9, 30).astype(float), rng.normal(size=30)
    params = boosting.BoostParams(rate=0.4, depth=int(seed) + 1, penalty=float(seed % 2))
    tree = boosting.grow(masks, weight, weight * residual, range(6), params)
    plain = plain_tree(list(zip(masks.tolist(), weight, residual)), range(6), params.depth, params.penalty, params.rate)
    every = np.arange(1 << 6)
    got = boosting._leaf_values(tree, every, params.depth)
    assert got == pytest.approx([plain(int(m)) for m in every])


def test_each_tree_draws_its_own_columns():
    rng = np.random.default_rng(0)
    masks = np.arange(1 << 10)
    mean = rng.normal(size=len(masks))
    forest = boosting.boost(masks, np.ones(len(masks)), mean, 10, boosting.BoostParams(trees=20))
    used = [frozenset(t.column[t.column >= 0].tolist()) for t in forest.trees]
    assert all(len(u) <= 6 for u in used) and len(set(used)) > 10
    assert frozenset().union(*used) == set(range(10))


def test_same_forest_whatever_the_rows_are_grouped_by(spark):
    rows = [(i % 2, i % 3 == 0, i % 5 < 2, float(i % 7)) for i in range(300)]
    df = spark.createDataFrame([(int(a), int(b), int(c), y) for a, b, c, y in rows], "a int, b int, c int, y double")
    flags = [F.col(c) == 1 for c in "abc"]
    first = boosting.fit(df.repartition(7), flags, "y", boosting.BoostParams(trees=5))
    second = boosting.fit(df.coalesce(1), flags, "y", boosting.BoostParams(trees=5))
    every = np.arange(8)
    assert first.predict(every) == pytest.approx(second.predict(every), rel=1e-12)


def test_an_unseen_combination_is_scored_by_its_parts(spark):
    """Effects add up: carriers that met two classes separately are seen, both together are not.

    Trees of one split add up as well; deep ones come closer than the mean of the seen.
    """
    names = list(risk.CARRIER_COLUMNS)
    effect = {"with_china": 2.0, "with_trawlers": 1.0, "with_group1": -1.0, "any_loitering": 0.5}
    picks = [c for k in range(5) for c in itertools.combinations(effect, k)]
    seen = [p for p in picks if not {"with_china", "with_trawlers"} <= set(p)]

    def frame(parts):
        rows = [(*(int(c in p) for c in names), float(sum(effect[c] for c in p))) for p in parts for _ in range(20)]
        return spark.createDataFrame(rows, ", ".join(f"`{c}` int" for c in names) + ", risk_score double")

    unseen = frame([p for p in picks if p not in seen]).withColumnRenamed("risk_score", "truth")
    known = frame(seen)
    got = risk.impute_boosted(unseen, known, (), columns=names, rate=0.3, trees=400, depth=1, penalty=0.0).collect()
    assert max(abs(r.risk_score - r.truth) for r in got) < 0.05
    mean = known.agg(F.avg("risk_score")).first()[0]
    got = risk.impute_boosted(unseen, known, (), columns=names, rate=0.01, trees=300).collect()
    assert sum((r.risk_score - r.truth) ** 2 for r in got) < 0.5 * sum((mean - r.truth) ** 2 for r in got)


def test_missing_scores_and_categories(spark):
    rows = [("a", 1.0), ("a", None), ("b", 3.0), (None, 2.0)]
    seen = spark.createDataFrame(rows, "f string, risk_score double")
    trips = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "f string")
    got = {r.f: r.risk_score for r in risk.impute_boosted(trips, seen, ["f"], rate=1.0, trees=1, depth=9, column_share=1.0, penalty=0.0).collect()}
    # Neither a nor b: the rest of the observed rows.
    assert got == pytest.approx({"a": 1.0, "b": 3.0, "z": 2.0, None: 2.0})
    with pytest.raises(ValueError):
        risk.impute_boosted(trips, seen.where("risk_score > 9"), ["f"])
    with pytest.raises(ValueError):
        boosting.bit_mask([F.lit(True)] * 63)


def test_tables_of_the_imputation(spark):
    rows = [
        (f"t{i}", "v", flag, "trawlers" if i % 2 else "squid_jigger", "1_3m", int(i % 3 > 0), 0, 0, int(flag == "china") * 3)
        for i, flag in enumerate(["china", "group1", "other"] * 30)
    ]
    df = spark.createDataFrame(rows, "trip_id string, ssvid string, flag_group string, vessel_class string, time_at_sea string,"
                               " iuu_no_to long, iuu_low_to long, iuu_med_to long, iuu_high_to long")
    df = df.withColumns({"trip_start": F.current_timestamp(), "trip_end": F.current_timestamp()})
    parts = risk.imputation_tables(df)
    seen, again, guessed = (parts[p].collect() for p in ("observed", "in_sample", "predicted"))
    assert len(seen) == len(again) and len(seen) + len(guessed) == 90
    truth = {r.trip_id: r for r in seen}
    off = [r.risk_score - truth[r.trip_id].risk_score for r in again]
    error = parts["error"].first()
    assert error.n == len(seen) and error.rmse == pytest.approx(np.sqrt(np.mean(np.square(off))))
    assert error.class_share == pytest.approx(np.mean([r.risk_class == truth[r.trip_id].risk_class for r in again]))
    assert all(r.risk_class == (0 if r.risk_score < classes.RISK_THRESHOLDS[0] else 1 if r.risk_score < 2 else 2) for r in guessed)
