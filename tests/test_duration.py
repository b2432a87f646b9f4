"""Duration model: planted variances and levels, the exact equations, the intervals."""

import numpy as np
import pytest

from tidemark.plans import duration, policy

SCHEMA = "g string, p string, c string, n bigint, sum_y double, sum_y2 double"


def planted(seed, ports, classes, sizes=(1, 40), sp=0.5, sc=0.3, se=0.8):
    """Cells of unequal size with random port and class levels."""
    rng = np.random.default_rng(seed)
    means = {"a": 1.0, "b": 1.6, "c": 2.1}
    up, uc = rng.normal(0, sp, ports), rng.normal(0, sc, classes)
    rows = []
    for g, m in means.items():
        for i in range(ports):
            for j in range(classes):
                n = int(rng.integers(*sizes))
                if rng.random() < 0.3 or n == 0:
                    continue
                y = m + up[i] + uc[j] + rng.normal(0, se, n)
                rows.append((g, f"p{i}", f"c{j}", n, float(y.sum()), float((y * y).sum())))
    return rows, means


def dense(rows, variances):
    """Generalised least squares with the full covariance of the cell means."""
    se, sp, sc = variances
    n, y = np.array([r[3] for r in rows], float), np.array([r[4] / r[3] for r in rows])
    one = [np.array([[r[k] == v for v in sorted({q[k] for q in rows})] for r in rows], float) for k in range(3)]
    v = sp * one[1] @ one[1].T + sc * one[2] @ one[2].T + np.diag(se / n)
    w = np.linalg.inv(v)
    beta = np.linalg.solve(one[0].T @ w @ one[0], one[0].T @ w @ y)
    left = w @ (y - one[0] @ beta)
    return beta, sp * one[1].T @ left, sc * one[2].T @ left


def test_planted_variances_are_recovered(spark):
    rows, means = planted(3, 120, 60, (1, 6))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.factor: r for r in duration.variance_components(df, "g", ["p", "c"]).collect()}
    assert got["residual"].variance == pytest.approx(0.64, rel=0.05)
    assert got["p"].variance == pytest.approx(0.25, rel=0.3)
    assert got["c"].variance == pytest.approx(0.09, rel=0.4)
    assert got["p"].ratio == pytest.approx(got["residual"].variance / got["p"].variance)
    level = {r.category: r.estimate for r in duration.adjusted_levels(df, "g", ["p", "c"]).where("factor = 'g'").collect()}
    # The general level cannot be told from the mean of the random levels; differences can.
    assert level["b"] - level["a"] == pytest.approx(means["b"] - means["a"], abs=0.05)
    assert level["c"] - level["a"] == pytest.approx(means["c"] - means["a"], abs=0.05)


def test_moments_are_unbiased():
    """Expected quadratic forms against their average over simulated data."""
    from tidemark.plans.duration import CrossedModel

    rng = np.random.default_rng(8)
    place = rng.integers(0, [3, 7, 5], (60, 3))
    n = rng.integers(1, 9, 60).astype(float)
    counts = [[None] * 3 for _ in range(3)]
    for a in range(3):
        for b in range(a, 3):
            counts[a][b] = np.zeros((place[:, a].max() + 1, place[:, b].max() + 1))
            np.add.at(counts[a][b], (place[:, a], place[:, b]), n)
    model = CrossedModel(["g", "p", "c"], [list(range(len(counts[a][a]))) for a in range(3)], counts, 60)
    size = n.astype(int)
    found = []
    for _ in range(4000):
        effects = [rng.normal(0, s, len(counts[a][a])) for a, s in ((0, 0.0), (1, 0.7), (2, 0.4))]
        y = np.repeat(sum(e[place[:, a]] for a, e in enumerate(effects)), size) + rng.normal(0, 1.1, size.sum())
        sums = [np.bincount(np.repeat(place[:, a], size), y, len(counts[a][a])) for a in range(3)]
        found.append(np.linalg.solve(model.moments, model.quadratic_forms(sums, float(y @ y))))
    assert np.mean(found, axis=0) == pytest.approx([1.21, 0.49, 0.16], rel=0.05)


def test_levels_solve_the_full_model(spark):
    rows, _ = planted(5, 9, 4)
    df = spark.createDataFrame(rows + [("a", "p0", None, 5, 9.0, 30.0), ("a", "p0", "c0", 0, 0.0, 0.0)], SCHEMA)
    v = {r.factor: r.variance for r in duration.variance_components(df, "g", ["p", "c"]).collect()}
    want = dense(rows, (v["residual"], v["p"], v["c"]))
    for f, w in zip("gpc", want):
        got = duration.adjusted_levels(df, "g", ["p", "c"]).where(f"factor = '{f}'").orderBy("category").collect()
        assert [r.estimate for r in got] == pytest.approx(w.tolist(), abs=1e-9)


def test_no_spread_between_levels(spark):
    """A variance estimated below zero is zero, and its levels vanish."""
    rows = [(g, p, "x", 10, 10 * m, 10 * m * m + 10.0) for g, m in (("a", 1.0), ("b", 2.0)) for p in ("p", "q", "r")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.factor: (r.variance, r.ratio) for r in duration.variance_components(df, "g", ["p"]).collect()}
    assert got["p"] == (0.0, None)
    level = {(r.factor, r.category): r.estimate for r in duration.adjusted_levels(df, "g", ["p"]).collect()}
    assert level == pytest.approx({("g", "a"): 1.0, ("g", "b"): 2.0, ("p", "p"): 0.0, ("p", "q"): 0.0, ("p", "r"): 0.0})


def test_intervals_hold_the_adjusted_mean_and_widen_with_port_spread(spark):
    widths = []
    for sp in (0.05, 1.0):
        rows, _ = planted(7, 30, 12, sp=sp)
        df = spark.createDataFrame(rows, SCHEMA)
        got = duration.bootstrap_intervals(df, "g", ["p", "c"], replicates=300, drop=["c"]).collect()
        means = {r.category: r.estimate for r in duration.adjusted_levels(df, "g", ["p", "c"]).where("factor = 'g'").collect()}
        assert {r.category for r in got} == {"a", "b"}
        assert all(r.mean == pytest.approx(means[r.category]) and r.lower < r.mean < r.upper for r in got)
        widths.append(np.mean([r.upper - r.lower for r in got]))
    # The mean moves with the average of 30 port levels and of 12 class levels.
    assert widths[1] > 1.6 * widths[0] and widths[1] == pytest.approx(2 * 1.96 * np.sqrt(1 / 30 + 0.09 / 12), rel=0.35)


def test_intervals_cover_the_truth_as_often_as_they_say(spark):
    """A planted mean lies in its 80 % interval in about 80 % of the data sets."""
    hits = 0
    rows_of = [planted(100 + i, 25, 4, (1, 8)) for i in range(12)]
    for rows, means in rows_of:
        got = duration.bootstrap_intervals(spark.createDataFrame(rows, SCHEMA), "g", ["p", "c"], replicates=200, level=0.8).collect()
        hits += sum(r.lower <= means[r.category] <= r.upper for r in got)
    assert 18 <= hits <= 36


def test_study_from_the_port_stop_table(spark):
    flags = ["CHN", "PAN", "ESP", None]
    rng = np.random.default_rng(1)
    stops = [
        (flags[i % 4], ["PRT", "ESP", "HKG", "MAR"][i % 7 % 4], ["trawlers", "driftnets", "squid_jigger"][i % 3], int(rng.integers(20, 4000)))
        for i in range(400)
    ]
    df = spark.createDataFrame(stops, "flag string, port_iso3 string, vessel_class string, duration_min long")
    zones = spark.createDataFrame([("200NM", "ZZZ", "ZZZ")], "eez_type string, territory1_iso3 string, sovereign1_iso3 string")
    study = duration.port_stop_study(df, policy.sovereign_pairs(zones), replicates=50)
    cells = study.cells.collect()
    # Own ports, territories of the own sovereign, short stops and incomplete rows are left out.
    foreign = [s for s in stops if s[0] and s[3] >= 60 and {"HKG": "CHN"}.get(s[1], s[1]) != s[0]]
    assert sum(r.n for r in cells) == len(foreign)
    assert {r.flag_group for r in cells} == {"china", "group2", "group3"}
    assert {r.category for r in study.flag_intervals.collect()} == {"china", "group2", "group3"}
    assert {r.category for r in study.gear_intervals.collect()} == {"trawlers", "squid_jigger"}
    assert {r.factor for r in study.by_gear.collect()} == {"vessel_class", "port_iso3"}
