"""Effort maps, risk scores and attribution."""

from __future__ import annotations

from math import factorial

from pyspark.sql import functions as F

from tidemark.functions import classes
from tidemark.plans import attribution, effort, report, risk
from workload.inputs import Inputs
from workload.registry import query

CELL = "lat_bin:d lon_bin:d risk_class:i fishing_hours:d"


@query("k45_effort_grid", CELL, "effort", "effort")
def effort_grid(q: Inputs):
    return effort.effort_grid(q.positions(), q.segments(), q.trip_risk())


@query("k46_effort_per_area", CELL + " km2:d fishing_hours_km2:d", "effort_area", "effort_area")
def effort_area(q: Inputs):
    return effort.with_area(effort_grid(q))


@query("l20_scaled_effort", CELL + " scaled:d", "scaled_effort", "scaled_effort")
def scaled(q: Inputs):
    return effort.scaled_effort(effort_area(q))


GRID = "risk_class:i gx:i gy:i lon:d lat:d relative:d"
_RELATIVE = "(SELECT *, density * 1000 AS relative FROM {})"


@query("l21_density_map", GRID, _RELATIVE.format("density"), "density")
def density(q: Inputs):
    return effort.density_map(scaled(q)).withColumn("relative", F.col("density") * 1000)


@query(
    "l22_dense_region", GRID,
    _RELATIVE.format(
        "(SELECT *, quantile_cont(density, 0.95) OVER (PARTITION BY risk_class) AS cut FROM density) WHERE density > cut"
    ),
    "density",
)
def dense_region(q: Inputs):
    return effort.dense_region(effort.density_map(scaled(q))).withColumn("relative", F.col("density") * 1000)


# -- risk scores ---------------------------------------------------------------------------------


@query(
    "l01_risk_score", "trip_id risk_score:d",
    "(SELECT *, iuu_low_to / 3.0::DOUBLE + iuu_med_to * 2 / 3.0::DOUBLE + iuu_high_to - iuu_no_to AS risk_score FROM trip_rows)",
    "trip_rows",
)
def risk_score(q: Inputs):
    votes = [F.col(c) for c in risk.vote_columns("iuu")]
    return q.trips().withColumn("risk_score", classes.risk_score(*votes))


@query("l02_observed_trips", "trip_id flag_group vessel_class time_at_sea risk_score:d", "observed_trips", "observed_trips")
def observed(q: Inputs):
    return risk.observed_trips(risk.complete_trips(q.trips()))


@query(
    "l02_observed_trips_all_votes", "trip_id risk_score:d",
    "(SELECT * FROM observed_trips WHERE iuu_no_to + iuu_low_to + iuu_med_to + iuu_high_to > 0)", "observed_trips",
)
def observed_all_votes(q: Inputs):
    return risk.observed_trips(risk.complete_trips(q.trips()), null_votes="propagate")


_HOT = [f"{c}_{v}" for c, values in risk.CATEGORIES.items() for v in values]


@query(
    "l03_category_design", "trip_id " + " ".join(f"{c}:i" for c in _HOT),
    "(SELECT trip_id, "
    + ", ".join(
        f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"" for c, values in risk.CATEGORIES.items() for v in values
    )
    + " FROM complete_trips)",
    "complete_trips",
)
def design(q: Inputs):
    return risk.one_hot(risk.complete_trips(q.trips()))


_MET = [f"with_{v}" for v in (*classes.FLAG_GROUP_NAMES, *classes.GEAR_CLASS_NAMES)]
_CARRIER_HOT = [f"time_at_sea_{v}" for v in classes.TIME_AT_SEA_NAMES] + [
    f"carrier_flag_group_{v}" for v in classes.FLAG_GROUP_NAMES
]


@query(
    "l04_carrier_trip_design",
    "trip_id time_at_sea carrier_flag_group to_iuu_no:i to_iuu_high:i to_la_med:i loitering:i no_loitering:i "
    + " ".join(f"{c}:i" for c in (*_CARRIER_HOT, *_MET)),
    "(SELECT *, 1 - loitering AS no_loitering, "
    + ", ".join(f"CASE WHEN time_at_sea = '{v}' THEN 1 ELSE 0 END AS \"time_at_sea_{v}\"" for v in classes.TIME_AT_SEA_NAMES)
    + ", "
    + ", ".join(
        f"CASE WHEN carrier_flag_group = '{v}' THEN 1 ELSE 0 END AS carrier_flag_group_{v}" for v in classes.FLAG_GROUP_NAMES
    )
    + " FROM (SELECT trip_id, first(time_at_sea) AS time_at_sea, first(carrier_flag_group) AS carrier_flag_group,"
    " first(to_iuu_no) AS to_iuu_no, first(to_iuu_high) AS to_iuu_high, first(to_la_med) AS to_la_med,"
    " (trip_id IN (SELECT trip_id FROM carrier_loitering WHERE ssvid IS NOT NULL))::INT AS loitering, "
    + ", ".join(f"max((neighbor_flag_group = '{v}')::INT) AS with_{v}" for v in classes.FLAG_GROUP_NAMES)
    + ", "
    + ", ".join(f"max((neighbor_vessel_class = '{v}')::INT) AS with_{v}" for v in classes.GEAR_CLASS_NAMES)
    + " FROM carrier_rows WHERE neighbor_vessel_class IS NOT NULL GROUP BY trip_id))",
    "carrier_rows", "carrier_loitering",
)
def carrier_design(q: Inputs):
    return risk.carrier_design(q.carrier_rows(), q.carrier_loitering())


@query("l05_imputed_by_cell_mean", "trip_id risk_score:d", "predicted_trips", "predicted_trips")
def imputed(q: Inputs):
    seen = observed(q)
    complete = risk.complete_trips(q.trips())
    return risk.impute_cell_mean(risk.seen_classes(risk.unobserved(complete, seen), seen), seen)


@query("l05_imputed_by_boosted_trees", "trip_id risk_score:d")
def boosted(q: Inputs):
    seen = observed(q)
    complete = risk.complete_trips(q.trips())
    rest = risk.seen_classes(risk.unobserved(complete, seen), seen)
    return risk.impute_boosted(rest, seen)


@query(
    "l05_l06_saturated_tree_in_sample", "trip_id risk_score:d",
    """(SELECT trip_id, avg(risk_score) OVER (PARTITION BY flag_group, vessel_class, time_at_sea) AS risk_score
        FROM observed_trips WHERE risk_score IS NOT NULL)""",
    "observed_trips",
)
def saturated_tree(q: Inputs):
    """One full tree of weight 1 over all columns is the cell mean, here on the observed trips."""
    seen = observed(q).where("risk_score IS NOT NULL")
    return risk.impute_boosted(seen, seen, rate=1.0, trees=1, depth=20, column_share=1.0, penalty=0.0)


# Few small trees over all columns, which SQL can grow as well.
SMALL = {"rate": 0.3, "trees": 3, "depth": 2, "column_share": 1.0}


def _trees_sql(rows: str, columns: dict[str, str]) -> str:
    """WITH parts of ``trees(trip_id, y, seen, guess)``: SMALL trees grown on the ``rows`` with y.

    ``columns`` maps names to 0/1 expressions over ``rows`` (trip_id, y, seen, ...).
    """
    names = list(columns)
    bits = ", ".join(f"({e})::INT AS b{i}" for i, e in enumerate(columns.values()))
    parts = [
        f"s0 AS MATERIALIZED (SELECT trip_id, y, seen, {bits}, (SELECT avg(y) FROM {rows}) AS guess FROM {rows})"
    ]
    last = "s0"
    for t in range(SMALL["trees"]):
        parts.append(f"n{t}_0 AS MATERIALIZED (SELECT *, 1 AS node FROM {last})")
        for level in range(SMALL["depth"]):
            at = f"n{t}_{level}"
            sums = " UNION ALL ".join(
                f"SELECT node, {i} AS f, sum(y - guess) AS g, count(y) AS h, coalesce(sum(y - guess) FILTER (b{i} = 1), 0) AS g1,"
                f" count(y) FILTER (b{i} = 1) AS h1 FROM {at} GROUP BY node"
                for i in range(len(names))
            )
            gain = "g1 * g1 / (h1 + 1) + (g - g1) * (g - g1) / (h - h1 + 1) - g * g / (h + 1)"
            parts.append(
                f"x{t}_{level} AS MATERIALIZED (SELECT node, f FROM (SELECT node, f, row_number() OVER (PARTITION BY node ORDER BY round(gain, 7) DESC, f) AS r"
                f" FROM (SELECT *, {gain} AS gain FROM ({sums})) WHERE h1 >= 1 AND h - h1 >= 1 AND gain > 1e-9) WHERE r = 1)"
            )
            bit = "CASE f " + " ".join(f"WHEN {i} THEN b{i}" for i in range(len(names))) + " ELSE 0 END"
            parts.append(
                f"n{t}_{level + 1} AS MATERIALIZED (SELECT {at}.* EXCLUDE (node), node * 2 + {bit} AS node FROM {at} LEFT JOIN x{t}_{level} USING (node))"
            )
        at = f"n{t}_{SMALL['depth']}"
        parts.append(
            f"s{t + 1} AS MATERIALIZED (SELECT * EXCLUDE (node) REPLACE (guess + {SMALL['rate']}::DOUBLE * sum(y - guess) OVER (PARTITION BY node)"
            f" / (count(y) OVER (PARTITION BY node) + 1) AS guess) FROM {at})"
        )
        last = f"s{t + 1}"
    parts.append(f"trees AS MATERIALIZED (SELECT trip_id, y, seen, guess FROM {last})")
    return ", ".join(parts)


_FISHING_COLUMNS = {f"{c}={v}": f"{c} = '{v}'" for c, values in risk.CATEGORIES.items() for v in values}
# Observed trips with their score, then those without votes whose class was observed.
_FISHING_ROWS = """fishing AS MATERIALIZED (
  SELECT trip_id, flag_group, vessel_class, time_at_sea, risk_score AS y, TRUE AS seen FROM observed_trips UNION ALL
  SELECT trip_id, flag_group, vessel_class, time_at_sea, NULL, FALSE FROM complete_trips
  WHERE trip_id IN (SELECT trip_id FROM predicted_trips))"""
_FISHING_TREES = f"{_FISHING_ROWS}, {_trees_sql('fishing', _FISHING_COLUMNS)}"
_FISHING_PARTS = ("observed_trips", "predicted_trips", "complete_trips")


def _small(trips, seen, **more):
    return risk.impute_boosted(trips, seen, **SMALL, **more)


@query(
    "l05_imputed_by_small_trees", "trip_id risk_score:d",
    f"(WITH {_FISHING_TREES} SELECT trip_id, guess AS risk_score FROM trees WHERE NOT seen)", *_FISHING_PARTS,
)
def small_trees(q: Inputs):
    return risk.risk_table(q.trips(), impute=_small).where("type = 'pred'")


_GUESS = "CASE WHEN round({0}, 9) < 0 THEN 0 WHEN round({0}, 9) < 2 THEN 1 ELSE 2 END"


@query(
    "l06_imputation_tables", "part trip_id risk_score:d risk_class:i",
    f"""(WITH {_FISHING_TREES} SELECT part, trip_id, risk_score, {_GUESS.format('risk_score')} AS risk_class FROM (
          SELECT 'observed' AS part, trip_id, y AS risk_score FROM trees WHERE seen
          UNION ALL SELECT 'in_sample', trip_id, guess FROM trees WHERE y IS NOT NULL
          UNION ALL SELECT 'predicted', trip_id, guess FROM trees WHERE NOT seen))""",
    *_FISHING_PARTS,
)
def imputation_tables(q: Inputs):
    parts = risk.imputation_tables(q.trips(), impute=_small)
    shown = [parts[p].withColumn("part", F.lit(p)) for p in ("observed", "in_sample", "predicted")]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


@query(
    "l06_imputation_error", "n:i rmse:d class_share:d",
    f"""(WITH {_FISHING_TREES} SELECT count(*) AS n, sqrt(avg((y - guess) * (y - guess))) AS rmse,
          avg(({_GUESS.format('y')} = {_GUESS.format('guess')})::INT) AS class_share FROM trees WHERE y IS NOT NULL)""",
    *_FISHING_PARTS,
)
def imputation_error(q: Inputs):
    return risk.imputation_tables(q.trips(), impute=_small)["error"]


@query(
    "l06_model_error", "n_observed:i n_predicted:i below_means:i",
    """(SELECT count(*) FILTER (risk_score IS NOT NULL) AS n_observed, (SELECT count(*) FROM predicted_trips) AS n_predicted, 1 AS below_means
        FROM observed_trips)""",
    "observed_trips", "predicted_trips",
)
def model_error(q: Inputs):
    """The model as it is used: its in-sample error is below that of the means of two factors."""
    parts = risk.imputation_tables(q.trips())
    seen = observed(q).where("risk_score IS NOT NULL")
    means = risk.impute_cell_mean(seen.withColumnRenamed("risk_score", "truth"), seen, risk.FACTORS[:2])
    other = risk.imputation_error(means.select("truth", F.col("risk_score").alias("guess")))
    predicted = parts["predicted"].agg(F.count("risk_score").alias("n_predicted"))
    return (
        parts["error"].select(F.col("n").alias("n_observed"), "rmse")
        .crossJoin(other.select(F.col("rmse").alias("other"))).crossJoin(predicted)
        .withColumn("below_means", (F.col("rmse") < F.col("other")).cast("int"))
    )


_CLASS = "CASE WHEN round(risk_score, 9) < 0 THEN 0 WHEN round(risk_score, 9) < 2 THEN 1 ELSE 2 END AS risk_class"


@query(
    "l06_risk_classes", "trip_id ssvid trip_start:t trip_end:t risk_score:d type risk_class:i",
    f"""(SELECT trip_id, ssvid, trip_start, trip_end, risk_score, type, {_CLASS} FROM (
          SELECT trip_id, ssvid, trip_start, trip_end, risk_score, 'obs' AS type FROM observed_trips UNION ALL
          SELECT trip_id, ssvid, trip_start, trip_end, risk_score, 'pred' FROM predicted_trips))""",
    "observed_trips", "predicted_trips",
)
def risk_classes(q: Inputs):
    return risk.risk_table(q.trips())


# -- attribution -----------------------------------------------------------------------------------

FACTORS = ["flag", "gear", "tas"]
_TERMS = {
    "flag": "m_flag", "gear": "m_gear", "tas": "m_tas",
    "flag x gear": "flag_x_gear", "flag x tas": "flag_x_tas", "gear x tas": "gear_x_tas",
}


def _terms(q: Inputs):
    rows = q.factors()
    return attribution.attribution_terms(attribution.factor_cells(rows, FACTORS, "risk_score"), FACTORS)


@query(
    "l07_attribution_terms",
    "flag_value gear_value tas_value n:i base:d cell_mean:d m_flag:d m_gear:d m_tas:d flag_x_gear:d flag_x_tas:d gear_x_tas:d",
    """(SELECT flag AS flag_value, gear AS gear_value, tas AS tas_value, count(*) AS n, first(v0) AS base, first(v123) AS cell_mean,
          first(m_flag) AS m_flag, first(m_gear) AS m_gear, first(m_tas) AS m_tas, first(flag_x_gear) AS flag_x_gear,
          first(flag_x_tas) AS flag_x_tas, first(gear_x_tas) AS gear_x_tas FROM attributed_rows GROUP BY ALL)""",
    "attributed_rows",
)
def attribution_cells(q: Inputs):
    return _terms(q).withColumnsRenamed(_TERMS)


_LONG = " UNION ALL ".join(f"SELECT '{t}' AS term, {c} AS value FROM attributed_rows" for t, c in _TERMS.items())
_IMPORTANCE = f"""(SELECT term, avg(abs(value)) AS mean, stddev_samp(abs(value)) AS sd, stddev_samp(abs(value)) / sqrt(count(*)) AS se,
          quantile_cont(abs(value), 0.025) AS lower, quantile_cont(abs(value), 0.975) AS upper FROM ({_LONG}) GROUP BY term)"""
STATS = "mean:d sd:d se:d lower:d upper:d"


@query("l08_attribution_importance", "term " + STATS, _IMPORTANCE, "attributed_rows")
def importance(q: Inputs):
    return attribution.importance(_terms(q), FACTORS)


_PRESENT = " UNION ALL ".join(
    f"SELECT '{f}' AS factor, {f} AS category, m_{f} AS value, v0 FROM attributed_rows" for f in FACTORS
)


def _effect_sql(keys: str, rows: str) -> str:
    return f"""(SELECT {keys}, count(*) AS rows, avg(value) + first(v0) AS mean, stddev_pop(value) AS sd,
          stddev_samp(value) / sqrt(count(*)) AS se, quantile_cont(value, 0.025) + first(v0) AS lower,
          quantile_cont(value, 0.975) + first(v0) AS upper FROM ({rows}) GROUP BY {keys} HAVING count(*) > 1)"""


_SOLO = _effect_sql("factor, category", _PRESENT)


@query("l09_solo_effects", "factor category rows:i " + STATS, _SOLO, "attributed_rows")
def solo(q: Inputs):
    return attribution.solo_effects(_terms(q), FACTORS)


_TOGETHER = " UNION ALL ".join(
    f"SELECT '{a}' AS factor1, {a} AS category1, '{b}' AS factor2, {b} AS category2,"
    f" m_{a} + m_{b} + 2 * {a}_x_{b} AS value, v0 FROM attributed_rows"
    for a, b in (("flag", "gear"), ("flag", "tas"), ("gear", "tas"))
)


@query(
    "l10_combination_effects", "factor1 category1 factor2 category2 rows:i " + STATS,
    _effect_sql("factor1, category1, factor2, category2", _TOGETHER), "attributed_rows",
)
def combinations(q: Inputs):
    return attribution.combination_effects(_terms(q), FACTORS)


CARRIER = list(risk.CARRIER_DESIGN)


def _signature_sql(column: str, names) -> str:
    shown = ", ".join(f"CASE WHEN bool_or({column} = '{v}') THEN '{v}' END" for v in names)
    return f"array_to_string(list_filter([{shown}], lambda x: x IS NOT NULL), '+')"


_CARRIER_CELLS = f"""SELECT *, to_iuu_no + to_iuu_low + to_iuu_med + to_iuu_high AS votes,
      to_iuu_low / 3.0::DOUBLE + to_iuu_med * 2 / 3.0::DOUBLE + to_iuu_high - to_iuu_no AS score FROM (
    SELECT trip_id, first(time_at_sea) AS is_tas, first(carrier_flag_group) AS is_flag,
      {_signature_sql('neighbor_flag_group', classes.FLAG_GROUP_NAMES)} AS with_flag,
      {_signature_sql('neighbor_vessel_class', classes.GEAR_CLASS_NAMES)} AS with_gear,
      CASE WHEN trip_id IN (SELECT trip_id FROM carrier_loitering WHERE ssvid IS NOT NULL) THEN 'loitering' ELSE 'no_loitering' END AS loitering,
      {', '.join(f'first(to_iuu_{v}) AS to_iuu_{v}' for v in ('no', 'low', 'med', 'high'))}
    FROM carrier_rows WHERE neighbor_vessel_class IS NOT NULL GROUP BY trip_id)"""


def _back_off_sql() -> str:
    names = list(risk.CARRIER_DESIGN)
    joins, means = [], []
    for depth in range(len(names), 0, -1):
        by = ", ".join(names[:depth])
        joins.append(
            f"LEFT JOIN (SELECT {by}, avg(score) AS m{depth} FROM cells WHERE votes > 0 GROUP BY {by}) USING ({by})"
        )
        means.append(f"m{depth}")
    overall = "(SELECT avg(score) FROM cells WHERE votes > 0)"
    return f"SELECT trip_id, coalesce({', '.join(means)}, {overall}) AS risk_score FROM cells {' '.join(joins)} WHERE coalesce(votes, 0) <= 0"


@query(
    "l06_carrier_risk_classes", "trip_id risk_score:d type risk_class:i",
    f"""(WITH cells AS MATERIALIZED ({_CARRIER_CELLS})
        SELECT *, {_CLASS} FROM (SELECT trip_id, score AS risk_score, 'obs' AS type FROM cells WHERE votes > 0
          UNION ALL SELECT trip_id, risk_score, 'pred' FROM ({_back_off_sql()})))""",
    "carrier_rows", "carrier_loitering",
)
def carrier_risk_classes(q: Inputs):
    return risk.carrier_scores(q.carrier_rows(), q.carrier_loitering())


@query("l05_carrier_imputed_by_boosted_trees", "trip_id risk_score:d type risk_class:i")
def carrier_boosted(q: Inputs):
    def trees(rest, seen):
        return risk.impute_boosted(rest, seen, (), columns=risk.CARRIER_COLUMNS, rate=0.01, trees=300)

    return risk.carrier_scores(q.carrier_rows(), q.carrier_loitering(), impute=trees)


def _carrier_trees_sql() -> str:
    columns = {
        **{f"is_tas={v}": f"is_tas = '{v}'" for v in classes.TIME_AT_SEA_NAMES},
        **{f"is_flag={v}": f"is_flag = '{v}'" for v in classes.FLAG_GROUP_NAMES},
        **{f"with_flag={v}": f"list_contains(str_split(with_flag, '+'), '{v}')" for v in classes.FLAG_GROUP_NAMES},
        **{f"with_gear={v}": f"list_contains(str_split(with_gear, '+'), '{v}')" for v in classes.GEAR_CLASS_NAMES},
        "loitering": "loitering = 'loitering'", "no_loitering": "loitering <> 'loitering'",
    }
    rows = f"carriers AS MATERIALIZED (SELECT *, CASE WHEN votes > 0 THEN score END AS y, coalesce(votes > 0, FALSE) AS seen FROM ({_CARRIER_CELLS}))"
    return f"{rows}, {_trees_sql('carriers', columns)}"


@query(
    "l05_carrier_imputed_by_small_trees", "trip_id risk_score:d type risk_class:i",
    f"""(WITH {_carrier_trees_sql()} SELECT *, {_CLASS} FROM (SELECT trip_id, coalesce(y, guess) AS risk_score,
          CASE WHEN y IS NULL THEN 'pred' ELSE 'obs' END AS type FROM trees))""",
    "carrier_rows", "carrier_loitering",
)
def carrier_small(q: Inputs):
    def trees(rest, seen):
        return _small(rest, seen, factors=(), columns=risk.CARRIER_COLUMNS)

    return risk.carrier_scores(q.carrier_rows(), q.carrier_loitering(), impute=trees)


@query(
    "l11_map_points", "lon_mean:d lat_mean:d risk_score:d risk_class:i",
    f"""(WITH cells AS MATERIALIZED ({_CARRIER_CELLS}),
          scores AS (SELECT trip_id, score AS risk_score FROM cells WHERE votes > 0 UNION ALL {_back_off_sql()})
        SELECT lon_mean, lat_mean, risk_score, {_CLASS} FROM (
          SELECT trip_id, lon_mean, lat_mean FROM carrier_rows UNION ALL SELECT trip_id, lon_mean, lat_mean FROM carrier_loitering)
        JOIN scores USING (trip_id) WHERE risk_score IS NOT NULL)""",
    "carrier_rows", "carrier_loitering",
)
def map_points(q: Inputs):
    return risk.map_points(
        q.carrier_rows(), q.carrier_loitering(), risk.carrier_scores(q.carrier_rows(), q.carrier_loitering())
    )


def _carrier_terms(q: Inputs):
    factors = risk.carrier_factors(carrier_design(q))
    scored = risk.observed_trips(factors, "iuu", null_votes="propagate", carrier_style=True)
    return attribution.attribution_terms(
        attribution.factor_cells(scored, CARRIER, "risk_score"), CARRIER
    )


def _carrier_attribution_sql() -> str:
    """All terms per observed carrier trip, by a window mean per subset of factors."""
    names = list(risk.CARRIER_DESIGN)
    k = len(names)
    means = ", ".join(
        f"avg(score) OVER ({'PARTITION BY ' + ', '.join(n for i, n in enumerate(names) if m >> i & 1) if m else ''}) AS v{m}"
        for m in range(1 << k)
    )
    parts = {}
    for i in range(k):
        for j in range(i + 1, k):
            a, b = 1 << i, 1 << j
            parts[i, j] = " + ".join(
                f"(v{m | a | b} - v{m | a} - v{m | b} + v{m}) / {2 * 24 // (factorial(m.bit_count()) * factorial(k - 2 - m.bit_count()))}"
                for m in range(1 << k) if not m & (a | b)
            )
    pairs = ", ".join(f"{x} AS t{i}_{j}" for (i, j), x in parts.items())
    whole = ", ".join(
        "({}) / {} AS p{}".format(
            " + ".join(
                f"(v{m | 1 << i} - v{m}) * {factorial(m.bit_count()) * factorial(k - 1 - m.bit_count())}"
                for m in range(1 << k) if not m & (1 << i)
            ),
            factorial(k), i,
        )
        for i in range(k)
    )
    mains = ", ".join(
        f"p{i} - " + " - ".join(f"t{min(i, j)}_{max(i, j)}" for j in range(k) if j != i) + f" AS m{i}" for i in range(k)
    )
    return (
        f"SELECT *, {mains} FROM (SELECT *, {pairs}, {whole} FROM (SELECT *, {means} FROM"
        f" ({_CARRIER_CELLS}) WHERE votes > 0))"
    )


def _carrier_importance_sql() -> str:
    names = list(risk.CARRIER_DESIGN)
    columns = {n: f"m{i}" for i, n in enumerate(names)}
    columns |= {f"{names[i]} x {names[j]}": f"t{i}_{j}" for i in range(len(names)) for j in range(i + 1, len(names))}
    rows = " UNION ALL ".join(f"SELECT '{t}' AS term, abs({c}) AS x FROM terms" for t, c in columns.items())
    return f"""(WITH terms AS MATERIALIZED ({_carrier_attribution_sql()})
        SELECT term, avg(x) AS mean, stddev_samp(x) AS sd, stddev_samp(x) / sqrt(count(*)) AS se,
          quantile_cont(x, 0.025) AS lower, quantile_cont(x, 0.975) AS upper FROM ({rows}) GROUP BY term)"""


def _carrier_combination_sql() -> str:
    names = list(risk.CARRIER_DESIGN)

    def shown(n: str) -> str:
        return f"unnest(string_split({n}, '+'))" if n.startswith("with_") else n

    rows = " UNION ALL ".join(
        f"SELECT '{names[i]}' AS factor1, {shown(names[i])} AS category1, '{names[j]}' AS factor2, category2, value, v0 FROM"
        f" (SELECT *, {shown(names[j])} AS category2, m{i} + m{j} + 2 * t{i}_{j} AS value FROM terms)"
        for i in range(len(names)) for j in range(i + 1, len(names))
    )
    inner = _effect_sql("factor1, category1, factor2, category2", rows)
    return f"(WITH terms AS MATERIALIZED ({_carrier_attribution_sql()}) SELECT * FROM {inner})"


@query(
    "l08_carrier_attribution_importance", "term " + STATS, _carrier_importance_sql(), "carrier_rows", "carrier_loitering"
)
def carrier_importance(q: Inputs):
    return attribution.importance(_carrier_terms(q), CARRIER)


def _carrier_solo_sql() -> str:
    def shown(n: str) -> str:
        return f"unnest(string_split({n}, '+'))" if n.startswith("with_") else n

    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS factor, {shown(n)} AS category, m{i} AS value, v0 FROM terms" for i, n in enumerate(risk.CARRIER_DESIGN)
    )
    return f"(WITH terms AS MATERIALIZED ({_carrier_attribution_sql()}) SELECT * FROM {_effect_sql('factor, category', rows)})"


@query(
    "l09_carrier_solo_effects", "factor category rows:i " + STATS, _carrier_solo_sql(), "carrier_rows", "carrier_loitering"
)
def carrier_solo(q: Inputs):
    return attribution.solo_effects(_carrier_terms(q), CARRIER, signatures=("with_flag", "with_gear"))


@query(
    "l10_carrier_combination_effects", "factor1 category1 factor2 category2 rows:i " + STATS,
    _carrier_combination_sql(), "carrier_rows", "carrier_loitering",
)
def carrier_combinations(q: Inputs):
    return attribution.combination_effects(_carrier_terms(q), CARRIER, signatures=("with_flag", "with_gear"))


@query(
    "l23_importance_report", "var_name " + STATS,
    f"""(SELECT *, CASE term WHEN 'flag' THEN 'Flag' WHEN 'gear' THEN 'Gear type' WHEN 'tas' THEN 'Time at sea'
          WHEN 'flag x gear' THEN 'Flag × Gear type' WHEN 'flag x tas' THEN 'Flag × Time at sea'
          ELSE 'Gear type × Time at sea' END AS var_name FROM {_IMPORTANCE})""",
    "attributed_rows",
)
def importance_report(q: Inputs):
    return report.importance_report(importance(q))


def _classed(q: Inputs):
    """The trips of the risk study under short factor names."""
    return observed(q).where("risk_score IS NOT NULL").selectExpr(
        "trip_id", "flag_group AS flag", "vessel_class AS gear", "time_at_sea AS tas", "risk_score"
    )


def _classed_terms(q: Inputs):
    return attribution.attribution_terms(
        attribution.factor_cells(_classed(q), FACTORS, "risk_score"), FACTORS
    )


_REPORT_CELLS = "SELECT flag_group AS flag, vessel_class AS gear, time_at_sea AS tas, risk_score FROM observed_trips WHERE risk_score IS NOT NULL"


def _report_sql(select: str) -> str:
    from workload.inputs_sql import CTES

    # The attribution CTE over the trips of the risk study instead of the factor rows.
    body = CTES["attributed_rows"][1].replace("factor_rows", f"({_REPORT_CELLS})")
    return select.replace("attributed_rows", f"({body})")


def _names_sql(column: str) -> str:
    names = {**report.FLAG_LABELS, **report.GEAR_LABELS, **report.TIME_LABELS}
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


_FLAG_ONLY = f"(SELECT {_names_sql('category')} AS var1, NULL AS var2, factor AS class, mean, sd, se, lower, upper FROM {_SOLO} WHERE factor = 'flag')"


@query(
    "l23_solo_report", "var1 class " + STATS,
    _report_sql(
        f"(SELECT {_names_sql('category')} AS var1, factor AS class, mean, sd, se, lower, upper FROM {_SOLO} WHERE factor <> 'tas')"
    ),
    "observed_trips",
)
def solo_report(q: Inputs):
    return report.solo_report(attribution.solo_effects(_classed_terms(q), FACTORS))


_GEAR_FLAG = _effect_sql(
    "category1, category2",
    "SELECT flag AS category1, gear AS category2, m_flag + m_gear + 2 * flag_x_gear AS value, v0 FROM attributed_rows",
)


@query(
    "l23_combination_report", "var1 var2 class " + STATS,
    _report_sql(
        f"""(SELECT {_names_sql('category2')} AS var1, {_names_sql('category1')} AS var2, 'gear' AS class, mean, sd, se, lower, upper
            FROM {_GEAR_FLAG} UNION ALL SELECT * FROM {_FLAG_ONLY})"""
    ),
    "observed_trips",
)
def combination_report(q: Inputs):
    terms = _classed_terms(q)
    return report.combination_report(
        attribution.combination_effects(terms, FACTORS), attribution.solo_effects(terms, FACTORS)
    )
