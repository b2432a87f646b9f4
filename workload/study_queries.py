"""Policy study and port-stop durations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import duration, policy
from workload.inputs import Inputs
from workload.registry import query


@query(
    "l12_policy_cohort", "cohort:i iso3",
    """(SELECT 2016 AS cohort, 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS iso3 FROM nation
          WHERE n_nationkey % 8 <> 7 AND n_nationkey <> 4 AND n_nationkey % 5 <> 3 AND n_nationkey % 3 = 1
        UNION SELECT 2016, 'DNK'
        UNION SELECT 2017, 'N' || lpad(n_nationkey::VARCHAR, 2, '0') FROM nation
          WHERE n_nationkey % 8 <> 7 AND n_nationkey <> 4 AND n_nationkey % 5 <> 3 AND n_nationkey % 3 = 2
        UNION VALUES (2017, 'GRL'), (2017, 'FRO'))""",
)
def cohorts(q: Inputs):
    parties = policy.policy_parties(q.policy_dates())
    first, second = (
        policy.policy_cohort(parties, y).withColumn("cohort", F.lit(y)) for y in (2016, 2017)
    )
    return first.unionByName(second)


@query(
    "l13_foreign_visits", "year:i ssvid port_iso3 flag flag_sovereign port_iso3_sovereign n:i",
    """(SELECT year, ssvid, port_iso3, flag, flag_sovereign, port_iso3_sovereign, count(*) AS n FROM foreign_visits GROUP BY ALL)""",
    "foreign_visits",
)
def foreign(q: Inputs):
    pairs = policy.sovereign_pairs(q.zones(), position="position")
    return policy.foreign_visits(q.panel_visits(), pairs).groupBy(
        "year", "ssvid", "port_iso3", "flag", "flag_sovereign", "port_iso3_sovereign"
    ).agg(F.count("*").alias("n"))


PANEL = "year:i port_iso3 n_visits:i policy:i after:i"


@query("l14_visit_panel", PANEL, "panel", "panel")
def panel(q: Inputs):
    pairs = policy.sovereign_pairs(q.zones(), position="position")
    parties = policy.policy_parties(q.policy_dates())
    kept = policy.without_ports(q.panel_visits(), policy.policy_cohort(parties, 2017))
    visits = policy.select_cohort(policy.foreign_visits(kept, pairs), "fishing_gear")
    return policy.visit_panel(visits, policy.policy_cohort(parties, 2016), 1996, 1998)


@query("l15_trimmed_panel", PANEL, "trimmed_panel", "trimmed_panel")
def trimmed(q: Inputs):
    return policy.policy_study(
        q.panel_visits(),
        policy.policy_parties(q.policy_dates()),
        policy.sovereign_pairs(q.zones(), position="position"),
        years=(1996, 1998),
    )


_PORTS = """(SELECT port_iso3, policy, max(CASE WHEN after = 0 THEN y END) AS y0, max(CASE WHEN after = 1 THEN y END)
            - max(CASE WHEN after = 0 THEN y END) AS d
          FROM (SELECT *, ln(n_visits / (SELECT max(n_visits) FROM trimmed_panel)) AS y FROM trimmed_panel) GROUP BY ALL)"""


def _arm(agg: str, column: str, policy_: int) -> str:
    return f"(SELECT {agg}({column}) FROM {_PORTS} WHERE policy = {policy_})"


def _se(column: str, *arms: int) -> str:
    parts = [f"{_arm('var_samp', column, p)} / {_arm('count', column, p)}" for p in arms]
    return f"sqrt({' + '.join(parts)})"


@query(
    "l16_policy_effect", "term estimate:d std_error:d",
    f"""(SELECT 'intercept' AS term, {_arm('avg', 'y0', 0)} AS estimate, {_se('y0', 0)} AS std_error
        UNION ALL SELECT 'policy', {_arm('avg', 'y0', 1)} - {_arm('avg', 'y0', 0)}, {_se('y0', 0, 1)}
        UNION ALL SELECT 'after', {_arm('avg', 'd', 0)}, {_se('d', 0)}
        UNION ALL SELECT 'policy:after', {_arm('avg', 'd', 1)} - {_arm('avg', 'd', 0)}, {_se('d', 0, 1)})""",
    "trimmed_panel",
)
def effect(q: Inputs):
    return policy.policy_effect(trimmed(q))


CELLS = ("flag_group", "port_iso3", "vessel_class")


def _cells(q: Inputs):
    return duration.duration_cells(duration.log_hours(q.durations()), CELLS)


@query(
    "l17_duration_cells", "flag_group port_iso3 vessel_class n:i sum_y:d sum_y2:d", "duration_cells", "duration_cells"
)
def duration_cells(q: Inputs):
    return _cells(q)


def _moments_sql(factors: list[str], sums: str, squares: str) -> list[str]:
    """Variances per replicate: v(rep, v0, v1, ...) from sums (rep, a, lv, s) and squares (rep, yy).

    n<a>, p<a>_<b>: stops per level and pair of levels; m<a>_<b>: the pairs' counts less
    what the fixed means explain.
    """
    k = range(len(factors))
    parts = [f"sums AS MATERIALIZED {sums}", f"squares AS MATERIALIZED {squares}"]
    for a in k:
        parts.append(f"n{a} AS MATERIALIZED (SELECT {factors[a]} AS lv, sum(n)::DOUBLE AS n FROM dc GROUP BY 1)")
        for b in k:
            count = "sum(n)::DOUBLE"
            if a != b:
                parts.append(
                    f"p{a}_{b} AS MATERIALIZED (SELECT {factors[a]} AS x, {factors[b]} AS y, {count} AS n FROM dc GROUP BY ALL)"
                )
    unknown = k[1:]
    cell = {(0, 0): "(SELECT sum(n) - count(*) FROM n0)"}
    for a in unknown:
        for b in unknown:
            same = "CASE WHEN i.lv = j.lv THEN i.n ELSE 0 END" if a == b else "coalesce(p.n, 0)"
            pair = "" if a == b else f"LEFT JOIN p{a}_{b} p ON p.x = i.lv AND p.y = j.lv"
            parts.append(
                f"m{a}_{b} AS MATERIALIZED (SELECT i.lv AS x, i.n, j.lv AS y, {same} - coalesce(t.v, 0) AS v FROM n{a} i CROSS JOIN n{b} j {pair}"
                f" LEFT JOIN (SELECT l.y AS x, r.y AS y, sum(l.n * r.n / g.n) AS v FROM p0_{a} l JOIN p0_{b} r ON l.x = r.x"
                f" JOIN n0 g ON g.lv = l.x GROUP BY ALL) t ON t.x = i.lv AND t.y = j.lv)"
            )
            cell[a, b] = f"(SELECT sum(v * v / n) FROM m{a}_{b})"
        cell[0, a] = f"(SELECT sum(v) FROM m{a}_{a} WHERE x = y)"
        cell[a, 0] = f"(SELECT sum(v / n) FROM m{a}_{a} WHERE x = y)"
    parts.append("co AS MATERIALIZED (SELECT " + ", ".join(f"{q} AS c{a}{b}" for (a, b), q in cell.items()) + ")")
    parts.append(
        "q0 AS (SELECT rep, yy - ss AS q0 FROM squares JOIN (SELECT rep, sum(s * s / n) AS ss FROM sums JOIN n0 USING (lv)"
        " WHERE a = 0 GROUP BY 1) USING (rep))"
    )
    for a in unknown:
        parts.append(
            f"q{a} AS (SELECT rep, sum((s - coalesce(t, 0)) * (s - coalesce(t, 0)) / n) AS q{a} FROM (SELECT rep, lv, s FROM sums WHERE a = {a})"
            f" JOIN n{a} USING (lv) LEFT JOIN (SELECT rep, p.y AS lv, sum(p.n * s.s / g.n) AS t FROM p0_{a} p JOIN sums s ON s.lv = p.x"
            f" AND s.a = 0 JOIN n0 g ON g.lv = p.x GROUP BY ALL) USING (rep, lv) GROUP BY 1)"
        )
    # Cramer's rule.
    def det(columns: list[list[str]]) -> str:
        if len(columns) == 1:
            return columns[0][0]
        return "(" + " + ".join(
            f"{(-1) ** i}.0::DOUBLE * {columns[0][i]} * {det([c[:i] + c[i + 1:] for c in columns[1:]])}" for i in range(len(columns))
        ) + ")"

    matrix = [[f"c{a}{b}" for a in k] for b in k]
    right = [f"q{a}" for a in k]
    solved = ", ".join(
        f"greatest(0, {det([right if c == b else column for c, column in enumerate(matrix)])} / {det(matrix)}) AS v{b}" for b in k
    )
    joined = " ".join(f"JOIN q{a} USING (rep)" for a in unknown)
    parts.append(f"v AS MATERIALIZED (SELECT rep, {solved} FROM q0 {joined}, co)")
    return parts


def _levels_sql(factors: list[str], rounds: int) -> list[str]:
    """e<a>_<rounds>(rep, lv, e): the levels of factor a, each round from the latest of the others."""
    k = range(len(factors))
    parts = [
        f"e{a}_0 AS MATERIALIZED (SELECT rep, lv, 0.0::DOUBLE AS e FROM sums WHERE a = {a})" for a in k
    ]
    latest = {a: f"e{a}_0" for a in k}
    for step in range(1, rounds + 1):
        for a in k:
            others = " ".join(
                f"LEFT JOIN (SELECT rep, p.x AS lv, sum(p.n * e.e) AS t{b} FROM p{a}_{b} p JOIN {latest[b]} e ON e.lv = p.y GROUP BY ALL)"
                f" USING (rep, lv)"
                for b in k if b != a
            )
            rest = " - ".join(["s", *(f"coalesce(t{b}, 0)" for b in k if b != a)])
            # Random levels add up to 0 in the solution; without that the general level moves very slowly.
            own = f"({rest}) / (n + v0 / v{a})"
            value = f"({rest}) / n" if a == 0 else f"CASE WHEN v{a} > 0 THEN {own} - avg({own}) OVER (PARTITION BY rep) ELSE 0 END"
            name = f"e{a}_{step}"
            parts.append(
                f"{name} AS MATERIALIZED (SELECT rep, lv, {value} AS e FROM (SELECT rep, lv, s FROM sums WHERE a = {a})"
                f" JOIN n{a} USING (lv) JOIN v USING (rep) {others})"
            )
            latest[a] = name
    return parts


def _observed_sql(factors: list[str]) -> tuple[str, str]:
    sums = " UNION ALL ".join(
        f"SELECT 0 AS rep, {a} AS a, {f} AS lv, sum(sum_y) AS s FROM dc GROUP BY {f}" for a, f in enumerate(factors)
    )
    return f"({sums})", "(SELECT 0 AS rep, sum(sum_y2) AS yy FROM dc)"


DC = "dc AS MATERIALIZED (SELECT * FROM duration_cells)"
# Enough for the levels to stand still to the last digit shown.
ROUNDS, REPLICATE_ROUNDS, REPLICATES = 40, 14, 1000


def _fit_sql(factors: list[str]) -> str:
    """WITH parts of the fitted levels e<a>_<ROUNDS> and variances v."""
    return ", ".join([DC, *_moments_sql(factors, *_observed_sql(factors)), *_levels_sql(factors, ROUNDS)])


def _adjusted_sql(factors: list[str]) -> str:
    levels = " UNION ALL ".join(
        f"SELECT '{f}' AS factor, lv AS category, n, e AS estimate FROM e{a}_{ROUNDS} JOIN n{a} USING (lv)" for a, f in enumerate(factors)
    )
    return f"(WITH {_fit_sql(factors)} {levels})"


def _variances_sql(factors: list[str]) -> str:
    rows = ["SELECT 'residual' AS factor, v0 AS variance, 1.0::DOUBLE AS ratio FROM v"]
    rows += [
        f"SELECT '{f}', v{a}, CASE WHEN v{a} > 0 THEN v0 / v{a} END FROM v" for a, f in enumerate(factors) if a
    ]
    return f"(WITH {_fit_sql(factors)} {' UNION ALL '.join(rows)})"


def _z(*parts: str) -> str:
    """A standard normal number from the md5 of the parts joined by bars."""
    digest = f"md5(concat_ws('|', {', '.join(parts)}))"
    u = "((('0x' || substr({0}, {1}, 8))::BIGINT + 1) / 4294967296.0::DOUBLE)"
    return f"sqrt(-2 * ln({u.format(digest, 1)})) * cos(2 * pi() * {u.format(digest, 9)})"


def _intervals_sql(factors: list[str], drop: str | None = None) -> str:
    k = range(len(factors))
    fitted = f"fitted AS MATERIALIZED (WITH {_fit_sql(factors)} SELECT lv, e, v.* EXCLUDE (rep) FROM e0_{ROUNDS}, v)"
    reps = f"range(1, {REPLICATES + 1}) AS r(rep)"
    names = ", ".join(f"'{f}=' || {f}" for f in factors)
    # Levels of a replicate, then its cells: sum of a cell and its square over the size.
    drawn = [
        f"u{a} AS MATERIALIZED (SELECT rep, lv, sqrt(v) * {_z('0', 'rep', repr(factors[a]), 'lv')} AS u FROM"
        f" (SELECT DISTINCT {factors[a]} AS lv FROM dc), (SELECT any_value(v{a}) AS v FROM fitted), {reps})"
        for a in k[1:]
    ]
    mean = " + ".join(["f.e", *(f"u{a}.u" for a in k[1:])])
    joins = " ".join(f"JOIN u{a} ON u{a}.rep = z.rep AND u{a}.lv = z.{factors[a]}" for a in k[1:])
    cells = (
        f"sim AS MATERIALIZED (SELECT z.rep, {', '.join('z.' + f for f in factors)}, z.n, z.n * ({mean}) + sqrt(v0) * sqrt(z.n) * z AS y"
        f" FROM (SELECT *, {_z('0', 'rep', names)} AS z FROM (SELECT {', '.join(factors)}, sum(n)::DOUBLE AS n FROM dc GROUP BY ALL), {reps}) z"
        f" JOIN fitted f ON f.lv = z.{factors[0]} {joins})"
    )
    sums = " UNION ALL ".join(
        f"SELECT rep, {a} AS a, {f} AS lv, sum(y) AS s FROM sim GROUP BY rep, {f}" for a, f in enumerate(factors)
    )
    df = f"(SELECT sum(n) - count(*) FROM (SELECT {', '.join(factors)}, sum(n)::DOUBLE AS n FROM dc GROUP BY ALL))"
    within = (
        f"CASE WHEN {df} <= 0 THEN 0 ELSE (SELECT any_value(v0) FROM fitted) * {df}"
        f" * pow(greatest(0, 1 - 2 / (9 * {df}) + {_z('0', 'rep', repr('within'), repr('cells'))} * sqrt(2 / (9 * {df}))), 3) END"
    )
    squares = f"(SELECT rep, sum(y * y / n) + {within} AS yy FROM sim GROUP BY rep)"
    parts = [
        DC, fitted, *drawn, cells, *_moments_sql(factors, f"({sums})", squares), *_levels_sql(factors, REPLICATE_ROUNDS),
    ]
    kept = f"WHERE lv <> '{drop}'" if drop else ""
    return (
        f"(WITH {', '.join(parts)} SELECT lv AS category, mean, lower, upper FROM (SELECT lv, e AS mean FROM fitted) JOIN"
        f" (SELECT lv, quantile_cont(e, 0.025) AS lower, quantile_cont(e, 0.975) AS upper FROM e0_{REPLICATE_ROUNDS} GROUP BY 1)"
        f" USING (lv) {kept})"
    )


FLAG, GEAR = ["flag_group", "port_iso3", "vessel_class"], ["vessel_class", "port_iso3"]
LEVELS, VARIANCES, INTERVALS = "factor category n:i estimate:d", "factor variance:d ratio:d", "category mean:d lower:d upper:d"
DROPPED = "PROMO"


@query("l17_duration_by_flag_group", LEVELS, _adjusted_sql(FLAG), "duration_cells")
def by_flag(q: Inputs):
    return duration.adjusted_levels(_cells(q), FLAG[0], FLAG[1:])


@query("l18_duration_by_gear", LEVELS, _adjusted_sql(GEAR), "duration_cells")
def by_gear(q: Inputs):
    return duration.adjusted_levels(_cells(q), GEAR[0], GEAR[1:])


@query("l17_variances_by_flag_group", VARIANCES, _variances_sql(FLAG), "duration_cells")
def flag_variances(q: Inputs):
    return duration.variance_components(_cells(q), FLAG[0], FLAG[1:])


@query("l18_variances_by_gear", VARIANCES, _variances_sql(GEAR), "duration_cells")
def gear_variances(q: Inputs):
    return duration.variance_components(_cells(q), GEAR[0], GEAR[1:])


@query("l19_bootstrap_intervals", INTERVALS, _intervals_sql(FLAG), "duration_cells")
def flag_intervals(q: Inputs):
    return duration.bootstrap_intervals(_cells(q), FLAG[0], FLAG[1:], replicates=REPLICATES)


@query("l19_gear_intervals", INTERVALS, _intervals_sql(GEAR, DROPPED), "duration_cells")
def gear_intervals(q: Inputs):
    return duration.bootstrap_intervals(_cells(q), GEAR[0], GEAR[1:], replicates=REPLICATES, drop=[DROPPED])
