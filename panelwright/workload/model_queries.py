"""Fixed-effects models on the balanced test panel, where SQL has a closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regress, regress_leave_out
from ..operators.regress import ModelSpec, computed, crossed, interaction, main
from .registry import query
from .stats_queries import t_probability_sql
from .tables import r, round_all, with_balanced, with_panel


def unit_spec() -> ModelSpec:
    return ModelSpec("y", (main("x1"), main("x2")), ("unit", "yr"), "firm", "unit_fe")


def nation_spec() -> ModelSpec:
    return ModelSpec("y", (main("x1"), main("x2")), ("nation", "yr"), "firm", "nation_fe")


def fit_ctes(tag: str, source: str, large: str, y: str = "y", a: str = "x1", b: str = "x2") -> str:
    """SQL: two-way fit with two terms on balanced rows, as CTEs ending in ``{tag}_fit``.

    Balanced rows are demeaned in one step. Effects of units (nested in the
    firm clusters) do not count as parameters of the small-sample factor.
    """
    def two_way(v):
        return (
            f"{v} - avg({v}) OVER (PARTITION BY g) - avg({v}) OVER (PARTITION BY t) + avg({v}) OVER () AS {v}"
        )

    counted = "2 + n_t" if large == "unit" else "2 + n_g + n_t - 1"
    return f"""
{tag}_d AS (SELECT {large} AS g, yr AS t, firm AS c, CAST({y} AS DOUBLE) AS y, CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b FROM {source}),
{tag}_w AS (SELECT g, t, c, {two_way('y')}, {two_way('a')}, {two_way('b')} FROM {tag}_d),
{tag}_s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS byy, sum(y * y) AS yy,
                   count(*) AS n, count(DISTINCT g) AS n_g, count(DISTINCT t) AS n_t, count(DISTINCT c) AS n_c FROM {tag}_w),
{tag}_b AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * byy) / (aa * bb - ab * ab) AS b1,
                   (aa * byy - ab * ay) / (aa * bb - ab * ab) AS b2 FROM {tag}_s),
{tag}_e AS (SELECT c, a, b, y - b1 * a - b2 * b AS e FROM {tag}_w w, {tag}_b),
{tag}_c AS (SELECT c, sum(a * e) AS s1, sum(b * e) AS s2 FROM {tag}_e GROUP BY c),
{tag}_m AS (SELECT sum(s1 * s1) AS m11, sum(s1 * s2) AS m12, sum(s2 * s2) AS m22 FROM {tag}_c),
{tag}_r AS (SELECT sum(e * e) AS rss FROM {tag}_e),
{tag}_t AS (SELECT var_pop(y) * count(*) AS tss FROM {tag}_d),
{tag}_fit AS (
  SELECT b1, b2, n, n_c, CAST(n_c AS DOUBLE) / (n_c - 1) * (n - 1) / (n - ({counted})) AS f,
         sqrt(CAST(n_c AS DOUBLE) / (n_c - 1) * (n - 1) / (n - ({counted}))
              * (bb * bb * m11 - 2 * bb * ab * m12 + ab * ab * m22)) / det AS se1,
         sqrt(CAST(n_c AS DOUBLE) / (n_c - 1) * (n - 1) / (n - ({counted}))
              * (ab * ab * m11 - 2 * aa * ab * m12 + aa * aa * m22)) / det AS se2,
         1 - rss / tss AS r2, 1 - rss / tss * (n - 1) / (n - (2 + n_g + n_t - 1)) AS adj_r2, 1 - rss / yy AS within_r2
  FROM {tag}_b, {tag}_m, {tag}_r, {tag}_t)"""


def coefficient_rows(tag: str, model: str, names=("x1", "x2")) -> str:
    p1 = t_probability_sql("(b1 / se1)", "(n_c - 1)")
    p2 = t_probability_sql("(b2 / se2)", "(n_c - 1)")

    def row(k, name, p):
        return (
            f"SELECT '{model}' AS model, CAST({k} AS INTEGER) AS position, '{name}' AS term, {r(f'b{k}')} AS estimate, "
            f"{r(f'se{k}')} AS std_error, {r(f'b{k} / se{k}', 4)} AS t_value, {r(p, 5)} AS p_value, "
            f"CASE WHEN {p} < 0.01 THEN '***' WHEN {p} < 0.05 THEN '**' WHEN {p} < 0.1 THEN '*' ELSE '' END AS stars, "
            f"false AS dropped FROM {tag}_fit"
        )

    return row(1, names[0], p1) + "\nUNION ALL " + row(2, names[1], p2)


def rounded_coefficients(df):
    return round_all(round_all(round_all(df, "estimate", "std_error"), "t_value", digits=4), "p_value", digits=5)


@query("design_matrix", with_panel(f"""
SELECT nation, yr, firm, {r('ln(verified)')} AS log_verified, own, CAST(n_orders AS DOUBLE) AS n_orders,
       {r('ln(n_orders + 1)')} AS "log(n_orders + 1)", own * n_orders AS "own:n_orders",
       own * CAST(phase = 3 AS INTEGER) AS "own:phase3"
FROM panel WHERE verified IS NOT NULL AND verified > 0"""))
def design_matrix(t):
    rows = t.panel.withColumns({
        "log_verified": F.when(F.col("verified") > 0, F.ln("verified")),
        "phase3": (F.col("phase") == 3).cast("int"),
    })
    own, orders = main("own"), main("n_orders")
    spec = ModelSpec(
        "log_verified",
        (*crossed(own, orders), interaction(own, main("phase3")),
         computed("log(n_orders + 1)", F.log1p("n_orders"))),
        ("nation", "yr"), "firm",
    )
    return round_all(regress.design_matrix(rows, spec), "log_verified", "log(n_orders + 1)")


@query("demean_fixed_effects", with_balanced(f"""
SELECT unit, yr, {r('y - avg(y) OVER (PARTITION BY unit) - avg(y) OVER (PARTITION BY yr) + avg(y) OVER ()', 4)} AS y,
       {r('x1 - avg(x1) OVER (PARTITION BY unit) - avg(x1) OVER (PARTITION BY yr) + avg(x1) OVER ()', 4)} AS x1 FROM balanced"""))
def demean_fixed_effects(t):
    out = regress.demean_fixed_effects(t.balanced.select("unit", "yr", "y", "x1"), ["y", "x1"], ["unit", "yr"])
    # Whole cents over 7 and the number of units: at 6 digits some values lie on a rounding tie.
    return round_all(out, "y", "x1", digits=4).withColumns({c: F.col(c) + 0.0 for c in ("y", "x1")})


@query("demean_one_effect", with_panel(f"""
SELECT unit, yr, {r('own - avg(own) OVER (PARTITION BY nation)')} AS own FROM panel"""))
def demean_one_effect(t):
    out = regress.demean_fixed_effects(t.panel.select("unit", "yr", "nation", "own"), ["own"], ["nation"])
    return round_all(out, "own").select("unit", "yr", "own")


_ROUND = "SELECT * FROM {0} WHERE unit IN (SELECT unit FROM {0} GROUP BY unit HAVING count(*) > 1) AND code IN (SELECT code FROM {0} GROUP BY code HAVING count(*) > 1)"


@query("drop_singletons", with_panel(f"""
, k0 AS (SELECT unit, yr, verified, CAST(unit % 1000 * 10 + n_orders AS VARCHAR) AS code FROM panel WHERE verified IS NOT NULL),
k1 AS ({_ROUND.format('k0')}), k2 AS ({_ROUND.format('k1')}), k3 AS ({_ROUND.format('k2')}), k4 AS ({_ROUND.format('k3')}),
k5 AS ({_ROUND.format('k4')}), k6 AS ({_ROUND.format('k5')}), k7 AS ({_ROUND.format('k6')}), k8 AS ({_ROUND.format('k7')})
SELECT unit, yr, code, verified FROM k8"""))
def drop_singletons(t):
    code = (F.col("unit") % 1000 * 10 + F.col("n_orders")).cast("string").alias("code")
    rows = t.panel.where(F.col("verified").isNotNull()).select("unit", "yr", code, "verified")
    return regress.drop_singletons(rows, ["unit", "code"])


@query("drop_collinear", with_balanced("""
, w AS (SELECT x1 - avg(x1) OVER (PARTITION BY unit) - avg(x1) OVER (PARTITION BY yr) + avg(x1) OVER () AS a,
               x2 - avg(x2) OVER (PARTITION BY unit) - avg(x2) OVER (PARTITION BY yr) + avg(x2) OVER () AS b FROM balanced),
v AS (SELECT sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab FROM w)
SELECT 'x1' AS term, 1 AS position, NOT aa > 1e-6 AS dropped FROM v
UNION ALL SELECT 'fixed', 2, true UNION ALL SELECT 'x2', 3, NOT bb - ab * ab / aa > 1e-6 FROM v
UNION ALL SELECT 'both', 4, true"""))
def drop_collinear(t):
    spec = ModelSpec(
        "y",
        (main("x1"), computed("fixed", F.col("unit") % 13), main("x2"), computed("both", F.col("x1") * 2 - F.col("x2"))),
        ("unit", "yr"), "firm",
    )
    return regress.drop_collinear(t.balanced, spec)


@query("fe_ols", with_balanced(", " + fit_ctes("u", "balanced", "unit") + "\n" + coefficient_rows("u", "unit_fe")))
def fe_ols(t):
    return rounded_coefficients(regress.fe_ols(t.balanced, unit_spec()).coefficients())


@query("fe_ols_group_effects", with_balanced(", " + fit_ctes("v", "balanced", "nation") + "\n" + coefficient_rows("v", "nation_fe")))
def fe_ols_group_effects(t):
    return rounded_coefficients(regress.fe_ols(t.balanced, nation_spec()).coefficients())


@query("cluster_se", with_balanced(", " + fit_ctes("v", "balanced", "nation") + f"""
SELECT 'x1' AS term, {r('se1')} AS std_error, CAST(n_c AS INTEGER) AS n_clusters FROM v_fit
UNION ALL SELECT 'x2', {r('se2')}, CAST(n_c AS INTEGER) FROM v_fit"""))
def cluster_se(t):
    return round_all(regress.cluster_se(t.balanced, nation_spec()), "std_error")


_STATISTICS = f"n AS n_obs, n_c AS n_clusters, {r('r2')} AS r2, {r('adj_r2')} AS adj_r2, {r('within_r2')} AS within_r2"


@query("fit_statistics", with_balanced(", " + fit_ctes("u", "balanced", "unit") + f"\nSELECT 'unit_fe' AS model, {_STATISTICS} FROM u_fit"))
def fit_statistics(t):
    return round_all(regress.fit_statistics(t.balanced, unit_spec()), "r2", "adj_r2", "within_r2")


_PHASES = {"p1": 1, "p2": 2, "p3": 3, "p4": 4}
_GRID = [(f"{y}_{label}", y, k) for y in ("y", "y2", "y3") for label, k in _PHASES.items()]


def _doubled(t):
    y, x1, x2 = F.col("y"), F.col("x1"), F.col("x2")
    return t.balanced.withColumns({"y2": y * y / 10 + x1, "y3": y - x1 * x2 / 10})


@query("model_grid", with_balanced(
    ", doubled AS (SELECT *, y * y / 10 + x1 AS y2, y - x1 * x2 / 10 AS y3 FROM balanced)," + ",".join(
        f" part{k} AS (SELECT * FROM doubled WHERE phase = {k})" for k in _PHASES.values()
    ) + "," + ",".join(fit_ctes(f"m_{name}", f"part{k}", "nation", y=y) for name, y, k in _GRID)
    + "\n" + "\nUNION ALL ".join(coefficient_rows(f"m_{name}", name) for name, _, _ in _GRID)
))
def model_grid(t):
    subsets = {label: F.col("phase") == k for label, k in _PHASES.items()}
    panel = _doubled(t).persist()
    fits = regress.model_grid(panel, nation_spec(), ["y", "y2", "y3"], subsets)
    panel.unpersist()
    return rounded_coefficients(regress.tidy(fits))


@query("subsample_fit", with_balanced(
    ", changing AS (SELECT * FROM balanced WHERE nation <> 3 AND unit IN (SELECT unit FROM balanced GROUP BY unit HAVING stddev_samp(x1) > 0.5)), "
    + fit_ctes("u", "changing", "unit") + "\n" + coefficient_rows("u", "unit_fe")
))
def subsample_fit(t):
    units = t.balanced.groupBy("unit").agg(F.stddev_samp("x1").alias("sd")).where(F.col("sd") > 0.5)
    fit = regress.subsample_fit(t.balanced, unit_spec(), F.col("nation") != 3, units, "unit")
    return rounded_coefficients(fit.coefficients())


_LEFT_OUT = (0, 3, 11, 24)


@query("leave_out_fits", with_balanced(
    "".join(f", rest{k} AS (SELECT * FROM balanced WHERE nation <> {k}), " + fit_ctes(f"o{k}", f"rest{k}", "unit") for k in _LEFT_OUT)
    + "\n" + "\nUNION ALL ".join(coefficient_rows(f"o{k}", f"without {k}") for k in _LEFT_OUT)
))
def leave_out_fits(t):
    fits = regress_leave_out.leave_out_fits(t.balanced, unit_spec(), "nation", _LEFT_OUT)
    return rounded_coefficients(regress.tidy(list(fits.values())))


def _table_sql() -> str:
    models = {"unit_fe": "u", "nation_fe": "v"}

    def cell(tag, k):
        p = t_probability_sql(f"(b{k} / se{k})", "(n_c - 1)")
        star = f"CASE WHEN {p} < 0.01 THEN '***' WHEN {p} < 0.05 THEN '**' WHEN {p} < 0.1 THEN '*' ELSE '' END"
        return f"(SELECT printf('%.3f', b{k}) || {star} FROM {tag}_fit)", f"(SELECT printf('(%.3f)', se{k}) FROM {tag}_fit)"

    rows = []
    for k, label in ((1, "Verified"), (2, "Index")):
        for line in (1, 2):
            cells = ", ".join(f"{cell(tag, k)[line - 1]} AS {m}" for m, tag in models.items())
            rows.append(f"SELECT CAST({k} AS INTEGER) AS row, '{label}' AS label, CAST({line} AS INTEGER) AS line, {cells}")
    for row, (label, form, name) in enumerate(
        [("Num.Obs.", "%d", "n"), ("R2", "%.3f", "r2"), ("R2 Adj.", "%.3f", "adj_r2")], 3
    ):
        cells = ", ".join(f"(SELECT printf('{form}', {name}) FROM {tag}_fit) AS {m}" for m, tag in models.items())
        rows.append(f"SELECT CAST({row} AS INTEGER), '{label}', CAST(1 AS INTEGER), {cells}")
    return "\nUNION ALL ".join(rows)


@query("regression_table", with_balanced(
    ", " + fit_ctes("u", "balanced", "unit") + ", " + fit_ctes("v", "balanced", "nation") + "\n" + _table_sql()
))
def regression_table(t):
    panel = t.balanced.persist()
    fits = regress.fit_all(panel, [unit_spec(), nation_spec()])
    panel.unpersist()
    return regress.regression_table(fits, {"x1": "Verified", "x2": "Index"})


@query("marginal_effects", with_balanced(
    ", crossed AS (SELECT *, x1 * x2 AS x12 FROM balanced), " + fit_ctes("u", "crossed", "unit", a="x1", b="x12")
    + "".join(
        f"\n{'UNION ALL ' if i else ''}SELECT CAST({p} AS DOUBLE) AS prob, {r('q')} AS moderator, {r('b1 + b2 * q')} AS effect"
        f" FROM u_fit, (SELECT quantile_cont(x2, {p}) AS q FROM balanced)" for i, p in enumerate((0.25, 0.5, 0.75))
    )
))
def marginal_effects(t):
    spec = ModelSpec("y", (main("x1"), interaction(main("x1"), main("x2"))), ("unit", "yr"), "firm")
    fit = regress.fe_ols(t.balanced, spec)
    out = regress.marginal_effects(fit, t.balanced, "x1", "x1:x2", "x2", [0.25, 0.5, 0.75])
    return round_all(out, "moderator", "effect")
