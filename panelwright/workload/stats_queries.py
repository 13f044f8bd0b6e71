"""Correlations, tests, histograms, box plots, trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import labelled
from ..operators import stats
from .registry import query
from .tables import r, round_all, with_nation_years, with_panel

_VARS = ("ratio", "own", "n_orders", "abroad")
_COMPLETE = " AND ".join(f"{v} IS NOT NULL" for v in _VARS)


def _safe_r(a: str, b: str) -> str:
    return f"CASE WHEN stddev_samp({a}) * stddev_samp({b}) <> 0 THEN covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) END"


def _matrix_sql(source: str, by: str = "", variables=_VARS, having: str = "") -> str:
    lead, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    cells = []
    for a in variables:
        for b in variables:
            value = f"CASE WHEN max({a}) <> min({a}) THEN 1.0 END" if a == b else _safe_r(a, b)
            cells.append(f"SELECT {lead}count(*) AS n, '{a}' AS x, '{b}' AS y, {r(value)} AS r FROM {source} {group} {having}")
    return "\nUNION ALL ".join(cells)


@query("corr_matrix", with_panel(f", complete AS (SELECT * FROM panel WHERE {_COMPLETE})\n" + _matrix_sql("complete")))
def corr_matrix(t):
    return round_all(stats.corr_matrix(t.panel, _VARS), "r")


@query("corr_matrix_by_group", with_panel(
    f", complete AS (SELECT *, CASE WHEN unit % 400 = 0 THEN 'rare' ELSE segment END AS sector FROM panel WHERE {_COMPLETE})\n"
    + _matrix_sql("complete", "sector", having="HAVING count(*) > 50")
))
def corr_matrix_by_group(t):
    sector = F.when(F.col("unit") % 400 == 0, "rare").otherwise(F.col("segment"))
    out = stats.corr_matrix(t.panel.withColumn("sector", sector), _VARS, by=["sector"], more_than=50)
    return round_all(out, "r")


@query("corr_pairwise", with_nation_years(f"""
, b AS (SELECT own, idx FROM panel p LEFT JOIN nation_years n ON p.nation = n.nation AND p.yr = n.yr
        WHERE own IS NOT NULL AND idx IS NOT NULL)
SELECT {r(_safe_r('own', 'idx'))} AS r, count(*) AS n FROM b"""))
def corr_pairwise(t):
    rows = t.panel.join(t.nation_years, ["nation", "yr"], "left")
    return round_all(stats.corr_pairwise(rows, "own", "idx"), "r")


def t_probability_sql(t: str, df: str) -> str:
    """Two-sided Student t probability for integer degrees of freedom, as a finite series."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    even = (
        f"sin({angle}) * (1 + coalesce(list_sum(list_transform(generate_series(1, CAST(({df} - 2) // 2 AS BIGINT)),"
        f" lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1) - lgamma(0.5)) * pow(cos({angle}), 2 * j))), 0))"
    )
    odd = (
        f"2 / pi() * ({angle} + CASE WHEN {df} > 1 THEN sin({angle}) * cos({angle}) * coalesce(list_sum(list_transform("
        f"generate_series(0, CAST(({df} - 3) // 2 AS BIGINT)), lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5))"
        f" * pow(cos({angle}), 2 * j))), 0) ELSE 0 END)"
    )
    return f"(1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


@query("corr_test", with_nation_years(f"""
, cells AS (SELECT idx, CAST(nation * yr % 17 AS DOUBLE) AS z FROM nation_years WHERE idx IS NOT NULL),
m AS (SELECT corr(idx, z) AS r, count(*) AS n FROM cells),
s AS (SELECT r, n, r * sqrt(n - 2) / sqrt(1 - r * r) AS t, n - 2 AS df,
             tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)) AS lo, tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)) AS hi FROM m)
SELECT {r('r')} AS r, n, {r('t')} AS t, df, {r('lo')} AS conf_low, {r('hi')} AS conf_high, {r(t_probability_sql('t', 'df'))} AS p_value FROM s"""))
def corr_test(t):
    rows = t.nation_years.withColumn("z", (F.col("nation") * F.col("yr") % 17).cast("double"))
    return round_all(stats.corr_test(rows, "idx", "z"), "r", "t", "conf_low", "conf_high", "p_value")


@query("two_level_mean", with_nation_years(f"""
, cells AS (SELECT DISTINCT p.nation, p.yr, idx, idx * 2 + p.yr AS price FROM panel p
            JOIN nation_years n ON p.nation = n.nation AND p.yr = n.yr WHERE idx IS NOT NULL)
SELECT yr, {r('avg(idx)')} AS idx_mean, {r('avg(price)')} AS price_mean FROM cells GROUP BY yr"""))
def two_level_mean(t):
    rows = t.panel.join(t.nation_years, ["nation", "yr"], "left").withColumn("price", F.col("idx") * 2 + F.col("yr"))
    return round_all(stats.two_level_mean(rows, "nation", "yr", ["idx", "price"]), "idx_mean", "price_mean")


@query("histogram_bins", with_panel(f"""
, v AS (SELECT 'Phase ' || phase AS facet, ratio FROM panel WHERE ratio BETWEEN -1 AND 10),
e AS (SELECT min(ratio) AS lo, max(ratio) AS hi FROM v),
b AS (SELECT facet, least(CAST(floor((ratio - lo) / (hi - lo) * 60) AS INTEGER) + 1, 60) AS bin, lo, (hi - lo) / 60 AS w FROM v, e)
SELECT facet, bin, count(*) AS n, {r('any_value(lo + w * (bin - 1))')} AS bin_low, {r('any_value(lo + w * bin)')} AS bin_high
FROM b GROUP BY facet, bin"""))
def histogram_bins(t):
    rows = t.panel.where(F.col("ratio").between(-1, 10)).withColumn("facet", labelled("Phase", F.col("phase")))
    return round_all(stats.histogram_bins(rows, "ratio", 60, ["facet"]), "bin_low", "bin_high")


@query("boxplot_stats", with_panel(f"""
, v AS (SELECT phase, state, ratio FROM panel WHERE ratio BETWEEN -1 AND 2),
q AS (SELECT phase, state, quantile_cont(ratio, 0.25) AS q1, median(ratio) AS q2, quantile_cont(ratio, 0.75) AS q3 FROM v GROUP BY ALL),
f AS (SELECT v.*, q1, q2, q3, ratio BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS inside FROM v JOIN q USING (phase, state))
SELECT phase, state, count(*) AS n, {r('any_value(q1)')} AS q1, {r('any_value(q2)')} AS median, {r('any_value(q3)')} AS q3,
       {r('min(ratio) FILTER (inside)')} AS whisker_low, {r('max(ratio) FILTER (inside)')} AS whisker_high,
       count(*) FILTER (NOT inside) AS n_outliers FROM f GROUP BY phase, state"""))
def boxplot_stats(t):
    rows = t.panel.where(F.col("ratio").between(-1, 2))
    out = stats.boxplot_stats(rows, "ratio", ["phase", "state"])
    return round_all(out, "q1", "median", "q3", "whisker_low", "whisker_high")


@query("linear_trend", with_panel(f"""
, m AS (SELECT phase, regr_count(ratio, own) AS n, regr_slope(ratio, own) AS b, regr_intercept(ratio, own) AS a,
               regr_sxx(ratio, own) AS sxx, regr_syy(ratio, own) AS syy, regr_sxy(ratio, own) AS sxy, regr_avgx(ratio, own) AS mx
        FROM panel WHERE ratio BETWEEN -1 AND 10 GROUP BY phase),
s AS (SELECT *, (syy - b * sxy) / (n - 2) AS v FROM m)
SELECT phase, CAST(n AS BIGINT) AS n, {r('b')} AS slope, {r('a')} AS intercept, {r('sqrt(v / sxx)')} AS slope_se,
       {r('sqrt(v * (1.0 / n + mx * mx / sxx))')} AS intercept_se, {r('v')} AS residual_variance, {r('mx')} AS mean_x,
       {r('sxx', 3)} AS sxx FROM s"""))
def linear_trend(t):
    out = stats.linear_trend(t.panel.where(F.col("ratio").between(-1, 10)), "own", "ratio", ["phase"])
    out = round_all(out, "slope", "intercept", "slope_se", "intercept_se", "residual_variance", "mean_x")
    return round_all(out, "sxx", digits=3)


@query("time_trend_series", with_panel(f"""
SELECT yr, phase, {r('sum(verified) / 1e6')} AS total_emissions, {r('avg(ratio)')} AS mean_ratio, {r('median(ratio)')} AS median_ratio
FROM panel GROUP BY yr, phase"""))
def time_trend_series(t):
    out = stats.time_trend_series(
        t.panel, "yr", {"total_emissions": F.sum("verified") / 1e6, "mean_ratio": F.avg("ratio")}, "ratio", ["phase"]
    )
    return round_all(out, "total_emissions", "mean_ratio", "median_ratio")
