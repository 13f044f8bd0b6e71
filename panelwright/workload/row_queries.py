"""Projections and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import to_number
from ..operators import filters, projection
from ..operators.aggregates import n_distinct
from .registry import query
from .tables import with_panel


@query("project_rename", """
SELECT c_custkey AS id, c_name AS name, c_nationkey AS registry_id, c_mktsegment AS sector FROM customer""")
def project_rename(t):
    return projection.project_rename(
        t.customer, {"id": "c_custkey", "name": "c_name", "registry_id": "c_nationkey", "sector": "c_mktsegment"}
    )


@query("transmute", """
SELECT event_id, CAST(ts AS DATE) AS day, CAST(value AS VARCHAR) AS price_text FROM events""")
def transmute(t):
    return projection.transmute(
        t.events,
        {"event_id": F.col("event_id"), "day": F.to_date("ts"), "price_text": F.col("value").cast("string")},
    )


def wide_revenue(t):
    """One column per year for each unit, as firm exports have it."""
    years = range(1995, 2002)
    return t.unit_years.groupBy("unit").agg(
        *[F.max(F.when(F.col("yr") == y, F.col("verified"))).alias(f"Operating revenue EUR {y}") for y in years],
        *[F.max(F.when(F.col("yr") == y, F.col("n_orders"))).alias(f"Number of employees {y}") for y in years],
    )


def wide_sql(*families: tuple[str, str]) -> str:
    return ",\n  ".join(
        f"max(CASE WHEN yr = {y} THEN {value} END) AS \"{name}{y}\""
        for name, value in families for y in range(1995, 2002)
    )


REVENUE = ("Operating revenue EUR ", "verified")
EMPLOYEES = ("Number of employees ", "n_orders")


@query("select_by_prefix", with_panel(f"SELECT unit, {wide_sql(REVENUE)} FROM panel GROUP BY unit"))
def select_by_prefix(t):
    return projection.select_by_prefix(wide_revenue(t), "Operating revenue", keep=["unit"])


_YEAR_COLUMNS = ", ".join(
    f"max(CASE WHEN yr = {y} THEN n_orders END) AS \"{y}\"" for y in range(1995, 2002)
)


@query("select_by_regex", with_panel(f"SELECT unit, {_YEAR_COLUMNS} FROM panel GROUP BY unit"))
def select_by_regex(t):
    wide = t.unit_years.groupBy("unit").agg(
        F.min("code").alias("code"), F.max("yr").alias("y2001x"),
        *[F.max(F.when(F.col("yr") == y, F.col("n_orders"))).alias(str(y)) for y in range(1995, 2002)],
    )
    return projection.select_by_regex(wide, r"^\d{4}$", keep=["unit"])


@query("drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def drop_columns(t):
    return projection.drop_columns(t.orders, "o_totalprice", "o_orderdate", "o_orderpriority")


@query("drop_if_exists", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def drop_if_exists(t):
    return projection.drop_if_exists(t.orders, "o_totalprice", "eua_price")


_ACROSS = with_panel(
    "SELECT unit, " + ", ".join(
        f"try_cast(nullif(CASE WHEN unit % 7 = 0 THEN 'n.a.' ELSE CAST(max(CASE WHEN yr = {y} THEN n_orders END) AS VARCHAR) END, 'n.a.') AS DOUBLE)"
        f" AS \"Number of employees {y}\"" for y in range(1995, 2002)
    ) + " FROM panel GROUP BY unit"
)


@query("across_apply", _ACROSS)
def across_apply(t):
    wide = projection.select_by_prefix(wide_revenue(t), "Number of employees", keep=["unit"])
    names = projection.names_with_prefix(wide, "Number of employees")
    as_text = projection.across_apply(
        wide, names, lambda c: F.when(F.col("unit") % 7 == 0, "n.a.").otherwise(c.cast("string"))
    )
    return projection.across_apply(as_text, names, lambda c: to_number(c, "n.a."))


@query("rename_column", "SELECT s_suppkey AS firm, s_name, s_nationkey, s_acctbal FROM supplier")
def rename_column(t):
    return projection.rename_column(t.supplier, "s_suppkey", "firm")


@query("pull_column", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def pull_column(t):
    ids = projection.pull_column(
        t.customer.where(F.col("c_mktsegment") == "BUILDING").withColumnRenamed("c_custkey", "o_custkey"),
        "o_custkey",
    )
    return t.orders.select("o_orderkey", "o_custkey").join(ids, "o_custkey", "left_semi")


@query("filter_flags_in", """
SELECT l_orderkey, l_partkey, l_quantity FROM lineitem
WHERE NOT (l_returnflag = 'R') AND NOT (l_discount > 0.05) AND l_linenumber IN (1, 3, 5)""")
def filter_flags_in(t):
    flagged = t.lineitem.withColumns(
        {"returned": F.col("l_returnflag") == "R", "discounted": F.col("l_discount") > 0.05}
    )
    return filters.filter_flags_in(flagged, ["returned", "discounted"], "l_linenumber", [1, 3, 5]).select(
        "l_orderkey", "l_partkey", "l_quantity"
    )


@query("filter_valid_obs", with_panel("""
SELECT unit, yr, code, allocated, verified FROM panel
WHERE code IN ('F', 'O') AND verified IS NOT NULL AND verified > 0 AND allocated IS NOT NULL"""))
def filter_valid_obs(t):
    kept = filters.filter_valid_obs(t.panel, "code", ["F", "O"], "verified", ["allocated"])
    return kept.select("unit", "yr", "code", "allocated", "verified")


@query("filter_range", with_panel("SELECT unit, yr, ratio FROM panel WHERE ratio BETWEEN -1 AND 10"))
def filter_range(t):
    return filters.filter_range(t.panel, "ratio", -1, 10).select("unit", "yr", "ratio")


@query("filter_nonblank", """
SELECT page_id, shown FROM (
  SELECT page_id, CASE WHEN page_id % 9 = 0 THEN NULL WHEN page_id % 5 = 0 THEN '' ELSE url END AS shown
  FROM pages) WHERE shown IS NOT NULL AND shown <> ''""")
def filter_nonblank(t):
    shown = F.when(F.col("page_id") % 9 == 0, None).when(F.col("page_id") % 5 == 0, "").otherwise(F.col("url"))
    return filters.filter_nonblank(t.pages.select("page_id", shown.alias("shown")), "shown")


@query("filter_equals", """
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'""")
def filter_equals(t):
    rows = filters.filter_equals(t.orders, "o_orderstatus", "F")
    rows = filters.filter_equals(rows, "o_orderpriority", "1-URGENT", negate=True)
    return rows.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("filter_in_set", "SELECT p_partkey, p_type FROM part WHERE p_type IN ('SMALL', 'LARGE')")
def filter_in_set(t):
    return filters.filter_in_set(t.part, "p_type", ["SMALL", "LARGE"]).select("p_partkey", "p_type")


@query("filter_not_null", with_panel("SELECT unit, yr, verified FROM panel WHERE verified IS NOT NULL"))
def filter_not_null(t):
    return filters.filter_not_null(t.panel.select("unit", "yr", "verified"), "verified")


@query("filter_threshold", with_panel("SELECT unit, yr, ratio FROM panel WHERE ratio > 0.5 AND ratio <= 100"))
def filter_threshold(t):
    return filters.filter_threshold(t.panel.select("unit", "yr", "ratio"), "ratio", above=0.5, at_most=100)


@query("drop_na_listwise", with_panel("""
SELECT ratio, lag_own FROM (
  SELECT ratio, lag(own) OVER (PARTITION BY unit ORDER BY yr) AS lag_own FROM panel)
WHERE ratio IS NOT NULL AND lag_own IS NOT NULL"""))
def drop_na_listwise(t):
    from ..operators.ordered import with_previous

    rows = with_previous(t.panel, ["unit"], ["yr"], ["own"], "lag_", bounded=True)
    return filters.drop_na_listwise(rows, ["ratio", "lag_own"])


@query("filter_regex_ci", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)RED|gear$')")
def filter_regex_ci(t):
    return filters.filter_regex_ci(t.part, "p_name", "RED|gear$").select("p_partkey", "p_name")


@query("filter_group_having", """
SELECT o_custkey, count(*) AS n_orders, count(DISTINCT o_orderpriority) AS n_priorities
FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 3""")
def filter_group_having(t):
    return filters.filter_group_having(
        t.orders, ["o_custkey"],
        [F.count(F.lit(1)).alias("n_orders"), n_distinct("o_orderpriority").alias("n_priorities").cast("bigint")],
        F.col("n_priorities") > 3,
    )


@query("filter_year_window", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS yr FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 1999""")
def filter_year_window(t):
    rows = t.orders.select("o_orderkey", F.year("o_orderdate").alias("yr"))
    return filters.filter_year_window(rows, "yr", 1997, 1999)


@query("bracket_cutoff_trim", with_panel("""
SELECT unit, yr, ratio, CASE WHEN ratio > (SELECT quantile_cont(ratio, 0.99) FROM panel) THEN NULL ELSE ratio END
  AS ratio_trim FROM panel"""))
def bracket_cutoff_trim(t):
    return filters.bracket_cutoff_trim(t.panel.select("unit", "yr", "ratio"), "ratio", 0.99, "ratio_trim")


@query("trim_report", with_panel("""
SELECT count(*) AS total, count(*) FILTER (ratio BETWEEN -1 AND 10) AS kept,
       count(*) FILTER (NOT ratio BETWEEN -1 AND 10) AS dropped,
       round_even(avg(CAST(NOT ratio BETWEEN -1 AND 10 AS INTEGER)) * 100, 1) AS pct_dropped
FROM panel WHERE ratio IS NOT NULL"""))
def trim_report(t):
    return filters.trim_report(t.panel, "ratio", -1, 10)
