"""Aggregates, frequency tables, coverage, quantile summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators.quantiles import quantiles as quantile_rows
from .registry import query
from .tables import r, round_all, with_nation_years, with_panel


@query("agg_group_basic", with_panel(f"""
SELECT yr, {r('coalesce(sum(verified), 0) / 1e6')} AS total, {r('avg(verified)', 3)} AS mean, count(*) AS n
FROM panel GROUP BY yr"""))
def agg_group_basic(t):
    out = agg.agg_group_basic(t.panel, ["yr"], "verified", scale=1e6)
    return round_all(round_all(out, "total"), "mean", digits=3)


@query("agg_global_summary", with_panel(f"""
SELECT count(*) AS n, count(DISTINCT unit) AS n_units, {r('avg(own)')} AS mean_own,
       {r('avg(CAST(state = 1 AS INTEGER)) * 100', 4)} AS pct_state FROM panel WHERE verified > 0"""))
def agg_global_summary(t):
    rows = t.panel.where(F.col("verified") > 0)
    out = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("unit").alias("n_units"),
        F.avg("own").alias("mean_own"), (agg.share_where(F.col("state") == 1) * 100).alias("pct_state"),
    )
    return round_all(round_all(out, "mean_own"), "pct_state", digits=4)


@query("agg_conditional_rate", f"""
SELECT n_nationkey AS nation, {r("avg(CAST(o_orderstatus = 'P' AS INTEGER))")} AS rate, count(*) AS n_obs
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey
HAVING count(*) > 100""")
def agg_conditional_rate(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    out = rows.groupBy(F.col("c_nationkey").alias("nation")).agg(
        agg.share_where(F.col("o_orderstatus") == "P").alias("rate"), F.count(F.lit(1)).alias("n_obs")
    ).where(F.col("n_obs") > 100)
    return round_all(out, "rate")


@query("agg_filtered_max", """
SELECT l_orderkey, coalesce(max(l_extendedprice) FILTER (l_returnflag = 'R'), 0) AS max_returned
FROM lineitem GROUP BY l_orderkey""")
def agg_filtered_max(t):
    largest = agg.filtered_max(F.col("l_extendedprice"), F.col("l_returnflag") == "R")
    return t.lineitem.groupBy("l_orderkey").agg(largest.alias("max_returned"))


@query("agg_capped_sum", """
SELECT l_orderkey, least(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0), 100) AS capped
FROM lineitem GROUP BY l_orderkey""")
def agg_capped_sum(t):
    total = agg.capped_sum(F.col("l_quantity"), F.col("l_returnflag") == "R", 100)
    return t.lineitem.groupBy("l_orderkey").agg(total.alias("capped"))


@query("agg_any_flag", """
SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS any_urgent FROM orders GROUP BY o_custkey""")
def agg_any_flag(t):
    return t.orders.groupBy("o_custkey").agg(agg.any_true(F.col("o_orderpriority") == "1-URGENT").alias("any_urgent"))


@query("agg_count_if", """
SELECT l_suppkey, count(*) FILTER (l_tax = 0) AS n_untaxed, count(*) FILTER (l_tax > 0.05) AS n_high FROM lineitem
GROUP BY l_suppkey""")
def agg_count_if(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count_if(F.col("l_tax") == 0).alias("n_untaxed"), F.count_if(F.col("l_tax") > 0.05).alias("n_high")
    )


@query("count_distinct", """
WITH f AS (SELECT l_returnflag, CASE WHEN l_suppkey % 10 = 3 THEN NULL ELSE l_suppkey END AS firm FROM lineitem)
SELECT l_returnflag, count(DISTINCT firm) + max(CAST(firm IS NULL AS INTEGER)) AS n_firms FROM f GROUP BY l_returnflag""")
def count_distinct(t):
    rows = t.lineitem.select(
        "l_returnflag", F.when(F.col("l_suppkey") % 10 != 3, F.col("l_suppkey")).alias("firm")
    )
    return rows.groupBy("l_returnflag").agg(agg.n_distinct("firm").alias("n_firms"))


@query("distinct_rows", "SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderstatus FROM orders")
def distinct_rows(t):
    rows = t.orders.withColumn("yr", F.year("o_orderdate"))
    return agg.distinct_rows(rows, "o_custkey", "yr", "o_orderstatus")


@query("distinct_keep_first", """
SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def distinct_keep_first(t):
    first = agg.keep_first(t.orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return first.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query("freq_table", """
SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10""")
def freq_table(t):
    return agg.freq_table(t.events, "user_id", top=10)


@query("freq_table_missing", """
SELECT x AS tag, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS x FROM events)
GROUP BY x""")
def freq_table_missing(t):
    tag = F.when(F.col("event_type") != "error", F.col("event_type"))
    return agg.freq_table(t.events.select(tag.alias("tag")), "tag")


@query("coverage_report", with_nation_years("""
SELECT p.phase, count(*) AS n, count(verified) AS n_verified,
       round_even(avg(CAST(verified IS NOT NULL AS INTEGER)) * 100, 1) AS pct_verified, count(idx) AS n_idx,
       round_even(avg(CAST(idx IS NOT NULL AS INTEGER)) * 100, 1) AS pct_idx
FROM panel p LEFT JOIN nation_years n ON p.nation = n.nation AND p.yr = n.yr GROUP BY p.phase"""))
def coverage_report(t):
    rows = t.panel.join(t.nation_years, ["nation", "yr"], "left")
    return agg.coverage_report(rows, {"verified": "verified", "idx": "idx"}, by=["phase"])


@query("coverage_by_each", with_panel("""
, known AS (SELECT CASE WHEN verified > 100000 THEN 1 END AS v, phase, nation, state FROM panel)
SELECT 'all' AS grouping, NULL AS level, count(*) AS n, round_even(avg(CAST(v IS NOT NULL AS INTEGER)) * 100, 1) AS pct_coverage FROM known
UNION ALL SELECT 'phase', CAST(phase AS VARCHAR), count(*), round_even(avg(CAST(v IS NOT NULL AS INTEGER)) * 100, 1) FROM known GROUP BY phase
UNION ALL SELECT 'nation', CAST(nation AS VARCHAR), count(*), round_even(avg(CAST(v IS NOT NULL AS INTEGER)) * 100, 1) FROM known GROUP BY nation
UNION ALL SELECT 'state', CAST(state AS VARCHAR), count(*), round_even(avg(CAST(v IS NOT NULL AS INTEGER)) * 100, 1) FROM known GROUP BY state"""))
def coverage_by_each(t):
    known = F.when(F.col("verified") > 100000, 1)
    return agg.coverage_by_each(t.panel, known, ["phase", "nation", "state"])


@query("coverage_span", with_nation_years("""
SELECT nation, min(yr) AS first_year, max(yr) AS last_year FROM nation_years WHERE idx IS NOT NULL GROUP BY nation"""))
def coverage_span(t):
    return agg.coverage_span(t.nation_years, "nation", "yr", "idx")


_PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@query("quantiles", with_panel(" UNION ALL ".join(
    f"SELECT CAST({p} AS DOUBLE) AS prob, {r(f'quantile_cont(ratio, {p})')} AS quantile FROM panel" for p in _PROBS
)))
def quantiles(t):
    return round_all(quantile_rows(t.panel, "ratio", _PROBS), "quantile")


@query("quantiles_by_group", f"""
SELECT l_returnflag, l_linestatus, CAST(p AS DOUBLE) AS prob, {r('q')} AS quantile FROM (
  SELECT l_returnflag, l_linestatus, unnest([0.1, 0.5, 0.9]) AS p, unnest(quantile_cont(l_extendedprice, [0.1, 0.5, 0.9])) AS q
  FROM lineitem GROUP BY l_returnflag, l_linestatus)""")
def quantiles_by_group(t):
    # The narrowing plan for groups too large to buffer, forced by a limit of zero rows.
    rows = quantile_rows(
        t.lineitem, "l_extendedprice", [0.1, 0.5, 0.9], ["l_returnflag", "l_linestatus"],
        buffered_rows=0, buffered_group_rows=0,
    )
    return round_all(rows, "quantile")


def _five(column: str, source: str) -> str:
    return (
        f"SELECT '{column}' AS variable, {r(f'min({column})')} AS min, {r(f'quantile_cont({column}, 0.25)')} AS q1, "
        f"{r(f'median({column})')} AS median, {r(f'avg({column})', 3)} AS mean, {r(f'quantile_cont({column}, 0.75)')} AS q3, "
        f"{r(f'max({column})')} AS max, count(*) - count({column}) AS n_missing FROM {source}"
    )


@query("five_number_summary", with_panel(" UNION ALL ".join(_five(c, "panel") for c in ("ratio", "verified", "own"))))
def five_number_summary(t):
    out = agg.five_number_summary(t.panel, ["ratio", "verified", "own"])
    return round_all(round_all(out, "min", "q1", "median", "q3", "max"), "mean", digits=3)


@query("group_dispersion", with_panel(f"""
, per_unit AS (SELECT unit, min(nation) AS nation, stddev_samp(own) AS sd, avg(own) AS mean, max(own) - min(own) AS change
               FROM panel WHERE own IS NOT NULL GROUP BY unit HAVING stddev_samp(own) > 0)
SELECT nation, count(*) AS n_units, {r('avg(sd)')} AS mean_sd, {r('avg(mean)')} AS mean_own, {r('max(change)')} AS max_change
FROM per_unit GROUP BY nation"""))
def group_dispersion(t):
    per_unit = agg.unit_dispersion(t.panel, "unit", "own", F.min_by("nation", "yr").alias("nation"))
    out = per_unit.groupBy("nation").agg(
        F.count(F.lit(1)).alias("n_units"), F.avg("sd").alias("mean_sd"), F.avg("mean").alias("mean_own"),
        F.max("change").alias("max_change"),
    )
    return round_all(out, "mean_sd", "mean_own", "max_change")


@query("changed_units", """
SELECT o_custkey, min(o_orderpriority) AS min_value, max(o_orderpriority) AS max_value FROM orders GROUP BY o_custkey
HAVING min(o_orderpriority) <> max(o_orderpriority)""")
def changed_units(t):
    return agg.changed_units(t.orders, "o_custkey", "o_orderpriority")


@query("coef_of_variation", with_panel(f"""
SELECT unit, {r('CASE WHEN avg(n_orders) <> 0 THEN stddev_samp(n_orders) / avg(n_orders) END')} AS cv
FROM panel WHERE n_orders IS NOT NULL GROUP BY unit"""))
def coef_of_variation(t):
    return round_all(agg.coef_of_variation(t.panel, "unit", "n_orders"), "cv")


@query("nested_freq", """
WITH f AS (SELECT c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation, count(*) AS n FROM customer GROUP BY ALL)
SELECT segment, string_agg(nation || '=' || n, ',' ORDER BY nation) AS nations FROM f GROUP BY segment""")
def nested_freq(t):
    nested = agg.nested_freq(
        t.customer.select(F.col("c_mktsegment").alias("segment"), "c_nationkey"), "c_nationkey", "nations", ["segment"]
    )
    entries = F.transform(
        F.array_sort(F.map_entries("nations")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    )
    return nested.select("segment", F.array_join(entries, ",").alias("nations"))


@query("first_value_group", """
SELECT l_orderkey, arg_min(l_shipdate, (l_partkey, l_suppkey, l_linenumber, l_shipdate)) AS first_ship,
       arg_min(l_quantity, (l_partkey, l_suppkey, l_linenumber, l_shipdate, l_quantity)) AS first_quantity
FROM lineitem GROUP BY l_orderkey""")
def first_value_group(t):
    order = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_quantity")]
    first = t.lineitem.groupBy("l_orderkey").agg(agg.first_by(["l_shipdate", "l_quantity"], order).alias("_f"))
    return first.select(
        "l_orderkey", F.col("_f.l_shipdate").alias("first_ship"), F.col("_f.l_quantity").alias("first_quantity")
    )


@query("matched_vs_unmatched", with_panel(f"""
SELECT unit % 3 = 0 AS matched, count(*) AS n_obs, count(DISTINCT unit) AS n_units, {r('avg(verified)', 3)} AS mean_value,
       {r('median(verified)', 3)} AS median_value, {r('avg(CAST(own > 0 AS INTEGER))')} AS share_positive
FROM panel GROUP BY unit % 3 = 0"""))
def matched_vs_unmatched(t):
    rows = t.panel.withColumn("matched", F.col("unit") % 3 == 0)
    out = agg.matched_vs_unmatched(rows, "matched", "unit", "verified", "own")
    return round_all(round_all(out, "mean_value", "median_value", digits=3), "share_positive")


@query("value_range", "SELECT min(ts) AS low, max(ts) AS high FROM events")
def value_range(t):
    return agg.value_range(t.events, "ts")
