"""Joins, lookups and nearest-site matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, spatial
from ..operators.aggregates import unit_dispersion
from .registry import query
from .tables import r, round_all, with_nation_years, with_panel


@query("join_inner_key", """
SELECT o_orderkey, o_custkey, c_nationkey, c_mktsegment FROM orders
JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def join_inner_key(t):
    units = t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    rows = joins.join_on(
        t.orders.select("o_orderkey", "o_custkey"), units, {"o_custkey": "c_custkey"},
        ["c_nationkey", "c_mktsegment"], how="inner",
    )
    return rows


@query("join_left_dim", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS firm FROM orders),
     d AS (SELECT CASE WHEN c_acctbal >= 0 THEN c_custkey END AS firm, min(c_mktsegment) AS segment FROM customer GROUP BY 1)
SELECT o_orderkey, o.firm, segment FROM o LEFT JOIN d ON o.firm IS NOT DISTINCT FROM d.firm""")
def join_left_dim(t):
    # A large part of the facts has no firm id, and the dimension has such a row too.
    facts = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("firm"))
    firm = F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).alias("firm")
    dim = t.customer.groupBy(firm).agg(F.min("c_mktsegment").alias("segment"))
    return joins.join_on(facts, dim, ["firm"], null_safe=True)


@query("join_left_composite", with_nation_years("""
SELECT unit, p.yr, p.nation, idx FROM panel p LEFT JOIN nation_years n ON p.nation = n.nation AND p.yr = n.yr"""))
def join_left_composite(t):
    return joins.join_on(t.panel.select("unit", "yr", "nation"), t.nation_years, ["nation", "yr"])


_SITES = """
cust AS (SELECT c_custkey, c_nationkey AS country, CAST(c_custkey * 37 % 60 AS DOUBLE) AS lat,
                CAST(c_custkey * 53 % 90 AS DOUBLE) AS lon FROM customer),
supp AS (SELECT s_suppkey, s_name, s_nationkey AS country, CAST(s_suppkey * 37 % 60 AS DOUBLE) AS lat,
                CAST(s_suppkey * 53 % 90 AS DOUBLE) AS lon FROM supplier)"""
_DISTANCE = (
    "2 * 6378.137 * asin(least(1.0, sqrt(pow(sin(radians(s.lat - c.lat) / 2), 2)"
    " + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2))))"
)
_NEAREST = f"""
pairs AS (SELECT c.*, s.s_suppkey, s.s_name, s.lat AS s_lat, s.lon AS s_lon, {_DISTANCE} AS d
          FROM cust c JOIN supp s ON c.country = s.country),
nearest AS (SELECT * EXCLUDE k FROM (SELECT *, rank() OVER (PARTITION BY c_custkey ORDER BY d) AS k FROM pairs)
            WHERE k = 1)"""


def customer_sites(t):
    return t.customer.select(
        "c_custkey", F.col("c_nationkey").alias("country"),
        (F.col("c_custkey") * 37 % 60).cast("double").alias("lat"),
        (F.col("c_custkey") * 53 % 90).cast("double").alias("lon"),
    )


def supplier_sites(t):
    return t.supplier.select(
        "s_suppkey", "s_name", F.col("s_nationkey").alias("country"),
        (F.col("s_suppkey") * 37 % 60).cast("double").alias("s_lat"),
        (F.col("s_suppkey") * 53 % 90).cast("double").alias("s_lon"),
    )


SITE_COLUMNS = dict(country="country", left_place=("lat", "lon"), right_place=("s_lat", "s_lon"))


@query("join_left_triple", f"""
WITH {_SITES}, {_NEAREST}
SELECT c_custkey, n.s_suppkey, CAST(s_acctbal AS DOUBLE) AS s_acctbal FROM nearest n
LEFT JOIN (SELECT s_name, s_acctbal, CAST(s_suppkey * 37 % 60 AS DOUBLE) AS lat,
                  CAST(s_suppkey * 53 % 90 AS DOUBLE) AS lon FROM supplier) x
  ON n.s_name = x.s_name AND n.s_lat = x.lat AND n.s_lon = x.lon""")
def join_left_triple(t):
    matches = spatial.nearest_match(customer_sites(t), supplier_sites(t), **SITE_COLUMNS)
    codes = t.supplier.select(
        F.col("s_name").alias("site_name"), "s_acctbal",
        (F.col("s_suppkey") * 37 % 60).cast("double").alias("site_lat"),
        (F.col("s_suppkey") * 53 % 90).cast("double").alias("site_lon"),
    )
    keys = {"s_name": "site_name", "s_lat": "site_lat", "s_lon": "site_lon"}
    return joins.join_on(matches, codes, keys, ["s_acctbal"]).select("c_custkey", "s_suppkey", "s_acctbal")


_AREAS = {"AFRICA": "AF", "ASIA": "AS", "EUROPE": "EU"}


@query("join_inner_lookup", """
SELECT n_nationkey, n_name, r_name, code FROM nation JOIN region ON n_regionkey = r_regionkey
JOIN (VALUES ('AFRICA', 'AF'), ('ASIA', 'AS'), ('EUROPE', 'EU')) v(k, code) ON r_name = k""")
def join_inner_lookup(t):
    rows = joins.join_on(t.nation, t.region, {"n_regionkey": "r_regionkey"}, how="inner")
    return joins.join_inner_lookup(rows, _AREAS, "r_name", "code").select(
        "n_nationkey", "n_name", "r_name", "code"
    )


@query("dict_lookup", """
SELECT p_partkey, p_type, CASE p_type WHEN 'SMALL' THEN 'S' WHEN 'MEDIUM' THEN 'M' WHEN 'LARGE' THEN 'L' END AS size_code
FROM part""")
def dict_lookup(t):
    sizes = {"SMALL": "S", "MEDIUM": "M", "LARGE": "L"}
    return joins.dict_lookup(t.part.select("p_partkey", "p_type"), sizes, "p_type", "size_code")


@query("join_rekey_by_name", """
WITH names AS (SELECT 'P' || p_size AS name, min(p_partkey) AS id FROM part GROUP BY p_size
               UNION ALL SELECT 'P' || p_size, max(p_partkey) FROM part WHERE p_size % 5 = 0 GROUP BY p_size)
SELECT o_orderkey, 'P' || (o_orderkey % 60) AS name, id
FROM orders LEFT JOIN names ON names.name = 'P' || (o_orderkey % 60)""")
def join_rekey_by_name(t):
    # Some names carry two ids, so rows fan out, as the join semantics say.
    label = F.concat(F.lit("P"), F.col("p_size").cast("string")).alias("name")
    first = t.part.groupBy(label).agg(F.min("p_partkey").alias("id"))
    second = t.part.where(F.col("p_size") % 5 == 0).groupBy(label).agg(F.max("p_partkey").alias("id"))
    rows = t.orders.select(
        "o_orderkey", F.col("o_custkey").alias("id"),
        F.concat(F.lit("P"), (F.col("o_orderkey") % 60).cast("string")).alias("name"),
    )
    return joins.join_rekey_by_name(rows, first.unionByName(second), "name", "id")


@query("join_fanout_check", """
WITH k AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_values FROM orders GROUP BY o_custkey)
SELECT o_custkey, n_values FROM k WHERE n_values > 1""")
def join_fanout_check(t):
    return joins.fanout_keys(t.orders, "o_custkey", "o_orderpriority")


@query("join_fanout_report", """
SELECT 'before' AS side, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys FROM orders
UNION ALL
SELECT 'after', count(*), count(DISTINCT o_orderkey) FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""")
def join_fanout_report(t):
    orders = t.orders.select("o_orderkey")
    after = orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left")
    return joins.fanout_report(orders, after, "o_orderkey")


_VARYING = "(SELECT unit FROM panel WHERE own IS NOT NULL GROUP BY unit HAVING stddev_samp(own) > 0)"


@query("semi_join_ids", with_panel(f"SELECT unit, yr, own FROM panel WHERE unit IN {_VARYING}"))
def semi_join_ids(t):
    return joins.semi_join_ids(t.panel.select("unit", "yr", "own"), unit_dispersion(t.panel, "unit", "own"), "unit")


@query("anti_join_ids", """
SELECT l_orderkey, l_linenumber, firm FROM (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE l_suppkey END AS firm FROM lineitem)
WHERE firm IS NOT NULL AND firm NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def anti_join_ids(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_suppkey") % 6 != 0, F.col("l_suppkey")).alias("firm")
    )
    known = t.supplier.where(F.col("s_acctbal") > 0).select(F.col("s_suppkey").alias("firm"))
    return joins.anti_join_ids(rows, known, "firm")


@query("nearest_match", f"WITH {_SITES}, {_NEAREST} SELECT c_custkey, s_suppkey, {r('d')} AS dist_km FROM nearest")
def nearest_match(t):
    matches = spatial.nearest_match(customer_sites(t), supplier_sites(t), **SITE_COLUMNS)
    return round_all(matches.select("c_custkey", "s_suppkey", "dist_km"), "dist_km")


@query("nearest_within_radius", f"""
WITH {_SITES}, {_NEAREST} SELECT c_custkey, s_suppkey, {r('d')} AS dist_km FROM nearest WHERE d < 500""")
def nearest_within_radius(t):
    matches = spatial.nearest_within_radius(customer_sites(t), supplier_sites(t), radius_km=500, **SITE_COLUMNS)
    return round_all(matches.select("c_custkey", "s_suppkey", "dist_km"), "dist_km")


@query("match_rate_report", f"""
WITH {_SITES}, {_NEAREST}, one AS (SELECT c_custkey, min(d) AS d FROM nearest GROUP BY c_custkey)
SELECT count(*) AS n, count(d) AS n_matched, {r('avg(CAST(d IS NOT NULL AS INTEGER))')} AS share_matched,
       {r('avg(CAST(coalesce(d < 500, false) AS INTEGER))')} AS share_within_500,
       {r('avg(CAST(coalesce(d < 1000, false) AS INTEGER))')} AS share_within_1000
FROM orders LEFT JOIN one ON o_custkey = c_custkey""")
def match_rate_report(t):
    matches = spatial.nearest_match(customer_sites(t), supplier_sites(t), **SITE_COLUMNS)
    best = spatial.best_match_per_row(matches.select("c_custkey", "s_suppkey", "dist_km"), "c_custkey", ["dist_km", "s_suppkey"])
    panel = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    report = joins.match_rate_report(panel, best, "c_custkey", "dist_km", [500, 1000])
    return round_all(report, "share_matched", "share_within_500", "share_within_1000")
