"""Lag, fill, complete, dedupe, sort; set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.recode import lookup
from ..operators import aggregates, ordered, reshape
from .registry import query
from .row_queries import wide_revenue
from .tables import r, round_all, with_nation_years, with_panel


@query("lag_growth", with_panel(f"""
SELECT unit, yr, {r('CASE WHEN before <> 0 THEN (verified - before) / before END')} AS growth
FROM (SELECT *, lag(verified) OVER (PARTITION BY unit ORDER BY yr) AS before FROM panel)"""))
def lag_growth(t):
    # One row per unit and year after the aggregation, so a unit has few rows.
    out = ordered.lag_growth(t.panel, ["unit"], "yr", "verified", "growth", bounded=True)
    return round_all(out.select("unit", "yr", "growth"), "growth")


@query("change_events", """
WITH c AS (SELECT o_custkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b
           FROM orders)
SELECT o_custkey, count(*) AS n_changes FROM c WHERE o_orderstatus <> b GROUP BY o_custkey""")
def change_events(t):
    # Raw orders: one customer may hold any share of them, so blocks are used.
    return ordered.change_events(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus")


@query("dedupe_by_priority", """
SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey) = 1""")
def dedupe_by_priority(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    return aggregates.dedupe_by_priority(rows, ["o_custkey"], "o_orderstatus", "F", ["o_orderkey"])


@query("ffill_group", with_nation_years(f"""
, filled AS (SELECT nation, yr, last_value(idx IGNORE NULLS) OVER (PARTITION BY nation ORDER BY yr) AS idx FROM nation_years)
SELECT unit, p.yr, p.nation, {r('idx')} AS idx FROM panel p JOIN filled f ON p.nation = f.nation AND p.yr = f.yr"""))
def ffill_group(t):
    rows = t.panel.select("unit", "yr", "nation").join(t.nation_years, ["nation", "yr"], "left")
    return round_all(ordered.ffill_by_level(rows, "nation", "yr", "idx"), "idx")


@query("ffill_group_rows", """
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
         OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_purchase
FROM events""")
def ffill_group_rows(t):
    # Fill over raw events: a user may hold any share of the rows.
    rows = t.events.select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("last_purchase")
    )
    return ordered.ffill_group(rows, ["user_id"], ["ts", "event_id"], ["last_purchase"]).drop("ts")


@query("ffill_row_order", """
WITH s AS (SELECT conv_id * 1000 + turn AS row_no, CASE WHEN turn = 0 THEN 'conv ' || conv_id END AS parent, role, text
           FROM conversations)
SELECT row_no, role, length(text) AS n_chars, last_value(parent IGNORE NULLS) OVER (ORDER BY row_no) AS parent FROM s""")
def ffill_row_order(t):
    parent = F.when(F.col("turn") == 0, F.concat(F.lit("conv "), F.col("conv_id").cast("string")))
    sheet = t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_no"), parent.alias("parent"), "role",
        F.length("text").cast("bigint").alias("n_chars"),
    )
    return ordered.ffill_row_order(sheet, "row_no", ["parent"], block_rows=5_000, blocks_per_group=10)


@query("complete_years", with_panel("""
, spine AS (SELECT unit, CAST(s.yr AS INTEGER) AS yr FROM (SELECT DISTINCT unit FROM panel), generate_series(1996, 2003) s(yr))
SELECT unit, yr, n_orders FROM spine FULL JOIN (SELECT unit, yr, n_orders FROM panel) USING (unit, yr)"""))
def complete_years(t):
    return ordered.complete_years(t.unit_years.select("unit", "yr", "n_orders"), ["unit"], "yr", 1996, 2003)


@query("rank_min_ties", """
SELECT p_brand, p_partkey, p_size FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_size) = 1""")
def rank_min_ties(t):
    return ordered.rank_min_ties(t.part.select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size")


@query("sort_multi", with_panel("SELECT nation, unit, yr, ratio FROM panel ORDER BY nation, ratio DESC NULLS LAST, unit, yr"))
def sort_multi(t):
    rows = t.panel.select("nation", "unit", "yr", "ratio")
    return ordered.sort_multi(rows, ("nation", True), ("ratio", False), ("unit", True), ("yr", True))


@query("topk_outliers", with_panel("""
SELECT unit, yr, allocated, verified, ratio FROM panel WHERE ratio > 5 ORDER BY ratio DESC, unit, yr LIMIT 20"""))
def topk_outliers(t):
    rows = t.panel.select("unit", "yr", "allocated", "verified", "ratio")
    return ordered.topk_outliers(rows, "ratio", 5, 20, ["unit", "yr"])


@query("limit_rows", "SELECT page_id, url FROM pages ORDER BY url, page_id LIMIT 20")
def limit_rows(t):
    return ordered.limit_rows(t.pages.select("page_id", "url"), 20, ["url", "page_id"])


@query("reorder_levels", """
WITH s AS (SELECT c_nationkey AS nation, CAST(count(*) FILTER (o_orderstatus = 'P') AS DOUBLE) / count(*) AS statistic
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey)
SELECT nation, round(statistic, 6) AS statistic, CAST(row_number() OVER (ORDER BY statistic, nation) AS INTEGER) AS level_rank FROM s""")
def reorder_levels(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("c_nationkey", "nation")
    rate = F.count_if(F.col("o_orderstatus") == "P").cast("double") / F.count(F.lit(1))
    ranked = ordered.reorder_levels(rows, "nation", rate)
    return round_all(ranked, "statistic").withColumn("level_rank", F.col("level_rank").cast("int"))


@query("reorder_levels_fixed", """
SELECT p_type, count(*) AS n, CASE p_type WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LARGE' THEN 3 END AS level_rank
FROM part GROUP BY p_type""")
def reorder_levels_fixed(t):
    ranks = {"SMALL": 1, "MEDIUM": 2, "LARGE": 3}
    return aggregates.freq_table(t.part, "p_type").withColumn("level_rank", lookup(ranks, F.col("p_type")))


@query("union_by_name", """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def union_by_name(t):
    buyers = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    sellers = t.supplier.select(
        F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")
    )
    return reshape.union_by_name(buyers, sellers)


@query("unpivot_years", with_panel("""
SELECT u.unit, CAST(s.yr AS INTEGER) AS year, verified AS revenue
FROM (SELECT DISTINCT unit FROM panel) u, generate_series(1995, 2001) s(yr)
LEFT JOIN panel p ON p.unit = u.unit AND p.yr = s.yr"""))
def unpivot_years(t):
    wide = wide_revenue(t)
    names = [n for n in wide.columns if n.startswith("Operating revenue")]
    return reshape.unpivot_years(wide, ["unit"], names, "revenue")


@query("unpivot_all", with_panel("""
SELECT 'own' AS variable, own AS value FROM panel WHERE own > 0
UNION ALL SELECT 'ratio', ratio FROM panel WHERE ratio > 0"""))
def unpivot_all(t):
    return reshape.unpivot_all(t.panel.select("own", "ratio")).where(F.col("value") > 0)


@query("pivot_flag", """
WITH m AS (SELECT c_nationkey AS nation, c_custkey, (c_custkey % 5 = 0 AND c_nationkey <> 3) AS matched FROM customer),
     w AS (SELECT nation, count(DISTINCT c_custkey) FILTER (NOT matched) AS f, count(DISTINCT c_custkey) FILTER (matched) AS y
           FROM m GROUP BY nation)
SELECT nation, nullif(f, 0) AS "matched_FALSE", nullif(y, 0) AS "matched_TRUE",
       round_even(nullif(y, 0) * 100e0 / (nullif(y, 0) + nullif(f, 0)), 1) AS pct_matched FROM w""")
def pivot_flag(t):
    rows = t.customer.select(
        F.col("c_nationkey").alias("nation"), "c_custkey",
        ((F.col("c_custkey") % 5 == 0) & (F.col("c_nationkey") != 3)).alias("matched"),
    )
    return reshape.pivot_flag(rows, ["nation"], "matched", F.count_distinct("c_custkey"), "matched_")


def shareholder_cells(t):
    """Whole document texts as lists of holders, with parallel lists of types and shares."""
    lines = F.split("text", "\n")
    kind = F.transform(lines, lambda x, i: F.when((F.col("doc_id") + i) % 3 == 0, "Public").otherwise("Bank"))
    pct = F.transform(
        lines,
        lambda x, i: F.when((F.col("doc_id") + i) % 5 == 0, "n.a.")
        .when((F.col("doc_id") + i) % 7 == 0, "WO")
        .otherwise(((F.col("doc_id") * 13 + i * 29) % 101).cast("string")),
    )
    hidden = F.col("doc_id") % 10 == 0
    return t.documents.select(
        F.concat(F.lit("B"), F.col("doc_id").cast("string")).alias("BvD ID number"),
        F.concat(F.lit("Company "), F.col("doc_id").cast("string")).alias("Company name Latin alphabet"),
        F.upper("lang").alias("Country ISO code"),
        F.when(~hidden, F.col("text")).alias("CSH - Name"),
        F.when(~hidden, F.array_join(kind, "\n")).alias("CSH - Type"),
        F.when(~hidden, F.array_join(pct, "\n")).alias("CSH - Direct %"),
        F.when(~hidden, F.array_join(pct, "\n")).alias("CSH - Total %"),
    )


SHAREHOLDERS_SQL = """
parts AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS holder, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
          FROM documents WHERE doc_id % 10 <> 0),
holders AS (
  SELECT doc_id, lang, i, holder, CASE WHEN (doc_id + i) % 3 = 0 THEN 'Public' ELSE 'Bank' END AS kind,
         CASE WHEN (doc_id + i) % 5 = 0 THEN 'n.a.' WHEN (doc_id + i) % 7 = 0 THEN 'WO'
              ELSE CAST((doc_id * 13 + i * 29) % 101 AS VARCHAR) END AS pct
  FROM parts
  UNION ALL SELECT doc_id, lang, 0, NULL, NULL, NULL FROM documents WHERE doc_id % 10 = 0)"""


@query("split_rows", f"""
WITH {SHAREHOLDERS_SQL.strip()}
SELECT 'B' || doc_id AS firm, holder, kind, pct FROM holders""")
def split_rows(t):
    columns = ["CSH - Name", "CSH - Type", "CSH - Direct %", "CSH - Total %"]
    rows = reshape.split_rows(shareholder_cells(t), columns)
    return rows.select(
        F.col("BvD ID number").alias("firm"), F.col("CSH - Name").alias("holder"),
        F.col("CSH - Type").alias("kind"), F.col("CSH - Direct %").alias("pct"),
    )


@query("build_financials", with_panel("""
SELECT u.unit, CAST(s.yr AS INTEGER) AS year, verified AS operating_revenue, CAST(n_orders AS DOUBLE) AS n_employees
FROM (SELECT DISTINCT unit FROM panel) u, generate_series(1996, 2000) s(yr)
LEFT JOIN panel p ON p.unit = u.unit AND p.yr = s.yr"""))
def build_financials(t):
    return reshape.build_financials(
        wide_revenue(t), "unit",
        {"operating_revenue": "Operating revenue", "n_employees": "Number of employees"}, 1996, 2000,
    )
