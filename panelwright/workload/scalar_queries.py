"""Scalar functions over whole tables, and user functions in a pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions import geo, numeric, recode, text
from ..operators.projection import across_apply
from .registry import query
from .tables import r, rounded, with_panel


def period_label() -> Column:
    return recode.first_match([
        (F.col("yr") == 1995, "2005-2007"), (F.col("yr").between(1996, 1997), "2008-2012"),
        (F.col("yr").between(1998, 1999), "2013-2020"), (F.col("yr") == 2000, "2021-2030"),
    ], "before")


@query("case_phase", with_panel("""
SELECT unit, yr, CASE WHEN yr = 1995 THEN 1 WHEN yr BETWEEN 1996 AND 1997 THEN 2
                      WHEN yr BETWEEN 1998 AND 1999 THEN 3 WHEN yr = 2000 THEN 4 END AS phase FROM panel"""))
def case_phase(t):
    return t.panel.select("unit", "yr", recode.phase_of_period(period_label()).alias("phase"))


@query("case_sector", """
SELECT p_partkey, p_size, CASE WHEN p_size IN (1, 20) THEN 'Power' WHEN p_size IN (6, 29) THEN 'Cement'
  WHEN p_size IN (5, 24, 25) THEN 'Steel/Metal' WHEN p_size IN (2, 21) THEN 'Refining'
  WHEN p_size IN (9, 35, 36) THEN 'Pulp/Paper' ELSE 'Other' END AS sector FROM part""")
def case_sector(t):
    return t.part.select("p_partkey", "p_size", recode.sector_of(F.col("p_size")).alias("sector"))


_FULL_BANDS = """CASE WHEN own = 0 THEN 'Private (0%)' WHEN own > 0 AND own < 50 THEN 'Minority state (<50%)'
  WHEN own >= 50 AND own < 100 THEN 'Majority state (50-99%)' WHEN own = 100 THEN 'Fully state (100%)' END"""
_BANDS = """CASE WHEN own = 0 THEN 'Private (0%)' WHEN own >= 50 AND own < 100 THEN 'Majority state'
  WHEN own = 100 THEN 'Fully state (100%)' END"""


@query("case_ownership_group", with_panel(f"""
SELECT unit, yr, own, {_BANDS} AS band, {_FULL_BANDS} AS band_4,
       CASE {_BANDS} WHEN 'Private (0%)' THEN 1 WHEN 'Majority state' THEN 2 WHEN 'Fully state (100%)' THEN 3 END AS band_rank
FROM panel"""))
def case_ownership_group(t):
    band = recode.ownership_band(F.col("own"))
    return t.panel.select(
        "unit", "yr", "own", band.alias("band"), recode.ownership_band(F.col("own"), minority=True).alias("band_4"),
        recode.level_rank(band, fv.OWNERSHIP_BANDS_3).alias("band_rank"),
    )


@query("case_ownership_type", with_panel("""
SELECT unit, yr,
  CASE WHEN abroad = 1 THEN 'Foreign owned' WHEN state = 1 THEN 'Domestic state' ELSE 'Domestic private' END AS type_3,
  CASE WHEN abroad = 1 AND state = 1 THEN 'Foreign state' WHEN abroad = 1 THEN 'Foreign private'
       WHEN state = 1 THEN 'Domestic state' ELSE 'Domestic private' END AS type_4,
  CASE WHEN own = 0 THEN 'Private' WHEN own >= 50 THEN 'State-owned' END AS type_2
FROM panel"""))
def case_ownership_type(t):
    abroad, state = F.col("abroad"), F.col("state")
    return t.panel.select(
        "unit", "yr", recode.ownership_type(abroad, state).alias("type_3"),
        recode.ownership_type(abroad, state, four_way=True).alias("type_4"),
        recode.ownership_two_way(F.col("own")).alias("type_2"),
    )


@query("case_country_group", """
SELECT doc_id, CASE WHEN upper(lang) IN ('AT', 'DE', 'DK', 'FI', 'FR', 'NL', 'NO', 'SE') THEN 'Green government'
                    WHEN upper(lang) IN ('BG', 'CZ', 'HU', 'PL', 'RO', 'SK') THEN 'Laggard government' END AS policy_group
FROM documents""")
def case_country_group(t):
    return t.documents.select("doc_id", recode.policy_group(F.upper("lang")).alias("policy_group"))


FUEL_TEXTS_SQL = """CASE p_size % 8 WHEN 0 THEN 'Fossil Hard Coal' WHEN 1 THEN 'Fossil Gas' WHEN 2 THEN 'Fossil Oil'
  WHEN 3 THEN 'Biomass' WHEN 4 THEN 'Fossil Peat' WHEN 5 THEN 'Waste' WHEN 6 THEN 'Fossil Coal-derived GAS'
  ELSE 'Hydro ' || p_name END"""


def fuel_text() -> Column:
    size = F.col("p_size") % 8
    texts = ["Fossil Hard Coal", "Fossil Gas", "Fossil Oil", "Biomass", "Fossil Peat", "Waste", "Fossil Coal-derived GAS"]
    named = recode.first_match([(size == i, label) for i, label in enumerate(texts)])
    return F.coalesce(named, F.concat(F.lit("Hydro "), F.col("p_name")))


@query("case_fuel", f"""
WITH f AS (SELECT p_partkey, {FUEL_TEXTS_SQL} AS type_g FROM part)
SELECT p_partkey, type_g, CASE WHEN regexp_matches(type_g, '(?i)coal|lignite') THEN 'coal'
  WHEN regexp_matches(type_g, '(?i)gas') THEN 'gas' WHEN regexp_matches(type_g, '(?i)oil') THEN 'oil'
  WHEN regexp_matches(type_g, '(?i)biomass') THEN 'biomass' WHEN regexp_matches(type_g, '(?i)peat') THEN 'peat'
  WHEN regexp_matches(type_g, '(?i)waste') THEN 'waste' ELSE 'other' END AS fuel FROM f""")
def case_fuel(t):
    rows = t.part.select("p_partkey", fuel_text().alias("type_g"))
    return rows.withColumn("fuel", recode.fuel_of(F.col("type_g")))


@query("flag_int", """
WITH k AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS kind FROM events)
SELECT event_id, CAST(kind = 'click' AS INTEGER) AS is_click, CAST(coalesce(kind IN ('click', 'view'), false) AS INTEGER) AS is_visit
FROM k""")
def flag_int(t):
    kind = F.when(F.col("event_id") % 4 != 0, F.col("event_type"))
    return t.events.select(
        "event_id", recode.flag(kind == "click").alias("is_click"),
        recode.flag(recode.is_member(kind, ["click", "view"])).alias("is_visit"),
    )


@query("ratio_vars", with_panel("""
SELECT unit, yr, allocated - verified AS surplus_raw, (allocated - verified) / nullif(verified, 0) AS surplus_norm,
       allocated / nullif(verified, 0) AS coverage_ratio FROM panel"""))
def ratio_vars(t):
    a, v = F.col("allocated"), F.col("verified")
    return t.panel.select(
        "unit", "yr", numeric.surplus(a, v).alias("surplus_raw"), numeric.surplus_ratio(a, v).alias("surplus_norm"),
        numeric.coverage_ratio(a, v).alias("coverage_ratio"),
    )


@query("guarded_ratio_log", f"""
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_nationkey / c_acctbal END AS ratio,
       CASE WHEN c_acctbal > 0 AND c_nationkey > 0 THEN {r('ln(c_nationkey / c_acctbal)')} END AS log_ratio FROM customer""")
def guarded_ratio_log(t):
    ratio = numeric.positive_ratio(F.col("c_nationkey").cast("double"), F.col("c_acctbal"))
    return t.customer.select(
        "c_custkey", ratio.alias("ratio"), rounded(numeric.positive_log(ratio)).alias("log_ratio")
    )


@query("log_transform", f"""
SELECT l_orderkey, l_partkey, {r('ln(l_quantity)')} AS log_quantity, {r('ln(l_discount + 1)')} AS log_discount FROM lineitem""")
def log_transform(t):
    return t.lineitem.select(
        "l_orderkey", "l_partkey", rounded(numeric.positive_log(F.col("l_quantity"))).alias("log_quantity"),
        rounded(numeric.log_plus_one(F.col("l_discount"))).alias("log_discount"),
    )


@query("share_of_cumulative", with_panel("""
, c AS (SELECT unit, yr, verified, max(verified) OVER (PARTITION BY unit) - yr + 1996 AS cum FROM panel)
SELECT unit, yr, CASE WHEN cum > 0 AND verified / cum BETWEEN 0 AND 1 THEN verified / cum END AS share FROM c"""))
def share_of_cumulative(t):
    top = t.panel.groupBy("unit").agg(F.max("verified").alias("top"))
    rows = t.panel.select("unit", "yr", "verified").join(top, "unit")
    cumulative = F.col("top") - F.col("yr") + 1996
    return rows.select("unit", "yr", numeric.share_of_total(F.col("verified"), cumulative).alias("share"))


_SENTINEL = """CASE WHEN event_id % 7 = 0 THEN 'n.a.' WHEN event_id % 7 = 1 THEN 'WO' WHEN event_id % 7 = 2 THEN '-'
  WHEN event_id % 7 = 3 THEN '' WHEN event_id % 7 = 4 THEN 'x' || event_id ELSE CAST(event_id AS VARCHAR) END"""


def sentinel_text() -> Column:
    k = F.col("event_id") % 7
    number = F.col("event_id").cast("string")
    return (
        F.when(k == 0, "n.a.").when(k == 1, "WO").when(k == 2, "-").when(k == 3, "")
        .when(k == 4, F.concat(F.lit("x"), number)).otherwise(number)
    )


@query("null_if_sentinels", f"""
WITH s AS (SELECT event_id, {_SENTINEL} AS raw FROM events)
SELECT event_id, CASE WHEN raw NOT IN ('n.a.', 'WO', '-', '') THEN raw END AS cleaned FROM s""")
def null_if_sentinels(t):
    return t.events.select("event_id", recode.null_if(sentinel_text(), *fv.MISSING_TEXTS).alias("cleaned"))


@query("safe_cast", f"""
WITH s AS (SELECT event_id, {_SENTINEL} AS raw FROM events) SELECT event_id, try_cast(raw AS DOUBLE) AS number FROM s""")
def safe_cast(t):
    return t.events.select("event_id", numeric.to_number(sentinel_text(), *fv.MISSING_TEXTS).alias("number"))


def quote_of(kind: str) -> Column:
    return F.when(F.col("event_type") == kind, F.col("value"))


@query("coalesce_sources", """
SELECT event_id, coalesce(CASE WHEN event_type = 'purchase' THEN value END, CASE WHEN event_type = 'view' THEN value END,
                          CASE WHEN event_type = 'click' THEN value END) AS price FROM events""")
def coalesce_sources(t):
    price = numeric.first_present(*map(quote_of, ("purchase", "view", "click")))
    return t.events.select("event_id", price.alias("price"))


@query("replace_null", "SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN value END, 0) AS tax FROM events")
def replace_null(t):
    return t.events.select("event_id", numeric.or_zero(quote_of("view")).alias("tax"))


@query("extract_year_text", """
SELECT page_id, try_cast(nullif(regexp_extract(url, '\\d{4}'), '') AS INTEGER) AS year_in_url FROM pages""")
def extract_year_text(t):
    return t.pages.select("page_id", text.year_in_text(F.col("url")).alias("year_in_url"))


@query("date_parse_year", """
SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(year(ts) AS INTEGER) END AS year FROM events""")
def date_parse_year(t):
    raw = F.when(F.col("event_id") % 6 == 0, "no date").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    rows = t.events.select("event_id", text.to_date(raw).alias("day"))
    return rows.withColumn("year", F.year("day"))


@query("normalize_name", """
SELECT p_partkey, regexp_replace(upper(trim('  ' || p_name || ' / ' || p_brand || ' ')), '[^A-Z0-9]', '', 'g') AS name_clean FROM part""")
def normalize_name(t):
    raw = F.concat(F.lit("  "), "p_name", F.lit(" / "), "p_brand", F.lit(" "))
    return t.part.select("p_partkey", text.normalized_name(raw).alias("name_clean"))


@query("concat_label", with_panel("SELECT unit, yr, 'Phase ' || phase AS phase_label FROM panel"))
def concat_label(t):
    return t.panel.select("unit", "yr", text.labelled("Phase", F.col("phase")).alias("phase_label"))


@query("round_pct", """
SELECT l_shipmonth AS month, round_even(avg(CAST(l_quantity > 25 AS INTEGER)) * 100, 1) AS pct
FROM (SELECT CAST(month(l_shipdate) AS INTEGER) AS l_shipmonth, l_quantity FROM lineitem) GROUP BY l_shipmonth""")
def round_pct(t):
    rows = t.lineitem.withColumn("month", F.month("l_shipdate"))
    return rows.groupBy("month").agg(numeric.percent_true(F.col("l_quantity") > 25).alias("pct"))


_HAVERSINE = (
    "2 * 6378.137 * asin(least(1.0, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2)"
    " + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"
)
_POINTS = """(SELECT c_custkey, CAST(c_custkey * 37 % 60 AS DOUBLE) AS lat1, CAST(c_custkey * 53 % 90 AS DOUBLE) AS lon1,
                     CAST(c_custkey * 11 % 60 AS DOUBLE) AS lat2, CAST(c_custkey * 29 % 90 AS DOUBLE) AS lon2 FROM customer)"""


def _points(t) -> DataFrame:
    key = F.col("c_custkey")
    return t.customer.select(
        "c_custkey", (key * 37 % 60).cast("double").alias("lat1"), (key * 53 % 90).cast("double").alias("lon1"),
        (key * 11 % 60).cast("double").alias("lat2"), (key * 29 % 90).cast("double").alias("lon2"),
    )


def distance_km() -> Column:
    return geo.haversine_km(*map(F.col, ("lat1", "lon1", "lat2", "lon2")))


@query("haversine_km", f"SELECT c_custkey, {r(_HAVERSINE)} AS dist_km FROM {_POINTS}")
def haversine_km(t):
    return _points(t).select("c_custkey", rounded(distance_km()).alias("dist_km"))


@query("sum_prices", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN value END + coalesce(CASE WHEN event_type = 'view' THEN value END, 0)
  AS combined FROM events""")
def sum_prices(t):
    market = F.when(F.col("event_type") != "error", F.col("value"))
    return t.events.select("event_id", (market + numeric.or_zero(quote_of("view"))).alias("combined"))


def with_ownership_group(df: DataFrame) -> DataFrame:
    """A user's own frame-to-frame step."""
    return df.withColumn("band", recode.ownership_band(F.col("own"))).where(F.col("band").isNotNull())


@query("frame_function", with_panel(f"SELECT band, count(*) AS n FROM (SELECT {_BANDS} AS band FROM panel) WHERE band IS NOT NULL GROUP BY band"))
def frame_function(t):
    return t.panel.transform(with_ownership_group).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query("column_lambda", f"""
SELECT l_orderkey, l_partkey, {r('ln(l_quantity + 1)')} AS l_quantity, {r('ln(l_extendedprice + 1)')} AS l_extendedprice FROM lineitem""")
def column_lambda(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    return across_apply(rows, ["l_quantity", "l_extendedprice"], lambda c: rounded(numeric.log_plus_one(c)))


@query("row_function", f"SELECT c_custkey, {_HAVERSINE} < 3000 AS near FROM {_POINTS}")
def row_function(t):
    # A row-wise function is just a column expression here.
    return _points(t).select("c_custkey", (distance_km() < 3000).alias("near"))
