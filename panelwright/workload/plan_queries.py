"""The study's stages end to end, on test tables dressed in the raw schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.recode import first_match
from ..plans import firms, fuel, policy, register, study_models
from ..session import scratch_path
from ..sources import files
from .ordered_queries import SHAREHOLDERS_SQL, shareholder_cells
from .registry import query
from .scalar_queries import FUEL_TEXTS_SQL, fuel_text
from .tables import PANEL_SQL, r, round_all, with_panel

#: Country codes the 25 test nations stand for (the first 25 of the study's list).
CODES = list(fv.ISO2_TO_ISO3)[:25]
NAMES = {code: name for name, code in fv.COUNTRY_TO_ISO2.items()}


def _nation_sql(column: str, values) -> str:
    return "(['" + "', '".join(values) + f"'])[{column} + 1]"


ISO2_SQL = _nation_sql("c_nationkey", CODES)


def iso2(column: str):
    return F.element_at(F.array(*map(F.lit, CODES)), F.col(column).cast("int") + 1)


def installations(t):
    key = F.col("c_custkey")
    return t.customer.select(
        key.cast("string").alias("id"), F.col("c_name").alias("name"), iso2("c_nationkey").alias("registry_id"),
        (key % 30).cast("int").alias("activity_id"), (key % 50 == 7).alias("isAircraftOperator"),
        (key % 60 == 9).alias("isMaritimeOperator"), F.col("c_mktsegment").alias("parentCompany"),
        (key % 100).cast("string").alias("nace_id"), (key * 37 % 60).cast("double").alias("latitudeGoogle"),
        (key * 53 % 90).cast("double").alias("longitudeGoogle"),
    )


def compliance(t):
    unit, yr = F.col("unit"), F.col("yr")
    period = first_match([(yr <= 1996, "2005-2007"), (yr <= 1998, "2008-2012"), (yr <= 2000, "2013-2020")], "2021-2030")
    code = first_match(
        [((unit + yr) % 11 == 0, "C"), (F.col("code") == "F", "A"), (F.col("code") == "O", "B")], "E"
    )
    return t.unit_years.select(
        unit.cast("string").alias("installation_id"), (yr + 13).alias("year"), period.alias("euetsPhase"),
        code.alias("compliance_id"), "verified", F.col("allocated").alias("allocatedTotal"),
    )


def accounts(t):
    status = F.col("o_orderstatus")
    return t.orders.select(
        first_match([(status == "F", "100-7"), (status == "O", "120-0")], "111-1").alias("accountType_id"),
        F.when(F.col("o_orderkey") % 13 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("installation_id"),
        F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(
            F.concat(F.lit("B"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 300).cast("string"))
        ).alias("bvdId"),
    )


REGISTER_SQL = f"""
installation AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, {ISO2_SQL} AS registry_id, CAST(c_custkey % 30 AS INTEGER) AS activity_id,
         c_custkey % 50 = 7 AS air, c_custkey % 60 = 9 AS sea, CAST(c_custkey * 37 % 60 AS DOUBLE) AS lat,
         CAST(c_custkey * 53 % 90 AS DOUBLE) AS lon FROM customer),
compliance AS (
  SELECT CAST(unit AS VARCHAR) AS installation_id, CAST(yr + 13 AS INTEGER) AS year,
         CASE WHEN yr <= 1996 THEN 1 WHEN yr <= 1998 THEN 2 WHEN yr <= 2000 THEN 3 ELSE 4 END AS phase,
         CASE WHEN (unit + yr) % 11 = 0 THEN 'C' WHEN code = 'F' THEN 'A' WHEN code = 'O' THEN 'B' ELSE 'E' END AS compliance_id,
         verified, allocated AS allocated_total FROM unit_years),
account AS (
  SELECT CASE o_orderstatus WHEN 'F' THEN '100-7' WHEN 'O' THEN '120-0' ELSE '111-1' END AS kind,
         CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS installation_id,
         CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'B' || ((o_custkey * 7 + o_orderkey) % 300) END AS bvd FROM orders),
holder AS (
  SELECT installation_id, bvd AS "bvdId" FROM account WHERE kind IN ('100-7', '120-0') AND installation_id <> '' AND bvd <> ''
  QUALIFY row_number() OVER (PARTITION BY installation_id ORDER BY CASE WHEN kind = '100-7' THEN 0 ELSE 1 END, kind, bvd) = 1),
observed AS (
  SELECT c.*, i.registry_id, i.activity_id, (allocated_total - verified) / verified AS surplus_norm
  FROM compliance c JOIN installation i ON c.installation_id = i.id
  WHERE NOT air AND NOT sea AND compliance_id IN ('A', 'B', 'E') AND verified > 0 AND allocated_total IS NOT NULL)"""


@query("pipe_clean_register", with_panel(f""", {REGISTER_SQL},
lagged AS (SELECT *, lag(verified) OVER (PARTITION BY installation_id ORDER BY year) AS before FROM observed WHERE activity_id IN (1, 20)),
clean AS (SELECT l.*, (verified - before) / before AS growth, "bvdId" FROM lagged l LEFT JOIN holder USING (installation_id)
          WHERE surplus_norm BETWEEN -1 AND 10)
SELECT year, phase, count(*) AS n, count("bvdId") AS n_with_firm, {r('sum(verified) / 1e6')} AS total_verified,
       {r('avg(surplus_norm)')} AS mean_surplus, {r('avg(growth)')} AS mean_growth, {r("avg(CAST(compliance_id IN ('A', 'E') AS INTEGER))")} AS share_compliant
FROM clean GROUP BY year, phase"""))
def pipe_clean_register(t):
    panel = register.with_firm(register.clean_register(installations(t), compliance(t)), accounts(t))
    out = panel.groupBy("year", "phase").agg(
        F.count(F.lit(1)).alias("n"), F.count("bvdId").alias("n_with_firm"),
        (F.sum("verified") / 1e6).alias("total_verified"), F.avg("surplus_norm").alias("mean_surplus"),
        F.avg("emissions_growth").alias("mean_growth"), F.avg("compliant").alias("share_compliant"),
    )
    return round_all(out, "total_verified", "mean_surplus", "mean_growth", "share_compliant")


_STATE_SQL = """
state AS (
  SELECT 'B' || doc_id AS firm, upper(any_value(lang)) AS country,
         coalesce(max(try_cast(CASE WHEN pct NOT IN ('n.a.', 'WO', '') THEN pct END AS DOUBLE)) FILTER (kind = 'Public'), 0) AS state_ownership_pct,
         CAST(coalesce(bool_or(kind = 'Public'), false) AS INTEGER) AS state_owned_binary, count(*) AS n_shareholders
  FROM holders GROUP BY doc_id)"""


@query("pipe_state_ownership", f"WITH {SHAREHOLDERS_SQL.strip()}, {_STATE_SQL} SELECT * FROM state")
def pipe_state_ownership(t):
    return firms.state_ownership(shareholder_cells(t)).select(
        F.col("BvD ID number").alias("firm"), F.col("Country ISO code").alias("country"),
        "state_ownership_pct", "state_owned_binary", "n_shareholders",
    )


def shareholder_sheet(t):
    """A hierarchical sheet: the company on the first row of its block only."""
    conv, turn = F.col("conv_id"), F.col("turn")
    first = turn == 0
    def pct(step):
        k = (conv * 3 + turn * step) % 10
        return F.when(k == 0, "n.a.").when(k == 1, "-").when(k != 2, ((conv * 7 + turn * step * 11) % 101).cast("string"))

    return t.conversations.select(
        (conv * 1000 + turn).alias("row_no"),
        F.when(first, conv.cast("string")).alias("bvdId"),
        F.when(first, F.concat(F.lit("Company "), conv.cast("string"))).alias("Company name Latin alphabet"),
        F.when(~first, F.concat("role", turn.cast("string"))).alias("SH - Name"),
        F.when((conv + turn) % 3 == 0, fv.STATE_TYPES[0]).otherwise("Bank").alias("SH - Type"),
        F.when(~first, pct(1)).alias("SH - Direct % 2010"), F.when(~first, pct(2)).alias("SH - Direct % 2012"),
    )


def firm_names(t):
    """Firm list; every tenth name is listed under a second id."""
    key = F.col("c_custkey")
    name = F.concat(F.lit("Company "), key.cast("string")).alias("Company name Latin alphabet")
    base = t.customer.select(F.concat(F.lit("B"), key.cast("string")).alias("BvD ID number"), name)
    twice = t.customer.where(key % 10 == 0).select(F.concat(F.lit("X"), key.cast("string")).alias("BvD ID number"), name)
    return base.unionByName(twice)


def _pct_sql(step: int) -> str:
    k = f"(conv_id * 3 + turn * {step}) % 10"
    return f"CASE WHEN {k} > 2 THEN CAST((conv_id * 7 + turn * {step} * 11) % 101 AS DOUBLE) END"


_OWNERSHIP_SQL = f"""
ids AS (SELECT 'B' || c_custkey AS bvd, c_custkey AS k FROM customer UNION ALL SELECT 'X' || c_custkey, c_custkey FROM customer WHERE c_custkey % 10 = 0),
held AS (SELECT bvd, conv_id, turn, (conv_id + turn) % 3 = 0 AS gov FROM conversations JOIN ids ON k = conv_id WHERE turn > 0),
long AS (SELECT bvd, conv_id, 2010 AS year, gov, {_pct_sql(1)} AS pct FROM held
         UNION ALL SELECT bvd, conv_id, 2012, gov, {_pct_sql(2)} FROM held),
yearly AS (SELECT bvd, conv_id, year, least(coalesce(sum(pct) FILTER (gov), 0), 100) AS pct, CAST(coalesce(bool_or(gov AND pct IS NOT NULL), false) AS INTEGER) AS state,
                  count(*) FILTER (gov AND pct IS NOT NULL) AS n_gov FROM long GROUP BY ALL),
spine AS (SELECT DISTINCT bvd, CAST(s.y AS INTEGER) AS year FROM yearly, generate_series(2008, 2015) s(y)),
whole AS (SELECT coalesce(s.bvd, y.bvd) AS bvd, coalesce(s.year, y.year) AS year, conv_id, pct, state, n_gov
          FROM spine s FULL JOIN yearly y ON s.bvd = y.bvd AND s.year = y.year)"""


@query("pipe_ownership_panel", f"""WITH {_OWNERSHIP_SQL.strip()}
SELECT bvd AS "bvdId", 'Company ' || conv_id AS company, CAST(year AS INTEGER) AS year,
       last_value(pct IGNORE NULLS) OVER w AS state_ownership_pct_tv, last_value(state IGNORE NULLS) OVER w AS state_owned_binary_tv,
       n_gov AS n_gov_shareholders
FROM whole WINDOW w AS (PARTITION BY bvd ORDER BY year, 'Company ' || conv_id NULLS LAST)""")
def pipe_ownership_panel(t):
    # Two exported sheets; their row numbers are those of the files, which start with a row of units.
    sheet = shareholder_sheet(t)
    halves = []
    for name, rows in (("a", F.col("row_no") < 50_000), ("b", F.col("row_no") >= 50_000)):
        path = scratch_path(t.spark, f"holders-{name}")
        sheet.where(rows).orderBy("row_no").drop("row_no").write.parquet(path)
        halves.append(files.read_sheet_export(t.spark, path, kind="parquet", position="row_no"))
    out = firms.ownership_panel(halves, firm_names(t), first=2008, last=2015)
    return out.withColumnRenamed("Company name Latin alphabet", "company")


def firm_export(t):
    """Firm rows with owner columns and wide yearly families as text."""
    key = F.col("c_custkey")
    base = t.customer.select(
        "c_custkey",
        F.concat(F.lit("B"), key.cast("string")).alias("BvD ID number"),
        F.concat(F.lit("Company "), key.cast("string")).alias("Company name Latin alphabet"),
        iso2("c_nationkey").alias("Country ISO code"),
        *[F.lit("x").alias(fv_name) for fv_name in (
            "NACE Rev. 2, core code (4 digits)", "Standardized legal form", "OUB - Independence indicator",
            "Date of incorporation", "GUO - Name", "GUO - Direct %", "Quoted")],
        F.when(key % 4 == 0, "Public").when(key % 4 == 1, None).otherwise("Bank").alias("GUO - Type"),
        F.when(key % 3 == 0, "US").when(key % 3 == 1, iso2("c_nationkey")).alias("GUO - Country ISO code"),
        F.when(key % 7 == 0, "n.a.").otherwise((key % 101).cast("string")).alias("GUO - Total %"),
    )
    money = t.unit_years.groupBy("unit").agg(*[
        F.max(F.when(F.col("yr") == y, column)).alias(name)
        for y in range(1995, 2002)
        for name, column in (
            (f"Total assets th EUR {y + 13}", F.col("allocated").cast("string")),
            (f"Operating revenue th EUR {y + 13}", F.when(F.col("unit") % 9 == 0, "n.a.").otherwise(F.col("verified").cast("string"))),
            (f"Number of employees {y + 13}", F.col("n_orders").cast("string")),
        )
    ])
    return base.join(money, F.col("c_custkey") == F.col("unit"), "left").drop("unit", "c_custkey")


_FIRM_SQL = f"""
firm AS (
  SELECT 'B' || c_custkey AS "bvdId", c_custkey, try_cast(CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 101 END AS DOUBLE) AS guo_total_pct,
         CAST(c_custkey % 4 = 0 AS INTEGER) AS guo_state, CAST(c_custkey % 3 = 0 AS INTEGER) AS foreign_owned FROM customer)"""


@query("pipe_firm_panel", f"""WITH {PANEL_SQL.strip()}, {SHAREHOLDERS_SQL.strip()}, {_STATE_SQL}, {_FIRM_SQL}
SELECT u.unit, CAST(u.yr + 13 AS INTEGER) AS year, f."bvdId", guo_total_pct, guo_state, foreign_owned, state_ownership_pct, state_owned_binary,
       m.allocated AS total_assets, CASE WHEN f.c_custkey % 9 <> 0 THEN m.verified END AS operating_revenue, CAST(m.n_orders AS DOUBLE) AS n_employees
FROM unit_years u LEFT JOIN firm f ON f.c_custkey = (u.unit * 3) % 2000
LEFT JOIN state s ON s.firm = f."bvdId"
LEFT JOIN unit_years m ON m.unit = f.c_custkey AND m.yr = u.yr""")
def pipe_firm_panel(t):
    known = t.customer.select(F.concat(F.lit("B"), F.col("c_custkey").cast("string")).alias("bvdId"))
    panel = t.unit_years.select(
        "unit", (F.col("yr") + 13).alias("year"),
        F.concat(F.lit("B"), (F.col("unit") * 3 % 2000).cast("string")).alias("bvdId"),
    )
    out = firms.firm_panel(panel, firm_export(t), shareholder_cells(t))
    return out.join(known.withColumnRenamed("bvdId", "known"), F.col("bvdId") == F.col("known"), "left").select(
        "unit", "year", F.col("known").alias("bvdId"), "guo_total_pct", "guo_state", "foreign_owned",
        "state_ownership_pct", "state_owned_binary", "total_assets", "operating_revenue", "n_employees",
    )


@query("pipe_all_sectors", with_panel(f""", {REGISTER_SQL}, {SHAREHOLDERS_SQL.strip()}, {_STATE_SQL}, {_FIRM_SQL},
attributes AS (SELECT f."bvdId", state_ownership_pct, guo_state, foreign_owned FROM firm f LEFT JOIN state s ON s.firm = f."bvdId"),
money AS (SELECT 'B' || unit AS "bvdId", CAST(yr + 13 AS INTEGER) AS year, CASE WHEN unit % 9 <> 0 THEN verified END AS operating_revenue FROM unit_years),
joined AS (
  SELECT o.*, CASE WHEN activity_id IN (1, 20) THEN 'Power' WHEN activity_id IN (6, 29) THEN 'Cement' WHEN activity_id IN (5, 24, 25) THEN 'Steel/Metal'
                WHEN activity_id IN (2, 21) THEN 'Refining' WHEN activity_id IN (9, 35, 36) THEN 'Pulp/Paper' ELSE 'Other' END AS sector,
         state_ownership_pct, foreign_owned, operating_revenue
  FROM observed o LEFT JOIN holder h USING (installation_id) LEFT JOIN attributes a ON h."bvdId" = a."bvdId"
  LEFT JOIN money m ON h."bvdId" = m."bvdId" AND o.year = m.year
  WHERE phase > 1 AND surplus_norm BETWEEN -1 AND 10)
SELECT sector, phase, count(*) AS n, count(state_ownership_pct) AS n_owned, count(operating_revenue) AS n_revenue,
       {r('avg(state_ownership_pct)')} AS mean_own, {r('avg(foreign_owned)')} AS share_foreign,
       {r('avg(CASE WHEN operating_revenue > 0 THEN ln(verified / operating_revenue) END)')} AS mean_log_intensity
FROM joined GROUP BY sector, phase"""))
def pipe_all_sectors(t):
    attributes = firms.firm_attributes(firm_export(t))
    owned = firms.state_ownership(shareholder_cells(t)).select(
        F.col("BvD ID number").alias("bvdId"), "state_ownership_pct", "state_owned_binary"
    )
    ownership = attributes.join(owned, "bvdId", "left")
    money = t.unit_years.select(
        F.concat(F.lit("B"), F.col("unit").cast("string")).alias("bvdId"), (F.col("yr") + 13).alias("year"),
        F.col("allocated").alias("total_assets"),
        F.when(F.col("unit") % 9 != 0, F.col("verified")).alias("operating_revenue"),
        F.col("n_orders").alias("n_employees"),
    )
    panel = register.all_sectors(installations(t), compliance(t), accounts(t), ownership, money)
    out = panel.groupBy("sector", "phase").agg(
        F.count(F.lit(1)).alias("n"), F.count("state_ownership_pct").alias("n_owned"),
        F.count("operating_revenue").alias("n_revenue"), F.avg("state_ownership_pct").alias("mean_own"),
        F.avg("foreign_owned").alias("share_foreign"), F.avg("log_emissions_intensity").alias("mean_log_intensity"),
    )
    return round_all(out, "mean_own", "share_foreign", "mean_log_intensity")


ISO3 = [fv.ISO2_TO_ISO3[c] for c in CODES]
_INDEX_SQL = f"""
idx AS (
  SELECT {_nation_sql('nation', ISO3)} AS iso3, CAST(yr + 13 AS INTEGER) AS year,
         CASE WHEN (nation + yr) % 4 <> 0 THEN CAST(sum(CAST(round(allocated * 100) AS BIGINT)) AS DOUBLE) / 1e8 END AS eps,
         CAST(count(*) AS DOUBLE) / 100 AS dem
  FROM panel GROUP BY nation, yr)"""


def index_tables(t):
    """Policy tables in their raw shape: one indicator row per country and year."""
    cells = t.panel.groupBy("nation", "yr").agg(
        (F.sum(F.round(F.col("allocated") * 100).cast("bigint")).cast("double") / 1e8).alias("eps"),
        (F.count(F.lit(1)).cast("double") / 100).alias("dem"),
    )
    iso3 = F.element_at(F.array(*map(F.lit, ISO3)), F.col("nation").cast("int") + 1)
    stringency = cells.where((F.col("nation") + F.col("yr")) % 4 != 0).select(
        F.explode(F.array(F.lit("EPS"), F.lit("OTHER"))).alias("CLIM_POL"), iso3.alias("REF_AREA"),
        (F.col("yr") + 13).alias("TIME_PERIOD"), F.col("eps").alias("OBS_VALUE"),
    )
    democracy = cells.select(
        iso3.alias("country_text_id"), (F.col("yr") + 13).alias("year"), F.col("dem").alias("v2x_polyarchy"),
        (F.col("dem") / 2).alias("v2x_libdem"), (1 - F.col("dem")).alias("v2x_corr"),
    )
    return stringency, democracy


def coded_panel(t):
    return t.panel.select("unit", (F.col("yr") + 13).alias("year"), iso2("nation").alias("registry_id"))


@query("pipe_policy_indices", with_panel(f""", {_INDEX_SQL},
filled AS (SELECT iso3, year, last_value(eps IGNORE NULLS) OVER (PARTITION BY iso3 ORDER BY year) AS eps, dem FROM idx)
SELECT unit, CAST(yr + 13 AS INTEGER) AS year, iso3 AS country_iso3, {r('eps')} AS eps, {r('dem')} AS v2x_polyarchy
FROM panel JOIN filled ON iso3 = {_nation_sql('nation', ISO3)} AND year = yr + 13"""))
def pipe_policy_indices(t):
    out = policy.policy_indices(coded_panel(t), *index_tables(t), fill=True)
    return round_all(out.select("unit", "year", "country_iso3", "eps", "v2x_polyarchy"), "eps", "v2x_polyarchy")


def plant_units(t):
    """Generating units from the part table; several units share a plant."""
    key = F.col("p_partkey")
    plant = F.floor(key / 2)
    name = F.element_at(F.array(*[F.lit(NAMES[c]) for c in CODES if c in NAMES], F.lit("Atlantis")), (plant % 26 + 1).cast("int"))
    return t.part.select(
        F.concat(F.lit("P"), plant.cast("string")).alias("eic_p"),
        F.when(key % 5 != 0, F.concat(F.lit("G"), key.cast("string"))).alias("eic_g"),
        F.concat(F.lit("Plant "), plant.cast("string")).alias("name_p"), name.alias("country"),
        (plant * 37 % 60).cast("double").alias("lat"),
        F.when(plant % 40 != 0, (plant * 53 % 90).cast("double")).alias("lon"),
        fuel_text().alias("type_g"), (F.col("p_size") * 10.0).alias("capacity_p"),
    )


_PLANT_NAMES = [NAMES[c] for c in CODES] + ["Atlantis"]
_FUEL_SQL = f"""
site AS (SELECT CAST(c_custkey AS VARCHAR) AS installation_id, {ISO2_SQL} AS registry_id, CAST(c_custkey * 37 % 60 AS DOUBLE) AS lat,
                CAST(c_custkey * 53 % 90 AS DOUBLE) AS lon FROM customer),
units AS (SELECT p_partkey // 2 AS plant, {FUEL_TEXTS_SQL} AS type_g, CASE WHEN p_partkey % 5 <> 0 THEN 'G' || p_partkey END AS eic_g, p_size * 10e0 AS capacity FROM part),
fired AS (SELECT * FROM units WHERE regexp_matches(type_g, '(?i)fossil|biomass|peat|waste') AND plant % 40 <> 0 AND plant % 26 <> 25),
plants AS (SELECT plant, {_nation_sql('CAST(plant % 26 AS INTEGER)', CODES)} AS registry_id, CAST(plant * 37 % 60 AS DOUBLE) AS lat, CAST(plant * 53 % 90 AS DOUBLE) AS lon,
                  arg_min(type_g, (eic_g IS NULL, coalesce(eic_g, ''), type_g)) AS type_g FROM fired GROUP BY plant),
fuels AS (SELECT *, CASE WHEN regexp_matches(type_g, '(?i)coal|lignite') THEN 'coal' WHEN regexp_matches(type_g, '(?i)gas') THEN 'gas'
                         WHEN regexp_matches(type_g, '(?i)oil') THEN 'oil' WHEN regexp_matches(type_g, '(?i)biomass') THEN 'biomass'
                         WHEN regexp_matches(type_g, '(?i)peat') THEN 'peat' ELSE 'waste' END AS fuel FROM plants),
near AS (SELECT c.installation_id, c.registry_id, s.plant, s.fuel, 2 * 6378.137 * asin(least(1.0, sqrt(pow(sin(radians(s.lat - c.lat) / 2), 2)
           + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2)))) AS d
         FROM site c JOIN fuels s ON c.registry_id = s.registry_id),
best AS (SELECT * EXCLUDE k FROM (SELECT *, rank() OVER (PARTITION BY installation_id ORDER BY d) AS k FROM near) WHERE k = 1 AND d < 400)"""


@query("pipe_fuel_match", f"""WITH {_FUEL_SQL.strip()}
SELECT installation_id, registry_id, 'Plant ' || plant AS name_plant, fuel AS fuel_type, {r('d')} AS dist_km FROM best""")
def pipe_fuel_match(t):
    matches = fuel.fuel_match(installations(t), plant_units(t), radius_km=400)
    return round_all(matches.select("installation_id", "registry_id", "name_plant", "fuel_type", "dist_km"), "dist_km")


@query("pipe_fuel_crosswalk", f"""WITH {_FUEL_SQL.strip()}
SELECT DISTINCT installation_id, fuel AS fuel_type, 'P' || b.plant AS eic_p, eic_g FROM best b JOIN units u ON u.plant = b.plant""")
def pipe_fuel_crosswalk(t):
    units = plant_units(t)
    places = fuel.fuel_match(installations(t), units, radius_km=400, columns=[])
    return fuel.plant_crosswalk(places, units).select("installation_id", "fuel_type", "eic_p", "eic_g")


@query("pipe_fuel_coverage", with_panel(f""", {_FUEL_SQL.strip()},
one AS (SELECT installation_id, min(d) AS d FROM best GROUP BY installation_id),
p AS (SELECT unit, {_nation_sql('nation', CODES)} AS registry_id, d IS NOT NULL AS matched FROM panel LEFT JOIN one ON installation_id = CAST(unit AS VARCHAR)),
w AS (SELECT registry_id, nullif(count(DISTINCT unit) FILTER (NOT matched), 0) AS f, nullif(count(DISTINCT unit) FILTER (matched), 0) AS y FROM p GROUP BY registry_id)
SELECT registry_id, f AS "matched_FALSE", y AS "matched_TRUE", round_even(y * 100e0 / (y + f), 1) AS pct_matched FROM w"""))
def pipe_fuel_coverage(t):
    panel = t.panel.select(F.col("unit").cast("string").alias("installation_id"), iso2("nation").alias("registry_id"))
    matches = fuel.fuel_match(installations(t), plant_units(t), radius_km=400, columns=["fuel_type"])
    return fuel.country_coverage(fuel.with_fuel(panel, matches))


@query("pipe_fuel_representativeness", with_panel(f""", {_FUEL_SQL.strip()},
one AS (SELECT DISTINCT installation_id FROM best),
p AS (SELECT unit, verified, own, o.installation_id IS NOT NULL AS matched
      FROM panel LEFT JOIN one o ON o.installation_id = CAST(unit AS VARCHAR))
SELECT matched, count(*) AS n_obs, count(DISTINCT unit) AS n_units, {r('avg(verified)', 3)} AS mean_value,
       {r('median(verified)', 3)} AS median_value, {r('avg(CAST(own > 0 AS INTEGER))')} AS share_positive FROM p GROUP BY matched"""))
def pipe_fuel_representativeness(t):
    panel = t.panel.select(
        F.col("unit").cast("string").alias("installation_id"), "verified", F.col("own").alias("state_ownership_pct_tv")
    )
    matches = fuel.fuel_match(installations(t), plant_units(t), radius_km=400, columns=["fuel_type"])
    out = fuel.representativeness(fuel.with_fuel(panel, matches))
    return round_all(round_all(out, "mean_value", "median_value", digits=3), "share_positive")


@query("pipe_intensity", with_panel(f"""
, revenue AS (SELECT unit, yr, verified, CASE WHEN unit % 9 <> 0 THEN allocated END AS operating_revenue FROM panel),
i AS (SELECT *, CASE WHEN operating_revenue > 0 THEN verified / operating_revenue END AS x FROM revenue),
trimmed AS (SELECT *, CASE WHEN x <= (SELECT quantile_cont(x, 0.99) FROM i) THEN x END AS y FROM i)
SELECT unit, yr, {r('x')} AS emissions_intensity, {r('y')} AS emissions_intensity_trim,
       {r('CASE WHEN verified > 0 THEN ln(verified) END')} AS log_verified,
       {r('CASE WHEN y > 0 THEN ln(y) END')} AS log_emissions_intensity FROM trimmed"""))
def pipe_intensity(t):
    revenue = F.when(F.col("unit") % 9 != 0, F.col("allocated"))
    out = firms.with_intensity(t.panel.select("unit", "yr", "verified", revenue.alias("operating_revenue")))
    names = ("emissions_intensity", "emissions_intensity_trim", "log_verified", "log_emissions_intensity")
    return round_all(out, *names).select("unit", "yr", *names)


def daily_prices(t):
    def text_of(kind):
        return F.when(F.col("event_type") == kind, F.col("value").cast("string")).otherwise("")

    # Event days stand for days of seven years.
    day = F.date_add(F.lit("2008-01-01").cast("date"), (F.col("event_id") * 37 % 2500).cast("int"))
    return t.events.select(
        day.alias("date"), text_of("click").alias("primary_old"), text_of("view").alias("primary_new"),
        text_of("purchase").alias("secondary_new"),
    )


def tax_sheet(t):
    """Taxes from all suppliers: an id, an instrument and one column per year."""
    ids = list(fv.TAX_COUNTRY)
    schemes = t.supplier.groupBy((F.col("s_suppkey") % (len(ids) + 3)).alias("k")).agg(
        F.min("s_name").alias("name"), F.count(F.lit(1)).alias("n")
    )
    k = F.col("k")
    return schemes.select(
        F.coalesce(F.get(F.array(*map(F.lit, ids)), k.cast("int")), F.lit("Tax_XX")).alias("Unique ID"),
        F.col("name").alias("Name of the initiative"),
        F.when(k % 5 == 4, "ETS").otherwise("Carbon tax").alias("Instrument Type"),
        *[F.when((k + y) % 3 != 0, ((F.col("n") + k * 7 + y) % 50).cast("string")).alias(str(y)) for y in range(2008, 2015)],
    )


_TAX_CODES = "', '".join(fv.TAX_COUNTRY.values())


@query("pipe_carbon_price", with_panel(f"""
, daily AS (SELECT CAST(DATE '2008-01-01' + CAST(event_id * 37 % 2500 AS INTEGER) AS DATE) AS date, value AS price FROM events
            WHERE event_type IN ('click', 'view', 'purchase')),
annual AS (SELECT CAST(year(date) AS INTEGER) AS year, avg(price) AS eua_price FROM daily GROUP BY year(date)),
schemes AS (SELECT s_suppkey % {len(fv.TAX_COUNTRY) + 3} AS k, count(*) AS n FROM supplier GROUP BY ALL),
tax AS (SELECT (['{_TAX_CODES}'])[k + 1] AS country, CAST(y.y AS INTEGER) AS year, CAST((n + k * 7 + y.y) % 50 AS DOUBLE) AS tax
        FROM schemes, generate_series(2008, 2014) y(y) WHERE k < {len(fv.TAX_COUNTRY)} AND k % 5 <> 4 AND (k + y.y) % 3 <> 0)
SELECT unit, CAST(yr + 13 AS INTEGER) AS year, {_nation_sql('nation', CODES)} AS country, {r('eua_price')} AS eua_price, coalesce(tax, 0) AS national_tax,
       {r('eua_price + coalesce(tax, 0)')} AS combined_carbon_price
FROM panel LEFT JOIN annual a ON a.year = yr + 13 LEFT JOIN tax x ON x.year = yr + 13 AND x.country = {_nation_sql('nation', CODES)}"""))
def pipe_carbon_price(t):
    panel = t.panel.select("unit", (F.col("yr") + 13).alias("year"), iso2("nation").alias("country"))
    out = policy.carbon_price(panel, daily_prices(t), tax_sheet(t))
    return round_all(out.select("unit", "year", "country", "eua_price", "national_tax", "combined_carbon_price"), "eua_price", "combined_carbon_price")


def model_panel(t):
    """Unbalanced panel under the study's column names."""
    unit, yr = F.col("unit"), F.col("yr")
    indices = t.nation_years.select("nation", "yr", F.col("idx").alias("eps"))
    return t.panel.join(indices, ["nation", "yr"], "left").select(
        unit.alias("installation_id"), F.col("nation").alias("registry_id"), (yr + 13).alias("year"),
        F.col("firm").alias("bvdId"), (F.col("phase") + 1).alias("phase"), F.col("own").alias("state_ownership_pct_tv"),
        "eps", ((F.col("nation") * yr) % 29 / 29.0).alias("v2x_polyarchy"), F.col("n_orders").alias("n_employees"),
        F.col("abroad").alias("foreign_owned"), F.col("ratio").alias("surplus_norm"),
        F.when(F.col("verified") > 0, F.ln("verified")).alias("log_verified"),
        F.when(F.col("verified") > 0, F.ln(F.col("verified") / F.col("allocated"))).alias("log_emissions_intensity"),
    )


@query("pipe_model_table")
def pipe_model_table(t):
    # No closed form in SQL for an unbalanced panel; tested against explicit dummies.
    return study_models.published_table(model_panel(t), "log_verified_by_phase")


@query("pipe_model_table_country")
def pipe_model_table_country(t):
    # Country effects with the number of employees as a control; tested like the other tables.
    return study_models.published_table(model_panel(t), "lv_country_fe_employees")


@query("pipe_model_table_shifts")
def pipe_model_table_shifts(t):
    # Shifts of the ownership slope by phase, installation effects.
    return study_models.published_table(model_panel(t), "surplus_phase_interactions")
