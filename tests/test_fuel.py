"""Crosswalk of installations and plant codes: against the plain join, and on a crowded place."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelwright.plans import fuel
from tools.check_oracle import compare

COLUMNS = ["installation_id", "install_name", "registry_id", "name_plant", "fuel_type", "dist_km", "eic_p", "eic_g"]
UNIT = "eic_p string, eic_g string, name_p string, country string, lat double, lon double, type_g string, capacity_p double"


def unit(eic_p, eic_g, name, lat, lon, kind="Fossil Gas", country="Germany"):
    return eic_p, eic_g, name, country, lat, lon, kind, 10.0


UNITS = [
    unit("P1", "G1", "Twin", 50.0, 9.0), unit("P1", "G1", "Twin", 50.0, 11.0),  # one code east and west of a site
    unit("P1", "G2", "Twin", 50.0, 11.0), unit("P1", None, "Twin", 50.0, 9.0), unit("P1", None, "Twin", 50.0, 11.0),
    unit("P2", "G3", "Shared", 52.0, 10.0), unit("P3", "G4", "Shared", 52.0, 10.0, "Biomass"),  # one name, two plants
    unit(None, "G5", "Shared", 52.0, 10.0, "Waste"), unit("P2", "G6", "Shared", 52.0, 10.0, "Hydro"),
    unit("P4", "G7", "Shared", 52.0, 10.0, country="France"), unit("P5", "G8", None, 52.0, 10.0),
    unit("P6", "G9", "Abroad", 47.0, 2.0, country="France"), unit("P7", "G10", "Nowhere", None, 2.0),
    unit("P2", "G3", "Shared", 52.0, 10.0), unit("P1", "G1", "Twin", 0.0, 0.0),
]
SITES = [
    ("1", "between", "DE", 50.0, 10.0), ("2", "near", "DE", 52.0, 10.1), ("2", "near", "DE", 52.0, 9.9),
    ("3", None, "DE", 52.0, 10.0), (None, None, "DE", 50.0, 9.0), (None, None, "DE", 50.0, 11.0),
    (None, None, "DE", 52.0, 10.0), ("4", "far", "DE", 20.0, 10.0), ("5", "south", "FR", 47.0, 2.0),
    ("6", "no country", None, 50.0, 9.0), ("7", "unplaced", "DE", None, 9.0), ("1", "between", "DE", 50.0, 10.0),
]


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_crosswalk_equals_the_plain_join(spark, broadcast):
    units = spark.createDataFrame(UNITS, UNIT)
    sites = spark.createDataFrame(SITES, "id string, name string, registry_id string, latitudeGoogle double, longitudeGoogle double")
    codes = units.select(F.col("name_p").alias("name_plant"), F.col("lat").alias("lat_plant"), F.col("lon").alias("lon_plant"), "eic_p", "eic_g")
    plain = fuel.fuel_match(sites, units, 100.0).join(codes, ["name_plant", "lat_plant", "lon_plant"])
    want = plain.where("eic_p IS NOT NULL").select(*COLUMNS).distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = fuel.plant_crosswalk(fuel.fuel_match(sites, units, 100.0, []), units)
        assert got.columns == COLUMNS
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        # G1 is west and east of the site between them, yet comes once.
        assert got.where("installation_id = '1' AND eic_g = 'G1'").count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_plants_of_one_place_and_fuel_count_once(spark):
    kinds = ["Fossil Gas", "Biomass"]
    units = spark.createDataFrame([unit(f"P{i}", None, f"N{i}", 52.0, 10.0, kinds[i % 2]) for i in range(40)], UNIT)
    sites = spark.createDataFrame(SITES, "id string, name string, registry_id string, latitudeGoogle double, longitudeGoogle double")
    every, few = fuel.fuel_match(sites, units, 100.0), fuel.fuel_match(sites, units, 100.0, ["fuel_type"])
    assert (every.count(), few.count()) == (4 * 40, 4 * 2)  # four sites within reach
    panel = spark.createDataFrame([("1",), ("2",), ("4",)], "installation_id string")
    with_every, with_few = (sorted(map(tuple, fuel.with_fuel(panel, m).collect())) for m in (every, few))
    assert with_every == with_few and [r[-1] for r in with_few].count(True) == 1


def rows_dealt(plan):
    """Rows written by the exchanges of an executed plan, written tables aside."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return rows_dealt(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return rows_dealt(plan.plan())
    metrics, children = plan.metrics(), plan.children()
    own = metrics.apply("shuffleRecordsWritten").value() if metrics.contains("shuffleRecordsWritten") else 0
    return own + sum(rows_dealt(children.apply(i)) for i in range(children.size()))


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_rows_of_a_crowded_place_are_not_dealt(spark, tmp_path, broadcast):
    n = 300
    # All customers and all plants stand in one place of one country.
    customers = spark.range(n).select((F.col("id") * 180 + 1).alias("c_custkey"), F.lit("c").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit("s").alias("c_mktsegment"))
    parts = spark.range(n).select((F.col("id") * 4680 + 2).alias("p_partkey"), F.lit("p").alias("p_name"), F.lit(1).alias("p_size"))
    con = duckdb.connect()
    for name, rows in (("customer", customers), ("part", parts)):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        out = entry.queries()["pipe_fuel_crosswalk"](spark, str(tmp_path))
        assert len(out.collect()) == n * n
        assert rows_dealt(out._jdf.queryExecution().executedPlan()) <= 10 * n
        verdict = compare(out, con, entry.oracle_sql()["pipe_fuel_crosswalk"])
        assert verdict.startswith("ok") and "TYPES" not in verdict, verdict
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
