"""Fuel type of an installation from the nearest known power plant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import fixed_values as fv
from ..functions.recode import fuel_of, lookup, matches_ignoring_case
from ..operators.aggregates import first_by, matched_vs_unmatched
from ..operators.reshape import pivot_flag
from ..operators.spatial import best_match_per_row, nearest_within_radius
from ..session import frozen


def combustion_plants(units: DataFrame) -> DataFrame:
    """One row per plant: fuel and capacity of its first unit, in a known country."""
    fired = units.where(
        matches_ignoring_case(F.col("type_g"), fv.COMBUSTION_PATTERN)
        & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    ).withColumn("fuel_type", fuel_of(F.col("type_g")))
    plants = fired.groupBy("eic_p", "name_p", "country", "lat", "lon").agg(
        first_by(["fuel_type", "capacity_p"], [F.col("eic_g"), F.col("type_g")]).alias("_first")
    ).select("eic_p", "name_p", "country", "lat", "lon", "_first.*")
    coded = plants.withColumn("registry_id", lookup(fv.COUNTRY_TO_ISO2, F.col("country")))
    return coded.where(F.col("registry_id").isNotNull())


def site_coordinates(installations: DataFrame) -> DataFrame:
    return installations.where(
        F.col("latitudeGoogle").isNotNull() & F.col("longitudeGoogle").isNotNull()
    ).select(
        F.col("id").alias("installation_id"), F.col("name").alias("install_name"), "registry_id",
        F.col("latitudeGoogle").alias("lat_site"), F.col("longitudeGoogle").alias("lon_site"),
    ).distinct()


def known_plants(units: DataFrame) -> DataFrame:
    return combustion_plants(units).select(
        "registry_id", F.col("lat").alias("lat_plant"), F.col("lon").alias("lon_plant"),
        "fuel_type", "capacity_p", F.col("name_p").alias("name_plant"),
    )


def fuel_match(
    installations: DataFrame, units: DataFrame, radius_km: float = 5.0, columns: Sequence[str] | None = None
) -> DataFrame:
    """Installations with the nearest plant of their country inside the radius.

    With ``columns``, plants of one place that agree in them count once: a crowded
    place gives an installation one row per combination, with no columns one row.
    """
    plants = known_plants(units)
    if columns is not None:
        plants = plants.select("registry_id", "lat_plant", "lon_plant", *columns).distinct()
    return nearest_within_radius(
        site_coordinates(installations), plants, radius_km=radius_km, country="registry_id",
        left_place=("lat_site", "lon_site"), right_place=("lat_plant", "lon_plant"),
    )


def with_fuel(panel: DataFrame, matches: DataFrame) -> DataFrame:
    """Panel with one match per installation and a matched flag."""
    one = best_match_per_row(
        matches.select("installation_id", "fuel_type", "dist_km"), "installation_id",
        ["dist_km", "fuel_type"],
    )
    joined = panel.join(one, "installation_id", "left")
    return joined.withColumn("matched", F.col("fuel_type").isNotNull())


def representativeness(panel_with_fuel: DataFrame) -> DataFrame:
    return matched_vs_unmatched(
        panel_with_fuel, "matched", "installation_id", "verified", "state_ownership_pct_tv"
    )


def country_coverage(panel_with_fuel: DataFrame) -> DataFrame:
    return pivot_flag(
        panel_with_fuel, ["registry_id"], "matched", F.count_distinct("installation_id"), "matched_"
    )


def plant_crosswalk(matched_places: DataFrame, units: DataFrame) -> DataFrame:
    """Matched installations with the plant and unit codes at the same place.

    ``matched_places`` comes from ``fuel_match`` with no columns.  Installations and codes are made
    distinct before they meet, so the many rows of a crowded place are neither
    shuffled nor sorted.  The same row can then come out twice only where one
    installation has several nearest places and one code stands at several
    places; such pairs alone are made distinct afterwards.
    """
    place = ["registry_id", "lat_plant", "lon_plant"]
    site = ["installation_id", "install_name", "registry_id", "dist_km"]
    code = ["registry_id", "name_plant", "fuel_type", "eic_p", "eic_g"]
    listed = units.where(F.col("eic_p").isNotNull()).select(
        F.col("name_p").alias("name_plant"), F.col("lat").alias("lat_plant"),
        F.col("lon").alias("lon_plant"), "eic_p", "eic_g",
    ).distinct()
    plants = known_plants(units).select(*place, "name_plant", "fuel_type").distinct()
    codes = plants.join(listed, ["name_plant", "lat_plant", "lon_plant"]).select(*code, "lat_plant", "lon_plant")
    # Written once, as both kinds of pairs read them.
    sites = frozen(_with_repeats(matched_places.select(*site, "lat_plant", "lon_plant").distinct(), site, "_tied"))
    codes = frozen(_with_repeats(codes, code, "_spread"))
    twice = F.col("_tied") & F.col("_spread")
    pairs = sites.join(codes, place)
    columns = ["installation_id", "install_name", "registry_id", "name_plant", "fuel_type", "dist_km", "eic_p", "eic_g"]
    return pairs.where(~twice).select(*columns).unionByName(pairs.where(twice).select(*columns).distinct())


def _with_repeats(rows: DataFrame, by: list[str], flag: str) -> DataFrame:
    """Flag rows that share all ``by`` columns, missing values included, with another row."""
    return rows.withColumn(flag, F.count(F.lit(1)).over(W.partitionBy(*by)) > 1)
