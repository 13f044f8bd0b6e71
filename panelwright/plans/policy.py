"""Country-year policy indices and carbon prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.numeric import first_present, or_zero, to_number
from ..operators.joins import dict_lookup, join_inner_lookup, join_on
from ..operators.ordered import ffill_by_level
from ..operators.projection import drop_if_exists, names_matching, project_rename, quoted
from ..operators.reshape import unpivot_years


def policy_indices(
    panel: DataFrame, stringency: DataFrame, democracy: DataFrame,
    first: int = 2008, last: int = 2023, fill: bool = False,
) -> DataFrame:
    """Panel with climate-policy stringency and democracy indices of its country.

    ``fill`` carries the last known stringency of a country forward.
    """
    eps = project_rename(
        stringency.where((F.col("CLIM_POL") == "EPS") & F.col("TIME_PERIOD").between(first, last)),
        {"country_iso3": "REF_AREA", "year": "TIME_PERIOD", "eps": "OBS_VALUE"},
    )
    vdem = democracy.where(F.col("year").between(first, last)).select(
        F.col("country_text_id").alias("country_iso3"), "year", "v2x_polyarchy", "v2x_libdem", "v2x_corr"
    )
    keyed = dict_lookup(panel, fv.ISO2_TO_ISO3, "registry_id", "country_iso3")
    rows = join_on(keyed, eps, ["country_iso3", "year"])
    if fill:
        rows = ffill_by_level(rows, "registry_id", "year", "eps")
    return join_on(rows, vdem, ["country_iso3", "year"])


def daily_price(prices: DataFrame) -> DataFrame:
    """First available of the three quotes per day, newest market first."""
    quotes = [to_number(F.col(c), "") for c in ("secondary_new", "primary_new", "primary_old")]
    return prices.select("date", first_present(*quotes).alias("price")).where(F.col("price").isNotNull())


def annual_price(prices: DataFrame) -> DataFrame:
    return daily_price(prices).groupBy(F.year("date").alias("year")).agg(
        F.avg("price").alias("eua_price"), F.count(F.lit(1)).alias("n_obs")
    )


def national_tax(taxes: DataFrame) -> DataFrame:
    """Carbon taxes by country and year from one column per year."""
    years = names_matching(taxes, r"^\d{4}$")
    only = taxes.where(quoted("Instrument Type") == "Carbon tax")
    long = unpivot_years(only, ["Unique ID", "Name of the initiative"], years, "_tax")
    numbers = long.select(
        quoted("Unique ID").alias("_tax_id"), "year", to_number(F.col("_tax"), "").alias("national_tax")
    ).where(F.col("national_tax").isNotNull())
    return join_inner_lookup(numbers, fv.TAX_COUNTRY, "_tax_id", "country").select(
        "country", "year", "national_tax"
    )


def carbon_price(panel: DataFrame, prices: DataFrame, taxes: DataFrame) -> DataFrame:
    """Panel with the market price, the national tax (0 where none) and their sum."""
    priced = join_on(drop_if_exists(panel, "eua_price"), annual_price(prices), ["year"], ["eua_price"])
    taxed = join_on(priced, national_tax(taxes), ["country", "year"])
    return taxed.withColumn("national_tax", or_zero(F.col("national_tax"))).withColumn(
        "combined_carbon_price", F.col("eua_price") + F.col("national_tax")
    )
