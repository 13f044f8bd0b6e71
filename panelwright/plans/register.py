"""Emissions register to clean installation-year panel, power sector or all sectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.numeric import coverage_ratio, positive_log, positive_ratio, surplus, surplus_ratio
from ..functions.recode import flag, is_blank, phase_of_period, sector_of
from ..operators.aggregates import dedupe_by_priority, distinct_rows
from ..operators.filters import filter_range, filter_valid_obs
from ..operators.joins import join_on
from ..operators.ordered import lag_growth


def valid_compliance(compliance: DataFrame, installations: DataFrame, columns: list[str]) -> DataFrame:
    """Register rows of the given installations that carry a usable observation."""
    merged = join_on(compliance, installations, {"installation_id": "id"}, columns, how="inner")
    valid = filter_valid_obs(merged, "compliance_id", fv.KEPT_CODES, "verified", ["allocatedTotal"])
    return valid.withColumn("phase", phase_of_period(F.col("euetsPhase")))


def stationary(installations: DataFrame) -> DataFrame:
    return installations.where(~F.col("isAircraftOperator") & ~F.col("isMaritimeOperator"))


def clean_register(
    installations: DataFrame, compliance: DataFrame, low: float = -1.0, high: float = 10.0,
    one_row_per_year: bool = True,
) -> DataFrame:
    """Power-sector panel with derived variables, trimmed after the lag.

    ``one_row_per_year`` states that (installation, year) is unique, as in the
    register, which bounds the rows per installation.
    """
    power = stationary(installations).where(F.col("activity_id").isin(*fv.SECTORS["Power"]))
    columns = ["registry_id", "activity_id", "parentCompany", "nace_id", "latitudeGoogle", "longitudeGoogle"]
    verified, allocated = F.col("verified"), F.col("allocatedTotal")
    derived = valid_compliance(compliance, power, columns).withColumns({
        "surplus_raw": surplus(allocated, verified),
        "surplus_norm": surplus_ratio(allocated, verified),
        "coverage_ratio": coverage_ratio(allocated, verified),
        "compliant": flag(F.col("compliance_id").isin(*fv.COMPLIANT_CODES)),
    })
    grown = lag_growth(
        derived, ["installation_id"], "year", "verified", "emissions_growth", bounded=one_row_per_year
    )
    return filter_range(grown, "surplus_norm", low, high)


def firm_of_installation(accounts: DataFrame) -> DataFrame:
    """One firm id per installation; an active account wins over a former one."""
    usable = accounts.where(
        F.col("accountType_id").isin(*fv.ACCOUNT_TYPES)
        & ~is_blank(F.col("installation_id")) & ~is_blank(F.col("bvdId"))
    ).select("installation_id", "bvdId", "accountType_id")
    chosen = dedupe_by_priority(
        usable, ["installation_id"], "accountType_id", fv.ACCOUNT_TYPES[0], ["accountType_id", "bvdId"]
    )
    return chosen.select("installation_id", "bvdId")


def with_firm(panel: DataFrame, accounts: DataFrame) -> DataFrame:
    return panel.join(firm_of_installation(accounts), "installation_id", "left")


def all_sectors(
    installations: DataFrame, compliance: DataFrame, accounts: DataFrame,
    ownership: DataFrame, financials: DataFrame,
) -> DataFrame:
    """The same cleaning for every sector, with firm attributes and intensity.

    Firm rows without an id match panel rows without an id, as data-frame joins
    do; pass frames without missing ids to switch that off.
    """
    verified, allocated = F.col("verified"), F.col("allocatedTotal")
    panel = valid_compliance(
        compliance, stationary(installations), ["registry_id", "activity_id", "nace_id"]
    ).withColumns({
        "surplus_norm": surplus_ratio(allocated, verified),
        "log_verified": positive_log(verified),
    })
    panel = filter_range(panel.where(F.col("phase") > 1), "surplus_norm", -1, 10)
    panel = with_firm(panel, accounts).withColumn("sector", sector_of(F.col("activity_id")))
    attributes = distinct_rows(
        ownership, "bvdId", "state_ownership_pct", "state_owned_binary", "guo_state",
        "foreign_owned", "guo_type", "guo_country",
    )
    yearly = distinct_rows(
        financials, "bvdId", "year", "total_assets", "operating_revenue", "n_employees"
    )
    panel = join_on(panel, attributes, ["bvdId"], null_safe=True)
    panel = join_on(panel, yearly, ["bvdId", "year"], null_safe=True)
    intensity = positive_ratio(verified, F.col("operating_revenue"))
    return panel.withColumn("emissions_intensity", intensity).withColumn(
        "log_emissions_intensity", positive_log(F.col("emissions_intensity"))
    )
