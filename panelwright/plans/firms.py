"""Firm attributes, financials and state ownership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.numeric import positive_log, positive_ratio, to_number
from ..functions.recode import flag, is_member
from ..functions.text import year_in_text
from ..operators.aggregates import any_true, capped_sum, filtered_max
from ..operators.filters import bracket_cutoff_trim
from ..operators.joins import join_on, join_rekey_by_name
from ..operators.ordered import complete_years, ffill_group, ffill_row_order
from ..operators.projection import names_with_prefix, project_rename, quoted
from ..operators.reshape import build_financials, split_rows, union_by_name
from ..sources.schemas import FIRM_COLUMNS, FIRM_FAMILIES

_FIRM, _NAME = "BvD ID number", "Company name Latin alphabet"


def state_ownership(shareholders: DataFrame, wholly_owned_as: float | None = None) -> DataFrame:
    """Largest state share per firm, from multi-valued shareholder cells.

    "WO" (wholly owned) counts as missing unless ``wholly_owned_as`` gives it a value.
    """
    lists = ["CSH - Name", "CSH - Type", "CSH - Direct %", "CSH - Total %"]
    keys = [_FIRM, _NAME, "Country ISO code"]
    holders = split_rows(shareholders.select(*map(quoted, keys + lists)), lists)
    share = quoted("CSH - Direct %")
    direct = to_number(share, "n.a.", "WO", "")
    if wholly_owned_as is not None:
        direct = F.when(share == "WO", F.lit(float(wholly_owned_as))).otherwise(direct)
    by_state = is_member(quoted("CSH - Type"), fv.STATE_TYPES)
    return holders.groupBy(*[quoted(k) for k in keys]).agg(
        filtered_max(direct, by_state).alias("state_ownership_pct"),
        flag(any_true(by_state)).alias("state_owned_binary"),
        F.count(F.lit(1)).alias("n_shareholders"),
    )


def firm_attributes(firms: DataFrame) -> DataFrame:
    """Firm dimension with the two ownership flags."""
    named = project_rename(firms.where(quoted(_FIRM).isNotNull()), FIRM_COLUMNS)
    abroad = F.col("guo_country").isNotNull() & (F.col("guo_country") != F.col("country"))
    return named.withColumns({
        "guo_total_pct": to_number(F.col("guo_total_pct"), "n.a."),
        "guo_state": flag(is_member(F.col("guo_type"), fv.STATE_TYPES)),
        "foreign_owned": flag(abroad),
    })


def firm_panel(
    panel: DataFrame, firms: DataFrame, shareholders: DataFrame, first: int = 2005, last: int = 2023
) -> DataFrame:
    """Panel with firm attributes, static state ownership and yearly financials."""
    owned = state_ownership(shareholders).select(
        quoted(_FIRM).alias("bvdId"), "state_ownership_pct", "state_owned_binary"
    )
    attributes = join_on(firm_attributes(firms), owned, ["bvdId"])
    money = build_financials(
        firms.where(quoted(_FIRM).isNotNull()), _FIRM, FIRM_FAMILIES, first, last
    ).withColumnRenamed(_FIRM, "bvdId")
    return join_on(join_on(panel, attributes, ["bvdId"]), money, ["bvdId", "year"])


def shareholder_rows(sheet: DataFrame, row_number: str, block_rows: int = 1_000_000) -> DataFrame:
    """Shareholder rows of a hierarchical sheet, the company carried down to each."""
    filled = ffill_row_order(sheet, row_number, ["bvdId", _NAME], block_rows)
    return filled.where(quoted("SH - Name").isNotNull())


def ownership_panel(
    sheets: Sequence[DataFrame], firms: DataFrame, row_number: str = "row_no",
    first: int = 2008, last: int = 2023, by_name: bool = True, block_rows: int = 1_000_000,
) -> DataFrame:
    """Annual state share per firm from snapshot columns of shareholder sheets.

    ``by_name`` keeps one series per (firm, company name), as the published
    results do; without it the shares of a firm's names are added up first.
    """
    names = firms.select(quoted(_FIRM).alias("bvdId"), quoted(_NAME))
    keyed = [
        join_rekey_by_name(
            shareholder_rows(sheet, row_number, block_rows), names, _NAME, "bvdId", drop=[row_number]
        )
        for sheet in sheets
    ]
    stacked = union_by_name(*keyed).where(F.col("bvdId").isNotNull())
    snapshots = names_with_prefix(stacked, "SH - Direct %")
    ids = ["bvdId", _NAME, "SH - Name", "SH - Type"]
    long = stacked.select(*map(quoted, [*ids, *snapshots])).unpivot(
        [quoted(i) for i in ids], [quoted(s) for s in snapshots], "_date", "_pct"
    ).select(
        "bvdId", _NAME, year_in_text(F.col("_date")).alias("year"),
        to_number(F.col("_pct"), "n.a.", "-").alias("pct"),
        is_member(quoted("SH - Type"), fv.STATE_TYPES).alias("is_state"),
    )
    keys = ["bvdId", *([_NAME] if by_name else []), "year"]
    stated = F.col("is_state") & F.col("pct").isNotNull()
    yearly = long.groupBy(*keys).agg(
        capped_sum(F.col("pct"), F.col("is_state"), 100).alias("state_ownership_pct_tv"),
        flag(any_true(stated)).alias("state_owned_binary_tv"),
        F.count_if(stated).alias("n_gov_shareholders"),
    )
    complete = complete_years(yearly, ["bvdId"], "year", first, last)
    values = ["state_ownership_pct_tv", "state_owned_binary_tv"]
    if by_name:
        # A firm may appear under any number of names, so its rows are not bounded.
        return ffill_group(complete, ["bvdId"], ["year", _NAME], values)
    return ffill_group(complete, ["bvdId"], ["year"], values, bounded=True)


def with_intensity(panel: DataFrame, prob: float = 0.99) -> DataFrame:
    """Emissions per revenue, trimmed at a percentile, with logarithms."""
    rows = panel.withColumns({
        "emissions_intensity": positive_ratio(F.col("verified"), F.col("operating_revenue")),
        "log_verified": positive_log(F.col("verified")),
    })
    trimmed = bracket_cutoff_trim(rows, "emissions_intensity", prob, "emissions_intensity_trim")
    return trimmed.withColumn("log_emissions_intensity", positive_log(F.col("emissions_intensity_trim")))
