"""Row filters. All conditions reach the scan as pushed filters where possible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import present
from ..functions.recode import is_blank, matches_ignoring_case
from .quantiles import quantile_columns


def filter_flags_in(df: DataFrame, unset: Sequence[str], code: str, codes: Sequence) -> DataFrame:
    """Rows whose flags are all false and whose code is listed."""
    condition = F.col(code).isin(*codes)
    for name in unset:
        condition = condition & ~F.col(name)
    return df.where(condition)


def filter_valid_obs(
    df: DataFrame, code: str, codes: Sequence, positive: str, required: Sequence[str] = ()
) -> DataFrame:
    """Listed status, positive measure, and further measures present."""
    condition = F.col(code).isin(*codes) & present(F.col(positive)) & (F.col(positive) > 0)
    for name in required:
        condition = condition & F.col(name).isNotNull()
    return df.where(condition)


def filter_range(df: DataFrame, name: str, low: object, high: object) -> DataFrame:
    """Inclusive bounds."""
    return df.where(F.col(name).between(low, high))


def filter_nonblank(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.where(~is_blank(F.col(name)))
    return df


def filter_equals(df: DataFrame, name: str, value: object, negate: bool = False) -> DataFrame:
    """Equality or inequality with a constant; missing values are dropped either way."""
    return df.where(F.col(name) != value) if negate else df.where(F.col(name) == value)


def filter_in_set(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    return df.where(F.col(name).isin(*values))


def filter_not_null(df: DataFrame, *names: str) -> DataFrame:
    return df.dropna(subset=list(names))


def filter_threshold(
    df: DataFrame, name: str, above: float | None = None, at_most: float | None = None
) -> DataFrame:
    if above is not None:
        df = df.where(F.col(name) > above)
    if at_most is not None:
        df = df.where(F.col(name) <= at_most)
    return df


def drop_na_listwise(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The chosen columns on rows where all of them are present (NaN is missing)."""
    return df.select(*names).dropna(subset=list(names))


def filter_regex_ci(df: DataFrame, name: str, pattern: str) -> DataFrame:
    return df.where(matches_ignoring_case(F.col(name), pattern))


def filter_group_having(
    df: DataFrame, keys: Sequence[str], measures: Sequence[Column], condition: Column
) -> DataFrame:
    """Aggregate per group and keep the groups meeting the condition."""
    return df.groupBy(*keys).agg(*measures).where(condition)


def filter_year_window(df: DataFrame, year: str, first: int, last: int) -> DataFrame:
    return df.where(F.col(year).between(first, last))


def bracket_cutoff_trim(df: DataFrame, name: str, prob: float, result: str) -> DataFrame:
    """Null out values above a percentile of the column itself.

    The cutoff is a scalar subquery: one row, computed once, no join.
    """
    cutoff = quantile_columns(df, name, {"cutoff": prob}).select("cutoff").scalar()
    return df.withColumn(result, F.when(F.col(name) <= cutoff, F.col(name)))


def trim_report(df: DataFrame, name: str, low: float, high: float) -> DataFrame:
    """Rows kept and dropped by a fixed range, among rows with a value."""
    inside = F.col(name).between(low, high)
    return (
        df.where(F.col(name).isNotNull())
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(inside).alias("kept"),
            F.count_if(~inside).alias("dropped"),
            F.bround(F.avg((~inside).cast("int")) * 100, 1).alias("pct_dropped"),
        )
    )
