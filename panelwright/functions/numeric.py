"""Numeric expressions that return null where plain arithmetic would raise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .recode import null_if


def present(value: Column) -> Column:
    """Neither null nor NaN (NaN counts as missing everywhere in the library)."""
    return value.isNotNull() & ~F.isnan(value)


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def surplus(allocated: Column, verified: Column) -> Column:
    return allocated - verified


def surplus_ratio(allocated: Column, verified: Column) -> Column:
    return F.try_divide(allocated - verified, verified)


def coverage_ratio(allocated: Column, verified: Column) -> Column:
    return F.try_divide(allocated, verified)


def growth(value: Column, previous: Column) -> Column:
    return F.try_divide(value - previous, previous)


def positive_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio only where the denominator is positive."""
    return F.when(denominator > 0, F.try_divide(numerator, denominator))


def positive_log(value: Column) -> Column:
    return F.when(value > 0, F.ln(value))


def log_plus_one(value: Column) -> Column:
    return F.when(value > -1, F.log1p(value))


def share_of_total(value: Column, total: Column) -> Column:
    """Share of a positive cumulative total; shares outside [0, 1] give null."""
    share = F.when(total > 0, F.try_divide(value, total))
    return F.when(share.between(0, 1), share)


def to_number(text: Column, *missing: str) -> Column:
    """Text to double; listed sentinels and unparsable text give null."""
    cleaned = null_if(text, *missing) if missing else text
    return cleaned.try_cast("double")


def first_present(*values: Column) -> Column:
    return F.coalesce(*values)


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def percent_true(condition: Column, digits: int = 1) -> Column:
    """Aggregate: percentage of rows where the condition holds, ties to even."""
    return F.bround(F.avg(condition.cast("int")) * 100, digits)


def safe_corr(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation, null (not an error) for a constant column.

    Both columns must be complete on the aggregated rows, because the three
    moments have to see the same rows.
    """
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
