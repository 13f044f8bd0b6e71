"""Grouped summaries. All are hash aggregates with map-side partial results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import percent_true, present
from ..session import frozen
from .quantiles import join_keys_null_safe, quantile_columns


def agg_group_basic(
    df: DataFrame, by: Sequence[str], value: str, scale: float = 1.0
) -> DataFrame:
    """Sum (optionally scaled), mean and number of rows per group."""
    return df.groupBy(*by).agg(
        (F.coalesce(F.sum(value), F.lit(0.0)) / scale).alias("total"),
        F.avg(value).alias("mean"),
        F.count(F.lit(1)).alias("n"),
    )


def sum_or_zero(value: Column) -> Column:
    """Sum that is 0, not null, over nothing."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def filtered_max(value: Column, condition: Column) -> Column:
    """Largest value among flagged rows, 0 when there is none."""
    return F.coalesce(F.max(F.when(condition, value)), F.lit(0.0))


def capped_sum(value: Column, condition: Column, cap: float) -> Column:
    """Sum over flagged rows, at most ``cap``."""
    return F.least(sum_or_zero(F.when(condition, value)), F.lit(float(cap)))


def any_true(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def share_where(condition: Column) -> Column:
    """Mean of a predicate over the rows where it is known."""
    return F.avg(condition.cast("int"))


def n_distinct(name: str) -> Column:
    """Distinct values with a missing value counting as one more."""
    return F.count_distinct(name) + F.max(F.col(name).isNull().cast("int"))


def distinct_rows(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names).distinct()


def first_by(values: Sequence[str], order: Sequence[Column]) -> Column:
    """Aggregate: the values of the row that comes first in a total order.

    Missing order values come last. ``min_by`` combines on the map side, so the
    rows of a hot key never meet in one task, unlike a ``row_number`` window.
    """
    rank = F.struct(*[part for key in order for part in (key.isNull(), key)])
    return F.min_by(F.struct(*values), rank)


def keep_first(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per key: the first in a total order, all (or the named) columns kept."""
    values = [c for c in (columns or df.columns) if c not in keys]
    return df.groupBy(*keys).agg(first_by(values, order).alias("_row")).select(*keys, "_row.*")


def dedupe_by_priority(
    df: DataFrame, keys: Sequence[str], code: str, preferred: object, tie_break: Sequence[str]
) -> DataFrame:
    """One row per key, a row with the preferred code before any other."""
    priority = F.when(F.col(code) == preferred, 0).otherwise(1)
    return keep_first(df, keys, [priority, *map(F.col, tie_break)])


def freq_table(
    df: DataFrame, *names: str, keep_missing: bool = True, top: int | None = None
) -> DataFrame:
    """Counts per value, most frequent first; ``top`` limits the report."""
    rows = df if keep_missing else df.dropna(subset=list(names))
    counts = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    if top is None:
        return counts
    order = [F.desc("n"), *[F.asc_nulls_last(name) for name in names]]
    return counts.orderBy(*order).limit(top)


def coverage_report(
    df: DataFrame, columns: Mapping[str, Column | str], by: Sequence[str] = ()
) -> DataFrame:
    """Rows, non-missing counts and percentages of several columns, one pass."""
    measures = [F.count(F.lit(1)).alias("n")]
    for name, column in columns.items():
        known = (F.col(column) if isinstance(column, str) else column).isNotNull()
        measures.append(F.count_if(known).alias(f"n_{name}"))
        measures.append(percent_true(known).alias(f"pct_{name}"))
    return df.groupBy(*by).agg(*measures)


def coverage_by_each(
    df: DataFrame, column: Column, groupings: Sequence[str]
) -> DataFrame:
    """Coverage of one column by several groupings at once (one scan, grouping sets)."""
    rows = df.select(column.isNotNull().alias("_known"), *[F.col(g).cast("string") for g in groupings])
    sets = [[]] + [[g] for g in groupings]
    counted = rows.groupingSets(sets, *groupings).agg(
        F.grouping_id(*groupings).alias("_set"),
        F.count(F.lit(1)).alias("n"),
        percent_true(F.col("_known")).alias("pct_coverage"),
    )
    # Bit i of the grouping id is 0 for the one grouping column in use.
    width = len(groupings)
    label = F.lit("all")
    for position, name in enumerate(groupings):
        used = (2**width - 1) - 2 ** (width - 1 - position)
        label = F.when(F.col("_set") == used, F.lit(name)).otherwise(label)
    level = F.coalesce(*[F.col(g) for g in groupings]) if groupings else F.lit(None)
    return counted.select(label.alias("grouping"), level.alias("level"), "n", "pct_coverage")


def coverage_span(df: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """First and last year with any value, per key."""
    with_data = df.where(F.col(value).isNotNull()).groupBy(key, year).agg(F.lit(1).alias("_one"))
    return with_data.groupBy(key).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"))


def five_number_summary(
    df: DataFrame, columns: Sequence[str], **limits: int
) -> DataFrame:
    """Min, quartiles, mean, max and missing count of several columns, tidy."""
    wide = frozen(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))

    def ends_of(c: str) -> Column:
        known = F.when(present(F.col(c)), F.col(c))
        return F.struct(
            F.lit(c).alias("variable"), F.min(known).alias("min"), F.avg(known).alias("mean"), F.max(known).alias("max"),
            F.count_if(known.isNull()).alias("n_missing"),
        )

    ends = wide.agg(F.array(*map(ends_of, columns)).alias("_ends")).select(F.inline("_ends"))
    long = wide.unpivot([], list(columns), "variable", "value")
    middle = quantile_columns(
        long, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["variable"], written=True, **limits
    )
    return ends.join(middle, "variable").select(
        "variable", "min", "q1", "median", "mean", "q3", "max", "n_missing"
    )


def unit_dispersion(df: DataFrame, unit: str, value: str, *carry: Column) -> DataFrame:
    """Spread of a value inside each unit, units without variation left out."""
    per_unit = df.where(F.col(value).isNotNull()).groupBy(unit).agg(
        F.stddev_samp(value).alias("sd"),
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        (F.max(value) - F.min(value)).alias("change"),
        F.count(F.lit(1)).alias("n"),
        *carry,
    )
    return per_unit.where(F.col("sd") > 0)


def changed_units(df: DataFrame, unit: str, value: str) -> DataFrame:
    """Units whose value is not the same on all their rows."""
    ends = df.groupBy(unit).agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    return ends.where(F.col("min_value") != F.col("max_value"))


def coef_of_variation(df: DataFrame, unit: str, value: str) -> DataFrame:
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(unit).agg(F.try_divide(F.stddev_samp(value), F.avg(value)).alias("cv"))


def nested_freq(
    df: DataFrame, value: str, name: str, by: Sequence[str] = (), part_size: int | None = None
) -> DataFrame:
    """A whole frequency table as map cells, one per group.

    A cell holds all levels of its group.  With ``part_size`` the levels of a
    group are spread by hash over several rows, numbered by ``part``, of about
    that many levels each, so that no cell grows with the data.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    keys = list(by)
    if part_size is not None:
        counts = frozen(counts)
        levels = counts.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / part_size).alias("_parts"))
        counts = join_keys_null_safe(counts, levels, keys).withColumn(
            "part", (F.pmod(F.xxhash64(value), F.col("_parts")) + 1).cast("int")
        )
        keys.append("part")
    pairs = F.collect_list(F.struct(F.col(value).cast("string"), F.col("n")))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(pairs)).alias(name))


def matched_vs_unmatched(
    df: DataFrame, matched: str, unit: str, measure: str, share: str, **limits: int
) -> DataFrame:
    """Two populations side by side: sizes, distinct units, mean, median, a rate."""
    means = df.groupBy(matched).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.count_distinct(unit).alias("n_units"),
        F.avg(measure).alias("mean_value"),
        share_where(F.col(share) > 0).alias("share_positive"),
    )
    medians = quantile_columns(df, measure, {"median_value": 0.5}, [matched], **limits)
    return join_keys_null_safe(means, medians, [matched])


def value_range(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.min(name).alias("low"), F.max(name).alias("high"))
