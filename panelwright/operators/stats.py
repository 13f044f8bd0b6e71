"""Correlations, tests, histograms, box-plot numbers, trends."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from ..functions.numeric import present, safe_corr
from ..session import BROADCAST_ROWS, frozen
from .distributions import student_t_two_sided
from .filters import drop_na_listwise
from .quantiles import BUFFERED_GROUP_ROWS, group_sizes, join_keys_null_safe, quantile_columns

@F.pandas_udf(DoubleType())
def t_test_p_value(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Two-sided Student t probability; used on result rows only, never on data rows."""
    for statistic, freedom in batches:
        yield pd.Series([student_t_two_sided(t, df) for t, df in zip(statistic, freedom)], dtype=float)


def corr_matrix(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), more_than: int = 0
) -> DataFrame:
    """Pearson correlations of all pairs on complete rows, one aggregate, tidy.

    With ``by`` all groups are done in the same job; groups of ``more_than``
    rows or fewer are left out afterwards.  Pairs appear in both directions and
    with themselves, like a matrix.
    """
    rows = df.select(*by, *columns).dropna(subset=list(columns))
    pairs = list(combinations(columns, 2))
    packed = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[safe_corr(F.col(a), F.col(b)).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)],
        *[(F.max(c) != F.min(c)).alias(f"_varies{i}") for i, c in enumerate(columns)],
    ).where(F.col("n") > more_than)
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in ((a, b), (b, a)):
            cells.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"_r{i}").alias("r")))
    for i, c in enumerate(columns):
        own = F.when(F.col(f"_varies{i}"), F.lit(1.0))
        cells.append(F.struct(F.lit(c).alias("x"), F.lit(c).alias("y"), own.alias("r")))
    return packed.select(*by, "n", F.inline(F.array(*cells)))


def corr_pairwise(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation over the rows where both columns are present."""
    return drop_na_listwise(df, [x, y]).agg(
        safe_corr(F.col(x), F.col(y)).alias("r"), F.count(F.lit(1)).alias("n")
    )


def corr_test(df: DataFrame, x: str, y: str, level: float = 0.95) -> DataFrame:
    """Pearson test: r, t, degrees of freedom, p-value and confidence interval."""
    r, n = F.col("r"), F.col("n")
    z = NormalDist().inv_cdf(0.5 + level / 2)
    spread = F.lit(z) / F.sqrt(F.when(n > 3, n - 3))
    statistic = F.try_divide(r * F.sqrt(n - 2), F.sqrt(1 - r * r))
    result = corr_pairwise(df, x, y).withColumns({
        "t": statistic,
        "df": (n - 2).cast("long"),
        "conf_low": F.tanh(F.atanh(r) - spread),
        "conf_high": F.tanh(F.atanh(r) + spread),
    })
    return result.withColumn("p_value", t_test_p_value(F.col("t"), F.col("df").cast("double")))


def two_level_mean(
    df: DataFrame, level: str, year: str, values: Sequence[str]
) -> DataFrame:
    """Mean per year over the distinct (level, year, values) rows that are complete."""
    cells = df.select(level, year, *values).distinct().dropna(subset=list(values))
    return cells.groupBy(year).agg(*[F.avg(v).alias(f"{v}_mean") for v in values])


def histogram_bins(
    df: DataFrame, value: str, bins: int, by: Sequence[str] = ()
) -> DataFrame:
    """Counts in equal-width bins over the common range of all facets.

    The range is one scalar subquery; the maximum belongs to the last bin.
    """
    rows = df.where(present(F.col(value).cast("double"))).select(
        *by, F.col(value).cast("double").alias("_v")
    )
    ends = rows.agg(F.struct(F.min("_v").alias("low"), F.max("_v").alias("high"))).scalar()
    low, high = F.col("_low"), F.col("_high")
    rows = rows.withColumn("_ends", ends).withColumns(
        {"_low": F.col("_ends.low"), "_high": F.col("_ends.high")}
    )
    number = F.floor(F.try_divide(F.col("_v") - low, high - low) * bins).cast("int") + 1
    numbered = rows.withColumn("bin", F.least(F.coalesce(number, F.lit(1)), F.lit(bins)))
    counts = numbered.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.first("_low").alias("_low"), F.first("_high").alias("_high")
    )
    width = (high - low) / bins
    return counts.select(
        *by, "bin", "n", (low + width * (F.col("bin") - 1)).alias("bin_low"),
        (low + width * F.col("bin")).alias("bin_high"),
    )


def boxplot_stats(df: DataFrame, value: str, by: Sequence[str], **limits: int) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges, and outliers per group."""
    by = list(by)
    rows = frozen(df.where(present(F.col(value).cast("double"))).select(
        *by, F.col(value).cast("double").alias("_v")
    ))
    sizes = group_sizes(rows, by, limits.get("buffered_group_rows", BUFFERED_GROUP_ROWS))
    boxes = quantile_columns(
        rows, "_v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, by, sizes=sizes, written=True, **limits
    )
    if sizes.groups <= BROADCAST_ROWS:
        boxes = F.broadcast(boxes)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fenced = join_keys_null_safe(rows, boxes, by)
    inside = F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach)
    within = F.when(inside, F.col("_v"))
    return fenced.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.first(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(within).alias("whisker_low"),
        F.max(within).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def linear_trend(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of y on x with standard errors, one aggregate.

    ``residual_variance``, ``mean_x`` and ``sxx`` give the band around the line:
    the variance at x is ``residual_variance * (1 / n + (x - mean_x)**2 / sxx)``.
    """
    # Spark's regr_* take (y, x) and skip incomplete pairs.
    pair = (F.col(y), F.col(x))
    moments = df.groupBy(*by).agg(
        F.regr_count(*pair).alias("n"),
        F.regr_avgx(*pair).alias("_mx"),
        F.regr_avgy(*pair).alias("_my"),
        F.regr_sxx(*pair).alias("_sxx"),
        F.regr_syy(*pair).alias("_syy"),
        F.regr_sxy(*pair).alias("_sxy"),
    )
    slope = F.try_divide(F.col("_sxy"), F.col("_sxx"))
    rest = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    variance = F.try_divide(rest, F.when(F.col("n") > 2, F.col("n") - 2))
    about_mean = F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(
        F.col("_mx") * F.col("_mx"), F.col("_sxx")
    )
    return (
        moments.withColumn("slope", slope)
        .withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
        .withColumn("slope_se", F.sqrt(F.try_divide(variance, F.col("_sxx"))))
        .withColumn("intercept_se", F.sqrt(variance * about_mean))
        .withColumn("residual_variance", variance)
        .select(
            *by, "n", "slope", "intercept", "slope_se", "intercept_se", "residual_variance",
            F.col("_mx").alias("mean_x"), F.col("_sxx").alias("sxx"),
        )
    )


def time_trend_series(
    df: DataFrame, year: str, measures: Mapping[str, Column], median_of: str | None = None,
    by: Sequence[str] = (), **limits: int,
) -> DataFrame:
    """Yearly totals and means, with the yearly median of one column if asked for."""
    keys = [year, *by]
    series = df.groupBy(*keys).agg(*[m.alias(name) for name, m in measures.items()])
    if median_of is None:
        return series
    medians = quantile_columns(df, median_of, {f"median_{median_of}": 0.5}, keys, **limits)
    return join_keys_null_safe(series, medians, keys)
