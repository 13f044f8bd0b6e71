"""Exact quantiles (linear interpolation between order statistics).

Spark's ``percentile`` keeps every distinct value of a group in one buffer.
That is the fastest plan while groups are small, and it cannot work when one
group holds a large part of a big table.  So the row counts are checked first;
beyond the limit the order statistics are found by narrowing:

1. count rows per logarithmic bucket (64 buckets per factor e), per group;
2. only for the buckets that hold a wanted rank, count rows in 65,536 equal
   slices between the bucket's minimum and maximum, twice in a row;
3. count the rows per distinct value of the slices that are left.

Every step is a map-side combined aggregate, so no group is ever collected in
one task, and slices after step 2 are at most 2**-38 wide relative to the
value, which leaves at most some thousand distinct doubles per wanted rank.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import present
from ..session import BROADCAST_ROWS, frozen

#: Rows that Spark's own ``percentile`` may buffer, in total or per group.
BUFFERED_ROWS = 1_000_000
BUFFERED_GROUP_ROWS = 10_000

_SLICES = 65_536
_SALTS = 32


def join_keys_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi join in which a null key matches a null key; right keys are dropped."""
    renamed = right.withColumnsRenamed({key: f"_r_{key}" for key in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{key}" for key in keys])


@dataclass(frozen=True)
class GroupSizes:
    """What one cheap aggregate tells about the groups of a frame."""

    total: int
    largest: int
    groups: int
    crowded: int


def _sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))


def group_sizes(
    df: DataFrame, by: Sequence[str], buffered_group_rows: int = BUFFERED_GROUP_ROWS
) -> GroupSizes:
    row = _sizes(df, by).agg(
        F.sum("_n").alias("total"), F.max("_n").alias("largest"), F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("_n") > buffered_group_rows).alias("crowded"),
    ).first()
    return GroupSizes(row["total"] or 0, row["largest"] or 0, row["groups"], row["crowded"])


def quantile_columns(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    buffered_rows: int = BUFFERED_ROWS,
    buffered_group_rows: int = BUFFERED_GROUP_ROWS,
    sizes: GroupSizes | None = None,
    written: bool = False,
) -> DataFrame:
    """One row per group: the group columns, then one column per named quantile.

    Missing values are ignored; a group without any value gives nulls.
    ``written`` says that ``df`` is a plain scan of a written table.
    """
    by = list(by)
    number = F.col(value).cast("double")
    values = df.select(*by, F.when(present(number), number).alias("_v"))
    if not written:
        values = frozen(values)  # once; the size check and every pass read the copy
    sizes = sizes or group_sizes(values, by, buffered_group_rows)
    if sizes.total <= buffered_rows or sizes.largest <= buffered_group_rows:
        return _buffered(values, by, probs)
    if sizes.crowded < sizes.groups and sizes.crowded * 2 * len(probs) <= BROADCAST_ROWS:
        # A few crowded groups among many ordinary ones: narrow only those.
        table = frozen(_sizes(values, by).where(F.col("_n") > buffered_group_rows).select(*by))
        crowded = F.broadcast(table)
        ordinary = join_keys_null_safe(values, crowded, by, "left_anti")
        return _buffered(ordinary, by, probs).unionByName(
            _narrowed(join_keys_null_safe(values, crowded, by, "left_semi"), by, probs, True)
        )
    return _narrowed(values, by, probs, sizes.groups * 2 * len(probs) <= BROADCAST_ROWS)


def _buffered(values: DataFrame, by: list[str], probs: Mapping[str, float]) -> DataFrame:
    wanted = F.expr("percentile(_v, array(%s))" % ", ".join(f"{p!r}D" for p in probs.values()))
    packed = values.groupBy(*by).agg(wanted.alias("_q"))
    return packed.select(*by, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])


def _narrowed(
    values: DataFrame, by: list[str], probs: Mapping[str, float], few_groups: bool
) -> DataFrame:
    found = _by_narrowing(values.where(F.col("_v").isNotNull()), by, probs, few_groups)
    return join_keys_null_safe(values.select(*by).distinct(), found, by, "left") if by else found


def _coarse(value: Column) -> Column:
    """Order-preserving bucket: sign, then logarithm of the magnitude; infinities are outermost."""
    size = F.abs(value)
    step = F.when(size == float("inf"), F.lit(1_000_000)).otherwise(F.floor(F.ln(size) * 64) + 100_000)
    return F.when(value > 0, step).when(value < 0, -step).otherwise(F.lit(0)).cast("long")


def _slice(value: Column, low: Column, high: Column) -> Column:
    # Halves, so that the width of a bucket of huge numbers stays finite.
    inside = F.floor(F.try_divide(value / 2 - low / 2, high / 2 - low / 2) * _SLICES)
    # A bucket of one value, as those of the infinities, is one slice.
    return F.when(low == high, F.lit(0)).otherwise(
        F.coalesce(F.least(inside, F.lit(_SLICES - 1)), F.lit(0))
    ).cast("long")


def _ranks(probs: Sequence[float]) -> Column:
    """Both order statistics around each wanted position, as an array of structs."""
    positions = {float(p): (F.col("_size") - 1) * F.lit(float(p)) for p in sorted(set(probs))}
    return F.array_distinct(F.array(*[
        F.struct(F.lit(p).alias("_p"), position.alias("_position"), side.alias("_whole"))
        for p, position in positions.items()
        for side in (F.floor(position), F.ceil(position))
    ]))


def _with_ends(buckets: DataFrame, path: Sequence[str], bucket: str) -> DataFrame:
    """Rows before and up to each bucket; a path has a limited number of buckets."""
    upto = W.partitionBy(*path or [F.lit(0)]).orderBy(bucket).rowsBetween(W.unboundedPreceding, 0)
    ends = buckets.withColumn("_end", F.sum("_n").over(upto))
    return ends.withColumn("_start", F.col("_end") - F.col("_n"))


def _inside_bucket(targets: DataFrame) -> DataFrame:
    """Keep the bucket of every rank and count the rank from the bucket's start."""
    inside = (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end"))
    return targets.where(inside).withColumn("_rank", F.col("_rank") - F.col("_start"))


_TARGET = ["_p", "_position", "_whole", "_rank"]


def _by_narrowing(
    values: DataFrame, by: list[str], probs: Mapping[str, float], few: bool
) -> DataFrame:
    if few:
        rows = values.withColumn("_w", F.lit(1))
    else:
        # Too many wanted slices to broadcast: collapse equal values first, so
        # that a hash of the value can spread a crowded slice over tasks.
        rows = values.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_w"))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(_SALTS)))

    def only(rows: DataFrame, slices: DataFrame, path: Sequence[str]) -> DataFrame:
        if few:
            return join_keys_null_safe(rows, F.broadcast(slices), path)
        salts = F.array(*[F.lit(salt).cast("long") for salt in range(_SALTS)])
        # The copies hide from size estimates, so the join strategy is fixed here.
        salted = slices.withColumn("_salt", F.explode(salts)).hint("merge")
        return join_keys_null_safe(rows, salted, [*path, "_salt"])

    spread = [F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    rows = rows.withColumn("_b0", _coarse(F.col("_v")))
    path = [*by, "_b0"]
    whole = W.partitionBy(*by or [F.lit(0)])
    coarse = rows.groupBy(*path).agg(*spread).withColumn("_size", F.sum("_n").over(whole))
    targets = _with_ends(coarse, by, "_b0").select("*", F.inline(_ranks(list(probs.values()))))
    # The wanted slices are few; writing them keeps each level one plain scan.
    wanted = frozen(_inside_bucket(targets.withColumn("_rank", F.col("_whole"))))
    for level in ("_b1", "_b2"):
        rows = only(rows, wanted.select(*path, "_lo", "_hi").distinct(), path)
        rows = rows.withColumn(level, _slice(F.col("_v"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
        ends = _with_ends(rows.groupBy(*path, level).agg(*spread), path, level)
        wanted = frozen(_inside_bucket(join_keys_null_safe(ends, wanted.select(*path, *_TARGET), path)))
        path = [*path, level]
    rows = only(rows, wanted.select(*path).distinct(), path)
    ends = _with_ends(rows.groupBy(*path, "_v").agg(F.sum("_w").alias("_n")), path, "_v")
    exact = _inside_bucket(join_keys_null_safe(ends, wanted.select(*path, *_TARGET), path))

    below = F.max(F.when(F.col("_whole") == F.floor("_position"), F.col("_v")))
    above = F.max(F.when(F.col("_whole") == F.ceil("_position"), F.col("_v")))
    weight = F.first(F.col("_position") - F.floor("_position"))
    between = F.when(below == above, below).otherwise((1 - weight) * below + weight * above)
    pairs = exact.groupBy(*by, "_p").agg(between.alias("_q"))
    return pairs.groupBy(*by).agg(*[
        F.max(F.when(F.col("_p") == p, F.col("_q"))).alias(name) for name, p in probs.items()
    ])


def quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), **limits: int
) -> DataFrame:
    """Tidy form: one row per group and probability."""
    names = {f"q{i}": p for i, p in enumerate(probs)}
    wide = quantile_columns(df, value, names, by, **limits)
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.col(n).alias("quantile"))
                      for n, p in names.items()])
    return wide.select(*by, F.inline(pairs))
