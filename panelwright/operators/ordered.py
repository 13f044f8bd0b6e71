"""Operations that depend on row order: lag, fill, complete, rank, sort.

Two plans exist for lag and fill.

* ``bounded=True``: one plain window per unit. Only right when a unit has a
  limited number of rows by construction, e.g. after aggregation to one row
  per unit and year.
* otherwise rows are placed in range blocks of (unit, order) of about equal
  size, however many rows one unit has. Windows run inside a block; the state
  at the end of a block is handed to the next one through a table with one row
  per block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import growth
from ..session import broadcast_if_small, discard, frozen
from .quantiles import join_keys_null_safe

#: Rows per block when blocks are cut by row number, and blocks per super block.
BLOCK_ROWS = 1_000_000
BLOCKS_PER_GROUP = 1_000


def nulls_last(*names: str) -> list[Column]:
    return [F.col(name).asc_nulls_last() for name in names]


def _range_blocks(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows with the number of their range partition, written once.

    The number of blocks follows the number of rows, and is at least that of the
    shuffle partitions, of which adaptive execution may join small ones.  The
    written copy fixes the placement, so every later read (also after a lost
    executor) sees the same blocks.
    """
    source = frozen(df)
    blocks = math.ceil(source.count() / BLOCK_ROWS)
    order = nulls_last(*names)
    if blocks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        ranged = source.repartitionByRange(blocks, *order)
    else:
        ranged = source.repartitionByRange(*order)
    placed = frozen(ranged.withColumn("_block", F.spark_partition_id()))
    discard(source)
    return placed


def _block_ends(blocks: DataFrame, keys: Sequence[str], order: Sequence[str],
                values: Sequence[str], skip_missing: bool) -> DataFrame:
    """Per block: the state handed to the next block (one row per block).

    The state is the last unit of the block and, for each value, its last row
    or its last present value within that unit.
    """
    sort_key = F.struct(*[part for n in [*keys, *order] for part in (F.col(n).isNull(), F.col(n))])
    unit = F.struct(F.lit(1).alias("_one"), *keys)
    last_unit = blocks.groupBy("_block").agg(F.max_by(unit, sort_key).alias("_unit"))
    # One row per block.
    of_last_unit = blocks.join(F.broadcast(last_unit), "_block").where(
        F.struct(F.lit(1).alias("_one"), *keys).eqNullSafe(F.col("_unit"))
    )
    measures = [
        F.max_by(F.col(v), F.when(F.col(v).isNotNull(), sort_key) if skip_missing else sort_key).alias(v)
        for v in values
    ]
    return of_last_unit.groupBy("_block", "_unit").agg(*measures)


def _handed_over(ends: DataFrame, values: Sequence[str], cumulative: bool) -> DataFrame:
    """Shift block states down by one block.

    The window is over one row per block, of which there are at most as many as
    shuffle partitions, not a number of data rows.
    """
    blocks = W.partitionBy(F.lit(0)).orderBy("_block")
    if cumulative:
        same_unit = W.partitionBy("_unit").orderBy("_block").rowsBetween(W.unboundedPreceding, 0)
        ends = ends.withColumns({v: F.last(v, ignorenulls=True).over(same_unit) for v in values})
    return ends.select(
        "_block",
        F.lag("_unit").over(blocks).alias("_unit_before"),
        *[F.lag(v).over(blocks).alias(f"_before_{v}") for v in values],
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
    prefix: str = "prev_", bounded: bool = False,
) -> DataFrame:
    """Add the values of the unit's previous row in a total order (gaps count as adjacent)."""
    names = {v: f"{prefix}{v}" for v in values}
    if bounded:
        window = W.partitionBy(*keys).orderBy(*nulls_last(*order))
        return df.withColumns({new: F.lag(v).over(window) for v, new in names.items()})
    blocks = _range_blocks(df, [*keys, *order])
    # At most one row per shuffle partition: bounded by configuration, safe to broadcast.
    before = F.broadcast(_handed_over(
        _block_ends(blocks, keys, order, values, skip_missing=False), values, cumulative=False
    ))
    inside = W.partitionBy("_block", *keys).orderBy(*nulls_last(*order))
    rows = blocks.withColumns({
        "_first": F.row_number().over(inside) == 1,
        **{new: F.lag(v).over(inside) for v, new in names.items()},
    }).join(before, "_block", "left")
    continues = F.col("_first") & F.struct(F.lit(1).alias("_one"), *keys).eqNullSafe(F.col("_unit_before"))
    return rows.select(*df.columns, *[
        F.when(continues, F.col(f"_before_{v}")).otherwise(F.col(new)).alias(new)
        for v, new in names.items()
    ])


def lag_growth(
    df: DataFrame, unit: Sequence[str], year: str, value: str, result: str, bounded: bool = False
) -> DataFrame:
    """Relative change against the unit's previous row."""
    rows = with_previous(df, unit, [year], [value], "_prev_", bounded)
    return rows.withColumn(result, growth(F.col(value), F.col(f"_prev_{value}"))).drop(f"_prev_{value}")


def change_events(
    df: DataFrame, unit: Sequence[str], order: Sequence[str], value: str, bounded: bool = False
) -> DataFrame:
    """Units with the number of rows whose value differs from the row before."""
    known = df.select(*unit, *order, value).where(F.col(value).isNotNull())
    rows = with_previous(known, unit, order, [value], "_prev_", bounded)
    changed = rows.where(F.col(value) != F.col(f"_prev_{value}"))
    return changed.groupBy(*unit).agg(F.count(F.lit(1)).alias("n_changes"))


def ffill_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
    bounded: bool = False,
) -> DataFrame:
    """Carry the last present value down inside each unit."""
    if bounded:
        window = W.partitionBy(*keys).orderBy(*nulls_last(*order)).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({v: F.last(v, ignorenulls=True).over(window) for v in values})
    blocks = _range_blocks(df, [*keys, *order])
    before = F.broadcast(_handed_over(
        _block_ends(blocks, keys, order, values, skip_missing=True), values, cumulative=True
    ))
    inside = W.partitionBy("_block", *keys).orderBy(*nulls_last(*order)).rowsBetween(
        W.unboundedPreceding, 0
    )
    rows = blocks.withColumns(
        {f"_in_{v}": F.last(v, ignorenulls=True).over(inside) for v in values}
    ).join(before, "_block", "left")
    continues = F.struct(F.lit(1).alias("_one"), *keys).eqNullSafe(F.col("_unit_before"))
    filled = {
        v: F.coalesce(F.col(f"_in_{v}"), F.when(continues, F.col(f"_before_{v}"))) for v in values
    }
    return rows.withColumns(filled).select(*df.columns)


def ffill_by_level(
    df: DataFrame, level: str, year: str, value: str
) -> DataFrame:
    """Fill a value that is one per (level, year), such as a country index.

    Reduces to one row per (level, year) first, fills those few rows, and joins
    them back, so a hot level is never windowed as a whole.
    """
    cells = df.groupBy(level, year).agg(F.max(value).alias(value))
    filled = broadcast_if_small(ffill_group(cells, [level], [year], [value], bounded=True))
    return join_keys_null_safe(df.drop(value), filled, [level, year], "left").select(*df.columns)


def ffill_row_order(
    df: DataFrame, row_number: str, values: Sequence[str], block_rows: int = BLOCK_ROWS,
    blocks_per_group: int = BLOCKS_PER_GROUP,
) -> DataFrame:
    """Carry values down a sheet in row order, with no grouping key at all.

    Rows are filled inside blocks of consecutive row numbers; what a block
    leaves open comes from the last value of an earlier block.  The block table
    is filled the same way in groups of blocks, so its last step sees one row
    per ``block_rows * blocks_per_group`` sheet rows.
    """
    def last_value(rows: DataFrame, by: str, order: str) -> DataFrame:
        return rows.groupBy(by).agg(*[
            F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values
        ])

    def fill_inside(rows: DataFrame, by: Column, order: str, stop: int) -> dict[str, Column]:
        window = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, stop)
        return {f"_in_{v}": F.last(v, ignorenulls=True).over(window) for v in values}

    rows = df.withColumn("_block", F.floor(F.col(row_number) / block_rows))
    blocks = last_value(rows, "_block", row_number).withColumn(
        "_group", F.floor(F.col("_block") / blocks_per_group)
    )
    groups = last_value(blocks, "_group", "_block")
    opened = groups.select("_group", *[
        column.alias(name.replace("_in_", "_from_group_"))
        for name, column in fill_inside(groups, F.lit(0), "_group", -1).items()
    ])
    carried = (
        blocks.withColumns(fill_inside(blocks, F.col("_group"), "_block", -1))
        .join(opened, "_group", "left")
        .select("_block", *[
            F.coalesce(f"_in_{v}", f"_from_group_{v}").alias(f"_before_{v}") for v in values
        ])
    )
    filled = rows.withColumns(fill_inside(rows, F.col("_block"), row_number, 0)).join(
        carried, "_block", "left"
    )
    return filled.withColumns(
        {v: F.coalesce(f"_in_{v}", f"_before_{v}") for v in values}
    ).select(*df.columns)


def complete_years(
    df: DataFrame, unit: Sequence[str], year: str, first: int, last: int
) -> DataFrame:
    """Add a row for every missing year of a unit; all given rows stay as they are.

    Given rows are never moved: only the set of years present per unit (at most
    ``last - first + 1`` values) is aggregated, and its complement is appended.
    """
    kind = df.schema[year].dataType
    in_range = F.when(F.col(year).between(first, last), F.col(year).cast("int"))
    present = df.groupBy(*unit).agg(F.collect_set(in_range).alias("_present"))
    absent = F.array_except(F.sequence(F.lit(first), F.lit(last)), F.col("_present"))
    missing = present.select(*unit, F.explode(absent).alias(year)).withColumn(
        year, F.col(year).cast(kind)
    )
    return df.unionByName(missing, allowMissingColumns=True)


def rank_min_ties(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All rows holding their group's smallest value.

    Aggregate, then join on group *and* value: the rows of a hot group spread
    over the join partitions by value instead of meeting in one window.
    """
    lowest = df.groupBy(*keys).agg(F.min(value).alias(value))
    return join_keys_null_safe(df, lowest, [*keys, value], "left_semi")


def sort_multi(df: DataFrame, *order: tuple[str, bool]) -> DataFrame:
    """Sort by (column, ascending) pairs, missing values last either way."""
    return df.orderBy(*[
        F.col(name).asc_nulls_last() if ascending else F.col(name).desc_nulls_last()
        for name, ascending in order
    ])


def topk_outliers(
    df: DataFrame, value: str, above: float, k: int, tie_break: Sequence[str] = ()
) -> DataFrame:
    """The k largest rows above a threshold (top-k per task, then merged)."""
    order = [F.col(value).desc(), *nulls_last(*tie_break)]
    return df.where(F.col(value) > above).orderBy(*order).limit(k)


def limit_rows(df: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    """The first k rows of an explicit order."""
    return df.orderBy(*nulls_last(*order)).limit(k)


def reorder_levels(
    df: DataFrame, level: str, statistic: Column, result: str = "level_rank"
) -> DataFrame:
    """Category labels with their rank by a statistic: one row per level."""
    per_level = df.groupBy(level).agg(statistic.alias("statistic"))
    return with_row_position(per_level, ["statistic", level], result)


def with_row_position(df: DataFrame, order: Sequence[str], result: str) -> DataFrame:
    """Global row number (from 1) of a totally ordered frame, without one big task.

    After a range sort, ``monotonically_increasing_id`` numbers the rows inside
    each partition; adding the sizes of the earlier partitions (one row each)
    makes the numbers global.
    """
    sorted_rows = frozen(
        df.repartitionByRange(*nulls_last(*order))
        .sortWithinPartitions(*nulls_last(*order))
        .withColumn("_id", F.monotonically_increasing_id())
    )
    rows = sorted_rows.withColumns({
        "_block": F.shiftright("_id", 33),
        "_inside": F.col("_id").bitwiseAND(2**33 - 1),
    })
    earlier = W.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(
        "_block", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")
    )
    # At most one row per shuffle partition: bounded by configuration, safe to broadcast.
    placed = rows.join(F.broadcast(offsets), "_block")
    return placed.withColumn(result, F.col("_offset") + F.col("_inside") + 1).select(*df.columns, result)
