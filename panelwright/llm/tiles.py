"""Work on all pairs inside groups, in tiles of bounded size.

A group is cut into blocks of about BLOCK members; each pair of blocks is a
tile, handled by one task.  A group of any size is so spread over tasks, and no
pair is a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import frozen


def tiled(members: DataFrame, group: list[str], spread: str, block: int, differs: str | None = None) -> DataFrame:
    """Members of groups of two or more with ``tile`` (first and second block) and ``side`` (their own block).

    A member comes once for each tile of its block.  ``spread`` is a column
    that tells members apart.  Groups whose members all have one value in
    ``differs`` are left out.
    """
    several = F.min(differs or spread) != F.max(differs or spread)
    sizes = frozen(
        members.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"), several.alias("_several"))
        .where("_size > 1 AND _several").drop("_several")
    )
    own = members.join(sizes, group).withColumn("_blocks", F.ceil(F.col("_size") / block).cast("int")).withColumn(
        "side", F.pmod(F.xxhash64(spread), F.col("_blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return own.withColumn("_other", other).withColumn(
        "tile", F.struct(F.least("side", "_other").alias("i"), F.greatest("side", "_other").alias("j"))
    ).withColumns({"i": F.col("tile.i"), "j": F.col("tile.j")}).drop("_size", "_blocks", "_other", "tile")


def per_tile(tiles: DataFrame, group: list[str], function: Callable, schema: str) -> DataFrame:
    """``function(table)``, which yields record batches, for each tile; many small tiles share a task."""
    keys = [*group, "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = _changes(batch, keys)
            if rest and not _same(rest[-1], batch, keys):
                yield from function(pa.Table.from_batches(rest))
                rest = []
            for a, b in zip(cut[:-1], cut[1:]):
                rest.append(batch.slice(a, b - a))
                if b < batch.num_rows:
                    yield from function(pa.Table.from_batches(rest))
                    rest = []
        if rest:
            yield from function(pa.Table.from_batches(rest))

    return tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for key in keys:
        values = batch.column(key).to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), batch.num_rows)


def _same(left: pa.RecordBatch, right: pa.RecordBatch, keys: list[str]) -> bool:
    return all(left.column(k)[left.num_rows - 1] == right.column(k)[0] for k in keys)


def forest(pairs: np.ndarray, size: int) -> np.ndarray:
    """The pairs that join trees when taken in turn: at most size - 1 rows with the same components."""
    root = list(range(size))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return np.array(kept, np.int64).reshape(-1, 2)
