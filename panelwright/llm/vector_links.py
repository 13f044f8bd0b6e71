"""Links between vectors of one label by cosine: int8 tile products with error bounds, doubtful pairs in full.

Unit vectors are rounded to int8 with a scale of their own.  With ``u = s q + e``
the cosine of two vectors differs from ``s s' q.q'`` by at most
``|sq||e'| + |e||s'q'| + |e||e'|``, and both norms of the rounding errors are
known exactly.  Tiles get codes, scales and norms only, and settle every pair
whose bounds lie on one side of the threshold.  The full vectors go only to
tiles with doubtful pairs, and only those with a part in them; there the cosine
is computed in double precision.  Equal vectors are one vector with a number of
copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import frozen
from .components import components
from .tiles import forest, per_tile, tiled

BLOCK = 1024
#: Components whose int8 products a 32-bit float adds up without rounding.
EXACT = 1024
PAIRS = 1 << 15


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scales, norms of the rounded vectors and norms of the rounding errors."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    rounded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(rounded, axis=1), np.linalg.norm(unit - rounded, axis=1)


def bounds(left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
    """What the cosines of two sets of quantised vectors are at least and at most."""
    (a, s, n, e), (b, t, m, f) = left, right
    product = np.zeros((len(a), len(b)))
    for start in range(0, a.shape[1], EXACT):
        part = slice(start, start + EXACT)
        product += a[:, part].astype(np.float32) @ b[:, part].astype(np.float32).T
    product *= np.outer(s, t)
    slack = np.outer(n, f) + np.outer(e, m) + np.outer(e, f) + 1e-9
    return product - slack, product + slack


def _units(vectors: pa.ListArray, width: int) -> np.ndarray:
    given = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    given = given / np.abs(given).max(axis=1)[:, None]  # no overflow in the squares
    return given / np.linalg.norm(given, axis=1)[:, None]


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Int8 codes of the vectors, one after another as bytes."""
    for batch in batches:
        widths = batch.column("width").to_numpy()
        for width in np.unique(widths).tolist():
            own = batch.filter(pa.array(widths == width))
            codes, scale, norm, error = quantised(_units(own.column("vector"), width))
            yield pa.RecordBatch.from_arrays(
                [own.column("row"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(norm),
                 pa.array(error)],
                ["row", "codes", "scale", "norm", "error"],
            )


def _doubtful(table: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, in a tile, of the pairs surely linked and of the pairs that may be."""
    side, width = table.column("side").to_numpy(), table.column("width")[0].as_py()
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int8).reshape(-1, width)
    quantities = (codes, *(table.column(c).to_numpy() for c in ("scale", "norm", "error")))
    same = table.column("i")[0] == table.column("j")[0]
    low = np.flatnonzero(side == table.column("i")[0].as_py())
    high = low if same else np.flatnonzero(side != table.column("i")[0].as_py())
    least, most = bounds(*(tuple(q[part] for q in quantities) for part in (low, high)))
    sure, maybe = least >= threshold, (most >= threshold) & (least < threshold)
    if same:
        sure, maybe = np.triu(sure, 1), np.triu(maybe, 1)
    (a, b), (c, d) = np.nonzero(sure), np.nonzero(maybe)
    return low[a], high[b], low[c], high[d]


def _counted(rows: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list, list, list]:
    """Links of each row of a tile, by copies, and links that join the same components."""
    links = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
    joined = forest(np.column_stack([a, b]), len(rows))
    some = np.flatnonzero(links)
    return (
        [*rows[some], *rows[joined[:, 0]]], [*[None] * len(some), *rows[joined[:, 1]]],
        [*links[some].astype(np.int64), *[0] * len(joined)],
    )


def _settled(table: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links that the bounds of a tile settle; rows with a doubtful pair, with their tile."""
    table = table.combine_chunks()
    rows = table.column("row").to_numpy()
    a, b, c, d = _doubtful(table, threshold)
    u, v, links = _counted(rows, table.column("copies").to_numpy(), a, b)
    open_ = rows[np.unique(np.concatenate([c, d]))]
    i, j = (table.column(x)[0].as_py() for x in ("i", "j"))
    none, doubt = [None] * len(u), [None] * len(open_)
    yield pa.RecordBatch.from_arrays(
        [pa.array([*u, *open_], pa.int64()), pa.array([*v, *doubt], pa.int64()), pa.array([*links, *doubt], pa.int64()),
         pa.array([*none, *[i] * len(open_)], pa.int32()), pa.array([*none, *[j] * len(open_)], pa.int32())],
        ["a", "b", "links", "i", "j"],
    )


def _computed(table: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links among the doubtful pairs of a tile, from the full vectors."""
    table = table.combine_chunks()
    rows = table.column("row").to_numpy()
    _, _, a, b = _doubtful(table, threshold)
    unit = _units(table.column("vector").chunk(0), table.column("width")[0].as_py())
    sure = np.concatenate([np.zeros(0, bool), *(
        np.einsum("ij,ij->i", unit[a[s : s + PAIRS]], unit[b[s : s + PAIRS]]) >= threshold
        for s in range(0, len(a), PAIRS)
    )])
    u, v, links = _counted(rows, table.column("copies").to_numpy(), a[sure], b[sure])
    yield pa.RecordBatch.from_arrays(
        [pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(links, pa.int64())], ["a", "b", "links"]
    )


def vector_links(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93,
) -> DataFrame:
    """One row per input row: key, n_links (other rows linked directly), component_id and kept.

    Rows are linked if their labels are equal and not null and the cosine is
    ``threshold`` or more.  Vectors that are null, empty, zero, or have null or
    non-finite components link with nothing, nor do vectors of different
    lengths.  The component is named by its smallest key, a null key coming
    last; ``kept`` is whether the key is that name.  Other columns are not
    looked at.
    """
    values = F.col(f"`{vector}`").cast("array<double>")
    clean = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.coalesce(
        F.col(f"`{label}`").isNotNull() & (F.size(values) > 0) & clean & F.exists(values, lambda x: x != 0), F.lit(False)
    )
    last = F.lit(2**63 - 1)
    rows = table.select(
        F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{label}`").alias("label"), values.alias("vector"),
        fit.alias("fit"),
    )
    single = frozen(
        rows.where("fit").groupBy("label", "vector")
        .agg(F.min(F.coalesce("id", last)).alias("first"), F.count(F.lit(1)).alias("copies"))
        .withColumns({"row": F.monotonically_increasing_id(), "width": F.size("vector")})
    )
    coded = frozen(single.select("row", "width", "vector").mapInArrow(
        _codes, "row bigint, codes binary, scale double, norm double, error double"
    ))
    group = ["label", "width"]
    tiles = tiled(single.select("row", *group, "copies"), group, "row", BLOCK)
    settled = frozen(per_tile(
        tiles.join(coded, "row"), group, partial(_settled, threshold=threshold),
        "a bigint, b bigint, links bigint, i int, j int",
    ))
    needed = settled.where("i IS NOT NULL").select(F.col("a").alias("row"), "i", "j")
    computed = per_tile(
        tiles.join(needed, ["row", "i", "j"]).join(coded, "row").join(single.select("row", "vector"), "row"), group,
        partial(_computed, threshold=threshold), "a bigint, b bigint, links bigint",
    )
    pairs = frozen(settled.where("i IS NULL").select("a", "b", "links").unionByName(computed))
    counted = pairs.groupBy(F.col("a").alias("row")).agg(F.sum("links").alias("links"))
    classes = components(pairs.where("b IS NOT NULL")).withColumnRenamed("node", "row")
    named = frozen(
        single.drop("width").join(counted, "row", "left").join(classes, "row", "left")
        .withColumn("root", F.coalesce("root", "row"))
    )
    smallest = frozen(named.groupBy("root").agg(F.min("first").alias("component_id")))
    known = frozen(named.join(smallest, "root").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.nullif("component_id", last).alias("component_id"),
    ))
    done = rows.where("fit").join(known, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.where("NOT fit").select(
        "id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")
    )
    return done.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed(
        "id", key
    )
