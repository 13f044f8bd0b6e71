"""Fits that leave out one group of the large effect's levels each, from one pass over the rows.

Once the large effect is removed, cross products of the columns and of the
small effect's dummies add up over its levels, so over groups of them too.  A
fit without a group takes the products of all rows less those of the group and
removes the small effect on what is left.  Products are kept per cluster and
group; scores of the clusters are linear in them, so one more pass over that
table gives the standard errors of all fits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import nan_to_null
from ..session import discard, frozen
from .regress import SMALL_EFFECT_LEVELS, Fit, ModelSpec, Solved, _pairs, drop_singletons, estimates, fe_ols

#: Groups that may be left out in turn, and (cluster, group) pairs a task adds up before it sends them on.
MOST_GROUPS, HELD = 1_000, 2_000


def _add(sums: dict, key: tuple, values: np.ndarray) -> None:
    if key in sums:
        sums[key] += values
    else:
        sums[key] = values.copy()


def _sent(sums: dict, names: Sequence[str], like: pa.Schema) -> pa.RecordBatch:
    """The sums as rows, keys of the types they came with."""
    columns = [pa.array(c, like.field(n).type) for n, c in zip(names, zip(*sums))]
    return pa.RecordBatch.from_arrays([*columns, pa.array([v.tobytes() for v in sums.values()], pa.binary())], [*names, "sums"])


def _per_unit(batches: Iterator[pa.RecordBatch], k: int, levels: int) -> Iterator[pa.RecordBatch]:
    """Sums of (cluster, group): products with the large effect removed, rows per level, units, sums and squares.

    Rows are (large, level) cells in the order of the large effect.
    """
    pairs, size = _pairs(range(k)), k + levels
    sums: dict = {}
    unit, key, facts = None, None, None
    counts, means = np.zeros(levels), np.zeros((levels, k))

    def close() -> None:
        n = counts.sum()
        total = counts @ means
        mean = total / n
        gram = np.zeros((size, size))
        for (i, j), value in zip(pairs, facts):
            gram[i, j] = gram[j, i] = value
        gram[:k, k:] = (counts[:, None] * (means - mean)).T
        gram[k:, :k] = gram[:k, k:].T
        gram[k:, k:] = np.diag(counts) - np.outer(counts, counts) / n
        squares = np.diag(gram)[:k] + n * mean**2
        _add(sums, key, np.concatenate([gram.reshape(-1), counts, [1.0], total, squares]))

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("unit", "cluster", "part", "level", "n", "means", "products")]
        for own, cluster, part, level, n, mean, products in zip(*columns):
            if own != unit:
                if unit is not None:
                    close()
                    counts[:], means[:] = 0, 0
                unit, key, facts = own, (cluster, part), products
            counts[level], means[level] = n, mean
        if len(sums) >= HELD:
            yield _sent(sums, ("cluster", "part"), batch.schema)
            sums.clear()
    if unit is not None:
        close()
    if sums:
        yield _sent(sums, ("cluster", "part"), batch.schema)


def _combined(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal keys."""
    sums: dict = {}
    for batch in batches:
        for *key, blob in zip(*(batch.column(c).to_pylist() for c in (*names, "sums"))):
            key = tuple(key)
            if sums and key not in sums:
                yield _sent(sums, names, batch.schema)
                sums.clear()
            _add(sums, key, np.frombuffer(blob))
    if sums:
        yield _sent(sums, names, batch.schema)


def _added(rows: DataFrame, names: list[str], schema: str) -> DataFrame:
    """Sums per key; partial sums are formed before the shuffle."""
    partly = rows.sortWithinPartitions(*names).mapInArrow(partial(_combined, names=names), schema)
    return partly.repartition(*names).sortWithinPartitions(*names).mapInArrow(partial(_combined, names=names), schema)


def _scores(batches: Iterator[pa.RecordBatch], size: int, without: list, left: list[np.ndarray], right: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums over clusters of the outer products of their scores, for every fit; rows come in the order of clusters."""
    meats = [np.zeros((a.shape[1],) * 2) for a in left]
    place = {value: i for i, value in enumerate(without)}
    cluster, total, own = None, np.zeros((size, size)), {}

    def close() -> None:
        products = total @ right
        for f, a in enumerate(left):
            score = a.T @ (products[:, f] - (own[f] @ right[:, f] if f in own else 0))
            meats[f] += np.outer(score, score)

    for batch in batches:
        for this, part, blob in zip(*(batch.column(c).to_pylist() for c in ("cluster", "part", "sums"))):
            if this != cluster:
                if cluster is not None:
                    close()
                    total[:] = 0
                    own.clear()
                cluster = this
            gram = np.frombuffer(blob)[: size * size].reshape(size, size)
            total += gram
            if part in place:
                own[place[part]] = gram
    if cluster is not None:
        close()
        rows = [(f, i, float(v)) for f, meat in enumerate(meats) for i, v in enumerate(meat.reshape(-1))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.float64()))], ["fit", "place", "value"]
        )


def leave_out_fits(df: DataFrame, spec: ModelSpec, group: str, left_out: Sequence | None = None) -> dict:
    """For each value of ``group`` the fit without its rows, equal to ``fe_ols`` on the others.

    ``left_out`` names the values, by default all (at most MOST_GROUPS).  Rows
    without a group stay in every fit.  Each level of the large effect, the
    first of the spec's, must lie in one group and one cluster, and the other
    effect must have few levels; if not, use ``fe_ols`` on filtered rows.  Where
    leaving a group out leaves a level of the small effect with a single row,
    that fit is made on the filtered rows, as singletons must go there.
    """
    unit, level = spec.effects
    rows = df if spec.where is None else df.where(spec.where)
    columns = [F.col(spec.outcome), *[t.column for t in spec.terms]]
    k = len(columns)
    names = [f"_z{i}" for i in range(k)]
    rows = frozen(rows.select(
        F.col(unit).alias("unit"), F.col(level).alias("small"), F.col(spec.cluster).alias("cluster"), F.col(group).alias("part"),
        *[nan_to_null(c.cast("double")).alias(n) for c, n in zip(columns, names)],
    ).dropna(subset=["unit", "small", "cluster", *names]))
    kept = frozen(drop_singletons(rows, ["unit", "small"]))
    centre = kept.agg(*[F.avg(n) for n in names]).first()
    if centre[0] is None:
        raise ValueError("no complete rows")
    kept = kept.withColumns({n: F.col(n) - c for n, c in zip(names, centre)})
    values = sorted(r[0] for r in kept.select("small").distinct().limit(SMALL_EFFECT_LEVELS + 1).collect())
    if len(values) > SMALL_EFFECT_LEVELS:
        raise ValueError(f"{level} has more than {SMALL_EFFECT_LEVELS} levels")
    groups = [r[0] for r in kept.select("part").distinct().where("part IS NOT NULL").limit(MOST_GROUPS + 1).collect()]
    if left_out is None and len(groups) > MOST_GROUPS:
        raise ValueError(f"{group} has more than {MOST_GROUPS} values; name those to leave out")
    without = sorted(groups) if left_out is None else list(left_out)

    # At most SMALL_EFFECT_LEVELS rows.
    numbered = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(values)), ["level", "small"]).select(
        F.col("level").cast("int"), F.col("small").cast(kept.schema["small"].dataType)
    ))
    count = F.count(F.lit(1))
    units = kept.groupBy("unit").agg(
        F.min("cluster").alias("cluster"), F.min("part").alias("part"),
        F.array(*[F.covar_pop(names[i], names[j]) * count for i, j in _pairs(range(k))]).alias("products"),
        ((F.min("cluster") != F.max("cluster")) | ~F.min("part").eqNullSafe(F.max("part"))
         | ~F.count("part").isin(F.lit(0), count)).alias("split"),
    )
    if not units.where("split").isEmpty():
        raise ValueError(f"a level of {unit} lies in several groups or clusters")
    cells = kept.groupBy("unit", "small").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(n) for n in names]).alias("means")
    ).join(numbered, "small").join(units.drop("split"), "unit")
    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("cluster", "part")}
    schema = f"cluster {kinds['cluster']}, part {kinds['part']}, sums binary"
    partly = cells.repartition("unit").sortWithinPartitions("unit").mapInArrow(partial(_per_unit, k=k, levels=len(values)), schema)
    table = frozen(_added(partly, ["cluster", "part"], schema))

    # One row per group reaches the driver.
    size, levels = k + len(values), len(values)
    by_group = _added(table.select(
        F.when(F.col("part").isin(without), F.col("part")).alias("part"), "sums"
    ), ["part"], f"part {kinds['part']}, sums binary")
    sums = {r["part"]: np.frombuffer(r["sums"]) for r in by_group.collect()}
    whole = sum(sums.values())
    alone = table.groupBy("cluster").agg(F.min("part").alias("part"), count.alias("n"))
    counted = {r["part"]: r["n"] for r in alone.groupBy(F.when(F.col("n") == 1, F.col("part")).alias("part")).agg(count.alias("n")).collect()}
    n_clusters = sum(counted.values())
    outside = [F.when(~F.col("part").eqNullSafe(F.lit(v)), F.col("cluster")) for v in without]
    spans = cells.groupBy("level").agg(*[(F.min(c) != F.max(c)).alias(f"_f{f}") for f, c in enumerate(outside)]).collect()

    solved: list[Solved | None] = []
    left, right = [], np.zeros((size, len(without)))
    for f, value in enumerate(without):
        rest = whole - sums.get(value, 0)
        gram, counts = rest[: size * size].reshape(size, size), np.rint(rest[size * size : size * size + levels])
        n_units, total, squares = rest[size * size + levels], rest[-2 * k : -k], rest[-k:]
        n = int(counts.sum())
        if n == 0 or (counts == 1).any():
            solved.append(None)
            left.append(np.zeros((size, 0)))
            continue
        by_level = np.linalg.pinv(gram[k:, k:], rcond=1e-10, hermitian=True) @ gram[k:, :k]
        products = gram[:k, :k] - gram[:k, k:] @ by_level
        fit = estimates(
            replace(spec, name=f"without {value}"), products, squares - total**2 / n, squares, n, n_clusters - counted.get(value, 0),
            (int(round(n_units)), int((counts > 0).sum())), (True, not any(row[f"_f{f}"] for row in spans)),
        )
        solved.append(fit)
        unit_columns = np.eye(size)[:, fit.kept]
        unit_columns[k:] = -by_level[:, fit.kept]
        left.append(unit_columns)
        right[0, f] = 1.0
        right[fit.kept, f] = -fit.beta
        right[k:, f] = -(by_level[:, 0] - by_level[:, fit.kept] @ fit.beta)
    meats = table.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(
        partial(_scores, size=size, without=without, left=left, right=right), "fit int, place int, value double"
    ).groupBy("fit", "place").agg(F.sum("value").alias("value")).collect()
    found = {(r["fit"], r["place"]): r["value"] for r in meats}
    fits: dict = {}
    for f, (value, fit) in enumerate(zip(without, solved)):
        if fit is None:
            fits[value] = fe_ols(df.where(~F.col(group).eqNullSafe(F.lit(value))), replace(spec, name=f"without {value}"))
        else:
            q = len(fit.kept)
            fits[value] = fit.fit(df.sparkSession, np.array([found.get((f, i), 0.0) for i in range(q * q)]).reshape(q, q))
    discard(rows, table)
    return fits


def leave_units_out(df: DataFrame, spec: ModelSpec, units: DataFrame) -> Fit:
    """The fit without some levels of the large effect, such as units that never change."""
    unit = spec.effects[0]
    marked = units.select(unit).distinct().withColumn("_out", F.lit(1))
    return leave_out_fits(df.join(marked, unit, "left"), spec, "_out", [1])[1]
