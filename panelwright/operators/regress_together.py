"""Many fixed-effects models of one panel, fitted from shared aggregates.

Models with the same pair of effects and the same clusters go together.  Rows
are repeated once for each *block*, a set of models that use the same rows; a
block carries all columns of its models.  Every step of a single fit is then
one aggregate keyed by block as well, so the number of jobs does not depend on
the number of models:

1. complete rows per condition and per model, which tells the blocks apart;
2. moments per (block, level of the small effect);
3. means and level counts per (block, large group), and facts per block;
4. the system of the level effects of every block;
5. products per (block, cluster) of the rows with both effects subtracted;
6. products of the cluster scores of all models.

What reaches the driver is bounded by blocks, levels and terms, not by rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.numeric import nan_to_null
from .regress import (
    SMALL_EFFECT_LEVELS, Fit, ModelSpec, _exprs, _join_offsets, _pairs, _split, _square, drop_singletons, estimates, fe_ols,
)

BLOCK = "_block"


@dataclass(frozen=True)
class _Family:
    """Models of one pair of effects, their distinct columns, and the block of each."""

    specs: tuple[ModelSpec, ...]
    columns: tuple[Column, ...]
    used: tuple[tuple[int, ...], ...]  # outcome first, then terms
    conditions: tuple[Column, ...]
    condition: tuple[int, ...]


def _family(specs: Sequence[ModelSpec]) -> _Family:
    """Columns and conditions that are written alike are one."""
    columns: dict[str, int] = {}
    found: list[Column] = []
    conditions: dict[str, int] = {}
    said: list[Column] = []

    def place(column: Column) -> int:
        if repr(column) not in columns:
            columns[repr(column)] = len(found)
            found.append(nan_to_null(column.cast("double")))
        return columns[repr(column)]

    used, condition = [], []
    for spec in specs:
        used.append(tuple(place(c) for c in (F.col(spec.outcome), *[t.column for t in spec.terms])))
        where = F.lit(True) if spec.where is None else spec.where
        if repr(where) not in conditions:
            conditions[repr(where)] = len(said)
            said.append(F.coalesce(where, F.lit(False)))
        condition.append(conditions[repr(where)])
    return _Family(tuple(specs), tuple(found), tuple(used), tuple(said), tuple(condition))


def _complete(columns: Sequence[int]) -> Column:
    return F.expr(" AND ".join(f"_z{i} IS NOT NULL" for i in columns))


def _blocks(rows: DataFrame, family: _Family) -> tuple[list[int], list[tuple[int, list[int]]]]:
    """Block of each model, and (condition, columns) of each block.

    Models of one condition share a block if each is complete on the very rows
    where the columns of all of them are.
    """
    every = {c: sorted({k for u, own in zip(family.used, family.condition) if own == c for k in u}) for c in set(family.condition)}
    counts = rows.agg(
        *[F.count_if(F.col(f"_w{c}") & _complete(every[c])).alias(f"all{c}") for c in every],
        *[F.count_if(F.col(f"_w{c}") & _complete(u)).alias(f"own{m}") for m, (u, c) in enumerate(zip(family.used, family.condition))],
    ).first()
    blocks: dict[tuple[int, tuple[int, ...]], int] = {}
    of_model = []
    for m, (used, c) in enumerate(zip(family.used, family.condition)):
        columns = tuple(every[c]) if counts[f"own{m}"] == counts[f"all{c}"] else tuple(sorted(set(used)))
        of_model.append(blocks.setdefault((c, columns), len(blocks)))
    return of_model, [(c, list(columns)) for c, columns in blocks]


def _level_moments(df: DataFrame, small: str, names: Sequence[str], cluster: str, blocks: int):
    """Moments of each (block, level), or None if the effect has too many levels."""
    rows = df.groupBy(BLOCK, small).agg(
        _split(cluster), *_exprs("count(1) AS _n", *[f"avg({c}) AS _a{c}" for c in names], *[f"var_pop({c}) AS _s{c}" for c in names])
    ).limit(SMALL_EFFECT_LEVELS * blocks + 1).collect()
    values = sorted({row[small] for row in rows})
    if len(rows) > SMALL_EFFECT_LEVELS * blocks or len(values) > SMALL_EFFECT_LEVELS:
        return None
    at = {v: i for i, v in enumerate(values)}
    counts = np.zeros((blocks, len(values)))
    means, variances = np.zeros((2, blocks, len(values), len(names)))
    split = np.zeros(blocks, bool)
    for row in rows:
        place = row[BLOCK], at[row[small]]
        counts[place] = row["_n"]
        means[place] = [row[f"_a{c}"] for c in names]
        variances[place] = [row[f"_s{c}"] for c in names]
        split[row[BLOCK]] |= row["_split"]
    return values, counts, means, variances, split


def _driver_rows(df: DataFrame, rows: list, schema: str) -> DataFrame:
    """Rows that the driver holds anyway, bounded by blocks, levels and terms."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def _fit_family(df: DataFrame, specs: Sequence[ModelSpec], held: list[DataFrame]) -> list[Fit] | None:
    family = _family(specs)
    (first, second), cluster = specs[0].effects, specs[0].cluster
    names = [f"_z{i}" for i in range(len(family.columns))]
    rows = df.select(
        *[F.col(f"`{k}`").alias(new) for k, new in ((first, "_first"), (second, "_second"), (cluster, "_cluster"))],
        *[c.alias(n) for c, n in zip(family.columns, names)], *[c.alias(f"_w{i}") for i, c in enumerate(family.conditions)],
    ).dropna(subset=["_first", "_second", "_cluster"])
    of_model, blocks = _blocks(rows, family)
    member = F.filter(F.array(*[
        F.when(F.col(f"_w{c}") & _complete(columns), F.lit(b)) for b, (c, columns) in enumerate(blocks)
    ]), lambda b: b.isNotNull())
    # A column that no model of a block uses may be missing there; it counts as zero and is not looked at.
    stacked = rows.select("_first", "_second", "_cluster", F.explode(member).alias(BLOCK), *[
        F.coalesce(n, F.lit(0.0)).alias(n) for n in names
    ]).persist(StorageLevel.MEMORY_AND_DISK)
    held.append(stacked)
    for large, small in (("_first", "_second"), ("_second", "_first")):
        moments = _level_moments(stacked, small, names, "_cluster", len(blocks))
        if moments is not None:
            break
    else:
        return None

    for cleaned in (False, True):
        values, counts, means, variances, small_split = moments
        if (counts.sum(axis=1) == 0).any():
            raise ValueError("no complete rows" if not cleaned else "no rows are left once singletons are removed")
        in_level = [f"_n{i}" for i in range(len(values))]
        groups = stacked.groupBy(BLOCK, large).agg(
            _split("_cluster"), *_exprs("count(1) AS _n", *[f"avg({c}) AS _m{c}" for c in names]),
            *[F.count_if(F.col(small) == level).alias(n) for n, level in zip(in_level, values)],
        ).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(groups)
        facts = {row[BLOCK]: row for row in groups.groupBy(BLOCK).agg(*_exprs(
            "count(1) AS n", "count_if(_n = 1) AS lonely", "max(_n) AS largest", "coalesce(bool_or(_split), false) AS split",
        )).collect()}
        if cleaned or (not any(f["lonely"] for f in facts.values()) and (counts != 1).all()):
            break
        keyed = stacked.withColumns({"_u": F.struct(BLOCK, large), "_t": F.struct(BLOCK, small)})
        stacked = drop_singletons(keyed, ["_u", "_t"]).drop("_u", "_t").persist(StorageLevel.MEMORY_AND_DISK)
        held.append(stacked)
        moments = _level_moments(stacked, small, names, "_cluster", len(blocks))

    cells = groups.select(
        BLOCK, "_n", *in_level, *[f"_m{c}" for c in names],
        F.expr(f"posexplode(array({', '.join(in_level)})) AS (_level, _here)"),
    ).where("_here > 0")
    systems = np.array([np.diag(c) for c in counts])
    right = counts[:, :, None] * means
    for row in cells.groupBy(BLOCK, "_level").agg(*_exprs(
        *[f"sum(_here * {c} / _n) AS {c}" for c in in_level], *[f"sum(_here * _m{c}) AS _m{c}" for c in names],
    )).collect():
        systems[row[BLOCK], row["_level"]] -= [row[c] for c in in_level]
        right[row[BLOCK], row["_level"]] -= [row[f"_m{c}"] for c in names]
    effects = np.array([np.linalg.pinv(s, rcond=1e-10, hermitian=True) @ r for s, r in zip(systems, right)])

    by_block = _driver_rows(
        df, [(b, *[effects[b, :, k].tolist() for k in range(len(names))]) for b in range(len(blocks))],
        f"{BLOCK} int, " + ", ".join(f"_e{c} array<double>" for c in names),
    )
    shift = f"aggregate(zip_with(array({', '.join(in_level)}), {{}}, (a, b) -> a * b), 0D, (total, x) -> total + x)"
    offsets = groups.join(by_block, BLOCK).select(
        BLOCK, large, "_n", *_exprs(*[f"_m{c} - {shift.format(f'_e{c}')} / _n AS _g{c}" for c in names])
    )
    by_level = _driver_rows(
        df, [(b, i, *effects[b, i].tolist()) for b in range(len(blocks)) for i in range(len(values))],
        f"{BLOCK} int, _level int, " + ", ".join(f"_l{c} double" for c in names),
    ).join(
        F.broadcast(df.sparkSession.createDataFrame(list(enumerate(values)), ["_level", small])
                    .withColumns({"_level": F.col("_level").cast("int"), small: F.col(small).cast(stacked.schema[small].dataType)})),
        "_level",
    )
    n_obs = counts.sum(axis=1)
    placed = _join_offsets(
        stacked, offsets, [BLOCK, large], sum(f["n"] for f in facts.values()), max(f["largest"] for f in facts.values()), int(n_obs.sum())
    )
    within = placed.join(F.broadcast(by_level), [BLOCK, small]).select(
        BLOCK, "_cluster", *_exprs(*[f"{c} - _g{c} - _l{c} AS {c}" for c in names])
    )
    pairs = sorted({(min(i, j), max(i, j)) for used in family.used for i in used for j in used})
    clusters = within.groupBy(BLOCK, "_cluster").agg(*_exprs(
        *[f"sum(_z{i} * _z{j}) AS p{i}_{j}" for i, j in pairs]
    )).persist(StorageLevel.MEMORY_AND_DISK)
    held.append(clusters)
    totals = {row[BLOCK]: row for row in clusters.groupBy(BLOCK).agg(*_exprs(
        "count(1) AS n", *[f"sum(p{i}_{j}) AS p{i}_{j}" for i, j in pairs]
    )).collect()}

    overall = np.einsum("bl,blk->bk", counts, means) / n_obs[:, None]
    variation = np.einsum("bl,blk->bk", counts, variances + (means - overall[:, None]) ** 2)
    squares = np.einsum("bl,blk->bk", counts, variances + means**2)
    found = []
    for spec, used, b in zip(specs, family.used, of_model):
        total = totals[b]
        products = np.array([[total[f"p{min(i, j)}_{max(i, j)}"] for j in used] for i in used])
        found.append(estimates(
            spec, products, variation[b, list(used)], squares[b, list(used)], int(n_obs[b]), total["n"],
            (facts[b]["n"], int((counts[b] > 0).sum())), (not facts[b]["split"], not small_split[b]),
        ))
    meats = _score_products(clusters, family, of_model, found)
    return [solved.fit(df.sparkSession, meat) for solved, meat in zip(found, meats)]


def _score_products(clusters: DataFrame, family: _Family, of_model: Sequence[int], found: Sequence) -> list[np.ndarray]:
    """For each model, the sum over clusters of the outer product of the cluster's score; one job for all."""
    def product(i: int, j: int) -> str:
        return f"p{min(i, j)}_{max(i, j)}"

    models = []
    for m, (solved, used, b) in enumerate(zip(found, family.used, of_model)):
        kept = [used[k] for k in solved.kept]
        weighted = [" + ".join([f"{-float(w)!r}D * {product(i, j)}" for j, w in zip(kept, solved.beta)] + [product(i, used[0])]) for i in kept]
        models.append(f"CASE WHEN {BLOCK} = {b} THEN array({', '.join(weighted)}) END AS g{m}")
    scores = clusters.select(*_exprs(*models))
    sums = [
        f"sum(g{m}[{a}] * g{m}[{c}]) AS s{m}_{a}_{c}" for m, solved in enumerate(found) for a, c in _pairs(solved.kept)
    ]
    row = scores.agg(*_exprs("count(1)", *sums)).first().asDict()
    return [
        _square({f"g{a}_{c}": row[f"s{m}_{a}_{c}"] for a, c in _pairs(solved.kept)}, solved.kept, "g")
        for m, solved in enumerate(found)
    ]


def fit_together(df: DataFrame, specs: Sequence[ModelSpec]) -> list[Fit]:
    """Fits of several models of one panel, in their order, equal to those of ``fe_ols``.

    Each pair of effects (with its clusters) takes a fixed number of jobs.  A
    pair of which neither effect has few levels is fitted model by model.
    """
    families: dict[tuple, list[int]] = {}
    for i, spec in enumerate(specs):
        families.setdefault((spec.effects, spec.cluster), []).append(i)
    fits: list[Fit | None] = [None] * len(specs)
    for places in families.values():
        held: list[DataFrame] = []
        try:
            own = [specs[i] for i in places]
            for i, fit in zip(places, _fit_family(df, own, held) or [fe_ols(df, spec) for spec in own]):
                fits[i] = fit
        finally:
            for frame in held:
                frame.unpersist()
    return fits
