"""Linear models with two fixed effects and clustered standard errors.

The rows stay distributed.  What reaches the driver is bounded by the model,
not by the data: the levels of the small fixed effect (years), one cross
product matrix, one sandwich matrix.

How a fit runs, for N rows, a large effect (units or countries) and a small
effect with T levels (years):

1. complete rows of outcome, terms, effects and cluster; singletons removed;
2. one aggregate per large-effect group: means and the T level counts;
3. one aggregate per level: sums.  Together with (2) this gives the T x T
   system of the level effects, solved on the driver;
4. rows joined with their group's offset (the only row-level join), both
   effects subtracted, and all products summed *per cluster*;
5. cross products are the sum over clusters; redundant terms are dropped by an
   ordered Cholesky sweep; the coefficients follow; the score of a cluster is
   linear in its products, so the sandwich needs only the cluster table.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.fixed_values import STAR_LEVELS
from ..functions.numeric import nan_to_null
from ..session import BROADCAST_BYTES, BROADCAST_ROWS, broadcast_if_small, discard, frozen
from .distributions import stars, student_t_two_sided
from .quantiles import join_keys_null_safe, quantile_columns

logger = logging.getLogger(__name__)

#: Levels the small fixed effect may have for the plan without rounds.  Both plans solve the same equations; the
#: other one stops when the residual is ITERATION_TOLERANCE of the first one.
SMALL_EFFECT_LEVELS = 200
ITERATION_TOLERANCE = 1e-11

#: Share of all rows above which a group is joined by broadcast in any case.
CROWDED_SHARE = 1 / 1_000

#: A term is redundant when less than this share of its variation is left.
REDUNDANT_SHARE = 1e-10
_ROUNDING_SHARE = 1e-20


@dataclass(frozen=True)
class Term:
    """A regressor: its label and its column."""

    name: str
    column: Column
    order: int = 1


def main(name: str) -> Term:
    return Term(name, F.col(name))


def computed(name: str, column: Column) -> Term:
    return Term(name, column)


def interaction(a: Term, b: Term) -> Term:
    return Term(f"{a.name}:{b.name}", a.column * b.column, a.order + b.order)


def crossed(a: Term, b: Term) -> list[Term]:
    """Both main effects and their interaction."""
    return [a, b, interaction(a, b)]


@dataclass(frozen=True)
class ModelSpec:
    """What to fit: outcome ~ terms | (large effect, small effect), clustered."""

    outcome: str
    terms: tuple[Term, ...]
    effects: tuple[str, str]
    cluster: str
    name: str = "model"
    where: Column | None = None

    def __post_init__(self) -> None:
        # Main effects come before interactions; repeated labels count once.
        unique = {t.name: t for t in self.terms}
        ordered = sorted(unique.values(), key=lambda t: t.order)
        object.__setattr__(self, "terms", tuple(ordered))


@dataclass(frozen=True)
class Fit:
    """Results of one model; ``coefficients`` and ``statistics`` are frames."""

    name: str
    spark: SparkSession = field(repr=False)
    terms: tuple[str, ...]
    estimates: Mapping[str, float]
    std_errors: Mapping[str, float]
    p_values: Mapping[str, float]
    n_obs: int
    n_clusters: int
    r2: float
    adj_r2: float
    within_r2: float

    def coefficients(self) -> DataFrame:
        """One row per term; a dropped term has null numbers."""
        return tidy([self])

    def _coefficient_rows(self) -> list[tuple]:
        rows = []
        for position, term in enumerate(self.terms, 1):
            estimate, error = self.estimates.get(term), self.std_errors.get(term)
            t = estimate / error if estimate is not None and error else None
            rows.append((
                self.name, position, term, estimate, error, t, self.p_values.get(term),
                stars(self.p_values.get(term), STAR_LEVELS), estimate is None,
            ))
        return rows

    def statistics(self) -> DataFrame:
        row = (self.name, self.n_obs, self.n_clusters, self.r2, self.adj_r2, self.within_r2)
        return self.spark.createDataFrame(
            [row],
            "model string, n_obs bigint, n_clusters bigint, r2 double, adj_r2 double, within_r2 double",
        )


def design_matrix(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """Outcome, terms, effects and cluster on complete rows, and nothing else."""
    rows = df if spec.where is None else df.where(spec.where)
    numbers = {spec.outcome: F.col(spec.outcome), **{t.name: t.column for t in spec.terms}}
    keys = list(dict.fromkeys([*spec.effects, spec.cluster]))
    clash = set(numbers) & set(keys)
    if clash:
        raise ValueError(f"used both as a measure and as a key: {sorted(clash)}")
    return rows.select(
        *keys, *[nan_to_null(c.cast("double")).alias(name) for name, c in numbers.items()]
    ).dropna()


def drop_singletons(df: DataFrame, effects: Sequence[str]) -> DataFrame:
    """Remove groups of one row, for every effect, until none is left.

    The rounds run on the table of effect combinations and their sizes, not on
    the rows.  A round writes only the combinations that it removes, and levels
    are counted anew from what all rounds have removed; rows are touched once.
    """
    cells = frozen(df.groupBy(*effects).agg(F.count(F.lit(1)).alias("_n")))
    sizes = {effect: frozen(cells.groupBy(effect).agg(F.sum("_n").alias("_n"))) for effect in effects}
    rounds: list[DataFrame] = []
    while True:
        gone = reduce(DataFrame.unionByName, rounds) if rounds else None
        lonely = None
        for effect in effects:
            left = sizes[effect]
            if gone is not None:
                lost = gone.groupBy(effect).agg(F.sum("_n").alias("_lost"))
                left = join_keys_null_safe(left, lost, [effect], "left").withColumn(
                    "_n", F.col("_n") - F.coalesce("_lost", F.lit(0))
                )
            alone = join_keys_null_safe(cells, left.where("_n = 1").select(effect), [effect], "left_semi")
            lonely = alone if lonely is None else lonely.unionByName(alone)
        if gone is not None:
            lonely = join_keys_null_safe(lonely, gone.select(*effects), effects, "left_anti")
        removed = frozen(lonely.distinct())
        if removed.isEmpty():
            discard(removed, *sizes.values())
            break
        rounds.append(removed)
    if not rounds:
        return df
    removed = reduce(DataFrame.unionByName, rounds).select(*effects)
    return join_keys_null_safe(df, broadcast_if_small(removed), effects, "left_anti")


def demean_one(df: DataFrame, columns: Sequence[str], effect: str, suffix: str = "_within") -> DataFrame:
    """Subtract group means of one effect: aggregate, then join the means back."""
    means = df.groupBy(effect).agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    joined = df.join(broadcast_if_small(means), effect)
    return joined.withColumns(
        {f"{c}{suffix}": F.col(c) - F.col(f"_mean_{c}") for c in columns}
    ).drop(*[f"_mean_{c}" for c in columns])


@dataclass(frozen=True)
class _Within:
    """Rows with both effects subtracted (columns named as before), and group facts."""

    rows: DataFrame
    sizes: tuple[int, int]
    nested: tuple[bool, bool]
    n_obs: int
    variation: np.ndarray
    squares: np.ndarray


@dataclass(frozen=True)
class _Levels:
    """Per level of an effect with few levels: size, means and variances of the columns."""

    values: list
    counts: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    split: bool

    def without_singletons(self) -> bool:
        return bool((self.counts > 1).all())

    @property
    def variation(self) -> np.ndarray:
        """Centred sums of squares over all rows, from level moments."""
        overall = self.counts @ self.means / self.counts.sum()
        return self.counts @ (self.variances + (self.means - overall) ** 2)

    @property
    def squares(self) -> np.ndarray:
        return self.counts @ (self.variances + self.means**2)


def _exprs(*texts: str) -> list[Column]:
    """Columns from SQL text: one call each, where expression trees would take dozens."""
    return [F.expr(text) for text in texts]


def _dot(columns: Sequence[str], weights: Sequence[float]) -> str:
    """SQL: sum of columns times constant weights.

    The weights form one array constant, which generated code refers to by
    position, so that the code is compiled once and not for every fit.
    """
    pairs = f"zip_with(array({', '.join(columns)}), array({', '.join(f'{float(w)!r}D' for w in weights)}), (a, b) -> a * b)"
    return f"aggregate({pairs}, 0D, (total, x) -> total + x)"


def _split(cluster: str) -> Column:
    """Aggregate: whether a group spans several clusters."""
    return F.expr(f"min(`{cluster}`) != max(`{cluster}`) AS _split")


def _levels(df: DataFrame, effect: str, columns: Sequence[str], cluster: str) -> _Levels | None:
    """Moments per level if the effect has few levels, else None; one aggregate."""
    rows = df.groupBy(effect).agg(
        _split(cluster),
        *_exprs("count(1) AS _n", *[f"avg(`{c}`) AS `_a_{c}`" for c in columns],
                *[f"var_pop(`{c}`) AS `_s_{c}`" for c in columns]),
    ).limit(SMALL_EFFECT_LEVELS + 1).collect()
    if len(rows) > SMALL_EFFECT_LEVELS:
        return None
    rows.sort(key=lambda row: row[effect])
    return _Levels(
        [row[effect] for row in rows],
        np.array([row["_n"] for row in rows], dtype=float),
        np.array([[row[f"_a_{c}"] for c in columns] for row in rows]).reshape(len(rows), len(columns)),
        np.array([[row[f"_s_{c}"] for c in columns] for row in rows]).reshape(len(rows), len(columns)),
        any(row["_split"] for row in rows),
    )


def _subtract_both(
    df: DataFrame, columns: Sequence[str], large: str, small: str, cluster: str, levels: _Levels,
    kept_in_memory: list[DataFrame], singletons: bool,
) -> _Within:
    """Exact two-way demeaning where one effect has few levels.

    With ``singletons`` false, groups of one row are removed until none is left.
    """
    for cleaned in (singletons, True):
        counts = [f"_n{i}" for i in range(len(levels.values))]
        groups = df.groupBy(large).agg(
            _split(cluster),
            *_exprs("count(1) AS _n", *[f"avg(`{c}`) AS `_m_{c}`" for c in columns]),
            *[F.count_if(F.col(small) == level).alias(n) for n, level in zip(counts, levels.values)],
        ).persist(StorageLevel.MEMORY_AND_DISK)
        kept_in_memory.append(groups)
        facts = groups.agg(*_exprs(
            "count(1) AS n", "count_if(_n = 1) AS lonely", "max(_n) AS largest",
            "coalesce(bool_or(_split), false) AS split",
        )).first()
        if cleaned or (facts["lonely"] == 0 and levels.without_singletons()):
            break
        df = drop_singletons(df, [large, small])
        levels = _levels(df, small, columns, cluster)
        if not levels.values:
            raise ValueError("no rows are left once singletons are removed")

    # The level effects solve a system with one row per level: level sums over
    # rows minus the same sums over group means.
    cells = groups.select(
        "_n", *counts, *[f"`_m_{c}`" for c in columns],
        F.expr(f"posexplode(array({', '.join(counts)})) AS (_level, _in_level)"),
    ).where("_in_level > 0")
    overlap = cells.groupBy("_level").agg(*_exprs(
        *[f"sum(_in_level * {c} / _n) AS {c}" for c in counts],
        *[f"sum(_in_level * `_m_{c}`) AS `_m_{c}`" for c in columns],
    )).collect()
    system = np.diag(levels.counts)
    right = levels.counts[:, None] * levels.means
    for row in overlap:
        system[row["_level"]] -= [row[c] for c in counts]
        right[row["_level"]] -= [row[f"_m_{c}"] for c in columns]
    effects = np.linalg.pinv(system, rcond=1e-10, hermitian=True) @ right

    offsets = groups.select(f"`{large}`", "_n", *_exprs(*[
        f"`_m_{c}` - {_dot(counts, effects[:, k])} / _n AS `_group_{c}`" for k, c in enumerate(columns)
    ]))
    # At most SMALL_EFFECT_LEVELS rows.
    level_rows = F.broadcast(df.sparkSession.createDataFrame(
        [(level, *map(float, effects[i])) for i, level in enumerate(levels.values)],
        [small, *[f"_level_{c}" for c in columns]],
    ).withColumn(small, F.col(small).cast(df.schema[small].dataType)))
    n_obs = int(levels.counts.sum())
    placed = _join_offsets(df, offsets, large, facts["n"], facts["largest"], n_obs)
    rows = placed.join(level_rows, small).select(*_exprs(*[
        f"`{c}` - `_group_{c}` - `_level_{c}` AS `{c}`" if c in columns else f"`{c}`" for c in df.columns
    ]))
    return _Within(
        rows, (facts["n"], len(levels.values)), (not facts["split"], not levels.split),
        n_obs, levels.variation, levels.squares,
    )


def _join_offsets(
    df: DataFrame, offsets: DataFrame, key: str | list[str], n_groups: int, largest: int, n_rows: int
) -> DataFrame:
    """Bring group offsets (with group size ``_n``) to the rows.

    Few groups are broadcast. Many groups are shuffled, except that groups
    above ``CROWDED_SHARE`` of all rows - there are at most a thousand of them -
    are still broadcast, so their rows never have to meet in one task.
    """
    # A row has the keys and a number per column; its size in memory follows.
    if n_groups <= BROADCAST_ROWS and n_groups * 16 * (len(offsets.columns) + 2) <= 4 * BROADCAST_BYTES:
        return df.join(F.broadcast(offsets.drop("_n")), key)
    limit = n_rows * CROWDED_SHARE
    if largest <= limit:
        return df.join(offsets.drop("_n"), key)
    crowded = F.broadcast(offsets.where(F.col("_n") > limit).drop("_n"))
    ordinary = offsets.where(F.col("_n") <= limit).drop("_n")
    return df.join(crowded, key).unionByName(
        df.join(crowded.select(*([key] if isinstance(key, str) else key)), key, "left_anti").join(ordinary, key)
    )


def _subtract_iterating(df: DataFrame, columns: Sequence[str], effects: Sequence[str], cluster: str) -> _Within:
    """Two large effects: conjugate gradients on the table of effect combinations.

    With the first effect eliminated, the levels v of the second solve
    (D - C' N C) v = r: D holds their sizes, C the rows per combination, N the
    inverse sizes of the first effect's levels.  A round multiplies by that
    matrix in two aggregates over the combinations and takes one reduction for
    all columns; D preconditions.  The rounds end when the residual of every
    column has shrunk by ITERATION_TOLERANCE, or does not shrink any more, as
    rounding may keep it from.  Rows are touched once, at the end.
    """
    first, second = effects
    rows = frozen(df)
    facts = [
        rows.groupBy(effect).agg(_split(cluster)).agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("_split"), F.lit(False)).alias("split")
        ).first()
        for effect in effects
    ]
    if facts[0]["n"] < facts[1]["n"]:  # the smaller one is solved for
        first, second = second, first
    before = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.var_pop(c).alias(f"v_{c}") for c in columns], *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.sum(F.col(c) * F.col(c)).alias(f"s_{c}") for c in columns],
    ).first()
    # Centred columns of unit variance keep rounding small; constants go with the effects anyway.
    spread = {c: before[f"v_{c}"] ** 0.5 or 1.0 for c in columns}
    scaled = rows.select(first, second, *[((F.col(c) - before[f"m_{c}"]) / spread[c]).alias(f"_s{i}") for i, c in enumerate(columns)])
    ks = range(len(columns))
    cells = frozen(scaled.groupBy(first, second).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"_s{k}").alias(f"_s{k}") for k in ks]
    ))
    links = cells.select(first, second, "_n")
    sums = {
        effect: frozen(cells.groupBy(effect).agg(F.sum("_n").alias("_size"), *[F.sum(f"_s{k}").alias(f"_s{k}") for k in ks]))
        for effect in (first, second)
    }

    def spread_out(known: DataFrame, by: str, to: str, value: str, out: str) -> DataFrame:
        """Sum of ``value`` of the levels of ``by`` over the rows of each level of ``to``."""
        return links.join(known, by).groupBy(to).agg(*[F.sum(F.col("_n") * F.col(f"{value}{k}")).alias(f"{out}{k}") for k in ks])

    def multiplied(state: DataFrame, value: str, out: str) -> DataFrame:
        """``state`` with the matrix times its column ``value``."""
        met = spread_out(state.select(second, *[f"{value}{k}" for k in ks]), second, first, value, "_met")
        mean = met.join(sums[first].select(first, "_size"), first).select(first, *[(F.col(f"_met{k}") / F.col("_size")).alias(f"_met{k}") for k in ks])
        back = spread_out(mean, first, second, "_met", "_back")
        return state.join(back, second).withColumns(
            {f"{out}{k}": F.col("_size") * F.col(f"{value}{k}") - F.col(f"_back{k}") for k in ks}
        ).drop(*[f"_back{k}" for k in ks])

    means = sums[first].select(first, *[(F.col(f"_s{k}") / F.col("_size")).alias(f"_m{k}") for k in ks])
    state = sums[second].join(spread_out(means, first, second, "_m", "_t"), second).select(
        second, "_size", *[(F.col(f"_s{k}") - F.col(f"_t{k}")).alias(f"_r{k}") for k in ks],
        *[F.lit(0.0).alias(f"{name}{k}") for k in ks for name in ("_v", "_p", "_q")],
    )
    start, least, idle, old = None, float("inf"), 0, None
    best = state
    for rounds in count():
        # z: preconditioned residual, w: the matrix times z; p and q: direction and the matrix times it.
        state = frozen(multiplied(state.withColumns({f"_z{k}": F.col(f"_r{k}") / F.col("_size") for k in ks}), "_z", "_w"))
        row = state.agg(
            *[F.sum(F.col(f"_r{k}") * F.col(f"_z{k}")).alias(f"rz{k}") for k in ks],
            *[F.sum(F.col(f"_w{k}") * F.col(f"_z{k}")).alias(f"wz{k}") for k in ks],
        ).first()
        rz = np.array([row[f"rz{k}"] or 0.0 for k in ks])
        wz = np.array([row[f"wz{k}"] or 0.0 for k in ks])
        start = np.maximum(rz, 0) if start is None else start
        left = float(np.sqrt(np.max(np.where(start > 0, rz / np.where(start > 0, start, 1), 0))))
        discard(best)
        best, least, idle = (state, left, 0) if left < least else (state, least, idle + 1)
        if left <= ITERATION_TOLERANCE or idle >= 5:
            break
        live = (rz > ITERATION_TOLERANCE**2 * 1e-2 * start) & (wz > 0)
        beta = np.zeros(len(ks)) if old is None else np.where(live & (old[0] > 0), rz / np.where(old[0] > 0, old[0], 1), 0.0)
        bent = wz if old is None else wz - beta * rz / np.where(old[1] != 0, old[1], 1)
        alpha = np.where(live & (bent > 0), rz / np.where(bent > 0, bent, 1), 0.0)
        old = rz, alpha
        step = state.withColumns({
            name: F.col(f"{from_}{k}") + float(beta[k]) * F.col(name)
            for k in ks for name, from_ in ((f"_p{k}", "_z"), (f"_q{k}", "_w"))
        })
        state = step.withColumns({
            f"{name}{k}": F.col(f"{name}{k}") + float(sign * alpha[k]) * F.col(f"{by}{k}")
            for k in ks for name, by, sign in (("_v", "_p", 1), ("_r", "_q", -1))
        }).select(second, "_size", *[f"{name}{k}" for k in ks for name in ("_r", "_v", "_p", "_q")])
    logger.debug("%s: %d rounds, residual %.1e of the first", df.columns, rounds, left)
    theirs = best.select(second, *[F.col(f"_v{k}") for k in ks])
    ours = spread_out(theirs, second, first, "_v", "_t").join(sums[first], first).select(
        first, *[((F.col(f"_s{k}") - F.col(f"_t{k}")) / F.col("_size")).alias(f"_u{k}") for k in ks]
    )
    within = rows.join(ours, first).join(theirs, second).select(*[
        (F.col(c) - before[f"m_{c}"] - spread[c] * (F.col(f"_u{columns.index(c)}") + F.col(f"_v{columns.index(c)}"))).alias(c)
        if c in columns else F.col(c)
        for c in df.columns
    ])
    return _Within(
        within, tuple(f["n"] for f in facts), tuple(not f["split"] for f in facts), before["n"],
        np.array([before[f"v_{c}"] * before["n"] for c in columns]),
        np.array([before[f"s_{c}"] for c in columns]),
    )


def _within(
    df: DataFrame, columns: Sequence[str], effects: Sequence[str], cluster: str,
    kept_in_memory: list[DataFrame], singletons: bool,
) -> _Within:
    """Subtract both effects, by the exact plan whenever one effect has few levels."""
    first, second = effects
    for large, small in ((first, second), (second, first)):
        levels = _levels(df, small, columns, cluster)
        if levels is not None:
            if not levels.values:
                raise ValueError("no complete rows")
            return _subtract_both(df, columns, large, small, cluster, levels, kept_in_memory, singletons)
    rows = df if singletons else drop_singletons(df, effects)
    return _subtract_iterating(rows, list(columns), effects, cluster)


def demean_fixed_effects(df: DataFrame, columns: Sequence[str], effects: Sequence[str]) -> DataFrame:
    """The columns with the group means of one or two fixed effects removed."""
    if len(effects) == 1:
        return demean_one(df, columns, effects[0], suffix="").select(*df.columns)
    return _within(df, columns, effects, effects[0], [], singletons=True).rows.select(*df.columns)


def independent_terms(
    products: np.ndarray, variation: np.ndarray, squares: np.ndarray
) -> list[int]:
    """Positions of the terms to keep, earlier terms first.

    ``products`` are the cross products after demeaning, ``variation`` and
    ``squares`` the centred and plain sums of squares before.
    """
    kept: list[int] = []
    factor: list[np.ndarray] = []
    for k in range(len(products)):
        row = np.array([])
        for i, earlier in enumerate(kept):
            step = (products[k, earlier] - row @ factor[i][:i]) / factor[i][i]
            row = np.append(row, step)
        left = products[k, k] - row @ row
        if left > max(REDUNDANT_SHARE * variation[k], _ROUNDING_SHARE * squares[k]):
            kept.append(k)
            factor.append(np.append(row, np.sqrt(left)))
    return kept


def _pairs(names: Sequence[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(names)) for j in range(i, len(names))]


def _square(row, names: Sequence[str], prefix: str) -> np.ndarray:
    matrix = np.zeros((len(names), len(names)))
    for i, j in _pairs(names):
        matrix[i, j] = matrix[j, i] = row[f"{prefix}{i}_{j}"] or 0.0
    return matrix


def fe_ols(df: DataFrame, spec: ModelSpec) -> Fit:
    """Fit one model."""
    design = design_matrix(df, spec).persist(StorageLevel.MEMORY_AND_DISK)
    kept_in_memory = [design]
    try:
        return _fit(design, spec, kept_in_memory)
    finally:
        for frame in kept_in_memory:
            frame.unpersist()


def _fit(design: DataFrame, spec: ModelSpec, kept_in_memory: list[DataFrame]) -> Fit:
    source = [spec.outcome, *[t.name for t in spec.terms]]
    # Plain internal names: term labels may hold characters SQL would parse.
    names = [f"_z{i}" for i in range(len(source))]
    keys = list(dict.fromkeys([*spec.effects, spec.cluster]))
    rows = design.select(*keys, *[F.col(f"`{old}`").alias(new) for old, new in zip(source, names)])
    within = _within(rows, names, spec.effects, spec.cluster, kept_in_memory, singletons=False)

    clusters = within.rows.groupBy(spec.cluster).agg(*_exprs(*[
        f"sum({names[i]} * {names[j]}) AS p{i}_{j}" for i, j in _pairs(names)
    ])).persist(StorageLevel.MEMORY_AND_DISK)
    kept_in_memory.append(clusters)
    total = clusters.agg(*_exprs(
        "count(1) AS n", *[f"sum(p{i}_{j}) AS p{i}_{j}" for i, j in _pairs(names)]
    )).first()
    n, n_clusters, products = within.n_obs, total["n"], _square(total, names, "p")
    solved = estimates(
        spec, products, within.variation, within.squares, n, int(n_clusters), within.sizes, within.nested
    )
    return solved.fit(design.sparkSession, _score_products(clusters, solved.kept, solved.beta) if solved.kept else solved.bread)


@dataclass(frozen=True)
class Solved:
    """Coefficients of one model, before its standard errors are known."""

    spec: ModelSpec
    kept: list[int]
    beta: np.ndarray
    bread: np.ndarray
    factor: float
    n_obs: int
    n_clusters: int
    fits: tuple[float, float, float]

    def fit(self, spark: SparkSession, meat: np.ndarray) -> Fit:
        """The results, with ``meat``, the sum over clusters of the outer products of their scores."""
        errors = np.sqrt(np.maximum(np.diag(self.bread @ meat @ self.bread) * self.factor, 0.0))
        terms = tuple(t.name for t in self.spec.terms)
        labels = [terms[k - 1] for k in self.kept]
        found = {label: float(b) for label, b in zip(labels, self.beta)}
        std_errors = {label: float(e) for label, e in zip(labels, errors)}
        p_values = {
            label: student_t_two_sided(found[label] / std_errors[label], self.n_clusters - 1)
            for label in labels if std_errors[label] > 0
        }
        return Fit(
            self.spec.name, spark, terms, found, std_errors, p_values, self.n_obs, self.n_clusters, *self.fits
        )


def estimates(
    spec: ModelSpec, products: np.ndarray, variation: np.ndarray, squares: np.ndarray, n: int, n_clusters: int,
    sizes: tuple[int, int], nested: tuple[bool, bool],
) -> Solved:
    """Coefficients from the cross products of the demeaned outcome (first) and terms.

    ``variation`` and ``squares`` are sums of squares before demeaning, centred
    and plain; ``sizes`` are levels of the effects, ``nested`` whether they lie
    inside clusters.
    """
    kept = [k + 1 for k in independent_terms(products[1:, 1:], variation[1:], squares[1:])]
    inner = products[np.ix_(kept, kept)]
    bread = np.linalg.inv(inner) if kept else inner
    beta = bread @ products[kept, 0]
    # Parameters: slopes and all effect levels; for the small-sample factor the
    # levels of an effect nested in the clusters are left out.
    parameters = len(kept) + sum(sizes) - 1
    counted = parameters - sum(size - 1 for size, inside in zip(sizes, nested) if inside)
    factor = 1.0
    if n_clusters > 1 and n > counted:
        factor = n_clusters / (n_clusters - 1) * (n - 1) / (n - counted)
    residual = products[0, 0] - beta @ products[kept, 0]
    r2 = 1 - residual / variation[0] if variation[0] > 0 else float("nan")
    within_r2 = 1 - residual / products[0, 0] if products[0, 0] > 0 else float("nan")
    adj_r2 = 1 - (1 - r2) * (n - 1) / (n - parameters) if n > parameters else float("nan")
    return Solved(spec, kept, beta, bread, factor, n, n_clusters, (float(r2), float(adj_r2), float(within_r2)))


def _score_products(clusters: DataFrame, kept: Sequence[int], beta: np.ndarray) -> np.ndarray:
    """Sum over clusters of the outer product of each cluster's score."""
    def product(i: int, j: int) -> str:
        return f"p{min(i, j)}_{max(i, j)}"

    scores = clusters.select(*_exprs(*[
        f"{product(0, i)} - {_dot([product(i, j) for j in kept], beta)} AS g{a}" for a, i in enumerate(kept)
    ]))
    outer = scores.agg(*_exprs(*[f"sum(g{a} * g{b}) AS g{a}_{b}" for a, b in _pairs(kept)])).first()
    return _square(outer, kept, "g")


def drop_collinear(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """Which terms a fit keeps and which it drops as redundant."""
    return fe_ols(df, spec).coefficients().select("term", "position", "dropped")


def cluster_se(df: DataFrame, spec: ModelSpec) -> DataFrame:
    fit = fe_ols(df, spec)
    return fit.coefficients().select("term", "std_error").withColumn("n_clusters", F.lit(fit.n_clusters))


def fit_statistics(df: DataFrame, spec: ModelSpec) -> DataFrame:
    return fe_ols(df, spec).statistics()


def subsample_fit(
    df: DataFrame, spec: ModelSpec, where: Column | None = None, units: DataFrame | None = None,
    unit: str | None = None,
) -> Fit:
    """Fit on the rows meeting a condition, and/or on a computed set of units."""
    rows = df if where is None else df.where(where)
    if units is not None:
        rows = rows.join(units.select(unit).distinct(), unit, "left_semi")
    return fe_ols(rows, spec)


def model_grid(
    df: DataFrame, spec: ModelSpec, outcomes: Sequence[str], subsets: Mapping[str, Column]
) -> list[Fit]:
    """One specification over outcomes x subsets of the same panel; the number of jobs does not grow with them."""
    return fit_all(df, [
        replace(spec, outcome=outcome, where=condition, name=f"{outcome}_{label}")
        for outcome in outcomes
        for label, condition in subsets.items()
    ])


def fit_all(df: DataFrame, specs: Sequence[ModelSpec]) -> list[Fit]:
    """Fit several models of one panel from shared aggregates; see :mod:`.regress_together`."""
    from .regress_together import fit_together

    return fit_together(df, specs)


def tidy(fits: Sequence[Fit]) -> DataFrame:
    """Coefficients of several models, stacked."""
    return fits[0].spark.createDataFrame(
        [row for fit in fits for row in fit._coefficient_rows()],
        "model string, position int, term string, estimate double, std_error double, "
        "t_value double, p_value double, stars string, dropped boolean",
    )


def regression_table(fits: Sequence[Fit], labels: Mapping[str, str]) -> DataFrame:
    """Models side by side: labelled terms in order, then N, R2 and adjusted R2.

    Each term takes two rows, the estimate with its stars and the standard
    error in parentheses; a term a model lacks or dropped is blank.
    """
    spark = fits[0].spark
    wanted = spark.createDataFrame(
        [(i, term, label) for i, (term, label) in enumerate(labels.items(), 1)],
        "row int, term string, label string",
    )
    cells = tidy(fits).join(F.broadcast(wanted), "term").where(~F.col("dropped"))
    lines = cells.select(
        "model", "row", "label",
        F.inline(F.array(
            F.struct(
                F.lit(1).alias("line"),
                F.concat(F.format_string("%.3f", "estimate"), "stars").alias("cell"),
            ),
            F.struct(F.lit(2).alias("line"), F.format_string("(%.3f)", "std_error").alias("cell")),
        )),
    )
    figures = reduce(DataFrame.unionByName, [fit.statistics() for fit in fits]).select(
        "model", F.inline(F.array(*[
            F.struct(
                F.lit(len(labels) + i).alias("row"), F.lit(label).alias("label"),
                F.lit(1).alias("line"), F.format_string(form, name).alias("cell"),
            )
            for i, (label, form, name) in enumerate(
                [("Num.Obs.", "%d", "n_obs"), ("R2", "%.3f", "r2"), ("R2 Adj.", "%.3f", "adj_r2")], 1
            )
        ])),
    )
    models = [fit.name for fit in fits]
    table = lines.unionByName(figures).groupBy("row", "label", "line").pivot("model", models).agg(
        F.first("cell")
    )
    return table.na.fill("", models).orderBy("row", "line")


def marginal_effects(
    fit: Fit, df: DataFrame, own: str, interaction_term: str, moderator: str, probs: Sequence[float]
) -> DataFrame:
    """Effect of a term at quantiles of the variable it interacts with."""
    names = {f"q{i}": p for i, p in enumerate(probs)}
    wide = quantile_columns(df, moderator, names)
    rows = wide.select(F.inline(F.array(*[
        F.struct(F.lit(float(p)).alias("prob"), F.col(n).alias("moderator")) for n, p in names.items()
    ])))
    slope = F.lit(fit.estimates[own]) + F.lit(fit.estimates[interaction_term]) * F.col("moderator")
    return rows.withColumn("effect", slope)
