"""Fixed-effects fits against a dense dummy regression in numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import distributions, regress
from panelwright.operators.regress import ModelSpec, computed, crossed, interaction, main
from panelwright.session import frozen


def dense_fit(data, y, terms, effects, cluster):
    """Explicit dummies, least squares, clustered sandwich."""
    data = data.dropna(subset=[y, *terms, *effects, cluster]).copy()
    while True:
        keep = np.ones(len(data), bool)
        for e in effects:
            keep &= (data.groupby(e)[e].transform("size") > 1).to_numpy()
        if keep.all():
            break
        data = data[keep]
    dummies = [pd.get_dummies(data[e], dtype=float) for e in effects]
    full = np.hstack([d.to_numpy() if i == 0 else d.to_numpy()[:, 1:] for i, d in enumerate(dummies)])
    hat = full @ np.linalg.pinv(full)
    within = {c: data[c].to_numpy(float) - hat @ data[c].to_numpy(float) for c in [y, *terms]}
    x = np.column_stack([within[t] for t in terms])
    bread = np.linalg.inv(x.T @ x)
    beta = bread @ x.T @ within[y]
    e = within[y] - x @ beta
    scores = pd.DataFrame(x * e[:, None]).groupby(data[cluster].to_numpy()).sum().to_numpy()
    n, g = len(data), len(scores)
    sizes = [data[e].nunique() for e in effects]
    nested = [(data.groupby(e)[cluster].nunique() == 1).all() for e in effects]
    parameters = len(terms) + sum(sizes) - 1
    counted = parameters - sum(s - 1 for s, inside in zip(sizes, nested) if inside)
    factor = g / (g - 1) * (n - 1) / (n - counted)
    se = np.sqrt(np.diag(bread @ (scores.T @ scores) @ bread) * factor)
    tss = ((data[y] - data[y].mean()) ** 2).sum()
    r2 = 1 - (e @ e) / tss
    return dict(
        beta=beta, se=se, n=n, clusters=g, r2=r2, adj=1 - (1 - r2) * (n - 1) / (n - parameters),
        within=1 - (e @ e) / (within[y] @ within[y]),
    )


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    unit = np.concatenate([np.repeat(1, 150), rng.integers(2, 70, 330), [900, 901]])
    data = pd.DataFrame({"unit": unit, "year": rng.integers(2005, 2016, len(unit))})
    data.loc[data.index[-1], "year"] = 2040
    data["country"] = data["unit"] % 6
    data["firm"] = data["unit"] % 23
    for name in ("a", "b"):
        data[name] = rng.normal(size=len(data)) + data["unit"] % 5
    data["ab"] = data["a"] * data["b"]
    data["y"] = 2 * data["a"] - data["b"] + data["unit"] % 7 + (data["year"] - 2000) * 0.3 + rng.normal(size=len(data))
    data.loc[rng.choice(len(data), 20, replace=False), "b"] = np.nan
    data["ab"] = data["a"] * data["b"]
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in data.astype(object).itertuples(index=False)]
    df = spark.createDataFrame(
        rows, "unit int, year int, country int, firm int, a double, b double, ab double, y double"
    )
    return df, data


def check(fit, want, terms):
    assert fit.n_obs == want["n"] and fit.n_clusters == want["clusters"]
    for i, term in enumerate(terms):
        assert fit.estimates[term] == pytest.approx(want["beta"][i], rel=1e-7)
        assert fit.std_errors[term] == pytest.approx(want["se"][i], rel=1e-7)
    assert fit.r2 == pytest.approx(want["r2"], rel=1e-8)
    assert fit.adj_r2 == pytest.approx(want["adj"], rel=1e-8)
    assert fit.within_r2 == pytest.approx(want["within"], rel=1e-7)


@pytest.mark.parametrize("effects", [("unit", "year"), ("country", "year"), ("year", "unit")])
def test_unbalanced_fit(panel, effects):
    df, data = panel
    terms = crossed(main("a"), main("b"))
    fit = regress.fe_ols(df, ModelSpec("y", tuple(terms), effects, "firm"))
    check(fit, dense_fit(data, "y", ["a", "b", "ab"], list(effects), "firm"), ["a", "b", "a:b"])


@pytest.mark.parametrize("share", [0.0, 0.1, 1.0])
def test_many_groups_use_the_split_join(panel, monkeypatch, share):
    df, data = panel
    monkeypatch.setattr(regress, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(regress, "CROWDED_SHARE", share)
    fit = regress.fe_ols(df, ModelSpec("y", (main("a"), main("b")), ("unit", "year"), "firm"))
    check(fit, dense_fit(data, "y", ["a", "b"], ["unit", "year"], "firm"), ["a", "b"])


def test_two_large_effects_converge_to_the_same_fit(panel, monkeypatch):
    df, data = panel
    monkeypatch.setattr(regress, "SMALL_EFFECT_LEVELS", 3)
    fit = regress.fe_ols(df, ModelSpec("y", (main("a"),), ("country", "year"), "firm"))
    want = dense_fit(data, "y", ["a"], ["country", "year"], "firm")
    assert fit.n_obs == want["n"]
    assert fit.estimates["a"] == pytest.approx(want["beta"][0], rel=1e-6)
    assert fit.std_errors["a"] == pytest.approx(want["se"][0], rel=1e-6)


def test_badly_connected_panel_of_two_large_effects(spark, monkeypatch, caplog):
    # Three blocks of units and codes, each joined to the next by a single row: plain alternation takes thousands of rounds.
    rng = np.random.default_rng(2)
    rows = []
    for block in range(3):
        unit, code = rng.integers(0, 40, 500) + 40 * block, rng.integers(0, 15, 500) + 15 * block
        rows += list(zip(unit.tolist(), code.tolist()))
        rows.append((40 * block, (15 * block + 15) % 45))
    data = pd.DataFrame(rows, columns=["unit", "code"])
    data["firm"] = data["unit"] % 17
    data["a"] = rng.normal(size=len(data)) + data["unit"] // 40 + 1e4
    data["y"] = 3 * data["a"] + data["unit"] % 9 + data["code"] // 15 * 50 + rng.normal(size=len(data))
    monkeypatch.setattr(regress, "SMALL_EFFECT_LEVELS", 3)
    caplog.set_level("DEBUG", logger=regress.__name__)
    df = spark.createDataFrame(data)
    fit = regress.fe_ols(df, ModelSpec("y", (main("a"),), ("unit", "code"), "firm"))
    check(fit, dense_fit(data, "y", ["a"], ["unit", "code"], "firm"), ["a"])
    assert max(r.args[1] for r in caplog.records) <= 50


def test_columns_that_the_effects_explain(spark, monkeypatch):
    monkeypatch.setattr(regress, "SMALL_EFFECT_LEVELS", 1)
    rows = [(u, t, float(u + t), 7.0, float((u * t) % 5)) for u in range(9) for t in range(6)]
    df = spark.createDataFrame(rows, "u int, t int, explained double, fixed double, x double")
    out = regress.demean_fixed_effects(df, ["explained", "fixed", "x"], ["u", "t"]).toPandas()
    assert out["explained"].abs().max() < 1e-9 and out["fixed"].abs().max() < 1e-9
    x = np.array([[(u * t) % 5 for t in range(6)] for u in range(9)], float)
    want = x - x.mean(1, keepdims=True) - x.mean(0) + x.mean()
    got = out.sort_values(["u", "t"])["x"].to_numpy().reshape(9, 6)
    assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("effects", [("unit", "year"), ("country", "year")])
def test_models_fitted_together_equal_models_fitted_alone(panel, effects):
    df, data = panel
    more = df.withColumns({"y2": F.when(F.col("unit") % 4 != 1, F.col("y") * F.col("y")), "z": F.col("unit").cast("double")})
    early = F.col("year") < 2011
    def model(outcome, terms, where=None):
        return ModelSpec(outcome, tuple(terms), effects, "firm", where=where)

    specs = [
        model("y", [main("a")]), model("y", crossed(main("a"), main("b"))), model("y2", [main("a")]),
        model("y", [main("a")], early), model("y2", [main("b"), main("z")], early), model("y", [main("b")], F.col("unit") > 5),
        ModelSpec("y", (main("a"),), ("unit", "country"), "firm"),
    ]
    for fit, spec in zip(regress.fit_all(more, specs), specs):
        alone = regress.fe_ols(more, spec)
        assert (fit.n_obs, fit.n_clusters, set(fit.estimates)) == (alone.n_obs, alone.n_clusters, set(alone.estimates))
        for term in alone.estimates:
            assert fit.estimates[term] == pytest.approx(alone.estimates[term], rel=1e-8)
            assert fit.std_errors[term] == pytest.approx(alone.std_errors[term], rel=1e-8)
        for name in ("r2", "adj_r2", "within_r2"):
            assert getattr(fit, name) == pytest.approx(getattr(alone, name), rel=1e-8)


def test_leave_out_fits_equal_refits(panel):
    from panelwright.operators import regress_leave_out

    df, data = panel
    # A group per unit, clusters that span groups; year 2030 has one row outside group 3, rows of group "none" have no group.
    more = df.withColumns({"part": F.when(F.col("country") != 5, F.concat(F.lit("g"), "country")), "b": F.col("b") + 1000 * F.col("unit")})
    extra = more.where("unit = 9").limit(2).unionByName(more.where("unit = 10").limit(1)).withColumn("year", F.lit(2030))
    more = frozen(more.unionByName(extra))
    spec = ModelSpec("y", tuple(crossed(main("a"), main("b"))), ("unit", "year"), "firm")
    fits = regress_leave_out.leave_out_fits(more, spec, "part")
    assert list(fits) == [f"g{i}" for i in range(5)]
    for value, fit in fits.items():
        alone = regress.fe_ols(more.where(~F.col("part").eqNullSafe(F.lit(value))), spec)
        assert (fit.n_obs, fit.n_clusters, set(fit.estimates)) == (alone.n_obs, alone.n_clusters, set(alone.estimates))
        for term in alone.estimates:
            assert fit.estimates[term] == pytest.approx(alone.estimates[term], rel=1e-7)
            assert fit.std_errors[term] == pytest.approx(alone.std_errors[term], rel=1e-7)
        for name in ("r2", "adj_r2", "within_r2"):
            assert getattr(fit, name) == pytest.approx(getattr(alone, name), rel=1e-7)
    some = more.where("unit % 5 = 0").select("unit").distinct()
    check(
        regress_leave_out.leave_units_out(df, ModelSpec("y", (main("a"),), ("unit", "year"), "firm"), some),
        dense_fit(data[data["unit"] % 5 != 0], "y", ["a"], ["unit", "year"], "firm"), ["a"],
    )
    with pytest.raises(ValueError, match="several groups"):
        regress_leave_out.leave_out_fits(df, spec, "year")


def test_the_number_of_jobs_does_not_grow_with_models(panel):
    df, _ = panel
    kept = df.dropna().where("unit < 900").persist()
    spec = ModelSpec("y", (main("a"), main("b")), ("unit", "year"), "firm")
    def jobs(outcomes, subsets):
        tracker, group = kept.sparkSession.sparkContext, f"grid-{len(outcomes)}-{len(subsets)}"
        tracker.setJobGroup(group, group)
        fits = regress.model_grid(kept, spec, outcomes, subsets)
        assert len(fits) == len(outcomes) * len(subsets)
        return len(tracker.statusTracker().getJobIdsForGroup(group))

    halves = {"all": F.lit(True), "odd": F.col("unit") % 2 == 1, "even": F.col("unit") % 2 == 0, "late": F.col("year") > 2007}
    assert jobs(["y"], {"all": F.lit(True)}) + 4 >= jobs(["y", "ab"], halves)


def test_redundant_terms_are_dropped_and_the_rest_is_unchanged(panel):
    df, _ = panel
    spec = ModelSpec(
        "y",
        (main("a"), computed("twice", F.col("a") * 2 + 5), computed("fixed", F.col("unit") * 1e6),
         computed("shift", F.lit(3.0)), main("b"), computed("mix", F.col("a") + F.col("b"))),
        ("unit", "year"), "firm",
    )
    fit = regress.fe_ols(df, spec)
    assert set(fit.estimates) == {"a", "b"}
    plain = regress.fe_ols(df, ModelSpec("y", (main("a"), main("b")), ("unit", "year"), "firm"))
    assert fit.estimates["a"] == pytest.approx(plain.estimates["a"], rel=1e-9)
    dropped = {r["term"] for r in fit.coefficients().where("dropped").collect()}
    assert dropped == {"twice", "fixed", "shift", "mix"}


def test_a_constant_moderator_drops_but_its_interaction_stays(panel):
    df, _ = panel
    moderated = df.withColumn("m", (F.col("country") + 1).cast("double"))
    fit = regress.fe_ols(moderated, ModelSpec("y", tuple(crossed(main("a"), main("m"))), ("country", "year"), "firm"))
    assert set(fit.estimates) == {"a", "a:m"}


def test_shift_per_unit_leaves_slopes_alone(panel):
    df, _ = panel
    spec = ModelSpec("y", (main("a"), main("b")), ("unit", "year"), "firm")
    moved = df.withColumn("y", F.col("y") + F.col("unit") * 10)
    one, two = regress.fe_ols(df, spec), regress.fe_ols(moved, spec)
    assert one.estimates["a"] == pytest.approx(two.estimates["a"], rel=1e-8)


def test_demeaned_columns_have_zero_group_means(panel):
    df, _ = panel
    out = regress.demean_fixed_effects(df.dropna(), ["a", "y"], ["unit", "year"])
    for effect in ("unit", "year"):
        worst = out.groupBy(effect).agg(F.abs(F.avg("a")).alias("m")).agg(F.max("m")).first()[0]
        assert worst < 1e-9


def test_singletons_are_removed_until_stable(spark):
    # Removing unit 3 leaves year 9 with one row, and that leaves unit 2 with one.
    rows = [(1, 1), (1, 2), (4, 1), (4, 2), (2, 9), (2, 1), (3, 9)]
    df = spark.createDataFrame(rows, "u int, y int")
    assert sorted(map(tuple, regress.drop_singletons(df, ["u", "y"]).collect())) == [(1, 1), (1, 2), (4, 1), (4, 2)]


def test_terms_are_ordered_by_degree_without_repeats():
    class Fake:
        def __mul__(self, other):
            return self

    a, b = regress.Term("a", Fake()), regress.Term("b", Fake())
    spec = ModelSpec("y", (*crossed(a, b), regress.Term("c", Fake()), a), ("u", "t"), "f")
    assert [t.name for t in spec.terms] == ["a", "b", "c", "a:b"]
    assert interaction(a, b).order == 2


@pytest.mark.parametrize("t, df, p", [(2.0, 10, 0.07338803), (0.0, 5, 1.0), (1.959964, 1e6, 0.05), (12.706205, 1, 0.05), (-3.5, 30, 0.0014768)])
def test_student_t(t, df, p):
    assert distributions.student_t_two_sided(t, df) == pytest.approx(p, rel=2e-4)


def test_stars():
    levels = ((0.01, "***"), (0.05, "**"), (0.1, "*"))
    assert [distributions.stars(p, levels) for p in (0.001, 0.04, 0.09, 0.2, None)] == ["***", "**", "*", "", ""]


def test_model_table_on_the_test_panel_matches_dense_fits(spark):
    from panelwright.plans import study_models
    from panelwright.workload.plan_queries import model_panel
    from panelwright.workload.tables import Tables

    panel = model_panel(Tables(spark, "/root/testdata/sf0.001")).persist()
    data = panel.toPandas()
    data["state_ownership_pct_tv:eps"] = data["state_ownership_pct_tv"] * data["eps"]
    for fit, spec in zip(study_models.fit_table(panel, "log_verified_by_phase"), study_models.TABLES["log_verified_by_phase"]()):
        rows = data[data["phase"] == int(spec.name[-1])]
        kept = [t for t in fit.terms if t in fit.estimates]
        check(fit, dense_fit(rows.dropna(subset=list(fit.terms)), "log_verified", kept, list(spec.effects), "bvdId"), kept)


@pytest.mark.parametrize("table", ["lv_country_fe_employees", "surplus_phase_interactions"])
def test_further_model_tables_match_dense_fits(spark, table):
    from panelwright.plans import study_models
    from panelwright.workload.plan_queries import model_panel
    from panelwright.workload.tables import Tables

    panel = model_panel(Tables(spark, "/root/testdata/sf0.001")).persist()
    for fit, spec in zip(study_models.fit_table(panel, table), study_models.TABLES[table]()):
        data = regress.design_matrix(panel, spec).toPandas()
        kept = [t for t in fit.terms if t in fit.estimates]
        check(fit, dense_fit(data, spec.outcome, kept, list(spec.effects), spec.cluster), kept)


def test_every_published_table_is_specified():
    from panelwright.plans import study_models

    assert len(study_models.TABLES) == 10
