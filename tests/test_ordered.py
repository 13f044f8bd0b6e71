import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import aggregates, ordered


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows belongs to one unit; some units are missing or tiny."""
    rng = np.random.default_rng(3)
    units = np.where(rng.random(3000) < 0.34, 1, rng.integers(2, 200, 3000))
    data = pd.DataFrame({
        "unit": [None if u == 7 else int(u) for u in units],
        "k": rng.permutation(3000),
        "v": [None if rng.random() < 0.6 else float(x) for x in rng.normal(size=3000)],
    })
    df = spark.createDataFrame(
        [(None if pd.isna(u) else int(u), int(k), None if pd.isna(v) else float(v))
         for u, k, v in data.itertuples(index=False)],
        "unit int, k int, v double",
    )
    data["unit"] = pd.to_numeric(data["unit"])
    return df, data.sort_values("k")


def _as_dict(df, name):
    return {r["k"]: r[name] for r in df.collect()}


@pytest.mark.parametrize("bounded", [True, False])
def test_previous_row(rows, bounded):
    df, data = rows
    got = _as_dict(ordered.with_previous(df, ["unit"], ["k"], ["v"], "prev_", bounded), "prev_v")
    expected = data.groupby("unit", dropna=False)["v"].shift(1)
    assert len(got) == 3000
    for k, e in zip(data["k"], expected):
        assert got[k] == (None if pd.isna(e) else e)


@pytest.mark.parametrize("bounded", [True, False])
def test_fill_down(rows, bounded):
    df, data = rows
    got = _as_dict(ordered.ffill_group(df, ["unit"], ["k"], ["v"], bounded), "v")
    expected = data.groupby("unit", dropna=False)["v"].ffill()
    for k, e in zip(data["k"], expected):
        assert got[k] == (None if pd.isna(e) else e)


def test_fill_is_idempotent(rows):
    df, _ = rows
    once = ordered.ffill_group(df, ["unit"], ["k"], ["v"])
    assert _as_dict(once, "v") == _as_dict(ordered.ffill_group(once, ["unit"], ["k"], ["v"]), "v")


@pytest.mark.parametrize("block_rows, blocks", [(7, 3), (100, 5), (10_000, 1000)])
def test_fill_in_row_order(rows, block_rows, blocks):
    df, data = rows
    got = _as_dict(ordered.ffill_row_order(df, "k", ["v", "unit"], block_rows, blocks), "v")
    for k, e in zip(data["k"], data["v"].ffill()):
        assert got[k] == (None if pd.isna(e) else e)


def test_lag_growth_treats_gaps_as_adjacent_and_zero_as_missing(spark):
    df = spark.createDataFrame([(1, 2000, 2.0), (1, 2005, 3.0), (2, 2000, 0.0), (2, 2001, 1.0)], "u int, y int, v double")
    got = {(r["u"], r["y"]): r["g"] for r in ordered.lag_growth(df, ["u"], "y", "v", "g", bounded=True).collect()}
    assert got == {(1, 2000): None, (1, 2005): 0.5, (2, 2000): None, (2, 2001): None}


def test_change_events(spark):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, None), ("a", 3, "y"), ("a", 4, "y"), ("b", 1, "x")], "u string, k int, v string"
    )
    assert [tuple(r) for r in ordered.change_events(df, ["u"], ["k"], "v").collect()] == [("a", 1)]


def test_complete_years_keeps_rows_outside_the_range_and_duplicates(spark):
    df = spark.createDataFrame([(1, 1990, "old"), (1, 2001, "x"), (1, 2001, "y"), (2, 1999, "z")], "u int, y int, v string")
    got = sorted((r["u"], r["y"], r["v"] or "") for r in ordered.complete_years(df, ["u"], "y", 2000, 2002).collect())
    assert got == [(1, 1990, "old"), (1, 2000, ""), (1, 2001, "x"), (1, 2001, "y"), (1, 2002, ""),
                   (2, 1999, "z"), (2, 2000, ""), (2, 2001, ""), (2, 2002, "")]


def test_rank_keeps_ties_and_null_groups(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 2.0), (None, 4, 5.0)], "g string, k int, v double")
    assert sorted(r["k"] for r in ordered.rank_min_ties(df, ["g"], "v").collect()) == [1, 2, 4]


def test_row_positions_are_global(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    got = ordered.with_row_position(df, ["x"], "pos").collect()
    by_value = sorted(got, key=lambda r: r["x"])
    assert [r["pos"] for r in by_value] == list(range(1, 1001))


def test_sort_puts_missing_last_both_ways(spark):
    df = spark.createDataFrame([(None,), (1,), (2,)], "x int")
    assert [r[0] for r in ordered.sort_multi(df, ("x", True)).collect()] == [1, 2, None]
    assert [r[0] for r in ordered.sort_multi(df, ("x", False)).collect()] == [2, 1, None]


def test_keep_first_orders_missing_last(spark):
    df = spark.createDataFrame([(1, None, "n"), (1, 5, "five"), (1, 3, "three"), (2, None, "only")], "k int, o int, v string")
    got = {r["k"]: r["v"] for r in aggregates.keep_first(df, ["k"], [F.col("o")]).collect()}
    assert got == {1: "three", 2: "only"}


def test_dedupe_prefers_the_code(spark):
    df = spark.createDataFrame([(1, "120-0", "a"), (1, "100-7", "z"), (2, "120-0", "b")], "k int, code string, v string")
    got = aggregates.dedupe_by_priority(df, ["k"], "code", "100-7", ["code", "v"]).collect()
    assert {r["k"]: r["v"] for r in got} == {1: "z", 2: "b"}
