import numpy as np
import pandas as pd
import pytest

from panelwright.operators import quantiles as q

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def _frame(spark):
    rng = np.random.default_rng(7)
    parts = {
        "hot": np.concatenate([np.zeros(3000), rng.normal(size=2000), rng.lognormal(10, 5, 500), -rng.lognormal(2, 4, 700)]),
        "ties": rng.integers(-3, 4, 800).astype(float),
        "one": np.array([42.5]),
        "tiny": rng.normal(size=50) * 1e-12,
        "large": rng.normal(size=99) * 1e12 + 1e15,
        "gone": np.array([np.nan, np.nan]),
        "infinite": np.concatenate([np.arange(50.0), [np.inf]]),
        "both ends": np.array([-np.inf] * 30 + [np.inf] * 31 + [-0.0, 0.0, 5e-324, -5e-324, 1.7e308, -1.7e308]),
    }
    rows = [(None if k == "ties" else k, None if i % 97 == 5 and k == "hot" else float(v))
            for k, values in parts.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "g string, v double"), pd.DataFrame(rows, columns=["g", "v"])


def _interpolated(values, p):
    values = np.sort(values)
    place = (len(values) - 1) * p
    low, high = values[int(np.floor(place))], values[int(np.ceil(place))]
    share = place - np.floor(place)
    return low if low == high else (1 - share) * low + share * high


@pytest.mark.parametrize("plan", ["buffered", "mixed", "narrowing", "narrowing without broadcast"])
def test_quantiles_match_numpy(spark, monkeypatch, plan):
    df, local = _frame(spark)
    limits = {} if plan == "buffered" else {"buffered_rows": 0, "buffered_group_rows": 0}
    if plan == "mixed":
        limits["buffered_group_rows"] = 500
    if plan == "narrowing without broadcast":
        monkeypatch.setattr(q, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(q, "_SALTS", 4)
    got = {(r["g"], r["prob"]): r["quantile"] for r in q.quantiles(df, "v", PROBS, ["g"], **limits).collect()}
    local["g"] = local["g"].astype(object).where(local["g"].notna(), None)
    assert len(got) == 8 * len(PROBS)
    for g in ["hot", None, "one", "tiny", "large", "gone", "infinite", "both ends"]:
        values = local[local["g"].isna() if g is None else local["g"] == g]["v"].dropna().to_numpy()
        for p in PROBS:
            if len(values) == 0:
                assert got[(g, p)] is None
            else:
                assert got[(g, p)] == pytest.approx(_interpolated(values, p), rel=1e-9, abs=1e-18, nan_ok=True)


def test_global_quantile_by_narrowing(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "v double")
    (row,) = q.quantile_columns(df, "v", {"p99": 0.99}, buffered_rows=0, buffered_group_rows=0).collect()
    assert row["p99"] == pytest.approx(9.79)
