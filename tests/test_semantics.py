"""One small case per rule on missing values, ties, text and sentinels."""

import math

import pytest
from pyspark.sql import functions as F

from panelwright.functions import numeric, recode, text
from panelwright.operators import aggregates, filters, joins, projection, reshape, stats
from panelwright.session import broadcast_if_small


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    df = spark.createDataFrame([tuple(v for _, v in values.values())], schema)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_null_safe_join_spreads_rows_without_a_key(spark, how):
    def key(i, n):
        return None if i % 3 else i % n

    left = [(i, key(i, 7), key(i + 1, 5)) for i in range(600)] + [(0, None, None)] * 5
    right = [(key(i, 7), key(i, 5), 1000 + i) for i in range(40)]
    ldf = spark.createDataFrame(left, "i int, a int, b int")
    rdf = spark.createDataFrame(right, "a int, b int, v int")
    want = []
    for i, a, b in left:
        met = [v for ra, rb, v in right if (ra, rb) == (a, b)]
        want += [(i, a, b, v) for v in met or ([None] if how == "left" else [])]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = joins.join_on(ldf, rdf, ["a", "b"], ["v"], how=how, null_safe=True)
        assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
        # The left side is read once, and its rows without a key do not meet in one task.
        assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2
        blank = out.where("a IS NULL AND b IS NULL").groupBy(F.spark_partition_id()).count()
        assert blank.count() > 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_null_safe_join_and_plain_join(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, l int")
    right = spark.createDataFrame([(None, 10), ("b", 20)], "k string, r int")
    safe = {(r["l"], r["r"]) for r in joins.join_on(left, right, ["k"], null_safe=True).collect()}
    plain = {(r["l"], r["r"]) for r in joins.join_on(left, right, ["k"]).collect()}
    assert safe == {(1, 10), (2, None)} and plain == {(1, None), (2, None)}


def test_join_on_a_frame_derived_from_itself(spark):
    df = spark.createDataFrame([(1, 2), (2, 3)], "k int, v int")
    totals = df.groupBy("k").agg(F.sum("v").alias("total"))
    assert {tuple(r) for r in joins.join_on(df, totals, ["k"]).collect()} == {(1, 2, 2), (2, 3, 3)}


def test_membership_is_never_null(spark):
    assert one(spark, recode.is_member(F.col("v"), ["a"]), v=("string", None)) is False


def test_flag_keeps_or_zeroes_missing(spark):
    condition = F.col("v") > 1
    assert one(spark, recode.flag(condition), v=("int", None)) is None
    assert one(spark, recode.flag(condition, missing_as_zero=True), v=("int", None)) == 0


def test_distinct_counts_missing_as_a_value(spark):
    df = spark.createDataFrame([(None,), ("a",), ("a",), ("b",)], "v string")
    assert df.agg(aggregates.n_distinct("v").alias("n")).first()["n"] == 3


def test_aggregates_over_nothing(spark):
    df = spark.createDataFrame([(1.0, False), (None, False)], "v double, f boolean")
    row = df.agg(
        aggregates.filtered_max(F.col("v"), F.col("f")).alias("m"),
        aggregates.capped_sum(F.col("v"), F.col("f"), 100).alias("s"),
        aggregates.any_true(F.col("f")).alias("a"),
    ).first()
    assert tuple(row) == (0.0, 0.0, False)


def test_capped_sum(spark):
    df = spark.createDataFrame([(80.0,), (70.0,)], "v double")
    assert df.agg(aggregates.capped_sum(F.col("v"), F.lit(True), 100).alias("s")).first()["s"] == 100.0


@pytest.mark.parametrize("raw, number", [("12.5", 12.5), ("n.a.", None), ("WO", None), ("", None), ("x1", None), (None, None)])
def test_text_to_number(spark, raw, number):
    assert one(spark, numeric.to_number(F.col("v"), "n.a.", "WO", ""), v=("string", raw)) == number


def test_division_by_zero_is_missing(spark):
    assert one(spark, numeric.surplus_ratio(F.col("a"), F.col("b")), a=("double", 1.0), b=("double", 0.0)) is None
    assert one(spark, numeric.positive_ratio(F.col("a"), F.col("b")), a=("double", 1.0), b=("double", -1.0)) is None


def test_log_of_zero_is_missing(spark):
    assert one(spark, numeric.positive_log(F.col("a")), a=("double", 0.0)) is None


def test_constant_correlation_is_missing_not_an_error(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "a double, b double")
    cells = {(r["x"], r["y"]): r["r"] for r in stats.corr_matrix(df, ["a", "b"]).collect()}
    assert cells == {("a", "a"): None, ("b", "b"): 1.0, ("a", "b"): None, ("b", "a"): None}
    assert stats.corr_pairwise(df, "a", "b").first()["n"] == 2


def test_corr_test_matches_a_worked_example(spark):
    x, y = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [2.0, 1.0, 4.0, 3.0, 7.0, 5.0]
    row = stats.corr_test(spark.createDataFrame(list(zip(x, y)), "x double, y double"), "x", "y").first()
    r = row["r"]
    assert row["df"] == 4 and row["t"] == pytest.approx(r * math.sqrt(4 / (1 - r * r)))
    half = 1.959963984540054 / math.sqrt(3)
    assert row["conf_low"] == pytest.approx(math.tanh(math.atanh(r) - half))
    assert row["p_value"] == pytest.approx(0.06051, abs=1e-4)


def test_dictionary_misses_are_null(spark):
    assert one(spark, recode.lookup({"a": 1}, F.col("v")), v=("string", "b")) is None
    assert one(spark, recode.lookup({"a": 1}, F.col("v")), v=("string", None)) is None


def test_rounding_ties_go_to_even(spark):
    df = spark.createDataFrame([(1,)] * 1 + [(0,)] * 7, "v int")
    assert df.agg(numeric.percent_true(F.col("v") == 1).alias("p")).first()["p"] == 12.5
    df = spark.createDataFrame([(1,)] * 1 + [(0,)] * 15, "v int")
    assert df.agg(numeric.percent_true(F.col("v") == 1).alias("p")).first()["p"] == 6.2


def test_split_rows_keeps_missing_cells_and_rejects_uneven_ones(spark):
    good = spark.createDataFrame([(1, "a\nb\n", "1\n2\n3"), (2, None, None)], "k int, n string, p string")
    assert sorted((r["k"], r["n"] or "", r["p"] or "") for r in reshape.split_rows(good, ["n", "p"]).collect()) == [
        (1, "", "3"), (1, "a", "1"), (1, "b", "2"), (2, "", "")]
    bad = spark.createDataFrame([(1, "a\nb", "1")], "k int, n string, p string")
    assert reshape.uneven_cells(bad, ["n", "p"]).count() == 1
    with pytest.raises(Exception, match="different numbers of parts"):
        reshape.split_rows(bad, ["n", "p"]).collect()
    assert reshape.split_rows(bad, ["n", "p"], checked=False).count() == 2


def test_year_in_text(spark):
    assert one(spark, text.year_in_text(F.col("v")), v=("string", "SH - Direct % 31/12/2014")) == 2014
    assert one(spark, text.year_in_text(F.col("v")), v=("string", "none")) is None


def test_union_by_name_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2,)], "k int")
    assert {tuple(r) for r in reshape.union_by_name(a, b).collect()} == {(1, "x"), (2, None)}


def test_pivot_leaves_absent_cells_missing(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", False)], "g string, m boolean")
    got = {r["g"]: (r["m_FALSE"], r["m_TRUE"], r["pct_matched"]) for r in
           reshape.pivot_flag(df, ["g"], "m", F.count(F.lit(1)), "m_").collect()}
    assert got == {"a": (1, 1, 50.0), "b": (1, None, None)}


def test_missing_is_its_own_group(spark):
    df = spark.createDataFrame([(None, 1), ("a", None)], "g string, v int")
    got = {r["g"]: r["pct_v"] for r in aggregates.coverage_report(df, {"v": "v"}, ["g"]).collect()}
    assert got == {None: 100.0, "a": 0.0}


@pytest.mark.parametrize("value, fuel", [("Fossil Coal-derived gas", "coal"), ("FOSSIL GAS", "gas"), ("Biomass", "biomass"), ("Hydro", "other")])
def test_first_pattern_wins(spark, value, fuel):
    assert one(spark, recode.fuel_of(F.col("v")), v=("string", value)) == fuel


def test_minority_shares_have_no_band_of_three(spark):
    assert one(spark, recode.ownership_band(F.col("v")), v=("double", 20.0)) is None
    assert one(spark, recode.ownership_band(F.col("v"), minority=True), v=("double", 20.0)) == "Minority state (<50%)"


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    row = aggregates.five_number_summary(df, ["v"]).first()
    assert (row["n_missing"], row["max"], row["median"]) == (2, 1.0, 1.0)


def test_anti_join_drops_blank_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), ("",), (None,)], "k string")
    ids = spark.createDataFrame([("a",), (None,)], "k string")
    assert [r["k"] for r in joins.anti_join_ids(df, ids, "k").collect()] == ["b"]


def test_fanout_is_visible(spark):
    df = spark.createDataFrame([("n", "1"), ("n", "2"), ("m", "3")], "name string, id string")
    assert [tuple(r) for r in joins.fanout_keys(df, "name", "id").collect()] == [("n", 2)]


def test_nested_freq_spreads_wide_cells(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("v"))
    assert len(aggregates.nested_freq(df, "v", "cell").first()["cell"]) == 50
    parts = aggregates.nested_freq(df, "v", "cell", part_size=10).collect()
    assert len(parts) > 1 and sorted(k for p in parts for k in p["cell"]) == sorted(str(i) for i in range(50))


def test_columns_with_awkward_names(spark):
    df = spark.createDataFrame([(1, "2", "x")], "`A. id` int, `Value 2010 (%)` string, other string")
    assert projection.select_by_prefix(df, "Value", keep=["A. id"]).columns == ["A. id", "Value 2010 (%)"]
    assert projection.select_by_regex(df, r"\d{4}").columns == ["Value 2010 (%)"]
    long = reshape.unpivot_years(df, ["A. id"], ["Value 2010 (%)"], "v").first()
    assert (long["A. id"], long["year"], long["v"]) == (1, 2010, "2")


def test_drop_columns_is_strict_and_drop_if_exists_is_not(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert projection.drop_if_exists(df, "b", "zzz").columns == ["a"]
    with pytest.raises(ValueError):
        projection.drop_columns(df, "zzz")


def test_percentile_trim_uses_the_data(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10)], "v double")
    kept = [r["t"] for r in filters.bracket_cutoff_trim(df, "v", 0.99, "t").orderBy("v").collect()]
    assert kept == [1.0, 2.0, 3.0, None]


def test_histogram_maximum_is_in_the_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    bins = {r["bin"]: r["n"] for r in stats.histogram_bins(df, "v", 10).collect()}
    assert bins == {**{b: 1 for b in range(1, 10)}, 10: 2}


@pytest.mark.parametrize("rows, hinted", [(5, True), (6, False)])
def test_broadcast_only_below_the_limit(spark, rows, hinted):
    plan = broadcast_if_small(spark.range(rows), 5)._jdf.queryExecution().logical().toString()
    assert ("ResolvedHint" in plan or "UnresolvedHint" in plan) == hinted


def test_wholly_owned_option(spark):
    from panelwright.plans.firms import state_ownership

    schema = ("`BvD ID number` string, `Company name Latin alphabet` string, `Country ISO code` string, "
              "`CSH - Name` string, `CSH - Type` string, `CSH - Direct %` string, `CSH - Total %` string")
    df = spark.createDataFrame([("f", "F", "DE", "State", "Public", "WO", "WO")], schema)
    assert state_ownership(df).first()["state_ownership_pct"] == 0.0
    assert state_ownership(df, wholly_owned_as=100).first()["state_ownership_pct"] == 100.0
