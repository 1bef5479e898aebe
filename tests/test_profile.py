"""Statistics, quality, quantiles, outliers and histograms on small frames."""
import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from prismtab.operators import outliers, profile, quality, quantiles, relations


def rows(frame):
    return [tuple(r) for r in frame.collect()]


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame([
        ("a", 1.0, "2026-01-01", None, True), ("a", 1.0, "2026-01-01", None, True), (" ", float("nan"), "x", None, False),
        (None, 3.0, None, None, None),
    ], "label string, number double, day string, nothing string, flag boolean")


def test_stats_by_value_equal_stats_by_row(mixed):
    by_value = profile.column_stats(mixed)
    by_row = profile.column_stats(mixed, distinct=False)
    for one, other in zip(by_value, by_row):
        assert (one.rows, one.nulls, one.blanks, one.numeric_values, one.date_values, one.word_groups) == (
            other.rows, other.nulls, other.blanks, other.numeric_values, other.date_values, other.word_groups)
    found = {s.name: s for s in by_value}
    assert (found["label"].nulls, found["label"].blanks, found["label"].distinct, found["label"].distinct_filled) == (1, 2, 2, 1)
    assert (found["number"].nulls, found["number"].distinct) == (1, 2)
    assert found["nothing"].nulls == 4 and found["nothing"].distinct == 0


def test_approximate_distinct_is_close(spark):
    stats = profile.column_stats(spark.range(20000), approximate=True)[0]
    assert abs(stats.distinct - 20000) < 2000


def test_empty_frame(spark):
    df = spark.createDataFrame([], "a string, b double")
    assert [s.rows for s in profile.column_stats(df)] == [0, 0]
    assert quality.data_quality(df).first().data_quality_score == 96.0  # two constant columns
    assert rows(quality.describe_numeric(df)) == [("b", 0, None, None, None, None, None, None, None)]
    assert rows(outliers.histogram(df, "b")) == []


def test_duplicates_treat_nulls_as_equal(mixed):
    assert quality.duplicate_count(mixed) == 1
    assert quality.duplicate_count(mixed, fingerprint=True) == 1


def test_fingerprint_sees_where_the_null_is(spark):
    df = spark.createDataFrame([("a", None), (None, "a")], "x string, y string")
    assert quality.duplicate_count(df, fingerprint=True) == 0


def test_single_row_statistics(spark):
    df = spark.createDataFrame([(5.0,)], "v double")
    assert rows(profile.numeric_summary(df)) == [("v", 5.0, 5.0, 5.0, 5.0, 0.0)]
    assert rows(profile.skewness(df)) == [("v", None, "unknown")]
    assert rows(outliers.outliers_iqr(df)) == []
    assert rows(outliers.outliers_any_size(df)) == [("v", 0)]


def test_skew_and_describe_equal_pandas(spark):
    values = [1.0, 2.0, 2.0, 3.0, 50.0, -4.5]
    df, series = spark.createDataFrame([(v,) for v in values], "v double"), pd.Series(values)
    assert profile.skewness(df).first().skewness == round(series.skew(), 4)
    want = series.describe().round(6)
    got = quality.describe_numeric(df).first()
    assert [got["count"], got["mean"], got["std"], got["p25"], got["p50"], got["p75"]] == [
        want["count"], want["mean"], want["std"], want["25%"], want["50%"], want["75%"]]


PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("bracket", [0, 50, 200_000])
def test_bracketed_quantiles_are_exact_with_hot_values(spark, bracket):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.full(4000, 7.0), rng.normal(0, 100, 5000), rng.integers(0, 5, 3000)])
    df = spark.createDataFrame(pd.DataFrame({"v": values, "w": values * -2}))
    got = quantiles.exact_quantiles(df, ["v", "w"], PROBABILITIES, in_one_bracket=bracket)
    for name, column in (("v", values), ("w", values * -2)):
        assert got[name] == pytest.approx(list(np.quantile(column, PROBABILITIES)), abs=1e-9)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), min_size=1, max_size=40))
def test_quantiles_of_any_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    filled = [v for v in values if v is not None]
    for limit in (0, 10**6):
        got = quantiles.exact_quantiles(df, ["v"], [0.25, 0.5, 0.9], in_one_bracket=limit)["v"]
        assert got == ([None] * 3 if not filled else pytest.approx(list(np.quantile(filled, [0.25, 0.5, 0.9])), rel=1e-9, abs=1e-6))


def test_outliers_and_capping(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 100])] + [(9, None)], "k int, v double")
    assert rows(outliers.outliers_pct(df, ["v"])) == [("v", 1, 16.67, -1.5, 8.5)]
    assert rows(outliers.outlier_samples(df, "v", ["k"])) == [(5, 100.0)]
    capped = {r.k: r.v for r in outliers.cap_outliers(df, ["v"]).collect()}
    assert capped[5] == 8.5 and capped[0] == 1.0 and capped[9] is None


def test_flat_columns_have_no_outlier_share(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(5.0,)], "v double")
    assert rows(outliers.outliers_pct(df)) == []
    assert rows(outliers.outliers_iqr(df)) == [("v", 1, 1.0, 1.0)]


def test_integer_histogram(spark):
    df = spark.createDataFrame([(v,) for v in [0, 1, 9, 10, 25, None]], "v int")
    assert rows(outliers.histogram(df, "v")) == [("0-2", 2), ("9-11", 2), ("24-26", 1)]


def test_calorie_histogram_has_a_wider_first_bin(spark):
    df = spark.createDataFrame([(v,) for v in [100, 160, 161, 220, 221]], "calories int")
    assert rows(outliers.histogram(df, "calories")) == [("100-160", 2), ("161-220", 2), ("221-280", 1)]


def test_float_histogram_equals_numpy(spark):
    values = np.random.default_rng(1).random(500) * 10
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    counts, _ = np.histogram(values, bins=12)
    assert [r["count"] for r in outliers.histogram(df, "v").collect()] == [c for c in counts if c]


def test_constant_histogram_and_summary_histogram(spark):
    df = spark.createDataFrame([(2.5,)] * 3 + [(None,)], "v double")
    assert rows(outliers.histogram(df, "v")) == [("2.5-2.5", 3)]
    assert sum(r["count"] for r in outliers.histogram_summary(df, "v").collect()) == 3


def test_unique_values_name_missing(mixed):
    found = {r.column_name: (r.unique_values, r.top_values) for r in profile.unique_values(mixed.select("label", "nothing")).collect()}
    assert found == {"label": (2, "a (2),   (1), Missing (1)"), "nothing": (0, "Missing (4)")}


def test_correlations_ignore_gaps_and_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0), (4.0, 8.0, 5.0)], "a double, b double, c double")
    assert rows(relations.correlation_pairs(df)) == [("a", "b", 1.0), ("a", "c", 0.0), ("b", "c", 0.0)]
    assert rows(relations.strong_correlations(df)) == [("a", "b", 1.0)]
    assert rows(relations.correlation_strength(df)) == [("a", "b", 1.0, "strong")]
    assert rows(relations.correlation_pairs(df.select("a"))) == []


def test_missing_report_order_and_flag(mixed):
    assert rows(quality.missing_report(mixed))[0] == ("nothing", 4, 100.0, True)
    assert {r.column_name: r.missing for r in quality.missing_values(mixed).collect()}["number"] == 1


def test_eda_bundle(mixed):
    bundle = quality.eda_bundle(mixed, "label")
    assert {"missing_values", "duplicates", "cardinality", "top_values", "describe", "skewness", "outliers", "preview"} == set(bundle)
    assert all(frame.columns for frame in bundle.values())
