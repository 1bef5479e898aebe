"""Permutation importance against a brute force, co-moments against numpy, ranks, and model settings."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from prismtab.operators import comparison, importance, modeling, moments, ranks, relations, targets


def people(spark, rows=1000):
    r = np.random.default_rng(3)
    x, y, noise = r.normal(size=rows), r.normal(size=rows), r.normal(size=rows)
    word = r.choice(["a", "b", "c"], rows)
    return spark.createDataFrame([(i, float(a), float(b), float(n), str(w), float(3 * a + b + 2 * (w == "a"))) for i, (a, b, n, w) in enumerate(zip(x, y, noise, word))],
                                 "id long, x double, y double, noise double, word string, actual double").repartition(7)


@pytest.mark.parametrize("regression", [True, False])
def test_shuffled_scores_against_brute_force(spark, regression):
    data, features = people(spark), ["x", "y", "noise", "word"]
    value = 3 * F.col("x") + F.col("y") + 2 * (F.col("word") == "a").cast("int")
    if not regression:
        data = data.withColumn("actual", (F.col("actual") > 0).cast("string"))
        value = (value > 0).cast("string")
    got = {r["variant"]: r["score"] for r in importance.shuffled_scores(data, features, ["id"], lambda d: d.withColumn("predicted", value), regression, repeats=2).collect()}
    rows = data.withColumn("_mark", F.xxhash64(F.lit(42), "id")).orderBy("_mark", "id").collect()

    def score(columns):
        p = [3 * a + b + 2 * (w == "a") for a, b, w in zip(columns["x"], columns["y"], columns["word"])]
        actual = [r["actual"] for r in rows]
        if not regression:
            return np.mean([str(v > 0).lower() == t for v, t in zip(p, actual)])
        return 1 - np.mean((np.array(actual) - p) ** 2) / np.var(actual)

    base = {f: [r[f] for r in rows] for f in features}
    assert got[0] == pytest.approx(score(base)) and len(got) == 9
    for repeat in range(2):
        for f, name in enumerate(features):
            by = importance.shift(name, repeat, len(rows), 42)
            moved = base | {name: base[name][-by:] + base[name][:-by]}
            assert got[1 + repeat * 4 + f] == pytest.approx(score(moved)), name


def test_importance_of_a_trained_model(spark):
    trained = modeling.train_model(people(spark).withColumnRenamed("actual", "sales"), "sales", "regression", ["id"])
    found = importance.permutation_importance(trained, ["id"]).collect()
    assert [r["feature"] for r in found[:2]] == ["x", "y"] and found[0]["importance"] > 0.5
    assert sum(r["share"] for r in found) == pytest.approx(1, abs=1e-5)


def test_co_moments_of_many_columns(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(800, 20)) @ r.normal(size=(20, 20)) + 1e6
    x[r.random(x.shape) < 0.2] = np.nan
    x[:, 5] = 3.0
    names = [f"n{i}" for i in range(20)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"{n} double" for n in names)).repartition(5)
    found = moments.co_moments(df, names, tile=7, block_rows=90).correlation()
    assert np.allclose(found, moments.co_moments(df, names).correlation(), equal_nan=True)
    for a in range(20):
        for b in range(20):
            both = np.isfinite(x[:, a]) & np.isfinite(x[:, b])
            if 5 in (a, b):
                assert np.isnan(found[a, b])
            else:
                assert found[a, b] == pytest.approx(np.corrcoef(x[both, a], x[both, b])[0, 1], abs=1e-9)
    wide = {(r.column_a, r.column_b): r.correlation for r in relations.correlation_pairs(df).collect()}
    few = {(r.column_a, r.column_b): r.correlation for r in relations.correlation_pairs(df, names[:6]).collect()}
    assert len(wide) == 190 and all(wide[k] == pytest.approx(v, abs=2e-6) for k, v in few.items())
    assert np.isnan(moments.co_moments(df.limit(0), names[:3]).correlation()).all()


def test_totals_before(spark):
    r = np.random.default_rng(5)
    values = r.integers(0, 30, 3000).tolist()
    df = spark.createDataFrame([(v, i, float(i % 7)) for i, v in enumerate(values)], "v int, id int, w double").repartition(9)
    got = {r["id"]: (r["rank"], r["sum"]) for r in ranks.totals_before(df, ["v", "id"], {"rank": F.lit(1).cast("bigint"), "sum": F.col("w")}).collect()}
    order, total = sorted(range(3000), key=lambda i: (values[i], i)), 0.0
    for rank, i in enumerate(order):
        assert got[i] == (rank, pytest.approx(total))
        total += i % 7
    assert ranks.totals_before(df.limit(0), ["v"], {"rank": F.lit(1)}).count() == 0


def test_ranks_of_two_segments(spark):
    df = people(spark).withColumns({"g": F.when(F.col("id") % 3 == 0, "a").otherwise("b"), "v": F.round("x", 1)})
    u = comparison.mann_whitney(df, "g", ("a", "b"), "v").first()
    rows = [(r["g"], r["v"]) for r in df.collect()]
    a, b = [v for g, v in rows if g == "a"], [v for g, v in rows if g == "b"]
    assert (u["n_a"], u["n_b"]) == (len(a), len(b)) and u["statistic"] == sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def test_targets_of_metrics():
    columns = ["Profit", "total_sales", "category", "net_profit"]
    assert targets.target_for_metric(columns, "profit") == ("Profit", "regression")
    assert targets.target_for_metric(columns, "quantity") == (None, "regression")
    assert targets.target_for_metric(columns, None, "Which CATEGORY?") == ("category", "classification")
    assert targets.target_for_metric(columns, "orders") == ("total_sales", "regression")


def test_settings_of_training(spark):
    rows = [(i, f"w{i % 60}", "even" if i % 2 == 0 else "odd", "p" if i % 2 == 0 else "q", float(i % 5) if i % 9 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, word string, parity string, category string, size double")
    few = modeling.train_model(df, "category", "classification", ["id"])
    assert few.features == ["parity", "size"] and any("parity nearly determines category" in note for note in few.limitations)
    more = modeling.train_model(df, "category", "classification", ["id"], most_values=80)
    assert more.features == ["word", "parity", "size"]
    assert modeling.train_model(df, "category", "classification", ["id"], most_codes=10, most_values=80).reason == "too many indicator columns"
    assert modeling.train_model(df.withColumnRenamed("size", "sales"), metric="revenue").target == "sales"
    assert modeling.train_model(df, metric="quantity").status == "skipped"


def test_lines_of_several_targets(spark):
    df = people(spark).withColumns({"p": 2 * F.col("x") - F.col("y") + 5, "q": F.col("noise") * 0 + 1})
    got = {(r["target"], r["feature"]): (r["coefficient"], r["r2"]) for r in modeling.linear_targets(df, ["p", "q"], ["x", "y"]).collect()}
    assert got["p", "x"] == (2.0, 1.0) and got["p", "y"] == (-1.0, 1.0) and got["p", "intercept"] == (5.0, 1.0)
    assert got["q", "x"][0] == 0.0 and got["q", "intercept"] == (1.0, None)
