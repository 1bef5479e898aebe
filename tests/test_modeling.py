"""Models: gates, a better score than the baseline, stable splits."""
import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from prismtab.operators import evaluation, modeling
from prismtab.sources import store


@pytest.fixture(scope="module")
def shop(spark):
    rng = np.random.default_rng(5)
    n = 400
    quantity, price = rng.integers(1, 20, n), rng.choice([5.0, 9.5, 20.0], n)
    region = rng.choice(["north", "south"], n)
    revenue = quantity * price + (region == "north") * 30 + rng.normal(0, 1, n)
    churned = np.where(quantity + rng.normal(0, 2, n) > 10, "yes", "no")
    return spark.createDataFrame(pd.DataFrame({
        "order_id": np.arange(n), "region": region, "price": price, "quantity": quantity.astype(float),
        "revenue": revenue, "churned": churned}))


def scores(result, metric):
    return {name: value for name, m, value in result.scores if m == metric}


def test_regression_beats_the_baseline(shop, tmp_path):
    result = modeling.train_model(shop.drop("churned"), "revenue")
    assert result.status == "complete" and result.task == "regression"
    assert result.features == ["region", "price", "quantity"]
    r2 = scores(result, "r2")
    assert r2[result.selected] > 0.8 > r2["baseline_mean"]
    assert result.train_rows + result.test_rows == 400
    importance = modeling.feature_importance(shop, result).collect()
    assert abs(sum(r.importance for r in importance) - 1) < 1e-3
    assert {r.feature for r in importance} == {"price", "quantity", "region_north", "region_south"}
    store.save_model(result.model, str(tmp_path))
    assert len(store.load_model(str(tmp_path)).stages) == len(result.model.stages)


def test_classification_beats_the_baseline(shop):
    result = modeling.train_model(shop.drop("revenue"), "churned")
    f1 = scores(result, "f1_weighted")
    assert f1[result.selected] > f1["baseline_most_common"]
    assert modeling.top_features(modeling.feature_importance(shop, result), 1).first().feature == "quantity"
    sample = modeling.prediction_sample(result, ["quantity"], 3).collect()
    assert len(sample) == 3 and {r.predicted for r in sample} <= {"yes", "no"}
    matrix = evaluation.confusion_matrix(result.predictions).collect()
    assert len(matrix) == 4 and sum(r["count"] for r in matrix) == result.test_rows


def test_gates(spark, shop):
    assert modeling.train_model(shop.limit(10), "revenue").status == "skipped"
    assert modeling.train_model(shop, "order_id").status == "skipped"
    assert modeling.train_model(shop.select("order_id", "revenue"), "revenue").reason == "no safe feature columns"


def test_split_is_stable_and_keeps_equal_rows_together(shop):
    doubled = shop.unionByName(shop)
    train, test = modeling.hash_split(doubled.repartition(7), 75)
    assert train.join(test, shop.columns, "left_semi").count() == 0
    assert train.count() == 2 * modeling.hash_split(shop, 75)[0].count()


def test_ridge_equals_the_closed_form(spark):
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    x = (x - x.mean(0)) / x.std(0)
    y = x @ [3.0, -1.0] + rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    ready = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    want = np.linalg.solve(x.T @ x + np.eye(2), x.T @ (y - y.mean()))
    assert modeling._ridge(ready, "y").fit(ready).coefficients.toArray() == pytest.approx(want, abs=1e-8)


def test_local_contributions_add_up(shop):
    rows = modeling.local_contributions(shop, "revenue", ["price", "quantity"], ["order_id"], top=1).collect()
    assert len(rows) == 400 and all(r.contribution is not None for r in rows)


def test_segments(spark):
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(0, 0.1, (60, 2)), rng.normal(9, 0.1, (30, 2))])
    df = spark.createDataFrame(pd.DataFrame(points, columns=["x", "y"]))
    rows = modeling.segments(df, k=2).collect()
    assert [r["count"] for r in rows] == [60, 30] and abs(rows[1].x_mean - 9) < 0.2
    assert modeling._largest_drop({2: 10.0, 3: 9.0, 4: 2.0}) == 3 and modeling._largest_drop({2: 1.0}) == 3


def test_quick_predict(shop):
    line = modeling.quick_predict(shop, "revenue", ["price", "quantity"]).collect()
    assert {r.model for r in line} == {"linear"} and next(r.value for r in line if r.name == "r2") > 0.7
    classes = modeling.quick_predict(shop, "churned", ["price", "quantity"]).collect()
    assert next(r.value for r in classes if r.name == "accuracy") > 0.6
    with pytest.raises(ValueError):
        modeling.quick_predict(shop.limit(5), "revenue", ["price"])


def test_batch(shop):
    trained = modeling.batch_train(shop, {"revenue": "regression", "churned": "classification"})
    table = modeling.batch_table(shop, trained).collect()
    assert {r.target for r in table} == {"revenue", "churned"}


def test_scores_of_constant_targets(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (None, 3.0)], "actual double, predicted double")
    assert evaluation.regression_metrics(df).first().r2 == 0.0
    assert evaluation.class_balance(df, "actual").first().imbalanced


def test_stratified_split_keeps_the_share_of_each_class(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 40 == 0, "rare").otherwise("common").alias("kind"))
    train, test = modeling.stratified_split(df, "kind", 75)
    counts = {r["kind"]: r["count"] for r in train.groupBy("kind").count().collect()}
    assert counts == {"rare": 75, "common": 2925} and train.count() + test.count() == 4000 and test.columns == df.columns


def test_merged_rows_grow_the_forest_of_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n = 6000
    size, price, word = rng.integers(0, 9, n), rng.exponential(50.0, n), rng.choice(["a", "b", "c"], n)
    value = 20.0 * size + price + 30 * (word == "a") + rng.normal(0, 1, n)
    frame = spark.createDataFrame(pd.DataFrame({"size": size.astype(float), "price": price, "word": word, "sales": value,
                                                "kind": np.where(value > 120, "high", "low")}))
    fitted = []
    real = modeling.VectorAssembler
    def assembler(*args, **kwargs):
        fitted.append(kwargs.get("outputCol"))
        return real(*args, **kwargs)
    monkeypatch.setattr(modeling, "VectorAssembler", assembler)
    for target, other, metric in (("sales", "kind", "r2"), ("kind", "sales", "f1_weighted")):
        whole = modeling.train_model(frame.drop(other), target)
        assert "_binned" not in fitted
        with monkeypatch.context() as few:
            few.setattr(modeling, "MERGE_FROM", 500)
            merged = modeling.train_model(frame.drop(other), target)
        assert "_binned" in fitted and merged.train_rows == whole.train_rows and merged.features == whole.features
        assert scores(merged, metric)["random_forest"] == pytest.approx(scores(whole, metric)["random_forest"], abs=0.03)
        fitted.clear()


def test_pieces_weigh_as_much_as_the_rows(spark, monkeypatch):
    from pyspark.ml.regression import RandomForestRegressor

    monkeypatch.setattr(modeling, "MERGE_FROM", 50)
    # nine tenths of the rows are alike; a value that 40 of 2000 rows have stays apart
    rows = [(float(0 if i % 50 else 1 + i % 3), float(i % 2), 10.0 if i % 50 else 0.0) for i in range(2000)]
    train = spark.createDataFrame(rows, "x double, y double, _actual double")
    given = []
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, frame: given.append(frame.select("x__bin", "y__bin", "_piece", "_actual").collect()))
    modeling._grown(RandomForestRegressor(labelCol="_actual"), train, 2000, ["x", "y"])
    pieces = given[0]
    assert sum(r["_piece"] for r in pieces) == pytest.approx(2000) and max(r["_piece"] for r in pieces) <= 2000 / 50
    assert len(pieces) < 2 * 50 and sum(r["_piece"] * r["_actual"] for r in pieces) == pytest.approx(19600)
    assert {r["x__bin"] for r in pieces} == {0.0, 1.0, 2.0, 3.0} and {r["_actual"] for r in pieces if r["x__bin"] > 0} == {0.0}


def test_cuts_of_a_forest(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("many"), (F.col("id") % 3).cast("double").alias("few"), F.lit(2.0).alias("one"),
                                  F.when(F.col("id") == 7, float("nan")).when(F.col("id") == 8, float("inf")).alias("none"))
    many, few, one, none = modeling._cuts(df, ["many", "few", "one", "none"])
    assert len(many) == 31 and many[15] == pytest.approx(500, abs=2) and few == [0.5, 1.5] and one == [2.0] and none == [0.0]


def test_segments_of_many_rows_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(0, 1, (900, 2)), rng.normal(7, 1, (500, 2)), rng.normal((0, 40), 1, (300, 2))])
    df = spark.createDataFrame(pd.DataFrame(points, columns=["x", "y"])).withColumn("same", F.lit(3.0)).repartition(5)
    want = modeling.segments(df).collect()
    monkeypatch.setattr(modeling, "MERGE_FROM", 100)
    assert modeling.segments(df).collect() == want and [r["count"] for r in want] == [900, 500, 300] or len(want) == 2
    assert modeling.segments(df, k=3).collect()[2].y_mean == pytest.approx(points[1400:, 1].mean(), abs=0.01)
    names, centers = ["x", "y"], {2: np.array([[0.0, 0.0], [1.0, 1.0]]), 3: np.array([[0.0, 0.0], [1.0, 0.0], [-50.0, 0.0]])}
    got = modeling._nearest_sums(df, names, points.mean(0), 1 / points.std(0), centers)
    scaled = (points - points.mean(0)) / points.std(0)
    for n, c in centers.items():
        away = ((scaled[:, None] - c) ** 2).sum(axis=2)
        for i in range(n):
            mine = away.argmin(axis=1) == i
            if not mine.any():
                assert i not in got[n]
                continue
            rows, cost, total = got[n][i]
            assert rows == mine.sum() and cost == pytest.approx(away[mine, i].sum()) and total == pytest.approx(points[mine].sum(axis=0))
