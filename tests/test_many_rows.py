"""Models of many rows: forests grown by levels, linear models added up, sketches of sorted pieces, counts for training."""
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from prismtab.operators import forests, linear, modeling, quantiles
from prismtab.operators.profile import column_stats


def test_rows_that_differ_are_not_merged_for_a_forest(spark, monkeypatch):
    rng = np.random.default_rng(3)
    frame = spark.createDataFrame(pd.DataFrame(rng.random((2000, 4)), columns=list("abcd"))).withColumn("_actual", 5 * F.col("a") + F.col("b"))
    monkeypatch.setattr(modeling, "MERGE_FROM", 500)
    fitted = []
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, rows: fitted.append(rows.count()))
    stages = modeling._grown(RandomForestRegressor(labelCol="_actual", numTrees=3, maxDepth=4, seed=1), frame, 2000, list("abcd"))
    assert not fitted and stages[-1].getNumTrees == 3 and stages[-1].featureImportances[0] > 0.8


@pytest.mark.parametrize("depth", [3, 8])
def test_a_tree_of_all_rows_is_the_tree_of_pyspark(spark, monkeypatch, depth):
    rng = np.random.default_rng(6)
    n = 600
    rows = pd.DataFrame({"x": rng.integers(0, 20, n).astype(float), "y": rng.integers(0, 9, n).astype(float), "w__index": rng.integers(0, 3, n).astype(float)})
    rows["_actual"] = rows.x * 2 + (rows.y > 4) * rows.x + 7 * (rows.w__index == 1) + rng.normal(0, 0.5, n)
    rows["_label"] = (rows._actual > 30).astype(float)
    frame = spark.createDataFrame(rows).repartition(3)
    coded = [F.when(F.col("w__index") == w, 1.0).otherwise(0.0).alias(f"w{w}") for w in range(3)]
    vectors = VectorAssembler(inputCols=["x", "y", "w0", "w1", "w2"], outputCol="features").transform(frame.select("*", *coded))
    monkeypatch.setattr(forests, "_poisson", lambda: np.ones(65_536, np.uint8))  # every row once
    columns = forests.with_keys(modeling._cuts(frame, ["x", "y"]), [3])
    for forest, regression, weights in ((RandomForestRegressor(labelCol="_actual"), True, []), (RandomForestClassifier(labelCol="_label"), False, [1.0, 1.0])):
        forest.setParams(numTrees=1, maxDepth=depth, featureSubsetStrategy="all", subsamplingRate=1.0, bootstrap=False, seed=3)
        want = forest.fit(vectors)
        got = forests.grow(forest, frame, n, ["x", "y"], ["w__index"], columns, 100, regression, weights, "features")
        # Splits that part the rows of a small node alike are as good: one word or the other.
        shares = [[v[0], v[1], v[2:].sum()] for v in (got.featureImportances.toArray(), want.featureImportances.toArray())]
        assert shares[0] == pytest.approx(shares[1], abs=1e-3)
        wanted = [r["prediction"] for r in want.transform(vectors).orderBy("x", "y", "w__index", "_actual").collect()]
        both = got.transform(vectors).withColumn("again", got.by_keys)
        found = both.orderBy("x", "y", "w__index", "_actual").collect()
        assert [r["prediction"] for r in found] == pytest.approx(wanted) and [r["again"] for r in found] == pytest.approx(wanted)


def test_unknown_words_go_the_way_of_other_words(spark):
    frame = spark.createDataFrame([(float(i % 3), float(i % 3 == 1)) for i in range(300)], "w double, _actual double")
    columns = forests.with_keys([], [3])
    model = forests.grow(RandomForestRegressor(labelCol="_actual", numTrees=5, maxDepth=2, featureSubsetStrategy="all", seed=1), frame, 300, [], ["w"], columns, 300, True, [], "features")
    new = spark.createDataFrame([(0.0,), (1.0,), (3.0,)], "w double").withColumn("p", model.by_keys).collect()
    assert [r["p"] for r in new] == pytest.approx([0.0, 1.0, 0.0])


def test_linear_models_of_many_rows_equal_those_of_vectors(spark, monkeypatch):
    rng = np.random.default_rng(9)
    n = 900
    rows = pd.DataFrame({"a": rng.normal(5, 3, n), "b": rng.normal(0, 1, n), "word": rng.choice(["p", "q", "r"], n)})
    rows["sales"] = 2 * rows.a - rows.b + 4 * (rows.word == "p") + rng.normal(0, 1, n)
    rows["kind"] = np.where(rows.sales + rng.normal(0, 4, n) > 11, "up", "down")
    frame = spark.createDataFrame(rows)
    monkeypatch.setitem(modeling.FOREST, "numTrees", 2)
    monkeypatch.setitem(modeling.FOREST, "maxDepth", 2)
    for target, other, name in (("sales", "kind", "ridge"), ("kind", "sales", "logistic")):
        few = dict(((m, metric), v) for m, metric, v in modeling.train_model(frame.drop(other), target).scores)
        with monkeypatch.context() as many:
            many.setattr(modeling, "MERGE_FROM", 300)
            seen = []
            for way in ("ridge", "logistic"):
                many.setattr(linear, way, lambda *args, way=way, real=getattr(linear, way): seen.append(way) or real(*args))
            result = modeling.train_model(frame.drop(other), target)
        assert seen == [name]
        for (m, metric), v in dict(((m, metric), v) for m, metric, v in result.scores).items():
            if m == name:
                assert v == pytest.approx(few[m, metric], abs=1e-3), (m, metric)
        assert result.predictions.count() == result.test_rows


def test_newton_reaches_the_optimum(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 2))
    y = (x @ [2.0, -1.0] + rng.normal(size=500) > 0.3).astype(float)
    frame = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    line = LogisticRegression(labelCol="y", regParam=1 / 500, elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-12)
    want = line.fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(frame))
    inputs = linear.Inputs(["a", "b"], [], np.zeros(2), np.ones(2), [])
    got = linear.logistic(line, frame, inputs, [1.0, 1.0], frame.limit(50))
    assert got.coefficients.toArray() == pytest.approx(want.coefficients.toArray(), abs=1e-5) and got.intercept == pytest.approx(want.intercept, abs=1e-5)


def test_medians_from_sorted_pieces(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=5000), rng.integers(0, 3, 5000).astype(float)
    frame = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).withColumn("y", F.when(F.col("y") > 0, F.col("y"))).repartition(4)
    for name, value in (("SORT_FROM", 100), ("PIECE_ROWS", 700), ("PIECE_POINTS", 50)):
        monkeypatch.setattr(quantiles, name, value)
    used = []
    monkeypatch.setattr(quantiles, "sorted_points", lambda values, real=quantiles.sorted_points: used.append(values.columns) or real(values))
    found = quantiles.exact_quantiles(frame, ["x", "y"], [0.5, 0.9], in_one_bracket=90)
    assert used and found["x"] == pytest.approx(list(np.quantile(x, [0.5, 0.9]))) and found["y"] == pytest.approx(list(np.quantile(y[y > 0], [0.5, 0.9])))


def test_numbers_that_need_no_count(spark):
    frame = spark.createDataFrame([(i, 1.0, None, i * 0.5, str(i % 3)) for i in range(60)], "item_id long, one double, none double, size double, word string")
    exact, loose = ({s.name: s for s in column_stats(frame, uncounted=some)} for some in ((), ("one", "none", "size")))
    assert [loose[c].distinct for c in ("item_id", "one", "none", "size", "word")] == [60, 1, 0, 2, 3] and exact["size"].distinct == 60
    names = [s.name for s in modeling._training_stats(frame, ["size"], False)]
    assert names == frame.columns and modeling._training_stats(frame, ["size"], False)[0].identifier_like
