"""Versions of datasets, column meanings and models: broken saves, damaged versions, fall-back."""
import glob
import os

import pytest

from prismtab.operators import modeling, roles
from prismtab.operators.profile import column_stats
from prismtab.sources import store


def values(df):
    return sorted(r[0] for r in df.collect())


def frame(spark, *numbers):
    return spark.createDataFrame([(n, f"t{n}") for n in numbers], "n int, `odd name` string")


def test_newest_version_wins(spark, tmp_path):
    path = store.dataset_path(str(tmp_path), "d")
    with pytest.raises(store.NothingStored):
        store.load_dataset(spark, path)
    first, second = store.save_dataset(frame(spark, 1), path), store.save_dataset(frame(spark, 2, 3), path)
    assert first < second and values(store.load_dataset(spark, path)) == [2, 3]
    assert store.load_facts(spark, path).first()["row_count"] == 2
    assert [n for n, _, _ in store.versions(spark, path, "data")] == [2, 1]


def test_a_save_that_breaks_off_leaves_the_old_version(spark, tmp_path):
    path = store.dataset_path(str(tmp_path), "d")
    store.save_dataset(frame(spark, 1), path)
    broken = frame(spark, 2).selectExpr("n", "raise_error('lost') AS x")
    with pytest.raises(Exception, match="lost"):
        store.save_dataset(broken, path)
    assert len(glob.glob(f"{path}/data/v*")) == 2  # the parts that were begun
    assert values(store.load_dataset(spark, path)) == [1]
    store.save_dataset(frame(spark, 4), path)
    assert values(store.load_dataset(spark, path)) == [4]


def test_a_damaged_version_falls_back(spark, tmp_path):
    path = store.dataset_path(str(tmp_path), "d")
    store.save_dataset(frame(spark, 1), path)
    newest = store.save_dataset(frame(spark, *range(50)).repartition(4), path)
    for file in glob.glob(f"{path}/data/{newest}/data/part-*")[:1]:
        os.remove(file)
    assert values(store.load_dataset(spark, path)) == [1]
    for file in glob.glob(f"{path}/data/v*/data/part-*"):
        os.remove(file)
    with pytest.raises(store.NothingStored, match="version 2.*version 1"):
        store.load_dataset(spark, path)


def test_sessions_fall_back_to_their_dataset(spark, tmp_path):
    root = str(tmp_path)
    store.save_dataset(frame(spark, 7), store.dataset_path(root, "d"))
    assert values(store.load_session(spark, root, "s", "d")) == [7]
    store.save_dataset(frame(spark, 8), store.session_path(root, "s"))
    assert values(store.load_session(spark, root, "s", "d")) == [8]
    with pytest.raises(store.NothingStored):
        store.load_session(spark, root, "other")


def test_meanings_with_metrics(spark, tmp_path):
    df = spark.createDataFrame([("SALE", 5.0, "2024-01-01")] * 3, "type string, amount double, date string")
    found = roles.metric_roles(column_stats(df))
    known = roles.metric_map(found)
    store.save_roles(spark, found, str(tmp_path), known)
    assert store.load_roles(spark, str(tmp_path)) == found and store.load_metrics(spark, str(tmp_path)) == known
    store.save_roles(spark, {"a": "amount"}, str(tmp_path))
    assert store.load_metrics(spark, str(tmp_path)) is None and store.load_roles(spark, str(tmp_path)) == {"a": "amount"}


def test_models_with_scores(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 7) * 3 + i % 3) for i in range(120)], "row_key long, x double, sales double")
    run = modeling.train_model(df, "sales", "regression", ["row_key"])
    store.save_model(run, str(tmp_path), spark)
    facts = store.load_model_facts(str(tmp_path), spark)
    assert facts["target"] == "sales" and facts["features"] == run.features and [tuple(s) for s in facts["scores"]] == run.scores
    again = store.load_model(str(tmp_path), spark)
    assert type(again.stages[-1]) is type(run.model.stages[-1]) and len(again.stages) == len(run.model.stages)
