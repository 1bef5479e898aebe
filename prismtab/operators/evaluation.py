"""Scores of predictions, as plain aggregates over (actual, predicted) columns."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismtab.functions.coerce import col
from prismtab.functions.rounding import half_up


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted", digits: int = 6) -> DataFrame:
    """One row: rmse, mae, r2. R2 is 0 for a constant target unless every prediction is right."""
    y, p = col(actual).cast("double"), col(predicted).cast("double")
    pairs = df.select(y.alias("y"), p.alias("p")).where(F.col("y").isNotNull() & F.col("p").isNotNull())
    miss = F.col("y") - F.col("p")
    sums = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.avg(miss * miss).alias("_mse"), F.avg(F.abs(miss)).alias("_mae"),
        F.var_pop("y").alias("_spread"))
    r2 = F.when(F.col("_spread") > 0, 1 - F.col("_mse") / F.col("_spread")).otherwise(
        F.when(F.col("_mse") == 0, 1.0).otherwise(0.0))
    return sums.select(
        "n", half_up(F.sqrt("_mse"), digits).alias("rmse"), half_up(F.col("_mae"), digits).alias("mae"),
        half_up(r2, digits).alias("r2"))


def _pair_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(col(actual).cast("string").alias("actual"), col(predicted).cast("string").alias("predicted")).agg(
        F.count(F.lit(1)).alias("count"))


def classification_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted", digits: int = 6) -> DataFrame:
    """One row: accuracy and class-weighted precision, recall and F1. All after one small grouping."""
    counts = _pair_counts(df, actual, predicted)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = counts.select(F.inline(F.array(
        F.struct(F.col("actual").alias("label"), F.col("count").alias("real"), zero.alias("said"), hit.alias("hit")),
        F.struct(F.col("predicted").alias("label"), zero.alias("real"), F.col("count").alias("said"), zero.alias("hit")),
    )))
    label = sides.groupBy("label").agg(*[F.sum(c).cast("double").alias(c) for c in ("real", "said", "hit")])
    none = F.lit(0.0)
    precision = F.coalesce(F.try_divide("hit", "said"), none)
    recall = F.coalesce(F.try_divide("hit", "real"), none)
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), none)
    total = F.sum("real")
    return label.agg(
        total.cast("bigint").alias("n"), half_up(F.sum("hit") / total, digits).alias("accuracy"),
        half_up(F.sum(precision * F.col("real")) / total, digits).alias("precision_weighted"),
        half_up(F.sum(recall * F.col("real")) / total, digits).alias("recall_weighted"),
        half_up(F.sum(f1 * F.col("real")) / total, digits).alias("f1_weighted"))


def confusion_matrix(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Every pair of labels with its count, zeros included: as many rows as classes squared."""
    counts = _pair_counts(df, actual, predicted)
    labels = counts.select(F.explode(F.array("actual", "predicted")).alias("label")).agg(
        F.collect_set("label").alias("labels"))
    grid = labels.select(F.explode("labels").alias("actual"), "labels").select(
        "actual", F.explode("labels").alias("predicted"))
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("count", F.lit(0)).alias("count"))


def class_balance(df: DataFrame, label: str, limit: float = 0.9) -> DataFrame:
    """Rows and share per class, with a flag when the largest class reaches the limit."""
    counts = df.where(col(label).isNotNull()).groupBy(col(label).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("count"))
    whole = Window.partitionBy(F.lit(0))  # one row per class
    share = F.col("count") / F.sum("count").over(whole)
    return counts.select(
        "label", "count", half_up(share, 6).alias("share"), (F.max(share).over(whole) >= limit).alias("imbalanced"))


def leakage_determinism(df: DataFrame, features: list[str], target: str, limit: float = 0.9) -> DataFrame:
    """Share of each feature's values that occur with one target value only.

    One grouping of (feature, value) pairs serves all features. A value has one target value when
    its smallest and largest are equal, so no distinct count is needed."""
    words = df.select(col(target).cast("string").alias("_target"), *[col(f).cast("string").alias(f) for f in features])
    pairs = words.unpivot(["_target"], [col(f) for f in features], "feature", "value").where(
        F.col("value").isNotNull() & F.col("_target").isNotNull())
    values = pairs.groupBy("feature", "value").agg((F.min("_target") == F.max("_target")).alias("_one"))
    share = F.count_if("_one") / F.count(F.lit(1))
    return values.groupBy("feature").agg(F.count(F.lit(1)).alias("feature_values"), share.alias("_share")).select(
        "feature", "feature_values", half_up(F.col("_share"), 6).alias("determined_share"),
        (F.col("_share") >= limit).alias("near_deterministic"))
