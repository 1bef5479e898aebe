"""Simple supervised models and segments on `pyspark.ml`."""
from __future__ import annotations

import math
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (
    Bucketizer, IndexToString, OneHotEncoder, OneHotEncoderModel, SQLTransformer, StandardScaler, StandardScalerModel,
    StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from prismtab.functions.coerce import col, is_number, number, numeric_columns
from prismtab.functions.rounding import half_up, half_up_value
from prismtab.operators import forests, linear
from prismtab.operators.evaluation import class_balance, classification_metrics, leakage_determinism, regression_metrics
from prismtab.operators.moments import co_moments
from prismtab.operators.profile import ColumnStats, column_stats, identifier_name, local_frame, top_values, value_counts
from prismtab.operators.quantiles import at_shares, exact_quantiles, sorted_points
from prismtab.operators.targets import MOST_VALUES, choose_target, exclusion, target_for_metric

# Gates and settings of the models.
MIN_ROWS = 30
MIN_COMPLETE_ROWS = 20
AUTO_CONFIDENCE = 0.65
MOST_CODES = 200  # indicator columns, unless the caller says otherwise
FEW_CLASSES = 50  # whose cuts are part of the query
MAX_CLASSES = 1000  # classes of a target that a model is trained for
RIDGE_ALPHA = 1.0
FOREST = {"numTrees": 80, "maxDepth": 8, "seed": 42}
QUICK_FOREST = {"numTrees": 100, "maxDepth": 10, "seed": 42}
FOREST_MEMORY_MB = 1024  # more nodes per pass over the data
MAX_BINS = 32  # bins of a number in a forest, as Spark's
MERGE_FROM = 250_000  # rows; beyond them, rows that look alike to a forest are merged, if there can be as few cells
ROWS_IN_TASK = 1_000_000  # of a table that is kept
MOST_PASSES, MOVED = 20, 1e-4  # K-means, as Spark's


@dataclass
class Training:
    """What came out of a training run; only `status` and `reason` are set when it was skipped."""

    status: str
    reason: str = ""
    target: str | None = None
    task: str | None = None
    features: list[str] = field(default_factory=list)
    scores: list[tuple[str, str, float]] = field(default_factory=list)  # model, metric, value
    selected: str | None = None
    model: PipelineModel | None = None
    predictions: DataFrame | None = None  # actual, predicted and the original columns
    train_rows: int = 0
    test_rows: int = 0
    limitations: list[str] = field(default_factory=list)


def hash_split(df: DataFrame, train_percent: int, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the row (or of key columns).

    The same row always falls on the same side, whatever the partitioning, and equal rows stay
    together, so no copy of a training row is tested."""
    bucket = F.pmod(F.xxhash64(F.lit(42), *[col(c) for c in keys or df.columns]), F.lit(100))
    return df.where(bucket < train_percent), df.where(bucket >= train_percent)


def stratified_split(
    df: DataFrame, label: str, train_percent: int, keys: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Like ``hash_split``, with the wanted share of each class: the cut is a quantile of the hashes of
    the class, from a sketch of bounded size that is exact for small classes. Equal rows stay together."""
    # 52 bits: the sketch works on doubles, which hold them exactly.
    marked = df.withColumn("_mark", F.shiftrightunsigned(F.xxhash64(F.lit(42), *[col(c) for c in keys or df.columns]), 12))
    cuts = marked.groupBy(F.col(label).alias("_class")).agg(
        F.percentile_approx("_mark", train_percent / 100, 10_000).alias("_cut"))  # one row per class
    few = cuts.limit(FEW_CLASSES + 1).collect() if isinstance(df.schema[label].dataType, T.StringType) else []
    if 0 < len(few) <= FEW_CLASSES:  # no join, which would bring the rows of a class together, and each pass does not look again
        cut = F.lit(None).cast("bigint")
        for row in few:
            cut = F.when(col(label).eqNullSafe(F.lit(row["_class"])), F.lit(row["_cut"])).otherwise(cut)
        placed = marked.withColumn("_cut", cut)
    else:
        placed = marked.join(cuts, F.col(label).eqNullSafe(F.col("_class")))
    train, test = (placed.where(side) for side in (F.col("_mark") <= F.col("_cut"), F.col("_mark") > F.col("_cut")))
    return train.select(*map(col, df.columns)), test.select(*map(col, df.columns))


def _kept(df: DataFrame) -> DataFrame:
    """Data that a model passes over many times: spread evenly once, then kept in memory and on disk."""
    return df.hint("rebalance").persist(StorageLevel.MEMORY_AND_DISK)


def _numeric_feature(df: DataFrame, name: str) -> bool:
    kind = df.schema[name].dataType
    return is_number(kind) or isinstance(kind, T.BooleanType)


def _prepared(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Numbers as doubles, everything else as text."""
    values = [(number(df, f) if _numeric_feature(df, f) else col(f).cast("string")).alias(f) for f in features]
    return df.select(*[col(k) for k in keep], *values)


def _common_texts(df: DataFrame, features: list[str]) -> dict[str, str]:
    """The most common text of each text feature."""
    words = [f for f in features if not _numeric_feature(df, f)]
    found = {r["column_name"]: r["value"] for r in top_values(value_counts(df, words), 1).collect()} if words else {}
    return {word: found.get(word, "") for word in words}


def _preprocessing(df: DataFrame, features: list[str], train: DataFrame) -> list:
    """Median of the training rows and scaling for numbers, indicator columns for text (unknown words get all zeros)."""
    numbers = [f for f in features if _numeric_feature(df, f)]
    words = [f for f in features if f not in numbers]
    stages: list = []
    if numbers:
        filled = [f"{n}__filled" for n in numbers]
        stages += [
            _median_filler(train, numbers, filled),
            VectorAssembler(inputCols=filled, outputCol="_numbers"),
            StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
        ]
    if words:
        indexed, coded = [f"{w}__index" for w in words], [f"{w}__code" for w in words]
        stages += [
            StringIndexer(inputCols=words, outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=True),
        ]
    parts = (["_scaled"] if numbers else []) + ([f"{w}__code" for w in words])
    return stages + [VectorAssembler(inputCols=parts, outputCol="features")]


def _median_filler(train: DataFrame, columns: list[str], filled: list[str]) -> SQLTransformer:
    """Adds the columns with their gaps filled by the exact median of the training rows; 0 where all is gap."""
    medians = {name: found[0] for name, found in exact_quantiles(train, columns, [0.5]).items()}
    added = ", ".join(f"coalesce({_quoted(c)}, {medians[c] or 0.0!r}D) AS {_quoted(f)}" for c, f in zip(columns, filled))
    return SQLTransformer(statement=f"SELECT *, {added} FROM __THIS__")


def feature_names(fitted: PipelineModel, df: DataFrame, features: list[str]) -> list[str]:
    """Names of the vector positions: numbers first, then one per word of each text column."""
    names = [f for f in features if _numeric_feature(df, f)]
    words = [f for f in features if f not in names]
    for stage in fitted.stages:
        if hasattr(stage, "labelsArray"):
            for word, labels in zip(words, stage.labelsArray):
                names += [f"{word}_{label}" for label in labels]
    return names


def _ridge(train: DataFrame, label: str) -> LinearRegression:
    """Ridge with the penalty on the scale the solver uses."""
    row = train.agg(F.stddev_pop(label).alias("spread"), F.count(label).alias("n")).first()
    penalty = RIDGE_ALPHA * (row["spread"] or 0.0) / max(1, row["n"])
    return LinearRegression(labelCol=label, solver="normal", regParam=penalty, elasticNetParam=0.0, standardization=False)


def _safe_features(
    stats: list[ColumnStats], target: str, limitations: list[str], ids_by_name: bool = False, most_values: int = MOST_VALUES,
) -> list[str]:
    kept = []
    for s in stats:
        reason = exclusion(s, target, ids_by_name, most_values)
        if reason is None:
            kept.append(s.name)
        elif reason != "target":
            limitations.append(f"left out {s.name}: {reason}")
    return kept


def train_model(
    df: DataFrame, target: str | None = None, task: str | None = None, keys: list[str] | None = None,
    ids_by_name: bool = False, stats: list[ColumnStats] | None = None, metric: str | None = None,
    most_codes: int | None = MOST_CODES, most_values: int = MOST_VALUES,
) -> Training:
    """Fit the candidates for a target, score them on held-out rows and keep the best one.

    Without a target the column that stands for the metric is used, and without a metric the best
    suggestion if its confidence is high enough. The baseline (mean or most common class) is scored but
    never selected. ``most_codes`` bounds the indicator columns (None: any number), ``most_values`` the
    values of a text feature."""
    if target is None and metric is not None:
        target, task = target_for_metric(df.columns, metric)
        if target is None:
            return Training("skipped", f"no column for {metric}")
    with _passed_over(df, stats[0].rows if stats else None) as kept:
        return _trained(kept, target, task, keys, ids_by_name, stats, most_codes, most_values)


@contextmanager
def _passed_over(df: DataFrame, rows: int | None):
    """A table of many rows spread evenly and kept in memory and on disk while it is passed over; a small one as it is."""
    rows = 0 if df.storageLevel.useMemory or df.storageLevel.useDisk else df.count() if rows is None else rows
    if rows <= MERGE_FROM:
        yield df
        return
    cores = df.sparkSession.sparkContext.defaultParallelism
    kept = df.repartition(cores * max(3, math.ceil(rows / ROWS_IN_TASK / cores))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def _training_stats(df: DataFrame, targets: list[str | None], ids_by_name: bool) -> list[ColumnStats]:
    """Statistics that choose features, and targets that are not given. With given targets, how many values a number has
    only matters where its name may mark an identifier."""
    if not all(targets):
        return column_stats(df)
    return column_stats(df, uncounted=[f.name for f in df.schema.fields if _numeric_feature(df, f.name) and (ids_by_name or not identifier_name(f.name))])


def _trained(
    df: DataFrame, target: str | None, task: str | None, keys: list[str] | None, ids_by_name: bool,
    stats: list[ColumnStats] | None, most_codes: int | None, most_values: int,
) -> Training:
    stats = _training_stats(df, [target and task], ids_by_name) if stats is None else stats
    rows = stats[0].rows if stats else 0
    if rows < MIN_ROWS:
        return Training("skipped", f"{rows} rows, at least {MIN_ROWS} are needed")
    if task is None or target is None:
        choice = choose_target(stats, target, 0.0 if target else AUTO_CONFIDENCE)
        if choice is None:
            return Training("skipped", "no safe target column with enough confidence")
        target, task = choice[0], task or choice[1]
    limitations: list[str] = []
    features = _safe_features(stats, target, limitations, ids_by_name, most_values)
    if not features:
        return Training("skipped", "no safe feature columns", target, task, limitations=limitations)
    codes = sum(max(1, s.distinct) for s in stats if s.name in features and s.kind not in ("number", "bool"))
    if most_codes is not None and codes > most_codes:
        return Training("skipped", "too many indicator columns", target, task, limitations=limitations)
    if task == "classification":
        limitations += leakage_notes(df, target, features)
    result = Training("complete", "", target, task, features, limitations=limitations)
    _fit(df, keys or [], result, rows)
    return result


# Features that may give a category of food away.
CATEGORY_WORDS = ("food_name", "food_description", "main_ingredient", "cuisine")


def leakage_notes(df: DataFrame, target: str, features: list[str]) -> list[str]:
    """Notes on text features whose values nearly always occur with one class."""
    notes = []
    if target.lower() == "category" and any(f.lower() in CATEGORY_WORDS for f in features):
        notes.append("possible leakage: names, descriptions and kinds of dishes can give the category away")
    words = [f for f in features if not _numeric_feature(df, f)]
    if words:
        found = leakage_determinism(df, words, target).where("near_deterministic").select("feature").collect()  # features only
        notes += [f"possible leakage: {r['feature']} nearly determines {target}" for r in sorted(found)]
    return notes


def _fit(df: DataFrame, keys: list[str], result: Training, rows: int) -> None:
    regression = result.task == "regression"
    actual = number(df, result.target) if regression else col(result.target).cast("string")
    labelled = df.withColumn("_actual", actual).where(F.col("_actual").isNotNull())
    if not regression and class_balance(labelled, "_actual").where("imbalanced").count():
        result.limitations.append("one class holds 90% of the rows or more")
    data = _prepared(labelled, result.features, ["_actual", *[k for k in keys if k not in result.features]])
    train, test = hash_split(data, 75, keys or None) if regression else stratified_split(data, "_actual", 75, keys or None)
    common = _common_texts(train, result.features)  # of training rows only
    train, test = (side.fillna(common) if common else side for side in (train, test))
    prepared = Pipeline(stages=_preprocessing(df, result.features, train)).fit(train)
    held = [prepared.transform(side) for side in (train, test)]
    many = rows > MERGE_FROM  # then only the table itself is kept, not its vectors
    if not many:
        held = list(map(_kept, held))
    try:
        result.train_rows, result.test_rows = (side.count() for side in held)
        numbers = [f"{f}__filled" for f in result.features if _numeric_feature(df, f)]
        words = [f"{f}__index" for f in result.features if not _numeric_feature(df, f)]
        encoder = [stage for stage in prepared.stages if isinstance(stage, OneHotEncoderModel)]
        scaler = [stage for stage in prepared.stages if isinstance(stage, StandardScalerModel)]
        fitted = (_regressors if regression else _classifiers)(held[0], result.train_rows, numbers, words, encoder, scaler)
        best = None
        for name, model in fitted:
            scored = _scored(model, held[1])
            metrics = (regression_metrics if regression else classification_metrics)(scored).first().asDict()
            score = metrics["r2" if regression else "f1_weighted"]
            result.scores += [(name, m, float(v)) for m, v in metrics.items() if m != "n" and v is not None]
            if not name.startswith("baseline") and (best is None or score > best[0]):
                best = (score, name, model)
        result.selected = best[1]
        result.model = PipelineModel(stages=[*prepared.stages, *best[2]])
        if dict((m, v) for n, m, v in result.scores if n == best[1]).get("accuracy") == 1.0:
            result.limitations.append("perfect accuracy may mean that a feature gives the target away")
    finally:
        for side in [] if many else held:
            side.unpersist()
    result.predictions = _scored([result.model], test)


def _scored(stages, frame: DataFrame) -> DataFrame:
    """(actual, predicted, ...) of a list of fitted stages, or of a constant."""
    if isinstance(stages, Column):
        return frame.select(F.col("_actual").alias("actual"), stages.alias("predicted"))
    frame = predict(stages, frame)
    predicted = F.col("predicted") if "predicted" in frame.columns else F.col("prediction")
    return frame.withColumn("actual", F.col("_actual")).withColumn("predicted", predicted)


def predict(stages: list, frame: DataFrame) -> DataFrame:
    """The frame after all stages. A forest that was grown from keys of bins finds its leaves by them: walking through
    many trees costs far more for each row."""
    for i, stage in enumerate(stages):
        by_keys = next((s.by_keys for s in stages[i:i + 2] if hasattr(s, "by_keys")), None)
        if by_keys is None:
            frame = stage.transform(frame)
        elif hasattr(stage, "by_keys"):
            frame = frame.withColumn("prediction", by_keys)
    return frame


def _regressors(train: DataFrame, rows: int, numbers: list[str], words: list[str], encoder: list, scaler: list) -> list:
    mean = train.agg(F.avg("_actual")).first()[0]
    forest = RandomForestRegressor(labelCol="_actual", maxMemoryInMB=FOREST_MEMORY_MB, featureSubsetStrategy="all", **FOREST)
    return [("baseline_mean", F.lit(mean)), ("ridge", [_line_through(train, rows, _inputs(numbers, words, encoder, scaler))]),
            ("random_forest", _grown(forest, train, rows, numbers, words, encoder))]


def _classifiers(train: DataFrame, rows: int, numbers: list[str], words: list[str], encoder: list, scaler: list) -> list:
    counts = {r["_actual"]: r["count"] for r in train.groupBy("_actual").count().limit(MAX_CLASSES + 1).collect()}
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"the target has more than {MAX_CLASSES} classes; it is no label")
    common = min(counts, key=lambda c: (-counts[c], c))
    total, classes = sum(counts.values()), len(counts)
    weight = F.try_divide(F.lit(total / classes), F.element_at(
        F.create_map(*[F.lit(x) for pair in counts.items() for x in pair]), F.col("_actual")))
    indexer = StringIndexer(inputCol="_actual", outputCol="_label").fit(train)  # only training rows are indexed
    balanced = indexer.transform(train.withColumn("_weight", weight))
    to_text = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)
    line = LogisticRegression(labelCol="_label", weightCol="_weight", maxIter=1000,
                              regParam=1 / total, elasticNetParam=0.0, standardization=False)
    forest = RandomForestClassifier(labelCol="_label", weightCol="_weight", maxMemoryInMB=FOREST_MEMORY_MB, **FOREST)
    return [("baseline_most_common", F.lit(common)), ("logistic", [_line_between(line, balanced, rows, classes, _inputs(numbers, words, encoder, scaler)), to_text]),
            ("random_forest", [*_grown(forest, balanced, rows, numbers, words, encoder), to_text])]


def _inputs(numbers: list[str], words: list[str], encoder: list, scaler: list) -> linear.Inputs:
    mean, spread = (scaler[0].mean.toArray(), scaler[0].std.toArray()) if scaler else (np.zeros(0), np.zeros(0))
    return linear.Inputs(numbers, words, mean, np.divide(1, spread, out=np.zeros_like(spread), where=spread > 0), _code_counts(encoder))


def _line_through(train: DataFrame, rows: int, inputs: linear.Inputs):
    """A fitted ridge; many rows are added up in one pass."""
    if rows <= MERGE_FROM or inputs.width > linear.MOST_FEATURES:
        return _ridge(train, "_actual").fit(train)
    return linear.ridge(LinearRegression(labelCol="_actual", solver="normal", standardization=False), train, inputs, RIDGE_ALPHA)


def _line_between(line: LogisticRegression, train: DataFrame, rows: int, classes: int, inputs: linear.Inputs):
    """A fitted logistic regression. Of many rows in two classes by Newton's method, which needs few passes; its first
    steps are made on about ``MERGE_FROM`` rows."""
    if rows <= MERGE_FROM or classes != 2 or inputs.width > linear.MOST_FEATURES:
        return line.fit(train)
    return linear.logistic(line, train, inputs, _class_weights(train, line.getLabelCol()), train.sample(MERGE_FROM / rows, seed=42))


def _code_counts(encoder: list) -> list[int]:
    """Number of indicators of each word column."""
    return [size - 1 for stage in encoder for size in stage.categorySizes]


def _class_weights(train: DataFrame, label: str) -> list[float]:
    """The weight of each class, in the order of its index."""
    each = F.max("_weight") if "_weight" in train.columns else F.lit(1.0)
    return [r["each"] for r in sorted(train.groupBy(label).agg(each.alias("each")).collect())]  # one row per class


def score_table(df: DataFrame, result: Training) -> DataFrame:
    """(model, metric, value, selected) of every candidate."""
    rows = [(n, m, half_up_value(v, 6), n == result.selected) for n, m, v in result.scores]
    return local_frame(df.sparkSession, rows, "model string, metric string, value double, selected boolean")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _cuts(train: DataFrame, columns: list[str], bins: int = MAX_BINS) -> list[list[float]]:
    """Where a forest may split each column: between all values of a column with few of them, else at quantiles."""
    points = sorted_points(train.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))
    found = []
    for values, many in points.values():
        values, at = np.unique(values, return_inverse=True)
        if len(values) <= bins:
            cuts = [a + (b - a) / 2 for a, b in zip(values.tolist(), values[1:].tolist())]
        else:
            cuts = at_shares(values, np.bincount(at, many), [i / bins for i in range(1, bins)])
        found.append(sorted(set(cuts)) or [float(values[0]) if len(values) else 0.0])
    return found


def _binner(train: DataFrame, columns: list[str], bins: list[str], most: int = MAX_BINS, cuts: list[list[float]] | None = None) -> list:
    """Stages that add the bin of each column as a number."""
    if not columns:
        return []
    buckets = [f"{b}__bucket" for b in bins]
    splits = [[-math.inf, *found, math.inf] for found in cuts or _cuts(train, columns, most)]
    # Buckets are marked as categories; the forest shall split them in their order.
    plain = ", ".join(f"CAST({_quoted(k)} AS float) AS {_quoted(b)}" for k, b in zip(buckets, bins))
    return [Bucketizer(inputCols=columns, outputCols=buckets, splitsArray=splits, handleInvalid="keep"),
            SQLTransformer(statement=f"SELECT *, {plain} FROM __THIS__")]


def _grown(forest, train: DataFrame, rows: int, numbers: list[str], words: list[str] = (), encoder: list = ()) -> list:
    """A forest fitted to the training rows, with the stages before it.

    A forest sees a number only through its bins. More than ``MERGE_FROM`` rows are grown level by level from their bins
    (``forests``), unless there can be fewer cells than that many: then, of more than ``MERGE_FROM`` rows, those with the same bins, words
    and class (the mean target, in a regression) are merged into one that weighs as much, so the number of rows is
    bounded by the number of such cells. Cells are cut into equal pieces of at most 1 / ``MERGE_FROM`` of all rows:
    a piece is drawn for a tree as one row would be, and no draw decides on a large share of the rows.
    `words` are indexed columns, which `encoder` turns into indicators."""
    if rows <= MERGE_FROM:
        return [forest.fit(train)]
    label, regression = forest.getLabelCol(), isinstance(forest, RandomForestRegressor)
    cuts = _cuts(train, numbers) if numbers else []
    columns = forests.with_keys(cuts, _code_counts(encoder))
    weights = [] if regression else _class_weights(train, label)
    if math.prod(columns.bins) * max(1, len(weights)) > MERGE_FROM:
        codes = [c for stage in encoder for c in stage.getOutputCols()]
        return [VectorAssembler(inputCols=[*numbers, *codes], outputCol="_binned"),
                forests.grow(forest, train, rows, numbers, words, columns, MERGE_FROM, regression, weights, "_binned")]
    bins = [f"{n}__bin" for n in numbers]
    stages = _binner(train, numbers, bins, cuts=cuts)
    for stage in stages:
        train = stage.transform(train)
    target = [F.avg(label).alias(label)] if regression else []
    each = F.max("_weight") if "_weight" in train.columns else F.lit(1.0)  # one weight per class
    cells = train.groupBy(*map(col, [*bins, *words, *([] if regression else [label])])).agg(
        F.count(F.lit(1)).alias("_rows"), each.alias("_each"), *target).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tasks = max(32, math.ceil(cells.count() / 20_000))
        pieces = F.ceil(F.col("_rows") * MERGE_FROM / rows).cast("int")
        spread = cells.repartition(tasks).withColumn("_piece", F.explode(F.array_repeat(F.col("_rows") * F.col("_each") / pieces, pieces)))
        for stage in encoder:
            spread = stage.transform(spread)
        codes = [c for stage in encoder for c in stage.getOutputCols()]
        stages.append(VectorAssembler(inputCols=[*bins, *codes], outputCol="_binned"))
        fitted = forest.copy({forest.weightCol: "_piece", forest.featuresCol: "_binned"}).fit(stages[-1].transform(spread))
    finally:
        cells.unpersist()
    return [*stages, fitted]


def _fitted_estimator(result: Training):
    return next(s for s in reversed(result.model.stages) if hasattr(s, "featureImportances")
                or hasattr(s, "coefficientMatrix") or hasattr(s, "coefficients"))


def importance_values(estimator) -> list[float]:
    """Tree importances, or the mean absolute coefficient per feature."""
    if hasattr(estimator, "featureImportances"):
        return [float(v) for v in estimator.featureImportances.toArray()]
    if hasattr(estimator, "coefficientMatrix"):
        return [float(v) for v in abs(estimator.coefficientMatrix.toArray()).mean(axis=0)]
    return [abs(float(v)) for v in estimator.coefficients.toArray()]


def feature_importance(df: DataFrame, result: Training, limit: int = 20) -> DataFrame:
    """Share of each feature in the selected model, largest first."""
    values = importance_values(_fitted_estimator(result))
    total = sum(values)
    pairs = sorted(zip(feature_names(result.model, df, result.features), values), key=lambda p: (-p[1], p[0]))
    rows = [(name, half_up_value(v / total, 6)) for name, v in pairs[:limit]] if total > 0 else []
    return local_frame(df.sparkSession, rows, "feature string, importance double")


def top_features(importance: DataFrame, limit: int = 5) -> DataFrame:
    return importance.orderBy(F.desc("importance"), F.asc("feature")).limit(limit)


def local_contributions(df: DataFrame, target: str, features: list[str], keys: list[str], top: int = 5) -> DataFrame:
    """What moved each row's linear prediction away from the average: coefficient times the scaled
    distance from the mean, the strongest features per row."""
    data = _prepared(df.withColumn("_actual", number(df, target)).where(F.col("_actual").isNotNull()),
                     features, ["_actual", *[k for k in keys if k not in features]])
    common = _common_texts(data, features)
    data = data.fillna(common) if common else data
    prepared = Pipeline(stages=_preprocessing(df, features, data)).fit(data)
    ready = prepared.transform(data)
    model = _ridge(ready, "_actual").fit(ready)
    names = feature_names(prepared, df, features)
    parts = F.transform(
        F.arrays_zip(F.array(*map(F.lit, names)).alias("name"),
                     F.array(*[F.lit(float(c)) for c in model.coefficients]).alias("weight"),
                     vector_to_array("features").alias("x")),
        lambda p: F.struct((-F.abs(p["weight"] * p["x"])).alias("order"), p["name"].alias("feature"),
                           half_up(p["weight"] * p["x"], 6).alias("contribution")))
    strongest = F.slice(F.array_sort(parts), 1, top)
    return ready.select(*map(col, keys), F.explode(strongest).alias("p")).select(
        *map(col, keys), "p.feature", "p.contribution")


def prediction_sample(result: Training, keys: list[str], rows: int = 10) -> DataFrame:
    return result.predictions.select(*map(col, keys), "actual", "predicted").orderBy(*map(col, keys)).limit(rows)


def quick_predict(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """Numeric features only, complete rows only, one model, an 80/20 split.

    Classes when the target is text, boolean or has at most 20 values; else a straight line up to
    three features and a forest beyond."""
    names = [n for n in numeric_columns(df) if n != target] if features is None else features
    kind = df.schema[target].dataType
    few = is_number(kind) and df.select(target).distinct().limit(21).count() <= 20
    classes = few or not is_number(kind)
    actual = col(target).cast("string") if classes else number(df, target)
    data = df.select(actual.alias("_actual"), *[number(df, n).alias(n) for n in names]).dropna()
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(data)
    train, test = hash_split(assembled, 80, ["_actual", *names])
    train, test = _kept(train), _kept(test)
    try:
        rows = train.count()
        if rows + test.count() < MIN_COMPLETE_ROWS:
            raise ValueError(f"at least {MIN_COMPLETE_ROWS} complete rows are needed")
        if classes:
            indexer = StringIndexer(inputCol="_actual", outputCol="_label").fit(train)
            forest = RandomForestClassifier(labelCol="_label", maxMemoryInMB=FOREST_MEMORY_MB, **QUICK_FOREST)
            back = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)
            name, stages = "random_forest", [*_grown(forest, indexer.transform(train), rows, names), back]
            metrics = classification_metrics(_scored(stages, test), digits=2).first()
            shown = [("accuracy", metrics["accuracy"]), ("f1_weighted", metrics["f1_weighted"])]
        else:
            if len(names) <= 3:
                name, stages = "linear", [LinearRegression(labelCol="_actual", solver="normal").fit(train)]
            else:
                name = "random_forest"
                forest = RandomForestRegressor(labelCol="_actual", maxMemoryInMB=FOREST_MEMORY_MB, featureSubsetStrategy="all", **QUICK_FOREST)
                stages = _grown(forest, train, rows, names)
            metrics = regression_metrics(_scored(stages, test), digits=2).first()
            shown = [("r2", metrics["r2"]), ("rmse", metrics["rmse"])]
        fitted = next(s for s in reversed(stages) if hasattr(s, "featureImportances") or hasattr(s, "coefficients"))
        weights = sorted(zip(names, importance_values(fitted)), key=lambda p: (-p[1], p[0]))[:10]
    finally:
        train.unpersist()
        test.unpersist()
    rows = [(name, "metric", m, v) for m, v in shown]
    rows += [(name, "importance", f, half_up_value(v, 4)) for f, v in weights]
    return local_frame(df.sparkSession, rows, "model string, kind string, name string, value double")


def batch_train(df: DataFrame, targets: dict[str, str], keys: list[str] | None = None) -> dict[str, Training]:
    """The best model per target of one wide table; its statistics are computed once."""
    with _passed_over(df, None) as kept:
        stats = _training_stats(kept, [t and task for t, task in targets.items()], ids_by_name=True)
        return {t: train_model(kept, t, task, keys, ids_by_name=True, stats=stats) for t, task in targets.items()}


def batch_table(df: DataFrame, trained: dict[str, Training]) -> DataFrame:
    rows = [(t, r.task, r.selected, m, half_up_value(v, 6)) for t, r in trained.items()
            for n, m, v in r.scores if n == r.selected]
    return local_frame(df.sparkSession, rows, "target string, task string, model string, metric string, value double")


def linear_targets(df: DataFrame, targets: list[str], features: list[str], alpha: float = 0.0) -> DataFrame:
    """(target, feature, coefficient, r2) of a straight line for each target, over complete rows; the feature
    `intercept` has the constant. All targets share the co-moments of one scan; the equations have one row per
    feature. `alpha` is a ridge penalty on standardized features."""
    names = [*features, *targets]
    found = co_moments(df.select(*(number(df, n).alias(n) for n in names)).dropna(), names)
    f = len(features)
    inner, n = found.product[:f, :f], max(1.0, float(found.n[0, 0]))
    spread = np.diag(inner)
    rows = []
    for i, target in enumerate(targets, f):
        weights = np.linalg.lstsq(inner + alpha * np.diag(spread) / n, found.product[:f, i], rcond=None)[0]
        whole = found.product[i, i]
        left = whole - 2 * weights @ found.product[:f, i] + weights @ inner @ weights
        r2 = None if whole <= 0 else half_up_value(1 - left / whole, 6)
        constant = found.mean[i, i] - weights @ np.diag(found.mean)[:f]
        rows += [(target, name, half_up_value(float(w), 6), r2) for name, w in zip([*features, "intercept"], [*weights, constant])]
    return local_frame(df.sparkSession, rows, "target string, feature string, coefficient double, r2 double")


def segments(df: DataFrame, columns: list[str] | None = None, k: int | None = None) -> DataFrame:
    """K-means profiles on standardized numbers: size and mean of every column per segment.

    Without `k`, between 2 and 6 segments by the largest drop of the within-segment distance.
    Segments are numbered by size, the largest first."""
    names = numeric_columns(df) if columns is None else columns
    if len(names) < 2:
        raise ValueError("at least two numeric columns are needed")
    data = df.select(*[number(df, n).alias(n) for n in names]).dropna()
    rows = data.count()
    if rows < MIN_COMPLETE_ROWS:
        raise ValueError(f"at least {MIN_COMPLETE_ROWS} complete rows are needed")
    sizes = [k] if k else list(range(2, max(2, min(6, rows // 5)) + 1))
    if rows > MERGE_FROM:
        found = _segments_of_many(data, names, sizes)
        chosen = k or _largest_drop({n: cost for n, (cost, _) in found.items()})
        parts = (found.get(chosen) or _segments_of_many(data, names, [chosen])[chosen])[1]
        profile = [(n, *(half_up_value(total / n, 2) for total in sums)) for n, sums in sorted(parts, key=lambda part: -part[0])]
    else:
        profile = _segments_of_few(data, names, sizes, k)
    means = [f"{n}_mean" for n in names]
    return local_frame(df.sparkSession, [(i, *part) for i, part in enumerate(profile)], "segment int, count bigint, " + ", ".join(f"`{m}` double" for m in means))


def _segments_of_few(data: DataFrame, names: list[str], sizes: list[int], k: int | None) -> list[tuple]:
    """(count, mean of each column) of every segment, the largest first."""
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_raw"),
                                StandardScaler(inputCol="_raw", outputCol="features", withMean=True)])
    ready = _kept(pipeline.fit(data).transform(data).select("features", *names))
    try:
        models = {n: KMeans(k=n, seed=42).fit(ready) for n in sizes}
        chosen = k or _largest_drop({n: m.summary.trainingCost for n, m in models.items()})
        model = models.get(chosen) or KMeans(k=chosen, seed=42).fit(ready)
        grouped = model.transform(ready).groupBy("prediction").agg(
            F.count(F.lit(1)).alias("count"), *[half_up(F.avg(n), 2).alias(f"{n}_mean") for n in names])
        found = sorted(grouped.collect(), key=lambda r: (-r["count"], r["prediction"]))  # one row per segment
    finally:
        ready.unpersist()
    return [(r["count"], *[r[f"{n}_mean"] for n in names]) for r in found]


def _segments_of_many(data: DataFrame, names: list[str], sizes: list[int]) -> dict[int, tuple[float, list[tuple[int, list[float]]]]]:
    """For each number of segments the distance within them, and (rows, sum of each column) of every segment.

    K-means starts from cells of rows alike, each as heavy as its rows, and goes on over all rows until no center
    moves. A pass serves all numbers of segments and keeps no rows."""
    seen = data.agg(*[part(n).alias(f"{kind}{i}") for i, n in enumerate(names) for kind, part in (("m", F.avg), ("s", F.stddev))]).first()
    mean = np.array([seen[f"m{i}"] for i in range(len(names))])
    scale = np.array([1 / seen[f"s{i}"] if seen[f"s{i}"] else 0.0 for i in range(len(names))])
    centers, moving = _starting_centers(data, names, mean, scale, sizes), set(sizes)
    found: dict = {}
    for step in range(MOST_PASSES + 1):
        sums = _nearest_sums(data, names, mean, scale, {n: centers[n] for n in moving})
        for n in list(moving):
            parts = sums[n]
            found[n] = (sum(cost for _, cost, _ in parts.values()), [(rows, list(total)) for rows, _, total in parts.values()])
            moved = centers[n].copy()
            for segment, (rows, _, total) in parts.items():
                moved[segment] = (total / rows - mean) * scale
            if step == MOST_PASSES or np.sqrt(((moved - centers[n]) ** 2).sum(axis=1)).max() <= MOVED:
                moving.discard(n)
            centers[n] = moved
        if not moving:
            return found
    return found


def _starting_centers(data: DataFrame, names: list[str], mean, scale, sizes: list[int]) -> dict[int, np.ndarray]:
    """Centers, in standardized units, of cells of about ``MERGE_FROM`` in all."""
    bins = [f"{n}__bin" for n in names]
    most = max(2, min(MAX_BINS, int(MERGE_FROM ** (1 / len(names)))))
    binned = data
    for stage in _binner(data, names, bins, most):
        binned = stage.transform(binned)
    cells = binned.groupBy(*map(col, bins)).agg(F.count(F.lit(1)).cast("double").alias("_rows"), *[
        ((F.avg(col(n)) - float(m)) * float(s)).alias(n) for n, m, s in zip(names, mean, scale)])
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(cells).select("features", "_rows")
    ready = ready.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return {n: np.array(KMeans(k=n, seed=42, weightCol="_rows").fit(ready).clusterCenters()) for n in sizes}
    finally:
        ready.unpersist()


def _nearest_sums(data: DataFrame, names: list[str], mean, scale, centers: dict[int, np.ndarray]) -> dict[int, dict]:
    """For each number of segments and each segment that is nearest to any row: (rows, squared distance, sum of each column)."""
    every = np.concatenate(list(centers.values()))
    ends = np.cumsum([len(c) for c in centers.values()])

    def sums(batches):
        total = {n: np.zeros((len(c), 2 + len(names))) for n, c in centers.items()}
        for batch in batches:
            raw = np.stack([batch[n].to_numpy(dtype=float) for n in names])
            x = (raw - mean[:, None]) * scale[:, None]
            away = (every * every).sum(axis=1)[:, None] - 2 * (every @ x)  # without the square of the row itself
            own = (x * x).sum(axis=0)
            for end, (n, c) in zip(ends, centers.items()):
                some = away[end - len(c):end]
                nearest = some.argmin(axis=0)
                total[n][:, 0] += np.bincount(nearest, minlength=len(c))
                for i, part in enumerate((np.maximum(some.min(axis=0) + own, 0), *raw), 1):
                    total[n][:, i] += np.bincount(nearest, part, len(c))
        rows = [(n, i, *row) for n, t in total.items() for i, row in enumerate(t.tolist()) if row[0]]
        yield pd.DataFrame(rows, columns=["size", "segment", "rows", "cost", *(f"x{i}" for i in range(len(names)))])

    values = ["rows", "cost", *(f"x{i}" for i in range(len(names)))]
    schema = "size int, segment int, " + ", ".join(f"{v} double" for v in values)
    found = data.select(*map(col, names)).mapInPandas(sums, schema).groupBy("size", "segment").agg(*[F.sum(v).alias(v) for v in values])
    result: dict[int, dict] = {n: {} for n in centers}
    for r in found.collect():  # one row per segment
        result[r["size"]][r["segment"]] = (int(r["rows"]), r["cost"], np.array([r[v] for v in values[2:]]))
    return result


def _largest_drop(costs: dict[int, float]) -> int:
    """The number of segments before the largest drop in cost; 3 when there is nothing to compare."""
    drops = {n: costs[n] - costs[n + 1] for n in costs if n + 1 in costs}
    return max(drops, key=lambda n: drops[n]) if drops else 3
