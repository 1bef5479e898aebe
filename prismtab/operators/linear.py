"""Linear models over many rows: least squares with a penalty in one pass, and logistic regression for two classes by
Newton's method.

A pass adds up the gradient and the curvature, a matrix of the size of the coefficients, so a handful of passes leads to
the same optimum that a solver of first order needs hundreds for. No vectors are kept.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismtab.functions.coerce import col
from prismtab.operators.forests import described, written

# Fixed values.
MOST_STEPS = 100
SETTLED = 1e-10  # how much of the mean loss the next step could still take away
MOST_FEATURES = 500  # the matrix has the square of it


@dataclass(frozen=True)
class Inputs:
    """The features: (number - mean) * scale, then indicators of the indexed words, `sizes` of each; words beyond have none."""

    numbers: list[str]
    words: list[str]
    mean: np.ndarray
    scale: np.ndarray
    sizes: list[int]

    @property
    def width(self) -> int:
        return len(self.numbers) + sum(self.sizes)

    def rows(self, frame: DataFrame, label: str) -> DataFrame:
        names = [*self.numbers, *self.words]
        return frame.select(*[col(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)], col(label).cast("double").alias("y"))

    def matrix(self, batch: pd.DataFrame) -> np.ndarray:
        """The features of some rows, and a last column of ones."""
        x = np.zeros((len(batch), self.width + 1))
        x[:, -1] = 1
        start = numbers = len(self.numbers)
        for i in range(numbers):
            x[:, i] = (batch[f"x{i}"].to_numpy() - self.mean[i]) * self.scale[i]
        for i, size in enumerate(self.sizes, numbers):
            word = batch[f"x{i}"].to_numpy().astype(np.int64)
            known = np.flatnonzero(word < size)
            x[known, start + word[known]] = 1
            start += size
        return x


def ridge(line: LinearRegression, train: DataFrame, inputs: Inputs, alpha: float) -> LinearRegressionModel:
    """Least squares with `alpha` times the squared coefficients, from one pass over all rows."""
    middle = train.agg(F.avg(line.getLabelCol())).first()[0] or 0.0

    def sums(x, y):
        return float(len(y)), 0.0, x.T @ (y - middle), x.T @ x

    many, _, product, square = _added(inputs.rows(train, line.getLabelCol()), inputs, sums)
    mean = square[-1, :-1] / max(1.0, many)
    inner = square[:-1, :-1] - many * np.outer(mean, mean)
    weights = np.linalg.solve(inner + alpha * np.eye(inputs.width), product[:-1] - mean * product[-1])
    constant = float(product[-1] / max(1.0, many) - mean @ weights + middle)
    data = train.sparkSession.createDataFrame([(constant, DenseVector(weights), 1.0)], ["intercept", "coefficients", "scale"])
    return LinearRegressionModel.load(written(train.sparkSession, described(
        "org.apache.spark.ml.regression.LinearRegressionModel", line, {}), {"data": data}))


def logistic(line: LogisticRegression, train: DataFrame, inputs: Inputs, weights: list[float], start_rows: DataFrame) -> LogisticRegressionModel:
    """The model for a label of 0 and 1, with a weight for each. The first steps are made on `start_rows`, the last ones on all."""
    at = np.zeros(inputs.width + 1)
    for rows in (start_rows, train):
        at = _optimum(inputs.rows(rows, line.getLabelCol()), at, inputs, np.array(weights), line.getRegParam())
    row = (2, inputs.width, DenseVector([at[-1]]), DenseMatrix(1, inputs.width, at[:-1].tolist(), True), False)
    data = train.sparkSession.createDataFrame([row], ["numClasses", "numFeatures", "interceptVector", "coefficientMatrix", "isMultinomial"])
    return LogisticRegressionModel.load(written(train.sparkSession, described(
        "org.apache.spark.ml.classification.LogisticRegressionModel", line, {}), {
        "data": data.withColumns({n: F.col(n).cast("int") for n in ("numClasses", "numFeatures")})}))


def _optimum(rows: DataFrame, at: np.ndarray, inputs: Inputs, weights: np.ndarray, penalty: float) -> np.ndarray:
    best, step = None, np.zeros_like(at)
    shrunk = np.array([penalty] * inputs.width + [0.0])  # all but the constant
    for _ in range(MOST_STEPS):
        tried = at + step

        def sums(x, y, tried=tried):
            score, weight = x @ tried, weights[y.astype(np.int64)]
            chance = 0.5 * (1 + np.tanh(0.5 * score))
            loss = float(weight @ (np.logaddexp(0, score) - y * score))
            return float(weight.sum()), loss, x.T @ (weight * (chance - y)), (x * (weight * chance * (1 - chance))[:, None]).T @ x

        whole, loss, gradient, curve = _added(rows, inputs, sums)
        if not whole:
            return at
        loss = loss / whole + 0.5 * float(shrunk @ (tried * tried))
        if best is not None and not loss <= best + 1e-12 * abs(best):
            step = step / 2  # too far
            if np.abs(step).max() <= 1e-12 * (1 + np.abs(at).max()):
                return at
            continue
        at, best = tried, loss
        gradient, curve = gradient / whole + shrunk * at, curve / whole + np.diag(shrunk)
        step = -np.linalg.lstsq(curve, gradient, rcond=1e-15)[0]
        if -0.5 * float(gradient @ step) <= SETTLED:
            return at + step
    return at


def _added(rows: DataFrame, inputs: Inputs, part) -> tuple[float, float, np.ndarray, np.ndarray]:
    """What `part` finds of the features and targets of some rows, two numbers, a vector and a matrix, added up."""
    width = inputs.width + 1

    def sums(batches):
        whole, loss, gradient, curve = 0.0, 0.0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            a, b, c, d = part(inputs.matrix(batch), batch["y"].to_numpy())
            whole, loss, gradient, curve = whole + a, loss + b, gradient + c, curve + d
        yield pd.DataFrame({"whole": [whole], "loss": [loss], "gradient": [gradient.tobytes()], "curve": [curve.tobytes()]})

    schema = "whole double, loss double, gradient binary, curve binary"
    found = rows.mapInPandas(sums, schema).withColumn("_some", F.spark_partition_id() % 16).groupBy("_some").applyInPandas(
        lambda frame: pd.DataFrame({"whole": [frame["whole"].sum()], "loss": [frame["loss"].sum()], **{
            name: [sum(np.frombuffer(v) for v in frame[name]).tobytes()] for name in ("gradient", "curve")}}), schema).collect()  # at most 16 rows
    return (sum(r["whole"] for r in found), sum(r["loss"] for r in found), sum((np.frombuffer(r["gradient"]) for r in found), np.zeros(width)),
            sum((np.frombuffer(r["curve"]).reshape(width, width) for r in found), np.zeros((width, width))))
