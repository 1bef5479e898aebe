"""Datasets, column meanings and models on shared storage, and the listing of datasets.

Whatever is saved becomes a version of its own: a folder with a number, whose parts are written first and
whose manifest is written last. A version without a manifest was broken off and does not exist for readers;
loading takes the newest version with a manifest and falls back to the one before if its parts cannot be
read. So a save that fails, or that another save overtakes, never harms what was there.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismtab.operators.metrics import Metric
from prismtab.operators.modeling import Training
from prismtab.operators.profile import local_frame
from prismtab.operators.roles import MetricMap

Found = TypeVar("Found")
MANIFEST = "number bigint, version string, kind string, facts string, created_at string"


class NothingStored(LookupError):
    """No complete version is there."""


def dataset_path(root: str, dataset_id: str) -> str:
    return f"{root.rstrip('/')}/datasets/{dataset_id}"


def session_path(root: str, session_id: str) -> str:
    return f"{root.rstrip('/')}/sessions/{session_id}"


def versions(spark: SparkSession, path: str, kind: str) -> list[tuple[int, str, dict]]:
    """(number, folder, facts) of the complete versions of a kind, the newest first."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{path}/{kind}/manifests").where(F.col("kind") == kind).collect()  # one row per version
    except AnalysisException:  # nothing was ever saved here
        return []
    found = sorted(((r["number"], r["version"], r["facts"]) for r in rows), reverse=True)
    return [(number, f"{path}/{kind}/{version}", json.loads(facts)) for number, version, facts in found]


def _publish(spark: SparkSession, path: str, kind: str, write: Callable[[str], dict]) -> str:
    """Write a new version: its parts by `write`, which returns its facts, then the manifest. Two saves at
    the same time get one number and folders of their own; readers take either."""
    known = versions(spark, path, kind)
    number = known[0][0] + 1 if known else 1
    version = f"v{number:06d}-{uuid.uuid4().hex[:8]}"
    facts = write(f"{path}/{kind}/{version}")
    row = (number, version, kind, json.dumps(facts), datetime.now(timezone.utc).isoformat())
    local_frame(spark, [row], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/{kind}/manifests")
    return version


def _newest(spark: SparkSession, path: str, kind: str, read: Callable[[str, dict], Found]) -> Found:
    """What `read` makes of the newest version that it can read."""
    failed = []
    for number, folder, facts in versions(spark, path, kind):
        try:
            return read(folder, facts)
        except Exception as problem:  # a part is missing or damaged: the version before it may be whole
            failed.append(f"version {number}: {type(problem).__name__}")
    raise NothingStored(f"no {kind} at {path}" + (f" ({'; '.join(failed)})" if failed else ""))


def save_dataset(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write the table as a new version with facts about it; returns the version."""
    def write(folder: str) -> dict:
        writer = df.write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{folder}/data")
        # Counting stored parquet reads file footers only.
        rows = df.sparkSession.read.parquet(f"{folder}/data").count()
        return {"row_count": rows, "column_count": len(df.columns), "columns": df.columns, "schema": df.schema.json(),
                "types": [f.dataType.simpleString() for f in df.schema.fields], "created_at": datetime.now(timezone.utc).isoformat()}

    return _publish(df.sparkSession, path, "data", write)


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of the table with its columns in the order they were saved. A version that has
    lost rows is not whole."""
    def read(folder: str, facts: dict) -> DataFrame:
        table = spark.read.parquet(f"{folder}/data").select(*[F.col(f"`{c}`") for c in facts["columns"]])
        if table.count() != facts["row_count"]:
            raise ValueError("rows are missing")
        return table

    return _newest(spark, path, "data", read)


def load_facts(spark: SparkSession, path: str) -> DataFrame:
    """One row: counts, columns and types of the newest version."""
    facts = _newest(spark, path, "data", lambda folder, facts: facts)
    names = ("row_count", "column_count", "columns", "types", "created_at")
    return local_frame(spark, [tuple(facts[n] for n in names)],
                       "row_count bigint, column_count bigint, columns array<string>, types array<string>, created_at string")


def save_roles(spark: SparkSession, roles: dict[str, str], path: str, metrics: MetricMap | None = None) -> str:
    """The meaning of the columns, and the metrics that can be computed from them."""
    def write(folder: str) -> dict:
        rows = [(i, column, role) for i, (column, role) in enumerate(roles.items())]
        local_frame(spark, rows, "position int, column_name string, role string").coalesce(1).write.json(f"{folder}/roles")
        if metrics is None:
            return {"metrics": None}
        columns = {n: getattr(metrics, n) for n in ("date", "product", "category", "customer", "store", "region", "transaction_type")}
        return {"metrics": {name: vars(m) for name, m in metrics.metrics.items()}, "columns": columns}

    return _publish(spark, path, "roles", write)


def load_roles(spark: SparkSession, path: str) -> dict[str, str]:
    def read(folder: str, _: dict) -> dict[str, str]:
        rows = spark.read.schema("position int, column_name string, role string").json(f"{folder}/roles")
        return {r["column_name"]: r["role"] for r in rows.orderBy("position").collect()}  # one row per column

    return _newest(spark, path, "roles", read)


def load_metrics(spark: SparkSession, path: str) -> MetricMap | None:
    """The metrics saved with the newest column meanings; None if they were saved without."""
    def read(_: str, facts: dict) -> MetricMap | None:
        if facts["metrics"] is None:
            return None
        known = {name: Metric(**(m | {"include": tuple(m["include"]), "subtract": tuple(m["subtract"])})) for name, m in facts["metrics"].items()}
        return MetricMap(known, **facts["columns"])

    return _newest(spark, path, "roles", read)


def save_model(model: PipelineModel | Training, path: str, spark: SparkSession | None = None) -> str:
    """A fitted model; of a training run also its target, features, scores and limitations."""
    session = spark or SparkSession.active()
    run = model if isinstance(model, Training) else None

    def write(folder: str) -> dict:
        (run.model if run else model).write().save(f"{folder}/model")
        if run is None:
            return {}
        return {"target": run.target, "task": run.task, "features": run.features, "selected": run.selected, "train_rows": run.train_rows,
                "test_rows": run.test_rows, "limitations": run.limitations, "scores": [list(s) for s in run.scores]}

    return _publish(session, path, "model", write)


def load_model(path: str, spark: SparkSession | None = None) -> PipelineModel:
    return _newest(spark or SparkSession.active(), path, "model", lambda folder, _: PipelineModel.load(f"{folder}/model"))


def load_model_facts(path: str, spark: SparkSession | None = None) -> dict:
    """What was saved about the newest model; empty for a model that was saved alone."""
    return _newest(spark or SparkSession.active(), path, "model", lambda _, facts: facts)


def load_session(spark: SparkSession, root: str, session_id: str, dataset_id: str | None = None) -> DataFrame:
    """The table of a session, else that of its dataset."""
    paths = [session_path(root, session_id), *([dataset_path(root, dataset_id)] if dataset_id else [])]
    for path in paths:
        try:
            return load_dataset(spark, path)
        except NothingStored:
            continue
    raise NothingStored(f"nothing stored at {' or '.join(paths)}")


def recent_datasets(registry: DataFrame, user_id=None, limit: int = 50) -> DataFrame:
    """The newest datasets, of one user or of all; ties by id."""
    mine = registry if user_id is None else registry.where(F.col("user_id") == F.lit(user_id))
    return mine.orderBy(F.desc("created_at"), F.desc("dataset_id")).limit(limit)
