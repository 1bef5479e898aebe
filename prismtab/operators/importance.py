"""How much a fitted model loses when the values of one feature are shuffled, for all features in one pass.

Rows stand in the order of a hash, numbered over the whole table. In the shuffle of a feature each row
takes the value of the row a fixed number of places before it, another number for each feature and
repeat, so a value travels to one row and each feature keeps its distribution. The row is then scored once as
it is and once for each shuffled value.
"""
from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from prismtab.functions.coerce import col
from prismtab.functions.rounding import half_up
from prismtab.operators.modeling import Training
from prismtab.operators.modeling import predict as modeling_predict
from prismtab.operators.profile import local_frame
from prismtab.operators.ranks import totals_before

TOGETHER = 16  # variants that are scored in one pass
RESULT = "feature string, importance double, share double"


def shift(feature: str, repeat: int, rows: int, seed: int) -> int:
    """How many places the values of a feature move."""
    return 1 + zlib.crc32(f"{seed}/{repeat}/{feature}".encode()) % (rows - 1)


def shuffled_scores(
    data: DataFrame, features: list[str], keys: list[str], predict: Callable[[DataFrame], DataFrame],
    regression: bool, repeats: int = 1, seed: int = 42,
) -> DataFrame:
    """(variant, score): variant 0 is the data as it is, variant 1 + r * features + f has feature f shuffled.

    `data` has the column `actual`, the features, and keys that tell its rows apart; `predict` adds `predicted`.
    The score is R2, or the share of right classes; null for a constant target."""
    hashed = data.withColumn("_mark", F.xxhash64(F.lit(seed), *map(col, keys)))
    ranked = totals_before(hashed, ["_mark", *keys], {"_rank": F.lit(1).cast("bigint")})
    ranked = ranked.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = ranked.count()
        if rows < 2:
            return local_frame(data.sparkSession, [], "variant int, score double")
        moved = [(1 + r * len(features) + f, name, shift(name, r, rows, seed)) for r in range(repeats) for f, name in enumerate(features)]
        found = []
        for start in range(0, len(moved), TOGETHER):
            some = moved[start:start + TOGETHER]
            scored = predict(_variants(ranked, rows, features, keys, some, [] if start else [0]))
            found += scored.groupBy("variant").agg(_score(regression).alias("score")).collect()  # one row per feature and repeat
    finally:
        ranked.unpersist()
    return local_frame(data.sparkSession, [tuple(r) for r in found], "variant int, score double")


def _variants(ranked: DataFrame, rows: int, features: list[str], keys: list[str], moved: list[tuple[int, str, int]], plain: list[int]) -> DataFrame:
    """Each row once for each variant: as it is for the `plain` ones, else with one feature's value from another row.
    The rows stay where their rank was dealt to; only ranks and values of one feature travel for each variant."""
    met = ranked
    for variant, name, by in moved:
        met = met.join(ranked.select(F.pmod(F.col("_rank") + F.lit(by), F.lit(rows)).alias(f"_to{variant}"), col(name).alias(f"_new{variant}")),
                       F.col("_rank") == F.col(f"_to{variant}")).drop(f"_to{variant}")
    every = met.withColumn("variant", F.explode(F.array(*(F.lit(v) for v in [*plain, *(v for v, _, _ in moved)]))))
    taken = {name: col(name) for name in features}
    for variant, name, _ in moved:
        taken[name] = F.when(F.col("variant") == variant, F.col(f"_new{variant}")).otherwise(taken[name])
    return every.select("variant", "actual", *map(col, [k for k in keys if k not in features]), *(taken[name].alias(name) for name in features))


def _score(regression: bool) -> Column:
    if not regression:
        return F.avg((F.col("actual") == F.col("predicted")).cast("double"))
    miss = F.col("actual").cast("double") - F.col("predicted").cast("double")
    return 1 - F.try_divide(F.avg(miss * miss), F.var_pop(F.col("actual").cast("double")))


def permutation_importance(result: Training, keys: list[str], repeats: int = 1, seed: int = 42, limit: int = 20) -> DataFrame:
    """(feature, importance, share) of a trained model on its held-out rows: the mean loss of score over the
    repeats, largest first, and its share of all losses above 0. `keys` must tell rows apart."""
    held = result.predictions.select("actual", *map(col, dict.fromkeys([*result.features, *keys])))

    def predict(frame: DataFrame) -> DataFrame:
        scored = modeling_predict(result.model.stages, frame.withColumn("_actual", F.col("actual")))
        return scored if "predicted" in scored.columns else scored.withColumn("predicted", F.col("prediction"))

    scores = shuffled_scores(held, result.features, keys, predict, result.task == "regression", repeats, seed)
    found = {r["variant"]: r["score"] for r in scores.collect()}  # one row per feature and repeat
    if found.get(0) is None:
        return local_frame(held.sparkSession, [], RESULT)
    many = len(result.features)
    losses = [(name, sum(found[0] - found[1 + r * many + f] for r in range(repeats)) / repeats) for f, name in enumerate(result.features)]
    above = sum(max(0.0, loss) for _, loss in losses)
    frame = local_frame(held.sparkSession, [(n, v, max(0.0, v) / above if above else 0.0) for n, v in losses], RESULT)
    return frame.select("feature", half_up(F.col("importance"), 6).alias("importance"), half_up(F.col("share"), 6).alias("share")).orderBy(
        F.desc("importance"), F.asc("feature")).limit(limit)
