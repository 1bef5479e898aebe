"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments of about two bits fewer than the number of codes has, so a segment value
has a few codes: longer segments need more look-ups, shorter ones meet more codes. Every code is indexed once under each of its segment values. In round r a query looks up
all values that differ in exactly r bits from its own, in each segment: an equi-join of the probes with
the index. After the round, every code within distance m (r + 1) - 1 for m segments has been met, so a
query is done once its k-th verified distance is within that; the rest go on with radius r + 1. No value
is looked up twice, and a code is verified only in the first round and segment that meet it.

Equal codes are one entry with their k + 1 smallest ids, so copies of a vector never meet each other one
by one. A segment value that many codes share is a skewed key of a join of two plain tables, which Spark
splits. All of it is column expressions.

Vectors that are null, or hold null or non-finite components, take no part. Longer vectors are folded
onto 64 components by addition. Rows that repeat an id and a code count once. Ties go to the smaller
id. With fewer than k candidates all are returned; an empty table gives an empty result.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismtab.llm.common import forget, stored

CODE_BITS = 64
LEAST_BITS, MOST_BITS = 8, 22  # of a segment
LARGEST = 65


def sign_codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, code): bit i is set where component i is above 0."""
    def batches(parts):
        for part in parts:
            ids, codes = [], []
            for name, vector in zip(part.column(0), part.column(1)):
                x = np.array([np.nan if v is None else v for v in vector.as_py() or []], dtype=np.float64)
                if len(x) and np.isfinite(x).all():
                    folded = np.zeros(64)
                    np.add.at(folded, np.arange(len(x)) % 64, x)
                    ids.append(name.as_py())
                    codes.append(np.packbits(folded > 0, bitorder="little").view(np.int64)[0])
            yield pa.RecordBatch.from_arrays([pa.array(ids, part.column(0).type), pa.array(codes, pa.int64())], names=["vec_id", "code"])

    kind = vectors.schema[vec_id].dataType.simpleString()
    return vectors.select(F.col(vec_id).alias("vec_id"), embedding).mapInArrow(batches, f"vec_id {kind}, code long")


def with_smallest_ids(rows: DataFrame, key: str, vec_id: str, many: int) -> DataFrame:
    """(key, first_id, ids): the `many` smallest ids of each key. Rows that repeat go first, so that they take
    no place; the rank filter then drops the rest in the tasks that hold them, before the shuffle by key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(vec_id))
    few = rows.select(key, vec_id).distinct().withColumn("_rank", rank).where(F.col("_rank") <= many)
    return few.groupBy(key).agg(F.min(vec_id).alias("first_id"), F.array_sort(F.collect_set(vec_id)).alias("ids"))


def segments_for(codes: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the segments for a number of codes."""
    wanted = min(MOST_BITS, max(LEAST_BITS, codes.bit_length() - 2))
    many = -(-CODE_BITS // wanted)
    edges = [round(i * CODE_BITS / many) for i in range(many + 1)]
    return [(low, high - low) for low, high in zip(edges, edges[1:])]


def value_of(code: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def masks(bits: int, radius: int) -> list[int]:
    """The numbers of so many bits of which exactly `radius` are set."""
    return [sum(1 << b for b in chosen) for chosen in combinations(range(bits), radius)]


def probes(active: DataFrame, parts: list[tuple[int, int]], radius: int) -> DataFrame:
    """(query, bound, segment, value): what each query looks up in a round."""
    found = [active.select("query", "bound", F.lit(i).alias("segment"), F.explode(F.transform(
        F.array(*map(F.lit, masks(bits, radius))), lambda m: value_of(F.col("query"), low, bits).bitwiseXOR(m))).alias("value"))
        for i, (low, bits) in enumerate(parts) if radius <= bits]
    return union(found)


def union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def first_met(parts: list[tuple[int, int]], radius: int) -> Column:
    """No segment before this one is as near, and none behind it nearer."""
    apart = [F.bit_count(value_of(F.col("query").bitwiseXOR(F.col("code")), low, bits)) for low, bits in parts]
    holds = F.lit(True)
    for i, own in enumerate(apart):
        holds = holds & F.when(F.col("segment") > i, own > radius).otherwise(own >= radius)
    return holds


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", code: str = "code", report: list | None = None) -> DataFrame:
    """(query_id, rank, vec_id, distance) of codes (vec_id, code) for query rows of the same form. `report` receives
    (radius, queries, codes met) of each round."""
    many = k + 1
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(code).alias("code")).where("vec_id IS NOT NULL AND code IS NOT NULL")
    entries = stored(with_smallest_ids(rows, "code", "vec_id", many))
    asked = stored(queries.select(F.col(vec_id).alias("query_id"), F.col(code).alias("query")).where("query_id IS NOT NULL AND query IS NOT NULL").distinct())
    parts = segments_for(entries.count())
    index = stored(union([entries.select(F.lit(i).alias("segment"), value_of(F.col("code"), low, bits).alias("value"), "code", "first_id",
                                         F.size("ids").alias("held")) for i, (low, bits) in enumerate(parts)]))

    active = stored(asked.select("query").distinct().withColumn("bound", F.lit(LARGEST)))
    best, settled = None, []
    in_order = Window.partitionBy("query").orderBy("distance", "first_id")
    least = min(bits for _, bits in parts)
    for radius in range(least + 1):
        distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code")))
        # Spark's size of the probes does not count what explode makes of a query, so it must not choose a broadcast.
        met = probes(active, parts, radius).hint("merge").join(index, ["segment", "value"])
        found = met.withColumn("distance", distance).where((F.col("distance") <= F.col("bound")) & first_met(parts, radius))
        found = found.select("query", "code", "distance", "first_id", "held")
        merged = found if best is None else best.unionByName(found)
        so_far = F.sum("held").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        merged = stored(merged.withColumn("_rank", F.row_number().over(in_order)).where(F.col("_rank") <= many).drop("_rank")
                        .withColumn("_rows", so_far))
        if report is not None:
            report.append((radius, active.count(), met.count()))
        bounds = merged.where(F.col("_rows") >= many).groupBy("query").agg(F.min("distance").cast("int").alias("reached"))
        state = stored(active.drop("bound").join(bounds, "query", "left").withColumn("bound", F.coalesce("reached", F.lit(LARGEST))).drop("reached"))
        covered = len(parts) * (radius + 1) - 1 if radius < least else LARGEST
        best = merged.drop("_rows")
        done = state.where(F.col("bound") <= covered).select("query")
        settled.append(stored(best.join(done, "query", "left_semi")))
        forget(active)
        active = stored(state.where(F.col("bound") > covered))
        if active.limit(1).count() == 0:
            break
        best = stored(best.join(active.select("query"), "query", "left_semi"))
        forget(merged, state)
    rows = (asked.join(union(settled), "query").join(entries.select("code", "ids"), "code")
            .select("query_id", "distance", F.explode("ids").alias("vec_id")).where("vec_id <> query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
