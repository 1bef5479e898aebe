"""Approximate nearest neighbours on shifted space-filling curves.

Each of CURVES curves projects the vectors onto DIMENSIONS random directions, shifts them, and orders
them by their place on a Hilbert curve. Spark sorts all curves by ranges and numbers the places. A
query reads, on every curve, the window of candidates around its own place; the windows are merged
and reranked by the true distance in double precision.

The width of the window and the number of curves are measured, not guessed: for a bounded sample of queries
the true neighbours are found by scanning everything. For one curve, two, and so on, the window must be as
wide as TARGET of them need on their best curve; the number that reads the fewest candidates is used. Vectors
with structure need narrow windows on several curves; without any, one wide window is the best there is. Places are dealt into blocks of BLOCK candidates; a window that crosses a border reads
its part of each block, and within a block only the places of the window are measured. Query lists are
split, so every task holds bounded data whatever the vectors look like.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors of
another length than the most frequent one. Equal vectors are one entry with their k + 1 smallest ids.
Rows that repeat an id and a vector count once. Ties go to the smaller id. An empty table gives an
empty result.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismtab.llm.common import running_totals, small_batches, stored
from prismtab.llm.hamming import with_smallest_ids

CURVES, DIMENSIONS, BITS = 6, 6, 10
BLOCK, QUERIES = 4096, 2048
SAMPLE, TARGET, MARGIN = 128, 0.96, 1.1
SEED = 5


def directions(size: int, curve: int) -> np.ndarray:
    """Random orthonormal directions of one curve (size x DIMENSIONS or fewer)."""
    random = np.random.default_rng([SEED, curve])
    return np.linalg.qr(random.normal(size=(size, min(size, DIMENSIONS))))[0]


def hilbert_places(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates below 2^bits.

    From the highest bit down: a coordinate whose bit is set turns the lower bits of the first one
    over, otherwise both exchange them; then the Gray code of the turned coordinates is read off.
    """
    x = cells.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, lower = one << np.uint64(level), (one << np.uint64(level)) - one
        for axis in range(len(x)):
            up = (x[axis] & bit) > 0
            differ = np.where(up, 0, (x[0] ^ x[axis]) & lower)
            x[0] ^= np.where(up, lower, differ)
            x[axis] ^= differ
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(level)) & one > 0, (one << np.uint64(level)) - one, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            place = place << one | (x[axis] >> np.uint64(level)) & one
    return place.view(np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def entries_of(vectors: DataFrame, vec_id: str, embedding: str, many: int) -> DataFrame:
    """(node, x, first_id, ids): the different usable vectors."""
    x = F.col(embedding).cast("array<double>")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), x.alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    rows = rows.where(~bad & F.exists("x", lambda v: v != 0))
    usual = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("x") == (usual["n"] if usual else 0))
    entries = with_smallest_ids(rows, "x", "vec_id", many)
    return stored(entries.withColumn("node", F.monotonically_increasing_id()))


def curve_places(entries: DataFrame, size: int) -> DataFrame:
    """(node, curve, place) for every entry and curve; place counts from 0 along the curve."""
    axes = [directions(size, c) for c in range(CURVES)]

    def sums(parts):
        for part in parts:
            x = matrix(part.column(0))
            p = np.hstack([x @ a for a in axes]) if len(x) else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(p.shape[1])), pa.array(np.full(p.shape[1], float(len(p)))), pa.array(p.sum(axis=0)), pa.array((p * p).sum(axis=0))],
                names=["axis", "n", "s", "ss"])

    moments = (entries.select("x").mapInArrow(sums, "axis long, n double, s double, ss double").where("n > 0")
               .groupBy("axis").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).orderBy("axis").toPandas())
    mean = (moments["s"] / moments["n"]).to_numpy()
    spread = np.sqrt(np.maximum((moments["ss"] / moments["n"]).to_numpy() - mean ** 2, 1e-24))
    width = min(size, DIMENSIONS)
    shifts = np.random.default_rng([SEED, CURVES]).uniform(-0.1, 0.1, (CURVES, width))

    def keys(parts):
        for part in parts:
            x, nodes = matrix(part.column(1)), part.column(0)
            for c, a in enumerate(axes):
                here = slice(c * width, (c + 1) * width)
                scaled = (x @ a - mean[here]) / (6 * spread[here]) + 0.5 + shifts[c] if len(x) else np.zeros((0, width))
                cells = np.clip(scaled * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([nodes, pa.array(np.full(len(nodes), c, np.int32)), pa.array(hilbert_places(cells))],
                                                 names=["node", "curve", "key"])

    keyed = entries.select("node", "x").mapInArrow(keys, "node long, curve int, key long")
    placed = running_totals(keyed, ["curve", "key", "node"], {"_all": F.lit(1)})
    held = entries.count()
    return stored(placed.select("node", "curve", (F.col("_all") - F.col("curve") * F.lit(held)).alias("place")))


def nearest_in(points: np.ndarray, first: np.ndarray, query: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the points that are nearest to one query, exactly measured, ties by `first`: (rows, distances)."""
    apart = points - query
    far = np.sqrt(np.einsum("ij,ij->i", apart, apart))
    near = np.flatnonzero(far <= np.partition(far, most - 1)[most - 1]) if len(far) > most else np.arange(len(far))
    chosen = near[np.lexsort((first[near], far[near]))][:most]
    return chosen, far[chosen]


def scanned(entries: DataFrame, sample: pd.DataFrame, many: int) -> DataFrame:
    """(query, node) of the true neighbours of the few sampled queries, by a scan of all entries."""
    queries, names = np.stack(sample["x"].to_numpy()).astype(np.float64), sample["node"].to_numpy()

    def batches(parts):
        for part in parts:
            x, nodes, first = matrix(part.column(1)), part.column(0).to_numpy(), part.column(2).to_numpy()
            if not len(x):
                continue
            for name, query in zip(names, queries):
                rows, far = nearest_in(x, first, query, many)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), name)), pa.array(nodes[rows]), pa.array(far)], names=["query", "node", "far"])

    found = entries.select("node", "x", "first_id").mapInArrow(batches, "query long, node long, far double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("far", "node"))
    return found.where("query <> node").withColumn("_rank", rank).where(F.col("_rank") < many).select("query", "node")


def windows_needed(entries: DataFrame, asked: DataFrame, places: DataFrame, many: int, held: int) -> tuple[int, int]:
    """(curves, places on each side of a query) that hold TARGET of the true neighbours of the sampled queries and
    read the fewest candidates."""
    sample = asked.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).toPandas()
    if sample.empty:
        return 1, 1
    pairs = stored(scanned(entries, sample, many))
    of_query, of_node = (places.select(F.col("node").alias(n), "curve", F.col("place").alias(p)) for n, p in (("query", "p"), ("node", "q")))
    gaps = (pairs.join(of_query, "query").join(of_node, ["node", "curve"])
            .select("query", "node", "curve", F.abs(F.col("p") - F.col("q")).alias("gap")).toPandas())  # a row per sampled pair and curve
    if gaps.empty:
        return 1, 1
    best = gaps.pivot_table(index=["query", "node"], columns="curve", values="gap").sort_index(axis=1).cummin(axis=1)
    widths = [int(np.ceil(np.quantile(best.iloc[:, c], TARGET) * MARGIN)) + 1 for c in range(best.shape[1])]
    return min(((c + 1, w) for c, w in enumerate(widths)), key=lambda cw: (cw[0] * min(2 * cw[1] + 1, held), cw[0]))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
               block: int = BLOCK, report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows `vectors` for the rows `queries`, which are among them. `report`
    receives the curves used, the half-width of the window and the number of different vectors."""
    small_batches(vectors.sparkSession)
    many = k + 1
    entries = entries_of(vectors, vec_id, embedding, many)
    found = entries.first()
    if found is None:
        kind = vectors.schema[vec_id].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    x = F.col(embedding).cast("array<double>")
    rows = queries.select(F.col(vec_id).alias("query_id"), x.alias("x")).distinct()
    rows = stored(rows.join(entries.select("node", "x"), "x").select("query_id", "node"))
    asked = stored(rows.select("node").distinct().join(entries.select("node", "x"), "node"))
    places = curve_places(entries, len(found["x"]))
    held, many_asked = entries.count(), asked.count()
    used, width = windows_needed(entries, asked, places, many, held)
    if report is not None:
        report |= {"curves": used, "width": width, "vectors": held}
    places = places.where(F.col("curve") < used)
    shares = max(1, -(-many_asked * (2 * width + block) // max(held, 1) // QUERIES))

    last = (held - 1) // block
    cell = ["curve", "block", "share"]
    windows = (places.join(asked, "node").withColumn("block", F.explode(F.sequence(
        F.greatest(F.floor((F.col("place") - width) / block), F.lit(0)).cast("long"),
        F.least(F.floor((F.col("place") + width) / block), F.lit(last)).cast("long"))))
        .withColumn("share", F.pmod(F.xxhash64("node"), F.lit(shares)).cast("int")).select(*cell, "node", "place", "x").toDF(*cell, "node", "place", "x"))
    blocks = (places.withColumn("block", F.floor(F.col("place") / block).cast("long"))
              .join(entries.select("node", "x", "first_id"), "node")
              .withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).select(*cell, "node", "place", "first_id", "x"))

    def rerank(held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(held) and len(wanted):
            held = held.sort_values("place")
            points, first, nodes, place = np.stack(held["x"].to_numpy()), held["first_id"].to_numpy(), held["node"].to_numpy(), held["place"].to_numpy()
            lows, highs = (np.searchsorted(place, wanted["place"].to_numpy() + by, side) for by, side in ((-width, "left"), (width, "right")))
            for query, x, low, high in zip(wanted["node"], wanted["x"], lows, highs):
                at, far = nearest_in(points[low:high], first[low:high], x, many)
                found.append(pd.DataFrame({"query": query, "node": nodes[low:high][at], "score": far}))
        return pd.concat(found) if found else pd.DataFrame({"query": np.empty(0, np.int64), "node": np.empty(0, np.int64), "score": np.empty(0)})

    merged = blocks.groupBy(*cell).cogroup(windows.groupBy(*cell)).applyInPandas(rerank, "query long, node long, score double")
    merged = merged.groupBy("query", "node").agg(F.min("score").alias("score")).join(entries.select("node", "first_id", "ids"), "node")
    near = F.row_number().over(Window.partitionBy("query").orderBy("score", "first_id"))
    lists = stored(merged.withColumn("_rank", near).where(F.col("_rank") <= many).select("query", "score", "ids"))
    result = (rows.join(lists, rows["node"] == lists["query"]).select("query_id", "score", F.explode("ids").alias("vec_id"))
              .where("vec_id <> query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return result.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
