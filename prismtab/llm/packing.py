"""Packing into optimal length buckets.

The global histogram of lengths decides the bucket boundaries: dynamic programming finds the ones with
the least padding for a given number of buckets. Inside a bucket every document is padded to the
bucket's length, so a batch takes as many documents as its token budget holds.

The histogram has one row for each length that occurs, so what the driver holds is bounded by the longest
document and not by their number.

Nulls and empty texts have no tokens: they stay in the result without bucket and batch. A document
above the budget makes a batch of its own. Equal documents are ordered by doc_id; rows that repeat
get places of their own. An empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismtab.llm.common import running_totals, stored, word_count

BUCKETS = 16
BATCH_TOKENS = 65_536
SEED = 411


def best_boundaries(lengths, counts, tokens, buckets: int = BUCKETS) -> list[int]:
    """Upper ends of at most `buckets` buckets with the least padding.

    lengths: ascending; counts and tokens: documents and tokens of each length.
    The best last cut moves right as the prefix grows, so each level is solved by halving.
    """
    lengths = np.asarray(lengths, dtype=np.float64)
    size = len(lengths)
    if size == 0:
        return []
    docs = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64))])
    true = np.concatenate([[0.0], np.cumsum(np.asarray(tokens, dtype=np.float64))])
    best = np.full(size + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(buckets, size)):
        new, cut = np.full(size + 1, np.inf), np.zeros(size + 1, dtype=np.int64)
        new[0] = 0.0
        todo = [(1, size, 0, size - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            middle = (low + high) // 2
            starts = np.arange(first, min(last, middle - 1) + 1)
            padding = best[starts] + lengths[middle - 1] * (docs[middle] - docs[starts]) - (true[middle] - true[starts])
            at = int(np.argmin(padding))
            new[middle], cut[middle] = padding[at], starts[at]
            todo += [(low, middle - 1, first, int(starts[at])), (middle + 1, high, int(starts[at]), last)]
        best = new
        cuts.append(cut)
    ends, at = [], size
    for cut in reversed(cuts):
        if at == 0:
            break
        ends.append(int(lengths[at - 1]))
        at = int(cut[at])
    return ends[::-1]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
         batch_tokens: int = BATCH_TOKENS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_tokens, bucket, padded_length, batch, slot); batch counts within its bucket."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), word_count(F.col(text)).alias("n_tokens"))
    rows = stored(rows)
    bins = rows.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow()
    lengths, counts = (bins[c].to_numpy() for c in ("n_tokens", "n"))
    order = np.argsort(lengths)
    lengths, counts = lengths[order], counts[order]
    ends = best_boundaries(lengths, counts, lengths * counts, buckets)
    if not ends:
        return rows.select("doc_id", "n_tokens", *(F.lit(None).cast(kind).alias(name) for name, kind in (
            ("bucket", "int"), ("padded_length", "long"), ("batch", "long"), ("slot", "long"))))
    held = [int(counts[(lengths > low) & (lengths <= end)].sum()) for low, end in zip([0, *ends], ends)]
    plan = [(i, end, sum(held[:i]), max(1, batch_tokens // end)) for i, end in enumerate(ends)]
    bucket = F.lit(None).cast("int")
    for i, end in reversed(list(enumerate(ends))):
        bucket = F.when(F.col("n_tokens") <= end, F.lit(i)).otherwise(bucket)
    sized = rows.where("n_tokens > 0").withColumns({"bucket": bucket, "_mixed": F.xxhash64(F.lit(seed), "doc_id")})
    placed = running_totals(sized, ["bucket", "_mixed", "doc_id"], {"_rank": F.lit(1)})
    plan = spark.createDataFrame(plan, "bucket int, padded_length long, _first long, _each long")
    at = F.col("_rank") - F.col("_first")
    packed = placed.join(F.broadcast(plan), "bucket").select(
        "doc_id", "n_tokens", "bucket", "padded_length",
        F.floor(at / F.col("_each")).cast("long").alias("batch"), (at % F.col("_each")).cast("long").alias("slot"))
    none = rows.where("n_tokens = 0").select("doc_id", "n_tokens", *(F.lit(None).cast(kind).alias(name) for name, kind in (
        ("bucket", "int"), ("padded_length", "long"), ("batch", "long"), ("slot", "long"))))
    return packed.union(none)
