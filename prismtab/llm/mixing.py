"""Mixing sources to target weights by weighted fair queueing.

Every document, in shuffled order within its source, gets a virtual finish time: the words of its
source up to its end, divided by the target of the source. The mix is the prefix of the global order
of finish times that fits the budget (the words of all documents); the copy that crosses the target of
its source is cut there. A source may be gone through up
to `most` times, so a document is offered once for each pass.

Nulls: a null text has no words, a null source is a source of its own, after all others. Documents
without words are kept with taken 0. Ties in the shuffle are ordered by doc_id, then size, then a hash of
the text; rows that repeat are told apart by a stored number, so each takes its own place. An empty
table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismtab.llm.common import running_totals, stored, word_count

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 20240


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, place, size_before, source_size, weight, target) from rows (source, source_size).

    The level of the shares is the one at which sources that reach `most` times their size stop and
    the others share the rest by weight: sources are ordered by the level at which they stop, and the
    first one whose share of the rest is not above its own stop gives the level.
    """
    ranked = running_totals(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"],
                            {"place": F.lit(1), "size_before": "source_size"})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.drop("_null").withColumn("weight", weight.cast("long")))
    ranked = ranked.withColumn("_stop", most * F.col("source_size") / F.col("weight"))
    whole = ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    words, all_weights = whole["words"] or 0, whole["weights"] or 0
    stops = running_totals(ranked, ["_stop", "place"], {"_words": most * F.col("source_size"), "_weights": "weight"})
    level = (F.lit(words) - F.col("_words")) / (F.lit(all_weights) - F.col("_weights"))
    found = (stops.withColumn("_level", level).where("_level <= _stop")
             .agg(F.min_by("_level", F.struct("_stop", "place")).alias("level")).first()["level"])
    target = F.least(most * F.col("source_size").cast("double"), F.col("weight") * F.lit(float(found or 0.0)))
    return ranked.drop("_stop").withColumn("target", target)


def fair_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
             weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The documents with size, source_size, target, copies (whole), part (words of the copy that is cut
    where the source meets its target) and taken (words, repeats counted)."""
    columns = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "part", "taken")]
    # Stored with the number of each row: read twice, the number must stay the same.
    whole = stored(docs.withColumns({"_size": word_count(F.col(text)), "_mixed": F.xxhash64(F.lit(seed), F.col(doc_id)),
                                     "_hash": F.xxhash64(F.col(text)), "_nth": F.monotonically_increasing_id()})
                   .select(*(f"`{c}`" for c in dict.fromkeys([*columns, doc_id, source])), "_size", "_mixed", "_hash", "_nth"))
    rows = whole.select(F.col(doc_id).alias("_id"), F.col(source).alias("source"), F.col("_size").alias("size"), "_mixed", "_hash", "_nth")
    sizes = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = stored(source_targets(sizes, weights, most))
    budget = sizes.agg(F.sum("source_size")).first()[0] or 0

    named = targets.withColumnRenamed("source", "_source")
    offered = rows.where("size > 0").join(named, F.col("source").eqNullSafe(F.col("_source")))
    own = ["_mixed", "_id", "size", "_hash", "_nth"]
    placed = running_totals(offered.select(*own, "place", "size_before", "source_size", "target"), ["place", *own], {"_all_before": "size"})
    end = F.col("_all_before") - F.col("size_before") + F.col("size")
    passes = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    passes = (passes.withColumn("_end", F.col("pass") * F.col("source_size") + end)
              .withColumn("finish", F.col("_end") / F.col("target")))
    queued = running_totals(passes.select(*own, "place", "pass", "_end", "finish"), ["finish", "place", "pass", *own], {"_ahead": "size"})
    fits = (F.col("_ahead") + F.col("size") <= budget) & (F.col("finish") <= 1)
    # Within a source the mix is a prefix of (pass, shuffled place): one row says where it ends, and
    # which copy is cut so that the source meets its target.
    one = F.struct("pass", *own)
    ends = queued.groupBy("place").agg(
        F.max(F.when(fits, one)).alias("_last"), F.min(F.when(~fits, one)).alias("_next"),
        F.coalesce(F.max(F.when(fits, F.col("_end"))), F.lit(0)).alias("_whole"))
    left = (F.round("target") - F.col("_whole")).cast("long")
    cuts = stored(named.join(ends, "place", "left").select(
        "_source", "source_size", "target", "_last", "_next",
        F.when(F.col("_next").isNotNull(), F.least(F.greatest(left, F.lit(0)), F.col("_next.size"))).alias("_left")))

    kept = whole.join(cuts, F.col(source).eqNullSafe(F.col("_source")), "left")
    this = F.struct(F.col("_mixed"), F.col(doc_id).alias("_id"), F.col("_size").alias("size"), F.col("_hash"), F.col("_nth"))
    at = {name: F.struct(*(F.col(f"{name}.{part}").alias(part) for part in own)) for name in ("_last", "_next")}
    copies = F.when((F.col("_size") > 0) & F.col("_last").isNotNull(),
                    F.col("_last.pass") + F.when(this <= at["_last"], 1).otherwise(0)).otherwise(0)
    part = F.when((F.col("_size") > 0) & F.col("_next").isNotNull() & (this == at["_next"]), F.col("_left")).otherwise(0)
    kept = kept.withColumns({"_copies": copies.cast("long"), "_part": part.cast("long")})
    return kept.select(
        *(F.col(f"`{c}`") for c in columns),
        F.col("_size").alias("size"), kept["source_size"].alias("source_size"), kept["target"].alias("target"),
        F.col("_copies").alias("copies"), F.col("_part").alias("part"),
        (F.col("_copies") * F.col("_size") + F.col("_part")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of the documents: each document as often as it was taken, the
    copy that is cut once more if at least half of it was taken."""
    inner = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # no name clashes with a result
    named = {c: inner[options.pop(c, c)] for c in ("doc_id", "text", "source")}
    mix = fair_mix(docs.toDF(*inner.values()), **named, **options)
    times = (F.col("copies") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)).cast("int")
    again = mix.where(times > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), times)))
    return again.select(*(F.col(name).alias(c) for c, name in inner.items()))
