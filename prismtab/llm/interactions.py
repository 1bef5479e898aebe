"""Audit of how filters act on each other: what each of five filters removes at each step of every order.

Each document fails a set of filters, written as its letters. Documents of one part that fail the same
set are one cell, with its counts, so a part has at most 32 cells however many rows it holds. A cell
folds over the array of all 120 orders (`transform` over orders, `aggregate` over the five steps) into
600 structs weighted by its counts; equal places of the arrays of a part are added up.

The copies filter E needs the whole table. Rows are counted by (doc_id, text digest, part, failures)
first; the smallest doc_id of a digest is an aggregate that combines before its shuffle, and only that
one row for each digest goes back to the counts, by digest and doc_id together. So a text that a third
of all rows share never meets in one task.

Null texts count as empty (they fail A, and E if a smaller doc_id holds an empty text too), null parts
as ''. A row with a null doc_id never fails E, makes no other row fail it and has no label. Rows that
repeat a doc_id and its text count once each and do not make each other fail E. If labels repeat a
doc_id, one row that marks it is enough. An empty table gives an empty result. Other columns are not
read, so their names cannot clash. Texts are read whole, by column expressions alone.
"""
from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismtab.llm.common import SPACES, stored

FILTERS = "ABCDE"
MARKS = r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEWEST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITALS_PERCENT = 2
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def own_failures(text: Column, words: Column, distinct: Column) -> Column:
    """Letters of the filters A to D that a text fails, in order."""
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return F.concat(
        F.when(words < FEWEST_WORDS, "A").otherwise(""),
        F.when(100 * distinct < DISTINCT_PERCENT * words, "B").otherwise(""),
        F.when(100 * capitals > CAPITALS_PERCENT * F.length(text), "C").otherwise(""),
        F.when(text.rlike(MARKS), "D").otherwise(""))


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, failed, n): the number of rows of a doc_id that fail just these filters."""
    whole = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), whole.alias("text"))
    read = read.withColumn("_inner", F.btrim("text", F.lit(SPACES)))
    read = read.withColumn("_words", F.split("_inner", r"[\x20\x09-\x0D]+"))
    some = F.col("_inner") != ""
    read = read.withColumns({"_n": F.when(some, F.size("_words")).otherwise(0),
                             "_distinct": F.when(some, F.size(F.array_distinct("_words"))).otherwise(0)})
    rows = stored(
        read.select("doc_id", "part", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"),
                    own_failures(F.col("text"), F.col("_n").cast("long"), F.col("_distinct").cast("long")).alias("failed"))
        .groupBy("doc_id", "digest", "part", "failed").agg(F.count("*").alias("n")))
    firsts = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    late = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (rows.join(firsts, ["digest", "doc_id"], "left")
            .withColumn("failed", F.concat("failed", F.when(late, "E").otherwise("")))
            .groupBy("doc_id", "part", "failed").agg(F.sum("n").alias("n")))


def cells(failed: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(part, failed, n, good, toxic): documents of each part that fail just these filters."""
    failed = stored(failed)
    by = ["part", "failed"]
    marks = labels.groupBy(F.col(doc_id).alias("doc_id")).agg(
        F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("long")).alias("good"),
        F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("long")).alias("toxic"))
    every = failed.select(*by, "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    marked = failed.join(marks, "doc_id").select(
        *by, F.lit(0).cast("long").alias("n"), (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic"))
    return every.unionByName(marked).groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def weighted(when: Column, weight: Column) -> Column:
    return F.when(when, weight).otherwise(F.lit(0).cast("long"))


def fold(order: Column) -> Column:
    """The five steps of one order for one cell: what it keeps, removes and loses at each."""
    kind = "array<struct<filter_order:string,step:int," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
    start = F.struct(F.lit(False).alias("gone"), F.array().cast(kind).alias("steps"))
    n, good, toxic, failed = (F.col(c) for c in ("n", "good", "toxic", "failed"))

    def next_step(state: Column, step: Column) -> Column:
        letter = F.substring(order, step, F.lit(1))
        fails = F.instr(failed, letter) > 0
        here = fails & ~state["gone"]
        gone = state["gone"] | fails
        counts = [weighted(~gone, n), weighted(here, n), weighted(fails & state["gone"], n), weighted(failed == letter, n),
                  weighted(here, good), weighted(here, toxic)]
        row = F.struct(order.alias("filter_order"), step.alias("step"), *(c.alias(name) for name, c in zip(COUNTS, counts)))
        return F.struct(gone.alias("gone"), F.concat(state["steps"], F.array(row).cast(kind)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), start, next_step, lambda state: state["steps"])


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row for each part, order and step with its counts, and in `shapley` all that the step's filter
    removes in the part, over all orders. `labels` has doc_id, quality and toxic."""
    orders = F.array(*(F.lit("".join(o)) for o in permutations(FILTERS)))
    folded = cells(failures(docs, doc_id, text, part), labels, doc_id).select(
        "part", F.explode(F.flatten(F.transform(orders, fold))).alias("at"))
    merged = (folded.select("part", "at.*").groupBy("part", "filter_order", "step")
              .agg(*(F.sum(c).alias(c) for c in COUNTS)))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    return merged.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))
