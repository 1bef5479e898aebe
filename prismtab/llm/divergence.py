"""Divergence of the sources of each language, and the terms that set a source apart, in exact integers.

Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased. A language keeps the
terms that enough of its documents hold. With V kept terms and N occurrences of them, a group (language
and source, or the whole language) gives a term of `count` occurrences the share
p = 1 + floor(10^9 * (count + 5) / (N + 5 V)).

Tasks count terms in bounded tables before anything is shuffled. Each language's vocabulary is dealt by
hash into blocks of bounded size, and each group holds one array of (term id, count), sorted by id, in
each block. The sources of a language are dealt into tiles; the arrays of two tiles are co-grouped for
each block, and each unordered pair of groups is one merge: a galloping search of the shorter array in
the longer one finds the common terms, which are priced together; terms of one side are priced against
the other side's share of a term it does not hold; terms of neither side are counted and priced once
for both. The sum counts for both directions of a pair. A task holds two tiles of one block, however
large the vocabulary or the number of sources.

Null language, source and text count as ''. Texts are read whole, in pieces that end between terms. Rows
are documents, also rows that repeat. A group without terms takes part in all pairs; a language that
keeps no term has distance 0 between all its sources. Ties are ordered by item, by its UTF-8 bytes. An
empty table gives an empty result. Other columns are not read, so their names cannot clash.
"""
from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismtab.llm.common import small_batches, stored

LEAST_DOCS = 30
TOP = 50
SCALE = 1_000_000_000
ADDED = 5
TERM, BREAK = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
#: A text is counted in pieces of about this many bytes; a task's tables are handed on at this many terms.
PIECE_BYTES, TABLE_TERMS = 1 << 20, 200_000
BLOCK_TERMS, TILE_SOURCES, CHUNK = 1 << 16, 16, 256
GROUP = ["lang", "source"]


def terms_of(raw: bytes) -> Counter:
    """Occurrences of each term in a text (UTF-8)."""
    raw, found, at = raw.lower(), Counter(), 0
    while at < len(raw):
        cut = BREAK.search(raw, min(len(raw), at + PIECE_BYTES))
        end = cut.start() if cut else len(raw)
        found.update(TERM.findall(raw, at, end))
        at = max(end, at + 1)
    return found


def term_counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up within each task; also one row
    with an empty term for each group, so that groups without terms stay."""
    def batches(parts):
        tables, held = {}, 0

        def rows():
            flat = [(*group, term, n, docs_of[term]) for group, (count, docs_of) in tables.items() for term, n in count.items()]
            flat += [(*group, b"", 0, 0) for group in tables]
            columns = list(zip(*flat))
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "term", "n", "docs"])

        for part in parts:
            for name, origin, raw in zip(*(part.column(i).to_pylist() for i in range(3))):
                count, docs_of = tables.setdefault((name, origin), (Counter(), Counter()))
                before, found = len(count), terms_of(raw)
                count.update(found)
                docs_of.update(found.keys())
                held += len(count) - before
                if held >= TABLE_TERMS:
                    yield rows()
                    tables, held = {}, 0
        if tables:
            yield rows()

    small_batches(docs.sparkSession)
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    return read.mapInArrow(batches, "lang string, source string, term binary, n long, docs long")


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n, term_id, once) of the kept terms and of the empty term; `once` is 1 in
    one row of each kept term of a language. One shuffle, by language and term, serves all steps."""
    mine = Window.partitionBy("lang", "term")
    summed = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    wide = summed.withColumn("_row", F.monotonically_increasing_id()).withColumns({
        "lang_n": F.sum("n").over(mine), "lang_docs": F.sum("docs").over(mine), "term_id": F.min("_row").over(mine)})
    once = (F.col("_row") == F.col("term_id")) & (F.col("term") != F.lit(b""))
    return (wide.where((F.col("lang_docs") >= least_docs) | (F.col("term") == F.lit(b"")))
            .select("lang", "source", "term", "n", "lang_n", "term_id", once.cast("long").alias("once")))


def share(count: str, held: str, vocabulary: str) -> Column:
    """p as a long, exact: the product is a decimal."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (F.col(count) + ADDED)
    return 1 + F.call_function("div", above, F.col(held) + ADDED * F.col(vocabulary))


def shares(count: np.ndarray, held: int, vocabulary: int) -> np.ndarray:
    """The same for an array: long division, three digits at a time, so that nothing overflows below 9 * 10^15 occurrences."""
    below = held + ADDED * vocabulary
    rest, found = count.astype(np.int64) + ADDED, np.zeros(len(count), np.int64)
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // below
        rest = rest % below
    return found + 1


def common(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common values of two sorted arrays without repeats. The search gallops: for each chunk of the
    shorter one, steps that double bound the stretch of the longer one in which the chunk can lie."""
    mine, theirs, low = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for start in range(0, len(short), CHUNK):
        part, step = short[start:start + CHUNK], CHUNK
        high = low
        while high < len(long) and long[high] <= part[-1]:
            high, step = min(len(long), high + step), step * 2
        place = low + np.searchsorted(long[low:high], part)
        inside = np.flatnonzero(place < high)
        equal = inside[long[place[inside]] == part[inside]]
        mine.append(start + equal)
        theirs.append(place[equal])
        low = int(place[-1])
    return np.concatenate(mine), np.concatenate(theirs)


def merge(a: tuple, b: tuple) -> tuple[int, int]:
    """(sum of differences over the terms that either group holds, their number) of two groups (ids, shares, share of
    a term that the group does not hold) in one block."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    mine, theirs = common(a[0], b[0])
    value = int(np.abs(a[1][mine] - b[1][theirs]).sum())
    for one, places, absent in ((a, mine, b[2]), (b, theirs, a[2])):
        rest = np.abs(one[1] - absent)
        value += int(rest.sum() - rest[places].sum())
    return value, len(a[0]) + len(b[0]) - len(mine)


PAIRS = "lang string, a string, b string, value long, held long, vocabulary long, gap long"


def merge_tiles(left: pa.Table, right: pa.Table) -> pa.Table:
    """All unordered pairs of groups of two tiles in one block; of one tile with itself each pair once."""
    def groups(table):
        found = []
        for source, held, vocabulary, terms in zip(*(table.column(c) for c in ("source", "held", "vocabulary", "terms"))):
            n, v, items = held.as_py(), vocabulary.as_py(), terms.values
            ids, counts = ((items.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)) if items is not None
                           else (np.empty(0, np.int64), np.empty(0, np.int64)))
            priced = (shares(counts, n, v), int(shares(np.zeros(1, np.int64), n, v)[0])) if v else (counts, 0)
            found.append((source.as_py(), v, (ids, *priced)))
        return found

    rows = []
    if left.num_rows and right.num_rows:
        lang, same = left.column("lang")[0].as_py(), left.column("i")[0].as_py() == left.column("j")[0].as_py()
        others = groups(right)
        for a, vocabulary, mine in groups(left):
            for b, _, theirs in others:
                if a < b or (a > b and not same):
                    value, held = merge(mine, theirs)
                    rows.append((lang, min(a, b), max(a, b), value, held, vocabulary, abs(mine[2] - theirs[2])))
    names, kinds = zip(*(c.split() for c in PAIRS.split(", ")))
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(c, pa.string() if k == "string" else pa.int64()) for c, k in zip(columns, kinds)], names=list(names))


def pair_values(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, a, b, value): each unordered pair of sources of a language once, a before b."""
    largest = totals.groupBy("lang").agg(F.max("vocabulary").alias("v"), F.count("*").alias("s")).agg(F.max("v"), F.max("s")).first()
    blocks = max(1, math.ceil((largest[0] or 0) / BLOCK_TERMS))
    tiles = max(1, math.ceil((largest[1] or 0) / TILE_SOURCES))
    arrays = (kept.where(F.col("term") != F.lit(b"")).withColumn("block", F.pmod(F.xxhash64("term_id"), F.lit(blocks)).cast("int"))
              .groupBy(*GROUP, "block").agg(F.sort_array(F.collect_list(F.struct("term_id", "n"))).alias("terms")))
    grid = totals.select(*GROUP, "held", "vocabulary", F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int").alias("tile"),
                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    grid = stored(grid.join(arrays, [*GROUP, "block"], "left"))
    task = ["lang", "block", "i", "j"]
    columns = [*GROUP, "block", "held", "vocabulary", "terms"]
    left = grid.select(*columns, F.col("tile").alias("i"), F.explode(F.sequence("tile", F.lit(tiles - 1))).alias("j"))
    right = grid.select(*columns, F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("i"), F.col("tile").alias("j"))
    right = right.toDF(*right.columns)  # columns of its own: both sides come from one table
    merged = left.groupBy(*task).cogroup(right.groupBy(*task)).applyInArrow(merge_tiles, PAIRS)
    absent = (F.max("vocabulary") - F.sum("held")) * F.max("gap")
    return merged.groupBy("lang", "a", "b").agg((F.sum("value") + absent).alias("value"))


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
               least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has every other source of the language by the sum of
    the differences of all shares; part `term` the `top` terms that the group has more of than its language."""
    kept = stored(kept_terms(term_counts(docs, lang, source, text), least_docs))
    all_of = Window.partitionBy("lang")
    totals = stored(kept.groupBy(*GROUP).agg(F.sum("n").alias("held"), F.sum("once").alias("_own"))
                    .withColumns({"vocabulary": F.sum("_own").over(all_of), "lang_held": F.sum("held").over(all_of)}).drop("_own"))

    order = Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), "item")
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = (pair_values(kept, totals).select("lang", both.alias("way"), "value")
             .select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value").withColumn("rank", F.row_number().over(order)))

    gain = share("n", "held", "vocabulary") - share("lang_n", "lang_held", "vocabulary")
    terms = (kept.where("n > 0").join(totals, GROUP)
             .select(*GROUP, F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), gain.alias("value")).where("value > 0")
             .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return pairs.unionByName(terms)
