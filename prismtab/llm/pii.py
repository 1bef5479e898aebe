"""Personal data by bootstrapped contextual extraction.

Four base recognisers (email, ip, card, phone) and one for long hexadecimal keys give seeds. The words
around a seed make lexical patterns; the same patterns are taken around every other token that has
the shape of an identifier. Patterns and instances form a graph that Spark scores in rounds: the
confidence of a pattern is the mean score of the instances it surrounds, smoothed towards 0, and the
score of an unknown instance is the chance that at least one of its patterns is right. Unknown
instances whose score reaches the confidence count as seeds of the next round, so contexts that only
discovered identifiers lead to are found too; the rounds go on until the scores settle. Patterns with
too few seeds, or a confidence of at most 0.05, pass nothing on. Strings that look like a base kind but
fail its rule (an ip part above 255, a card that fails Luhn) count as instances of score 0. Patterns
with enough different seeds and a high confidence then mark the unknown identifiers they surround.
Base spans always stay.

All positions are in code points. Null text counts as empty: no spans. Spans of different kinds may
overlap; a discovered span that overlaps a base span is left out. Rows that repeat give equal rows. An
empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from prismtab.llm.common import parted, small_batches, stored

#: Kinds in the order of the spans, and their forms.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "discovered")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"(?<![A-Za-z0-9])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,128}(?![A-Za-z0-9])")
TOKEN = re.compile(r"[A-Za-z0-9_@+./:-]+", re.ASCII)
#: Marks that a shaped token does not start with, and that it does not end with.
NO_START, NO_END = "./:-", "@+./:-"
DIGITS = re.compile(r"[0-9]")

LEAST_SHAPE, LEAST_DIGITS = 8, 3
LEAST_SEEDS = 5
CONFIDENCE = 0.9
#: The rounds end when no confidence changes by this much and no pattern gains a seed.
TOLERANCE = 0.001
MOST_ROUNDS = 200
AROUND = 48


def emails(text: str):
    """Leftmost matches of local@domain: the run of local characters before each @, cut at the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        last = max(last, at + 1)
        at = text.find("@", last)


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_matches(text: str):
    """(kind, start, end, passes) of every leftmost match of a base form."""
    for start, end in emails(text):
        yield "email", start, end, True
    for m in IP.finditer(text):
        parts = (part.lstrip("0") for part in m.group().split("."))
        yield "ip", m.start(), m.end(), all(len(p) < 4 and int(p or 0) <= 255 for p in parts)
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        yield "card", m.start(), m.end(), 14 <= len(digits) <= 19 and luhn(digits)
    for m in PHONE.finditer(text):
        yield "phone", m.start(), m.end(), 10 <= len(DIGITS.findall(m.group())) <= 15


def patterns(text: str, start: int, end: int) -> list[int]:
    """Hashes of the lexical patterns around a span: two words before it, one on each side, and two behind it."""
    before = text[max(0, start - AROUND):start].lower().split()
    after = text[end:end + AROUND].lower().split()
    left = before[-2:]
    shapes = [" ".join(("L", *left)), " ".join(("B", left[-1], *after[:1]))] if left else []
    if after:
        shapes.append(" ".join(("R", *after[:2])))
    return [xxhash.xxh3_64_intdigest(s) - (1 << 63) for s in shapes]


def shaped(text: str):
    """(start, end) of the tokens that have the shape of an identifier; one look at each character."""
    for m in TOKEN.finditer(text):
        token = m.group().rstrip(NO_END)
        inner = token.lstrip(NO_START)
        if len(inner) >= LEAST_SHAPE and len(DIGITS.findall(inner)) >= LEAST_DIGITS:
            end = m.start() + len(token)
            yield end - len(inner), end


def seen_in(text: str):
    """(base spans, other spans, instances): instances are (start, end, value, score or None, patterns)."""
    matches = list(base_matches(text))
    base = sorted((s, BASE_KINDS.index(kind), e) for kind, s, e, passes in matches if passes)
    keys = [m.span() for m in SECRET.finditer(text)]
    instances, taken = [], []
    for start, end, score in [*((s, e, 1.0) for s, _, e in base), *((s, e, 1.0) for s, e in keys),
                              *((s, e, 0.0) for kind, s, e, passes in matches
                                if not passes and (kind != "card" or e - s >= 14))]:
        taken.append((start, end))
        instances.append((start, end, score))
    taken.sort()
    at = 0
    if DIGITS.search(text):
        for start, end in shaped(text):
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if at < len(taken) and taken[at][0] < end:
                continue
            instances.append((start, end, None))
    starts, furthest = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    others = [(s, KINDS.index("secret"), e) for s, e in keys if not (before := bisect_left(starts, e)) or furthest[before - 1] <= s]
    return base, others, [
        (s, e, xxhash.xxh3_64_intdigest(text[s:e]) - (1 << 63), score, found)
        for s, e, score in instances if (found := patterns(text, s, e))]


def digest(spans) -> str:
    return hashlib.sha256(",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans).encode()).hexdigest()


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
INSTANCE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("score", pa.float64()),
                      ("patterns", pa.list_(pa.int64()))])
FIELDS = ("base_sha256 string, spans array<struct<start:int,kind:int,end:int>>, "
          "seen array<struct<start:int,end:int,value:bigint,score:double,patterns:array<bigint>>>")


def scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row for each document: counts, digest and spans found at once, and the instances of the graph."""
    def batches(parts):
        for part in parts:
            rows = [seen_in(value.as_py() or "") for value in part.column(1)]
            counts = [pa.array([sum(k == i for _, k, _ in base) for base, _, _ in rows], pa.int64()) for i in range(len(BASE_KINDS))]
            spans = [[dict(zip(("start", "kind", "end"), s)) for s in sorted([*base, *others])] for base, others, _ in rows]
            seen = [[dict(zip(("start", "end", "value", "score", "patterns"), s)) for s in found] for _, _, found in rows]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), *counts, pa.array([digest(base) for base, _, _ in rows]),
                 pa.array(spans, pa.list_(SPAN)), pa.array(seen, pa.list_(INSTANCE))],
                names=["doc_id", "hash", *(f"n_{kind}" for kind in BASE_KINDS), "base_sha256", "spans", "seen"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text)).alias("hash")).mapInArrow(
        batches, f"doc_id {kind}, hash long, " + ", ".join(f"n_{kind} long" for kind in BASE_KINDS) + ", " + FIELDS)


def pattern_scores(seen: DataFrame, least_seeds: int = LEAST_SEEDS, confidence: float = CONFIDENCE,
                   tolerance: float = TOLERANCE) -> DataFrame:
    """(pattern, seeds, confidence) from occurrences (pattern, value, score); score is null for unknowns.

    The rounds start from 0, and no score ever falls. A pattern that passes its confidence on also gives it
    to the unknowns it surrounds, and so to itself: with d, the sum over its unknowns of the chance that all
    of their other patterns are wrong, its confidence c meets c (n + 0.5) = seeds + unknowns - (1 - c) d. This
    is solved for c in each round, so that many unknowns around few seeds take no more rounds than few.
    """
    edges = stored(seen.groupBy("pattern", "value").agg(F.max("score").alias("fixed")))
    fixed = stored(edges.groupBy("pattern").agg(
        F.count("*").alias("n"), F.count_if(F.col("fixed").isNull()).alias("unknown"), F.count_if(F.col("fixed") == 1).alias("ones")))
    unknowns = stored(edges.where("fixed IS NULL").select("pattern", "value"))
    scores = stored(fixed.select("pattern", F.col("ones").alias("seeds"), (F.col("ones") / (F.col("n") + 0.5)).alias("confidence")))
    for _ in range(MOST_ROUNDS):
        useful = scores.where((F.col("confidence") > 0.05) & (F.col("seeds") >= least_seeds)).select(
            "pattern", F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))).alias("wrong"))
        reached = stored(unknowns.join(useful, "pattern", "left"))
        values = reached.where("wrong IS NOT NULL").groupBy("value").agg(F.sum("wrong").alias("all_wrong"))
        score = 1 - F.exp("all_wrong")
        around = reached.join(values, "value").groupBy("pattern").agg(
            F.sum(score).alias("found"), F.count_if(score >= confidence).alias("more"),
            F.sum(F.exp(F.col("all_wrong") - F.col("wrong"))).alias("d"))  # null unless the pattern passes on
        apart = F.coalesce("d", F.lit(0.0))
        gained = F.when(F.col("d").isNotNull(), F.col("unknown") - F.col("d")).otherwise(F.coalesce("found", F.lit(0.0)))
        was = scores.select("pattern", F.col("seeds").alias("_seeds"), F.col("confidence").alias("_confidence"))
        new = stored(fixed.join(around, "pattern", "left").join(was, "pattern").select(
            "pattern", (F.col("ones") + F.coalesce("more", F.lit(0))).alias("seeds"),
            ((F.col("ones") + gained) / (F.col("n") + 0.5 - apart)).alias("confidence"), "_seeds", "_confidence"))
        changed = new.where((F.col("seeds") != F.col("_seeds")) | (F.abs(F.col("confidence") - F.col("_confidence")) >= tolerance))
        scores = new.select("pattern", "seeds", "confidence")
        if changed.limit(1).count() == 0:
            return scores
    raise RuntimeError(f"pattern scores did not settle in {MOST_ROUNDS} rounds")


def find_private(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 least_seeds: int = LEAST_SEEDS, confidence: float = CONFIDENCE, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, hash, n_email, n_ip, n_card, n_phone, base_sha256, spans, discovered): spans holds base and
    seed spans, discovered the ones that patterns have found, both as (start, kind, end) in order."""
    small_batches(docs.sparkSession)
    rows = stored(scan(docs, doc_id, text))
    at = rows.where(F.size("seen") > 0).select("doc_id", "hash", F.explode("seen").alias("s"))
    at = at.select("doc_id", "hash", "s.start", "s.end", "s.value", "s.score", F.explode("s.patterns").alias("pattern"))
    trusted = pattern_scores(at, least_seeds, confidence, tolerance).where((F.col("seeds") >= least_seeds) & (F.col("confidence") >= confidence))
    more = (at.where("score IS NULL").join(trusted, "pattern").select("doc_id", "hash", "start", "end").distinct()
            .groupBy("doc_id", "hash").agg(F.array_sort(F.collect_list(
                F.struct("start", F.lit(KINDS.index("discovered")).alias("kind"), "end"))).alias("discovered")))
    more = more.withColumnsRenamed({"doc_id": "_id", "hash": "_hash"})
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return (rows.drop("seen").join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("hash").eqNullSafe(F.col("_hash")), "left")
            .drop("_id", "_hash").withColumn("discovered", F.coalesce("discovered", none)))


def spans_text(spans) -> F.Column:
    """kind:start:end by start and kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str = "n_chars", **options) -> DataFrame:
    """The documents with every span replaced by <KIND>; overlapping spans become one of the first kind."""
    found = find_private(docs, doc_id, text, **options).where(F.size("spans") + F.size("discovered") > 0)
    found = stored(found.select("doc_id", "hash", F.array_sort(F.concat("spans", "discovered")).alias("_spans"))
                   .groupBy("doc_id", "hash").agg(F.first("_spans").alias("_spans")))
    found = found.withColumnsRenamed({"doc_id": "_id", "hash": "_hash"})
    near, apart = parted(docs, F.xxhash64(F.col(text)), found, "_hash")
    joined = near.join(found, F.col(doc_id).eqNullSafe(F.col("_id")) & F.xxhash64(F.col(text)).eqNullSafe(F.col("_hash")), "left")
    marked = joined.withColumn("_new", F.when(F.col("_spans").isNotNull(), with_marks(F.col(text).cast("string"), F.col("_spans"))))
    changed = {text: F.col("_new")} | ({length: F.length("_new").cast(docs.schema[length].dataType)} if length in docs.columns else {})
    return marked.select(*(F.when(F.col("_spans").isNull(), F.col(c)).otherwise(changed[c]).alias(c) if c in changed else F.col(c)
                           for c in docs.columns)).union(apart)


@F.arrow_udf(StringType())
def with_marks(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts with a mark in place of every span, cut once from start to end."""
    def one(text: str, found: list[dict]) -> str:
        parts, at = [], 0
        for span in found:
            if span["start"] >= at:
                parts += text[at:span["start"]], f"<{KINDS[span['kind']].upper()}>"
            at = max(at, span["end"])
        return "".join([*parts, text[at:]])

    return pa.array([None if s is None else one(t or "", s) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())
