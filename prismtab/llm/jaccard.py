"""Exact Jaccard join over word shingles: universe partition and pigeonhole.

Sets are grouped into size bands of ratio 1/threshold, so linked sets lie in one band or in two that
follow each other. Each band has a scheme: it bounds the symmetric difference d of any linked pair
whose smaller set lies in the band, and cuts the universe of shingle hashes into segments. A segment
worth one is indexed as it is; a segment worth two is indexed as it is and with each one of its
shingles deleted. The worths of a scheme add up to d + 1, so a linked pair must agree in a segment
worth one, or differ by at most one shingle in a segment worth two. Which worths a band uses is a
matter of cost: deletions cost index rows but let segments be larger, which collide less in bands
with many sets. A set is indexed under the scheme of its own band and of the band below.

Each set also has a d of its own: the largest difference of a linked pair that it is in. Segments count as
filled if they hold something, those worth two if they hold two shingles. A set whose filled segments are
worth d + 1 leaves keys of empty contents out of the index, which any two sets of a band may have in common:
a linked pair agrees in a filled segment, and the smaller of the two contents is not empty. If all are worth
one, it needs only the d + 1 of its keys that the fewest sets have (ties by key): the first key in this order
that a pair shares is among them on both sides. Schemes cut more segments than they must, so that nearly all
sets can do this, and keys of passages that many documents share are left out first.

Sets that share an index key are candidates. Each key first offers its smallest and its largest
member to all others, which is linear in the key; the links so found make components. Pairs of a key
that are still in different components are joined. Sizes and the parities of the shingles (a lower
bound of the symmetric difference) rule candidates out before any set is fetched; the rest are
verified on the shingle sets. So groups of copies cost one pair for each member, and no link is lost.

Shingles are 64-bit hashes; sets are told apart by 128 bits. Texts without words have an empty set
and link with nothing. Null text counts as empty. Rows with a null doc_id take part like others.
Documents with equal sets are one node, so rows that repeat (also with one doc_id) share a
component. An empty table gives an empty result.
"""
from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismtab.llm.common import bloom, components, forget, marked, parted, setting, small_batches, stored, total

WIDTH = 5
PERCENT = 80
#: The cost model: a candidate pair costs as much as this many index rows, and this part of the keys that a set can leave
#: out are keys of the pair. What pairs have in common without being linked is measured on a sample of at most PROFILE_DOCS documents; it decides costs and never results.
PAIR_COST, SPARE_PART, PROFILE_DOCS, PROFILE_CHARS, PROFILE_STEPS = 1, 1 / 8, 400, 20_000, 20
FOLDED_WORDS = 8
#: Bands are this much wider than they must be; wider bands need fewer keys for sets near two bands.
BAND_GROWTH = Fraction(5, 4)
KEY_BITS = 48
KNOWN_WORDS = 50_000
BATCH_BYTES, READER_ROWS = 2 << 20, 512
#: Keys are counted, and their candidates ruled out, in this many passes by the remainder of the key: what a pass
#: shuffles goes before the next one, and few pairs are left of each.
PASSES = 4
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    """Hashes of words, remembered up to a bound and then forgotten."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle.

    Bytes are lower-cased and split as the word rule says: A-Z only, and the six ASCII spaces.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, U)
    hashes = np.fromiter(map(known.__getitem__, words), dtype=U, count=len(words))
    take = min(width, len(words))
    value = np.full(len(words) - take + 1, take, dtype=U)
    for i in range(take):
        value = mixed(value * U(0x9E3779B97F4A7C15) + hashes[i:len(hashes) - take + 1 + i])
    return np.unique(value)


def most_apart(smaller: int, larger: int, percent: int) -> int:
    """The largest symmetric difference of a linked pair with these sizes."""
    return (smaller + larger) * (100 - percent) // (100 + percent)


def band_starts(percent: int, largest: int) -> list[int]:
    """First size of each band; bands grow by BAND_GROWTH times the ratio of the largest linked sizes."""
    starts, edge = [], Fraction(1)
    while edge <= largest:
        if not starts or math.ceil(edge) > starts[-1]:
            starts.append(math.ceil(edge))
        edge *= Fraction(100, percent) * BAND_GROWTH
    return starts


def bare(ones: int, twos: int, size: int) -> tuple[float, float]:
    """The chances that a segment worth one holds nothing, and that one worth two holds fewer than two shingles."""
    mean = size / (ones + 2 * twos)
    return math.exp(-mean), math.exp(-2 * mean) * (1 + 2 * mean)


def filled(ones: int, twos: int, size: int) -> float:
    """Worth of the filled segments, nearly always at least: the mean less three deviations."""
    one, two = bare(ones, twos, size)
    return ones * (1 - one) + 2 * twos * (1 - two) - 3 * math.sqrt(ones * one * (1 - one) + 4 * twos * two * (1 - two))


def needs(size: int, percent: int) -> int:
    """One more than the largest symmetric difference of a linked pair that a set of this size is in."""
    return most_apart(size, size * 100 // percent, percent) + 1


def overlaps(sets: list[np.ndarray], percent: int) -> list[tuple[float, float]]:
    """(part, share): the share of all pairs of the sets that have this part of the smaller set in common and do
    not link, for parts above 0 in steps. One pair in a million counts for the largest step at least."""
    sets = [values for values in sets if len(values)]
    of = np.repeat(np.arange(len(sets)), [len(values) for values in sets])
    values, place, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True) if sets else (np.empty(0),) * 3
    both = np.zeros((len(sets), len(sets)), np.int64)
    order = of[np.argsort(place, kind="stable")] if sets else of
    for end, count in zip(np.cumsum(held), held):
        if count > 1:
            mine = order[end - count:end]
            both[np.ix_(mine, mine)] += 1
    sizes = np.bincount(of, minlength=len(sets))
    x, y = np.triu_indices(len(sets), 1)
    x, y = (one[both[x, y] > 0] for one in (x, y)) if len(x) else (x, y)
    apart = 100 * both[x, y] < percent * (sizes[x] + sizes[y] - both[x, y])
    part = both[x, y][apart] / np.minimum(sizes[x], sizes[y])[apart]
    count = np.bincount(np.minimum((part * PROFILE_STEPS).astype(np.int64), PROFILE_STEPS - 1), minlength=PROFILE_STEPS)
    pairs = max(1, len(sets) * (len(sets) - 1) // 2)
    shares = np.maximum(count / pairs, [*[0] * (PROFILE_STEPS // 2), *[1e-6] * (PROFILE_STEPS - PROFILE_STEPS // 2)])
    return [((i + 0.5) / PROFILE_STEPS, float(share)) for i, share in enumerate(shares) if share]


def allocation(low: int, high: int, percent: int, sets: int, profile: list[tuple[float, float]]) -> tuple[int, int, int]:
    """(d + 1, segments worth one, segments worth two) of the scheme for sizes low..high with the least
    estimated cost: index rows, and the candidates among pairs that have something in common but do not link.

    A segment of s shingles agrees in a pair with the part p in common with the chance p^s. Keys that a set
    can leave out are taken from those it has in common first, as they are the frequent ones; a part of them counts
    here, since a set has something in common with many others. Where sets keep keys of empty contents, any pair collides.
    """
    need = needs(high, percent)
    most = max(need, int(low / 1.5))

    def enough(ones: int, twos: int) -> bool:
        return all(filled(ones, twos, size) >= needs(size, percent) for size in (low, high))

    wider = [m for m in sorted({need, *(int(need * g) for g in (1.1, 1.25, 1.5, 2, 2.5, 3)),
                                next((m for m in range(need, 2 * need + 1) if enough(m, 0)), need)}) if m <= most]
    pairs = [(need - 2 * twos, twos) for twos in sorted({max(1, need * i // 16) for i in range(1, 9)}) if 2 * twos <= need]
    options = [(m, 0) for m in wider] + [(ones, next((t for t in range(twos, 2 * twos + 1) if enough(ones, t)), twos)) for ones, twos in pairs]
    best = None
    for ones, twos in options:
        one = low / (ones + 2 * twos)
        spare = max(0.0, filled(ones, 0, low) - needs(low, percent)) * SPARE_PART if not twos else 0.0
        rows = ones + twos * (1 + 2 * one)
        hits = sum(share * (max(0.0, ones * part ** one - spare) + twos * 2 * one * part ** (2 * one - 1)) for part, share in profile)
        if not enough(ones, twos):
            no_one, no_two = bare(ones, twos, low)
            hits += ones * no_one ** 2 + twos * no_two ** 2
        cost = rows + PAIR_COST * hits * sets
        if best is None or cost < best[0]:
            best = (cost, ones, twos)
    return need, best[1], best[2]


class Schemes:
    """Starts of the bands and the allocation of each; small, one entry for each band of sizes."""

    def __init__(self, percent: int, counts: dict[int, int], largest: int, profile: list[tuple[float, float]] | None = None):
        profile = overlaps([], percent) if profile is None else profile
        self.percent = percent
        self.starts = np.array(band_starts(percent, largest + 1), dtype=np.int64)
        ends = [*self.starts[1:].tolist(), int(self.starts[-1]) * 3]
        held = [sum(c for size, c in counts.items() if low <= size < high) for low, high in zip(self.starts.tolist(), ends)]
        self.parts = [allocation(int(low), high - 1, percent, max(1, held[i]), profile)
                      for i, (low, high) in enumerate(zip(self.starts.tolist(), ends))]

    def keys(self, values: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Index keys of one set under the scheme of its band, and of the band below if it can link into it; and how
        many of them can be left out, for schemes of even and of odd number. The bit above a key tells the two apart."""
        band = int(np.searchsorted(self.starts, len(values), side="right")) - 1
        inner = mixed(values + U(0x632BE59BD9B4E019))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(inner, dtype=U)])
        found, spare = [np.empty(0, np.int64)], [0, 0]
        for scheme in (band, band - 1):
            if scheme < 0 or scheme < band and self.percent * len(values) > 100 * (int(self.starts[band]) - 1):
                continue
            _, ones, twos = self.parts[scheme]
            need = needs(len(values), self.percent) if scheme == band else most_apart(int(self.starts[band]) - 1, len(values), self.percent) + 1
            weight = ones + 2 * twos
            place = ((values >> U(32)) * U(weight)) >> U(32)
            segment = np.where(place < ones, place, ones + (place - np.minimum(place, U(ones))) // U(2)).astype(np.int64)
            cuts = np.searchsorted(segment, np.arange(ones + twos + 1))
            tag = mixed(np.arange(ones + twos, dtype=U) + U((scheme + 1) << 32))
            content = sums[cuts[1:]] - sums[cuts[:-1]]
            whole = mixed(content + tag)
            size = cuts[1:] - cuts[:-1]
            leave = np.count_nonzero(size[:ones]) + 2 * np.count_nonzero(size[ones:] > 1) >= need
            mine = [whole[size > 0] if leave else whole]
            if twos:
                of = segment[cuts[ones]:]
                less = mixed(content[of] - inner[cuts[ones]:] + tag[of])
                mine.append(less[size[of] > 1] if leave else less)
            mine = np.unique(np.concatenate(mine) >> U(64 - KEY_BITS)).view(np.int64)
            found.append(mine + ((scheme & 1) << KEY_BITS))
            spare[scheme & 1] = max(0, len(mine) - need) if leave and not twos else 0
        return np.concatenate(found), spare


def parity(values: np.ndarray) -> np.ndarray:
    """Parities of the shingles over a power of two of bits, at least two for each shingle: two sets differ in at
    least as many shingles as their parities differ in bits. Halves laid over each other (xor) are the
    parities over half the bits."""
    bits = max(64 * FOLDED_WORDS, 1 << int(2 * max(1, len(values)) - 1).bit_length())
    odd = np.bincount((values % U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


FOLDED = [f"f{i}" for i in range(FOLDED_WORDS)]


def identity(values: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(values.tobytes())
    return (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]) if parts else np.zeros(1)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


def index_rows(docs: DataFrame, doc_id: str, text: str, width: int, schemes: Schemes) -> DataFrame:
    """(doc_id, hash, n, k1, k2, odd, f0.., keys, even, uneven): hash of the text, size, identity, parities (also folded to few words),
    index keys and spare keys of each document's set."""
    def batches(parts):
        known, none = WordHashes(), (np.empty(0, np.int64), [0, 0])
        for part in parts:
            sets = [shingle_set(value.as_py(), width, known) for value in part.column(2)]
            names = [identity(values) for values in sets]
            odd = [parity(values) for values in sets]
            keys = [schemes.keys(v) if len(v) else none for v in sets]
            few = np.array([np.bitwise_xor.reduce(p.reshape(-1, FOLDED_WORDS), axis=0) for p in odd]).reshape(-1, FOLDED_WORDS)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(v) for v in sets], pa.int64()), *(pa.array([k[i] for k in names], pa.int64()) for i in (0, 1)),
                 lists(odd),
                 *(pa.array(few[:, i]) for i in range(FOLDED_WORDS)), lists([k for k, _ in keys]),
                 *(pa.array([spare[i] for _, spare in keys], pa.int32()) for i in (0, 1))],
                names=["doc_id", "hash", "n", "k1", "k2", "odd", *FOLDED, "keys", "even", "uneven"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).cast("string").alias("text")).mapInArrow(
        batches, f"doc_id {kind}, hash long, n long, k1 long, k2 long, odd array<long>, {', '.join(f + ' long' for f in FOLDED)}, keys array<long>, even int, uneven int")


SIDE = f"shiftright(key, {KEY_BITS})"


def needed(entries: DataFrame) -> DataFrame:
    """The entries (key, id, spare, held) without the most frequent keys that each set can leave out."""
    rank = F.row_number().over(Window.partitionBy("id", "side").orderBy(F.col("held").desc(), F.col("key").desc()))
    return entries.withColumn("side", F.expr(SIDE)).withColumn("_rank", rank).where(F.col("_rank") > F.col("spare")).select("key", "id")


def entries_of(rows: DataFrame, nodes: DataFrame, held: Broadcast, use: Broadcast | None = None, turn: int | None = None) -> DataFrame:
    """(key, id, spare): index keys of one document of each set, by its doc_id, with the number of keys of that
    scheme which it can leave out; with `use`, only keys that its bits may hold, with `turn` only those of a pass.
    `held` has the bits of the sets that several documents have.

    Only documents that may have an equal one are shuffled to choose it; the others pass in place.
    """
    def part_of(twins: bool):
        def batches(parts):
            for part in parts:
                part = part.take(pa.array(np.flatnonzero(marked(held.value, part.column(1).to_numpy()) == twins)))
                if use is not None or turn is not None:
                    keys = part.column(3)
                    flat = keys.flatten().to_numpy()
                    kept = marked(use.value, flat) if use is not None else flat % PASSES == turn
                    ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(keys.value_lengths().to_numpy())]).astype(np.int64)]
                    part = part.set_column(3, "keys", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[kept])))
                yield part
        return batches

    rows = rows.where("n > 0").select("doc_id", "k1", "k2", "keys", "even", "uneven")
    held_by = ["doc_id", "keys", "even", "uneven"]
    alone = rows.mapInArrow(part_of(False), rows.schema).select(*held_by)
    reps = nodes.select("k1", "k2", F.col("first_id").alias("_first"))
    twins = rows.mapInArrow(part_of(True), rows.schema).join(reps, ["k1", "k2"]).where(F.col("doc_id").eqNullSafe(F.col("_first")))
    entries = alone.union(twins.dropDuplicates(["k1", "k2"]).select(*held_by)).select(
        F.explode("keys").alias("key"), F.col("doc_id").alias("id"), "even", "uneven")
    return entries.select("key", "id", F.expr(f"if({SIDE} = 0, even, uneven)").alias("spare"))


def measured(docs: DataFrame, text: str, width: int, percent: int) -> list[tuple[float, float]]:
    """What pairs have in common, from a sample of documents by the hash of their text, copies once."""
    spread = F.xxhash64(F.lit(PROFILE_DOCS), F.col(text))
    sample = docs.where(F.length(text) > 0).select(spread.alias("h"), F.substring(F.col(text), 1, PROFILE_CHARS).alias("t"))
    chosen = sample.select("h").distinct().orderBy("h").limit(PROFILE_DOCS)
    texts = sample.join(F.broadcast(chosen), "h").groupBy("h").agg(F.first("t").alias("t")).collect()
    known = WordHashes()
    return overlaps([shingle_set(r["t"], width, known) for r in texts], percent)


def fetch_sets(docs: DataFrame, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """(node, items): the shingle sets of the wanted nodes (node, k1, k2), made from the texts again."""
    held = docs.sparkSession.sparkContext.broadcast(bloom(wanted))

    def batches(parts):
        known = WordHashes()
        for part in parts:
            sets = [shingle_set(value.as_py(), width, known) for value in part.column(0)]
            sets = [(identity(values), values.view(np.int64)) for values in sets if len(values)]
            use = marked(held.value, np.array([k[0] for k, _ in sets], dtype=np.int64))
            sets = [one for one, used in zip(sets, use) if used]
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k, _ in sets], pa.int64()) for i in (0, 1)] + [lists([v for _, v in sets])],
                                             names=["k1", "k2", "items"])

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(batches, "k1 long, k2 long, items array<long>")
    sets = stored(found.join(wanted, ["k1", "k2"]).dropDuplicates(["node"]).select("node", "items"))
    held.destroy()
    return sets


def close(apart, percent: int):
    """The sizes of a and b, and a lower bound of their difference, leave a link open."""
    sizes = F.col("a_n") + F.col("b_n")
    return (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & (apart * (100 + percent) <= sizes * (100 - percent))


def may_link(percent: int):
    return close(total([F.bit_count(F.col(f"a_{f}").bitwiseXOR(F.col(f"b_{f}"))) for f in FOLDED]), percent)


def may_link_by_all(percent: int):
    """The same by all parities; the longer list is folded to the length of the other. From 50 percent on, sizes
    that leave a link open have lists of one length or of two that double."""
    def halved(mine: str, other: str):
        half = (F.size(mine) / 2).cast("int")
        laid = F.zip_with(F.slice(mine, 1, half), F.slice(mine, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(mine) > F.size(other), laid).otherwise(F.col(mine))

    bits = F.zip_with(halved("a_odd", "b_odd"), halved("b_odd", "a_odd"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return close(F.aggregate(bits, F.lit(0), lambda x, y: x + y), percent)


def document() -> F.Column:
    """What orders the documents of a component."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("hash"))


def sided(nodes: DataFrame, side: str, columns: list[str]) -> DataFrame:
    return nodes.select(*(F.col(c).alias(f"{side}_{c}") for c in columns))


def filtered(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a_node, b_node) those that sizes and parities leave open, as (a, b)."""
    few = ["node", "n", *FOLDED]
    pairs = pairs.join(sided(nodes, "a", few), "a_node").join(sided(nodes, "b", few), "b_node").where(may_link(percent))
    return by_all_parities(pairs.select("a_node", "b_node", "a_n", "b_n"), nodes, percent)


def by_all_parities(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a_node, b_node, a_n, b_n) those that all parities leave open, as (a, b)."""
    if percent < 50:
        return pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    pairs = pairs.join(sided(nodes, "a", ["node", "odd"]), "a_node").join(sided(nodes, "b", ["node", "odd"]), "b_node")
    return pairs.where(may_link_by_all(percent)).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def verified(pairs: DataFrame, docs: DataFrame, text: str, width: int, percent: int, nodes: DataFrame) -> DataFrame:
    """Of the candidate pairs (a, b) those whose sets link."""
    pairs = stored(pairs)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = stored(nodes.select("node", "k1", "k2").join(ends, "node", "left_semi"))
    sets = fetch_sets(docs, text, width, wanted)
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("_x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    found = stored(pairs.join(left, "a").join(right, "b").withColumn("_both", both)
                   .where(100 * F.col("_both") >= percent * (F.size("_x") + F.size("_y") - F.col("_both"))).select("a", "b"))
    forget(pairs, sets, wanted)
    return found


def of_turn(rows: DataFrame, turn: int) -> DataFrame:
    return rows.where(F.pmod(F.col("key"), F.lit(PASSES)) == turn)


def offered(shared: DataFrame) -> DataFrame:
    """(a_node, b_node): the smallest and the largest member of each key, with all its others."""
    ends = shared.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    tied = shared.select("key", "node").join(ends, "key")
    pairs = tied.select("node", "low").union(tied.select("node", "high")).toDF("x", "y").where("x <> y")
    return pairs.select(F.least("x", "y").alias("a_node"), F.greatest("x", "y").alias("b_node")).distinct()


def similarity_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT):
    """(membership, links): doc_id, n_shingles, node and component_id of every document; and the links
    (a, b) between nodes that were verified, enough of them to connect every component."""
    member, links = full_join(docs, doc_id, text, width, percent)
    return member.select("doc_id", "n_shingles", "node", "component_id"), links


def full_join(docs: DataFrame, doc_id: str, text: str, width: int, percent: int):
    """What `joined` gives, computed with fewer rows in a batch of the reader, since rows hold long lists of keys."""
    with setting(docs.sparkSession, "spark.sql.parquet.columnarReaderBatchSize", READER_ROWS):
        return joined(docs, doc_id, text, width, percent)


def joined(docs: DataFrame, doc_id: str, text: str, width: int, percent: int):
    """The two results of `similarity_join`, with the hash of each document's text, and `first`: the document (no_id, doc_id, hash) that
    comes first in its component, by doc_id, null last, then by hash; null without words."""
    small_batches(docs.sparkSession, BATCH_BYTES)
    guess = F.greatest(F.lit(1), F.length(F.col(text)) / 7).cast("long")
    rough = F.pow(F.lit(2.0), F.floor(8 * F.log2(guess)) / 8).cast("long")  # eight steps to a doubling, finer than the bands
    counts = {r["s"]: r["n"] for r in docs.where(F.length(text) > 0).groupBy(rough.alias("s")).agg(F.count("*").alias("n")).collect()}
    longest = docs.agg(F.max(F.length(text))).first()[0] or 1
    schemes = Schemes(percent, counts, longest, measured(docs, text, width, percent))

    indexed = stored(index_rows(docs, doc_id, text, width, schemes))
    rows = stored(indexed.select("doc_id", "hash", "n", "k1", "k2"))
    nodes = indexed.where("n > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("first_id"), F.min(document()).alias("first"), F.count("*").alias("held"), *(F.first(c).alias(c) for c in ("n", "odd", *FOLDED)))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))

    context = docs.sparkSession.sparkContext
    held = context.broadcast(bloom(nodes.where("held > 1")))
    counted = [stored(entries_of(indexed, nodes, held, turn=turn).groupBy("key").agg(F.count("*").alias("held")).where("held > 1")) for turn in range(PASSES)]
    often = reduce(DataFrame.unionByName, counted)
    use = context.broadcast(bloom(often, "key"))
    met = stored(entries_of(indexed, nodes, held, use).join(often, "key"))
    held.destroy()  # tasks and their Python workers need not keep the bits
    use.destroy()
    forget(indexed, *counted)
    shared = needed(met)
    named = nodes.select("node", "n", F.col("first_id").alias("_first"))
    shared = stored(shared.join(named, F.col("id").eqNullSafe(F.col("_first"))).select("key", "node", "n"))
    forget(met)

    offers = [stored(filtered(offered(of_turn(shared, turn)), nodes, percent)) for turn in range(PASSES)]
    links = verified(reduce(DataFrame.unionByName, offers).distinct(), docs, text, width, percent, nodes)
    forget(*offers)
    found = components(links)

    labels = found.withColumnRenamed("node", "_node")
    tagged = (shared.select("key", "node").join(labels, F.col("node") == F.col("_node"), "left")
              .withColumn("label", F.coalesce("label", "node")).drop("_node"))
    split = tagged.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high").select("key")
    columns = ["node", "n", *FOLDED]
    open_rows = stored(tagged.join(split, "key", "left_semi").join(nodes.select(*columns), "node"))
    near = (F.col("a_node") < F.col("b_node")) & (F.col("a_label") != F.col("b_label")) & may_link(percent)
    forget(shared)
    left = []
    for turn in range(PASSES):
        x, y = (sided(of_turn(open_rows, turn), side, ["key", "label", *columns]) for side in ("a", "b"))
        pairs = x.join(y, (F.col("a_key") == F.col("b_key")) & near).select("a_node", "b_node", "a_n", "b_n").distinct()
        left.append(stored(by_all_parities(pairs, nodes, percent)))
    links = links.union(verified(reduce(DataFrame.unionByName, left).distinct(), docs, text, width, percent, nodes))
    labels = components(links)
    forget(open_rows, *left)

    firsts = nodes.select("node", "k1", "k2", "first_id", F.col("first").alias("_own"))
    labelled = labels.join(firsts, "node").groupBy("label").agg(F.min("first_id").alias("component_id"), F.min("_own").alias("_all"))
    linked = labels.join(labelled, "label").select("node", "component_id", "_all")
    of_node = (firsts.join(linked, "node", "left")
               .select("node", "k1", "k2", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("_all", "_own").alias("first")))
    member = rows.select("doc_id", "hash", "n", "k1", "k2").join(of_node, ["k1", "k2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "node", F.coalesce("component_id", "doc_id").alias("component_id"), "hash", "first")
    return member, links


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents without those that have another one before them in their component, by doc_id, null
    last, then by a hash of the text. A document is a doc_id, which may be null, and its text: rows that
    repeat both are one document, and one doc_id with two texts is two."""
    member, _ = full_join(docs, doc_id, text, width, percent)
    named = stored(member.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), (F.col("first") != document()).alias("_other")))
    same = F.col(doc_id).eqNullSafe(F.col("_id")) & F.xxhash64(F.col(text)).eqNullSafe(F.col("_hash"))
    others = stored(named.where("_other").select("_id", "_hash").distinct())
    near, apart = parted(docs, F.xxhash64(F.col(text)), others, "_hash")
    kept = near.join(others, same, "left_anti").unionByName(apart)
    again = stored(named.groupBy("_id", "_hash").count().where("count > 1").select("_id", "_hash"))
    if again.limit(1).count() == 0:
        return kept
    near, apart = parted(stored(kept), F.xxhash64(F.col(text)), again, "_hash")
    once = near.join(again, same, "left_anti")
    twice = near.join(again, same, "left_semi").dropDuplicates([doc_id, text])
    return once.unionByName(twice).unionByName(apart)
