"""Language identification by a bidirectional gated recurrent network over bytes.

Every text is cut into windows of bytes; the network reads each window forwards and backwards and
gives every position a distribution over the languages. A document's distribution is the mean over
all of its positions. The network is trained here, in numpy, by backpropagation through time.

Gates and states use piecewise linear activations. The fit takes every language of the labelled rows,
by a bounded sample of each (PER_LANGUAGE texts in hashed order, SAMPLE_CHARS characters from a hashed
place of each text); every document is labelled over its whole text.

Null texts and texts without a letter are `und` with score 0. Without labelled rows everything is
`und`. Ties between languages go to the smaller name. Rows are labelled one by one, so rows that
repeat agree; an empty table gives an empty result. Columns named like the results are replaced.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from prismtab.llm.common import small_batches, stored

PER_LANGUAGE = 400
SAMPLE_CHARS = 384
HIDDEN = 8
WINDOW = 128
BLOCK = 4096
PAD = 256
STEPS = 700
SEED = 7
UNKNOWN = "und"


@dataclass
class Direction:
    """One direction: what each byte adds to the gates (reset, update, candidate), the recurrent
    weights, and what the state adds to the scores of the languages."""
    inputs: np.ndarray
    recurrent: np.ndarray
    scores: np.ndarray

    def arrays(self):
        return [self.inputs, self.recurrent, self.scores]


@dataclass
class Network:
    languages: list[str]
    forward: Direction
    backward: Direction
    bias: np.ndarray


def new_network(languages: list[str], random: np.random.Generator) -> Network:
    def one() -> Direction:
        inputs = random.normal(0, 0.4, (PAD + 1, 3 * HIDDEN))
        inputs[PAD] = 0
        inputs[PAD, HIDDEN:2 * HIDDEN] = 1e3  # the update gate keeps the state over padding
        return Direction(inputs.astype(np.float32), random.normal(0, 0.3, (3 * HIDDEN, HIDDEN)).astype(np.float32),
                         random.normal(0, 0.5, (len(languages), HIDDEN)).astype(np.float32))

    return Network(languages, one(), one(), np.zeros((len(languages), 1), np.float32))


def step(way: Direction, codes: np.ndarray, state: np.ndarray, gates: np.ndarray):
    """The next state; leaves the reset and update gates in `gates` and returns the candidate too."""
    added = way.inputs.take(codes, axis=0).T
    np.dot(way.recurrent, state, out=gates)
    both = gates[:2 * HIDDEN]
    both += added[:2 * HIDDEN]
    both += 0.5
    np.maximum(both, 0, out=both)
    np.minimum(both, 1, out=both)
    candidate = gates[2 * HIDDEN:] * gates[:HIDDEN]
    candidate += added[2 * HIDDEN:]
    np.maximum(candidate, -1, out=candidate)
    np.minimum(candidate, 1, out=candidate)
    new = state - candidate
    new *= gates[HIDDEN:2 * HIDDEN]
    new += candidate
    return new, candidate


def probabilities(network: Network, windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over the positions of each window of the probabilities of the languages.

    windows: (steps, windows) codes with PAD behind each window's end; sizes: codes of each window.
    """
    steps, many = windows.shape
    gates = np.empty((3 * HIDDEN, many), np.float32)
    behind = np.empty((steps, len(network.languages), many), np.float32)
    state = np.zeros((HIDDEN, many), np.float32)
    for t in range(steps - 1, -1, -1):
        state, _ = step(network.backward, windows[t], state, gates)
        np.dot(network.backward.scores, state, out=behind[t])
    state = np.zeros((HIDDEN, many), np.float32)
    found = np.zeros((len(network.languages), many), np.float32)
    shortest = int(sizes.min()) if many else 0
    for t in range(steps):
        state, _ = step(network.forward, windows[t], state, gates)
        odds = np.dot(network.forward.scores, state)
        odds += behind[t]
        odds += network.bias
        np.minimum(odds, 80, out=odds)
        np.exp(odds, out=odds)
        odds /= odds.sum(axis=0)
        if t >= shortest:
            odds *= t < sizes
        found += odds
    return found


def label_texts(network: Network, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mean probabilities (texts x languages) of the texts data[start:end]."""
    sizes = ends - starts
    windows = -(-sizes // WINDOW)
    of = np.repeat(np.arange(len(sizes)), windows)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    first = starts[of] + nth * WINDOW
    held = np.minimum(ends[of] - first, WINDOW)
    order = np.argsort(-held, kind="stable")
    totals = np.zeros((len(sizes), len(network.languages)))
    for low in range(0, len(order), BLOCK):
        chosen = order[low:low + BLOCK]
        lengths = held[chosen]
        places = np.arange(int(lengths[0]))[:, None]
        inside = places < lengths
        codes = np.where(inside, data[np.minimum(first[chosen] + places, len(data) - 1)], PAD)
        np.add.at(totals, of[chosen], probabilities(network, codes, lengths).T)
    return totals / np.maximum(sizes, 1)[:, None]


def backpropagate(way: Direction, codes, order, states, kept, above):
    """Gradients of one direction. kept: (gates, candidate) of each step; above: gradient of the loss
    by the scores at each position."""
    many = codes.shape[1]
    later = np.zeros((HIDDEN, many), np.float32)
    by_recurrent, by_scores = np.zeros_like(way.recurrent), np.zeros_like(way.scores)
    by_added = np.empty((len(order), 3 * HIDDEN, many), np.float32)
    for i in range(len(order) - 1, -1, -1):
        t, before, after = order[i], states[i], states[i + 1]
        gates, candidate = kept[i]
        reset, update, inner = gates[:HIDDEN], gates[HIDDEN:2 * HIDDEN], gates[2 * HIDDEN:]
        by_scores += above[t] @ after.T
        later = later + way.scores.T @ above[t]
        by_candidate = later * (1 - update) * (np.abs(candidate) < 1)
        by_update = later * (before - candidate) * ((update > 0) & (update < 1))
        by_reset = by_candidate * inner * ((reset > 0) & (reset < 1))
        recurrent = np.concatenate([by_reset, by_update, by_candidate * reset])
        by_added[i] = np.concatenate([by_reset, by_update, by_candidate])
        by_recurrent += recurrent @ before.T
        later = later * update + way.recurrent.T @ recurrent
    flat = codes[order].ravel()
    rows = by_added.transpose(1, 0, 2).reshape(3 * HIDDEN, -1)
    by_inputs = np.stack([np.bincount(flat, weights=row, minlength=PAD + 1) for row in rows], axis=1).astype(np.float32)
    by_inputs[PAD] = 0
    return [by_inputs, by_recurrent, by_scores]


def fit(texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = SEED, batch: int = 128, rate: float = 0.01) -> Network:
    """Train on windows of the texts: cross-entropy of the label at every position, Adam."""
    random = np.random.default_rng(seed)
    languages = sorted(set(labels))
    network = new_network(languages, random)
    length = WINDOW // 2
    parts = [(i, at) for i, text in enumerate(texts) for at in range(0, len(text), length)]
    by_language = [[p for p in parts if labels[p[0]] == language] for language in languages]
    weights = [*network.forward.arrays(), *network.backward.arrays(), network.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for turn in range(1, steps + 1):
        target = random.integers(0, len(languages), batch)
        codes = np.full((length, batch), PAD, dtype=np.int64)
        for column, language in enumerate(target):
            which, at = by_language[language][random.integers(0, len(by_language[language]))]
            piece = np.frombuffer(texts[which][at:at + length], np.uint8)
            codes[:len(piece), column] = piece
        runs = []
        scores = np.repeat(network.bias[None], length, axis=0).repeat(batch, axis=2)
        for way, order in ((network.forward, np.arange(length)), (network.backward, np.arange(length)[::-1])):
            states, kept = [np.zeros((HIDDEN, batch), np.float32)], []
            for t in order:
                gates = np.empty((3 * HIDDEN, batch), np.float32)
                state, candidate = step(way, codes[t], states[-1], gates)
                states.append(state)
                kept.append((gates, candidate))
                scores[t] += way.scores @ state
            runs.append((way, order, states, kept))
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        odds[:, target, np.arange(batch)] -= 1
        inside = (codes < PAD)[:, None, :]
        above = (odds * inside / max(1, inside.sum())).astype(np.float32)
        gradients = [g for way, order, states, kept in runs for g in backpropagate(way, codes, order, states, kept, above)]
        gradients.append(above.sum(axis=(0, 2))[:, None])
        now = rate * min(1.0, 3 * (1 - turn / (steps + 1)))
        for weight, gradient, m, v in zip(weights, gradients, first, second):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient * gradient - v)
            weight -= (now * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.99 ** turn)) + 1e-8)).astype(np.float32)
    return network


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(labelled: DataFrame, text: str = "text", language: str = "lang", per_language: int = PER_LANGUAGE,
          steps: int = STEPS, seed: int = SEED) -> Network | None:
    """A network fitted on a bounded sample of the labelled rows of each language; None without any."""
    rows = labelled.where(F.col(language).isNotNull() & has_letter(F.col(text)))
    spread = F.xxhash64(F.lit(seed), F.col(text))
    start = F.lit(1) + F.pmod(F.xxhash64(spread), F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0)) + 1).cast("int")
    pieces = rows.select(spread.alias("h"), F.col(language).alias("l"), F.substring(F.col(text), start, F.lit(SAMPLE_CHARS)).alias("t"))
    # Copies of a text count once, so that they take no place from others of their language. Hashes above a share of
    # their range that surely holds enough go before anything is dealt by language.
    marks = pieces.select("l", "h", (F.shiftrightunsigned("h", 1) / float(1 << 63)).alias("part"))
    held = stored(marks.groupBy("l").agg(F.approx_count_distinct("h").alias("texts")))
    low = marks.join(held, "l").where(F.col("part") * F.col("texts") <= 2 * per_language + 50).select("l", "h").distinct()
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.shiftrightunsigned("h", 1), "h"))
    chosen = low.withColumn("_rank", rank).where(F.col("_rank") <= per_language).select("l", "h")
    sample = pieces.join(F.broadcast(chosen), ["l", "h"]).dropDuplicates(["l", "h"]).orderBy("h", "l", "t").collect()
    sample = [(r["t"].encode("utf-8", "surrogatepass"), r["l"]) for r in sample if r["t"]]
    return fit([t for t, _ in sample], [name for _, name in sample], steps, seed) if sample else None


def identify(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """The documents with lang_pred and score, from the text alone."""
    small_batches(docs.sparkSession)
    kept = docs.drop("lang_pred", "score")
    if network is None:
        return kept.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    marked = kept.withColumns({"_text": F.col(text).cast("string"), "_letters": has_letter(F.col(text))})
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    width = len(kept.columns)

    def batches(parts):
        names = np.array(network.languages, dtype=object)
        for part in parts:
            texts, letters = part.column(width), part.column(width + 1).to_numpy(zero_copy_only=False).astype(bool)
            _, ends, data = texts.buffers()
            ends = np.frombuffer(ends, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
            means = np.zeros((len(texts), len(names)))
            chosen = np.flatnonzero(letters)
            if len(chosen):
                means[chosen] = label_texts(network, data, ends[chosen], ends[chosen + 1])
            best = means.argmax(axis=1)
            found = np.where(letters, names[best], UNKNOWN)
            score = np.clip(np.where(letters, means[np.arange(len(best)), best], 0.0), 0.0, 1.0)
            columns = [part.column(i) for i in range(width)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array(score, pa.float64())],
                                             names=schema.names)

    return marked.mapInArrow(batches, schema)
