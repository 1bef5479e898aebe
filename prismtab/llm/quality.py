"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (PASSAGE bytes each) and only the bag has a label. Every passage is
encoded from the frequencies of its bytes and of its pairs of byte classes, and from how many
different runs of RUN bytes it has against what as many random runs would have; a gated attention network
weighs the passages, and the weighted mean of their codes is scored. Encoder, attention and score are
learned together, in numpy, from document labels.

The fit takes at most TRAINING_DOCS labelled documents, chosen by hash, and at most TRAINING_PASSAGES
evenly spread passages of each; every document is scored over all of its passages.

Null and empty texts are a bag with one empty passage and get that score. Without labels every score
is 0.5. Rows are scored one by one, so rows that repeat agree; an empty table gives an empty result.
Columns named like the results are replaced.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from prismtab.llm.common import small_batches

TRAINING_DOCS = 3000
TRAINING_PASSAGES = 12
PASSAGE = 512
CODE = 16
ATTENTION = 8
EPOCHS = 25
THRESHOLD = 0.7
SEED = 31
BLOCK = 8192

#: Bytes by class, for pairs: lower case, upper case, digit, blank, line end, above ASCII, and the rest
#: of ASCII by groups.
GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!", "?",
          "|", "#$%&*@^~", "()[]{}<>", "\"'`", ":;", "-_/\\+="]
CLASSES = len(GROUPS) + 2


def class_table() -> np.ndarray:
    table = np.full(256, len(GROUPS), dtype=np.int64)
    for i, group in enumerate(GROUPS):
        table[np.frombuffer(group.encode(), np.uint8)] = i
    table[128:] = len(GROUPS) + 1
    return table


CLASS_OF = class_table()
RUN, RUN_CODES = 6, 512
FEATURES = 256 + CLASSES * CLASSES + 1


@dataclass
class Model:
    encode: np.ndarray
    encode_bias: np.ndarray
    tanh_gate: np.ndarray
    sigmoid_gate: np.ndarray
    weigh: np.ndarray
    score: np.ndarray
    score_bias: np.ndarray

    def arrays(self):
        return [self.encode, self.encode_bias, self.tanh_gate, self.sigmoid_gate, self.weigh, self.score, self.score_bias]


def passage_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Square roots of the frequencies of bytes and class pairs of the passages data[start:end], and their variety,
    which is 1 for passages shorter than a run. A passage has the same features whatever passages are beside it."""
    sizes = ends - starts
    many = len(sizes)
    if not many:
        return np.zeros((0, FEATURES), np.float32)
    of = np.repeat(np.arange(many), sizes)
    place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    codes = data[place]
    single = np.bincount(of * 256 + codes, minlength=many * 256).reshape(many, 256)
    classes = CLASS_OF[codes]
    inside = of[1:] == of[:-1]
    pairs = (of[1:] * CLASSES + classes[:-1]) * CLASSES + classes[1:]
    double = np.bincount(pairs[inside], minlength=many * CLASSES * CLASSES).reshape(many, -1)
    held = max(0, len(codes) - RUN + 1)
    runs = np.zeros(held, np.int64)
    for first in range(RUN - 1, -1, -1):
        runs = runs * 131 + codes[first:first + held]
    runs = (runs * 0x9E3779B1 >> 16) % RUN_CODES
    whole = of[RUN - 1:] == of[:held]
    seen = np.bincount((of[RUN - 1:] * RUN_CODES + runs)[whole], minlength=many * RUN_CODES).reshape(many, -1) > 0
    likely = RUN_CODES * -np.expm1(-np.maximum(sizes - RUN + 1, 1) / RUN_CODES)
    variety = np.minimum(seen.sum(axis=1) / likely, 1)[:, None]
    frequencies = np.sqrt(np.hstack([single, double]) / np.maximum(sizes, 1)[:, None])
    return np.hstack([frequencies, np.where(sizes[:, None] >= RUN, variety, 1)]).astype(np.float32)


def passages_of(starts: np.ndarray, ends: np.ndarray):
    """(bag, start, end) of every passage; an empty text is one empty passage."""
    counts = np.maximum(-(-(ends - starts) // PASSAGE), 1)
    of = np.repeat(np.arange(len(starts)), counts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = starts[of] + nth * PASSAGE
    return of, first, np.minimum(first + PASSAGE, ends[of])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def passage_codes(model: Model, features: np.ndarray):
    """Codes of the passages, both gates, and the attention before it is shared out."""
    codes = np.tanh(features @ model.encode + model.encode_bias)
    left, right = np.tanh(codes @ model.tanh_gate), sigmoid(codes @ model.sigmoid_gate)
    return codes, left, right, np.exp(np.clip((left * right) @ model.weigh, -30, 30))


def bag_sums(values: np.ndarray, of: np.ndarray, bags: int) -> np.ndarray:
    if values.ndim == 1:
        return np.bincount(of, weights=values, minlength=bags)
    return np.stack([np.bincount(of, weights=column, minlength=bags) for column in values.T], axis=1)


def fit(features: np.ndarray, of: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED,
        batch: int = 64, rate: float = 0.004) -> Model:
    """Adam on the log loss of the bags. features: passages; of: bag of each passage, ascending."""
    random = np.random.default_rng(seed)
    normal = lambda *shape: random.normal(0, 1 / np.sqrt(shape[0]), shape)
    model = Model(normal(FEATURES, CODE) * 4, np.zeros(CODE), normal(CODE, ATTENTION), normal(CODE, ATTENTION),
                  normal(ATTENTION), normal(CODE), np.zeros(1))
    weights = model.arrays()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    bounds = np.searchsorted(of, np.arange(len(labels) + 1))
    turn = 0
    for epoch in range(epochs):
        order = random.permutation(len(labels))
        for low in range(0, len(order), batch):
            bags = order[low:low + batch]
            rows = np.concatenate([np.arange(bounds[b], bounds[b + 1]) for b in bags])
            local = np.repeat(np.arange(len(bags)), bounds[bags + 1] - bounds[bags])
            x, y = features[rows], labels[bags]
            codes, left, right, raw = passage_codes(model, x)
            share = raw / bag_sums(raw, local, len(bags))[local]
            mean = bag_sums(codes * share[:, None], local, len(bags))
            error = (sigmoid(mean @ model.score + model.score_bias) - y) / len(bags)
            by_mean = error[:, None] * model.score
            by_share = (codes * by_mean[local]).sum(axis=1)
            by_logit = share * (by_share - bag_sums(by_share * share, local, len(bags))[local])
            by_both = by_logit[:, None] * model.weigh
            by_left, by_right = by_both * right * (1 - left * left), by_both * left * right * (1 - right)
            by_codes = share[:, None] * by_mean[local] + by_left @ model.tanh_gate.T + by_right @ model.sigmoid_gate.T
            by_codes *= 1 - codes * codes
            gradients = [x.T @ by_codes + 2e-4 * model.encode, by_codes.sum(axis=0), codes.T @ by_left, codes.T @ by_right,
                         (left * right).T @ by_logit, mean.T @ error, np.array([error.sum()])]
            turn += 1
            now = rate * min(1.0, 2 * (1 - epoch / epochs))
            for weight, gradient, m, v in zip(weights, gradients, first, second):
                m += 0.1 * (gradient - m)
                v += 0.01 * (gradient * gradient - v)
                weight -= now * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.99 ** turn)) + 1e-8)
    return Model(*(w.astype(np.float32) for w in weights))


def text_bytes(texts: pa.Array):
    """(data, starts, ends) of the texts of an Arrow column; a null is empty."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    starts, ends = offsets[:-1], offsets[1:]
    if texts.null_count:
        ends = np.where(np.asarray(texts.is_valid()), ends, starts)
    return data, starts, ends


def score_texts(model: Model, data, starts, ends) -> np.ndarray:
    of, first, last = passages_of(starts, ends)
    whole, weighted = np.zeros(len(starts)), np.zeros((len(starts), CODE))
    for low in range(0, len(of), BLOCK):
        cut = slice(low, low + BLOCK)
        codes, _, _, raw = passage_codes(model, passage_features(data, first[cut], last[cut]))
        base, top = int(of[cut][0]), int(of[cut][-1]) + 1
        whole[base:top] += bag_sums(raw, of[cut] - base, top - base)
        weighted[base:top] += bag_sums(codes * raw[:, None], of[cut] - base, top - base)
    return sigmoid(weighted / whole[:, None] @ model.score + model.score_bias) if len(starts) else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          most_docs: int = TRAINING_DOCS, seed: int = SEED) -> Model | None:
    """A model from the labels (doc_id, label 0/1); None without any. Only the bounded sample of the
    labels is sent to the documents, and only bounded features come back."""
    small_batches(docs.sparkSession)
    usable = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_label"))
    held = usable.count()
    if not held:
        return None
    spread = F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.where(spread < min(1.0, most_docs / held)).limit(2 * most_docs)
    chosen = docs.join(F.broadcast(sample), F.col(doc_id) == F.col("_id")).select("_id", "_label", F.col(text).cast("string").alias("_text"))

    def batches(parts):
        for part in parts:
            data, starts, ends = text_bytes(part.column(2))
            of, first, last = passages_of(starts, ends)
            count = np.bincount(of, minlength=len(starts))
            nth = np.arange(len(of)) - (np.cumsum(count) - count)[of]
            step = -(-count // TRAINING_PASSAGES)
            keep = nth % step[of] == 0
            features = passage_features(data, first[keep], last[keep])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(of[keep])), part.column(1).take(pa.array(of[keep])), pa.array(nth[keep], pa.int64()),
                 pa.array([row.tobytes() for row in features], pa.binary())], names=["id", "label", "nth", "x"])

    kind = docs.schema[doc_id].dataType.simpleString()
    found = chosen.mapInArrow(batches, f"id {kind}, label double, nth long, x binary").toPandas()
    if found.empty:
        return None
    found = found.sort_values(["id", "nth"], kind="stable")
    of = found["id"].ne(found["id"].shift()).cumsum().to_numpy() - 1
    return fit(np.stack([np.frombuffer(x, np.float32) for x in found["x"]]), of, found.groupby(of)["label"].first().to_numpy(), seed=seed)


def score_quality(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with score and predicted, from the text alone."""
    small_batches(docs.sparkSession)
    kept = docs.drop("score", "predicted")
    if model is None:
        return kept.withColumns({"score": F.lit(0.5), "predicted": F.lit(int(0.5 >= threshold))})
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    width = len(kept.columns)

    def batches(parts):
        for part in parts:
            score = score_texts(model, *text_bytes(part.column(width))).astype(np.float64)
            columns = [part.column(i) for i in range(width)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=schema.names)

    return kept.withColumn("_text", F.col(text).cast("string")).mapInArrow(batches, schema)
