"""Random forests over many rows: every level of all trees comes from one pass over rows of bins.

A forest sees a number only through its bins. The bins of several columns make one small key, and a row is
kept as a few keys and its target, in blocks. For a level, a task finds the node of each row by looking its
keys up, adds up the target per node and key, and sends sums per node and bin; the best split of each node is found
where the sums of its tree meet. Only splits reach the driver, so a pass costs the same for every kind of rows.
Nodes, gains, draws of features and the stored form are those of `pyspark.ml`.
"""
from __future__ import annotations

import io
import json
import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from prismtab.functions.coerce import col
from prismtab.operators.profile import local_frame
from prismtab.session import ensure_checkpoint_dir

# Sizes of keys, blocks and messages.
KEYS = 1024  # values of a key, unless one column has more
BLOCK_ROWS = 131_072
CHUNK_BLOCKS = 24  # blocks that a task holds at once
STEP = 6  # levels that one look-up goes down; 2 to that power nodes are the bits of a word
SUMS_MB = 128  # sums that a task holds; more trees go into another pass over the rows
PART_NODES = 32  # nodes of a tree whose sums meet in one group
MOST_TOGETHER = 16  # rows that are drawn together


@dataclass(frozen=True)
class Columns:
    """The binned columns: `cuts` of each number, number of words of each text; which ones make up each key."""

    cuts: list[list[float]]
    words: list[int]
    keys: list[list[int]] = field(default_factory=list)
    unknown: int = 0  # 1 with a bin for words that no row had in training

    @property
    def bins(self) -> list[int]:
        return [len(c) + 1 for c in self.cuts] + [max(1, n) + self.unknown for n in self.words]

    @property
    def features(self) -> list[tuple[int, int | None]]:
        """(column, word or None) of each position of the feature vector."""
        return [(i, None) for i in range(len(self.cuts))] + [
            (len(self.cuts) + i, word) for i, many in enumerate(self.words) for word in range(many)]

    def size(self, key: list[int]) -> int:
        return math.prod(self.bins[c] for c in key)


def with_keys(cuts: list[list[float]], words: list[int], unknown: int = 0) -> Columns:
    """Columns dealt to keys of at most ``KEYS`` values, the largest column first."""
    plain, keys = Columns(cuts, words, [], unknown), []
    for c in sorted(range(len(plain.bins)), key=lambda c: (-plain.bins[c], c)):
        home = next((key for key in keys if plain.size([*key, c]) <= KEYS), None)
        if home is None:
            keys.append([c])
        else:
            home.append(c)
    return Columns(cuts, words, keys, unknown)


@dataclass
class Tree:
    """Nodes by number: the root is 1, the children of n are 2n and 2n + 1. `splits` has (feature, bin, gain)."""

    splits: dict[int, tuple[int, int, float]] = field(default_factory=dict)
    stats: dict[int, np.ndarray] = field(default_factory=dict)
    open: list[int] = field(default_factory=lambda: [1])


def grow(forest, train: DataFrame, rows: int, numbers: list[str], words: list[str], columns: Columns, draw_from: int,
         regression: bool, class_weights: list[float], features_col: str):
    """The fitted model of a `pyspark.ml` forest. `train` has numbers, indexed words and the label; rows are drawn
    together while they are at most 1 / `draw_from` of all, and no more than ``MOST_TOGETHER``."""
    spark, label = train.sparkSession, forest.getLabelCol()
    together = max(1, min(MOST_TOGETHER, rows // draw_from))
    middle = train.agg(F.avg(label)).first()[0] if regression else 0.0
    select = train.select(*[col(n).cast("double").alias(f"x{i}") for i, n in enumerate(numbers)],
                          *[col(w).cast("double").alias(f"x{i}") for i, w in enumerate(words, len(numbers))],
                          (F.col(label) - middle if regression else F.col(label)).cast("double").alias("y"))
    blocks = select.mapInArrow(_packer(columns, together), "place bigint, number bigint, many int, keys binary, y binary").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        trees = _levels(spark, blocks, forest, columns, together, regression, np.array(class_weights))
    finally:
        blocks.unpersist()
    model = _stored(spark, forest, trees, columns, regression, np.array(class_weights), middle, features_col)
    model.by_keys = _by_keys(trees, forest.getMaxDepth(), columns, regression, np.array(class_weights), middle)(
        F.struct(*[col(n).cast("double").alias(f"x{i}") for i, n in enumerate([*numbers, *words])]))
    return model


def _packer(columns: Columns, together: int):
    """Rows to blocks: the keys of all rows, one key after the other, and the targets; filled up to whole draws."""
    def pack(batches):
        place, number, held, many = TaskContext.get().partitionId(), 0, [], 0
        cuts = [np.array(c) for c in columns.cuts]

        def block(parts):
            bins = [np.concatenate([p[c] for p in parts]) for c in range(len(columns.bins))]
            y = np.concatenate([p[-1] for p in parts])
            empty = -len(y) % together
            keys = []
            for key in columns.keys:
                value = np.zeros(len(y) + empty, np.uint32)
                for c in key:
                    value[:len(y)] = value[:len(y)] * columns.bins[c] + bins[c]
                keys.append(value)
            return pa.RecordBatch.from_arrays([
                pa.array([place], pa.int64()), pa.array([number], pa.int64()), pa.array([len(y)], pa.int32()),
                pa.array([np.concatenate(keys).astype(_key_type(columns)).tobytes()], pa.binary()),
                pa.array([np.concatenate([y, np.zeros(empty)]).tobytes()], pa.binary())], ["place", "number", "many", "keys", "y"])

        for batch in batches:
            values = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(batch.num_columns)]
            binned = [np.searchsorted(cuts[c], v, "right").astype(np.uint32) if c < len(cuts) else v.astype(np.uint32) for c, v in enumerate(values[:-1])]
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = [b[start:start + BLOCK_ROWS] for b in (*binned, values[-1])]
                held.append(part)
                many += len(part[-1])
                if many >= BLOCK_ROWS:
                    yield block(held)
                    number, held, many = number + 1, [], 0
        if many:
            yield block(held)
    return pack


def _key_type(columns: Columns):
    return np.uint16 if max(columns.size(key) for key in columns.keys) <= 65_536 else np.uint32


def _poisson() -> np.ndarray:
    """How often something is drawn, for each of 65,536 equally likely numbers."""
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(upto, (np.arange(65_536) + 0.5) / 65_536).astype(np.uint8)


def _levels(spark: SparkSession, blocks: DataFrame, forest, columns: Columns, together: int, regression: bool, weights) -> list[Tree]:
    trees = [Tree() for _ in range(forest.getNumTrees())]
    features, seed = columns.features, forest.getSeed()
    subset = len(features) if forest.getFeatureSubsetStrategy() == "all" else math.ceil(math.sqrt(len(features)))
    channels = 2 if regression else len(weights)
    tasks = max(1, spark.sparkContext.defaultParallelism)
    for level in range(forest.getMaxDepth()):
        waiting = [t for t, tree in enumerate(trees) if tree.open]
        while waiting:
            now, size = [], 0
            while waiting and (not now or size <= SUMS_MB << 20):
                now.append(waiting.pop(0))
                size += 8 * len(trees[now[-1]].open) * (sum(columns.bins) * channels + 1)
            paths = {t: (trees[t].splits, trees[t].open) for t in now}
            sums = blocks.coalesce(tasks).mapInArrow(_summer(columns, paths, together, level, regression, channels, seed), "tree int, part int, sums binary")
            found = sums.groupBy("tree", "part").applyInPandas(
                _splitter(columns, paths, regression, channels, subset, seed, weights), "tree int, part int, found binary").collect()  # some numbers for each node
            for row in sorted(found, key=lambda r: (r["tree"], r["part"])):
                _extend(trees[row["tree"]], row["part"], np.load(io.BytesIO(row["found"])), level + 1 == forest.getMaxDepth(), regression, channels)
        for tree in trees:
            tree.open = [] if level + 1 == forest.getMaxDepth() else sorted(n for n in tree.stats if n.bit_length() == level + 2 and not _pure(tree.stats[n], regression))
    for tree in trees:
        _prune(tree, regression, weights)
    return trees


def _prune(tree: Tree, regression: bool, weights: np.ndarray) -> None:
    """Two leaves of a node that predict the same become one, as in `pyspark.ml`."""
    def prediction(n: int) -> float:
        stats = tree.stats[n]
        return float(stats[1] / stats[0] if stats[0] else 0.0) if regression else float((stats * weights).argmax())

    for n in sorted(tree.splits, reverse=True):
        children = 2 * n, 2 * n + 1
        if not any(c in tree.splits for c in children) and prediction(children[0]) == prediction(children[1]):
            del tree.splits[n], tree.stats[children[0]], tree.stats[children[1]]


def _pure(stats: np.ndarray, regression: bool) -> bool:
    return not regression and np.count_nonzero(stats) < 2


def _extend(tree: Tree, part: int, found: np.ndarray, last: bool, regression: bool, channels: int) -> None:
    """The splits of the open nodes; children get what is known of them."""
    kept = channels + 1 if regression else channels
    for node, row in zip(tree.open[part * PART_NODES:], found):
        tree.stats[node] = row[:kept]
        gain, feature, bin_ = row[kept:kept + 3]
        if gain > 0:
            left = row[kept + 3:]
            right = row[:channels] - left
            tree.splits[node] = (int(feature), int(bin_), float(gain))
            for child, sums in ((2 * node, left), (2 * node + 1, right)):
                # The squares within a child are known after the next level; the last ones count as alike.
                tree.stats[child] = np.array([*sums, sums[1] ** 2 / sums[0] if sums[0] else 0.0]) if regression else sums


def _goes_left(columns: Columns, split: tuple[int, int, float], key: list[int]) -> np.ndarray | None:
    """For each value of a key, whether its rows go left; None when the split asks for a column of another key."""
    c, word = columns.features[split[0]]
    if c not in key:
        return None
    at = key.index(c)
    value = np.arange(columns.size(key)) // math.prod(columns.bins[k] for k in key[at + 1:]) % columns.bins[c]
    return value <= split[1] if word is None else value != word


def _look_ups(columns: Columns, splits: dict, open_nodes: list[int], level: int) -> list[tuple[list, np.ndarray]]:
    """How a row finds its place among the open nodes (0: it is in none). For each step: for some keys a table
    (place before, key value) of words, whose bits are the nodes below that place which the value allows, and the
    first node below each place."""
    depths = sorted({level, *range(level % STEP or min(STEP, level), level, STEP)} - {0})
    steps, above = [], [1]
    for before, depth in zip([0, *depths], depths):
        below = sorted({n >> (level - depth) for n in open_nodes})
        first = np.zeros(len(above) + 1, np.int64)
        for place, start in enumerate(above, 1):
            first[place] = next((i for i, n in enumerate(below, 1) if n >> (depth - before) == start), 0)
        tables = []
        for k, key in enumerate(columns.keys):
            table, allowed, asked = np.zeros((len(above) + 1, columns.size(key)), np.uint64), dict.fromkeys(above), False
            for down in range(1, depth - before + 1):
                for n in sorted({m >> (depth - before - down) for m in below}):  # a leaf's only way down is to the left
                    goes = _goes_left(columns, splits[n >> 1], key) if n >> 1 in splits else None
                    so_far = allowed[n >> 1]
                    side = goes if goes is None or n % 2 == 0 else ~goes
                    allowed[n] = so_far if side is None else side if so_far is None else so_far & side
                    asked = asked or side is not None
            for i, n in enumerate(below, 1):
                place = above.index(n >> (depth - before)) + 1
                bit = np.uint64(1) << np.uint64(i - first[place])
                table[place] |= bit if allowed[n] is None else allowed[n].astype(np.uint64) * bit
            if asked:
                tables.append((k, table.ravel(), table.shape[1]))
        steps.append((tables, first))
        above = below
    return steps


def _places(steps: list, keys: list[np.ndarray]) -> np.ndarray | None:
    """The place of each row among the open nodes, from 1; 0 for a row in none. None: all rows are in the root."""
    place = None
    for tables, first in steps:
        allowed = None
        for k, table, size in tables:
            words = table.take(keys[k] if place is None else place * size + keys[k])
            allowed = words if allowed is None else np.bitwise_and(allowed, words, out=allowed)
        bit = allowed.astype(np.float64).view(np.int64)  # one bit at most: its number is the exponent
        bit >>= 52
        bit += (first[1] if place is None else first.take(place)) - 1023
        place = np.where(allowed != 0, bit, 0)
    return place


def _summer(columns: Columns, paths: dict, together: int, level: int, regression: bool, channels: int, seed: int):
    """Sums per tree, open node, bin of each column and channel (weight and weighted target, or each class); a
    regression adds the weighted squares of the node."""
    def summed(batches):
        sizes, kind, drawn = [columns.size(key) for key in columns.keys], _key_type(columns), _poisson()
        steps = {}
        for t, (splits, open_nodes) in paths.items():
            # The tables of the first place row belong to rows in no open node.
            tables = _look_ups(columns, splits, open_nodes, level)
            steps[t] = [([(k, table[size:] if i == 0 else table, size) for k, table, size in parts], first) for i, (parts, first) in enumerate(tables)]
        width = sum(columns.bins) * channels + regression
        total = {t: np.zeros((len(open_nodes), width)) for t, (_, open_nodes) in paths.items()}
        held = []

        def add():
            for t, (_, open_nodes) in paths.items():
                nodes = len(open_nodes) + 1
                sums = [np.zeros((channels, nodes * size)) if regression else np.zeros(nodes * channels * size) for size in sizes]
                squares = np.zeros(nodes)
                for place, number, many, keys, y in held:
                    draws = drawn.take(np.random.default_rng([seed, t, place, number]).integers(0, 65_536, len(y) // together, np.uint16))
                    chosen = np.flatnonzero(draws)
                    if not len(chosen):
                        continue
                    weight = np.repeat(draws.take(chosen).astype(np.float64), together)
                    if chosen[-1] == len(draws) - 1 and many < len(y):
                        weight[many - len(y):] = 0
                    mine = [k.reshape(-1, together)[chosen].ravel().astype(np.int64) for k in keys]
                    target = y.reshape(-1, together)[chosen].ravel()
                    at = _places(steps[t], mine)
                    if regression:
                        weighted = weight * target
                        squares += np.bincount(at, weighted * target, nodes) if at is not None else np.array([0.0, weighted @ target])
                    else:
                        at = (channels if at is None else at * channels) + target.astype(np.int64)
                    for key, size, into in zip(mine, sizes, sums):
                        where = key + size if at is None else at * size + key
                        if regression:
                            into[0] += np.bincount(where, weight, nodes * size)
                            into[1] += np.bincount(where, weighted, nodes * size)
                        else:
                            into += np.bincount(where, weight, nodes * channels * size)
                into = total[t]
                for key, some in zip(columns.keys, sums):
                    shape = [columns.bins[c] for c in key]
                    by = some.reshape(channels, nodes, *shape).swapaxes(0, 1) if regression else some.reshape(nodes, channels, *shape)
                    for i, c in enumerate(key):
                        other = tuple(2 + j for j in range(len(key)) if j != i)
                        start = sum(columns.bins[:c]) * channels
                        into[:, start:start + columns.bins[c] * channels] += by[1:].sum(axis=other).reshape(nodes - 1, -1)
                if regression:
                    into[:, -1] += squares[1:]
            held.clear()

        for batch in batches:
            for place, number, many, keys, y in zip(*(batch.column(i) for i in range(5))):
                values = np.frombuffer(y.as_buffer(), np.float64)
                held.append((place.as_py(), number.as_py(), many.as_py(), np.frombuffer(keys.as_buffer(), kind).reshape(len(sizes), -1), values))
                if len(held) >= CHUNK_BLOCKS:
                    add()
        if held:
            add()
            for t, sums in total.items():
                for part in range(math.ceil(len(sums) / PART_NODES)):
                    mine = sums[part * PART_NODES:(part + 1) * PART_NODES]
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([part], pa.int32()), pa.array([mine.tobytes()], pa.binary())], ["tree", "part", "sums"])
    return summed


def _splitter(columns: Columns, paths: dict, regression: bool, channels: int, subset: int, seed: int, weights):
    """Adds up the sums of some nodes of a tree and finds the best split of each: what is known of the node, gain,
    feature, bin, and the sums of the left side. A gain of 0 is no split."""
    def split(frame: pd.DataFrame) -> pd.DataFrame:
        t, part = int(frame["tree"].iloc[0]), int(frame["part"].iloc[0])
        nodes = paths[t][1][part * PART_NODES:(part + 1) * PART_NODES]
        sums = sum(np.frombuffer(s).reshape(len(nodes), -1) for s in frame["sums"])
        found = []
        for node, row in zip(nodes, sums):
            starts = np.cumsum([0, *columns.bins]) * channels
            by_column = [row[a:b].reshape(channels, -1) for a, b in zip(starts, starts[1:])]
            whole = by_column[0].sum(axis=1)
            best = (0.0, 0, 0, whole)
            chosen = range(len(columns.features))
            if subset < len(columns.features):
                chosen = sorted(np.random.default_rng([seed, t, node]).choice(len(columns.features), subset, replace=False))
            for f in chosen:
                c, word = columns.features[f]
                left = np.cumsum(by_column[c], axis=1)[:, :-1] if word is None else (whole - by_column[c][:, word])[:, None]
                gain = _gains(left, whole, regression, weights)
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), f, int(gain.argmax()), left[:, gain.argmax()])
            found.append([*whole, *([row[-1]] if regression else []), *best[:3], *best[3]])
        out = io.BytesIO()
        np.save(out, np.array(found))
        return pd.DataFrame({"tree": [t], "part": [part], "found": [out.getvalue()]})
    return split


def _gains(left: np.ndarray, whole: np.ndarray, regression: bool, weights) -> np.ndarray:
    """The fall of impurity (variance or Gini) for each split; 0 where a side is empty or nothing is gained."""
    right = whole[:, None] - left
    if regression:
        sides = left[0], right[0]
        def kept(part):  # the part of the mean square that the mean explains
            return np.divide(part[1] ** 2, part[0], out=np.zeros_like(part[0]), where=part[0] > 0.5)
        total = whole[0]
        before = whole[1] ** 2 / total if total else 0.0
    else:
        left, right, all_ = left * weights[:, None], right * weights[:, None], whole * weights
        sides = left.sum(axis=0), right.sum(axis=0)
        def kept(part):
            many = part.sum(axis=0)
            return np.divide((part ** 2).sum(axis=0), many, out=np.zeros_like(many), where=many > 0)
        total = all_.sum()
        before = (all_ ** 2).sum() / total if total else 0.0
    after = kept(left) + kept(right)
    gain = (after - before) / total if total else np.zeros_like(after)
    least = 0.5 if regression else 0.5 * min(weights)  # draws are whole numbers
    small = 1e-12 * max(before, 1e-300) / total if total else 0.0
    return np.where((sides[0] > least) & (sides[1] > least) & (gain > small), gain, 0.0)


def _by_keys(trees: list[Tree], depth: int, columns: Columns, regression: bool, weights: np.ndarray, middle: float):
    """A function of a row's numbers and indexed words: its prediction, as `pyspark.ml` finds it."""
    ways, columns = [], with_keys(columns.cuts, columns.words, unknown=1)
    for tree in trees:
        leaves = _leaves(tree)
        down = {n << (depth + 1 - n.bit_length()): n for n in leaves}
        places = sorted(down)
        steps = _look_ups(columns, tree.splits, places, depth) if tree.splits else []
        steps = [([(k, table[size:] if i == 0 else table, size) for k, table, size in parts], first) for i, (parts, first) in enumerate(steps)]
        stats = [tree.stats[down[place]] for place in places]
        if regression:
            value = np.array([0.0, *(s[1] / s[0] if s[0] else 0.0 for s in stats)])
        else:
            shares = [s * weights / max((s * weights).sum(), 1e-300) for s in stats]
            value = np.array([np.zeros(len(weights)), *shares])
        ways.append((steps, value))
    cuts, sizes = [np.array(c) for c in columns.cuts], columns.bins

    def predicted(rows: pd.DataFrame) -> pd.Series:
        bins = []
        for c in range(len(sizes)):
            x = rows[f"x{c}"].to_numpy(dtype=float)
            bins.append(np.searchsorted(cuts[c], x, "right") if c < len(cuts) else x.astype(np.int64))
        keys = []
        for key in columns.keys:
            value = np.zeros(len(rows), np.int64)
            for c in key:
                value = value * sizes[c] + bins[c]
            keys.append(value)
        total = np.zeros(len(rows)) if regression else np.zeros((len(rows), len(weights)))
        for steps, value in ways:
            place = _places(steps, keys)
            total += value[1] if place is None else value.take(place, axis=0)
        return pd.Series(total / len(ways) + middle if regression else total.argmax(axis=1).astype(float))

    return F.pandas_udf(predicted, "double")


def _leaves(tree: Tree) -> list[int]:
    return [n for n in tree.stats if n not in tree.splits]


def _stored(spark: SparkSession, forest, trees: list[Tree], columns: Columns, regression: bool, weights, middle: float, features_col: str):
    """The model, written in the form in which `pyspark.ml` keeps one, and read."""
    node = ("treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,"
            "leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>")
    data = [(t, row) for t, tree in enumerate(trees) for row in _rows(tree, columns, regression, weights, middle)]
    kind, one = ("Regression", "regression.DecisionTreeRegressionModel") if regression else ("Classification", "classification.DecisionTreeClassificationModel")
    package = f"org.apache.spark.ml.{kind.lower()}"
    params = {"featuresCol": features_col, "impurity": forest.getImpurity()}
    extra = {"numFeatures": len(columns.features), "numTrees": len(trees)} | ({} if regression else {"numClasses": len(weights)})
    each = [(t, json.dumps(described(f"org.apache.spark.ml.{one}", forest, params, f"tree_{uuid.uuid4().hex[:12]}", ("numTrees", "featureSubsetStrategy", "subsamplingRate", "bootstrap"))), 1.0)
            for t in range(len(trees))]
    model = RandomForestRegressionModel if regression else RandomForestClassificationModel
    return model.load(written(spark, described(f"{package}.RandomForest{kind}Model", forest, params) | extra, {
        "data": local_frame(spark, data, node), "treesMetadata": local_frame(spark, each, "_1 int, _2 string, _3 double")}))


def described(kind: str, estimator, params: dict, uid: str | None = None, without: tuple[str, ...] = ()) -> dict:
    """What `pyspark.ml` notes of a model: the settings of its estimator, and `params`."""
    given = {p.name: v for p, v in estimator._paramMap.items() if p.name not in ("weightCol", *without)}
    return {"class": kind, "timestamp": 0, "sparkVersion": SparkSession.active().version, "uid": uid or estimator.uid,
            "paramMap": given | params, "defaultParamMap": {}}


def written(spark: SparkSession, described: dict, tables: dict[str, DataFrame]) -> str:
    """A model's description and tables in a new folder under the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/model-{uuid.uuid4().hex}"
    local_frame(spark, [(json.dumps(described),)], "value string").coalesce(1).write.text(f"{at}/metadata")
    for name, frame in tables.items():
        frame.coalesce(1).write.parquet(f"{at}/{name}")
    return at


def _rows(tree: Tree, columns: Columns, regression: bool, weights, middle: float) -> list[tuple]:
    """The nodes of a tree, parents before children, as `pyspark.ml` stores them."""
    order, ids, stack = [], {}, [1]
    while stack:
        n = stack.pop()
        ids[n] = len(order)
        order.append(n)
        if n in tree.splits:
            stack += [2 * n + 1, 2 * n]
    found = []
    for n in order:
        stats = tree.stats[n]
        if regression:
            many, total, squares = stats
            mean = total / many if many else 0.0
            spread = max(0.0, squares / many - mean * mean) if many else 0.0
            values, kept, count = (mean + middle, spread), [many, total + many * middle, squares + 2 * middle * total + many * middle ** 2], many
        else:
            real = stats * weights
            all_ = real.sum()
            values, kept, count = (float(real.argmax()), 1 - ((real / all_) ** 2).sum() if all_ else 0.0), real.tolist(), stats.sum()
        gain, children, split = -1.0, (-1, -1), (-1, [], -1)
        if n in tree.splits:
            feature, bin_, gain = tree.splits[n]
            c, word = columns.features[feature]
            # Left are the bins up to this one: values below the cut after it.
            at = float(np.nextafter(columns.cuts[c][bin_], -np.inf)) if word is None else 0.5
            children, split = (ids[2 * n], ids[2 * n + 1]), (feature, [at], -1)
        found.append((ids[n], *map(float, values), [float(v) for v in kept], int(round(count)), float(gain), *children, split))
    return found
