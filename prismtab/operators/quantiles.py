"""Exact quantiles (linear interpolation), one way for every size.

A wanted rank lies in a bracket of values, at first the whole column. A bracket with too many values
is cut: a quantile sketch of bounded size proposes values around the rank, exact counts tell which
gap between them holds it, or that it falls on one of them. The values of a bracket that is small
enough are grouped and ordered. A cut takes the proposed values out of the bracket, so it always
shrinks, also where one value fills a third of all rows.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismtab.functions.coerce import number

IN_ONE_BRACKET = 200_000  # values of a bracket that are grouped and ordered
SKETCH_ACCURACY = 2_000
SORT_FROM = 2_000_000  # values of a bracket; from there on sorted pieces are the faster sketch
PIECE_ROWS, PIECE_POINTS = 1_000_000, 4_000  # rows that a task sorts at once, and values it hands on of each column


@dataclass(frozen=True)
class _Target:
    """The value wanted: the one at ``rank`` (0-based) of ``column``, known to be between low and high,
    neither included; ``below`` values are at most low, ``inside`` values lie between."""

    column: str
    rank: int
    low: float
    high: float
    below: int
    inside: int

    @property
    def bracket(self) -> tuple[str, float, float]:
        return self.column, self.low, self.high


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], in_one_bracket: int = IN_ONE_BRACKET,
) -> dict[str, list[float | None]]:
    """Quantiles per numeric column; None for a column without values."""
    if not columns:
        return {}
    values = df.select(*[number(df, name).alias(f"c{i}") for i, name in enumerate(columns)])
    counts = values.agg(*[F.count(c).alias(c) for c in values.columns]).first().asDict()
    places = {(c, p): p * (counts[c] - 1) for c in values.columns if counts[c] for p in probabilities}
    ranks = {(c, r) for (c, _), at in places.items() for r in (math.floor(at), math.ceil(at))}
    targets = [_Target(c, r, -math.inf, math.inf, 0, counts[c]) for c, r in sorted(ranks)]
    at_rank: dict[tuple[str, int], float] = {}
    while targets:
        _settle(values, [t for t in targets if t.inside <= in_one_bracket], at_rank)
        targets = _narrow(values, [t for t in targets if t.inside > in_one_bracket], at_rank)
    return {
        name: [_between(at_rank, alias, places[alias, p]) if (alias, p) in places else None for p in probabilities]
        for name, alias in zip(columns, values.columns)
    }


def _between(at_rank, column: str, place: float) -> float:
    low, high = at_rank[column, math.floor(place)], at_rank[column, math.ceil(place)]
    return low + (high - low) * (place - math.floor(place))


def _by_bracket(targets: list[_Target]) -> dict[tuple[str, float, float], list[_Target]]:
    found: dict[tuple[str, float, float], list[_Target]] = {}
    for t in targets:
        found.setdefault(t.bracket, []).append(t)
    return found


def _inside(bracket: tuple[str, float, float]):
    column, low, high = bracket
    return (F.col(column) > low) & (F.col(column) < high)


def _narrow(values: DataFrame, targets: list[_Target], at_rank: dict) -> list[_Target]:
    """One sketch pass for values to cut at, one counting pass that places every rank among them."""
    if not targets:
        return []
    margin = 2.0 / SKETCH_ACCURACY

    def share(t: _Target, shift: float) -> float:
        return min(max((t.rank - t.below + 0.5) / t.inside + shift, 0.0), 1.0)

    brackets = _by_bracket(targets)
    within = [F.when(_inside(bracket), F.col(bracket[0])) for bracket in brackets]
    shares = [[share(t, shift) for t in members for shift in (-margin, margin)] for members in brackets.values()]
    if max(t.inside for t in targets) < SORT_FROM:
        proposed = values.agg(*[
            F.percentile_approx(value, wanted, SKETCH_ACCURACY).alias(f"s{i}") for i, (value, wanted) in enumerate(zip(within, shares))]).first()
    else:
        sketched = sorted_points(values.select(*[value.alias(f"s{i}") for i, value in enumerate(within)]))
        proposed = {f"s{i}": at_shares(*sketched[f"s{i}"], wanted) for i, wanted in enumerate(shares)}
    cuts = [(bracket, x) for i, bracket in enumerate(brackets) for x in sorted(set(proposed[f"s{i}"]))]
    counted = values.agg(*[
        count.alias(f"{i}_{part}") for i, ((column, _, _), x) in enumerate(cuts)
        for part, count in (("less", F.count_if(F.col(column) < x)), ("upto", F.count_if(F.col(column) <= x)))
    ]).first()
    at = {bracket: [(x, counted[f"{i}_less"], counted[f"{i}_upto"]) for i, (b, x) in enumerate(cuts) if b == bracket]
          for bracket in brackets}
    placed = [_place(t, at[t.bracket], at_rank) for t in targets]
    return [t for t in placed if t is not None]


def _place(target: _Target, cuts: list[tuple[float, int, int]], at_rank: dict) -> _Target | None:
    """The target in the gap that holds its rank; None, with the value recorded, when it is a cut."""
    low, high, below, end = target.low, target.high, target.below, target.below + target.inside
    for x, less, upto in cuts:
        if target.rank < less:
            high, end = x, less
            break
        if target.rank < upto:
            at_rank[target.column, target.rank] = x
            return None
        low, below = x, upto
    return replace(target, low=low, high=high, below=below, inside=end - below)


def _settle(values: DataFrame, targets: list[_Target], at_rank: dict) -> None:
    """Record the values at ranks whose bracket is small enough to be ordered in one task."""
    if not targets:
        return
    brackets = _by_bracket(targets)
    # One row per distinct value in a bracket, so a value repeated over a third of all rows is one
    # row here; the window orders each bracket on its own.
    entries = F.array(*[
        F.when(_inside(bracket), F.struct(F.lit(i).alias("bracket"), F.col(bracket[0]).alias("value")))
        for i, bracket in enumerate(brackets)
    ])
    steps = (
        values.select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
        .groupBy("e.bracket", "e.value").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(Window.partitionBy("bracket").orderBy("value")))
    )
    offsets = F.element_at(F.array(*[
        F.array(*[F.lit(t.rank - t.below).cast("bigint") for t in members]) for members in brackets.values()
    ]), F.col("bracket") + 1)
    met = F.filter(offsets, lambda r: (F.col("upto") > r) & (F.col("upto") - F.col("n") <= r))
    members = list(brackets.values())
    for row in steps.select("bracket", "value", F.explode(met).alias("offset")).collect():
        for t in members[row["bracket"]]:
            if t.rank - t.below == row["offset"]:
                at_rank[t.column, t.rank] = row["value"]


def sorted_points(values: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each column of doubles, some of its finite values in order, with the number of rows that each stands for:
    all values where they are few, else evenly spaced ones of sorted pieces, so a rank is off by about 1 / 4,000 of the rows."""
    names = values.columns

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows >= PIECE_ROWS:
                yield _points_of(held)
                held, rows = [], 0
        if rows:
            yield _points_of(held)

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        many = [np.frombuffer(m) for m in frame["many"]]
        points, many = _thinned(np.concatenate([np.frombuffer(p) for p in frame["points"]]), np.concatenate(many))
        return pd.DataFrame({"at": frame["at"].iloc[:1], "points": [points.tobytes()], "many": [many.tobytes()]})

    schema = "at int, points binary, many binary"
    found = values.select(*[F.col(n).cast("double") for n in names]).mapInArrow(pieces, schema).groupBy("at").applyInPandas(together, schema).collect()  # one row per column
    nothing = {name: (np.zeros(0), np.zeros(0)) for name in names}
    return nothing | {names[r["at"]]: (np.frombuffer(r["points"]), np.frombuffer(r["many"])) for r in found}


def _points_of(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    parts = []
    for column in zip(*held):
        value = np.concatenate(column).astype(np.float64)
        value = value[np.isfinite(value)]
        parts.append(_thinned(value, np.ones(len(value))))
    return pa.RecordBatch.from_arrays([
        pa.array(range(len(parts)), pa.int32()), pa.array([v.tobytes() for v, _ in parts], pa.binary()),
        pa.array([m.tobytes() for _, m in parts], pa.binary())], ["at", "points", "many"])


def _thinned(value: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with the rows of each; of more than ``PIECE_POINTS``, evenly spaced ones."""
    order = np.argsort(value)
    value, upto = value[order], np.cumsum(many[order])
    last = np.flatnonzero(np.append(value[1:] != value[:-1], True)) if len(value) else np.zeros(0, int)
    if len(last) > PIECE_POINTS:
        rank = (np.arange(PIECE_POINTS) + 0.5) / PIECE_POINTS * upto[-1]
        return value[np.searchsorted(upto, rank)], np.full(PIECE_POINTS, upto[-1] / PIECE_POINTS)
    return value[last], np.diff(upto[last], prepend=0.0)


def at_shares(points: np.ndarray, many: np.ndarray, shares: list[float]) -> list[float]:
    """The values below which those shares of the rows lie, about."""
    if not len(points):
        return []
    upto = np.cumsum(many)
    return [float(points[min(len(points) - 1, np.searchsorted(upto, share * upto[-1]))]) for share in shares]
