"""Counts, means and co-moments of all column pairs, merged from blocks of rows.

A block of rows gives, by a few matrix products under the masks of filled cells, for every pair of
columns the rows that fill both, the mean of each side over these rows, and the centred sums of squares
and products. Blocks merge exactly, so no pass for the means is needed and large means cost no digits.
Each task sends its matrices in square tiles; tiles of the same place merge in two steps, streaming, so a
task holds a few tiles however many tasks there were. What remains grows with the columns alone.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prismtab.functions.coerce import number

TILE = 64
BLOCK_ROWS = 4096
MERGERS = 256
PARTS = ("n", "mean_a", "mean_b", "square_a", "square_b", "product")
TILES = "i int, j int, merger int, " + ", ".join(f"{p} binary" for p in PARTS)


@dataclass
class Moments:
    """For columns a and b, over the rows that fill both: [a, b] of each matrix."""

    names: list[str]
    n: np.ndarray
    mean: np.ndarray  # of a
    square: np.ndarray  # centred squares of a
    product: np.ndarray  # centred products of a and b

    def correlation(self) -> np.ndarray:
        """NaN where a column is constant over the common rows."""
        spread = np.sqrt(self.square) * np.sqrt(self.square.T)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(spread > 0, np.clip(self.product / spread, -1, 1), np.nan)


def _block(values: np.ndarray) -> dict[str, np.ndarray]:
    """The matrices of one block; rows with NaN in a column do not count for its pairs."""
    filled = np.isfinite(values)
    mask, centre = filled.astype(np.float64), np.zeros(values.shape[1])
    held = filled.any(axis=0)
    centre[held] = np.nanmean(np.where(filled, values, np.nan)[:, held], axis=0)
    x = np.where(filled, values - centre, 0.0)
    n, total, squares, products = mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x
    many = np.maximum(n, 1)
    return {"n": n, "mean": total / many + centre[:, None] * (n > 0), "square": np.maximum(squares - total * total / many, 0),
            "product": products - total * total.T / many}


def _merged(a: dict, b: dict) -> dict:
    """Of matrices n, mean_a, mean_b, square_a, square_b and product."""
    n = a["n"] + b["n"]
    weight = a["n"] * b["n"] / np.maximum(n, 1)
    left, right = b["mean_a"] - a["mean_a"], b["mean_b"] - a["mean_b"]
    share = b["n"] / np.maximum(n, 1)
    return {"n": n, "mean_a": a["mean_a"] + left * share, "mean_b": a["mean_b"] + right * share,
            "square_a": a["square_a"] + b["square_a"] + left * left * weight, "square_b": a["square_b"] + b["square_b"] + right * right * weight,
            "product": a["product"] + b["product"] + left * right * weight}


def _tiles(block: dict, i: int, j: int, tile: int) -> dict:
    rows, columns = slice(i * tile, (i + 1) * tile), slice(j * tile, (j + 1) * tile)
    return {"n": block["n"][rows, columns], "mean_a": block["mean"][rows, columns], "mean_b": block["mean"][columns, rows].T,
            "square_a": block["square"][rows, columns], "square_b": block["square"][columns, rows].T, "product": block["product"][rows, columns]}


def _shape(i: int, j: int, columns: int, tile: int) -> tuple[int, int]:
    return min(tile, columns - i * tile), min(tile, columns - j * tile)


def _rows(found: dict[tuple[int, int], dict], merger: int) -> Iterator[pa.RecordBatch]:
    for (i, j), tile in found.items():
        yield pa.RecordBatch.from_pydict({
            "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "merger": pa.array([merger], pa.int32()),
            **{p: pa.array([np.ascontiguousarray(tile[p]).tobytes()], pa.binary()) for p in PARTS}})


def co_moments(df: DataFrame, columns: list[str], tile: int = TILE, block_rows: int = BLOCK_ROWS) -> Moments:
    """The moments of all pairs of numeric columns, from one scan; NaN and infinities count as missing."""
    many, side = len(columns), -(-len(columns) // tile)
    values = df.select(*(number(df, name).alias(f"c{i}") for i, name in enumerate(columns)))

    def of_rows(parts):
        from pyspark import TaskContext

        found: dict[tuple[int, int], dict] = {}
        for part in parts:
            for at in range(0, part.num_rows, block_rows):
                piece = part.slice(at, block_rows)
                block = _block(np.column_stack([c.to_numpy(zero_copy_only=False) for c in piece.columns]).astype(np.float64))
                for i in range(side):
                    for j in range(i, side):
                        mine = _tiles(block, i, j, tile)
                        found[i, j] = _merged(found[i, j], mine) if (i, j) in found else {k: v.copy() for k, v in mine.items()}
        yield from _rows(found, TaskContext.get().partitionId() % MERGERS)

    def of_tiles(parts):
        found: dict[tuple[int, int], dict] = {}
        for part in parts:
            for row in part.to_pylist():
                place = row["i"], row["j"]
                mine = {p: np.frombuffer(row[p]).reshape(_shape(*place, many, tile)) for p in PARTS}
                found[place] = _merged(found[place], mine) if place in found else mine
        yield from _rows(found, 0)

    first = values.mapInArrow(of_rows, TILES).repartition("i", "j", "merger").mapInArrow(of_tiles, TILES)
    tiles = first.repartition("i", "j").mapInArrow(of_tiles, TILES).toArrow().to_pylist()  # one row per pair of tiles
    whole = {p: np.zeros((many, many)) for p in ("n", "mean", "square", "product")}
    for row in tiles:
        i, j = row["i"], row["j"]
        rows, cols = slice(i * tile, (i + 1) * tile), slice(j * tile, (j + 1) * tile)
        parts = {p: np.frombuffer(row[p]).reshape(_shape(i, j, many, tile)) for p in PARTS}
        for name, one, other in (("n", "n", "n"), ("mean", "mean_a", "mean_b"), ("square", "square_a", "square_b"), ("product", "product", "product")):
            whole[name][cols, rows] = parts[other].T
            whole[name][rows, cols] = parts[one]
    return Moments(list(columns), **whole)
