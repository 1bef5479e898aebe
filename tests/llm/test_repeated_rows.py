"""Rows that repeat an id and a code or vector take one place among the smallest ids."""
import math

from prismtab.llm import curves, hamming


def test_hamming_with_repeated_rows(spark):
    rows = [(i, 5) for i in range(11)] * 12 + [(100 + i, 5 ^ (1 << i)) for i in range(12)]
    codes = spark.createDataFrame(rows, "vec_id long, code long")
    for asked in (3, 10):
        got = hamming.top_k(codes, codes.where(f"vec_id = {asked}")).orderBy("rank").collect()
        assert [(r.vec_id, r.distance) for r in got] == [(i, 0) for i in range(11) if i != asked]


def test_curves_with_repeated_rows(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(11)] * 12
    rows += [(100 + i, [math.cos(i + 1), math.sin(i + 1), 0.5]) for i in range(12)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = curves.neighbours(vectors, vectors.where("vec_id = 3")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 0.0) for i in range(11) if i != 3]
