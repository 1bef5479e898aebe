"""Searches on data with structure: fewer candidates than a scan, blocks far smaller than the table, ties."""
import numpy as np
import pytest

from prismtab.llm import curves, hamming
from prismtab.llm.common import table


def clustered(rows, size, seed):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(rows // 25, size)) * 4 + 50
    return centres[random.integers(0, len(centres), rows)] + random.normal(size=(rows, size)) * 0.05


def brute(x, q, k):
    far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    return [j for j in np.lexsort((np.arange(len(x)), far)) if j != q][:k], far


def test_curves_read_windows_only(spark):
    x = clustered(4000, 16, 7)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    report, hits, asked = {}, 0, range(0, 4000, 40)
    got = {}
    for r in curves.neighbours(vectors, vectors.where("vec_id % 40 = 0"), block=128, report=report).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    for q in asked:
        best, far = brute(x, q, 10)
        hits += len(set(best) & set(got[q]))
        assert all(far[v] == pytest.approx(s, abs=1e-9) for v, s in got[q].items())
    assert hits >= 9 * len(asked)
    assert report["vectors"] == 4000 and report["curves"] * (2 * report["width"] + 1) < 4000 / 4


def test_recall_of_vectors_without_structure(spark):
    """Blocks of a thirtieth of the table; the windows grow as wide as the data need."""
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = vectors.orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows], dtype=np.float64), [r["vec_id"] for r in rows]
    got = {}
    for r in curves.neighbours(vectors, vectors.where("vec_id % 100 = 0"), block=64).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len({ids[j] for j in brute(x, ids.index(q), 10)[0]} & found) for q, found in got.items())
    assert len(got) == 20 and hits >= 9 * len(got)


def test_many_ties_go_to_the_smaller_id(spark):
    """Forty-eight vectors at one distance from the query."""
    rows = [(100, [3.0, 0.0])]
    exact = [(i, [a, b]) for i, (a, b) in enumerate([(5.0, 0.0), (1.0, 0.0), (3.0, 2.0), (3.0, -2.0)] * 12)]
    vectors = spark.createDataFrame(exact + rows, "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in curves.neighbours(vectors, vectors.where("vec_id = 100")).orderBy("rank").collect()]
    assert got == list(range(10))


def test_look_ups_meet_fewer_codes_than_a_scan(spark):
    random = np.random.default_rng(9)
    base = random.integers(0, 1 << 63, 300, dtype=np.int64)
    codes = np.concatenate([base[random.integers(0, 300, 3000)] ^ (1 << random.integers(0, 63, 3000)), random.integers(0, 1 << 63, 3000, dtype=np.int64)])
    frame = spark.createDataFrame([(i, int(c)) for i, c in enumerate(codes)], "vec_id long, code long")
    asked = frame.where("vec_id < 3000 AND vec_id % 30 = 0")
    report = []
    got = {}
    for r in hamming.top_k(frame, asked, k=3, report=report).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["distance"]))
    for q in range(0, 3000, 30):
        far = np.bitwise_count(codes.view(np.uint64) ^ codes[q].view(np.uint64)).astype(int)
        best = [j for j in np.lexsort((np.arange(len(codes)), far)) if j != q][:3]
        assert sorted(got[q]) == [(n, j, far[j]) for n, j in enumerate(best, 1)]
    assert sum(met for _, _, met in report) < 100 * len(codes) / 5


def test_masks_and_segments():
    assert sorted(hamming.masks(4, 2)) == [3, 5, 6, 9, 10, 12] and hamming.masks(3, 0) == [0]
    for codes in (0, 1, 300, 10**6, 10**12):
        parts = hamming.segments_for(codes)
        assert [low for low, _ in parts] == [sum(b for _, b in parts[:i]) for i in range(len(parts))] and sum(b for _, b in parts) == 64
