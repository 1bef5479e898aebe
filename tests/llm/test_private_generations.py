"""Contexts that only discovered identifiers lead to, and contexts with more unknown values than seeds."""
import hashlib

import numpy as np

from prismtab.llm import pii


def key(i):
    return hashlib.sha1(str(i).encode()).hexdigest()


def brute_force(rows, rounds=2000):
    """(pattern, seeds, confidence) by plain rounds, one after the other."""
    fixed = {}
    for pattern, value, score in rows:
        fixed[pattern, value] = max((s for s in (fixed.get((pattern, value)), score) if s is not None), default=None)
    patterns = {p: [v for q, v in fixed if q == p] for p, _ in fixed}
    scores = {}
    for _ in range(rounds):
        found = {}
        for p, values in patterns.items():
            now = [fixed[p, v] if fixed[p, v] is not None else scores.get(v, 0.0) for v in values]
            found[p] = (sum(fixed[p, v] == 1 or fixed[p, v] is None and scores.get(v, 0.0) >= pii.CONFIDENCE for v in values), sum(now) / (len(now) + 0.5))
        scores = {}
        for (p, v), known in fixed.items():
            if known is None and found[p][0] >= pii.LEAST_SEEDS and found[p][1] > 0.05:
                scores[v] = 1 - (1 - scores.get(v, 0.0)) * (1 - found[p][1])
    return found


def test_more_unknown_values_than_seeds(spark):
    rows = [(i, f'{i} token = "{key(i)}" w{i} x{i}') for i in range(5)] + [(100 + i, f'{i} token = "Zx{i:02d}-77-Quux" y{i} z{i}') for i in range(40)]
    found = pii.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found if r.discovered} == {100 + i for i in range(40)}


def test_second_generation(spark):
    value = [f"Zx{i:02d}-77-Quux" for i in range(31)]
    rows = [(i, f"first key {key(i)} a{i} b{i}") for i in range(60)]
    rows += [(100 + i, f"first key {value[i]} c{i} d{i}") for i in range(30)]
    rows += [(200 + i, f"second place {value[i]} e{i} f{i}") for i in range(31)]
    found = {r.doc_id: r.discovered for r in pii.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s)[::2] for s in found[230]] == [(13, 13 + len(value[30]))]


def test_right_context(spark):
    rows = [(i, f"x{i} y{i} {key(i)} was revoked") for i in range(12)] + [(50, "Zx81-99-Quux77 was revoked"), (51, "Zx81-99-Quux78 was found")]
    found = {r.doc_id: r.discovered for r in pii.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s)[::2] for s in found[50]] == [(0, 14)] and not found[51]


def test_scores_settle_where_plain_rounds_do(spark):
    random = np.random.default_rng(8)
    rows = []
    for value in range(150):
        score = 1.0 if value < 45 else 0.0 if value < 50 else None
        rows += [(int(p), value, score) for p in random.choice(9, int(random.integers(1, 4)), replace=False)]
    got = {r.pattern: (r.seeds, r.confidence) for r in pii.pattern_scores(spark.createDataFrame(rows, "pattern long, value long, score double"), tolerance=1e-6).collect()}
    want = brute_force(rows)
    assert got.keys() == want.keys() and all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 1e-4 for p in got)
