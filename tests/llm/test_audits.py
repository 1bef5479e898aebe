"""Source divergence and filter interactions against brute force, and their edge cases."""
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismtab.llm import divergence, interactions
from prismtab.llm.common import table
from prismtab.llm.queries import op11_source_divergence, op13_filter_audit

SF = "/root/testdata/sf0.001"


def brute_divergence(rows, least, top):
    """rows: (lang, source, text), already without nulls."""
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        small = text.translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", small)
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    found = set()
    for lang in docs.keys() | {r[0] for r in rows}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted({s for name, s in counts if name == lang} | {r[1] for r in rows if r[0] == lang})
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(count):
            below = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // below for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(whole)
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            found |= {(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(pairs, 1)}
            found |= {(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(terms[:top], 1)}
    return found


@pytest.fixture
def small_tasks(monkeypatch):
    for name, value in (("BLOCK_TERMS", 40), ("TILE_SOURCES", 2), ("PIECE_BYTES", 64)):  # of the driver
        monkeypatch.setattr(divergence, name, value)


def test_divergence_of_documents(spark, small_tasks):
    docs = table(spark, SF, "documents")
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    assert {tuple(r) for r in divergence.divergence(docs, least_docs=3, top=7).collect()} == brute_divergence(rows, 3, 7)
    assert {tuple(r) for r in op11_source_divergence(spark, SF).collect()} == brute_divergence(rows, 30, 50)


def test_divergence_edges(spark):
    rows = [(None, None, None), ("en", "a", "Ab ab, É éİ x1y"), ("en", "a", "Ab ab, É éİ x1y"), ("en", "b", ""), ("en", None, "ab " * 50000 + "Zz"),
            ("en", "c", "123 \x00[]"), ("xx", "only", "zz"), ("en", "ab", "zz ab")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"term": F.lit(1), "value": F.lit(2), "n": F.lit(3)})
    plain = [tuple(c or "" for c in r) for r in rows]
    for least in (1, 2, 99):
        assert {tuple(r) for r in divergence.divergence(docs, least_docs=least).collect()} == brute_divergence(plain, least, 50)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_terms_of_long_texts(small_tasks):
    """Pieces end between terms, also where a term is longer than a piece."""
    text = "Ab é" + "x" * 300 + " 1 " + "word Éa " * 90 + "[end"
    want = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)})))
    assert {t.decode(): n for t, n in divergence.terms_of(text.encode()).items()} == want


def test_galloping_search():
    random = np.random.default_rng(5)
    for short, long in ((0, 9), (3, 4000), (900, 1000), (700, 60000), (1, 1)):
        a, b = (np.unique(random.integers(0, 90000, n)) for n in (short, long))
        mine, theirs = divergence.common(a, b)
        want, x, y = np.intersect1d(a, b, return_indices=True)
        assert np.array_equal(mine, x) and np.array_equal(theirs, y) and np.array_equal(a[mine], want)


def test_shares_do_not_overflow():
    counts = np.array([0, 7, 10**15 - 1, 10**15])
    want = [1 + 10**9 * (int(c) + 5) // (10**15 + 5 * 1000) for c in counts]
    assert divergence.shares(counts, 10**15, 1000).tolist() == want


def brute_audit(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    smallest = {}
    for i, text, _ in rows:
        if i is not None:
            smallest[text or ""] = min(smallest.get(text or "", i), i)
    good = {i for i, quality, _ in labels if i is not None and quality == 1}
    toxic = {i for i, _, mark in labels if i is not None and mark == 1}
    parts = defaultdict(list)
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {name for name, failed in {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and smallest[text] < i}.items() if failed}
        parts[source or ""].append((i, fails))
    found, shapley = {}, Counter()
    for part, members in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = list(members)
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in alive if letter in f]
                alive = [(i, f) for i, f in alive if letter not in f]
                failing = sum(letter in f for _, f in members)
                shapley[part, letter] += len(gone)
                found[part, order, step] = (len(alive), len(gone), failing - len(gone), sum(f == {letter} for _, f in members),
                                            sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
    return {(*key, *row, shapley[key[0], key[1][key[2] - 1]]) for key, row in found.items()}


def test_audit_of_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    want = brute_audit([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    got = [tuple(r) for r in op13_filter_audit(spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want


def test_audit_edges(spark):
    long = " ".join(f"w{i % 150}" for i in range(40000))
    rows = [(1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, "A#B", "b"), (5, "A#B", ""), (5, "A#B", "b"), (4, "A#B", "b"), (None, "A#B", "b"),
            (None, None, None), (7, long, "b"), (8, long, "b"), (9, " ".join(f"w{i}" for i in range(200)), "c"), (10, "É\U0001F600x", "a")]
    labels = [(4, 1, 0), (4, 0, None), (5, None, 1), (None, 1, 1), (99, 1, 1), (8, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("mine") for c in ("part", "failed", "n", "good", "step", "digest")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in interactions.audit(docs, marks).collect()]
    want = brute_audit(rows, labels)
    assert len(got) == len(want) and set(got) == want
    assert interactions.audit(docs.limit(0), marks).count() == 0
    assert {r["good_lost"] for r in interactions.audit(docs, marks.limit(0)).collect()} == {0}
