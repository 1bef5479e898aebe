"""Private data in very long texts and many spans, and quality scores that do not depend on the batch."""
import hashlib
import re
import time

import numpy as np
import pyarrow as pa

from prismtab.llm import pii, quality
from prismtab.llm.common import table
from prismtab.llm.queries import op2_private_data

SF = "/root/testdata/sf0.001"


def brute_base(text):
    """Base spans by the expressions of the contract, character by character where a kind needs a check."""
    def luhn(digits):
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return sum(v - 9 * (v > 9) for v in twice) % 10 == 0

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 14 <= len(re.sub("[^0-9]", "", t)) <= 19 and luhn(re.sub("[^0-9]", "", t))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 10 <= len(re.sub("[^0-9]", "", t)) <= 15)}
    found = [(m.start(), i, kind, m.end()) for i, (kind, (form, passes)) in enumerate(rules.items())
             for m in re.finditer(form, text) if passes(m.group())]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_query_against_the_expressions(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    rows = op2_private_data(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(k == kind for kind, _, _ in want) for k in pii.BASE_KINDS]
        joined = ",".join(f"{kind}:{start}:{end}" for kind, start, end in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert r["n_spans"] == len(spans) and set(joined.split(",") if joined else ()) <= set(spans)


def test_shaped_tokens_are_those_of_the_expression():
    form = re.compile(r"[A-Za-z0-9_@+](?:[A-Za-z0-9_@+./:-]*[A-Za-z0-9_])?", re.ASCII)
    random = np.random.default_rng(8)
    for _ in range(4000):
        text = "".join(random.choice(list("a1@+./:- _"), int(random.integers(0, 40))))
        want = [m.span() for m in form.finditer(text) if len(m.group()) >= pii.LEAST_SHAPE and len(re.findall("[0-9]", m.group())) >= pii.LEAST_DIGITS]
        assert list(pii.shaped(text)) == want


def test_long_runs_take_linear_time():
    began = time.perf_counter()
    for piece in ("+/", "@", "@-", "a@b.c ", "1.", "1-", "+1 (", "0f" * 20 + " ", "key a@b.cd "):
        pii.seen_in(piece * (1_000_000 // len(piece)) + "1")
    assert time.perf_counter() - began < 90


def test_many_spans_are_cut_in_one_pass(spark):
    text = "".join(f"mail é{i}@x.org, " for i in range(60_000))
    docs = spark.createDataFrame([(1, text, 5), (2, None, 0), (3, "no", 2)], "doc_id long, text string, n_chars long")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert time.perf_counter() - began < 90
    assert got[1]["text"] == "mail é<EMAIL>, " * 60_000 and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[3]["text"] == "no"


def some_model():
    random = np.random.default_rng(1)
    normal = lambda *shape: random.normal(0, 1, shape)
    return quality.Model(normal(quality.FEATURES, quality.CODE), normal(quality.CODE), normal(quality.CODE, quality.ATTENTION),
                         normal(quality.CODE, quality.ATTENTION), normal(quality.ATTENTION), normal(quality.CODE), normal(1))


def test_scores_do_not_depend_on_the_batch():
    model, texts = some_model(), ["abcdefghijkl"[:n] for n in range(13)] + [None, "", "ab" * 700]
    alone = [quality.score_texts(model, *quality.text_bytes(pa.array([t], pa.string())))[0] for t in texts]
    mixed = quality.score_texts(model, *quality.text_bytes(pa.array(texts, pa.string())))
    short = quality.score_texts(model, *quality.text_bytes(pa.array(["ab", "cd", ""], pa.string())))
    assert np.allclose(alone, mixed, atol=1e-6) and np.allclose(short[2], alone[0], atol=1e-6) and abs(alone[13] - alone[14]) < 1e-9


def test_fit_follows_its_gradient():
    """One Adam step from the same start moves each weight against the numeric gradient of the loss."""
    random = np.random.default_rng(2)
    x, of, y = random.normal(size=(12, quality.FEATURES)), np.repeat(np.arange(4), 3), np.array([0.0, 1, 1, 0])
    start = quality.fit(x, of, y, epochs=0)
    moved = quality.fit(x, of, y, epochs=1, batch=4)

    def loss(model):
        codes, _, _, raw = quality.passage_codes(model, x)
        share = raw / quality.bag_sums(raw, of, 4)[of]
        p = quality.sigmoid(quality.bag_sums(codes * share[:, None], of, 4) @ model.score + model.score_bias)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + 1e-4 * (model.encode.astype(float) ** 2).sum()

    start = quality.Model(*(a.astype(np.float64) for a in start.arrays()))
    for i, (weight, after) in enumerate(zip(start.arrays(), moved.arrays())):
        flat, change = weight.reshape(-1), (after - weight).reshape(-1)
        for at in random.choice(flat.size, min(12, flat.size), replace=False):
            was, step = flat[at], 1e-5
            flat[at] = was + step
            up = loss(start)
            flat[at] = was - step
            slope = (up - loss(start)) / (2 * step)
            flat[at] = was
            if abs(slope) > 1e-5:
                assert np.sign(change[at]) == -np.sign(slope), (i, at, slope, change[at])
