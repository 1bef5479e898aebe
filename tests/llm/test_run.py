"""The whole pipeline row by row: run() against its stages, and every stage against a plain version of it."""
import collections
import re

import pytest

import corpus_pipeline
from prismtab.llm import pii
from prismtab.llm.common import stored, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return len(WORD.findall(text or ""))


def one_of_each(rows):
    """Smallest id of each component of five-word Jaccard similarity 0.8 or more."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {i for i in sets if top(i) == i}


def targets(sizes, total):
    """Shares by weight 1, 2, 3 in the order of the sources, at most three times a source's size."""
    weight = {s: 1 + n % 3 for n, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    fixed = {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s: 3.0 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return fixed | share
        fixed |= over


@pytest.fixture(scope="module")
def steps(spark):
    docs, found = table(spark, SF, "documents"), []
    found.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        found.append(docs)
    return found


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_run_gives_what_its_stages_give(spark, steps):
    key = lambda r: (r["doc_id"], r["bucket"] is None, r["bucket"], r["batch"], r["slot"])
    assert sorted(rows(corpus_pipeline.run(spark, SF)), key=key) == sorted(rows(steps[5]), key=key)


def test_language_drops_texts_without_letters_only(steps):
    before, after = rows(steps[0]), {r["doc_id"]: r for r in rows(steps[1])}
    assert set(after) == {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")}
    assert all(after[r["doc_id"]]["text"] == r["text"] and after[r["doc_id"]]["lang"] for r in before if r["doc_id"] in after)


def test_near_duplicates_keep_one_of_each(steps):
    assert {r["doc_id"] for r in rows(steps[2])} == one_of_each([(r["doc_id"], r["text"]) for r in rows(steps[1])])


def test_private_data_is_marked(steps):
    before, after = {r["doc_id"]: r for r in rows(steps[2])}, {r["doc_id"]: r for r in rows(steps[3])}
    assert before.keys() == after.keys()
    for r in pii.find_private(steps[2]).collect():
        text, spans = before[r["doc_id"]]["text"], sorted(map(tuple, [*r["spans"], *r["discovered"]]))
        want, at = "", 0
        for start, kind, end in spans:
            if start >= at:
                want += text[at:start] + "<" + pii.KINDS[kind].upper() + ">"
            at = max(at, end)
        assert after[r["doc_id"]]["text"] == want + text[at:] and after[r["doc_id"]]["n_chars"] == len(want + text[at:])


def test_the_mix_meets_its_targets(steps):
    before, after = rows(steps[3]), rows(steps[4])
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in before:
        sizes[r["source"]] += words(r["text"])
        largest[r["source"]] = max(largest[r["source"]], words(r["text"]))
    for r in after:
        taken[r["source"]] += words(r["text"])
    wanted = targets(sizes, sum(sizes.values()))
    assert all(abs(taken[s] - wanted[s]) <= largest[s] for s in sizes)
    assert max(collections.Counter(r["doc_id"] for r in after).values()) <= 3


def test_the_packing_holds_all_in_budget(steps):
    packed = rows(steps[5])
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in packed) == collections.Counter((r["doc_id"], words(r["text"])) for r in rows(steps[4]))
    batches = collections.defaultdict(list)
    for r in packed:
        if r["n_tokens"]:
            assert r["n_tokens"] <= r["padded_length"]
            batches[r["bucket"], r["batch"]].append(r)
    for members in batches.values():
        assert len({m["padded_length"] for m in members}) == 1 and sorted(m["slot"] for m in members) == list(range(len(members)))
        assert len(members) == 1 or len(members) * members[0]["padded_length"] <= 65_536
