"""The operators against brute force, and their edge cases: nulls, empty texts, ties, repeated rows, empty
tables, clashing columns."""
import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismtab.llm import chat, curves, hamming, jaccard, langid, mixing, packing, pii, quality, urls
from prismtab.llm.common import components, table, word_count

SF = "/root/testdata/sf0.001"
ODD = [(1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, "Hello wide world of words", "b"), (5, "Hello wide world of words", "b"),
       (6, "x", "a"), (7, "word " * 30000, "b"), (7, "word " * 30000, "b"), (None, "no id here at all", None)]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"lang": F.lit("en"), "score": F.lit("mine"), "size": F.lit(-1)})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def brute_components(rows, width, percent):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    names = sorted(sets)
    for a in names:
        for b in names:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                label[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(sets[i]), top(i)) for i in names}


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_join(docs, width, percent):
    member, _ = jaccard.similarity_join(docs, width=width, percent=percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in member.collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], width, percent)


def test_jaccard_dense_near_copies(spark):
    random = np.random.default_rng(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        words = list(base)
        for place in random.integers(0, 60, int(random.integers(0, 4))):
            words[place] = f"x{random.integers(0, 9)}"
        rows.append((i, " ".join(words)))
    member, _ = jaccard.similarity_join(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=90)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in member.collect()}
    assert got == brute_components(rows, 3, 90)


def test_jaccard_edges(odd, none):
    member = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similarity_join(odd, width=3, percent=90)[0].collect()}
    assert member == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 3, 4), (5, 3, 4), (6, 1, 6), (7, 1, 7), (None, 3, None)}
    assert jaccard.similarity_join(none)[0].count() == 0
    kept = jaccard.one_of_each(odd, width=3, percent=90)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "6", "7", "None"]


@pytest.mark.parametrize("profile", [[], [(0.5, 0.2)], [(0.75, 0.9)]])
def test_scheme_is_complete(profile):
    """A linked pair has a key in common, also when both sets leave out the keys that are worst for the pair."""
    random = np.random.default_rng(3)
    for percent in (90, 80, 60):
        for sets in (1, 10**9):
            scheme = jaccard.Schemes(percent, {1 << i: sets for i in range(9)}, 400, profile)
            for _ in range(100):
                a = np.unique(random.integers(0, 1 << 63, int(random.integers(2, 150))).astype(np.uint64))
                most = jaccard.most_apart(len(a), len(a), percent)
                b = a.copy()
                b[random.choice(len(a), most // 2, replace=False)] = random.integers(0, 1 << 63, most // 2)
                b = np.unique(b)
                if 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
                    continue
                (left, spare_left), (right, spare_right) = scheme.keys(a), scheme.keys(b)
                both, kept = np.intersect1d(left, right), []
                for keys, spare in ((left, spare_left), (right, spare_right)):
                    frequent = np.where(np.isin(keys, both), 9, 1)  # what the pair shares counts as frequent
                    mine = []
                    for side in (0, 1):
                        here = keys >> jaccard.KEY_BITS == side
                        order = np.lexsort((-keys[here], -frequent[here]))
                        mine.append(keys[here][order][spare[side]:])
                    kept.append(np.concatenate(mine))
                assert len(np.intersect1d(*kept))


def test_deletions_are_used_where_they_pay():
    heavy = [(0.5, 0.001)]
    assert jaccard.allocation(400, 499, 80, 10**9, heavy)[2] > 0 and jaccard.allocation(400, 499, 80, 100, heavy)[2] == 0
    scheme = jaccard.Schemes(80, {256: 10**9}, 3000, heavy)
    assert any(twos for low, (_, _, twos) in zip(scheme.starts.tolist(), scheme.parts) if low >= 100)
    for need, ones, twos in scheme.parts:
        assert ones + 2 * twos >= need


def test_overlaps_are_measured():
    base = np.arange(100, dtype=np.uint64)
    apart = [np.concatenate([base[:50], np.arange(1000 * i, 1000 * i + 50, dtype=np.uint64)]) for i in range(1, 11)]
    found = dict(jaccard.overlaps([*apart, base + np.uint64(10**6), base + np.uint64(10**6)], 80))
    assert max(found, key=found.get) == 0.525 and abs(found[0.525] - 45 / 66) < 1e-9
    assert jaccard.overlaps([], 80)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)}


def test_base_forms_match_their_expressions():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    random = np.random.default_rng(2)
    for _ in range(5000):
        text = "".join(random.choice(list("a1.@-+ (2"), int(random.integers(0, 25))))
        assert list(pii.emails(text)) == [m.span() for m in email.finditer(text)]
        assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in ip.finditer(text)]


def test_private_data(spark, odd, none):
    rows = [(i, f"my token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" is long") for i in range(12)]
    rows += [(50, 'your token = "Zx81-99-Quux77" is odd'), (51, "mail a.b@c.example.org or 10.0.0.1, not 300.1.1.1; +1 (706) 555-3138"),
             (52, "card 4111 1111 1111 1111 and 4111111111111112")]
    found = {r["doc_id"]: r for r in pii.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in found[50]["discovered"]] == [(14, 5, 28)]
    assert (found[51]["n_email"], found[51]["n_ip"], found[51]["n_phone"], found[51]["n_card"]) == (1, 1, 1, 0)
    assert (found[52]["n_card"], found[52]["base_sha256"]) == (1, hashlib.sha256(b"card:5:24").hexdigest())
    clean = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[51] == "mail <EMAIL> or <IP>, not 300.1.1.1; <PHONE>" and clean[50] == 'your token = "<DISCOVERED>" is odd'
    assert pii.find_private(odd).count() == len(ODD) and pii.find_private(none).count() == 0
    assert pii.redact(odd).collect() == odd.collect() or sorted(map(str, pii.redact(odd).collect())) == sorted(map(str, odd.collect()))


def test_hamming_edges(spark):
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 2.0]), (3, None), (4, [float("nan"), 1.0]),
                                     (5, [None, 1.0])], "vec_id long, embedding array<double>")
    codes = hamming.sign_codes(vectors)
    got = sorted(map(tuple, hamming.top_k(codes, codes.where("vec_id = 0")).collect()))
    assert got == [(0, 1, 1, 0), (0, 2, 2, 1)]
    assert hamming.top_k(codes.limit(0), codes.limit(0)).count() == 0


def test_curve_recall_and_edges(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = vectors.orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows], dtype=np.float64), [r["vec_id"] for r in rows]
    got = collections.defaultdict(dict)
    for r in curves.neighbours(vectors, vectors.where("vec_id % 50 = 0")).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    hits = 0
    for q, found in got.items():
        far = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(axis=1))
        best = [ids[j] for j in np.lexsort((ids, far)) if ids[j] != q][:10]
        hits += len(set(best) & set(found))
        assert all(abs(far[ids.index(v)] - s) < 1e-12 for v, s in found.items())
    assert hits >= 9 * len(got) and len(got) == 10
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 3.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, curves.neighbours(few, few.where("vec_id = 0")).collect())) == [(0, 1, 1, 0.0), (0, 2, 2, 10 ** 0.5)]
    assert curves.neighbours(few.limit(0), few.limit(0)).count() == 0


def test_hilbert_curve_is_continuous():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    places = curves.hilbert_places(cells, 3)
    assert sorted(places.tolist()) == list(range(512))
    assert set(np.abs(np.diff(cells[np.argsort(places)], axis=0)).sum(axis=1)) == {1}


def test_boundaries_are_optimal():
    import itertools

    random = np.random.default_rng(4)
    for _ in range(30):
        lengths = np.sort(random.choice(np.arange(1, 60), 8, replace=False))
        counts, buckets = random.integers(1, 9, 8), int(random.integers(1, 5))
        cost = lambda ends: sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts))
        best = min(cost([*some, lengths[-1]]) for some in itertools.combinations(lengths[:-1], buckets - 1))
        ends = packing.best_boundaries(lengths, counts, lengths * counts, buckets)
        assert cost(ends) == best and len(ends) <= buckets


def test_packing(docs, odd, none):
    rows = packing.pack(docs, batch_tokens=4096).collect()
    assert len(rows) == docs.count()
    batches = collections.defaultdict(list)
    for r in rows:
        if r["n_tokens"]:
            assert r["n_tokens"] <= r["padded_length"]
            batches[r["bucket"], r["batch"]].append(r)
    for members in batches.values():
        assert len(members) == 1 or len(members) * members[0]["padded_length"] <= 4096
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    assert packing.pack(odd).where("bucket IS NULL").count() == 3 and packing.pack(none).count() == 0


def test_word_count(odd):
    assert [r[0] for r in odd.orderBy(F.asc_nulls_last("doc_id")).select(word_count(F.col("text"))).collect()] == [0, 0, 0, 5, 5, 1, 30000, 30000, 5]


def brute_targets(sizes):
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    weight = {n: 1 + i % 3 for i, n in enumerate(names)}
    total, free, target = sum(sizes.values()), set(names), {}
    while free:
        left = total - sum(target.values())
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = {n for n in free if share[n] > 3 * sizes[n]}
        if not over:
            return target | share
        target |= {n: 3.0 * sizes[n] for n in over}
        free -= over
    return target


def test_mixing(docs, odd, none):
    rows = mixing.fair_mix(docs).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = brute_targets(dict(sizes))
    assert all(abs(r["target"] - want[r["source"]]) < 1e-6 * want[r["source"]] for r in rows)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.fair_mix(docs.repartition(5)).collect()))
    mixed = mixing.fair_mix(odd)
    assert mixed.count() == len(ODD) and {r["size"] for r in mixed.where("text IS NULL").collect()} == {0}
    assert mixing.fair_mix(none).count() == 0
    again = mixing.mixed_documents(odd)
    assert again.columns == odd.columns and again.count() >= 1


def test_targets_stop_at_three_times(spark):
    sizes = {"a": 10, "b": 1, "c": 2, "d": 1000, None: 5}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in want)


def test_chat(spark):
    rows = [(1, 0, "user", "a <| b <\\| c"), (1, 1, "user", "<|im_end|><|next|>"), (1, 2, "assistant", "x<"), (1, 3, "assistant", None),
            (2, 0, "odd\nrole<|", ""), (2, 0, "odd\nrole<|", ""), (None, None, None, "é")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    read = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    assert [tuple(t) for t in read[1]["turns"]] == [(r, t or "") for c, _, r, t in rows if c == 1]
    assert [tuple(t) for t in read[2]["turns"]] == [("odd\nrole<|", "")] * 2 and [tuple(t) for t in read[None]["turns"]] == [("", "é")]
    assert read[1]["loss_texts"] == ["x<", ""] and sum(r["chars"] for r in read[1]["loss_runs"]) == len(read[1]["formatted"])
    assert chat.chat_digests(turns.limit(0)).count() == 0


def test_url_lists(spark):
    entries = spark.createDataFrame(
        [("bad.org", "spam", "2024-01-10", "add"), ("bad.org", "spam", "2024-02-10", "remove"), ("good.org/x", "adult", "2024-01-01", "add"),
         (None, "spam", "2024-01-01", "add"), ("bad.org", "spam", "2024-01-12", "add")],
        "pattern string, category string, listed_on string, action string").withColumn("listed_on", F.to_date("listed_on"))
    pages = [(1, "http://a.bad.org/p", "2024-01-09"), (2, "http://a.bad.org/p", "2024-01-10"), (3, "HTTP://BAD.org:80", "2024-02-09"),
             (4, "http://bad.org", "2024-02-10"), (5, "http://notbad.org", "2024-01-11"), (6, "http://good.org/x/y?z", "2024-05-01"),
             (7, "http://good.org/xx", "2024-05-01"), (8, None, "2024-05-01"), (9, "no url", None), (2, "http://a.bad.org/p", "2024-01-10")]
    captures = spark.createDataFrame(pages, "page_id long, url string, at string").select("page_id", "url", F.to_timestamp("at").alias("fetched_at"), F.lit(0).alias("listed"))
    got = urls.url_verdicts(captures, entries).collect()
    assert len(got) == len(pages) and {r["page_id"] for r in got if r["listed"]} == {2, 3, 6}
    assert urls.url_verdicts(captures, entries.limit(0)).where("listed").count() == 0
    assert urls.url_verdicts(captures.limit(0), entries).count() == 0


def test_language(docs, odd, none):
    network = langid.train(docs.where("doc_id % 5 <> 0"), steps=300)
    named = langid.identify(docs.where("doc_id % 5 = 0 AND length(text) > 100"), network)
    assert named.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.9
    got = langid.identify(odd, network)
    assert got.count() == len(ODD) and {r["lang_pred"] for r in got.where("doc_id <= 3").collect()} == {"und"}
    assert got.where("score < 0 OR score > 1").count() == 0 and langid.identify(none, network).count() == 0
    assert langid.train(none) is None and {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}


def test_gradients_of_the_network():
    random = np.random.default_rng(0)
    network = langid.new_network(["a", "b"], random)
    codes = random.integers(0, 256, (5, 3))
    order, state = np.arange(5), np.zeros((langid.HIDDEN, 3), np.float32)
    above = random.normal(size=(5, 2, 3)).astype(np.float32)

    def run():
        states, kept = [state], []
        for t in order:
            gates = np.empty((3 * langid.HIDDEN, 3), np.float32)
            new, candidate = langid.step(network.forward, codes[t], states[-1], gates)
            states.append(new)
            kept.append((gates, candidate))
        return states, kept, sum((above[t] * (network.forward.scores @ s)).sum() for t, s in zip(order, states[1:]))

    states, kept, _ = run()
    gradients = langid.backpropagate(network.forward, codes, order, states, kept, above)
    for weight, gradient in zip(network.forward.arrays(), gradients):
        place = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        weight[place] += 1e-2
        high = run()[2]
        weight[place] -= 2e-2
        low = run()[2]
        weight[place] += 1e-2
        assert abs((high - low) / 2e-2 - gradient[place]) < 0.05 * abs(gradient[place]) + 1e-3


def test_quality(spark, odd, none):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.train(docs, labels.where("doc_id % 4 <> 2"))
    scored = quality.score_quality(docs, model).join(labels.where("doc_id % 4 = 2"), "doc_id")
    assert scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] >= 0.9
    got = quality.score_quality(odd, model)
    assert got.count() == len(ODD) and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert quality.score_quality(none, model).count() == 0 and quality.train(docs, labels.limit(0)) is None
