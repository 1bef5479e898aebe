"""Encoding and decoding against the tokenizers library, and edge cases."""
import hashlib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from prismtab.llm import bpe
from prismtab.llm.common import table
from prismtab.llm.queries import op12_word_bpe

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return bpe.read_tables()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_path())


def same(tables, library, texts):
    ids, lengths = bpe.Encoder(tables).encode(texts)
    ends = [0, *lengths.cumsum()]
    got = [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_character(tables, library):
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same(tables, library, [f"a{''.join(characters[i:i + 8])}b {characters[i]} x{characters[i]}" for i in range(0, len(characters), 8)])


@pytest.mark.parametrize("letters", ["ab'sSt re1 \ńéΣΑ", "abcdeinthr", "aab", "x<|endoftext|>"])
def test_random_texts(tables, library, letters):
    r = random.Random(3)
    same(tables, library, ["".join(r.choice(letters) for _ in range(r.randint(0, 90))) for _ in range(2000)])


def test_special_tokens_and_marks(tables, library):
    r = random.Random(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|endoftext", "a", "é", " ", "́", "Ab", "̴", "᪰", "ͅ"]
    same(tables, library, ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(3000)])
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    same(tables, library, ["".join(chr(r.randint(0xC0, 0x24F)) + "".join(r.choices(marks, k=3)) for _ in range(8)) for _ in range(2000)])


def test_long_words_and_texts(tables, library, monkeypatch):
    r = random.Random(5)
    word = "".join(r.choice("abcdefghij") for _ in range(20000))
    same(tables, library, ["a" * 300000, word, "it's a Test " * 30000])
    monkeypatch.setattr(bpe, "PIECE_CHARS", 7)
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 5)
    same(tables, library, ["".join(r.choice("ab c \ńé") for _ in range(200)) for _ in range(300)])


def test_one_merge_at_a_time_gives_the_same(tables, library):
    import dataclasses

    r = random.Random(6)
    same(dataclasses.replace(tables, in_order=False), library, ["".join(r.choice("aabcin th") for _ in range(80)) for _ in range(500)])


def test_query_on_documents(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    rows = op12_word_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_edges(spark, tables):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "Hi hi"), (4, "Hi hi"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("mine"), "a b": F.lit(1)})
    found = bpe.decode(bpe.encode(docs, tables), tables)
    assert found.columns == ["doc_id", "text", "a b", "ids", "decoded"]
    got = sorted((str(r["doc_id"]), tuple(r["ids"]), r["decoded"]) for r in found.collect())
    hi = bpe.Encoder(tables).encode(["hi"])[0].tolist()
    x = bpe.Encoder(tables).encode(["x"])[0].tolist()
    assert got == [("1", (), ""), ("2", (), ""), ("3", (), ""), ("4", (*hi, *hi), "hi</w> hi</w>"), ("4", (*hi, *hi), "hi</w> hi</w>"), ("None", tuple(x), "x</w>")]
    assert bpe.encode(docs.limit(0), tables).count() == 0
    odd = spark.createDataFrame([([hi[0], None, 10**8],), (None,)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(odd, tables).collect()] == ["hi</w>", ""]


def test_other_kinds_of_files_are_refused(tmp_path):
    import json

    with open(bpe.default_path(), encoding="utf-8") as file:
        found = json.load(file)
    found["normalizer"]["normalizers"].pop()
    path = tmp_path / "other.json"
    path.write_text(json.dumps(found))
    with pytest.raises(ValueError):
        bpe.read_tables(str(path))
