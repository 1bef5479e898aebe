"""Byte-pair encoding and decoding with the tables of a public tokenizer file.

The file is one of the `tokenizers` library with the kind of model read here: NFC, white space to one
space, lower case; words cut by the file's pattern; byte-level symbols whose last one in a word carries
an end mark. Special tokens of the file are found in the raw text first and become their own ids.

Merges run for many words at once. The symbols of all words lie in one flat array. The rank of each
neighbouring pair is found by binary search over the sorted pair keys (left * K + right). Each round
takes the lowest rank of every word, merges all its places from left to right (or, for a table in which
a merged symbol could take part in an earlier merge, the first place only), and looks up only the pairs
that changed. Words without a merge left leave the array, so a very long word goes on alone. Words are
remembered by a task up to a bound; the words of a document become its ids by array look-ups.

Null and empty texts have no ids, and no ids decode to the empty text. Very long texts are read whole, in
pieces that start at a space. Rows that repeat give the same ids. Columns of the input pass through;
one that has the name of the result is replaced. An empty table gives an empty result. Ids that the
file does not have, and nulls among ids, are left out when decoding.
"""
from __future__ import annotations

import json
import re
import sys
import unicodedata
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from prismtab.llm.common import small_batches

#: Fixed values of the file's format: the white space its normaliser knows, and the byte-level alphabet (printable
#: bytes stand for themselves, the others for the characters from 256 on, in order).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Where the Unicode tables of the library's steps differ from those of Python 3.13 (Unicode 15.1). Its lower
#: case is of Unicode 17, its expressions of Unicode 16 (letters and numbers added since), its NFC of Unicode 9: marks that
#: are newer stay where they are. First and last character of each range.
LATER_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}}
LATER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
LATER_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
LATER_MARKS = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50),
    (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E),
    (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45),
    (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF),
    (0x1E4EC, 0x1E4EF)]
KNOWN_WORDS = 200_000
PIECE_CHARS = 1 << 20
NONE = np.iinfo(np.int32).max


def characters(ranges: list[tuple[int, int]]) -> str:
    """The inside of a character class."""
    return "".join(f"{re.escape(chr(first))}-{re.escape(chr(last))}" for first, last in ranges)


LATER = re.compile("[" + "".join(map(chr, LATER_LOWER)) + "]")
APART = re.compile(f"([{characters(LATER_MARKS)}])")
#: Characters that need one of the steps above or that are, or become, one beyond the first 65,536; most texts have none.
RARE = re.compile("[" + characters([m for m in LATER_MARKS if m[1] < 0x10000]) + r"\U00010000-\U0010ffff"
                  + "".join(chr(c) for c in LATER_LOWER if c < 0x10000)
                  + "".join(chr(c) for c in range(0xF900, 0xFB00) if max(unicodedata.normalize("NFC", chr(c))) > "\uffff") + "]")


@dataclass
class Tables:
    """What the file says, as arrays: bounded by the size of its vocabulary."""

    tokens: list[str | None]
    inside: np.ndarray  # id of a byte within a word, and at its end
    last: np.ndarray
    keys: np.ndarray  # sorted pair keys, with the rank and the merged id of each
    ranks: np.ndarray
    merged: np.ndarray
    in_order: bool  # no merge makes a pair that is merged earlier
    pattern: str
    special: dict[str, int]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def read_tables(path: str | None = None) -> Tables:
    """The tables of a tokenizer file; read once, on the driver."""
    with open(path or default_path(), encoding="utf-8") as file:
        found = json.load(file)
    model, steps = found["model"], [n["type"] for n in found["normalizer"]["normalizers"]]
    split, level = found["pre_tokenizer"]["pretokenizers"]
    known = (model["type"], steps, split["type"], split["behavior"], split["invert"], level["type"], level["use_regex"], found["decoder"])
    if known != ("BPE", ["NFC", "Replace", "Lowercase"], "Split", "Removed", True, "ByteLevel", False, None):
        raise ValueError(f"a tokenizer file of another kind: {known}")
    vocabulary, mark = model["vocab"], model["end_of_word_suffix"]
    special = {t["content"]: t["id"] for t in found["added_tokens"]}
    tokens: list[str | None] = [None] * (1 + max([*vocabulary.values(), *special.values()]))
    for token, number in (vocabulary | special).items():
        tokens[number] = token
    others = iter(range(256, 512))
    shown = [chr(b) if b in set(PRINTABLE) else chr(next(others)) for b in range(256)]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    latest = {left + right: rank for rank, (left, right) in enumerate(pairs)}
    in_order = all(latest.get(side, -1) < rank for rank, pair in enumerate(pairs) for side in pair)
    keys = np.array([vocabulary[left] * len(tokens) + vocabulary[right] for left, right in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    merged = np.array([vocabulary[left + right] for left, right in pairs], np.int32)
    return Tables(tokens, np.array([vocabulary[c] for c in shown], np.int32), np.array([vocabulary[c + mark] for c in shown], np.int32),
                  keys[order], order.astype(np.int32), merged[order], in_order, split["pattern"]["Regex"], special)


def ranked(tables: Tables, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of the pairs in the sorted keys; -1 for pairs that are not merged."""
    key = left.astype(np.int64) * len(tables.tokens) + right
    place = np.minimum(np.searchsorted(tables.keys, key), len(tables.keys) - 1)
    return np.where(tables.keys[place] == key, place, -1)


def merge_words(tables: Tables, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths): the ids of all words, one after the other, and how many each has. No word is empty."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    symbol, word = tables.inside[data], np.repeat(np.arange(len(words)), lengths)
    ends = np.cumsum(lengths) - 1
    symbol[ends] = tables.last[data[ends]]

    def look_up(at: np.ndarray):
        """Rank and place of the pairs that start at these places of the flat array."""
        following = np.minimum(at + 1, len(symbol) - 1)
        place = np.where((at < len(symbol) - 1) & (word[at] == word[following]), ranked(tables, symbol[at], symbol[following]), -1)
        return np.where(place >= 0, tables.ranks[place], NONE), place

    rank, place = look_up(np.arange(len(symbol)))
    done_words, done = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    while len(symbol):
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        best = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(word)))
        if (best == NONE).any():
            over = np.repeat(best == NONE, sizes)
            done_words.append(word[over])
            done.append(symbol[over])
            symbol, word, rank, place = symbol[~over], word[~over], rank[~over], place[~over]
            sizes, best = sizes[best < NONE], best[best < NONE]
        hit = np.flatnonzero(rank == np.repeat(best, sizes))
        if not len(hit):
            break
        if tables.in_order:  # of places that follow each other (one symbol repeats), every second one
            new_run = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            first = np.flatnonzero(new_run)
            hit = hit[(np.arange(len(hit)) - np.repeat(first, np.diff(np.append(first, len(hit))))) % 2 == 0]
        else:
            hit = hit[np.concatenate([[True], word[hit][1:] != word[hit][:-1]])]
        symbol[hit] = tables.merged[place[hit]]
        left = np.ones(len(symbol), bool)
        left[hit + 1] = False
        symbol, word, rank, place = symbol[left], word[left], rank[left], place[left]
        now = hit - np.arange(len(hit))
        touched = np.zeros(len(symbol), bool)
        touched[now] = touched[now[now > 0] - 1] = True
        changed = np.flatnonzero(touched)
        rank[changed], place[changed] = look_up(changed)
    at, ids = np.concatenate(done_words), np.concatenate(done)
    return ids[np.argsort(at, kind="stable")], np.bincount(at, minlength=len(words))


def word_patterns(pattern: str) -> tuple[re.Pattern, re.Pattern]:
    """The file's pattern for all texts, and for texts without characters beyond the first 65,536. Its letter and number
    classes are written as ranges. White space is never part of a word, so it needs no replacing."""
    ranges = {"L": list(LATER_LETTERS), "N": list(LATER_NUMBERS)}
    for kind, run in groupby(range(sys.maxunicode + 1), lambda code: unicodedata.category(chr(code))[0]):
        if kind in ranges:
            codes = list(run)
            ranges[kind].append((codes[0], codes[-1]))
    found = []
    for end in (sys.maxunicode, 0xFFFF):
        text = pattern
        for kind, all_of in ranges.items():
            text = text.replace(rf"\p{{{kind}}}", characters([r for r in all_of if r[1] <= end]))
        found.append(re.compile(text.replace(r"\s", WHITE)))
    return found[0], found[1]


class WordNumbers(dict):
    """Words by number; a word that is not known yet gets the next number and joins the list of new ones."""

    def __missing__(self, word: str) -> int:
        self.new.append(word.encode("utf-8", "surrogatepass"))
        number = self[word] = len(self)
        return number


class Encoder:
    """Texts to ids; keeps the ids of words it has met, up to a bound."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.words, self.plain_words = word_patterns(tables.pattern)
        self.special = re.compile("|".join(map(re.escape, sorted(tables.special, key=len, reverse=True)))) if tables.special else None
        self.forget()

    def forget(self) -> None:
        """Start anew, with the special tokens as words that have their id already."""
        self.number = WordNumbers((("special", content), i) for i, content in enumerate(self.tables.special))
        self.ids = np.array(list(self.tables.special.values()), np.int32)
        self.starts = np.arange(len(self.ids) + 1)

    def pieces(self, text: str):
        """(special token or None, text): the text in its order, cut at special tokens, and long stretches at spaces."""
        at = 0
        for found in self.special.finditer(text) if self.special else ():
            yield from ((None, p) for p in stretches(text, at, found.start()))
            yield found.group(), ""
            at = found.end()
        yield from ((None, p) for p in stretches(text, at, len(text)))

    def word_numbers(self, text: str, new: list[bytes]) -> np.ndarray:
        """The words of a text by number; words not met before are numbered on and added to `new`."""
        parts, number = [], self.number
        for special, piece in self.pieces(text):
            if special is not None:
                parts.append(np.array([number["special", special]], np.int64))
                continue
            rare = not piece.isascii() and RARE.search(piece) is not None
            found = (self.words if rare else self.plain_words).findall(normal(piece, rare))
            number.new = new
            parts.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of the texts, one after the other."""
        if len(self.number) > KNOWN_WORDS:
            self.forget()
        new: list[bytes] = []
        numbers = [self.word_numbers(text or "", new) for text in texts]
        if new:
            ids, lengths = merge_words(self.tables, new)
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        flat = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        sizes = self.starts[flat + 1] - self.starts[flat]
        before = np.cumsum(sizes) - sizes
        ids = self.ids[np.repeat(self.starts[flat] - before, sizes) + np.arange(sizes.sum())]
        edges = np.cumsum([0, *map(len, numbers)])
        totals = np.concatenate([[0], np.cumsum(sizes)])[edges]
        return ids, np.diff(totals)


def stretches(text: str, at: int, end: int):
    """The text from `at` to `end` in pieces of bounded length that start at a space; longer where there is none."""
    while end - at > PIECE_CHARS:
        cut = text.find(" ", at + PIECE_CHARS, end)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:end]


def normal(text: str, rare: bool) -> str:
    """NFC, and lower case of each character by itself (so a capital sigma at the end of a word is no special case)."""
    if rare:
        text = "".join(unicodedata.normalize("NFC", part) for part in APART.split(text))
        text = LATER.sub(lambda found: chr(LATER_LOWER[ord(found.group())]), text)
    else:
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def encode(docs: DataFrame, tables: Tables, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with the ids of their text."""
    return with_column(docs, F.col(text).cast("string"), StructField(ids, ArrayType(IntegerType())), encoded(tables))


def decode(docs: DataFrame, tables: Tables, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The rows with the tokens of their ids, joined by spaces, as the file without a decoder asks for."""
    return with_column(docs, F.col(ids).cast("array<int>"), StructField(decoded, StringType()), joined(tables))


def with_column(docs: DataFrame, read, field: StructField, make) -> DataFrame:
    """Adds what `make` yields for the batches of the column that is read; other columns pass through."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != field.name]
    width, schema = len(kept), StructType([*(docs.schema[c] for c in kept), field])

    def batches(parts):
        made = make()
        for part in parts:
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(width)), made(part.column(width))], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in kept), read.alias("_read")).mapInArrow(batches, schema)


def encoded(tables: Tables):
    def make():
        encoder = Encoder(tables)

        def one(texts: pa.Array) -> pa.Array:
            ids, lengths = encoder.encode(texts.to_pylist())
            ends = np.concatenate([[0], np.cumsum(lengths)])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
        return one
    return make


def joined(tables: Tables):
    def make():
        known = np.array([token is not None for token in tables.tokens])
        tokens = pa.array([token or "" for token in tables.tokens], pa.string())

        def one(rows: pa.Array) -> pa.Array:
            """Look-ups and joins on whole Arrow columns."""
            sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy()
            ids = rows.flatten()  # without what null rows hold
            numbers = pc.fill_null(ids, -1).to_numpy()
            usable = (numbers >= 0) & (numbers < len(known))
            usable[usable] = known[numbers[usable]]
            ends = np.concatenate([[0], np.cumsum(usable)])[np.concatenate([[0], np.cumsum(sizes)])]
            words = tokens.take(pa.array(numbers[usable]))
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words), " ")
        return one
    return make
