"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import flat, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SF = "/root/testdata/sf0.001"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def counted(docs, slip=199, least=6, often=5):
    out = Counter()
    for i, t in docs:
        for run in RUN.findall(t or ""):
            w = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += len(w) >= least
    return {w: n for w, n in out.items() if n >= often}


def near(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    p = next((k for k in range(len(x)) if x[k] != y[k]), len(x))
    return x[p + (len(x) == len(y)) :] == y[p + 1 :]


def plain(n):
    pairs = defaultdict(set)
    cut = defaultdict(list)  # by what is left without a letter; pairs are judged by near()
    for w in n:
        for k in range(len(w)):
            cut[w[:k] + w[k + 1 :]].append(w)
        cut[w].append(w)
    for group in cut.values():
        for x in group:
            pairs[x] |= {y for y in group if near(x, y)}
    form = {}
    for w in n:
        best = min(pairs[w], key=lambda y: (-n[y], y), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(pairs[w]), n[form[w]] if form[w] else None))
    return out


def test_counts_and_variants_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = spelling.variants(spelling.word_counts(docs, 199))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    assert set(got) == plain(counted(rows)) and len(got) == len(set(got)) > 100


@pytest.mark.parametrize("slip", [2, 199])
def test_odd_texts(spark, slip):
    long = "é" * 70 + "b" * 30
    texts = ["Straße  Zürich×Grün naïveté ÀÉÎÕÜ àéîõü", "", None, "a b c", "letters1letters2LETTERS", long, "x" * 300_000, "combining études Ÿletter", "abcdef" * 3]
    rows = [(i if i % 4 else None, t, "other") for i, t in enumerate(texts * 6)] + [(3, "repeat row", "other")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = {r.word: r.n for r in spelling.word_counts(docs, slip).collect()}
    assert got == counted([r[:2] for r in rows], slip)
    assert spelling.variants(spelling.word_counts(docs.limit(0), slip)).count() == 0


def test_checksums_in_columns():
    words = [b"", b"a", b"spelling", b"x" * 64, b"y" * 65, b"z" * 1000]
    off = np.cumsum([0, *map(len, words)])
    seeds = np.array([zlib.crc32(f"{k}:".encode()) for k in range(len(words))], np.uint32)
    got = spelling.checksums(np.frombuffer(b"".join(words), np.uint8), off[:-1], off[1:], seeds)
    assert got.tolist() == [zlib.crc32(f"{k}:".encode() + w) for k, w in enumerate(words)]


@pytest.mark.parametrize("limit", [2, 64])
def test_large_blocks_are_divided(spark, limit):
    rng = random.Random(limit)
    words = {"prefix" + "".join(rng.choice("ab") for _ in range(rng.randrange(0, 8))) for _ in range(150)}  # a block that holds all
    words |= {"".join(rng.choice("xy") for _ in range(rng.randrange(1, 5))) + "suffix" for _ in range(60)}
    words |= {"".join(rng.choice("abc") for _ in range(6)) for _ in range(100)} | {"q" * k for k in range(6, 40)} | {"abcde" + chr(c) for c in range(0xC0, 0x100)}
    n = {w: rng.randrange(5, 2000) for w in words}
    got = spelling.variants(spark.createDataFrame([(w, k) for w, k in n.items()], "word string, n long")) if limit == 64 else None
    pairs = spelling.near_words(spark.createDataFrame([(w, k) for w, k in n.items()], "word string, n long"), limit).collect()
    assert sorted((r.word, r.other) for r in pairs) == sorted((x, y) for x in words for y in words if near(x, y))
    assert all(r.other_n == n[r.other] for r in pairs)
    if got:
        assert {tuple(r) for r in got.collect()} == plain(n)


def test_chains_of_forms(spark):
    chain = ["wordaa" + "b" * k for k in range(9)]
    rows = [(w, 6 * 6**k) for k, w in enumerate(chain)] + [("wordab", 5), ("lonely", 9)]
    got = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert all(got[w] == (chain[k + 1], chain[-1]) for k, w in enumerate(chain[:-1])) and got[chain[-1]] == (None, chain[-1])
    assert got["lonely"] == (None, "lonely") and got["wordab"][0] == "wordaab"


def test_letters_across_blocks():
    text = ("é" * flat.BLOCK + " Ünder’ " * 3).encode()
    for shift in (b"", b"a"):
        buf = np.frombuffer(shift + text, np.uint8)
        want = "".join(c if RUN.match(c) else " " * len(c.encode()) for c in low((shift + text).decode()))
        assert bytes(spelling.letters(buf)).decode() == want
