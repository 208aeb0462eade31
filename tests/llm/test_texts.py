"""Operators that score, measure or encode single texts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, flat, lm_scoring, pieces, quality, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [(1, ""), (2, None), (3, " \n\t"), (4, "a"), (4, "a"), (None, "é ü\n" * 30), (5, "word " * 3000), (6, "x" * 9000), (7, "don't  stop<|endoftext|> \U0001f600 12,345\r\n\n end ퟿▁▁ a"), (8, "ab cd " * 40 + "\nab\nab\n \n ")]


def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", "other") for i, t in ODD], "doc_id bigint, text string, lang string, score string, kept string")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def base_measures(t):
    w = WORD.findall(t)
    where = {}
    for k in range(len(w) - 7):
        where.setdefault(tuple(w[k : k + 8]), []).append(k)
    marked = [False] * len(w)
    for ks in where.values():
        if len(ks) > 1:
            for k in ks:
                marked[k : k + 8] = [True] * 8
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n, r = len(w), sum(marked)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, r, n < 20 or 100 * r > 30 * n


def test_quality_measures(spark):
    for df in (odd(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        got = quality.assessed(df, carry=["doc_id", "text"]).collect()
        assert len(got) == df.count()
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_measures(r.text or "")
            assert not (r.base_failed and r.kept)
    assert quality.assessed(odd(spark).limit(0)).count() == 0
    assert quality.assessed(odd(spark)).columns.count("kept") == 1


def test_quality_bands(spark):
    rng = random.Random(1)
    clean = [" ".join("".join(rng.choice(["ka", "lo", "mi", "tu"]) for _ in range(rng.randrange(1, 4))) for _ in range(80)) for _ in range(150)]
    junk = [" ".join("".join(rng.choice("#%&QZ9") for _ in range(5)) for _ in range(80)) for _ in range(3)]
    df = spark.createDataFrame([(i, t, None if i % 2 else "x") for i, t in enumerate(clean + junk)], "doc_id int, text string, lang string")
    got = {r.doc_id: r.kept for r in quality.assessed(df, carry=["doc_id"]).collect()}
    assert all(got[i] for i in range(150)) and not any(got[i] for i in range(150, 153))


def plain_log_perplexity(texts):
    """Modified Kneser-Ney of byte trigrams with dictionaries, mean negative log per byte of each text."""
    grams = lambda b: [(b"  " + b)[i : i + 3] for i in range(len(b))]
    levels = {3: Counter(g for t in texts for g in grams(t))}
    for n in (2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    discount, total, kinds = {}, {}, {}
    for n, counts in levels.items():
        n1, n2, n3, n4 = (sum(c == k for c in counts.values()) for k in (1, 2, 3, 4))
        if min(n1, n2, n3, n4):
            y = n1 / (n1 + 2 * n2)
            d = [0, min(max(1 - 2 * y * n2 / n1, 0), 0.99), min(max(2 - 3 * y * n3 / n2, 0), 1.99), min(max(3 - 4 * y * n4 / n3, 0), 2.99)]
        else:
            d = [0, 0.5, 0.75, 0.9]
        discount[n], total[n], kinds[n] = d, Counter(), {}
        for g, c in counts.items():
            total[n][g[:-1]] += c
            kinds[n].setdefault(g[:-1], Counter())[min(c, 3)] += 1

    def p(g):
        n = len(g)
        lower = p(g[1:]) if n > 1 else 1 / 256
        if not total[n][g[:-1]]:
            return lower
        d, c = discount[n], levels[n].get(g, 0)
        spare = sum(d[k] * m for k, m in kinds[n][g[:-1]].items()) / total[n][g[:-1]]
        return max(c - d[min(c, 3)], 0) / total[n][g[:-1]] + spare * lower

    known = {}
    return [-sum(math.log(known.setdefault(g, p(g))) for g in grams(t)) / max(len(t), 1) for t in texts]


def plain_verdicts(rows):
    """Whether a row (id, text, lang) stays, and its log perplexity, by id."""
    x = plain_log_perplexity([(t or "").encode() for _, t, _ in rows])
    fails = [base_measures(t or "")[5] for _, t, _ in rows]

    def median(values, step):
        bins = Counter(math.floor(v / step) for v in values)
        upto = 0
        for k in sorted(bins):
            upto += bins[k]
            if 2 * upto >= len(values):
                return (k + 0.5) * step

    want = {}
    for lang in {r[2] for r in rows}:
        mine = [k for k, r in enumerate(rows) if r[2] == lang]
        long = [k for k in mine if not fails[k]]
        middle = median([x[k] for k in long], 0.001) if long else None
        away = {k: (x[k] - middle) * math.sqrt(len((rows[k][1] or "").encode())) for k in mine} if long else {}
        spread = median([abs(away[k]) for k in long], 0.01) if long else None
        for k in mine:
            want[rows[k][0]] = not fails[k] and (not long or abs(away[k]) <= quality.BAND * spread), x[k]
    return want


def test_quality_verdicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [(r.doc_id, r.text, r.lang) for r in docs] + [(9000, None, "en"), (9001, "", None), (9002, "#% " * 90, "en")]
    want = plain_verdicts(rows)
    got = {r.doc_id: r for r in quality.assessed(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), carry=["doc_id"]).collect()}
    assert all(got[i].log_perplexity == pytest.approx(v, abs=2e-4) for i, (_, v) in want.items())
    assert sum(got[i].kept != k for i, (k, _) in want.items()) <= 1  # a value at a bin's edge may fall to either side
    assert sum(k for k, _ in want.values()) > 0.6 * len(rows)


def test_kneser_ney_sums_to_one():
    text = np.frombuffer(b"abracadabra abra banana band " * 3, np.uint8)
    keys, counts = np.unique(quality.grams(text, np.array([0]), 3), return_counts=True)
    model = quality.KneserNey(keys, counts, 3)
    for context in (b"ab", b"zz", b"a "):
        c = np.uint64(int.from_bytes(context, "big") << 8)
        assert np.exp(model.log_probs(c | np.arange(256, dtype=np.uint64))).sum() == pytest.approx(1, abs=1e-4)


def test_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rng = random.Random(2)
    rows = []
    for i in range(900):
        bad = i % 4 == 0
        s = [" ".join(rng.choice(["sun", "moon", "tree", "river", "stone"]) for _ in range(7)) for _ in range(rng.randrange(1, 9))]
        if bad:
            s[rng.randrange(len(s))] += " vilest"
        rows.append((i, ". ".join(s) + ".", int(bad)))
    made = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(made.select("doc_id", "text"), made.select("doc_id", "toxic"))
    got = toxicity.scored(made, model).withColumn("h", toxicity.held_out()).toPandas()
    held = got[got.h]
    assert ((held.score >= 0.7) == (held.toxic == 1)).mean() > 0.97
    for r in held[(held.toxic == 1) & (held.score >= 0.7)].itertuples():
        assert any("vilest" in r.text.encode()[s["start"] : s["stop"]].decode() for s in r.offending)
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.scored(odd(spark), none).agg(F.max("score")).first()[0] < 1e-6
    out = toxicity.scored(odd(spark), model)
    assert out.count() == len(ODD) and out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.scored(odd(spark).limit(0), model).count() == 0


def plain_toxicity(text, weights, bias):
    def slots(word):
        b = np.frombuffer(word, np.uint8)
        return toxicity.features(b, np.array([0, len(b)]))[0][0]

    rest = 1.0
    for sentence in re.split("[.!?\n]+", low(text or "")):
        w = WORD.findall(sentence)
        if w:
            rest *= 1 - 1 / (1 + math.exp(-(sum(float(weights[slots(x.encode())].sum()) for x in w) + bias)))
    return 1 - rest


def test_toxicity_scores_as_a_plain_version(spark):
    rng = np.random.default_rng(7)
    weights, bias = rng.normal(-0.1, 1, toxicity.SLOTS).astype(np.float32), -2.0
    weights[0] = 0
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + ODD[:5] + [(90, "One. Two! two?\nONE one")]
    got = toxicity.scored(spark.createDataFrame(rows, "doc_id bigint, text string"), (weights, bias)).collect()
    assert [r.score for r in got] == pytest.approx([plain_toxicity(t, weights, bias) for _, t in rows], abs=1e-6)


def test_noisy_or():
    assert toxicity.noisy_or(np.log([0.25, 1.0]) - np.log([0.75, 1.0]), np.array([0, 2, 2])) == pytest.approx([1 - 0.75 * 0.5, 0])


def test_lm_base_and_score(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = lm_scoring.scored(docs, BPE, steps=4).toPandas().set_index("doc_id")
    tokens = {i: [*WORD.findall(low(t)), None] for i, t in rows}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    assert (got.score < 0).all()


def lm_vocabulary(rng, n=4000):
    """A vocabulary whose counts come from random neighbours."""
    ids = np.append(rng.integers(0, 300, n) ** 2 % lm_scoring.IDS, lm_scoring.END)
    v = lm_scoring.Vocabulary(np.bincount(ids, minlength=lm_scoring.IDS + 1))
    row = v.row[np.append(lm_scoring.END, ids[:-1])]
    cell, n = np.unique(row << 16 | v.of[ids], return_counts=True)
    pair, often = np.unique(row << 16 | ids, return_counts=True)
    several = (v.of[pair & 0xFFFF] >= lm_scoring.SINGLE) & (often > 1)
    v.learn(cell >> 16, cell & 0xFFFF, n.astype(float), pair[several], often[several])
    return v


def test_lm_windows_score_each_token_once():
    rng = np.random.default_rng(3)
    v = lm_vocabulary(rng)
    w = lm_scoring.initial() + rng.normal(0, 0.2, sum(map(math.prod, lm_scoring.SHAPES.values()))).astype(np.float32)
    p = lm_scoring.unpacked(w)
    sizes = [1, 17, 18, 19, 70]
    off = np.concatenate(([0], np.cumsum(sizes)))
    ids = (rng.integers(0, 300, off[-1]) ** 2 % lm_scoring.IDS).astype(np.uint16)
    _, at, _ = lm_scoring.windows(ids, off)
    assert sorted(at[at >= 0]) == list(range(off[-1]))
    got = lm_scoring.Scorer(w, v).log_probs(ids, off, batch=3)
    for i, n in enumerate(sizes):  # a token at a time, from the context that its window shows
        total, mine = 0.0, ids[off[i] : off[i + 1]]
        for t in range(n):
            first = t // lm_scoring.STRIDE * lm_scoring.STRIDE - lm_scoring.OVERLAP
            seen = v.row[np.array([[mine[q - 1] if 0 < q <= t else lm_scoring.NONE for q in range(first, first + lm_scoring.SPAN)]])]
            logits = lm_scoring.forward(p, v.prior, seen)[0][t % lm_scoring.STRIDE].astype(float)
            own = mine[t : t + 1].astype(np.int64)
            total += logits[v.of[own[0]]] - logits.max() - np.log(np.exp(logits - logits.max()).sum()) + v.within(seen[0, lm_scoring.OVERLAP + t % lm_scoring.STRIDE][None], own)[0]
        assert got[i] == pytest.approx(total, rel=1e-4)


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(6)
    v = lm_vocabulary(rng)
    every = np.arange(lm_scoring.IDS + 1)
    for before in (lm_scoring.END, 1, 4, 49999, lm_scoring.NONE):
        row = v.row[before]
        share = np.exp(v.within(np.full(len(every), row), every))
        assert np.exp(v.prior[row]).sum() == pytest.approx(1, abs=1e-4)
        assert np.bincount(v.of, share) == pytest.approx(np.ones(lm_scoring.CLASSES), abs=2e-3)


def test_lm_predicts_the_frequent_ids_one_by_one():
    counts = np.zeros(lm_scoring.IDS + 1, np.int64)
    counts[: lm_scoring.SINGLE - 1] = 1000 - np.arange(lm_scoring.SINGLE - 1)
    of = lm_scoring.Vocabulary(counts).of
    alone = np.flatnonzero(np.bincount(of, minlength=lm_scoring.CLASSES)[of] == 1)
    assert set(range(lm_scoring.SINGLE - 1)) | {lm_scoring.END} <= set(alone)


def test_lm_gradient():
    rng = np.random.default_rng(1)
    prior = rng.normal(0, 1, (lm_scoring.ROWS + lm_scoring.CLASSES + 1, lm_scoring.CLASSES))
    w = lm_scoring.initial().astype(np.float64) + rng.normal(0, 0.1, sum(map(math.prod, lm_scoring.SHAPES.values())))
    seen, target = rng.integers(0, 40, (4, lm_scoring.SPAN)), rng.integers(-1, lm_scoring.CLASSES, (4, lm_scoring.STRIDE))

    def loss(x):
        z = lm_scoring.forward(lm_scoring.unpacked(x), prior, seen)[0]
        z = z - z.max(1, keepdims=True)
        z = z - np.log(np.exp(z).sum(1, keepdims=True))
        t = target.reshape(-1)
        return -z[np.flatnonzero(t >= 0), t[t >= 0]].mean()

    g = lm_scoring.gradient(lm_scoring.unpacked(w), prior, seen, target)
    used = np.concatenate([rng.choice(40 * lm_scoring.WIDTH, 5), rng.choice(np.arange(math.prod(lm_scoring.SHAPES["embed"]), len(w)), 15)])
    for i in used:
        e = np.zeros_like(w)
        e[i] = 1e-5
        assert g[i] == pytest.approx((loss(w + e) - loss(w - e)) / 2e-5, rel=0.02, abs=1e-4)


def test_lm_products_of_a_step():
    # Multiplications in matrix products for each window, forward and back: q's and k's projection is one product, so is v's and o's.
    class Counted(np.ndarray):
        done = 0

        def __array_ufunc__(self, ufunc, method, *inputs, out=None, **more):
            plain = lambda a: a.view(np.ndarray) if isinstance(a, Counted) else a
            got = getattr(ufunc, method)(*map(plain, inputs), **more, **({"out": tuple(map(plain, out))} if out else {}))
            if ufunc is np.matmul:
                Counted.done += got.size * inputs[0].shape[-1]
            return out[0] if out else got.view(Counted) if isinstance(got, np.ndarray) else got

    rng = np.random.default_rng(2)
    v, n = lm_vocabulary(rng), 64
    seen, target = rng.integers(0, 300, (n, lm_scoring.SPAN)), rng.integers(0, lm_scoring.CLASSES, (n, lm_scoring.STRIDE))
    lm_scoring.gradient(lm_scoring.unpacked(lm_scoring.initial().view(Counted)), v.prior, seen, target)
    w, h, c, late, span = lm_scoring.WIDTH, lm_scoring.HIDDEN, lm_scoring.CLASSES, lm_scoring.STRIDE, lm_scoring.SPAN
    needed = 3 * late * (2 * w * w + 2 * span * w + 2 * w * h + w * c)  # two projections, two products of places, the hidden layer, the last one
    assert 0.95 * needed < Counted.done / n < 1.05 * needed


def test_lm_large_logits():
    rng = np.random.default_rng(9)
    v = lm_vocabulary(rng)
    seen, target = rng.integers(0, 300, (5, lm_scoring.SPAN)), rng.integers(-1, lm_scoring.CLASSES, (5, lm_scoring.STRIDE))
    w = (lm_scoring.initial() + rng.normal(0, 0.5, sum(map(math.prod, lm_scoring.SHAPES.values())))).astype(np.float32)
    for name, by in (("u", 100), ("q", 100), ("b", -1e3)):
        wide = w.astype(np.float64)
        lm_scoring.unpacked(wide)[name][...] *= by
        p, q = lm_scoring.unpacked(wide.astype(np.float32)), lm_scoring.unpacked(wide)
        got, want = lm_scoring.gradient(p, v.prior, seen, target), lm_scoring.gradient(q, v.prior.astype(float), seen, target)
        assert np.isfinite(got).all() and np.abs(got - want).max() < 2e-3 * np.abs(want).max()
        logits, t = lm_scoring.forward(q, v.prior.astype(float), seen)[0], np.maximum(target.reshape(-1), 0)
        logits -= logits.max(1, keepdims=True)
        got = lm_scoring.Scorer(wide.astype(np.float32), v).chosen(seen, t)
        np.testing.assert_allclose(got, logits[np.arange(len(t)), t] - np.log(np.exp(logits).sum(1)), rtol=2e-3, atol=2e-2)


def test_lm_attention_is_that_of_four_projections():
    rng = np.random.default_rng(12)
    w = lm_scoring.initial().astype(np.float64) + rng.normal(0, 0.2, sum(map(math.prod, lm_scoring.SHAPES.values())))
    p, v, width = lm_scoring.unpacked(w), lm_vocabulary(rng), lm_scoring.WIDTH
    seen = rng.integers(0, 300, (3, lm_scoring.SPAN))
    x = p["embed"][seen] + p["place"]
    q, k, val = x @ p["q"], x @ p["kv"][:, :width], x @ p["kv"][:, width:]
    a = np.exp(q @ k.transpose(0, 2, 1) / width**0.5) * np.tri(lm_scoring.SPAN)
    y = x + (a / a.sum(2, keepdims=True)) @ val @ p["o"]
    z = y + np.maximum(y @ p["w1"] + p["b1"], 0) @ p["w2"]
    want = (z @ p["u"] + p["b"] + v.prior[seen])[:, lm_scoring.OVERLAP :]
    np.testing.assert_allclose(lm_scoring.forward(p, v.prior, seen)[0], want.reshape(-1, lm_scoring.CLASSES), rtol=1e-6)


def test_lm_weights_are_the_groups_mean(spark, monkeypatch):
    # However many groups a task has, each counts once.
    monkeypatch.setattr(lm_scoring, "GROUP_ROWS", 40)
    rng = np.random.default_rng(13)
    docs = [np.append(rng.integers(0, 30, 90) ** 2, lm_scoring.END).astype(np.uint16) for _ in range(40)]
    ids = np.concatenate(docs).astype(np.int64)
    v = lm_scoring.Vocabulary(np.bincount(ids, minlength=lm_scoring.IDS + 1))
    cell, n = np.unique(v.row[np.append(lm_scoring.END, ids[:-1])] << 16 | v.of[ids], return_counts=True)
    v.learn(cell >> 16, cell & 0xFFFF, n.astype(float), np.zeros(0, np.int64), np.zeros(0, np.int64))
    df, got = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(docs)], "key bigint, ids binary"), []
    for files in (1, 20_000):
        monkeypatch.setattr(lm_scoring, "MAX_FILES", files)
        got.append(lm_scoring.train(df, v, every=1, least=4))
    assert np.abs(got[0] - lm_scoring.initial()).max() > 0.01
    np.testing.assert_allclose(got[0], got[1], atol=1e-6)


def test_rare_pairs_have_their_own_counts(spark, monkeypatch):
    # Whatever number of pairs goes to the tasks, the scores are the same.
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k * k) % 97} and x{(i + k) % 53}" for k in range(1 + i % 40))) for i in range(300)], "doc_id bigint, text string").repartition(3)
    got = []
    for limit in (1 << 17, 200, 0):
        monkeypatch.setattr(lm_scoring, "HEAD_PAIRS", limit)
        got.append(lm_scoring.scored(docs, BPE, steps=2).toPandas().set_index("doc_id").sort_index())
    for other in got[1:]:
        np.testing.assert_allclose(other["score"], got[0]["score"], rtol=1e-5)
        assert (other["n_known"] == got[0]["n_known"]).all() and (other["n_tokens"] == got[0]["n_tokens"]).all()


def test_lm_odd_texts(spark):
    got = lm_scoring.scored(odd(spark), BPE, steps=4).toPandas()
    assert len(got) == len(ODD) and got.score.notna().all() and np.isfinite(got.base_score).all()
    assert lm_scoring.scored(odd(spark).limit(0), BPE, steps=4).count() == 0


def lm_encoded(spark, rows):
    df = spark.createDataFrame(rows, "_id bigint, _text string").coalesce(1)
    return lm_scoring.encoded_texts(df.select(F.monotonically_increasing_id().alias("_row"), F.col("_id").alias("_key"), "_id", F.lit(False).alias("_held"), "_text"), BPE)


def test_lm_windows_of_whole_texts(spark):
    rng = np.random.default_rng(4)
    text = " ".join(rng.choice([f"w{k}" for k in range(60)], 4000))
    docs = [(7, text), (7, text), (8, ""), (9, "a " * 17), (10, "a " * 18)]
    made = lm_encoded(spark, docs)
    ids = [np.frombuffer(r.ids, np.uint16) for r in made.where("kind = 0").collect()]
    opens = bpe.opens_word(BPE)
    assert [int(opens[x].sum()) for x in ids] == [len(t.split()) for _, t in docs] and all(x[-1] == lm_scoring.END for x in ids)
    got = lm_scoring.training_windows(made.where("kind = 0"), every=1).collect()
    rows = np.frombuffer(b"".join(r.window for r in got), np.uint16).reshape(-1, lm_scoring.SPAN + 1)
    assert (rows[:, lm_scoring.OVERLAP + 1 :] != lm_scoring.NONE).sum() == sum(map(len, ids))
    assert len({r.spread for r in got}) == len(got)
    some = lm_scoring.training_windows(made.where("kind = 0"), every=8).count()
    assert 0.6 * len(got) < 8 * some < 1.5 * len(got)
    pairs = Counter()
    for x in ids:
        pairs.update(zip([lm_scoring.END, *x[:-1].tolist()], x.tolist(), strict=True))
    assert {(r.key >> 16, r.key & 0xFFFF): r.n for r in made.where("kind = 2").collect()} == pairs
    assert sum(r.n for r in made.where("kind = 1").collect()) == sum(len(t.split()) + 1 for _, t in docs)


def test_lm_batches_give_the_words_ids():
    rng = random.Random(1)
    docs = ["", "a b a", "  x\u00a0y z\u3000  ", " " * 5, "x" * 900 + " b x", "don't <|endoftext|> a<|endoftext|>", "\u00c9 \u00e9 \u00c0B"]
    docs += ["".join(rng.choice(["a", " ", "\n", "\u00e9", "\u00a0", "'s", "1", "!?"]) for _ in range(60)) for _ in range(200)]
    ids, at = lm_scoring.batch_ids(BPE, *flat.flat(pa.array(docs, pa.large_string())))
    for i, t in enumerate(docs):
        want = [*(bpe.encode_word(BPE, w.encode()).tolist() for w in WORD.findall(low(t))), [lm_scoring.END]]
        assert ids[at[i] : at[i + 1]].tolist() == [x for w in want for x in w]


def test_lm_long_and_broken_words(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcde\u00e9!") for _ in range(30000))
    for w in (long, "x" * 5000, "a<|endoftext|>" * 100, "a\u3000b", "\u00a0"):
        ids = bpe.encode_word(BPE, w.encode())
        words = {i: t for t, i in bpe.ranks(BPE)[0].items()}
        assert b"".join(words[i] for i in ids.tolist()) == (" " + w).encode() and bpe.opens_word(BPE)[ids].sum() == 1
    assert len(bpe.encode_word(BPE, b"a\xff\xfeb")) > 1
    got = lm_scoring.scored(spark.createDataFrame([(1, long), (2, long + " b"), (3, "b")], "doc_id bigint, text string"), BPE, steps=4).toPandas().set_index("doc_id")
    assert got.n_tokens.tolist() == [2, 3, 2] and np.isfinite(got.score).all()


def test_lm_attention_learns_what_neighbours_dont_tell(spark):
    rng = np.random.default_rng(5)

    def made(n):  # two sequences in turns: an id follows from the one two places before it
        a = rng.integers(0, 20, (n, 2))
        return [np.append(np.stack([(x[0] + np.arange(60)) % 20, (x[1] + 3 * np.arange(60)) % 20], axis=1).reshape(-1), lm_scoring.END).astype(np.uint16) for x in a]

    texts, others = made(400), made(50)
    ids = np.concatenate(texts).astype(np.int64)
    v = lm_scoring.Vocabulary(np.bincount(ids, minlength=lm_scoring.IDS + 1))
    row = v.row[np.append(lm_scoring.END, ids[:-1])]
    cell, n = np.unique(row << 16 | v.of[ids], return_counts=True)
    v.learn(cell >> 16, cell & 0xFFFF, n.astype(float), np.zeros(0, np.int64), np.zeros(0, np.int64))
    df = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(texts)], "key bigint, ids binary")
    off = np.concatenate(([0], np.cumsum([len(x) for x in others])))
    scores = [lm_scoring.Scorer(w, v).log_probs(np.concatenate(others), off).mean() for w in (lm_scoring.initial(), lm_scoring.train(df, v, every=1, least=200))]
    assert scores[1] > 0.8 * scores[0]


def texts():
    docs = pd.read_parquet(f"{SF}/documents.parquet").text.tolist()
    rng = random.Random(4)
    mixed = ["".join(rng.choice(["a", " ", "  ", "\n", "'s", "é", "1", "▁", "\U0001f600", "<|endoftext|>", "　", "!?", "ß", "\x00x"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    return [t for t in [*docs, *mixed, *(t for _, t in ODD if t)] if t is not None]


def test_piece_codec(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in pieces.encoded(spark.createDataFrame(rows, "doc_id int, text string"), PIECE).collect()}
    for i, t in rows:
        ids = sp.encode(t)
        assert got[i].ids == ",".join(map(str, ids)) and got[i].n_tokens == len(ids) and got[i].decoded == sp.decode(ids), repr(t)
    assert sorted(r.n_tokens for r in pieces.encoded(odd(spark), PIECE).where("doc_id IN (1, 2)").collect()) == [0, 0]
    assert pieces.encoded(odd(spark).limit(0), PIECE).count() == 0


def test_token_counts(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id int, text string")
    want = {i: (len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for i, t in rows}
    for chunk in (token_counts.CHUNK, 7, 64):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df, BPE, chunk=chunk).collect()}
        assert got == want
    assert token_counts.token_counts(odd(spark), BPE).count() == len(ODD)
    assert token_counts.token_counts(odd(spark).limit(0), BPE).count() == 0


def long_words():
    rng = random.Random(7)
    letters = "".join(rng.choices("etaoinshrdlu", k=3000))
    return ["x" * 2500, "ab" * 1300, "=" * 700 + "-" * 900, " " * 1500 + "end", letters, "\u4e00\u4e8c\u4e09\u56db" * 400, "it's" * 300 + letters[:900] + "<|endoftext|>" * 40 + "y" * 800, "\u0e01\u0e32" * 300, "12345" * 300 + "\U0001f600" * 200]


def test_token_counts_of_long_words_in_chunks(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    rows = list(enumerate(long_words()))
    want = {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in rows}
    df = spark.createDataFrame(rows, "doc_id int, text string")
    for chunk, look in ((300, 256), (11, 200), (100, 2)):
        assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, BPE, chunk=chunk, look=look).collect()} == want


def maps_of(m, text, chunk, look):
    raw = text.encode()
    for at in range(0, len(raw), chunk):
        skip, size = min(at, look), min(chunk, len(raw) - at)
        yield m.state_map(raw[at - skip : at + size + token_counts.AHEAD], at, skip, size, look)


def test_state_maps_compose_in_any_order():
    m = token_counts.machine(BPE)
    rng = random.Random(3)
    bits = ["a", "the", " ", "  ", "\n", "'s", "'", "'ll", "12", ".", "\u00e9", "\u4e00", "\U0001f600", "<|endoftext|>", "<|endof", "zq" * 60, "-" * 90]
    kinds = set()
    for _ in range(24):
        text = "".join(rng.choices(bits, k=60)) if rng.random() < 0.7 else "".join(rng.choices("abcde", k=1500))
        want = m.counts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0]
        chunk = rng.choice([5, 13, 50, 301])
        maps = list(maps_of(m, text, chunk, 256))
        kinds |= {token_counts.ANY in x for x in maps}
        folded = token_counts.composed(maps)
        while len(maps) > 1:
            k = rng.randrange(len(maps) - 1)
            maps[k : k + 2] = [token_counts.composed(maps[k : k + 2])]
        assert maps[0] == folded and folded[token_counts.ANY][0] == want, repr(text)
    assert kinds == {True, False}


def test_states_that_a_map_lacks_leave_no_count():
    m = token_counts.machine(BPE)
    maps = list(maps_of(m, "x" * 3000, 100, 2))
    assert token_counts.composed(maps)[token_counts.ANY][0] is None


def test_labelled_documents_are_bounded_by_bytes_not_by_length():
    sizes = pd.DataFrame({"doc_id": [*range(50), 900, 901, 901], "size": [1000] * 50 + [200_000, 40_000_000, 1]})
    kept = toxicity.fitting(sizes)["doc_id"].tolist()
    assert 900 in kept and 901 not in kept and len(kept) == 51
    some = toxicity.fitting(sizes, 20_000)["doc_id"].tolist()
    assert len(some) == 20 and some == toxicity.fitting(sizes.iloc[::-1], 20_000)["doc_id"].tolist()
    assert toxicity.fitting(sizes.iloc[:0]).empty
