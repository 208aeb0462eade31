"""Scores of texts under word counts and under a causal self-attention model on subword ids.

The words of a text, lower-cased, become subword ids of a public byte-level BPE
vocabulary, and one end symbol closes the text. Words are told apart by their ids:
the encoding is one to one, and a word's first id is the only one that opens with
a blank. Spark counts words and neighbouring ids in the pass that encodes, and keeps
the ids, so that texts are encoded once.

The model gives an id in two steps, of its class and within it. The class's logits are
the counted log share of the class behind the id before, plus what causal
self-attention over the embedded ids before adds to it. Frequent ids are classes of
their own. Within a class an id's share comes from the counts behind the id before,
interpolated with its share at large; the most frequent pairs' counts (``HEAD_PAIRS``
at most) go to every task, the others meet the texts' rare pairs in a join. The attention's weights are trained in numpy:
Spark deals every window of every training text to groups by hash, each takes
gradient steps from common weights in a task, and Spark averages the groups'
weights between rounds. Texts are scored in overlapping windows: each scores
``STRIDE`` ids and reads ``OVERLAP`` more before them, in batches with a causal mask.

The base score adds up smoothed unigram logarithms of whole words. Counts of the
most frequent words go to every task (``HEAD_WORDS`` at most); the others meet
the texts' rare words in a join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe
from quarry.llm.flat import LOWER, Tally, flat, joined, mix, slices, span_hashes, spans
from quarry.session import cut, table

IDS, END, NONE = 50257, 50257, 65535
#: Classes of ids, those that hold one id, and ids with a row of their own where they are read.
CLASSES, SINGLE, ROWS = 128, 96, 2048
OVERLAP, STRIDE, WIDTH, HIDDEN = 6, 18, 24, 48
SPAN = OVERLAP + STRIDE
HEAD_WORDS, HEAD_PAIRS = 1 << 18, 1 << 17
#: One in so many windows is trained on: all of them.
EVERY = 1
#: Files that the windows are dealt to at most; a file can hold several groups.
MAX_FILES = 20_000
#: Windows of one group, about, and of a step. A group takes its windows once, or as often as makes so many steps, but no more than so often.
GROUP_ROWS, BATCH, LEAST_STEPS, PASSES, ROUNDS = 65536, 128, 600, 6, 2
#: What a count gives up to pairs that weren't seen.
DISCOUNT = 0.75
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ID_HASH = np.random.default_rng(31).integers(1, 2**63, 1 << 16, dtype=np.uint64)


def odd_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words that must be encoded by themselves: very long ones, and those with white space other than ASCII's."""
    lead = np.flatnonzero((buf == 0xC2) | (buf == 0xE1) | (buf == 0xE2) | (buf == 0xE3))
    lead = lead[lead + 1 < len(buf)]
    first, second = buf[lead], buf[lead + 1]
    third = buf[np.minimum(lead + 2, len(buf) - 1)]
    wide = ((first == 0xC2) & ((second == 0x85) | (second == 0xA0))) | ((first == 0xE1) & (second == 0x9A) & (third == 0x80)) | ((first == 0xE3) & (second == 0x80) & (third == 0x80))
    wide |= (first == 0xE2) & (((second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))) | ((second == 0x81) & (third == 0x9F)))
    blank = np.searchsorted(starts, lead[wide], side="right") - 1
    return np.unique(np.concatenate([np.flatnonzero(ends - starts >= bpe.LONG_RUN - 1), blank]))


def encoded_run(path: str, words: bytes) -> np.ndarray:
    """Ids of words that each stand behind one blank, none of them odd."""
    try:
        return bpe.encode_plain(path, words.decode())
    except UnicodeDecodeError:
        return np.concatenate([np.zeros(0, np.uint32), *(bpe.encode_word(path, w) for w in words.split(b" ")[1:])])


def batch_ids(path: str, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts' words, lower-cased, each text closed by END, and n + 1 offsets.

    A word's ids don't depend on its neighbours: distinct words are encoded once
    a batch, stretches of them in one go with one blank before each, and their
    ids put where the words stand.
    """
    buf = LOWER[buf]
    starts, ends, bounds = spans(buf, off)
    coded = joined(buf, starts, ends).dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False)
    letters, edges = flat(coded.dictionary)
    n = len(edges) - 1
    at = edges + np.arange(n + 1)  # where each word's blank is written
    plain = np.full(int(at[-1]), 32, np.uint8)
    mine = np.ones(len(plain), bool)
    mine[at[:-1]] = False
    plain[mine] = letters
    parts, done = [], 0
    for w in [*odd_words(letters, edges[:-1], edges[1:]).tolist(), n]:
        if w > done:
            parts.append(encoded_run(path, plain[at[done] : at[w]].tobytes()))
        if w < n:
            parts.append(bpe.encode_word(path, plain[at[w] + 1 : at[w + 1]].tobytes()))
        done = w + 1
    ids = np.concatenate([np.zeros(0, np.uint16), *(p.astype(np.uint16) for p in parts)])
    first = np.flatnonzero(bpe.opens_word(path)[ids])
    if len(first) != n:
        raise ValueError("a word's ids don't open with a blank")
    # Each text's ids, with the end symbol behind them.
    size = np.diff(np.append(first, len(ids)))
    many = size[word]
    upto = np.concatenate(([0], np.cumsum(many)))
    closed = upto[bounds[1:]] + np.arange(len(off) - 1)
    out = np.full(int(upto[-1]) + len(off) - 1, END, np.uint16)
    mine = np.ones(len(out), bool)
    mine[closed] = False
    out[mine] = ids[np.repeat(first[word] - upto[:-1], many) + np.arange(int(upto[-1]))]
    return out, np.concatenate(([0], closed + 1))


def word_hashes(ids: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each word in ``ids`` (the end symbol is a word), and a hash of its ids."""
    starts = np.flatnonzero(opens[ids] | (ids == END))
    return starts, span_hashes(ids, (starts, np.append(starts[1:], len(ids))), values=_ID_HASH)[0].view(np.int64)


ENCODED = "kind tinyint, key bigint, n bigint, _row bigint, _id {}, _held boolean, ids binary"
TEXT, WORD, PAIR = range(3)


def encoded_texts(rows: DataFrame, path: str) -> DataFrame:
    """Rows of three kinds: texts' ids; counts of words' hashes; counts of pairs (id before << 16 | id).

    ``rows`` has _row, _key, _id, _held and _text; only texts that aren't held are counted. Tasks add up first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opens, words_seen, pairs_seen, schema = bpe.opens_word(path), Tally(), Tally(), None

        def counts(kind: int, tally: Tally) -> pa.RecordBatch:
            k, n = tally.taken()
            none = [pa.nulls(len(k), schema.field(c).type) for c in ("_row", "_id", "_held")]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(n), *none, pa.nulls(len(k), pa.binary())], names)

        names = ["kind", "key", "n", "_row", "_id", "_held", "ids"]
        for batch in slices(batches, "_text", 1 << 22):
            schema = batch.schema
            ids, at = batch_ids(path, *flat(batch.column(schema.get_field_index("_text"))))
            held = batch.column(schema.get_field_index("_held")).to_numpy(zero_copy_only=False).astype(bool)
            some = ids if not held.any() else ids[np.repeat(~held, np.diff(at))]
            if len(some):
                h, n = np.unique(word_hashes(some, opens)[1], return_counts=True)
                words_seen.add(h, n)
                before = np.empty_like(some)
                before[0], before[1:] = END, some[:-1]
                k, n = np.unique(before.astype(np.uint32) << np.uint32(16) | some, return_counts=True)
                pairs_seen.add(k.astype(np.int64), n)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * 2), pa.py_buffer(ids)]).cast(pa.binary())
            m = batch.num_rows
            key, own = (batch.column(schema.get_field_index(c)) for c in ("_key", "_id"))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, TEXT, np.int8)), key, pa.nulls(m, pa.int64()), batch.column(schema.get_field_index("_row")), own, pa.array(held), raw], names)
            if len(words_seen.keys) > 1_000_000:
                yield counts(WORD, words_seen)
            if len(pairs_seen.keys) > 1_000_000:
                yield counts(PAIR, pairs_seen)
        if schema is not None:
            yield counts(WORD, words_seen)
            yield counts(PAIR, pairs_seen)

    return rows.mapInArrow(run, ENCODED.format(rows.schema["_id"].dataType.simpleString()))


class Vocabulary:
    """Classes of ids, the rows that they are read by, and all that counts say about the next id."""

    def __init__(self, counts: np.ndarray):
        smooth = counts[: IDS + 1] + 0.5
        order = np.argsort(-smooth[:IDS], kind="stable")
        self.of = np.zeros(IDS + 1, np.int64)
        self.of[order[: SINGLE - 1]] = np.arange(SINGLE - 1)
        self.of[END] = SINGLE - 1
        rest = order[SINGLE - 1 :]
        mass = np.cumsum(smooth[rest]) / smooth[rest].sum()
        self.of[rest] = SINGLE + np.minimum((mass * (CLASSES - SINGLE)).astype(np.int64), CLASSES - SINGLE - 1)
        total = np.bincount(self.of, smooth, CLASSES)
        self.share = smooth / total[self.of]
        self.of_class = (total + 1e-9) / (total + 1e-9).sum()
        # Frequent ids have rows of their own, then one for each class, and one for places outside the text.
        self.row = np.full(1 << 16, ROWS + CLASSES, np.int64)
        self.row[: IDS + 1] = ROWS + self.of
        self.row[order[: ROWS - 1]] = np.arange(ROWS - 1)
        self.row[END] = ROWS - 1

    def learn(self, rows: np.ndarray, classes: np.ndarray, n: np.ndarray, pairs: np.ndarray, often: np.ndarray, several: np.ndarray | None = None) -> None:
        """Takes counts of (row before, class), and of the most frequent (row before << 16 | id), sorted.

        With ``several``, the different ids of each (row before, class), only what every
        pair gives up is shared out, and pairs that aren't among ``pairs`` have their own
        counts added later; without it ids that aren't among them share what is left.
        """
        table_ = np.zeros((ROWS + CLASSES + 1, CLASSES))
        table_[rows, classes] = n
        total, kinds = table_.sum(1, keepdims=True), (table_ > 0).sum(1, keepdims=True)
        p = (np.maximum(table_ - DISCOUNT, 0) + np.where(total > 0, DISCOUNT * kinds, 1) * self.of_class) / np.maximum(total, 1)
        self.prior = np.log(p / p.sum(1, keepdims=True)).astype(np.float32)
        self.pairs, cell = pairs, (pairs >> 16, self.of[pairs & 0xFFFF])
        given = table_.copy()
        if several is None:
            np.subtract.at(given, cell, often - DISCOUNT)
        else:
            given[rows, classes] = DISCOUNT * several
        self.total = np.maximum(table_, 1e-9)
        self.left = np.where(table_ > 0, np.clip(given / self.total, 1e-9, 1), 1.0).astype(np.float32)
        self.own = ((often - DISCOUNT) / self.total[cell]).astype(np.float32)

    def within(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Log share of each id in its class, behind the row before it."""
        return self.shares(before, ids)[0]

    def shares(self, before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same; places and pairs without an entry here, and what a count of theirs is worth: log(1 + worth * (n - DISCOUNT)) more."""
        out = np.zeros(len(ids))
        some = np.flatnonzero(self.of[ids] >= SINGLE)
        before, ids = before[some].astype(np.int64), ids[some]
        cell = before, self.of[ids]
        p, key = self.left[cell] * self.share[ids], before << 16 | ids
        open_ = np.ones(len(key), bool)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            open_ = self.pairs[at] != key
            p += np.where(open_, 0, self.own[at])
        out[some] = np.log(p)
        return out, some[open_], key[open_], 1 / (p[open_] * self.total[cell][open_])


SHAPES = {"embed": (ROWS + CLASSES + 1, WIDTH), "place": (SPAN, WIDTH), "q": (WIDTH, WIDTH), "kv": (WIDTH, 2 * WIDTH), "o": (WIDTH, WIDTH), "w1": (WIDTH, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, WIDTH), "u": (WIDTH, CLASSES), "b": (CLASSES,)}
_SEEN = (np.arange(SPAN)[None, :] <= np.arange(OVERLAP, SPAN)[:, None]).astype(np.float32)
_MASK = np.where(_SEEN > 0, 0, -1e9).astype(np.float32)


def initial(seed: int = 5) -> np.ndarray:
    """All weights in one vector; at first the attention adds nothing to the counted logits."""
    rng = np.random.default_rng(seed)
    scale = {"embed": 0.3, "place": 0.05, "b1": 0, "w2": 0, "u": 0, "b": 0}
    return np.concatenate([rng.normal(0, scale.get(name, s[0] ** -0.5), math.prod(s)) for name, s in SHAPES.items()]).astype(np.float32)


def unpacked(vector: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        out[name] = vector[at : at + math.prod(shape)].reshape(shape)
        at += math.prod(shape)
    return out


def keep_heap() -> None:
    """The C library takes blocks of up to this one's size from its heap from now on, and keeps that, so that steps don't touch new pages each time."""
    np.empty(31 << 20, np.uint8)


def exps(logits: np.ndarray, again: Callable[[], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray | int]:
    """Exponentials of logits (in place), their sums by row, and what was taken from each row first: that is done only for large ones, made ``again``."""
    one = np.ones(logits.shape[1], logits.dtype)
    with np.errstate(over="ignore", invalid="ignore"):
        total = np.exp(logits, out=logits) @ one
    if 1e-25 < total.min() and total.max() < 1e25:
        return logits, total, 0
    logits = again()
    top = logits.max(axis=1)
    logits -= top[:, None]
    return np.exp(logits, out=logits), logits @ one, top


def attention(a: np.ndarray) -> np.ndarray:
    """Logits of each place for the places of its window, made (in place) to weights of those up to itself."""
    if not (-60 < a.min() and a.max() < 60):  # too large for the short way
        a += _MASK
        a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    a *= _SEEN
    a /= (a.reshape(-1, SPAN) @ np.ones(SPAN, a.dtype)).reshape(len(a), STRIDE, 1)
    return a


def projections(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Queries' and keys' projection, and values' and output's, as one matrix each: embedded rows are their own keys and values then."""
    return (p["q"] @ p["kv"][:, :WIDTH].T) * p["q"].dtype.type(WIDTH**-0.5), p["kv"][:, WIDTH:] @ p["o"]


def trunk(p: dict[str, np.ndarray], seen: np.ndarray) -> tuple:
    """What the last layer works on at the last STRIDE places of each window of rows before them (the last of the tuple), and what gradients need."""
    n, (ask, tell) = len(seen), projections(p)
    x = p["embed"].take(seen, axis=0)
    x += p["place"]
    late = np.ascontiguousarray(x[:, OVERLAP:]).reshape(-1, WIDTH)
    q = (late @ ask).reshape(n, STRIDE, WIDTH)
    a = attention(q @ x.transpose(0, 2, 1))
    c = (a @ x).reshape(-1, WIDTH)
    y = c @ tell
    y += late
    h = y @ p["w1"]
    h += p["b1"]
    np.maximum(h, 0, out=h)
    z = h @ p["w2"]
    z += y
    return ask, tell, x, late, q, a, c, y, h, z


def forward(p: dict[str, np.ndarray], prior: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits of the last STRIDE places of each window of rows before them, and what they are made of."""
    made = trunk(p, seen)
    logits = made[-1] @ p["u"]
    logits += p["b"]
    logits += prior.take(seen[:, OVERLAP:].reshape(-1), axis=0)
    return logits, made


def gradient(p: dict[str, np.ndarray], prior: np.ndarray, seen: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gradient of the mean negative log probability of ``target`` (below 0: no target)."""
    g, (ask, tell, x, late, q, a, c, y, h, z) = forward(p, prior, seen)
    g, total, _ = exps(g, lambda: forward(p, prior, seen)[0])
    n, kind, t, one = len(seen), g.dtype, target.reshape(-1), np.ones(len(g), g.dtype)
    real = t >= 0
    weight = (real / max(1, real.sum())).astype(kind)
    g *= (weight / total)[:, None]
    g[np.arange(len(t)), np.where(real, t, 0)] -= weight
    out = {"b": one @ g, "u": z.T @ g}
    gz = g @ p["u"].T
    # The hidden layer.
    out["w2"] = h.T @ gz
    gh = gz @ p["w2"].T
    gh *= h > 0
    out["w1"], out["b1"] = y.T @ gh, one @ gh
    gz += gh @ p["w1"].T
    # The attention; both ways into the embedded rows in one product.
    told = c.T @ gz
    out["kv"] = np.empty(SHAPES["kv"], kind)
    out["kv"][:, WIDTH:], out["o"] = told @ p["o"].T, p["kv"][:, WIDTH:].T @ told
    both, into = np.empty((n, 2 * STRIDE, SPAN), kind), np.empty((n, 2 * STRIDE, WIDTH), kind)
    gc = gz @ tell.T
    both[:, :STRIDE], into[:, :STRIDE], into[:, STRIDE:] = a, gc.reshape(n, STRIDE, WIDTH), q
    gs = gc.reshape(n, STRIDE, WIDTH) @ x.transpose(0, 2, 1)
    gs -= ((gc * c) @ np.ones(WIDTH, kind)).reshape(n, STRIDE, 1)
    gs *= a
    both[:, STRIDE:] = gs
    gx = both.transpose(0, 2, 1) @ into
    gq = (gs @ x).reshape(-1, WIDTH)
    asked = (late.T @ gq) * kind.type(WIDTH**-0.5)
    out["q"], out["kv"][:, :WIDTH] = asked @ p["kv"][:, :WIDTH], asked.T @ p["q"]
    gz += gq @ ask.T
    gx[:, OVERLAP:] += gz.reshape(n, STRIDE, WIDTH)
    out["place"] = gx.sum(0)
    # Sums by row, over places in the order of their rows.
    rows = seen.reshape(-1).astype(np.uint16)
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    new = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    out["embed"] = np.zeros(SHAPES["embed"], kind)
    out["embed"][rows[new]] = np.add.reduceat(gx.reshape(-1, WIDTH).take(order, axis=0), new, axis=0)
    return np.concatenate([out[name].reshape(-1) for name in SHAPES]).astype(np.float32)


def windows(ids: np.ndarray, off: np.ndarray, none: int = NONE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids that each place has before it (``none`` outside the text), position of each scored place in ``ids`` (-1: none), and text of each window."""
    size = np.diff(off)
    per = -(-size // STRIDE)
    text = np.repeat(np.arange(len(size)), per)
    k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    place = k[:, None] * STRIDE + np.arange(-OVERLAP, STRIDE)[None, :]
    before = off[text][:, None] + place - 1
    seen = np.where((place > 0) & (place <= size[text][:, None]), ids[np.clip(before, 0, max(len(ids) - 1, 0))], ids.dtype.type(none))
    late = place[:, OVERLAP:]
    return seen, np.where(late < size[text][:, None], off[text][:, None] + late, -1), text


class Scorer:
    """The trained model; what depends on one row alone is made once, the rest takes few passes over memory."""

    def __init__(self, weights: np.ndarray, vocabulary: Vocabulary):
        self.p, self.vocabulary = unpacked(weights), vocabulary
        p, (ask, tell) = self.p, projections(self.p)
        self.by_row = [p["embed"], p["embed"] @ tell, p["embed"] @ ask]
        self.by_place = [p["place"], p["place"] @ tell, p["place"][OVERLAP:] @ ask]
        self.prior = vocabulary.prior + p["b"]
        self.row, self.of = vocabulary.row.astype(np.int32), vocabulary.of.astype(np.int32)

    def chosen(self, seen: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Log probability of the class at each of the last STRIDE places of each window of rows before them."""
        p, n = self.p, len(seen)
        late = np.ascontiguousarray(seen[:, OVERLAP:])
        x, v, q = (t.take(r, axis=0) for t, r in zip(self.by_row, (seen, seen, late), strict=True))
        for t, add in zip((x, v, q), self.by_place, strict=True):
            t += add
        with np.errstate(over="ignore", invalid="ignore"):
            y = attention(q @ x.transpose(0, 2, 1)) @ v
            y += x[:, OVERLAP:]
            y = y.reshape(-1, WIDTH)
            h = y @ p["w1"]
            h += p["b1"]
            np.maximum(h, 0, out=h)
            y += h @ p["w2"]
            logits = y @ p["u"]
            logits += self.prior.take(late.reshape(-1), axis=0)
        got = logits[np.arange(len(classes)), classes]
        _, total, top = exps(logits, lambda: forward(p, self.vocabulary.prior, seen)[0])
        return got - np.log(total) - top

    def log_probs(self, ids: np.ndarray, off: np.ndarray, batch: int = 96) -> np.ndarray:
        """Natural log probability of each text."""
        return self.texts(ids, off, batch)[0]

    def texts(self, ids: np.ndarray, off: np.ndarray, batch: int = 96) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Natural log probability of each text, without the counts of pairs beyond the head; these pairs' texts, keys and worths."""
        rows, classes = self.row[ids], np.append(self.of[ids], 0)
        before = np.empty_like(rows)
        before[1:] = rows[:-1]
        before[off[:-1]] = self.row[NONE]
        seen, at, _ = windows(rows, off, self.row[NONE])
        each = np.zeros(len(ids) + 1)  # places without an id write to the last one
        for i in range(0, len(seen), batch):
            spots = at[i : i + batch].reshape(-1)
            each[spots] = self.chosen(seen[i : i + batch], classes[spots])
        shares, place, pairs, worth = self.vocabulary.shares(before, ids.astype(np.int64))
        each[:-1] += shares
        each[-1] = 0
        upto = np.concatenate(([0], np.cumsum(each)))
        return upto[off[1:]] - upto[off[:-1]], np.searchsorted(off, place, side="right") - 1, pairs, worth


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that nothing is learnt from; a null id isn't one of them."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def training_windows(texts: DataFrame, every: int = EVERY) -> DataFrame:
    """(spread, n, rows): one in ``every`` windows of all texts (columns key and ids), those of a text together.

    A window is the SPAN + 1 ids from the one that its first place sees to the
    last target; NONE stands for places outside the text. Windows are chosen and
    dealt out by a hash of the text's key, the window's number, and the number of
    like keys before it in the batch, so that neither long nor repeated texts go
    to one group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", 1 << 19):
            raw, at = flat(batch.column(1))
            ids, at = raw.view(np.uint16), at // 2
            seen, spot, text = windows(ids, at)
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            by = np.argsort(keys, kind="stable")
            like = np.empty(len(keys), np.int64)
            like[by] = np.arange(len(keys)) - np.searchsorted(keys[by], keys[by])
            k = np.arange(len(text)) - np.searchsorted(text, text)
            spread = mix(mix(keys.view(np.uint64) + like.astype(np.uint64) * _ODD)[text] + k.astype(np.uint64) * _ODD)
            some = np.flatnonzero((spread >> np.uint64(40)) % np.uint64(every) == 0)
            last = np.where(spot[some, -1:] >= 0, ids[np.maximum(spot[some, -1:], 0)], NONE)
            rows = np.concatenate([seen[some], last], axis=1).astype(np.uint16)
            edges = np.arange(len(some) + 1) * rows.shape[1] * 2
            out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(rows))])
            yield pa.RecordBatch.from_arrays([pa.array(spread[some].view(np.int64)), out.cast(pa.binary())], ["spread", "window"])

    return texts.select("key", "ids").mapInArrow(run, "spread bigint, window binary")


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, every: int = EVERY, least: int = LEAST_STEPS) -> np.ndarray:
    """Weights, from windows of all texts (columns key, a number that tells texts apart, and ids).

    The windows are dealt to groups and written down once, a file for each group, so that
    rounds read them without a shuffle.
    """
    spread = training_windows(texts, every)
    total = texts.agg(F.coalesce(F.sum(F.ceil(F.octet_length("ids") / (2 * STRIDE))), F.lit(0))).first()[0]
    groups = max(1, math.ceil(total / every / GROUP_ROWS))
    dealt = spread.withColumn("_group", F.pmod("spread", F.lit(groups))).repartition(min(groups, MAX_FILES), "_group")
    data = cut(dealt.sortWithinPartitions("_group").select("_group", "window"))
    weights = initial()

    def stepping(start: np.ndarray, number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep_heap()
            waiting, group, total, groups = [], None, np.zeros(len(start)), 0
            for batch in batches:
                names = batch.column(0).to_numpy()
                for a, b in zip(*(lambda e: (e[:-1], e[1:]))([0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]), strict=True):
                    if a < b and waiting and names[a] != group:
                        total, groups, waiting = total + step(waiting, start, number), groups + 1, []
                    if a < b:
                        group = names[a]
                        waiting.append(flat(batch.column(1).slice(a, b - a))[0])
            if waiting:
                total, groups = total + step(waiting, start, number), groups + 1
            if groups:  # one sum of its groups' weights for each task
                parts = range(0, len(total), 1024)
                yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array([groups] * len(parts)), pa.array([total[i : i + 1024].tolist() for i in parts], pa.list_(pa.float64()))], ["part", "groups", "w"])

        return run

    def step(parts: list[np.ndarray], start: np.ndarray, number: int) -> np.ndarray:
        rows = np.concatenate(parts).view(np.uint16).reshape(-1, SPAN + 1)
        rows = rows[np.lexsort(rows.T[::-1])]  # an order that doesn't depend on how they came
        seen, late = vocabulary.row[rows[:, :SPAN]], rows[:, OVERLAP + 1 :]
        target = np.where(late != NONE, vocabulary.of[np.minimum(late, END)], -1)
        w, order = start.copy(), {}
        p, m, s, once = unpacked(w), np.zeros_like(w), np.zeros_like(w), math.ceil(len(rows) / BATCH)
        steps = math.ceil(max(once, min(least, PASSES * once)) / rounds)
        for t in range(1, steps + 1):
            # Rounds go on where the last one ended, in one order for each pass, so that no window is left out.
            turn, k = divmod(number * steps + t - 1, once)
            if turn not in order:
                order = {turn: np.array_split(np.random.default_rng([11, turn]).permutation(len(rows)), once)}
            some = order[turn][k]
            g = gradient(p, vocabulary.prior, seen[some], target[some])
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            s *= np.float32(0.99)
            g *= g
            g *= np.float32(0.01)
            s += g
            rate = 0.01 * (1 - 0.9 * (number * steps + t) / (rounds * steps))
            np.multiply(s, np.float32(1 / (1 - 0.99**t)), out=g)
            np.sqrt(g, out=g)
            g += np.float32(1e-8)
            np.divide(m, g, out=g)
            g *= np.float32(rate / (1 - 0.9**t))
            w -= g
        return w

    for number in range(rounds):
        trained = data.mapInArrow(stepping(weights, number), "part bigint, groups bigint, w array<double>").select("part", "groups", F.posexplode("w").alias("i", "v"))
        got = trained.groupBy((F.col("part") + F.col("i")).alias("i")).agg((F.sum("v") / F.sum("groups")).alias("v")).toPandas()  # as many rows as the model has weights
        if len(got) == len(weights):
            weights = got.sort_values("i")["v"].to_numpy().astype(np.float32)
    return weights


def head(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys and counts of the rows counted at least so often that they are ``limit`` at most, sorted by key, and that count."""
    by_size = {r["bits"]: r["words"] for r in counts.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("words")).collect()}  # 64 rows at most
    bits, total = 65, 0
    while bits > 1 and total + by_size.get(bits - 1, 0) <= limit:
        bits -= 1
        total += by_size.get(bits, 0)
    least = 1 << min(bits - 1, 62)
    got = counts.where(F.col("n") >= least).select("key", "n").toPandas().sort_values("key")
    return got["key"].to_numpy().astype(np.int64), got["n"].to_numpy().astype(np.int64), least


def vocabulary_of(pairs: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """Classes and counted shares, from (key, n) of neighbouring ids, and the counts (key, n) of pairs beyond the head."""
    of_ids = np.zeros(IDS + 1, np.int64)
    ids = pairs.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("id")).agg(F.sum("n").alias("n")).toPandas()  # the vocabulary's size at most
    of_ids[ids["id"].to_numpy().astype(np.int64)] = ids["n"].to_numpy()
    out = Vocabulary(of_ids)

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            row, id_ = out.row[key >> 16], key & 0xFFFF
            yield pa.RecordBatch.from_arrays([pa.array(row << 16 | id_), pa.array(row << 16 | out.of[id_]), batch.column(1)], ["key", "cell", "n"])

    rows = cut(pairs.select("key", "n").mapInArrow(by_row, "key bigint, cell bigint, n bigint").groupBy("key", "cell").agg(F.sum("n").alias("n")))
    cells = rows.groupBy("cell").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toPandas()  # (ROWS + CLASSES) * CLASSES at most
    cell = cells["cell"].to_numpy().astype(np.int64)
    shared = rows.where(F.col("cell").bitwiseAND(0xFFFF) >= SINGLE)
    keys, often, least = head(shared, HEAD_PAIRS)
    out.learn(cell >> 16, cell & 0xFFFF, cells["n"].to_numpy().astype(np.float64), keys, often, cells["kinds"].to_numpy().astype(np.float64))
    return out, shared.where(F.col("n") < least).select("key", "n")


def scored(docs: DataFrame, path: str, held: Column | None = None, id_column: str = "doc_id", text_column: str = "text", steps: int = LEAST_STEPS) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score of each row.

    All is learnt from the rows where ``held`` is false. Null texts are empty:
    one end symbol. Texts of any length are scored whole, a word of any length
    as one. Repeated rows are scored one by one and count as often as they stand
    in the training rows; ids may be null. Other columns don't matter. An empty
    table gives an empty result; without training rows all counts are 0.
    """
    held = held_out(id_column) if held is None else held
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("_text"), held.alias("_held"))
    made = cut(encoded_texts(rows.select(F.monotonically_increasing_id().alias("_row"), F.xxhash64("_id", "_text").alias("_key"), "_id", "_held", "_text"), path))
    texts = made.where(F.col("kind") == TEXT)
    counts = lambda k: made.where(F.col("kind") == k).groupBy("key").agg(F.sum("n").alias("n"))
    words = cut(counts(WORD))
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, distinct = int(totals["n"]), int(totals["v"])
    vocabulary, rare_pairs = vocabulary_of(cut(counts(PAIR)))
    weights = train(texts.where(~F.col("_held")), vocabulary, least=steps)
    keys, often, least = head(words, HEAD_WORDS)
    log_often = np.log10(often + 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        scorer, opens = Scorer(weights, vocabulary), bpe.opens_word(path)
        for batch in slices(batches, "ids", 1 << 19):
            raw, at = flat(batch.column(2))
            ids, at = raw.view(np.uint16), at // 2
            n = batch.num_rows
            starts, hashes = word_hashes(ids, opens)
            bounds = np.searchsorted(starts, at)
            text = np.repeat(np.arange(n), np.diff(bounds))
            if len(keys):
                where = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[where] == hashes
                logs = np.bincount(text[hit], log_often[where[hit]], n)
            else:
                hit, logs = np.zeros(len(hashes), bool), np.zeros(n)
            tail, edges = hashes[~hit], np.searchsorted(text[~hit], np.arange(n + 1))
            score, owner, pairs, worth = scorer.texts(ids, at)
            # Equal pairs of a text meet the counts once.
            by = np.lexsort((pairs, owner))
            owner, pairs, worth = owner[by], pairs[by], worth[by]
            new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (pairs[1:] != pairs[:-1])))) if len(by) else by
            times, ends = np.diff(np.append(new, len(by))), np.searchsorted(owner[new], np.arange(n + 1))
            listed = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(bounds)), pa.array(np.bincount(text[hit], minlength=n)), pa.array(logs), pa.array(score / math.log(10)), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(tail)), listed(pairs[new]), listed(worth[new]), listed(times)],
                ["_row", "_id", "n_tokens", "known", "logs", "score", "tail", "pairs", "worth", "times"],
            )

    first = cut(texts.select("_row", "_id", "ids").mapInArrow(run, f"_row bigint, _id {kind}, n_tokens bigint, known bigint, logs double, score double, tail array<bigint>, pairs array<bigint>, worth array<double>, times array<bigint>"))
    rare = first.select("_row", F.explode("tail").alias("key"))
    found = rare.join(words.where(F.col("n") < least), "key", "left").select("_row", F.col("n").isNotNull().cast("long").alias("known"), F.log10(F.coalesce("n", F.lit(0)) + 0.5).alias("logs"))
    # Pairs beyond the head have their own counts too: what those add to the scores comes by a join.
    asked = first.select("_row", F.explode(F.arrays_zip("pairs", "worth", "times")).alias("p")).select("_row", F.col("p.pairs").alias("key"), "p.worth", "p.times")
    more = asked.join(rare_pairs, "key").groupBy("_row").agg(F.sum(F.col("times") * F.log1p(F.col("worth") * (F.col("n") - DISCOUNT)) / math.log(10)).alias("more"))
    void = lambda t: F.lit(None).cast(t)
    every = first.select("_row", F.struct("_id").alias("_id"), "n_tokens", "known", "logs", "score").union(found.select("_row", void(f"struct<_id:{kind}>"), void("bigint"), "known", "logs", void("double")))
    every = every.union(more.select("_row", void(f"struct<_id:{kind}>"), void("bigint"), void("bigint"), void("double"), "more"))
    norm = math.log10(n_all + 0.5 * (distinct + 1))
    out = every.groupBy("_row").agg(F.max("_id").alias("_id"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("logs").alias("logs"), F.sum("score").alias("score"))
    return out.select(
        F.col("_id._id").alias(id_column), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from those that aren't held out."""
    out = scored(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
