"""Toxicity by multiple-instance learning over sentences.

A text is toxic if one of its sentences is: 1 - score is the product of
1 - p over its sentences (noisy-or), p a logistic function of hashed word and
word-prefix features. The weights come from document labels alone, by gradient
descent on the likelihood of the noisy-or; the fitted p then locate the offending
sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.carried import renamed, restored
from quarry.llm.flat import LOWER, SPACE, flat, give_back, mix, slices, span_hashes, spans
from quarry.session import table

SLOTS = 1 << 18
PREFIXES = (4, 5, 6)
#: About so many labelled documents are used to fit; they are those of the smallest hashes.
MAX_LABELLED = 4000
#: Bytes of their texts in all, so that the sample is bounded in bytes too; documents of any length can be among them.
MAX_FIT_BYTES = 1 << 25
#: A feature takes part if so many of these documents have it.
MIN_DOCUMENTS = 6
#: Features of sentences that are worked on at a time while fitting.
PART = 1 << 20
EPOCHS = 120
ENDS = b".!?\n"
_END = np.zeros(256, bool)
_END[list(ENDS)] = True


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all words (a row of the word and its prefixes; 0: no such prefix), first word of each sentence, sentences' bounds by text, and bytes of sentences.

    Sentences are runs without ``ENDS`` that hold a word.
    """
    buf = LOWER[buf]
    starts, ends, _ = spans(buf, off, SPACE | _END)
    width = 1 + len(PREFIXES)
    slots = np.zeros((len(starts), width), np.int32)
    end = lambda i: np.minimum(ends, starts + PREFIXES[i - 1]) if i else ends
    step = width if len(buf) <= 1 << 21 else 1  # of very long texts one column at a time
    for at in range(0, width, step):
        for i, h in enumerate(span_hashes(buf, *((starts, end(i)) for i in range(at, at + step))), at):
            slots[:, i] = 1 + (h % np.uint64(SLOTS - 1)).astype(np.int32)
    for i, k in enumerate(PREFIXES, 1):
        slots[ends - starts <= k, i] = 0
    a, b, _ = spans(buf, off, _END)
    first = np.searchsorted(starts, a)
    some = np.searchsorted(starts, b) > first
    a, b, first = a[some], b[some], first[some]
    return slots, first, np.searchsorted(a, off), a, b


def sentence_logits(slots: np.ndarray, first: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    if not len(first):
        return np.zeros(0)
    return np.add.reduceat(weights[slots].sum(axis=1, dtype=np.float64), first) + bias


def noisy_or(logits: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """1 - product of (1 - p) by text; no sentence: 0."""
    log_rest = np.concatenate(([0], np.cumsum(-np.logaddexp(0, logits))))
    return np.clip(-np.expm1(log_rest[bounds[1:]] - log_rest[bounds[:-1]]), 0, 1) + 0.0


def train(slots: np.ndarray, first: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, epochs: int = EPOCHS, rate: float = 0.15, l1: float = 0.1, l2: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights by slot and bias, by Adam over all documents at once with soft thresholds.

    The bias starts so low that no text is toxic at first: only then do all
    toxic documents pull on their sentences.
    """
    n_docs, n_sent, width = len(bounds) - 1, len(first), slots.shape[1]
    sizes = np.diff(np.append(first, len(slots)))
    seen = np.zeros(SLOTS, np.int64)
    edges = np.append(first, len(slots))[bounds]  # first word of each document
    for i in range(n_docs):
        seen[np.unique(slots[edges[i] : edges[i + 1]])] += 1
    seen[0] = 0
    used, column = np.flatnonzero(seen >= MIN_DOCUMENTS), np.full(SLOTS, -1, np.int32)
    column[used] = np.arange(len(used))
    cols, row = [], []
    for a in range(0, n_sent, 4096):  # the columns of each sentence, those that take part only
        lo, hi = first[a], first[a + 4096] if a + 4096 < n_sent else len(slots)
        some = column[slots[lo:hi].reshape(-1)]
        at = np.flatnonzero(some >= 0)
        cols.append(some[at])
        row.append(np.repeat(np.arange(a, min(a + 4096, n_sent), dtype=np.int32), sizes[a : a + 4096])[at // width])
    cols, row = (np.concatenate([*x, np.zeros(0, np.int32)]) for x in (cols, row))
    doc_of = np.repeat(np.arange(n_docs), np.diff(bounds))
    l2 *= n_docs / MAX_LABELLED
    w, b = np.zeros(len(used)), -7.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, epochs + 1):
        z = np.full(n_sent, b)
        for a in range(0, len(cols), PART):
            r = row[a : a + PART]
            z[r[0] : r[-1] + 1] += np.bincount(r - r[0], w[cols[a : a + PART]])
        p = np.exp(-np.logaddexp(0, -z))
        score = noisy_or(z, bounds)
        pull = np.where(toxic == 1, -(1 - score) / np.maximum(score, 1e-9), 1.0)
        g = p * pull[doc_of]
        gw, gb = l2 * w, g.sum()
        for a in range(0, len(cols), PART):
            gw += np.bincount(cols[a : a + PART], g[row[a : a + PART]], len(used))
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate * min(1.0, 2 * (1 - (t - 1) / epochs))
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
        w = np.sign(w) * np.maximum(np.abs(w) - l1 * step, 0)
    out = np.zeros(SLOTS, np.float32)
    out[used] = w
    return out, float(b)


def held_out(id_column: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from; a null id isn't one of them."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitting(sizes: pd.DataFrame, limit: int | None = None) -> pd.DataFrame:
    """The doc_id of those rows (doc_id, size) whose bytes fit into ``limit`` together, in the order of a hash of the id."""
    total = sizes.groupby("doc_id", as_index=False)["size"].sum()
    total = total.iloc[np.argsort(mix(total["doc_id"].to_numpy(np.int64).view(np.uint64)))]
    left, kept = MAX_FIT_BYTES if limit is None else limit, []
    for doc_id, size in zip(total["doc_id"].tolist(), total["size"].tolist(), strict=True):
        if size <= left:
            left -= size
            kept.append(doc_id)
    return pd.DataFrame({"doc_id": np.array(kept, np.int64)})


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """Model from the labels of rows that aren't held out; without both kinds of labels every score is 0."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    share = min(1.0, max_labelled / max(n, 1))
    # About max_labelled rows, whatever the input: small enough to send to every task.
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("_text")).join(F.broadcast(chosen), "doc_id")
    # In the order of their hashes until the bytes are used up; a text that doesn't fit any more is passed over.
    sizes = texts.select("doc_id", F.coalesce(F.octet_length("_text"), F.lit(0)).alias("size")).toPandas()  # about max_labelled rows
    rows = texts.join(F.broadcast(docs.sparkSession.createDataFrame(fitting(sizes), "doc_id bigint")), "doc_id", "left_semi").select("doc_id", "toxic", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            slots, first, bounds, _, _ = features(*flat(batch.column(2)))
            ends = np.append(first, len(slots))
            edge = ends[bounds]
            out = [(slots[edge[i] : edge[i + 1]].tobytes(), (first[bounds[i] : bounds[i + 1]] - edge[i]).astype(np.int32).tobytes()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([o[k] for o in out], pa.binary()) for k in (0, 1))], ["doc_id", "toxic", "slots", "first"])

    got: pd.DataFrame = rows.mapInArrow(run, "doc_id bigint, toxic int, slots binary, first binary").toPandas()
    got = got.sort_values(["doc_id", "slots"], ignore_index=True)
    if got["toxic"].nunique() < 2:
        return np.zeros(SLOTS, np.float32), -1e6
    width = 1 + len(PREFIXES)
    sizes = np.array([len(s) // 4 // width for s in got["slots"]])
    base = np.concatenate(([0], np.cumsum(sizes)))
    firsts = [np.frombuffer(f, np.int32) for f in got["first"]]
    slots = np.frombuffer(b"".join(got["slots"]), np.int32).reshape(-1, width)
    first = np.concatenate([f + o for f, o in zip(firsts, base[:-1], strict=True)]).astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum([len(f) for f in firsts])))
    toxic = got["toxic"].to_numpy()
    del got, firsts
    model = train(slots, first, bounds, toxic)
    give_back()
    return model


def scored(docs: DataFrame, model: tuple[np.ndarray, float], least: float = 0.5, carry: list[str] | None = None, text_column: str = "text") -> DataFrame:
    """Columns ``carry`` of ``docs`` (default: all) with score and offending.

    ``offending`` lists the sentences with p of ``least`` or more as byte spans
    with their p. Null texts and texts without words have score 0 and no spans.
    Every row is scored by itself, so repeated rows score alike. Texts of any
    length are scored whole. Columns of ``docs`` named ``score`` or
    ``offending`` are replaced.
    """
    weights, bias = model
    carry = [c for c in (carry or docs.columns) if c not in ("score", "offending")]
    rows = docs.select(*renamed(carry), F.col(f"`{text_column}`").cast("string").alias("_text"))
    names = rows.columns[: len(carry)]
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            buf, off = flat(batch.column(len(carry)))
            slots, first, bounds, a, b = features(buf, off)
            z = sentence_logits(slots, first, weights, bias)
            p = np.exp(-np.logaddexp(0, -z))
            bad: list[list] = [[] for _ in range(batch.num_rows)]
            for s in np.flatnonzero(p >= least).tolist():
                i = int(np.searchsorted(bounds, s, side="right")) - 1
                bad[i].append({"start": int(a[s] - off[i]), "stop": int(b[s] - off[i]), "p": float(p[s])})
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), pa.array(noisy_or(z, bounds)), pa.array(bad, spans_type)], [*names, "score", "offending"])

    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema[: len(carry)])
    out = rows.mapInArrow(run, f"{fields}score double, offending array<struct<start:bigint,stop:bigint,p:double>>")
    return out.select(*restored(carry), "score", "offending")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learnt from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")), carry=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
