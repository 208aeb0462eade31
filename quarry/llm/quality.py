"""Quality rules: per-text measures and n-gram perplexity bands.

Spark counts the byte n-grams of all texts; a modified Kneser-Ney model comes
out of the counts (lower orders from the numbers of distinct continuations) and
is stored as sorted arrays of hashes with probabilities and back-off weights.
One model serves all languages, so passages in another language cost nothing;
the bands are each language's own: the median of the log perplexity, and the
median deviation from it times the root of the length, since short texts scatter
more. Texts outside their language's band on either side are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.carried import renamed, restored
from quarry.llm.flat import SPACE, Tally, blocks, counts_at, flat, mix, slices, span_hashes, spans
from quarry.session import cut, table

#: There are 2**24 n-grams of this order at most, so the model is bounded whatever the input.
ORDER = 3
#: Width of a band above and below, in median deviations.
BAND = 6.0
#: Bands are sent to all tasks up to so many languages; more meet the rows in a join by language.
SENT_BANDS = 10_000
SYMBOLS = b"#*$%&|<>"
_BLANKS = 0x2020202020202020
_ODD = np.uint64(0x9E3779B97F4A7C15)


def grams(buf: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each byte; blanks stand before each text, which begin at ``starts``."""
    out = np.zeros(len(buf), np.uint64)
    for k in range(order - 1, -1, -1):
        out <<= np.uint64(8)
        out[k:] |= buf[: len(buf) - k]
    ends = np.append(starts[1:], len(buf))
    for k in range(order - 1):  # the first bytes of a text don't see the text before
        at = starts + k
        at = at[at < ends]
        mask = np.uint64((1 << 8 * (k + 1)) - 1)
        out[at] = (out[at] & mask) | (np.uint64(_BLANKS & ((1 << 8 * order) - 1)) & ~mask)
    return out


def gram_blocks(buf: np.ndarray, off: np.ndarray, order: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Bounds of each block of bytes and the n-grams that end in it."""
    starts = off[:-1][off[:-1] < off[1:]]
    for a, b in blocks(len(buf)):
        lo = max(0, a - order + 1)
        some = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, b)]
        yield a, b, grams(buf[lo:b], some - lo, order)[a - lo :]


def counted(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n) over all texts; each task adds up its own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Tally()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in seen.taken()], ["gram", "n"])

        for batch in slices(batches, "_text"):
            for _, _, g in gram_blocks(*flat(batch.column(0)), order):
                keys, n = np.unique(g.astype(np.uint32) if order < 5 else g, return_counts=True)
                seen.add(keys.astype(np.uint64).view(np.int64), n)
            if len(seen.keys) > 2_000_000:
                yield rows()
        yield rows()

    return texts.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more, from the counts of counts."""
    n1, n2, n3, n4 = (int((counts == k).sum()) for k in (1, 2, 3, 4))
    if min(n1, n2, n3, n4) == 0:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0, [0, 0.99, 1.99, 2.99])


class KneserNey:
    """Probabilities by n-gram and back-off weights by context, in sorted hash arrays for each order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int):
        self.order, self.tables, self.weights = order, [], []
        levels = [(keys, counts)]
        for n in range(order - 1, 0, -1):
            levels.append(np.unique(levels[-1][0] & np.uint64((1 << 8 * n) - 1), return_counts=True))
        below = None
        for n, (keys, counts) in enumerate(reversed(levels), 1):
            d = _discounts(counts)
            contexts, at = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kind = np.bincount(at, counts), np.minimum(counts, 3)
            weight = sum(d[k] * np.bincount(at, kind == k, len(total)) for k in (1, 2, 3)) / np.maximum(total, 1)
            lower = below[1][np.searchsorted(below[0], keys & np.uint64((1 << 8 * (n - 1)) - 1))] if below else 1 / 256
            p = (counts - d[kind]) / total[at] + weight[at] * lower if len(keys) else np.zeros(0)
            below = keys, p
            self.tables.append(self._sorted(keys, np.log(p)))
            self.weights.append(self._sorted(contexts, np.log(np.maximum(weight, 1e-12))))

    @staticmethod
    def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = mix(keys)
        by = np.argsort(hashes)
        return hashes[by], values[by].astype(np.float32)

    @staticmethod
    def _find(pair: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, values = pair
        if not len(hashes):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        h = mix(keys)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        return hashes[at] == h, values[at]

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """Natural log of each n-gram's last byte given the bytes before it."""
        out, todo, n = np.zeros(len(keys)), np.arange(len(keys)), self.order
        while len(todo) and n:
            known = keys[todo] & np.uint64((1 << 8 * n) - 1)
            hit, p = self._find(self.tables[n - 1], known)
            out[todo[hit]] += p[hit]
            todo, known = todo[~hit], known[~hit]
            seen, w = self._find(self.weights[n - 1], known >> np.uint64(8))
            out[todo[seen]] += w[seen]
            n -= 1
        out[todo] -= np.log(256)
        return out

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Sum of log probabilities of each text's bytes."""
        out = np.zeros(len(off) - 1)
        for a, b, g in gram_blocks(buf, off, self.order):
            distinct, at = np.unique(g, return_inverse=True)
            sums = np.concatenate(([0], np.cumsum(self.log_probs(distinct)[at])))
            i, j = int(np.searchsorted(off, a, side="right")) - 1, int(np.searchsorted(off, b))
            edges = np.clip(off[i : j + 1], a, b) - a
            out[i:j] += sums[edges[1:]] - sums[edges[:-1]]
        return out


def fit(docs: DataFrame, text_column: str = "text", order: int = ORDER) -> KneserNey:
    """The model of all texts of ``docs``."""
    texts = docs.select(F.col(f"`{text_column}`").cast("string").alias("_text"))
    got = counted(texts, order).toPandas().sort_values("gram")  # as many rows as there are n-grams
    return KneserNey(got["gram"].to_numpy().view(np.uint64), got["n"].to_numpy(), order)


def _repeated(hashes: np.ndarray) -> np.ndarray:
    """Which values stand there more than once."""
    by = np.sort(hashes)
    twice = np.unique(by[1:][by[1:] == by[:-1]])
    del by
    if not len(twice):
        return np.zeros(len(hashes), bool)
    return twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes


def measures(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base measures of each text."""
    n = len(off) - 1
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    solid = ~SPACE & ((np.arange(256) & 0xC0) != 0x80)
    of_texts = lambda which: np.diff(counts_at(buf, which, off)[0])
    starts, ends, bounds = spans(buf, off)
    words = span_hashes(buf, (starts, ends))[0]
    del starts, ends
    text_of = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
    rolled = np.zeros(max(0, len(words) - 7), np.uint64)
    for k in range(8):
        rolled *= _ODD
        rolled += words[k : k + len(rolled)]
    whole = text_of[: len(rolled)] == text_of[7:] if len(rolled) else np.zeros(0, bool)
    rolled += text_of[: len(rolled)].astype(np.uint64) * _ODD
    at = np.flatnonzero(whole)
    repeated = at[_repeated(mix(rolled[at]))]
    del rolled, at
    cover = np.zeros(len(words) + 1, np.int32)
    cover[repeated] += 1
    cover[repeated + 8] -= 1
    covered = np.cumsum(cover, dtype=np.int32)[: len(words)] > 0
    newline = np.zeros(256, bool)
    newline[10] = True
    a, b, lines = spans(buf, off, newline)
    before, behind = counts_at(buf, ~SPACE, a, b)
    full = behind > before
    line_text = np.repeat(np.arange(n), np.diff(lines))[full]
    h = mix(span_hashes(buf, (a[full], b[full]))[0] + line_text.astype(np.uint64) * _ODD)
    first = np.unique(h, return_index=True)[1]
    return {
        "n_words": np.diff(bounds),
        "word_chars": of_texts(solid),
        "n_symbols": of_texts(symbol),
        "n_dup_lines": np.bincount(line_text, minlength=n) - np.bincount(line_text[first], minlength=n),
        "n_repeat_words": np.bincount(text_of[covered], minlength=n),
        "n_bytes": np.diff(off),
    }


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes")


def assessed(docs: DataFrame, carry: list[str] | None = None, text_column: str = "text", lang_column: str = "lang", band: float = BAND, model: KneserNey | None = None) -> DataFrame:
    """Columns ``carry`` of ``docs`` (default: all) with measures, log_perplexity, base_failed and kept.

    ``base_failed``: fewer than 20 words, or over 30 % of them in repeated
    8-word windows. ``kept`` is false then, else if the log perplexity is outside
    its language's band. A null text has no words, and so fails; a null language
    is a language of its own; repeated rows are assessed one by one. Columns of
    ``docs`` with names of the result's are replaced. Very long texts are measured
    whole, in blocks; a task holds some 10 bytes for each of theirs. An empty
    table gives an empty result.
    """
    results = [*MEASURES, "log_perplexity", "base_failed", "kept"]
    model = model or fit(docs, text_column)
    carry = [c for c in (carry or docs.columns) if c not in results]
    text, lang = (F.col(f"`{c}`").cast("string") for c in (text_column, lang_column))
    rows = docs.select(*renamed(carry), text.alias("_text"), lang.alias("_lang"))
    names = rows.columns[: len(carry)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            buf, off = flat(batch.column(len(carry)))
            m = measures(buf, off)
            x = -model.scores(buf, off) / np.maximum(m["n_bytes"], 1)
            cols = [*(batch.column(i) for i in range(len(carry))), batch.column(len(carry) + 1), *(pa.array(m[k].astype(np.int64)) for k in MEASURES), pa.array(x)]
            yield pa.RecordBatch.from_arrays(cols, [*names, "_lang", *MEASURES, "log_perplexity"])

    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema[: len(carry)])
    # Written with the columns that are carried, so that texts are read and measured once and not shuffled.
    scored = cut(rows.mapInArrow(run, f"{fields}_lang string, {', '.join(f'{k} bigint' for k in MEASURES)}, log_perplexity double"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    long = scored.where(~failed).select("_lang", "n_bytes", F.col("log_perplexity").alias("_x"))

    def median(df: DataFrame, value, step: float, name: str) -> DataFrame:
        """By language, from a histogram of steps whose size doesn't depend on the rows."""
        bins = df.groupBy("_lang", F.floor(value / step).alias("_bin")).count()
        w = Window.partitionBy("_lang").orderBy("_bin")
        bins = bins.withColumns({"_upto": F.sum("count").over(w), "_all": F.sum("count").over(Window.partitionBy("_lang"))})
        return bins.where(2 * F.col("_upto") >= F.col("_all")).groupBy("_lang").agg(((F.min("_bin") + 0.5) * step).alias(name))

    same = lambda a, b: a.join(b.withColumnRenamed("_lang", "_l"), F.col("_lang").eqNullSafe(F.col("_l")), "left").drop("_l")
    middle = cut(median(long, F.col("_x"), 0.001, "_middle"))
    few = middle.count() <= SENT_BANDS
    sent = lambda df: F.broadcast(df) if few else df
    away = (F.col("_x") - F.col("_middle")) * F.sqrt("n_bytes")
    spread = median(same(long, sent(middle)), F.abs(away), 0.01, "_spread")
    bands = same(middle, spread)
    out = same(scored, sent(bands)).withColumn("_x", F.col("log_perplexity"))
    inside = F.coalesce(F.abs(away) <= F.lit(band) * F.col("_spread"), F.lit(True))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & inside).select(*restored(carry), *results)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return assessed(docs, carry=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")
