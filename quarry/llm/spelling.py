"""Spelling variants: words one edit apart, and the frequent word that each belongs to.

One edit leaves a half of a word intact. So words are sorted forwards and
backwards, and only words in one block, of a shared first or a shared last half,
are compared. A block of more than BLOCK words is divided again: of the letters
between its shared prefix and its shared suffix a half is intact too. Where
one letter is left between them a block holds no more words than the alphabet allows.

A pair belongs to the class of its shorter length m, and its route through
the blocks is fixed by its common prefix, so every pair is found exactly once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import flat
from quarry.session import cut, table

MIN_LENGTH, MIN_COUNT, FACTOR = 6, 5, 5
#: In the query, a run whose checksum this divides loses a letter.
SLIP = 199
#: Words of a block that are compared with each other; larger blocks are divided.
BLOCK = 64
#: Pairs compared at a time, and distinct words that a task sums up before it hands them on.
PAIRS, TALLY = 1 << 19, 200_000

#: Bytes of letters: A to Z, a to z, and the lead byte of U+00C0 to U+00FF.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[0xC3] = True
_SHORT = 64


def _remainders() -> np.ndarray:
    r = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        r = np.where(r & 1, (r >> 1) ^ np.uint32(0xEDB88320), r >> 1)
    return r


CRC = _remainders()


def letters(buf: np.ndarray) -> np.ndarray:
    """The bytes in lower case (A to Z only), with blanks in place of all that are no letters."""
    out = np.full(len(buf), 0x20, np.uint8)
    for a, b in flat.blocks(len(buf)):
        part, lead = buf[a:b], max(a - 1, 0)
        second = np.zeros(b - a, bool)
        second[a == 0 :] = buf[lead : b - 1] == 0xC3
        keep = LETTER[part] | (second & (part >= 0x80))
        out[a:b][keep] = flat.LOWER[part[keep]]
    return out


def checksums(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """crc32 of each span, carried on from ``seeds``."""
    state, size = seeds.astype(np.uint32) ^ np.uint32(0xFFFFFFFF), ends - starts
    rows = np.flatnonzero(size <= _SHORT)
    for k in range(_SHORT):
        rows = rows[size[rows] > k]
        if not len(rows):
            break
        s = state[rows]
        state[rows] = CRC[(s ^ buf[starts[rows] + k]) & np.uint32(255)] ^ (s >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _SHORT):
        state[i] = zlib.crc32(buf[starts[i] : ends[i]], int(seeds[i]))
    return state


def words_of(buf: np.ndarray, off: np.ndarray, seeds: np.ndarray, slip: int, least: int) -> Iterator[pa.Array]:
    """The words of all documents, runs that slip without a letter; only words of ``least`` letters or more."""
    buf = letters(buf)
    starts, ends, bounds = flat.spans(buf, off)
    seeds = np.repeat(seeds, np.diff(bounds))
    two = np.zeros(256, bool)
    two[0xC3] = True
    before, upto = flat.counts_at(buf, two, starts, ends)
    size = ends - starts - (upto - before)
    long = np.flatnonzero(size >= least)
    starts, ends, size, seeds = starts[long], ends[long], size[long], seeds[long]
    total = np.cumsum(ends - starts)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + flat.BLOCK, side="right")))
        s, e = starts[a:b], ends[a:b]
        slips = np.zeros(b - a, bool)
        if slip:
            crc = checksums(buf, s, e, seeds[a:b])
            slips = crc % slip == 0
            changed = []
            for i in np.flatnonzero(slips):
                word = bytes(buf[s[i] : e[i]]).decode()
                at = int(crc[i]) % len(word)
                if len(word) > least:
                    changed.append(word[:at] + word[at + 1 :])
            yield pa.array(changed, pa.large_string())
            s, e = s[~slips], e[~slips]
        lengths = e - s
        stops = np.cumsum(lengths)
        at = np.arange(stops[-1] if len(stops) else 0) + np.repeat(s - stops + lengths, lengths)
        yield flat.strings(buf[at], np.concatenate(([0], stops)), pa.large_string())
        a = b


def word_counts(docs: DataFrame, slip: int = 0, least: int = MIN_LENGTH, often: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of ``docs`` (doc_id, text) that stand there ``often`` times or more.

    Words are maximal runs of A to Z, a to z and U+00C0 to U+00FF, with only A to Z in
    lower case. Null texts have none; further columns are ignored, repeated rows
    count each. With ``slip``, a run whose crc32 behind its document's id (null:
    nothing) and a colon it divides loses one letter. Tasks sum up their words
    before the shuffle, TALLY different ones at a time, so a frequent word is a row
    for each task at most; long texts are worked on in blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, waiting, rows = None, [], 0

        def merged() -> pa.Table:
            parts = [*([tally] if tally is not None else []), *waiting]
            whole = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")])
            waiting.clear()
            return whole.rename_columns(["word", "n"])

        for batch in flat.slices(batches, "text"):
            buf, off = flat.flat(batch.column(1))
            seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column(0).to_pylist()], np.uint32)
            for words in words_of(buf, off, seeds, slip, least):
                counts = pc.value_counts(words)
                waiting.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
                rows += len(counts)
            if rows > TALLY:
                tally, rows = merged(), 0
                if tally.num_rows > TALLY or tally.nbytes > 1 << 24:
                    yield from tally.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).combine_chunks().to_batches()
                    tally = None
        if tally is not None or waiting:
            yield from merged().cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).combine_chunks().to_batches()
        flat.give_back()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def halved(rows: DataFrame) -> DataFrame:
    """Each word of a block in two blocks: the edit lies behind the first half of the letters in between, or within it."""
    half = F.floor((F.col("m") - F.col("a") - F.col("c")) / 2).cast("int")
    later = F.struct((F.col("a") + half).alias("a"), F.col("c").alias("c"))
    within = F.struct(F.col("a").alias("a"), (F.col("m") - F.col("a") - half).alias("c"))
    return rows.select("word", "n", "m", F.explode(F.array(later, within)).alias("s")).select("word", "n", "m", "s.a", "s.c")


def blocks(words: DataFrame, limit: int = BLOCK) -> DataFrame:
    """Words (word, n) in all blocks (m, a, c, head, tail) that they are compared in.

    ``head`` are the first ``a`` letters of the forward dictionary, ``tail`` the
    first ``c`` of the backward one. Sizes are counted by Spark, and the rows of
    large blocks go on, so a block of very many words is spread at every step.
    """
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).withColumns({"a": F.lit(0), "c": F.lit(0)})
    done = None
    while True:
        rows = halved(rows).withColumns({"head": F.substring("word", F.lit(1), F.col("a")), "tail": F.substring(F.reverse("word"), F.lit(1), F.col("c"))})
        rows = cut(rows.withColumn("key", F.xxhash64("m", "a", "c", "head", "tail")))
        large = cut(rows.where("m - a - c > 1").groupBy("key").count().where(F.col("count") > limit).select("key"))
        ended = large.isEmpty()
        ready = (rows if ended else rows.join(large, "key", "left_anti")).drop("key")
        done = ready if done is None else done.unionByName(ready)
        if ended:
            return done
        rows = rows.join(large, "key", "left_semi").drop("key", "head", "tail")


def compared(words: list[str], m: np.ndarray, a: np.ndarray, c: np.ndarray, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words one edit apart, of which the first has the length m; ``block`` ascends.

    Pairs whose common prefix reaches the shared suffix belong to another block.
    """
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(size) - size
    order = np.lexsort((size, block))  # shorter ones first in each block
    stop = np.searchsorted(block, block[order], side="right")
    first = np.flatnonzero(size[order] == m[order])
    partners = stop[first] - first - 1
    upto, done = np.cumsum(partners), 0
    while done < len(first):
        after = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + PAIRS, side="right")))
        i, k = first[done:after], partners[done:after]
        done = after
        x = np.repeat(i, k)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
        x, y = order[x], order[y]
        p, sx, sy, top = a[x].astype(np.int64), begin[x], begin[y], m[x].astype(np.int64)
        act = np.arange(len(x))
        while len(act):
            act = act[p[act] < top[act]]
            act = act[code[sx[act] + p[act]] == code[sy[act] + p[act]]]
            p[act] += 1
        own = np.flatnonzero((c[x] == 0) | (p < top - c[x]))
        more = size[y] - top  # letters that the second word has more
        at, last = p + 1 - more, top - c[x]
        good, act = np.zeros(len(x), bool), own
        while len(act):
            over = at[act] >= last[act]
            good[act[over]] = True
            act = act[~over]
            act = act[code[sx[act] + at[act]] == code[sy[act] + at[act] + more[act]]]
            at[act] += 1
        yield x[good], y[good]


def near_words(words: DataFrame, limit: int = BLOCK) -> DataFrame:
    """(word, other, other_n): all words that differ by one inserted, deleted or replaced letter, in both directions.

    Blocks are ranges of sorted dictionaries; a task scans its ranges block by
    block and holds one block besides the batch.
    """
    by = ["m", "a", "c", "head", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def found(rows: pa.Table, block: np.ndarray) -> Iterator[pa.RecordBatch]:
            words, n = rows.column("word").combine_chunks(), rows.column("n").combine_chunks()
            m, a, c = (rows.column(k).to_numpy() for k in by[:3])
            for x, y in compared(words.to_pylist(), m, a, c, block):
                left, right = pa.array(np.concatenate((x, y))), pa.array(np.concatenate((y, x)))
                yield pa.RecordBatch.from_arrays([words.take(left), words.take(right), n.take(right)], ["word", "other", "other_n"])

        def numbers(rows: pa.Table) -> np.ndarray:
            new = np.zeros(rows.num_rows, bool)
            for k in by:
                col = rows.column(k).combine_chunks()
                new[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
            return np.cumsum(new)

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            if not rows.num_rows:
                continue
            block = numbers(rows)
            whole = int(np.searchsorted(block, block[-1]))
            if whole:
                yield from found(rows.slice(0, whole), block[:whole])
            rest = rows.slice(whole).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from found(rest, numbers(rest))

    rows = blocks(words, limit).repartitionByRange(*by).sortWithinPartitions(*by)
    return rows.mapInArrow(run, "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: the last word that forms lead to. Chains are halved in each round."""
    links = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        rows = cut(links.join(onward, "root", "left"))
        links = rows.select("word", F.coalesce("_on", "root").alias("root"))
        if rows.where("_on IS NOT NULL").isEmpty():
            return links


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n) with form, root, n_near and form_n.

    A word's form is its near word of largest n (ties: the first in code-point
    order) if that n is ``factor`` times its own or more. Forms grow along a
    chain, so it ends.
    """
    words = cut(words)
    best = F.min(F.struct((-F.col("other_n")).alias("n"), "other"))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("_best"))
    rows = words.join(near, "word", "left")
    led = F.coalesce(-F.col("_best.n") >= factor * F.col("n"), F.lit(False))
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(led, F.col("_best.other")).alias("form"), F.when(led, -F.col("_best.n")).alias("form_n")))
    return rows.join(roots(rows.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents"), SLIP))


#: Words lose a letter by checksum as in the query; near words meet by what is left without a letter, or with a gap in its place.
ORACLE = r"""WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), ru AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), rc AS (SELECT doc_id, run, count(*) AS k FROM ru WHERE length(run) >= 6 GROUP BY ALL), rh AS (
  SELECT run, k, 4294967295 - list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [CAST(ord(ch) AS BIGINT)] ELSE [195, ord(ch) - 64] END))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)) AS h FROM rc, crc
), wd AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM rh
), wc AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM wd WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5), pl AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM wc
), dl AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM pl), gp AS (SELECT word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS rest FROM pl), nr AS (
  SELECT d.word, w.word AS other, w.n AS other_n FROM dl d JOIN wc w ON d.rest = w.word
  UNION ALL SELECT w.word, d.word, d.n FROM dl d JOIN wc w ON d.rest = w.word
  UNION ALL SELECT x.word, y.word, y.n FROM gp x JOIN gp y ON x.rest = y.rest AND x.word <> y.word
), nb AS (SELECT word, count(*) AS n_near, max(other_n) AS best FROM nr GROUP BY 1), fm AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.best >= 5 * w.n THEN b.best END AS form_n, CASE WHEN b.best >= 5 * w.n THEN (SELECT min(r.other) FROM nr r WHERE r.word = w.word AND r.other_n = b.best) END AS form
  FROM wc w LEFT JOIN nb b ON w.word = b.word
), ch AS (SELECT word, word AS here, form FROM fm UNION ALL SELECT c.word, f.word, f.form FROM ch c JOIN fm f ON c.form = f.word)
SELECT f.word, f.form, c.here AS root, f.n, f.n_near, f.form_n FROM fm f JOIN ch c ON f.word = c.word AND c.form IS NULL"""
