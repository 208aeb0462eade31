"""Near-duplicate groups by fast similarity sketching, banding and exact checks.

A document's set holds its distinct word shingles, as 64-bit hashes. Its sketch
has ``BINS`` coordinates: in round i every element is hashed anew into a random
bin with a value that starts with i, and each bin keeps its smallest value;
after ``BINS`` rounds, round ``BINS`` + j puts every element into bin j, so every
coordinate is filled whatever the set's size. Rounds end once all bins are full,
which a set of some hundred elements reaches in two or three. The share of equal
coordinates of two sketches is concentrated around their similarity as with
sampling without replacement.

Documents with equal sets are one class, whose smallest id stands for it. Classes
that share a band of four coordinates are candidates (a pair at similarity 0.8
shares none of the 32 bands with a chance of 5e-8). Every link is confirmed on
the full sets, in three passes that avoid the pairs of large groups:

1. each class against one pivot: of the pivots of its bands (a band's pivot is the
   member whose bands hold most classes) the one that shares most;
2. in bands whose members aren't yet in one component, each member against the
   band's pivot;
3. in bands that still hold several components, members of different components,
   of which at least one isn't linked with the pivot. Two such classes can only be
   linked if what each has different from the pivot agrees to a large part: by the
   prefix principle they share one of their rarest differences, so these are
   joined, with bounds on sizes and on the numbers of differences (the set that has
   fewer takes part with a prefix that texts of one template, if not linked, fill
   with what only they have); sketches sort out more before the full sets decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.flat import LOWER, flat, mix, slices, span_hashes, spans
from quarry.llm.suffix_dedup import numbered
from quarry.session import cut, table

BINS, BAND = 128, 4
#: A pair at the threshold of 0.8 has 102 equal coordinates on average; fewer than these have a chance of 1e-10.
LEAST_EQUAL = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    Words are runs without ASCII white space, A-Z lower-cased. A text with fewer
    words than ``width`` has its whole sequence as its one shingle; one without
    words has none.
    """
    buf, off = flat(texts)
    buf = LOWER[buf]
    starts, ends, bounds = spans(buf, off)
    words = span_hashes(buf, (starts, ends))[0]
    del starts, ends
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled = rolled * _ODD + words[k : k + n]
    rolled = mix(rolled + np.uint64(width))
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(np.unique(rolled[lo : hi - width + 1]))
        elif hi > lo:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words[lo:hi]:
                    h = h * _ODD + w
            out.append(mix(np.array([h + np.uint64(hi - lo)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], bins: int = BINS, part: int = 1 << 17) -> np.ndarray:
    """One row of ``bins`` coordinates for each set; those of empty sets have no meaning.

    Elements are worked on in parts of bounded size: a coordinate is a smallest
    value, so the parts' sketches combine by their minima.
    """
    out = np.full((len(sets), bins), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    upto = np.concatenate(([0], np.cumsum(sizes)))
    element = np.concatenate([*sets, np.zeros(0, np.uint64)])
    for a in range(0, len(element), part):
        b = min(a + part, len(element))
        i, j = int(np.searchsorted(upto, a, side="right")) - 1, int(np.searchsorted(upto, b))
        edges = np.clip(upto[i : j + 1], a, b)
        np.minimum(out[i:j], _sketches(np.repeat(np.arange(j - i), np.diff(edges)), element[a:b], j - i, bins), out=out[i:j])
    return out


def _sketches(doc: np.ndarray, element: np.ndarray, docs: int, bins: int) -> np.ndarray:
    out = np.full((docs, bins), np.iinfo(np.uint64).max, np.uint64)
    every, low = out.reshape(-1), np.uint64((1 << 56) - 1)
    for i in range(2 * bins):
        if not len(element):
            break
        x = mix(element + np.uint64((i + 1) * int(_ODD) & (1 << 64) - 1))
        bin_ = ((x >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(every, doc * bins + bin_, (np.uint64(i) << np.uint64(56)) | (mix(x) & low))
        full = (out != np.iinfo(np.uint64).max).all(axis=1)
        keep = ~full[doc]
        doc, element = doc[keep], element[keep]
    return out


def band_hashes(rows: np.ndarray, band: int = BAND) -> np.ndarray:
    parts = rows.reshape(len(rows), -1, band)
    h = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(band):
        h = mix(h * _ODD + parts[:, :, k])
    return h


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            sets = shingle_sets(batch.column(1), width)
            rows = sketches(sets)
            bands = band_hashes(rows).view(np.int64)
            short = (mix(rows) & np.uint64(0xFFFF)).astype("<u2")
            empty = [not len(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([None if e else hashlib.md5(s.tobytes()).digest() for s, e in zip(sets, empty, strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands.shape[1], pa.int32()), pa.array(bands.reshape(-1))),
                    pa.array([None if e else s.tobytes() for s, e in zip(short, empty, strict=True)], pa.binary()),
                ],
                ["_id", "n", "print", "bands", "sketch"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1), width)], pa.binary())], ["rep", "elements"])

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, (x, y) = [], (batch.column(2), batch.column(3))
            for i in range(batch.num_rows):
                p, q = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64())).select(["a", "b"])

    return run


def _deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles in which each class and its pivot differ."""
    for batch in slices(batches, "elements", 1 << 20):
        parts = [np.setxor1d(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(x.as_buffer(), np.uint64), assume_unique=True).view(np.int64) for p, x in zip(batch.column(5), batch.column(6), strict=True)]
        size = np.array([len(x) for x in parts], np.int64)
        at = pa.array(np.repeat(np.arange(batch.num_rows), size))
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(5)), pa.array(np.repeat(size, size)), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]))], ["pivot", "rep", "n", "component", "outside", "d", "element"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if n:
            p, q = (np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(n, -1) for c in (batch.column(2), batch.column(3)))
            yield batch.take(pa.array(np.flatnonzero((p == q).sum(axis=1) >= LEAST_EQUAL))).select(["a", "b"])


#: Words of the filter that keeps texts without candidates out of a shuffle: 2 MB. Where more ids would fill it, the join alone decides.
FILTER_WORDS = 1 << 18


def _only_near(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` (_id, _text) without most rows whose id isn't in ``ids`` (rep); a join with ``ids`` decides."""
    h = F.xxhash64("rep")
    words = np.zeros(FILTER_WORDS, np.int64)
    bits = ids.groupBy(F.pmod(h, F.lit(FILTER_WORDS)).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(shiftrightunsigned(xxhash64(rep), 32), 64) as int))")).alias("b"))
    got = bits.toPandas()  # FILTER_WORDS rows at most
    words[got["w"].to_numpy()] = got["b"].to_numpy()
    if 4 * np.bitwise_count(words.view(np.uint64)).sum() > 64 * FILTER_WORDS:
        return docs  # so many ids that the filter lets too much pass
    seen = docs.withColumn("_h", F.xxhash64("_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).to_numpy(zero_copy_only=False)
            bit = (x.view(np.uint64) >> np.uint64(32)) % np.uint64(64)
            hit = (words[x % FILTER_WORDS].view(np.uint64) >> bit) & np.uint64(1)
            yield batch.filter(pa.array(hit.astype(bool))).select(["_id", "_text"])

    return seen.mapInArrow(run, docs.schema)


def _share(percent: int) -> float:
    """Two sets are linked if they differ in so much of their sizes' sum at most."""
    return (100 - percent) / (100 + percent)


def prefixes(deltas: DataFrame, percent: int) -> DataFrame:
    """The rarest differences of each class from its pivot, one of which it shares with every class that it can be linked with.

    Of two classes that aren't linked with the pivot's component (``outside``)
    that of the smaller weight d - share * n only needs its ``narrow`` rows:
    linked sets agree in half the sum of their weights or more.
    """
    holders = deltas.groupBy("pivot", "element").agg(F.count("*").alias("holders"), F.bool_or("outside").alias("met"))
    share = _share(percent)
    weight = F.col("d") - share * F.col("n")
    wide = F.when(F.col("outside"), F.ceil(F.col("d") - share * (1 + 100 / percent) * F.col("n") - 1e-6)).otherwise(F.ceil((1 - share) / 2 * F.col("d") - 1e-6))
    within = lambda least: F.col("at") <= F.col("d") - F.greatest(least, F.lit(1)) + 1
    rarest = Window.partitionBy("pivot", "rep").orderBy("holders", "element")
    kept = deltas.join(holders, ["pivot", "element"]).withColumn("at", F.row_number().over(rarest)).where(within(wide) & (F.col("holders") > 1) & F.col("met"))
    return kept.select("pivot", "element", "rep", "n", "component", "outside", "d", "at", weight.alias("w"), within(F.ceil(weight - 1e-6)).alias("narrow"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept of each row.

    Two documents are linked if 100 * intersection >= ``percent`` * union of
    their shingle sets, with ``percent`` 80 at least. Null and empty texts have
    empty sets and are linked with nothing. Ids are bigint; texts of one id are
    linked with each other; rows with a null id are kept, with a null component. Very long texts are
    compared whole; their sets are one row. An empty table gives an empty
    result. Other columns are dropped.
    """
    if percent < 80:
        raise ValueError("the bands are laid out for a similarity of 0.8 or more")
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("_id"), F.col(f"`{text_column}`").cast("string").alias("_text"))
    if rows.where("_id IS NOT NULL").groupBy("_id").count().where("count > 1").isEmpty():
        out = _grouped(rows, width, percent)
    else:  # texts of one id are documents of their own, linked with each other
        named = cut(numbered(rows, "_id", "_text"))
        known = named.where("_id IS NOT NULL").select(F.col("_doc").alias("a"), F.col("_id").alias("of_id")).distinct()
        first = known.groupBy("of_id").agg(F.min("a").alias("b"))
        bound = known.join(first, "of_id").where("a <> b").select("a", "b")
        out = _grouped(named.select(F.when(F.col("_id").isNotNull(), F.col("_doc")).alias("_id"), "_text"), width, percent, bound)
        names = known.select(F.col("a").alias("_id"), "of_id")
        out = out.join(names, "_id", "left").join(names.toDF("component", "of_component"), "component", "left").select(F.col("of_id").alias("_id"), "n", F.col("of_component").alias("component"))
    return out.select(F.col("_id").alias(id_column), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("_id") == F.col("component"), F.lit(True)).alias("kept"))


def _grouped(docs: DataFrame, width: int, percent: int, bound: DataFrame | None = None) -> DataFrame:
    """_id, n and component of each row of ``docs`` (_id, _text); documents of ``bound`` (a, b) are linked whatever their texts."""
    marks = cut(docs.mapInArrow(_fingerprints(width), "_id bigint, n bigint, print binary, bands array<bigint>, sketch binary"))
    known = marks.where("print IS NOT NULL AND _id IS NOT NULL")
    classes = cut(known.groupBy("print").agg(F.min("_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    banded = classes.select(F.explode("bands").alias("band"), "rep", "n")
    shared = banded.groupBy("band").agg(F.count("*").alias("size"), F.min("rep").alias("low"), F.max("rep").alias("top")).where("low < top").select("band", "size")
    members = cut(banded.join(shared, "band"))
    # A band's pivot is its member that shares most: a text that many others are copies of.
    weight = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    pivots = members.join(weight, "rep").groupBy("band").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"), "n")).alias("p"))
    pivots = pivots.select("band", (-F.col("p.minus")).alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.weight").alias("pivot_weight"))
    members = cut(members.drop("size").join(pivots, "band"))
    fits = lambda x, y: (F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y))
    near = members.select("rep").distinct()
    texts = _only_near(docs, near).join(near, F.col("_id") == F.col("rep"), "left_semi")
    sets = texts.mapInArrow(_sets(width), "rep bigint, elements binary")
    sets = cut(sets if bound is None else sets.dropDuplicates(["rep"]))  # rows alike in id and text

    def confirm(pairs: DataFrame) -> DataFrame:
        left, right = sets.select(F.col("rep").alias("a"), F.col("elements").alias("x")), sets.select(F.col("rep").alias("b"), F.col("elements").alias("y"))
        return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirmed(percent), "a bigint, b bigint"))

    def labelled(links: DataFrame) -> DataFrame:
        own = components(links).withColumnsRenamed({"node": "rep"})
        rows = members.join(own, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        open_bands = rows.groupBy("band").agg((F.min("component") < F.max("component")).alias("open")).where("open").select("band")
        return cut(rows.join(open_bands, "band"))

    star = members.where((F.col("rep") != F.col("pivot")) & fits(F.col("n"), F.col("pivot_n")))
    heaviest = F.max(F.struct("pivot_weight", (-F.col("pivot")).alias("minus"))).alias("p")
    first = cut(star.groupBy("rep").agg(heaviest).select((-F.col("p.minus")).alias("a"), F.col("rep").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = confirm(first)
    left = labelled(links)
    pivots = left.where("rep = pivot").select("band", F.col("component").alias("pivot_component"))
    second = left.join(pivots, "band").where((F.col("component") != F.col("pivot_component")) & fits(F.col("n"), F.col("pivot_n")))
    second = cut(second.select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct().join(first, ["a", "b"], "left_anti"))
    links = cut(links.union(confirm(second)))
    left = labelled(links)
    centre = left.where("rep = pivot").select("pivot", F.col("component").alias("centre")).distinct()
    around = left.where("rep <> pivot").select("pivot", "rep", "n", "component").distinct().join(centre, "pivot")
    around = around.select("pivot", "rep", "n", "component", (F.col("component") != F.col("centre")).alias("outside"))
    both = around.join(sets.toDF("pivot", "p"), "pivot").join(sets, "rep").select("pivot", "rep", "n", "component", "outside", "p", "elements")
    deltas = cut(both.mapInArrow(_deltas, "pivot bigint, rep bigint, n bigint, component bigint, outside boolean, d bigint, element bigint"))
    kept, share = cut(prefixes(deltas, percent)), _share(percent)
    side = lambda s: kept.select("pivot", "element", *(F.col(c).alias(f"{c}_{s}") for c in ("n", "d", "component", "outside", "at", "w", "narrow")), F.col("rep").alias(s))
    # No more differences than those from here on can agree, if this is the first that does.
    agree = 1 + F.least(F.col("d_a") - F.col("at_a"), F.col("d_b") - F.col("at_b"))
    enough = 2 * agree >= F.col("w_a") + F.col("w_b") - 1e-6
    possible = enough & (F.col("component_a") != F.col("component_b")) & fits(F.col("n_a"), F.col("n_b")) & (F.abs(F.col("d_a") - F.col("d_b")) <= share * (F.col("n_a") + F.col("n_b")) + 1e-6)
    # Of two sets outside, that of the smaller weight takes part with its narrow prefix: what a template's copies have in common is behind it.
    smaller = (F.col("w_a") < F.col("w_b")) | ((F.col("w_a") == F.col("w_b")) & (F.col("a") < F.col("b")))
    apart = side("a").where("outside_a AND narrow_a").join(side("b").where("outside_b"), ["pivot", "element"]).where(possible & smaller).select("a", "b")
    third = apart.union(side("a").where("NOT outside_a").join(side("b").where("outside_b"), ["pivot", "element"]).where(possible).select("a", "b"))
    third = third.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    third = third.select("a", "b").distinct().join(first.union(second), ["a", "b"], "left_anti")
    seen = classes.select("rep", "sketch")
    third = third.join(seen.toDF("a", "x"), "a").join(seen.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(_alike, "a bigint, b bigint")
    links = cut(links.union(confirm(third)))
    if bound is not None:
        of = known.select("_id", "print").distinct().join(classes.select("print", "rep"), "print").select("_id", "rep")
        ends = bound.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").where("x <> y")
        links = links.union(ends.select(F.least("x", "y"), F.greatest("x", "y")))
    final = components(links).withColumnsRenamed({"node": "rep"})
    by_class = classes.select("print", "rep").join(final, "rep", "left").select("print", F.coalesce("component", "rep").alias("component"))
    out = marks.select("_id", "n", "print").join(by_class, "print", "left")
    return out.select("_id", "n", F.when(F.col("_id").isNotNull(), F.coalesce("component", "_id")).alias("component"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents by sets of two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
