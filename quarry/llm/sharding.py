"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in logical partitions (a hash of their identity, so a recomputed task
sees the same partition). The driver draws, from the partitions' counts alone,
how many rows of each partition go to each block: a matrix whose rows sum to the
partition counts and whose columns sum to the wanted block sizes, distributed as
the counts of a uniformly random permutation. Every partition then permutes its
rows locally and deals them out by its row of the matrix; every block permutes
what it got. The result is a uniform shuffle with exact shard sizes.

A shard is cut into blocks of about ``rows_per_part`` rows (slots run on across
a shard's blocks), so that no task holds a whole shard. Where there are more blocks
than a matrix may have columns, rows are dealt in levels: first to stretches of
blocks, then within each stretch, each time by matrices of their own. A level is
uniform given the one before, so the whole is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import carried
from quarry.session import cut, table

#: Partitions of a level and blocks at most; a task's rows are the table's by this number, once these exceed ``rows_per_part``.
MAX_PARTS = 1 << 16
#: Columns of a matrix, and cells of a level's matrices.
MAX_FAN, MAX_CELLS = 256, 1 << 22
#: Numpy draws hypergeometric numbers from fewer rows than this.
NUMPY_ROWS = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``good`` rows are among ``sample`` rows drawn from ``good`` + ``bad``, of any size."""
    if good + bad < NUMPY_ROWS:
        return int(rng.hypergeometric(good, bad, sample)) if good + bad else 0
    total = good + bad
    if good > bad:
        return sample - hypergeometric(rng, bad, good, sample)
    if 2 * sample > total:
        return good - hypergeometric(rng, good, bad, total - sample)
    return _rejected(rng, good, bad, sample)


def _rejected(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """By ratio of uniforms around the mode, or from 0 upwards where few are expected (good <= bad, sample at most half)."""
    total, top = good + bad, min(good, sample)
    mean = sample * good / total
    log = lambda k: -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(sample - k + 1) + math.lgamma(bad - sample + k + 1))
    if mean < 30:
        left = rng.random()
        p = math.exp(log(0) + sum(math.lgamma(x + 1) for x in (good, bad, sample, total - sample)) - math.lgamma(total + 1))
        for k in range(top):
            left -= p
            if left <= 0:
                return k
            p *= (good - k) * (sample - k) / ((k + 1) * (bad - sample + k + 1))
        return top
    spread = math.sqrt(mean * (1 - good / total) * (total - sample) / (total - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    peak = log(int((sample + 1) * (good + 1) / (total + 2)))
    while True:
        u, v = rng.random(), rng.random()
        x = mean + 0.5 + width * (v - 0.5) / u if u else -1.0
        if 0 <= x < top + 1 and 2 * math.log(u) <= log(int(x)) - peak:
            return int(x)


def communication_matrix(parts: np.ndarray, blocks: np.ndarray, seed: int | list[int]) -> np.ndarray:
    """Random matrix of counts with row sums ``parts`` and column sums ``blocks``."""
    if parts.sum() != blocks.sum():
        raise ValueError("partitions and blocks hold different numbers of rows")
    rng, left = np.random.default_rng(seed), blocks.astype(np.int64).copy()
    out = np.zeros((len(parts), len(blocks)), np.int64)
    for p, n in enumerate(parts.tolist()):
        if not n:
            continue
        if left.sum() < NUMPY_ROWS:
            out[p] = rng.multivariate_hypergeometric(left, n, method="marginals")
        else:  # a cell at a time
            rest, todo = int(left.sum()), n
            for b, size in enumerate(left.tolist()):
                rest -= size
                out[p, b] = hypergeometric(rng, size, rest, todo)
                todo -= int(out[p, b])
        left -= out[p]
    return out


def block_sizes(total: int, n_shards: int, per_shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, shard and first slot of each block; shards differ by one row at most."""
    size, shard, first = [], [], []
    for s in range(n_shards):
        rows = total // n_shards + (s < total % n_shards)
        at = 0
        for b in range(per_shard):
            n = rows // per_shard + (b < rows % per_shard)
            size.append(n), shard.append(s), first.append(at)
            at += n
    return np.array(size, np.int64), np.array(shard, np.int64), np.array(first, np.int64)


def _salted(df: DataFrame, identity: list[str], per_part: int) -> DataFrame:
    """``df`` with ``_salt``: 0, but for rows of an identity that would fill more than half a partition.

    Those are numbered and dealt out by their number. Numbers are written down
    before anything depends on them.
    """
    half = max(1, per_part // 2)
    hot = cut(df.groupBy(F.xxhash64(*identity).alias("_hash")).agg(F.count("*").alias("_many")).where(F.col("_many") > half))
    if hot.isEmpty():
        return df.withColumn("_salt", F.lit(0).cast("long"))
    rows = cut(df.withColumns({"_tie": F.monotonically_increasing_id(), "_hash": F.xxhash64(*identity)}))
    salt = F.coalesce(F.pmod(F.col("_tie"), F.ceil(F.col("_many") / half)), F.lit(0))
    return rows.join(hot, "_hash", "left").withColumn("_salt", salt.cast("long")).drop("_tie", "_hash", "_many")


def shuffle_into_shards(df: DataFrame, identity: list[str], n_shards: int, seed: int = 7, rows_per_part: int = 2000) -> DataFrame:
    """``df`` with columns ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``identity`` names the columns that tell rows apart; they also fix the order
    from which the seeded permutations start, so a lost task's second run gives
    the same rows. Rows alike in all of them are interchangeable; where they are
    many, they spread over partitions by a number of their own. Null
    identities are values like others, texts of any length are carried as they are. An
    empty table gives an empty result. Columns of ``df`` named ``shard`` or ``slot`` are
    replaced; others are carried under names of their own, so none clashes.
    """
    df = df.drop("shard", "slot")
    names = df.columns
    identity = [f"c{names.index(c)}" for c in identity]
    df = df.select(*carried.renamed(names))
    total = df.count()
    per_part = max(rows_per_part, math.ceil(total / MAX_PARTS))
    df = _salted(df, identity, per_part)
    size, shard, first = block_sizes(total, n_shards, max(1, math.ceil(total / n_shards / per_part)))
    upto = np.concatenate(([0], np.cumsum(size)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    all_parts = max(1, math.ceil(total / per_part))
    fan = max(2, min(MAX_FAN, MAX_CELLS // all_parts))

    def ordered(rows: pa.Table, where: int, step: int) -> pa.Table:
        rows = rows.combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in identity], null_placement="at_start"))
        return rows.take(pa.array(np.random.default_rng([seed, step, where]).permutation(rows.num_rows)))

    def level(rows: DataFrame, stretch: int, step: int) -> tuple[DataFrame, int]:
        """Deals rows of stretches (``_block``: a stretch's number) of so many blocks to shorter ones."""
        shorter = math.ceil(stretch / fan)
        stretches = math.ceil(len(size) / stretch)
        n_parts = math.ceil(all_parts / stretches)
        part = F.col("_block") * n_parts + F.pmod(F.xxhash64(*identity, "_salt", F.lit(step)), F.lit(n_parts))
        dealt = rows.withColumn("_part", part.cast("int")).drop("_block")
        counts = np.zeros(stretches * n_parts, np.int64)
        for row in dealt.groupBy("_part").count().collect():  # MAX_PARTS rows and one for each stretch at most
            counts[row["_part"]] = row["count"]
        matrix, base = [], []
        for s in range(stretches):
            edges = np.append(np.arange(s * stretch, min((s + 1) * stretch, len(size)), shorter), min((s + 1) * stretch, len(size)))
            drawn = communication_matrix(counts[s * n_parts : (s + 1) * n_parts], np.diff(upto[edges]), [seed, step, s])
            matrix += [row.astype(np.int32) for row in drawn]
            base += [edges[0] // shorter] * n_parts

        def deal(key: tuple, rows: pa.Table) -> pa.Table:
            p = key[0].as_py()
            rows = ordered(rows, p, 2 * step + 1).drop_columns("_part")
            return rows.append_column("_block", pa.array((base[p] + np.repeat(np.arange(len(matrix[p])), matrix[p])).astype(np.int32)))

        return dealt.groupBy("_part").applyInArrow(deal, f"{fields}, _block int"), shorter

    rows, stretch, step = df.withColumn("_block", F.lit(0)), len(size), 0
    # Stretches of a power of the fan keep to each other's bounds.
    stretch = fan ** max(1, math.ceil(math.log(max(stretch, 2), fan) - 1e-9)) if stretch > fan else stretch
    while step == 0 or stretch > 1:
        rows, stretch = level(rows, stretch, step)
        rows, step = rows if stretch == 1 else cut(rows), step + 1

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        b = key[0].as_py()
        rows = ordered(rows, b, 0).drop_columns("_block")
        return rows.append_column("shard", pa.array(np.full(rows.num_rows, shard[b], np.int32))).append_column("slot", pa.array(first[b] + np.arange(rows.num_rows, dtype=np.int64)))

    placed = rows.groupBy("_block").applyInArrow(place, f"{fields}, shard int, slot bigint")
    return placed.select(*carried.restored(names), "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose row counts are one apart at most (law ``rows``).

    Null texts have size 16 and the checksum of no bytes.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return shuffle_into_shards(rows, ["doc_id", "size", "text_crc32"], 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
