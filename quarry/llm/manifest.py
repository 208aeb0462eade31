"""A Merkle manifest of a table: a digest tree per group of rows, one over the groups, and a proof for each row.

Rows of a group, in order, are cut into aligned blocks of FAN ** LEVELS leaves.
One distributed traversal goes through every block in postorder: a subtree
returns its digest, and on the way back up the digests of the other children
are appended to the leaves below each child. The blocks' roots are the leaves of
the next traversal, until each group has one node left; these are the leaves of
the last tree. Paths then come down again, a join on the block for each
traversal, so no task holds more than a block and nothing meets on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from quarry.session import cut, table

#: Children of a node, and levels of a block: 4,096 leaves, each with 28 siblings of 32 bytes at most.
FAN, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def part(value: Column) -> Column:
    """A value as it enters a leaf: its length in bytes and itself; null: a dash."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(part, values)), 256)


def group_key(value: Column) -> Column:
    """Groups as strings in their order: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("1"), value.cast("string")), F.lit("0"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos``, their number (from 0) within ``grp`` by ``order``.

    Rows are sorted in ranges; a row's number is its place in its range plus the
    rows of the group in earlier ranges. A large group is many ranges; rows
    alike in all of ``order`` are told apart by a number of their own.
    """
    tagged = cut(rows.withColumn("_tie", F.monotonically_increasing_id()))
    by = ["grp", *order, "_tie"]
    placed = cut(tagged.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_id", F.monotonically_increasing_id()))
    rows = placed.withColumns({"_range": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")
    counts = rows.groupBy("grp", "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("grp").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("grp", "_range", (before - F.col("_first")).alias("_shift"))
    return rows.join(shift, ["grp", "_range"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")


def walk(digests: list[bytes], start: int, stop: int, height: int, paths: list[list[bytes]]) -> bytes:
    """Digest of the subtree over leaves ``start`` to ``stop``; its leaves' paths get the siblings of each level.

    A level is written as the node's place among the children, the number of its
    siblings, and their digests.
    """
    if not height:
        return digests[start]
    step = FAN ** (height - 1)
    children = [(a, min(a + step, stop)) for a in range(start, stop, step)]
    got = [walk(digests, a, b, height - 1, paths) for a, b in children]
    for k, (a, b) in enumerate(children):
        level = bytes((k, len(got) - 1)) + b"".join(got[:k] + got[k + 1 :])
        for path in paths[a:b]:
            path.append(level)
    return sha256("".join(g.hex() for g in got).encode()).digest()


def block_digest(digests: list[bytes], first: bool) -> tuple[bytes, list[bytes]]:
    """Root of a block and its leaves' paths; a group's ``first`` block is as high as its leaves need.

    Where a group has further blocks its first one is full, hence as high as these.
    """
    height = LEVELS
    if first:
        height = next(h for h in range(LEVELS + 1) if FAN**h >= len(digests))
    paths: list[list[bytes]] = [[] for _ in digests]
    return walk(digests, 0, len(digests), height, paths), [b"".join(p) for p in paths]


def traversed(nodes: DataFrame) -> DataFrame:
    """Nodes (grp, pos, digest, ...) with block, path within it and, on the block's first node, its root (``top``)."""
    rows = nodes.withColumn("block", F.floor(F.col("pos") / FAN**LEVELS).cast("long"))
    at = {n: rows.columns.index(n) for n in ("grp", "block", "digest")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(waiting)
            digests = [bytes.fromhex(d) for d in whole.column(at["digest"]).to_pylist()]
            top, paths = block_digest(digests, whole.column(at["block"])[0].as_py() == 0)
            tops = [top.hex()] + [None] * (len(digests) - 1)
            out = whole.append_column("path", pa.array(paths, pa.binary())).append_column("top", pa.array(tops, pa.string()))
            waiting.clear()
            yield from out.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            grp, block = batch.column(at["grp"]), batch.column(at["block"])
            new = pc.or_(pc.not_equal(grp[1:], grp[:-1]), pc.not_equal(block[1:], block[:-1]))
            bounds = [0, *(i + 1 for i in pc.indices_nonzero(new).to_pylist()), batch.num_rows]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if waiting and (waiting[0].column(at["grp"])[0] != grp[a] or waiting[0].column(at["block"])[0] != block[a]):
                    yield from done()
                waiting.append(batch.slice(a, b - a))
        if waiting:
            yield from done()

    schema = StructType([*rows.schema, StructField("path", BinaryType()), StructField("top", StringType())])
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos").mapInArrow(run, schema)


def climbed(nodes: DataFrame, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Nodes with their path to the last root, and the subroot and root that ``finish`` gives for the groups' tops.

    ``finish`` takes (grp, pos, digest) with a row for each group and adds path, subroot and root.
    """
    rows = cut(traversed(nodes))
    tops = rows.where("top IS NOT NULL").select("grp", F.col("block").alias("pos"), F.col("top").alias("digest"))
    upper = finish(tops) if tops.where("pos > 0").isEmpty() else climbed(tops, finish)
    upper = upper.select("grp", F.col("pos").alias("block"), F.col("path").alias("_above"), "subroot", "root")
    return rows.drop("top").join(upper, ["grp", "block"]).withColumn("path", F.concat("path", "_above")).drop("block", "_above")


def manifest(leaves: DataFrame, *order: str) -> DataFrame:
    """Leaves (grp, digest as hex, ...) with ``path``, ``subroot`` and ``root``, in the order of ``order`` and then digest.

    ``grp`` comes from group_key(). The path holds for each level, from the leaf
    to the root of all groups, the node's place and its siblings' digests. Other
    columns are carried along; their names must differ from grp, pos, block,
    path, subroot, root, top and those that begin with an underscore. An empty
    table has no rows. Rows alike in order and digest are leaves each; which of
    them gets which place doesn't matter, as they are equal.
    """

    def whole(tops: DataFrame) -> DataFrame:
        return tops.select("grp", "pos", F.lit(b"").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))

    def over_groups(tops: DataFrame) -> DataFrame:
        nodes = numbered(tops.select(F.lit("").alias("grp"), F.col("grp").alias("_own"), "digest"), "_own")
        rows = climbed(nodes, whole)
        return rows.select(F.col("_own").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")

    return climbed(numbered(leaves, *order, "digest"), over_groups).drop("pos")


def folded(rows: DataFrame, start: str = "digest") -> DataFrame:
    """Rows of manifest() with ``proof_sha256``, of all their siblings, and ``folded_root``, from ``start`` up the path."""
    at, path_at = rows.columns.index(start), rows.columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proofs, roots = [], []
            for digest, path in zip(batch.column(at).to_pylist(), batch.column(path_at).to_pylist(), strict=True):
                siblings, i = [], 0
                while i < len(path):
                    k, n = path[i], path[i + 1]
                    text, i = path[i + 2 : i + 2 + 32 * n].hex(), i + 2 + 32 * n
                    siblings.append(text)
                    digest = sha256((text[: 64 * k] + digest + text[64 * k :]).encode()).hexdigest()
                proofs.append(sha256("".join(siblings).encode()).hexdigest())
                roots.append(digest)
            arrays = [*batch.columns, pa.array(proofs, pa.string()), pa.array(roots, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "proof_sha256", "folded_root"])

    schema = StructType([*rows.schema, StructField("proof_sha256", StringType()), StructField("folded_root", StringType())])
    return rows.mapInArrow(run, schema)


def tampered(docs: DataFrame) -> DataFrame:
    """doc_id, group, leaf and the leaf after the query's tampering, for each document.

    Where 3 divides the checksum of doc_id the text is in lower case; a document
    without an id or a text is left alone. Other columns are ignored.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    columns = {f: F.col(f) for f in FIELDS}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    digest = leaf(*columns.values())
    return docs.select("doc_id", group_key(F.col("lang")).alias("grp"), digest.alias("digest"), F.when(hit, leaf(*(columns | {"text": lower}).values())).otherwise(digest).alias("start"))


def verified(docs: DataFrame) -> DataFrame:
    """A row for each document: its leaf, the roots, its proof's checksum, and the root that its tampered text leads to.

    Nulls are dashes in a leaf and the first group; empty texts have the length
    0; texts are hashed whole in the JVM, however long. Documents of one id
    follow each other by leaf, and equal rows give equal leaves. An empty table
    gives no rows; further columns don't enter a leaf.
    """
    rows = folded(manifest(tampered(docs), "doc_id"), "start")
    return rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(table(spark, sf_dir, "documents"))


#: Checksums come from a table of 256 remainders; trees and folds are recursive.
ORACLE = r"""WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), d AS (
  SELECT *, row_number() OVER () AS rid, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)) AS state FROM documents, crc
), lf AS (
  SELECT rid, doc_id, coalesce('1' || lang, '0') AS grp, (4294967295 - state) % 3 = 0 AS hit,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low FROM d
), lv AS (
  SELECT rid, doc_id, grp, sha256(head || body) AS leaf, sha256(head || CASE WHEN hit THEN low ELSE body END) AS start FROM lf
), ps AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos FROM lv), up AS (
  SELECT grp, 0 AS level, pos, leaf AS digest FROM ps
  UNION ALL
  SELECT grp, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM up) WHERE n > 1 GROUP BY grp, level, pos // 8
), sub AS (SELECT grp, max(level) AS depth, arg_max(digest, level) AS subroot FROM up GROUP BY 1), gp AS (
  SELECT grp, subroot, depth, row_number() OVER (ORDER BY grp) - 1 AS gpos FROM sub
), top AS (
  SELECT 0 AS level, gpos AS pos, subroot AS digest FROM gp
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY level, pos // 8
), rt AS (SELECT max(level) AS height, arg_max(digest, level) AS root FROM top), nodes AS (
  SELECT u.grp, u.level, u.pos, u.digest FROM up u JOIN gp g ON u.grp = g.grp WHERE u.level < g.depth
  UNION ALL
  SELECT g.grp, g.depth + t.level, t.pos, t.digest FROM gp g, top t, rt WHERE t.level < rt.height
), step AS (SELECT p.rid, p.grp, p.pos, g.gpos, g.depth, g.depth + rt.height AS last, p.start FROM ps p JOIN gp g ON p.grp = g.grp, rt), fo AS (
  SELECT rid, grp, pos AS here, gpos, depth, last, 0 AS level, start AS digest, '' AS proof FROM step
  UNION ALL
  SELECT f.rid, f.grp, CASE WHEN f.level + 1 = f.depth THEN f.gpos ELSE f.here // 8 END, f.gpos, f.depth, f.last, f.level + 1,
    sha256(string_agg(CASE WHEN n.pos = f.here THEN f.digest ELSE n.digest END, '' ORDER BY n.pos)), f.proof || coalesce(string_agg(CASE WHEN n.pos <> f.here THEN n.digest END, '' ORDER BY n.pos), '')
  FROM (SELECT rid, grp, CASE WHEN level = depth THEN gpos ELSE here END AS here, gpos, depth, last, level, digest, proof FROM fo) f JOIN nodes n ON n.grp = f.grp AND n.level = f.level AND n.pos // 8 = f.here // 8
  WHERE f.level < f.last GROUP BY f.rid, f.grp, f.here, f.gpos, f.depth, f.last, f.level, f.digest, f.proof
)
SELECT p.doc_id, p.leaf, g.subroot, rt.root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root, f.digest = rt.root AS verified
FROM fo f JOIN ps p ON f.rid = p.rid JOIN gp g ON p.grp = g.grp, rt WHERE f.level = f.last"""
