"""The Merkle manifest against plain recursion."""

import hashlib
import random
import zlib

from quarry.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def climb(tree, at, digest):
    """Siblings from the leaf to the tree's root, and the root from ``digest``."""
    siblings = []
    for nodes in tree[:-1]:
        run = list(nodes[at // 8 * 8 : at // 8 * 8 + 8])
        siblings += run[: at % 8] + run[at % 8 + 1 :]
        run[at % 8] = digest
        digest, at = h(*run), at // 8
    return siblings, digest


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, text, lang, source, n_chars)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for i, text, lang, source, n in rows:
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        start = leaf((i, source, lang, n, text.translate(low) if hit and text is not None else text))
        groups.setdefault(lang, []).append((i, leaf((i, source, lang, n, text)), start))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {g: levels([x[1] for x in groups[g]]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for at, (i, digest, start) in enumerate(groups[g]):
            below, folded = climb(trees[g], at, start)
            above, folded = climb(top, k, folded)
            root = top[-1][0]
            out.append((i, digest, trees[g][-1][0], root, h(*below, *above), folded, folded == root))
    return out


def got(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, pos string, digest long")
    out = manifest.verified(docs)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in out.collect()]


def key(row):
    return tuple(str(v) for v in row)


def test_edges(spark):
    rows = [(i, f"Text {i} É", "en", "a", i) for i in range(75)]
    rows += [(None, None, None, None, None), (None, "A", None, None, 3), (1, "", "", "b", 0), (2, "AB" * 50_000, "zz", None, None)]
    rows += [(7, "Same", "de", "s", 4)] * 11  # repeated rows
    rows += [(7, "Other", "de", "s", 4), (-3, "Minus", "de", "s", 4)]  # one id, two texts
    assert sorted(got(spark, rows), key=key) == sorted(plain(rows), key=key)
    assert got(spark, []) == []
    one = [(5, "Only One", "en", "s", 1)]
    assert got(spark, one) == plain(one) and got(spark, one)[0][2] == got(spark, one)[0][1]


def test_many_blocks_and_groups(spark):
    rng = random.Random(3)
    rows = [(i, f"T{rng.random()}", "en", "s", i) for i in range(4096 + 8 * 512 + 1)]  # three blocks, the last of one leaf
    rows += [(i, "x", f"g{i % 70}", "s", i) for i in range(200)]
    rng.shuffle(rows)
    assert sorted(got(spark, rows), key=key) == sorted(plain(rows), key=key)
