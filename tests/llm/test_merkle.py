"""The manifest against plain Python: odd rows, many sources, sources of several superblocks."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from hazardspark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    doc, text, lang, source, n = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def climb(nodes):
    """Root, and of each node the (left, right) siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            lo = p // 16 * 16
            paths[i].append((nodes[lo:p], nodes[p + 1 : lo + 16]))
        at = [p // 16 for p in at]
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain(rows):
    trees: dict = {}
    for r in rows:
        trees.setdefault((r[3] is not None, (r[3] or "").encode()), []).append(r)
    order = sorted(trees)
    built = []
    for t in order:
        own = sorted(trees[t], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built.append((own, *climb([leaf(r) for r in own])))
    root, above = climb([b[1] for b in built])
    out = []
    for (own, subroot, paths), over in zip(built, above):
        for r, path in zip(own, paths):
            path = path + over
            struck = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf(r, struck)
            for left, right in path:
                node = H(*left, node, *right)
            out.append((r[0], leaf(r), subroot, root, H(*(x for a, b in path for x in (*a, *b))), node, node == root))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, merkle.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def rows(seed=2, n=700):
    rng = random.Random(seed)
    text = lambda: rng.choice(["", "Abc DEF", "ünïcode ÀÉ", "lower only", "x" * rng.randint(0, 50)]) + str(rng.randint(0, 9))
    out = [(i * 3, text(), rng.choice(["en", "de", None]), rng.choice(["hot"] * 12 + ["a", "ä", "Z", "", None, "two words"]), rng.randint(0, 9)) for i in range(n)]
    out += [(None, "no ID", "en", "hot", None), (None, None, None, None, None), (5, "ONE source", "en", "alone", 1)]
    return out + [out[7], out[7], (out[8][0], "OTHER text", *out[8][2:]), (20, "LONG " * 200_000, "en", "hot", 3), (25, None, "en", "hot", 0)]


def test_manifest(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert got(df) == plain(data)
    clash = df.withColumns({c: F.lit("clash") for c in ("tree", "place", "node", "tampered", "leaf", "root", "block", "top", "left", "right")})
    assert got(clash) == plain(data)
    assert merkle.manifest(clash.limit(0)).count() == 0
    one = [(1, "Just ONE", "en", "s", 3)]
    assert got(spark.createDataFrame(one, SCHEMA)) == plain(one)


def test_many_sources(spark):
    """More sources than a run of the tree over them holds."""
    data = [(i, f"T{i}", "en", f"s{i % 300}", i) for i in range(700)]
    assert got(spark.createDataFrame(data, SCHEMA)) == plain(data)


def test_many_superblocks(spark):
    """Sources of several superblocks, and of a superblock and one row."""
    span = merkle.SPAN
    data = [(i, f"Text {i % 50}", "en", "hot", i) for i in range(3 * span + 5)] + [(i, "x", "en", "edge", i) for i in range(span + 1)] + [(i, "x", "en", "full", i) for i in range(span)]
    assert got(spark.createDataFrame(data, SCHEMA)) == plain(data)


def test_levels():
    assert [merkle.levels(n) for n in (0, 1, 2, 16, 17, 256, 257, 4096, 4097)] == [0, 0, 1, 1, 2, 2, 3, 3, 4]
