"""The prefix trie against plain Python: odd rows, long conversations, hot turns."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from hazardspark.llm.trie import BASE, digest, ends_digests, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Every node by its whole prefix."""
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            code = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, code, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = tuple(own.get(base, [])[:h] + v[h:])
    nodes: dict = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], set()).add(c)
    under: dict = {}
    for path in nodes:
        for d in range(len(path) + 1):
            under.setdefault(path[:d], []).append(path)
    children: dict = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    out = []
    for path, convs in nodes.items():
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in under[path] if p)
        leaves = sum(p not in children for p in under[path])
        ends = ",".join(map(str, sorted(c for c in convs if len(rebuilt[c]) == len(path))))
        up = min(nodes[path[:-1]]) if path else None
        out.append((min(convs), len(path), up, len(convs), len(children.get(path, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, parts=3):
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = []
    for c in rng.sample(range(0, 400), 90):
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "yes", "nö", ""])) for t in range(rng.randint(1, 9))]
    rng.shuffle(rows)
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(100, None, None, None), (100, 1, "user", None), (100, 1, None, "a"), (100, 1, None, "a"), (None, 1, "user", "lost"), (None, None, None, None)]
    rows += [(-7, 2, "user", "🙂"), (-100, 0, "user", "x"), (-107, 0, "", "x"), (101, 5, "user", "x"), (103, -2, "a:", "b"), (103, -3, "a", ":b"), (9_000_000_000_000_000_123, 1, "user", "big")]
    rows += [(c, 0, "user", "same") for c in range(200, 300)]
    check(spark, rows)
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("d", "code", "name", "parent", "chars", "j", "turns", "names", "saved")})
    assert sorted(map(tuple, prefix_trie(clash).collect()), key=repr) == plain(rows)
    assert prefix_trie(clash.limit(0)).count() == 0
    assert prefix_trie(clash.filter("conv_id is null")).count() == 0


def test_long_conversations(spark):
    """Heights on both sides of the cuts, long copies that part late, and a very long text."""
    rng = random.Random(8)
    base = [("user", rng.choice("ab")) for _ in range(75)]
    rows = []
    for c, n in enumerate((1, BASE - 1, BASE, BASE + 1, 2 * BASE, 2 * BASE + 1, 31, 33, 64, 65, 75, 75, 75), 1):
        path = base[:n] if c % 2 else base[: n - 1] + [("user", "other")]
        rows += [(c * 1000, t, r, x) for t, (r, x) in enumerate(path)]
    rows += [(50_000, t, "user", "z" * 300_000 if t == 3 else "q") for t in range(40)]
    check(spark, rows)


def test_lists_of_any_length_are_hashed_in_pieces(spark):
    ids = [i * 977 for i in range(20_000)]
    node = digest(F.lit("n"))
    ends = spark.range(20_000).select(F.lit(3).cast("long").alias("d"), node.alias("name"), (F.col("id") * 977).alias("conv_id"))
    ends = ends.unionByName(spark.range(2).select(F.lit(3).cast("long").alias("d"), digest(F.lit("o")).alias("name"), F.col("id").alias("conv_id")))
    got = {r.ends_sha256 for r in ends_digests(ends.repartition(7)).collect()}
    assert got == {hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in (ids, [0, 1])}
