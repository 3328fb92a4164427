"""The trie of conversation prefixes, by van Emde Boas recursion.

A sequence of turns is cut at half its height: the upper half belongs to the
upper trie, the lower one to a forest that hangs from the cut prefix. Both are
cut again, all at once, down to blocks of ``BASE`` turns, which one row holds.
So heights are BASE times powers of two, and the prefix of j blocks is named
from that of j - 2^k blocks (2^k the lowest bit of j) and the 2^k blocks behind
it. A name is the digest of these two, which come from one conversation, so
naming joins on (conversation, block): no conversation, and no first turn that
many share, meets in one task. It takes as many rounds as the binary logarithm
of the longest conversation.

Totals go upward by the same cuts: within a block each node has the total of
what lies below it in its block; a block of twice the height then adds the
totals of its lower forests, summed per cut node, to the cut node's ancestors in
its upper half.

Results for odd rows: turns stand by turn (null first), of equal turns by the
digest of their role and text; repeated rows are turns of their own; a null role
or text is empty; rows without conv_id take no part; a conversation of any
length and a text of any length are taken whole; c % 100 has the sign of c; other
columns are ignored; an empty table has no node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import places
from .reference_sql import crc32_sql
from .shared import n_parts, stored

SHARED = 100  # conversations c - c % SHARED lend their first turns
HEADS = 6
BASE = 8  # turns per row
CHUNK = 4_096  # ids per piece of a list that is hashed


def digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, d (from 1), code (a digest of role and text), chars: one row per turn, without its text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    code = digest(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), code.alias("code"), F.length(text("text")).cast("long").alias("chars"))
    return places(stored(rows, "turns"), "conv_id", [F.col("turn").asc_nulls_first(), "code"], "d").select("conv_id", (F.col("d") + 1).alias("d"), "code", "chars")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns after rebuilding, as ``turns``, and conv_id, length of every conversation, turnless ones too.

    The first h turns come from conversation c - c % 100, where it has so many;
    c's own follow from its turn h + 1 on; h is crc32 of c's decimal, modulo 6.
    """
    heads = own.groupBy("conv_id").agg(F.max("d").alias("n"), F.array_sort(F.collect_list(F.when(F.col("d") < HEADS, F.struct("d", "code", "chars")))).alias("heads"))
    c = F.col("conv_id")
    asks = heads.select("conv_id", "n", (c - c % SHARED).alias("base"), (F.crc32(c.cast("string").cast("binary")) % HEADS).cast("int").alias("h"))
    lent = asks.join(heads.select(F.col("conv_id").alias("base"), F.col("heads").alias("lent")), "base", "left")
    lent = lent.withColumn("lent", F.slice(F.coalesce("lent", F.array().cast(heads.schema["heads"].dataType)), F.lit(1), F.col("h")))
    lent = stored(lent.withColumn("taken", F.size("lent").cast("long")), "lent")
    first = lent.select("conv_id", F.explode("lent").alias("t")).select("conv_id", "t.d", "t.code", "t.chars")
    rest = own.join(lent.select("conv_id", "h", "taken"), "conv_id").filter("d > h").select("conv_id", (F.col("d") - F.col("h") + F.col("taken")).alias("d"), "code", "chars")
    lengths = lent.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return stored(first.unionByName(rest), "rebuilt"), lengths


def blocks_of(rows: DataFrame) -> DataFrame:
    """conv_id, j, turns (code and chars of turns BASE * j + 1 .. BASE * (j + 1), as far as there are)."""
    turn = F.struct("d", "code", "chars")
    return rows.groupBy("conv_id", F.expr(f"(d - 1) div {BASE}").alias("j")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def named(blocks: DataFrame, cuts: int) -> DataFrame:
    """conv_id, j, name: names of all prefixes of j whole blocks; the root's (j = 0) is empty."""
    whole = [blocks.filter(F.size("turns") == BASE).select("conv_id", "j", F.aggregate("turns", F.lit(b""), lambda acc, x: digest(acc, x["code"])).alias("block"))]
    for _ in range(cuts):
        pairs = whole[-1].groupBy("conv_id", F.shiftright("j", 1).alias("j")).agg(*[F.max(F.when(F.col("j") % 2 == i, F.col("block"))).alias(s) for i, s in enumerate("lr")])
        whole.append(stored(pairs.filter("l is not null and r is not null").select("conv_id", "j", digest(F.col("l"), F.col("r")).alias("block")), "blocks"))
    names = blocks.filter("j = 0").select("conv_id", "j", F.lit(b"").alias("name"))
    for k in range(cuts, -1, -1):
        upper = whole[k].filter(F.col("j") % 2 == 0).select("conv_id", F.shiftleft("j", k).alias("j"), "block")
        below = upper.join(names, ["conv_id", "j"]).select("conv_id", (F.col("j") + (1 << k)).alias("j"), digest(F.col("name"), F.col("block")).alias("name"))
        names = names.unionByName(below)
        if k:
            names = stored(names, "names")
    return names


def paths_of(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """``blocks`` with above (the name of the prefix before the block) and names (those of the prefixes that end in it)."""
    after = names.select("conv_id", (F.col("j") - 1).alias("j"), F.col("name").alias("last"))
    both = blocks.join(names.withColumnRenamed("name", "above"), ["conv_id", "j"]).join(after, ["conv_id", "j"], "left")
    inner = F.aggregate(F.slice("turns", 1, BASE - 1), F.array("above"), lambda acc, x: F.concat(acc, F.array(digest(F.element_at(acc, -1), x["code"]))))
    # the name that ends a whole block is the one from which the next block goes on
    own = F.concat(F.slice(inner, 2, BASE), F.when(F.col("last").isNotNull(), F.array("last")).otherwise(F.array().cast("array<binary>")))
    return both.select("conv_id", "j", "turns", "above", own.alias("names"))


TOTALS = ("n_leaves", "saved")


def grafted(nodes: DataFrame, paths: DataFrame, cuts: int) -> DataFrame:
    """d, name, parent, conv_id, n_leaves, saved: every node but the root with the totals of its subtree, from those of its own."""
    total = [F.sum(c).alias(c) for c in TOTALS]
    spot = F.expr(f"(d - 1) div {BASE}")

    def upward(own: DataFrame, name: str) -> DataFrame:
        fixed = [F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id")]
        return stored(own.groupBy("d", "name").agg(*fixed, *total), name)

    named = paths.select("conv_id", "j", "names")
    held = nodes.withColumn("j", spot).join(named, ["conv_id", "j"])
    low = F.expr(f"slice(names, 1, int(d - j * {BASE} - 1))")
    inside = held.select("j", F.posexplode(low).alias("i", "name"), *TOTALS).select((F.col("j") * BASE + F.col("i") + 1).alias("d"), "name", *TOTALS)
    have = upward(nodes.unionByName(inside, allowMissingColumns=True), "grafted")
    for k in range(cuts):
        half = 1 << k
        tops = have.filter(((F.col("d") - 1) % (2 * half * BASE)) == half * BASE)
        # the cut node, which ends block last, stands on the path of any member below it
        lower = tops.groupBy((F.expr(f"d div {BASE}") - 1).alias("last"), "parent").agg(F.min("conv_id").alias("conv_id"), *total)
        along = lower.select("conv_id", F.explode(F.sequence(F.col("last") - (half - 1), F.col("last"))).alias("j"), *TOTALS).join(named, ["conv_id", "j"])
        up = along.select("j", F.posexplode("names").alias("i", "name"), *TOTALS).select((F.col("j") * BASE + F.col("i") + 1).alias("d"), "name", *TOTALS)
        have = upward(have.unionByName(up, allowMissingColumns=True), "grafted")
    return have


def ends_digests(ends: DataFrame) -> DataFrame:
    """d, name, ends_sha256: of the conversations (d, name, conv_id) that end at a node, ascending, comma-joined.

    A list may be of any length: it is dealt by ranges into pieces of text, and
    one task then reads a node's pieces one after another.
    """
    spark = ends.sparkSession
    piece = "d long, name binary, first long, ids string"

    def cut(batches):
        for b in batches:
            if not b.num_rows:
                continue
            d, name, ids = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("d", "name", "conv_id"))
            bounds = [i for i in range(len(ids)) if i == 0 or (d[i], name[i]) != (d[i - 1], name[i - 1])] + [len(ids)]
            spans = [(lo, min(lo + CHUNK, z)) for a, z in zip(bounds, bounds[1:]) for lo in range(a, z, CHUNK)]
            yield pa.RecordBatch.from_pydict({
                "d": [d[a] for a, _ in spans], "name": pa.array([name[a] for a, _ in spans], pa.binary()), "first": [ids[a] for a, _ in spans],
                "ids": [",".join(map(str, ids[a:z])) for a, z in spans],
            })

    def joined(batches):
        node, hashed = None, None
        for b in batches:
            out = []
            for d, name, ids in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("d", "name", "ids")]):
                if (d, name) == node:
                    hashed.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, hashed.hexdigest()))
                node, hashed = (d, name), hashlib.sha256(ids.encode())
            yield _digests(out)
        if node is not None:
            yield _digests([(*node, hashed.hexdigest())])

    n = n_parts(spark)
    pieces = ends.repartitionByRange(n, "d", "name", "conv_id").sortWithinPartitions("d", "name", "conv_id").mapInArrow(cut, piece)
    return pieces.repartition(n, "d", "name").sortWithinPartitions("d", "name", "first").mapInArrow(joined, "d long, name binary, ends_sha256 string")


def _digests(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.string()))], ["d", "name", "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, lengths = rebuilt(turns(conversations))
    blocks = stored(blocks_of(rows), "turn-blocks")
    cuts = (blocks.agg(F.max("j")).first()[0] or 0).bit_length()
    paths = stored(paths_of(blocks, named(blocks, cuts)), "paths")
    before = F.concat(F.array("above"), F.slice("names", 1, BASE))
    each = paths.select("conv_id", "j", F.posexplode(F.arrays_zip(F.col("names").alias("name"), F.slice(before, 1, F.size("names")).alias("parent"), F.col("turns.chars").alias("chars"))).alias("i", "x"))
    steps = each.select("conv_id", (F.col("j") * BASE + F.col("i") + 1).alias("d"), "x.*")
    nodes = steps.groupBy("d", "name").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("parent").alias("parent"), F.max("chars").alias("chars"))
    nodes = stored(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")).drop("chars"), "nodes")
    born = nodes.groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(born, ["d", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    own = nodes.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
    totals = grafted(own.select("d", "name", "parent", "conv_id", *TOTALS), paths, cuts)
    at_root = totals.filter("d = 1").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.count(F.lit(1)).alias("n_children"))
    everyone = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    top = everyone.unionByName(at_root, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("conv_id", "n_convs", "n_leaves", "saved", "n_children")])
    root = top.filter("n_convs is not null").select(
        F.lit(0).cast("long").alias("d"), F.lit(b"").alias("name"), "conv_id", "n_convs", F.lit(None).cast("binary").alias("parent"),
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.greatest(F.coalesce("n_leaves", F.lit(0)), F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved"),
    )
    every = nodes.drop("saved").join(totals.select("d", "name", *TOTALS), ["d", "name"]).unionByName(root)
    stops = lengths.filter("length > 0").select("conv_id", F.col("length").alias("d"), F.expr(f"(length - 1) div {BASE}").alias("j"))
    stops = stops.join(paths.select("conv_id", "j", "names"), ["conv_id", "j"]).select("d", F.element_at("names", -1).alias("name"), "conv_id")
    stops = stops.unionByName(lengths.filter("length = 0").select(F.lit(0).cast("long").alias("d"), F.lit(b"").alias("name"), "conv_id"))
    every = stored(every.join(ends_digests(stored(stops, "stops")), ["d", "name"], "left"), "trie")
    over = every.select((F.col("d") + 1).alias("d"), F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return every.join(over, ["d", "parent"], "left").select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP11_SQL = f"""
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS d
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 100 AS base, {crc32_sql("c::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT c FROM o)),
a AS (SELECT h.c, o.d, o.r, o.t FROM h JOIN o ON o.c = base AND o.d <= h),
m AS (SELECT c, count(*) AS m FROM a GROUP BY c),
b AS (SELECT * FROM a UNION ALL SELECT o.c, o.d - h + coalesce(m, 0), o.r, o.t FROM o JOIN h USING (c) LEFT JOIN m USING (c) WHERE o.d > h),
p0 AS (SELECT c, d, length(t) AS chars, sha256(array_to_string(list(strlen(r) || ':' || strlen(t) || ':' || r || t) OVER (PARTITION BY c ORDER BY d), '')) AS k FROM b),
p AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY c ORDER BY d), '') AS up FROM p0
      UNION ALL SELECT c, 0, 0, '', NULL FROM h),
e AS (SELECT d, k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends_sha256 FROM p JOIN (SELECT c, max(d) AS d FROM p GROUP BY c) USING (c, d) GROUP BY d, k),
n AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(up) AS up, (count(*) - 1) * any_value(chars) AS saved FROM p GROUP BY d, k),
f AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY d, up),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN f USING (d, k)),
s AS (SELECT p.d, p.k, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM w JOIN p ON p.c = w.conv_id AND p.d <= w.d GROUP BY p.d, p.k)
SELECT w.conv_id, w.d::BIGINT AS depth, u.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM w JOIN s USING (d, k) LEFT JOIN e USING (d, k) LEFT JOIN n u ON u.d = w.d - 1 AND u.k = w.up
"""
