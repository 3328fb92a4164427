"""A Merkle manifest of a table: a leaf per row, a 16-ary tree per source, one root, and a proof per row.

Leaves are dealt in superblocks of ``SPAN`` consecutive ones of a source. Every
superblock is reduced to one node; these nodes are the leaves of the tree above,
which is dealt in superblocks in the same way, up to the subroots of the
sources, which again are the leaves of a tree of one group. On the way back the
outer nodes of every superblock, one row of what stands to the left and to the
right of its top on each level up to the root, are cogrouped with its leaves: one
pass per superblock joins the proofs, and folds each leaf to the root. No task
holds more than a superblock, and a source that holds a third of the rows is as
many superblocks as its rows ask for.

Results for odd rows: any field may be null (its input is ``-``); a null source
comes first, a null doc_id first in its source; rows of equal doc_id stand by
their leaf, and repeated rows are leaves of their own; an empty text is ``0:``; texts of any length are digested
whole where they lie; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import places
from .reference_sql import crc32_sql
from .shared import stored

ARITY = 16
SPAN = ARITY**3
TAMPERED = 5  # documents of which one in so many is tampered with
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def joined_digest(texts: list[str]) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    """The digest of a row: ``-`` or byte count, colon and value of each field."""
    told = [F.coalesce(F.concat(F.octet_length(c), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*told), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (of the source, never null, in the order of sources), node (the leaf), tampered (null where nothing is tampered with)."""
    fields = {c: F.col(c) for c in FIELDS}
    low = fields | {"text": F.translate(F.col("text").cast("string"), UPPER, LOWER)}
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("tree"),
        leaf_of(list(fields.values())).alias("node"),
        F.when(struck, leaf_of(list(low.values()))).alias("tampered"),
    )


def levels(count: int) -> int:
    """How often ``count`` nodes are reduced until one is left."""
    n = 0
    while count > 1:
        count, n = -(-count // ARITY), n + 1
    return n


def reduced(nodes: list[str], times: int) -> list[list[str]]:
    """The nodes and, level by level, what they are reduced to."""
    out = [nodes]
    for _ in range(times):
        out.append([joined_digest(out[-1][i : i + ARITY]) for i in range(0, len(out[-1]), ARITY)])
    return out


def _within(block: pd.DataFrame) -> tuple[pd.DataFrame, list[list[str]]]:
    """The nodes of a superblock in order, and their levels in it: all of its own, or as many as a tree of one superblock has."""
    block = block.sort_values("place", ignore_index=True)
    alone = block["place"].iloc[0] < SPAN and len(block) < SPAN
    return block, reduced(block["node"].tolist(), levels(len(block) if alone else SPAN))


def siblings(rows: list[list[str]], i: int) -> Iterator[tuple[str, str]]:
    """What stands to the left and to the right of node i in its run, then of the node over it, up to the last level but one."""
    for level in rows[:-1]:
        lo = i // ARITY * ARITY
        yield "".join(level[lo:i]), "".join(level[i + 1 : lo + ARITY])
        i //= ARITY


OUTER = "tree string, block long, top string, left array<string>, right array<string>"


def superblock() -> Column:
    return F.expr(f"place div {SPAN}")


def tops(nodes: DataFrame) -> DataFrame:
    """The tree above superblocks; like ``nodes``: tree, place, node."""

    def top(block: pd.DataFrame) -> pd.DataFrame:
        block, rows = _within(block)
        return pd.DataFrame({"tree": block["tree"].iloc[:1], "place": [int(block["place"].iloc[0]) // SPAN], "node": rows[-1]})

    return nodes.select("tree", "place", "node").groupBy("tree", superblock()).applyInPandas(top, "tree string, place long, node string")


def outer_nodes(nodes: DataFrame) -> DataFrame:
    """``OUTER``: for each superblock of ``nodes`` the root of its tree, and the siblings of its top and of the nodes above."""
    above = stored(tops(nodes), "superblocks")
    if (above.agg(F.max("place")).first()[0] or 0) == 0:
        return above.select("tree", F.col("place").alias("block"), F.col("node").alias("top"), *[F.array().cast("array<string>").alias(c) for c in ("left", "right")])
    return proofs(above, outer_nodes(above)).select("tree", F.col("place").alias("block"), "top", "left", "right")


def proofs(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """tree, place, top, left, right of every node; outer: ``outer_nodes`` of the same nodes."""

    def prove(block: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        block, rows = _within(block)
        left, right = over["left"].iloc[0].tolist(), over["right"].iloc[0].tolist()
        own = [list(siblings(rows, i)) for i in range(len(block))]
        pairs = {"left": [[a for a, _ in x] + left for x in own], "right": [[b for _, b in x] + right for x in own]}
        return block[["tree", "place"]].assign(top=over["top"].iloc[0], **pairs)

    return stored(nodes.groupBy("tree", superblock()).cogroup(outer.groupBy("tree", "block")).applyInPandas(prove, "tree string, place long, top string, left array<string>, right array<string>"), "proofs")


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    rows = places(stored(leaves(docs), "leaves"), "tree", [F.col("doc_id").asc_nulls_first(), "node"])
    outer = stored(outer_nodes(rows), "outer")
    # the sources' roots are the leaves of a tree of their own
    subroots = outer.filter("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("top").alias("node"))
    subroots = stored(places(subroots, "tree", ["source"]), "subroots")
    further = subroots.join(proofs(subroots.drop("source"), outer_nodes(subroots)).drop("tree"), "place")
    further = further.select(F.col("source").alias("tree"), F.col("top").alias("root"), F.col("left").alias("more_left"), F.col("right").alias("more_right"))
    outer = outer.join(further, "tree").select("tree", "block", "top", "root", F.concat("left", "more_left").alias("left"), F.concat("right", "more_right").alias("right"))

    def fold(block: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        block, rows = _within(block)
        around = list(zip(over["left"].iloc[0], over["right"].iloc[0]))
        top, root = over["top"].iloc[0], over["root"].iloc[0]
        proof, folded = [], []
        for i, (own, changed) in enumerate(zip(block["node"], block["tampered"])):
            path = [*siblings(rows, i), *around]
            proof.append(joined_digest([x for pair in path for x in pair]))
            node = changed or own
            for left, right in path:
                node = joined_digest([left, node, right])
            folded.append(node)
        out = block[["doc_id"]].assign(leaf=block["node"], subroot=top, root=root, proof_sha256=proof, folded_root=folded)
        return out.assign(verified=out["folded_root"] == root)

    # a decimal id, for pandas has no longs beside nulls
    sent = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    done = sent.groupBy("tree", superblock()).cogroup(outer.groupBy("tree", "block")).applyInPandas(fold, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle(depth: int = 6) -> str:
    """SQL for trees of up to 16^depth leaves: levels of runs, once within sources and once over them."""

    def field(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    def tree(name: str, source: str) -> str:
        """{name}_up: of each leaf its tree's root and, by level, what stands to its left and right; source: t (tree), p (place), h."""
        out = [f"{name}0 AS (SELECT t, p, h, count(*) OVER (PARTITION BY t) AS n, p AS q, h AS top, []::VARCHAR[] AS l, []::VARCHAR[] AS r FROM {source})"]
        for k in range(depth):
            v = f"{name}{k}"
            out.append(f"{v}n AS (SELECT t, q, any_value(top) AS h, any_value(n) AS n FROM {v} GROUP BY t, q)")
            out.append(
                f"{v}s AS (SELECT t, q, n, h, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, "
                f"coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {v}n WINDOW w AS (PARTITION BY t, q // {ARITY} ORDER BY q))"
            )
            out.append(
                f"{name}{k + 1} AS (SELECT x.t, p, x.h, (x.n + {ARITY - 1}) // {ARITY} AS n, CASE WHEN x.n > 1 THEN x.q // {ARITY} ELSE x.q END AS q, "
                f"CASE WHEN x.n > 1 THEN sha256(a || s.h || b) ELSE x.top END AS top, CASE WHEN x.n > 1 THEN list_append(l, a) ELSE l END AS l, "
                f"CASE WHEN x.n > 1 THEN list_append(r, b) ELSE r END AS r FROM {v} x JOIN {v}s s ON s.t = x.t AND s.q = x.q)"
            )
        return ", ".join([*out, f"{name}_up AS (SELECT * FROM {name}{depth})"])

    low = f"translate(text, '{UPPER}', '{LOWER}')"
    whole, changed = (" || ".join(field(c if c != "text" else x) for c in FIELDS) for x in ("text", low))
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '-') AS t, sha256({whole}) AS h,
  CASE WHEN {crc32_sql("doc_id::VARCHAR")} % {TAMPERED} = 0 THEN sha256({changed}) END AS c FROM documents),
i AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS p FROM d),
{tree("a", "i")},
u AS (SELECT t, any_value(top) AS h FROM a_up GROUP BY t),
j AS (SELECT '' AS t, t AS source, h, row_number() OVER (ORDER BY t) - 1 AS p FROM u),
{tree("b", "j")},
f AS (SELECT i.doc_id, i.h AS leaf, a_up.top AS subroot, b_up.top AS root, coalesce(i.c, i.h) AS start, list_concat(a_up.l, b_up.l) AS l, list_concat(a_up.r, b_up.r) AS r
  FROM i JOIN a_up ON a_up.t = i.t AND a_up.p = i.p JOIN j ON j.source = i.t JOIN b_up ON b_up.p = j.p),
g AS (SELECT *, list_reduce(list_concat([start], list_transform(list_zip(l, r), lambda x: x[1] || '|' || x[2])),
  lambda v, x: sha256(split_part(x, '|', 1) || v || split_part(x, '|', 2))) AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(list_reduce(list_concat([''], list_transform(list_zip(l, r), lambda x: x[1] || x[2])), lambda v, x: v || x)) AS proof_sha256,
       folded_root, folded_root = root AS verified FROM g
"""


OP12_SQL = _oracle()
