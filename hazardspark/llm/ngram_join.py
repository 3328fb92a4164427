"""N-gram Jaccard self-join: a blocked sparse product of the document by n-gram incidence.

The product's columns are thinned by size-derived bounds before any pair is
formed. A document of n n-grams that is similar to another shares one of the
n - ceil(t n) + 1 n-grams that come first in any order common to all documents,
so only these columns count. The order is by frequency: n-grams of the lowest
hashes (``REGION`` of all) are counted over the corpus, those of one document
come first and can match nothing, so a document with enough of them has no
partner at all and sends nothing on.

What is left is multiplied in blocks. Documents with equal sets are one row of
the matrix. Columns are grouped by their leader, the document in them with the
most common n-grams, so the many columns that a group of near copies shares
become one group of rows; two documents that share a column are in its group.
The members of a group are first multiplied with its leader alone. Two members
that both link with it need no more; members that do not are multiplied with
the whole group, in blocks of bounded size: a block's sets move as one packed
row, and two blocks meet only if their sizes are close enough for a link. A
product accumulates the overlap of every two documents of its blocks and returns
no more links than join what it found to be linked. No candidate pair is ever a
row.

What many documents hold is gathered before it moves: an n-gram that is common
among the documents of one task is reported once by that task, and a column
moves as one row per part of documents, with the part's own leader.

Results for odd rows: a null or empty text has no n-grams and links with
nothing; a null doc_id takes no part and has a null component; rows that repeat
a doc_id are one document, whose links are those of all its texts; a text of any
length is read whole, in one task; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Chunk, Words, chunks, mix, numbered, prefix_sums, ragged_arange, span_hash, word_hashes, words
from .components import components
from .runs import FLUSH_BYTES, PACKED, Rows, batch, by_part, of_kind, pack, passed_on, short, table, unpack, unpack_all
from .shared import dealt, dealt_np, part_count, stored, with_nulls

REGION = int(0.3 * (1 << 64))
RARE = 4  # n-grams in fewer than 2**(RARE + 1) documents come before those whose frequency isn't counted
COMMON = 8  # n-grams in so many documents of one task are taken as common without counting on
COMMON_LEVEL = 63
FLAGS, COUNTED, HEARD, REPS = range(10, 14)  # kinds of packed rows
FLAG = (np.int64, 5, np.int32, np.uint8)  # doc, n-gram, its bucket, level


def shingle_sets(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct n-gram of each document, sorted by row and hash."""
    w: Words = words(chunk)
    tokens = word_hashes(chunk, w, lower=True)
    n = np.diff(w.first)
    count = np.where(n == 0, 0, np.maximum(1, n - size + 1))
    row = np.repeat(np.arange(len(n)), count)
    before = np.cumsum(count) - count
    start = w.first[:-1][row] + np.arange(len(row)) - before[row]
    sums = prefix_sums(tokens, second=True)
    value = span_hash(sums, start, np.minimum(start + size, w.first[1:][row]), second=True)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _signatures(size: int):
    def run(batches):
        for b in batches:
            doc_id, b = numbered(b)
            for chunk in chunks(b):
                row, value = shingle_sets(chunk, size)
                cuts = np.searchsorted(row, np.arange(len(chunk.doc) + 1))
                total = lambda x: (c := np.append(np.uint64(0), np.cumsum(x, dtype=np.uint64)))[cuts[1:]] - c[cuts[:-1]]
                one, two = total(mix(value)), total(mix(value ^ np.uint64(0xA0761D6478BD642F)))
                out = {"doc_id": doc_id.take(pa.array(chunk.doc)), "n_shingles": np.diff(cuts), "sig_a": one.view(np.int64), "sig_b": two.view(np.int64)}
                yield from pa.table(out).to_batches()

    return run


def _levels(value: np.ndarray, n_parts: int) -> np.ndarray:
    return ((value >> np.uint64(40)) % np.uint64(n_parts)).astype(np.int32)


def _count_low(size: int, n_parts: int):
    """Packed n-grams of the counted region, for the buckets that count them; of common ones, past them, what their documents are to know."""

    def run(batches):
        have, weight = [], 0

        def flush():
            value, doc = (np.concatenate(x) for x in zip(*have))
            order = np.argsort(value, kind="stable")
            value, doc = value[order], doc[order]
            new = np.ones(len(value), bool)
            new[1:] = value[1:] != value[:-1]
            many = np.bincount(np.cumsum(new) - 1, minlength=1)[np.cumsum(new) - 1] if len(value) else np.zeros(0, np.int64)
            common = many >= COMMON
            v, d = value[common], doc[common]
            told = [d, short(v, 5), _levels(v, n_parts), np.full(len(v), COMMON_LEVEL, np.uint8)]
            rows: Rows = [(n_parts + p, FLAGS, pack(*c)) for p, c in by_part(dealt_np(d, n_parts), told)]
            heard = value[common & new]
            rows += [(p, HEARD, pack(short(v, 5))) for p, (v,) in by_part(_levels(heard, n_parts), [heard])]
            value, doc = value[~common], doc[~common]
            return batch(rows + [(p, COUNTED, pack(short(v, 5), d)) for p, (v, d) in by_part(_levels(value, n_parts), [value, doc])])

        for b in batches:
            for chunk in chunks(b):
                row, value = shingle_sets(chunk, size)
                low = value < np.uint64(REGION)
                have.append((value[low], chunk.doc[row[low]]))
                weight += len(chunk.data)
                if weight >= FLUSH_BYTES:
                    yield flush()
                    have, weight = [], 0
        if have:
            yield flush()

    return run


def _frequencies(n_parts: int):
    """For one bucket: the n-grams of two documents or more, with the log of their frequency, for these documents."""

    def run(key, t):
        part = key[0].as_py()
        if part >= n_parts:
            return passed_on(t, part - n_parts)
        value, doc = unpack_all(of_kind(t, COUNTED), 5, np.int64)
        (heard,) = unpack_all(of_kind(t, HEARD), 5)
        order = np.argsort(value, kind="stable")
        value, doc = value[order], doc[order]
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        group = np.cumsum(new) - 1
        many = np.bincount(group, minlength=1)[group] if len(value) else np.zeros(0, np.int64)
        common = np.isin(value, heard)
        keep = (many > 1) | common
        level = np.where(common, COMMON_LEVEL, np.log2(np.maximum(1, many))).astype(np.uint8)
        value, doc, level = value[keep], doc[keep], level[keep]
        own = [doc, short(value, 5), np.full(len(value), part, np.int32), level]
        return table([(p, FLAGS, pack(*c)) for p, c in by_part(dealt_np(doc, n_parts), own)])

    return run


SALTS = 16  # ways in which the members of a group are dealt when they learn how many blocks it has
BLOCK = 512  # members of a block at most, about
BLOCK_GRAMS = 1 << 18  # n-grams of the sets in a block, about
COLUMNS = "value long, n int, leader long, score double, docs binary, grams binary"


def _postings(size: int, percent: int, n_parts: int):
    """For documents that may have partners: the n-grams that a partner must share one of, with their documents here, and the whole sets (n = 0)."""

    def run(key, docs, found):
        reps = np.unique(found.column("rep").drop_null().to_numpy())
        doc, value, bucket, level = unpack_all(of_kind(found, FLAGS), *FLAG)
        key48 = (bucket.astype(np.uint64) << np.uint64(40)) | value
        order = np.lexsort((key48, doc))
        doc, key48, level = doc[order], key48[order], level[order]
        held: list[tuple] = []
        sets: list[tuple[int, bytes]] = []
        seen: set = set()
        for chunk in chunks(docs.filter(pa.array(np.isin(docs.column("doc_id").to_numpy(), reps))).select(["doc_id", "text"]).combine_chunks()):
            row, gram = shingle_sets(chunk, size)
            cuts = np.searchsorted(row, np.arange(len(chunk.doc) + 1))
            lo, hi = np.searchsorted(doc, chunk.doc), np.searchsorted(doc, chunk.doc, "right")
            for i, d in enumerate(chunk.doc.tolist()):
                own = gram[cuts[i] : cuts[i + 1]]
                n = len(own)
                name = (d, n, int(np.bitwise_xor.reduce(mix(own))) if n else 0)
                if not n or name in seen:  # repeated rows
                    continue
                seen.add(name)
                prefix = n - -(-percent * n // 100) + 1
                low = own < np.uint64(REGION)
                a, b = lo[i], hi[i]  # none: all its counted n-grams are its own
                known, df = np.zeros(n, bool), np.zeros(n, np.int64)
                if b > a:
                    k = (_levels(own, n_parts).astype(np.uint64) << np.uint64(40)) | (own & np.uint64((1 << 40) - 1))
                    spot = np.minimum(np.searchsorted(key48[a:b], k), b - a - 1)
                    known = low & (key48[a:b][spot] == k)
                    df = level[a:b][spot].astype(np.int64)
                if np.count_nonzero(low & ~known) >= prefix:
                    continue
                rank = np.where(~low, RARE + 1, np.where(~known, 0, np.where(df <= RARE, df, df + 1)))
                first = np.lexsort((own, rank))[:prefix]
                v = own[first[rank[first] > 0]]
                held.append((v.view(np.int64), np.full(len(v), d), np.full(len(v), df[known].sum() / max(1, np.count_nonzero(low)))))
                sets.append((d, short(own, 6).tobytes()))
        value, doc, score = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((doc, -score, value))
        value, doc, score = value[order], doc[order], score[order]
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        at = np.flatnonzero(new)
        many = np.diff(np.append(at, len(value)))
        raw = doc.astype("<i8").tobytes()
        lists = [raw[8 * a : 8 * (a + m)] if m > 1 else None for a, m in zip(at.tolist(), many.tolist())]
        k = len(sets)
        return pa.table(
            {
                "value": pa.array(np.append(value[at], np.zeros(k, np.int64))),
                "n": pa.array(np.append(many, np.zeros(k)).astype(np.int32)),
                "leader": pa.array(np.append(doc[at], np.array([x[0] for x in sets], np.int64))),
                "score": pa.array(np.append(score[at], np.zeros(k))),
                "docs": pa.array(lists + [None] * k, pa.binary()),
                "grams": pa.array([None] * len(lists) + [x[1] for x in sets], pa.binary()),
            }
        )

    return run


def _members(batches):
    """leader, doc: the documents of columns, each with the leader of all of its column."""
    for b in batches:
        own, leader = b.column(0).to_numpy(), b.column(1).to_numpy()
        lists = [np.frombuffer(x, "<i8") if x is not None else own[i : i + 1] for i, x in enumerate(b.column(2).to_pylist())]
        if lists:
            doc = np.concatenate(lists)
            of = np.repeat(leader, [len(x) for x in lists])
            both = np.unique(np.stack([of[of != doc], doc[of != doc]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["leader", "doc"])


def _set(grams: bytes) -> np.ndarray:
    wide = np.zeros((len(grams) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(grams, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def _similar(common, one, two, percent: int):
    return (100 * common >= percent * (one + two - common)) & (common > 0)


def _with_leader(percent: int):
    """For a leader and a block of its group: which members link with it."""

    def run(key, t):
        leader = key[0].as_py()
        doc = t.column("doc").to_numpy()
        sets = [_set(g.as_py()) for g in t.column("grams")]
        size = np.array([len(s) for s in sets], np.int64)
        linked = np.zeros(len(doc), bool)
        for i in np.flatnonzero(doc == leader):
            flat = np.isin(np.concatenate(sets), sets[i])
            common = np.add.reduceat(flat.astype(np.int64), np.cumsum(size) - size)
            linked |= _similar(common, size, size[i], percent)
        own = doc != leader
        return pa.table({"leader": np.full(own.sum(), leader), "doc": doc[own], "size": size[own], "linked": linked[own]})

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None, often: int = 24) -> np.ndarray:
    """Shared n-grams of every two sets, of two blocks or of one (right: None): a sparse product in two parts.

    N-grams that are in many sets of the blocks are multiplied as dense columns,
    the others add one to each pair of sets that shares them.
    """
    sets = left + (right or [])
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    gram = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(gram, kind="stable")
    gram, row = gram[order], row[order]
    new = np.ones(len(gram), bool)
    new[1:] = gram[1:] != gram[:-1]
    start = np.flatnonzero(new)
    df = np.diff(np.append(start, len(gram)))
    total = np.zeros((len(sets), len(sets)), np.int32)
    for count in range(2, often + 1):
        own = start[df == count]
        if len(own):
            rows = row[own[:, None] + np.arange(count)]
            for i in range(count):
                for j in range(i + 1, count):
                    np.add.at(total, (rows[:, i], rows[:, j]), 1)
    columns = np.flatnonzero(df > often)
    for at in range(0, len(columns), 2048):
        part = columns[at : at + 2048]
        dense = np.zeros((len(sets), len(part)), np.float32)
        spread = np.repeat(np.arange(len(part)), df[part])
        dense[row[np.repeat(start[part], df[part]) + ragged_arange(df[part])], spread] = 1
        total += np.triu((dense @ dense.T + 0.5).astype(np.int32), 1)
    return total[: len(left), len(left) :] if right is not None else total


def _pack_block(key, t):
    """The sets of a block as one row."""
    sizes = np.array([len(g.as_py()) // 6 for g in t.column("grams")], np.int64)
    payload = pack(t.column("doc").to_numpy(), sizes) + b"".join(g.as_py() for g in t.column("grams"))
    return pa.table({"leader": [key[0].as_py()], "block": [key[1].as_py()], "sets": pa.array([payload], pa.binary())})


def _unpack_block(payload: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    doc, size = unpack(payload, np.int64, np.int64)
    ends = 8 + 16 * len(doc) + 6 * np.cumsum(size)
    return doc, [_set(payload[e - 6 * n : e]) for e, n in zip(ends.tolist(), size.tolist())]


def _links(percent: int):
    """For two blocks of a group (one, if right is null): links between their documents, as many as join what they connect."""

    def pairs_of(left: bytes, right: bytes | None) -> np.ndarray:
        doc, sets = _unpack_block(left)
        other, more = _unpack_block(right) if right is not None else (doc, None)
        common = overlaps(sets, more)
        one, two = (np.array([len(s) for s in x], np.int64) for x in (sets, sets if more is None else more))
        i, j = np.nonzero(_similar(common, one[:, None], two[None, :], percent))
        root: dict = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        keep = []
        for x, y in zip(doc[i].tolist(), other[j].tolist()):
            p, q = find(x), find(y)
            if p != q:
                root[p] = q
                keep.append((x, y))
        return np.array(keep, np.int64).reshape(-1, 2)

    def run(batches):
        for b in batches:
            for left, right in zip(b.column(0), b.column(1)):
                pairs = pairs_of(left.as_py(), right.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _group_links(led: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join all documents which links join, within the groups (leader, doc)."""
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")

    def numbered_in(df: DataFrame, counts: DataFrame, spot: list[str]) -> DataFrame:
        """``df`` with at: a block among the parts of its group. Groups of one part need no telling."""
        large = counts.filter("parts > 1").select(*spot, "parts").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = df.withColumn("salt", salt).join(large, [*spot, "salt"], "left")
        return both.withColumn("at", F.pmod(F.xxhash64("doc"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts", "salt")

    parts = led.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    dealt_to = numbered_in(led, parts, ["leader"]).select("leader", "at", "doc")
    leaders = parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("at"), F.col("leader").alias("doc"))
    met = dealt_to.unionByName(leaders).join(sets, "doc").groupBy("leader", "at").applyInArrow(_with_leader(percent), "leader long, doc long, size long, linked boolean")
    # rows that repeat a doc_id may have several sets: linked if one of them is, and in every block of a set that is not
    met = stored(met, "with-leader")
    direct = met.filter("linked").select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct()
    apart = met.filter("not linked").select("leader").distinct()
    # sizes of linked sets lie in one band of this width, or in two next to each other
    width = math.log(100 / percent) * (1 + 1e-9) + 1e-12
    member = met.join(apart, "leader", "left_semi").withColumn("band", F.floor(F.log(F.col("size")) / F.lit(width)).cast("int"))
    spot = ["leader", "linked", "band"]
    many = F.greatest(F.ceil(F.sum("size") / BLOCK_GRAMS), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int")
    counts = member.groupBy(*spot).agg(many.alias("parts"))
    name = lambda linked, band, at: F.concat_ws("-", linked.cast("int"), band, at)
    blocked = numbered_in(member, counts, spot)
    blocked = blocked.select("leader", name(F.col("linked"), F.col("band"), F.col("at")).alias("block"), "doc").distinct()
    packed = stored(blocked.join(sets, "doc").groupBy("leader", "block").applyInArrow(_pack_block, "leader long, block string, sets binary"), "blocks")
    each = counts.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*spot, name(F.col("linked"), F.col("band"), F.col("at")).alias("block"))
    one = each.filter("not linked").select("leader", F.col("band").alias("near"), F.col("block").alias("left"))
    pairs = each.join(one, "leader").filter((F.abs(F.col("band") - F.col("near")) <= 1) & (F.col("linked") | (F.col("left") <= F.col("block"))))
    pairs = pairs.select("leader", "left", F.col("block").alias("right"))
    first = packed.select("leader", F.col("block").alias("left"), F.col("sets").alias("one"))
    second = packed.select("leader", F.col("block").alias("right"), F.col("sets").alias("two"))
    both = pairs.join(first, ["leader", "left"]).join(second, ["leader", "right"])
    both = both.select("one", F.when(F.col("left") != F.col("right"), F.col("two")).alias("two"))
    return stored(direct, "direct").unionByName(stored(both.mapInArrow(_links(percent), "a long, b long"), "links", batch_rows=8))


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``.

    Documents link if 100 * shared n-grams >= percent * all n-grams of the two;
    component_id is the smallest doc_id reachable over links.
    """
    docs = with_nulls(docs)
    n = part_count(docs)
    signed = stored(docs.mapInArrow(_signatures(size), "doc_id long, n_shingles long, sig_a long, sig_b long"), "signatures")
    same = ["n_shingles", "sig_a", "sig_b"]
    classes = stored(signed.filter("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep")), "classes")
    named = docs.filter("doc_id is not null")
    counted = named.mapInArrow(_count_low(size, n), PACKED).groupBy("part").applyInArrow(_frequencies(n), PACKED)
    told = counted.withColumn("rep", F.lit(None).cast("long")).unionByName(
        classes.select(dealt(F.col("rep"), n).alias("part"), F.lit(REPS).alias("kind"), F.lit(None).cast("binary").alias("payload"), "rep")
    )
    parted = named.withColumn("part", dealt(F.col("doc_id"), n))
    made = stored(parted.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(_postings(size, percent, n), COLUMNS), "columns")
    columns = made.filter("n > 0").select("value", "n", "leader", "score", "docs")
    sets = made.filter("n = 0").select(F.col("leader").alias("doc"), "grams")
    best = columns.groupBy("value").agg(F.sum("n").alias("total"), F.max_by("leader", "score").alias("of")).filter("total > 1").select("value", "of")
    led = columns.join(best, "value").select("leader", "of", "docs").mapInArrow(_members, "leader long, doc long")
    links = _group_links(stored(led.distinct(), "groups"), sets, percent)
    # a doc_id of several texts joins their classes
    several = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*same)).alias("low"), F.max(F.struct(*same)).alias("high")).filter("low <> high")
    own = signed.join(several.select("doc_id"), "doc_id").join(classes, same).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comp = stored(components(links.unionByName(own.filter("a <> b"))), "components")
    known = classes.join(comp, F.col("rep") == F.col("node"), "left").select(*same, F.coalesce("component", "rep").alias("found"))
    out = signed.join(known, same, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("found"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
