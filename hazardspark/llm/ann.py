"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes smallest Euclidean distance on vectors with one
more component (scaled by the largest norm, a corpus statistic). Each of
``TABLES`` tables cuts the space by some Gaussian projections, the 2-stable
family, into cells. A query visits its own cell and those whose boundaries are
nearest, in order of the sum of squared distances to the boundaries crossed,
which orders them by estimated success. In every cell the exact inner products
of its vectors with the queries that probe it are taken in blocks, and each
query's best go on; the tables' results are merged and ranked.

How many projections, how wide a cell (in units of the measured spread of the
projections) and how many probes is fitted on a bounded sample (``SAMPLE``
vectors, ``ASKED`` of them as queries): of all combinations whose recall on the
sample reaches ``RECALL``, the one that costs a query least, which depends on
the number of vectors. Neighbours in a sample lie further off than in the whole
table, so the whole is searched a little better than the sample.

Vectors go to tasks by cell. A cell that holds many vectors, or is probed by
many queries, is cut into blocks of bounded size, so one vector that a third of
the rows share fills many tasks and not one. A query that finds fewer than k
vectors visits all cells next to its own; if it still finds fewer, it lies far
from everything and is searched in all vectors, in blocks.

Results for odd rows: null or zero vectors, and those with null or non-finite
components or another length than most, take no part; so do null ids; repeated
rows count once; of rows that repeat an id with other vectors the least vector
counts; inner products beyond the range of a double are left out; ties go to
the smaller vec_id; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

TABLES = 8
CHOICES = [(h, w) for h in (4, 6, 8) for w in (1.25, 2.5)]  # projections per table, width of a cell in spreads
SAMPLE, ASKED, RECALL = 10_000, 128, 0.95
CELL_COST = 16  # a visit to a cell costs as much as so many vectors in it
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024
PROBED = 131_072  # probes of one table held at a time
SEED = 17
FOUND = "query_id long, vec_id long, score double"


class Tables:
    """The hash functions for vectors of ``dim`` components whose norm is at most ``top``; width: of a cell."""

    def __init__(self, dim: int, top: float, hashes: int, width: float, tables: int = TABLES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.top, self.width, self.tables, self.hashes = top, width, tables, hashes
        self.lines = rng.normal(0, 1, (tables, hashes, dim + 1))
        self.shift = rng.uniform(0, 1, (tables, hashes))
        self.names = rng.integers(1, 1 << 62, (tables, hashes)) | 1
        self.steps = np.array(list(itertools.product((-1, 0, 1), repeat=hashes)))

    def _places(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        scaled = vectors / (np.abs(vectors).max(axis=1, initial=0)[:, None] if query else self.top)
        norm = np.linalg.norm(scaled, axis=1)
        if query:
            wide = np.hstack([scaled / norm[:, None], np.zeros((len(scaled), 1))])
        else:
            wide = np.hstack([scaled, np.sqrt(np.maximum(0, 1 - norm**2))[:, None]])
        return np.einsum("nd,thd->nth", wide, self.lines) / self.width + self.shift

    def _name(self, cell: np.ndarray, table: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = ((cell.astype(np.int64) + 1000) * self.names[table]).sum(axis=-1).astype(np.uint64)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(8)) * np.uint64(self.tables) + np.uint64(table)).view(np.int64)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """One cell per vector and table."""
        whole = np.floor(self._places(vectors, False)).astype(np.int64)
        return np.stack([self._name(whole[:, t], t) for t in range(self.tables)], axis=1)

    def ranked(self, vectors: np.ndarray, count: int) -> list[np.ndarray]:
        """For each table, the ``count`` cells of each query that are most likely to succeed, best first."""
        place = self._places(vectors, True)
        whole = np.floor(place).astype(np.int64)
        inside = place - whole
        cost = np.stack([inside**2, np.zeros_like(inside), (1 - inside) ** 2])
        out = []
        for t in range(self.tables):
            score = sum(cost[self.steps[:, h] + 1, :, t, h] for h in range(self.hashes))
            best = np.argsort(score, axis=0, kind="stable")[:count].T
            out.append(self._name(whole[:, t][:, None, :] + self.steps[best], t))
        return out

    def probes(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """All cells that each query visits."""
        return np.concatenate([np.concatenate(self.ranked(part, count), axis=1) for part in np.array_split(vectors, -(-len(vectors) // 256))])


def fitted(sample: np.ndarray, top: float, total: int, k: int, seed: int = SEED) -> tuple[int, float, int, float]:
    """Projections, width and probes of a search in ``total`` vectors like ``sample``, and the share of vectors it visits in the sample."""
    dim = sample.shape[1]
    asked = sample[np.random.default_rng(seed).permutation(len(sample))[:ASKED]]
    scores = asked @ sample.T
    k = min(k, len(sample) - 1)
    near = np.argsort(-scores, axis=1)[:, : k + 1]  # the query itself is one of them
    spread = float(Tables(dim, top, 4, 1.0)._places(sample, False).std(axis=0).mean()) or 1.0
    best, found = None, None
    for hashes, width in CHOICES:
        known = Tables(dim, top, hashes, width * spread)
        cells = known.cells(sample)
        first = np.full((len(asked), len(sample)), 1 << 20)  # the probe, of any table, that comes upon a vector
        for t, probes in enumerate(known.ranked(asked, 3**hashes)):
            names, inverse = np.unique(cells[:, t], return_inverse=True)
            for i, own in enumerate(probes):
                at = np.searchsorted(names, own)
                hit = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == own)
                when = np.full(len(names), 1 << 20)
                when[at[hit]] = np.flatnonzero(hit)
                first[i] = np.minimum(first[i], when[inverse])
        hits = np.take_along_axis(first, near, axis=1)
        for count in sorted({*(2**e for e in range(13) if 2**e < 3**hashes), 3**hashes}):
            recall, share = float((hits < count).mean()), float((first < count).mean())
            cost = share * total + CELL_COST * known.tables * count
            if found is None or recall > found[0]:
                found = (recall, hashes, width * spread, count, share)
            if recall >= RECALL:
                if best is None or cost < best[0]:
                    best = (cost, hashes, width * spread, count, share)
                break
    return (best or found)[1:]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _first_copies(vectors: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of equal vectors the k + 1 of smallest id, in order of id: ties go to these, one of which may be the query itself."""
    order = np.argsort(ids, kind="stable")
    whole = np.ascontiguousarray(vectors[order]).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    _, kind = np.unique(whole, return_inverse=True)
    by_kind = np.argsort(kind, kind="stable")
    place = np.empty(len(kind), np.int64)
    place[by_kind] = np.arange(len(kind)) - np.searchsorted(kind[by_kind], kind[by_kind])
    return order[place <= k]


def _search(k: int):
    """The best of one block of vectors for one block of queries."""

    def run(key, queries, vectors):
        if not len(queries) or not len(vectors):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, v = _matrix(queries.column("vector")), _matrix(vectors.column("vector"))
        qid, vid = queries.column("query_id").to_numpy(), vectors.column("vec_id").to_numpy()
        apart = _first_copies(v, vid, k)
        v, vid = v[apart], vid[apart]
        rough = q @ v.T
        rough[qid[:, None] == vid[None, :]] = -np.inf
        take = min(k, rough.shape[1])
        least = np.partition(rough, rough.shape[1] - take, axis=1)[:, -take]
        scale = 1e-9 * (1 + np.abs(least))
        i, j = np.nonzero((rough >= (least - scale)[:, None]) & np.isfinite(rough))
        score = (q[i] * v[j]).sum(axis=1)
        order = np.lexsort((vid[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        return pa.table({"query_id": qid[i[keep]], "vec_id": vid[j[keep]], "score": score[keep]})

    return run


def _usable(df: DataFrame, name: str) -> DataFrame:
    vector = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    df = df.select(F.col(name).cast("long").alias(name), vector.alias("vector")).filter(F.col(name).isNotNull() & F.col("vector").isNotNull())
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return df.filter(sound)


def _one_each(df: DataFrame, name: str, dim: int) -> DataFrame:
    return df.filter(F.size("vector") == dim).groupBy(name).agg(F.min("vector").alias("vector"))


def _in_cells(here: DataFrame, there: DataFrame, found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: of every cell that a query visits, the best."""
    held = here.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    sought = there.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("sets"))
    sizes = stored(held.join(sought, "cell"), "sizes")
    split = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = there.join(sizes, "cell").withColumn("set", split("query_id", "sets")).withColumn("block", every("blocks")).join(asked, "query_id")
    right = here.join(sizes, "cell").withColumn("block", split("vec_id", "blocks")).withColumn("set", every("sets")).join(found, "vec_id")
    key = ["cell", "block", "set"]
    best = left.select(*key, "query_id", "vector").groupBy(*key).cogroup(right.select(*key, "vec_id", "vector").groupBy(*key)).applyInArrow(_search(k), FOUND)
    return stored(best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")


def _in_all(found: DataFrame, few: DataFrame, total: int, k: int) -> DataFrame:
    """The same against all vectors, in blocks."""
    parts = max(1, -(-total // BLOCK_ROWS))
    sets = max(1, -(-few.count() // BLOCK_QUERIES))
    lot = few.withColumn("set", F.pmod(F.xxhash64("query_id"), F.lit(sets)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    all_of = found.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    return lot.groupBy("block", "set").cogroup(all_of.groupBy("block", "set")).applyInArrow(_search(k), FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, how: tuple[int, float, int] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` vectors found of largest inner product, for each query.

    vectors: vec_id, embedding; queries: query_id, embedding. A query's own id is
    no candidate. how: projections, width and probes; by default they are fitted.
    """
    found = _usable(vectors, "vec_id")
    # scaled by the largest component, which is computed once a vector
    length = lambda most: most * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / most) * (x / most)))
    norm = F.get(F.transform(F.array(F.array_max(F.transform("vector", F.abs))), length), 0)
    dims = found.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top")).orderBy(F.desc("n"), "dim").first()
    if dims is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, top = dims["dim"], min(dims["top"], 1.7e308) * (1 + 1e-12)
    found = stored(_one_each(found, "vec_id", dim), "vectors")
    asked = stored(_one_each(_usable(queries, "query_id"), "query_id", dim), "queries")
    total = found.count()
    if how is None:
        some = found.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow().column("vector")
        how = fitted(_matrix(some), top, total, k)[:3]
    hashes, width, probes = how

    def place(batches):
        known = Tables(dim, top, hashes, width)
        for b in batches:
            m = _matrix(b.column(1)) if len(b) else np.zeros((0, dim))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(known.cells(m)) if len(b) else [], pa.list_(pa.int64()))], ["vec_id", "cells"])

    def probe(df: DataFrame, count: int) -> DataFrame:
        step = max(1, PROBED // count)  # queries at a time

        def run(batches):
            known = Tables(dim, top, hashes, width)
            for whole in batches:
                for lo in range(0, len(whole), step):
                    b = whole.slice(lo, step)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(known.probes(_matrix(b.column(1)), count)), pa.list_(pa.int64()))], ["query_id", "cells"])

        return df.mapInArrow(run, "query_id long, cells array<long>").select("query_id", F.explode(F.array_distinct("cells")).alias("cell"))

    here = stored(found.mapInArrow(place, "vec_id long, cells array<long>").withColumn("cell", F.explode("cells")).select("vec_id", "cell"), "cells")

    def short_of(best: DataFrame, of: DataFrame) -> DataFrame:
        enough = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(k, total - 1))
        return stored(of.join(enough, "query_id", "left_anti"), "few")

    best = _in_cells(here, stored(probe(asked, probes), "probes"), found, asked, k)
    few = short_of(best, asked)
    if not few.isEmpty():
        more = _in_cells(here, stored(probe(few, 3**hashes), "probes"), found, few, k)
        best = best.join(few.select("query_id"), "query_id", "left_anti").unionByName(more)
        rest = short_of(more, few)
        if not rest.isEmpty():
            best = best.join(rest.select("query_id"), "query_id", "left_anti").unionByName(_in_all(found, rest, total, k))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = vectors.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return nearest(vectors, queries)
