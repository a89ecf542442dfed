"""Approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.vectors import distinct_queries, distinct_vectors, expand, matrix, ranked, valid_vectors
from tallymark.session import stored

# Vectors of the sample that sets the widths and the number of probes, the recall it aims at, and points of one task.
SAMPLE, AIM, BLOCK = 2_000, 0.97, 8_192
# The most cells of a table (so many rows a table are broadcast), and the numbers that probes of some queries take at once.
CELLS, PROBED = 16_384, 1 << 20


def probe_template(hashes: int, count: int) -> list[tuple[int, ...]]:
    """Perturbation sets over the 2 * hashes nearest boundaries by rank, best expected success first.

    A set's cost is the sum of expected squared distances to its boundaries (those of uniform order statistics); the two
    boundaries of one hash never go together. Sets grow from the cheapest one by shifting or adding their last rank.
    """
    m = hashes

    def cost(j: int) -> float:
        if j <= m:
            return j * (j + 1) / (4 * (m + 1) * (m + 2))
        k = 2 * m + 1 - j
        return 1 - k / (m + 1) + k * (k + 1) / (4 * (m + 1) * (m + 2))

    out: list[tuple[int, ...]] = [()]
    heap = [(cost(1), (1,))]
    while heap and len(out) < count:
        _, ranks = heapq.heappop(heap)
        if not any(2 * m + 1 - j in ranks for j in ranks):
            out.append(ranks)
        if ranks[-1] < 2 * m:
            for new in (ranks[:-1] + (ranks[-1] + 1,), ranks + (ranks[-1] + 1,)):
                heapq.heappush(heap, (sum(map(cost, new)), new))
    return out


_template = lru_cache(maxsize=8)(probe_template)


@dataclass
class Tables:
    """Projections and offsets of all tables, their width, and the probes of a query in each."""

    axes: np.ndarray  # tables, hashes, dimensions
    shifts: np.ndarray
    width: float
    probes: int

    def slots(self, x: np.ndarray) -> np.ndarray:
        """Positions (vectors, tables, hashes) in units of the width."""
        return np.einsum("nd,thd->nth", x, self.axes) / self.width + self.shifts

    def buckets(self, x: np.ndarray) -> np.ndarray:
        return np.floor(self.slots(x)).astype(np.int64)

    def probed(self, x: np.ndarray) -> np.ndarray:
        """Buckets (vectors, tables, probes, hashes) in order of estimated success."""
        slots = self.slots(x)
        base = np.floor(slots)
        low = slots - base
        m = base.shape[2]
        sides = np.concatenate([low, 1 - low], axis=2)
        order = np.argsort(sides, axis=2)
        steps = np.concatenate([-np.eye(m), np.eye(m)])[order]  # vectors, tables, ranks, hashes
        sets = np.zeros((self.probes, 2 * m))
        for p, ranks in enumerate(_template(m, self.probes)):
            sets[p, [j - 1 for j in ranks]] = 1
        return (base[:, :, None, :] + sets @ steps).astype(np.int64)

    @property
    def at_once(self) -> int:
        """How many queries may be probed at once."""
        return max(1, PROBED // (self.axes.shape[0] * self.axes.shape[1] * self.probes))


def fit(sample: np.ndarray, size: int, k: int, tables: int, seed: int = 11) -> Tables:
    """Tables for ``size`` vectors from a bounded sample of them.

    Hashes grow with the logarithm of the size, so that buckets stay of one order. The width is the sample's mean
    distance to the k-th neighbour; probes are added until the sample finds ``AIM`` of its own neighbours, which lie
    further apart than those in the whole table.
    """
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    hashes = max(3, round(np.log2(max(size, 2)) / 3))
    axes = rng.normal(size=(tables, hashes, dim))
    squares = (sample**2).sum(1)
    asked = sample[:200]
    distance = np.sqrt(np.maximum(0, (asked**2).sum(1)[:, None] + squares[None] - 2 * asked @ sample.T))
    near = np.argsort(distance, axis=1, kind="stable")[:, :k + 1]
    reach = np.take_along_axis(distance, near, 1)[:, -1]
    made = Tables(axes, rng.uniform(size=(tables, hashes)), float(max(reach.mean(), 1e-9)) * 1.5, 1)
    most = min(len(probe_template(hashes, 4096)), 4096)
    home = made.buckets(sample)
    while True:
        hits, step = 0, max(1, made.at_once // near.shape[1])
        for at in range(0, len(asked), step):
            probed = made.probed(asked[at:at + step])
            hits += (probed[:, None] == home[near[at:at + step]][:, :, :, None]).all(-1).any(-1).any(-1).sum()
        if hits / near.size >= AIM or made.probes >= most:
            return made
        made.probes = min(most, made.probes * 2 if made.probes < 8 else made.probes + max(4, made.probes // 4))


def bucket_keys(buckets: np.ndarray) -> np.ndarray:
    """One long per bucket; buckets that happened to share one would only add candidates."""
    with np.errstate(over="ignore"):
        key = np.zeros(buckets.shape[:-1], np.uint64)
        for i in range(buckets.shape[-1]):
            key = (key ^ buckets[..., i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return key.astype(np.int64)


def _indexed(made: Tables, cells: int):
    def run(batches):
        for batch in batches:
            keys = bucket_keys(made.buckets(matrix(batch["vec"]))) if batch.num_rows else np.zeros((0, 1), np.int64)
            for t in range(keys.shape[1]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(keys[:, t] % cells), pa.array(keys[:, t]), batch["vec"], batch["ids"]],
                    ["tab", "cell", "bucket", "vec", "ids"])
    return run


def _asked(made: Tables, cells: int):
    def run(batches):
        for batch in batches:
            step = min(256, made.at_once)
            for at in range(0, batch.num_rows, step):
                vec, q = batch["vec"].slice(at, step), batch["q"].slice(at, step)
                keys = bucket_keys(made.probed(matrix(vec)))  # vectors, tables, probes
                for t in range(keys.shape[1]):
                    order = np.argsort(keys[:, t] % cells, axis=1, kind="stable")
                    key = np.take_along_axis(keys[:, t], order, axis=1)
                    cell = key % cells
                    begins = np.ones(cell.shape, bool)
                    begins[:, 1:] = cell[:, 1:] != cell[:, :-1]
                    row, _ = np.nonzero(begins)
                    ends = np.append(np.flatnonzero(begins), key.size).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), t, np.int32)), pa.array(cell[begins]), *[x.take(pa.array(row)) for x in (vec, q)],
                         pa.ListArray.from_arrays(pa.array(ends), pa.array(key.ravel()))],
                        ["tab", "cell", "vec", "q", "buckets"])
    return run


def _reranked(k: int):
    """Exact distances of the vectors in the probed buckets of this cell, the k + 1 nearest of each query."""
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        owners, vec_id, score = [], [np.zeros(0, np.int64)], [np.zeros(0)]
        if index.num_rows and queries.num_rows:
            points, asked, bucket = matrix(index["vec"]), matrix(queries["vec"]), index["bucket"].to_numpy()
            first = np.fromiter((x[0].as_py() for x in index["ids"]), np.int64, index.num_rows)
            order = np.argsort(bucket, kind="stable")
            names, starts = np.unique(bucket[order], return_index=True)
            ends = np.append(starts[1:], len(order))
            for q, query, wanted in zip(queries["q"].to_pylist(), asked, queries["buckets"]):
                if wanted.is_valid:
                    spot = np.searchsorted(names, wanted.values.to_numpy())
                    spot = spot[(spot < len(names)) & (names[np.minimum(spot, len(names) - 1)] == wanted.values.to_numpy())]
                    where = np.concatenate([order[starts[s]:ends[s]] for s in spot]) if len(spot) else np.zeros(0, np.int64)
                else:  # every bucket
                    where = order
                distance = np.sqrt(((points[where] - query) ** 2).sum(1))
                if len(where) > k + 1:  # all that are not beyond the (k + 1)-th, ties included
                    near = distance <= np.partition(distance, k)[k]
                    where, distance = where[near], distance[near]
                best = np.lexsort((first[where], distance))[:k + 1]
                ids, scores = expand(index["ids"], where[best], distance[best], k + 1, ascending=True)
                owners += [q] * len(ids)
                vec_id.append(ids)
                score.append(scores)
        return pa.table([pa.array(owners, pa.int64()), pa.array(np.concatenate(vec_id)), pa.array(np.concatenate(score))],
                        ["q", "vec_id", "score"])
    return run


def _salted(index: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """Both sides grouped by cell; a cell of more than ``BLOCK`` vectors is split by hash, and its queries visit each part.

    The sizes are what is broadcast, at most ``CELLS`` rows a table: left alone, the optimizer may take the probes instead,
    which it thinks as small as the queries they are made of.
    """
    sizes = F.broadcast(index.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("parts")))
    left = index.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("vec"), F.col("parts"))).drop("parts")
    right = asked.join(sizes, key).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return left.groupBy(*key, "part").cogroup(right.groupBy(*key, "part"))


FOUND = "q long, vec_id long, score double"


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = 4,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found by Euclidean distance, ties to smaller ids.

    Vectors are hashed into ``tables`` tables; a query visits, per table, its own bucket and perturbed ones in order of
    estimated success. Candidates of all tables are reranked by exact distance. Widths and probes are fitted on at most
    ``SAMPLE`` vectors, every vector is indexed. A query that finds fewer than ``k`` others is searched exhaustively, so
    only the table's size can shorten a result. Equal vectors are indexed once, with the k + 1 smallest ids of each, and
    equal queries searched once. A query is never its own result. Rows without an id, with a null, empty or zero vector,
    or with null or non-finite components take no part. Vectors of different lengths never meet; each length is a
    search of its own. An empty table gives no rows.
    """
    index = stored(distinct_vectors(valid_vectors(vectors, id_col, vec_col, nonzero=True), k + 1), "index")
    asked = stored(valid_vectors(queries, id_col, vec_col, nonzero=True), "queries")
    results = None
    for (dim,) in index.select(F.size("vec")).distinct().collect() or [(0,)]:
        one = _nearest_of(index.where(F.size("vec") == dim), asked.where(F.size("vec") == dim), k, tables)
        results = one if results is None else results.unionByName(one)
    return results


def _sample(index: DataFrame) -> list[list[float]]:
    """The ``SAMPLE`` vectors with the smallest hashes. Every task sends the driver its smallest hashes, not their vectors."""
    hashed = index.select(F.xxhash64("vec").alias("h"), "vec")
    last = hashed.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    return [r["vec"] for r in hashed.where(F.col("h") <= F.lit(last)).orderBy("h").limit(SAMPLE).collect()] if last is not None else []


def _nearest_of(index: DataFrame, asked: DataFrame, k: int, tables: int) -> DataFrame:
    size = index.count()
    sample = _sample(index)
    distinct = stored(distinct_queries(asked), "distinct")
    if not sample:
        return ranked(index.sparkSession.createDataFrame([], FOUND), asked, distinct, k, F.col("score"))
    made = fit(np.array(sample), size, k, tables)
    cells = min(max(1, size // (BLOCK // 4)), CELLS)
    slots = index.mapInArrow(_indexed(made, cells), "tab int, cell long, bucket long, vec array<double>, ids array<long>")
    probes = distinct.mapInArrow(_asked(made, cells), "tab int, cell long, vec array<double>, q long, buckets array<long>")
    found = _salted(slots, probes, ["tab", "cell"]).applyInArrow(_reranked(k), FOUND)
    merged = stored(found.groupBy("q", "vec_id").agg(F.min("score").alias("score")), "found")
    # A query's own id is among what it finds, so k others are k + 1 rows.
    short = distinct.join(merged.groupBy("q").count().where(F.col("count") > k), "q", "left_anti")
    short = stored(short, "short")
    if not short.isEmpty():
        blocks = index.select(F.lit(0).alias("cell"), F.lit(0).cast("long").alias("bucket"), "vec", "ids")
        whole = short.select(F.lit(0).alias("cell"), "vec", "q", F.lit(None).cast("array<long>").alias("buckets"))
        rest = _salted(blocks, whole, ["cell"]).applyInArrow(_reranked(k), FOUND)
        merged = merged.join(short.select("q"), "q", "left_anti").unionByName(rest)
    return ranked(merged, asked, distinct, k, F.col("score"))
