"""Exact top-k by inner product over an impact-ordered index, score at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.vectors import distinct_queries, distinct_vectors, expand, matrix, ranked, valid_vectors
from tallymark.session import stored

# Vectors of an index block, queries that meet it together, impact levels of a dimension, and segments between two checks.
BLOCK, QUERIES, LEVELS, CHECK = 16_384, 2_048, 24, 256
# A search stops once at most this share of a block can still be among the best.
FEW = 1 / 16


class ImpactIndex:
    """Posting segments of a block: per dimension the vectors in order of their value, cut into levels of equal width.

    Measured from the lowest value (for a positive query weight) or the highest (for a negative one), every contribution
    to a score is at least 0, so a level's impact bounds what its postings add.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        # Products and sums of integers are exact in doubles, and faster, as long as none can reach 2**53.
        self.largest = int(np.abs(vectors).max(initial=0))
        self.exact = vectors.astype(np.float64)
        self.low, self.high = vectors.min(0), vectors.max(0)
        self.width = (self.high - self.low) // LEVELS + 1
        level = (vectors - self.low) // self.width
        self.order = np.ascontiguousarray(np.argsort(level, axis=0, kind="stable").T.astype(np.int32))
        # starts[d, l]: where level l of dimension d begins in its order
        self.starts = np.stack([np.searchsorted(np.sort(level[:, d]), np.arange(LEVELS + 1)) for d in range(vectors.shape[1])])

    def search(self, query: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the vectors that can be among the ``count`` best; the best are certainly among them."""
        if 2 * self.largest * int(np.abs(query).max(initial=0)) * len(query) >= 2**53:
            return np.arange(len(self.vectors)), self.vectors @ query
        n, dims = self.vectors.shape
        weight = np.abs(query)
        rising = query > 0
        levels = np.arange(LEVELS)
        # The least and the most that a posting of a level adds; levels of a negative weight are counted from the top.
        floor = np.where(rising[:, None], levels * self.width[:, None], np.maximum(0, (self.high - self.low)[:, None] - (levels + 1) * self.width[:, None] + 1))
        most = np.where(rising[:, None], np.minimum((levels + 1) * self.width[:, None] - 1, (self.high - self.low)[:, None]), (self.high - self.low)[:, None] - levels * self.width[:, None])
        floor, most = weight[:, None] * floor, weight[:, None] * np.maximum(most, 0)
        size = self.starts[:, 1:] - self.starts[:, :-1]
        segments = np.argsort(-most, axis=None, kind="stable")
        dim, level = np.divmod(segments[(size > 0).ravel()[segments] & (weight[segments // LEVELS] > 0)], LEVELS)
        acc, seen, slack = np.zeros(n), np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        # left[d, s]: the most that a posting of dimension d adds after s of its segments have been seen.
        left = np.concatenate((-np.sort(-np.where(size > 0, most, 0), axis=1), np.zeros((dims, 1), np.int64)), axis=1)
        possible = np.arange(n)
        for at in range(0, len(dim) if n > count else 0, CHECK):
            d, v = dim[at:at + CHECK], level[at:at + CHECK]
            ids = np.concatenate([self.order[i, a:b] for i, a, b in zip(d, self.starts[d, v], self.starts[d, v + 1])])
            acc += np.bincount(ids, np.repeat(floor[d, v], size[d, v]), n)
            np.maximum.at(slack, d, (most - floor)[d, v])  # how far postings seen may lie above their level's floor
            seen += np.bincount(d, minlength=dims)
            reached = np.partition(acc, n - count)[n - count]
            possible = np.flatnonzero(acc + np.maximum(left[np.arange(dims), seen], slack).sum() >= reached)
            if len(possible) <= max(count, n * FEW):
                break
        return possible, (self.exact[possible] @ query.astype(np.float64)).astype(np.int64)


def _searched(k: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        found = {"q": [], "vec_id": [], "score": []}
        if index.num_rows and queries.num_rows:
            block, asked = ImpactIndex(matrix(index["vec"])), matrix(queries["vec"])
            # Smallest ids first, so that of equal scores the vectors with the smallest ids stay.
            first = np.fromiter((x[0].as_py() for x in index["ids"]), np.int64, index.num_rows)
            for q, query in zip(queries["q"].to_pylist(), asked):
                where, score = block.search(query, k + 1)
                best = np.lexsort((first[where], -score))[:k + 1]
                ids, scores = expand(index["ids"], where[best], score[best], k + 1, ascending=False)
                found["q"] += [q] * len(ids)
                found["vec_id"].append(ids)
                found["score"].append(scores)
        joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found["vec_id"], found["score"])]
        return pa.table([pa.array(found["q"], pa.int64()), pa.array(joined[0]), pa.array(joined[1])], ["q", "vec_id", "score"])
    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest inner products, ties to smaller ids.

    Components become floor(scale * x). Vectors are indexed in blocks by hash; a query walks a block's posting segments by
    descending impact and stops once the bounds prove that all but a few vectors are out, which are then rescored.
    Equal vectors are indexed once, with the k + 1 smallest ids of each; equal queries are searched once. A query is never
    its own result. Rows without an id, with a null or empty vector, or with null or non-finite components take no part.
    Vectors of different lengths never meet. With fewer candidates all are returned; an empty table gives no rows.
    Scores are 64-bit integers: a vector that could leave them, because its squares add up to 2**62 or more, is an error.
    """
    def quantised(df: DataFrame) -> DataFrame:
        # By Cauchy and Schwarz no product of two vectors is larger than the larger one's squares.
        scaled = valid_vectors(df, id_col, vec_col).withColumn("vec", F.transform("vec", lambda x: F.floor(x * F.lit(float(scale)))))
        squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        fits = F.forall("vec", lambda x: F.abs(x.cast("double")) < 2.0**31) & (squares < 2.0**62)
        return scaled.withColumn("vec", F.when(fits, F.col("vec")).otherwise(F.raise_error(
            F.concat(F.lit("scores of this vector can leave 64 bits: id "), F.col("id").cast("string")))))

    spark = vectors.sparkSession
    index = stored(distinct_vectors(quantised(vectors), k + 1), "index")
    asked = stored(quantised(queries), "queries")
    blocks = max(1, -(-index.count() // BLOCK))
    distinct = stored(distinct_queries(asked), "distinct")
    groups = max(1, -(-distinct.count() // QUERIES))
    turn = F.pmod(F.xxhash64("vec"), F.lit(groups)).alias("turn")
    left = index.select(F.size("vec").alias("dim"), F.pmod(F.xxhash64(F.lit(1), "vec"), F.lit(blocks)).alias("block"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("turn"), "vec", "ids")
    right = distinct.select(F.size("vec").alias("dim"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), turn, "vec", "q")
    key = ["dim", "block", "turn"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_searched(k), "q long, vec_id long, score long")
    return ranked(found, asked, distinct, k, F.col("score").desc())
