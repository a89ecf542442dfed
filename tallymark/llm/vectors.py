"""What both vector searches share: valid rows, distinct vectors, and the final ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame, id_col: str, vec_col: str, nonzero: bool = False) -> DataFrame:
    """(id long, vec array<double>) of rows with an id whose vector is neither null, empty, nor holds null or non-finite parts."""
    vec = F.col(vec_col).cast("array<double>")
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~odd)
    return rows.where(F.exists("vec", lambda x: x != 0)) if nonzero else rows


def member_rows(rows: DataFrame, keep: int) -> DataFrame:
    """Of every vector its ``keep`` rows with the smallest ids: no more can be in one result. Limited before the shuffle."""
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    return rows.withColumn("_v_n", place).where(F.col("_v_n") <= keep).drop("_v_n")


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(vec, ids): every vector once, with its ``keep`` smallest ids in order."""
    return member_rows(rows, keep).groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def expand(ids: pa.ChunkedArray, best: np.ndarray, scores: np.ndarray, count: int, ascending: bool) -> tuple[np.ndarray, np.ndarray]:
    """The first ``count`` (id, score) of the vectors ``best`` with all their ids, ties to smaller ids."""
    lists = [ids[int(i)].as_py() for i in best]
    row = np.fromiter((x for one in lists for x in one), np.int64)
    score = np.repeat(scores, [len(x) for x in lists])
    order = np.lexsort((row, score if ascending else -score))[:count]
    return row[order], score[order]


def distinct_queries(queries: DataFrame) -> DataFrame:
    """(vec, q): every query vector once, named by the smallest id that asks it."""
    return queries.groupBy("vec").agg(F.min("id").alias("q"))


def ranked(rows: DataFrame, queries: DataFrame, named: DataFrame, k: int, order: Column) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best rows other than itself.

    ``rows`` are (q, vec_id, score) of distinct queries, with at least k + 1 of the best; ``queries`` (id, vec) and
    ``named`` (vec, q) tell whose they are.
    """
    best = rows.withColumn("_v_n", F.row_number().over(Window.partitionBy("q").orderBy(order, "vec_id"))).where(
        F.col("_v_n") <= k + 1).drop("_v_n")
    mine = queries.join(named, "vec").select(F.col("id").alias("query_id"), "q").join(best, "q").where(F.col("query_id") != F.col("vec_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return mine.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
