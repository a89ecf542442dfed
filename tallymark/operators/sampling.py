"""Reproducible sampling by hash rank: independent of row order, partitioning and retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.hashing import hash_rank
from tallymark.operators.ranks import HASH_DIGITS
from tallymark.session import stored


def _first_by_hash(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows (_name, _sh) with the smallest hashes: whole buckets by their counts, only the boundary one in order."""
    bucketed = rows.withColumn("_b", F.substring("_sh", 1, HASH_DIGITS))
    # One row that holds at most 16 ** HASH_DIGITS counts.
    counts = bucketed.groupBy("_b").agg(F.count("*").alias("_n")).agg(F.array_sort(F.collect_list(F.struct("_b", "_n"))).alias("_c"))
    at = F.aggregate("_c", F.struct(F.lit(None).cast("string").alias("last"), F.lit(k).cast("long").alias("need")), lambda a, c: F.when(
        a["need"] <= 0, a).otherwise(F.struct(c["_b"].alias("last"), (a["need"] - c["_n"]).alias("need"))))
    last = counts.select(at.alias("_at")).select("_at.*")
    # need is minus the surplus of the boundary bucket, or what is missing where there are fewer rows.
    placed = bucketed.join(F.broadcast(last)).where(F.col("_b") <= F.col("last"))
    sized = placed.withColumn("_in", F.col("_b") < F.col("last"))
    edge = sized.where(~F.col("_in")).withColumn("_rn", F.row_number().over(Window.partitionBy("_b").orderBy("_sh", "_name"))).withColumn(
        "_all", F.count("*").over(Window.partitionBy("_b")))
    return sized.where("_in").select("_name").unionAll(edge.where(F.col("_rn") <= F.col("_all") + F.least("need", F.lit(0))).select("_name"))


def _ranked(df: DataFrame, key: str, stratum: str, seed: int) -> DataFrame:
    return df.withColumn("_h", hash_rank(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, HASH_DIGITS)).withColumn("_name", F.col(stratum))


def _bucket_counts(ranked: DataFrame) -> DataFrame:
    """(_name, _b, _n): rows per stratum and bucket of their hashes, written."""
    return stored(ranked.groupBy("_name", "_b").agg(F.count("*").alias("_n")), "strata")


def _boundaries(buckets: DataFrame, count: int, seed: int) -> DataFrame | None:
    """(_name, _quota, _last, _need): each stratum's share, the bucket in which it ends and how many rows of that belong to it.

    A stratum that is shorter than its share has no such bucket. None if there are no strata.
    """
    strata = buckets.select("_name").distinct().withColumn("_sh", F.coalesce(hash_rank(F.col("_name"), seed), F.lit("")))
    n_strata = strata.count()
    if not n_strata:
        return None
    each, more = divmod(count, n_strata)
    first = (_first_by_hash(strata, more) if more else strata.limit(0).select("_name")).withColumn("_one", F.lit(1))
    quota = strata.alias("a").join(first.alias("b"), F.col("a._name").eqNullSafe(F.col("b._name")), "left").select(
        "a._name", (F.lit(each) + F.coalesce("b._one", F.lit(0))).cast("long").alias("_quota"))
    upto = F.sum("_n").over(Window.partitionBy("_name").orderBy("_b"))
    reached = buckets.alias("a").join(quota.alias("b"), F.col("a._name").eqNullSafe(F.col("b._name"))).select(
        "a.*", "b._quota").withColumn("_upto", upto)
    full = F.col("_upto") >= F.col("_quota")
    return reached.groupBy("_name").agg(
        F.first("_quota").alias("_quota"), F.min(F.when(full, F.col("_b"))).alias("_last"),
        F.min_by(F.when(full, F.col("_quota") - F.col("_upto") + F.col("_n")), F.when(full, F.col("_b"))).alias("_need"))


def _within(ranked: DataFrame, bounds: DataFrame, most: int) -> DataFrame:
    """The rows of ``ranked`` inside the shares of ``bounds``, with its other columns; strata that it lacks are left out."""
    extra = [f"b.{c}" for c in bounds.columns if c not in ("_name", "_quota")]
    kept = ranked.alias("a").join(bounds.alias("b"), F.col("a._name").eqNullSafe(F.col("b._name"))).select("a.*", *extra).where(
        F.col("_last").isNull() | (F.col("_b") <= F.col("_last")))
    numbered = kept.withColumn("_rn", F.row_number().over(Window.partitionBy("_name", "_b").orderBy("_h", "_key")))
    inside = F.col("_last").isNull() | (F.col("_b") < F.col("_last")) | (F.col("_rn") <= F.col("_need"))
    # No bucket gives more than a stratum's share; said as a constant, Spark cuts hot buckets before the shuffle.
    return numbered.where((F.col("_rn") <= most) & inside)


def stratified_sample(df: DataFrame, key: str, stratum: str, count: int, seed: int) -> DataFrame:
    """``count`` rows split evenly over the strata, the remainder to the strata ranked first; short strata are not topped up.

    Hash ranks are uniform, so their leading digits cut every stratum into ordered buckets of equal size. A first scan
    counts rows per stratum and bucket and writes the counts: they name the strata and tell which buckets lie wholly
    inside the quota. A second scan keeps the rows up to the boundary bucket; of a bucket no task hands on more than its
    quota, so the smallest hashes of all tasks merge by (stratum, bucket), and a stratum that holds most of the table is
    not ordered in one task. Nulls are a stratum of their own.
    """
    if count <= 0:
        return df.limit(0)
    ranked = _ranked(df, key, stratum, seed).withColumn("_key", F.col(key))
    buckets = _bucket_counts(ranked)
    bounds = _boundaries(buckets, count, seed)
    return df.limit(0) if bounds is None else _within(ranked, bounds, count).select(*df.columns)


def sampled_pools(df: DataFrame, key: str, stratum: str, count: int, dev_strata: int, dev_count: int, seed: int) -> DataFrame:
    """``df`` plus ``pool``: a sample of the strata held out (``dev``) and one of the rest (``golden``), in two scans.

    One scan counts, for both pools; which pool a stratum is in is decided on the counts. The second takes the rows of both.
    """
    ranked = _ranked(df, key, stratum, seed).withColumn("_key", F.col(key))
    buckets = _bucket_counts(ranked)
    held, rest = holdout_strata(buckets, "_name", dev_strata, seed)
    out = []
    for pool, part, n in (("golden", rest, count), ("dev", held, dev_count)):
        bounds = _boundaries(part, n, seed) if n > 0 else None
        if bounds is not None:
            out.append(bounds.withColumn("pool", F.lit(pool)))
    if not out:
        return df.limit(0).withColumn("pool", F.lit(""))
    bounds = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return _within(ranked, bounds, max(count, dev_count)).select(*df.columns, "pool")


def holdout_strata(df: DataFrame, stratum: str, k: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(held out, remaining): the ``k`` strata ranked first are held out."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:holdout:"), F.col(stratum).cast("string")), 256)
    held = df.select(stratum).distinct().orderBy(rank).limit(k)
    return df.join(held, stratum, "left_semi"), df.join(held, stratum, "left_anti")
