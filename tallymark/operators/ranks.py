"""Exact ranks without a hot task.

A plain ``row_number`` or ``percentile`` over a key sends every row of that key to one task. Here the rows of a key are
spread over ordered buckets; only per-bucket counts (a bounded number of rows per key) are accumulated in order.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import stored

# Buckets that a range of values is cut into at once, and the most distinct values that one task orders.
VALUE_BUCKETS, ORDERED = 64, 20_000
HASH_DIGITS = 3


def rank_of(p: float, n: Column) -> Column:
    """1-based nearest rank of percentile ``p`` among ``n`` values: the ceiling of p*n, kept within 1..n."""
    exact = F.ceil(F.round(F.lit(Decimal(str(p))) * n.cast("decimal(18,0)"), 9)).cast("long")
    return F.least(F.greatest(exact, F.lit(1).cast("long")), n)


def nearest_ranks(
    df: DataFrame, keys: list[str], col: str, ps: dict[str, float], weight: str | None = None, ordered: int = ORDERED,
) -> DataFrame:
    """(keys, n, one column per entry of ``ps``): exact nearest-rank percentiles of the non-null values of ``col``.

    ``weight`` names a column that says how often a row counts.

    1. values are counted, so repeats combine before they are shuffled, and written once;
    2. while the range of values that holds a rank has more than ``ordered`` distinct ones, it is cut at evenly spaced
       split points (a bounded sketch of that range), and counts per bucket tell the bucket that holds the rank;
    3. the values of the last ranges are ordered, never more than ``ordered`` of them in a task.

    A range shrinks by about ``VALUE_BUCKETS`` each round, so ten million distinct values of one key take two rounds.
    """
    counted = stored(df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("_v")).agg(
        (F.sum(weight) if weight else F.count("*")).alias("_n")), "values")
    totals = counted.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.count("*").alias("_d"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    # One row per key and percentile: the range that holds the rank, and how many values lie before it.
    goals = totals.select(*keys, "n", F.lit(0).cast("long").alias("_before"), "_d", "_low", "_high", F.explode(F.array(*[
        F.struct(F.lit(name).alias("_name"), rank_of(p, F.col("n")).alias("_rank")) for name, p in ps.items()
    ])).alias("_t")).select(*keys, "n", "_before", "_d", "_low", "_high", "_t.*")
    done = None
    while True:
        goals = stored(goals, "ranges")
        small = goals.where(F.col("_d") <= ordered)
        done = small if done is None else done.unionByName(small)
        goals = goals.where(F.col("_d") > ordered)
        if goals.isEmpty():
            break
        goals = _narrowed(counted, goals, keys)
    by_value = Window.partitionBy(*keys, "_name").orderBy("_v")
    reached = _inside(counted, done, keys).withColumn("_upto", F.col("_before") + F.sum("_n").over(by_value)).where(
        F.col("_upto") >= F.col("_rank"))
    return reached.groupBy(*keys).agg(
        F.max("n").alias("n"), *[F.min(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ps])


def _inside(counted: DataFrame, goals: DataFrame, keys: list[str]) -> DataFrame:
    """The values of every range, each with what is known of the range."""
    return _join(counted, goals, keys).where(F.col("_v").between(F.col("_low"), F.col("_high")))


def _narrowed(counted: DataFrame, goals: DataFrame, keys: list[str]) -> DataFrame:
    """``goals`` with each range cut down to the bucket that holds its rank."""
    group = [*keys, "_name"]
    points = [i / VALUE_BUCKETS for i in range(1, VALUE_BUCKETS)]
    splits = _inside(counted, goals, keys).groupBy(*group).agg(F.percentile_approx("_v", points, 1000).alias("_s"))
    cut = stored(goals.join(splits, group), "cuts")
    placed = _inside(counted, cut, keys).withColumn("_b", F.size(F.filter("_s", lambda s: s < F.col("_v"))))
    buckets = placed.groupBy(*group, "_b").agg(
        *[F.first(c).alias(c) for c in ("n", "_before", "_rank")], F.sum("_n").alias("_bn"), F.count("*").alias("_d"),
        F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    # At most one row per bucket of a range.
    upto = F.col("_before") + F.sum("_bn").over(Window.partitionBy(*group).orderBy("_b"))
    found = buckets.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_bn") < F.col("_rank")))
    return found.withColumn("_before", F.col("_upto") - F.col("_bn")).select(*keys, "n", "_before", "_d", "_low", "_high", "_name", "_rank")


def _join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Equi-join whose small side is left to the size check of the optimizer; without keys the right side is one row."""
    return left.join(right, on) if on else left.join(F.broadcast(right))


def nearest_rank(df: DataFrame, keys: list[str], col: str, p: float) -> DataFrame:
    return nearest_ranks(df, keys, col, {"value": p}).select(*keys, "value")


def global_index(df: DataFrame, key: Column, order: list[str], name: str = "idx") -> DataFrame:
    """Adds a dense 0-based index: rows are ordered within hash buckets of ``key``, buckets by their number.

    The index does not follow a global sort order; it is reproducible and no task orders more than one bucket.
    """
    bucketed = df.withColumn("_b", F.substring(F.sha2(key.cast("string"), 256), 1, HASH_DIGITS))
    counts = bucketed.groupBy("_b").agg(F.count("*").alias("_n"))
    # At most 16 ** HASH_DIGITS rows, whatever the table holds: safe to order in one task and to broadcast.
    offsets = counts.withColumn("_from", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).drop("_n")
    within = bucketed.withColumn("_rn", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    return within.join(F.broadcast(offsets), "_b").withColumn(
        name, F.col("_from") + F.col("_rn") - 1).drop("_b", "_rn", "_from")


def ordered_index(df: DataFrame, keys: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """Adds the dense 0-based place of a row in its group, in the order of ``order``.

    The rows are stored in ranges of (keys, order) and numbered inside their range; a group's ranges, one count each,
    add what lies before. So many tasks number one large group.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(tasks, *keys, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_from", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p")) - F.col("_n")).drop("_n")
    within = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order)))
    return within.join(offsets, [*keys, "_p"]).withColumn(name, F.col("_from") + F.col("_rn") - 1).drop("_p", "_rn", "_from")
