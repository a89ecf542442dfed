"""Mixing sources to target weights by hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import WORD, shuffle_partitions
from tallymark.session import stored

# Bits of a document's hash, bits resolved by one histogram, and the number of boundary units ordered at last.
HASH_BITS, LEVEL_BITS, FEW = 60, 12, 4096


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """``docs`` with ``_mx_source``, ``_mx_size`` (words) and ``_mx_h``, a hash of id and text in [0, 2**60)."""
    name = F.concat_ws(
        ":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(text_col, F.lit(""))))
    return docs.withColumns({
        "_mx_source": F.col(source_col), "_mx_size": F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long"),
        "_mx_h": F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")})


def numbered_sources(sources: DataFrame) -> DataFrame:
    """``sources`` with ``_mx_i``, their 0-based place by code point, null last.

    Ranges are numbered side by side: a stored range partitioning, a count per range, and a row number inside it.
    """
    spark = sources.sparkSession
    order = [F.col("_mx_source").asc_nulls_last()]
    ranged = stored(
        sources.repartitionByRange(shuffle_partitions(spark), *order).withColumn("_mx_part", F.spark_partition_id()), "sources")
    before = ranged.groupBy("_mx_part").count().select(
        "_mx_part", (F.sum("count").over(Window.orderBy("_mx_part")) - F.col("count")).alias("_mx_before"))
    inside = ranged.withColumn("_mx_in", F.row_number().over(Window.partitionBy("_mx_part").orderBy(*order)) - 1)
    return inside.join(before, "_mx_part").withColumn("_mx_i", F.col("_mx_before") + F.col("_mx_in")).drop(
        "_mx_part", "_mx_before", "_mx_in")


def shares(sources: DataFrame, weight: Column, total_share: float, max_repeat: int) -> DataFrame:
    """``sources`` (with ``_mx_total``) plus ``target``: weighted shares, none above ``max_repeat`` times its source.

    Each round sets aside the sources above their limit and shares the rest anew; a round is one aggregate of one row.
    """
    rows = stored(sources.withColumn("_mx_w", weight.cast("long")), "weights")
    cap = F.col("_mx_total").cast("double") * max_repeat
    total, open_w = rows.agg(F.coalesce(F.sum("_mx_total"), F.lit(0)), F.coalesce(F.sum("_mx_w"), F.lit(0))).first()
    rest, found = float(total) * total_share, 0
    whole = rest
    while True:
        share = F.col("_mx_w").cast("double") * F.lit(rest) / F.lit(float(open_w or 1))
        # A share only grows from round to round, so what was above its limit stays there.
        n, held, open_w = rows.agg(
            F.count_if(share > cap), F.coalesce(F.sum(F.when(share > cap, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(share <= cap, F.col("_mx_w"))), F.lit(0))).first()
        if n == found:
            return rows.withColumn("target", F.least(share, cap))
        found, rest = n, whole - held


def thresholds(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` plus ``_mx_times`` (whole passes) and ``_mx_cut``: documents with a hash up to it are taken once more.

    Sizes are summed by source and hash bucket; only the bucket in which a budget ends is looked at again, with the next
    bits of the hash, until few units are left there. Equal hashes are one unit. A unit is taken if at least half of it
    fits, so a source misses its budget by half a document at most.
    """
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("_mx_total"))), F.lit(0)).cast("long")
    state = stored(sources.withColumn("_mx_times", whole).select(
        "_mx_source", "_mx_total", "target", "_mx_times", (F.col("target") - F.col("_mx_times") * F.col("_mx_total")).alias("_mx_budget"),
        F.lit(0).cast("long").alias("_mx_done"), F.lit(0).cast("long").alias("_mx_prefix")), "budgets")
    left, shift = rows, HASH_BITS
    running = Window.partitionBy("_mx_source").orderBy("_mx_b")
    while shift > 0:
        shift -= LEVEL_BITS
        histogram = left.groupBy("_mx_source", F.shiftright("_mx_h", shift).alias("_mx_b")).agg(
            F.sum("_mx_size").alias("_mx_s"), F.count(F.lit(1)).alias("_mx_n"))
        upto = histogram.withColumn("_mx_to", F.sum("_mx_s").over(running))
        st = state.drop("_mx_n").alias("s")
        # The bucket in which the budget ends is the first whose running sum exceeds it.
        ends = upto.join(st, upto["_mx_source"].eqNullSafe(F.col("s._mx_source"))).where(
            F.col("_mx_done") + F.col("_mx_to") > F.col("_mx_budget")).groupBy(F.col("s._mx_source").alias("_mx_key")).agg(
            F.min(F.struct("_mx_b", (F.col("_mx_done") + F.col("_mx_to") - F.col("_mx_s")).alias("done"), "_mx_n")).alias("e"))
        state = stored(st.join(ends, F.col("s._mx_source").eqNullSafe(F.col("_mx_key")), "left").select(
            "s._mx_source", "_mx_total", "target", "_mx_times", "_mx_budget", F.coalesce("e.done", "_mx_done").alias("_mx_done"),
            # No such bucket: the budget is above all that is left, and every hash there is below the threshold.
            F.coalesce("e._mx_b", F.lit(-1)).cast("long").alias("_mx_prefix"), F.coalesce("e._mx_n", F.lit(0)).alias("_mx_n")), "budgets")
        edge = state.where("_mx_prefix >= 0").select(F.col("_mx_source").alias("_mx_key"), "_mx_prefix")
        left = left.join(edge, left["_mx_source"].eqNullSafe(F.col("_mx_key")) & (F.shiftright("_mx_h", shift) == F.col("_mx_prefix"))).select(
            "_mx_source", "_mx_size", "_mx_h")
        if not state.where(F.col("_mx_n") > FEW).limit(1).count():
            break
        left = stored(left, "boundary")
    units = left.groupBy("_mx_source", "_mx_h").agg(F.sum("_mx_size").alias("_mx_s"))
    before = F.sum("_mx_s").over(Window.partitionBy("_mx_source").orderBy("_mx_h")) - F.col("_mx_s")
    placed = units.withColumn("_mx_before", before).withColumnRenamed("_mx_source", "_mx_key")
    st = state.alias("s")
    fits = 2 * (F.col("_mx_done") + F.col("_mx_before")) + F.col("_mx_s") <= 2 * F.col("_mx_budget")
    last = placed.join(st, F.col("_mx_key").eqNullSafe(F.col("s._mx_source"))).where(fits).groupBy("_mx_key").agg(
        F.max("_mx_h").alias("_mx_last"))
    cut = F.when(F.col("_mx_prefix") < 0, F.lit(2**HASH_BITS)).otherwise(
        F.coalesce("_mx_last", F.shiftleft("_mx_prefix", shift) - 1))
    return st.join(last, F.col("s._mx_source").eqNullSafe(F.col("_mx_key")), "left").select(
        "s._mx_source", "_mx_total", "target", "_mx_times", cut.cast("long").alias("_mx_cut"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), total_share: float = 1.0, max_repeat: int = 3, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) plus ``size`` (words), ``source_size``, ``target`` and ``times``, how often the mix takes the document.

    Sources by code point, null last, weigh ``weights`` in turn and share ``total_share`` of all words; none is taken
    more than ``max_repeat`` times. Whole passes come first; the rest of a budget goes to documents in hash order, by a
    threshold per source, without sorting. Null text and text without words have size 0. A null id hashes as an empty
    one; rows equal in id and text share their hash and their fate. Input columns with the names of results are
    replaced. An empty table gives an empty result. All columns: the documents are read twice, for sizes and to apply the
    thresholds. With ``keep`` these columns are written beside the sizes and the documents are read once.
    """
    everything = sized(docs, id_col, text_col, source_col, seed)
    rows = stored(everything.select(*(keep or ()), "_mx_source", "_mx_size", "_mx_h"), "sizes")
    cuts = stored(source_cuts(rows.select("_mx_source", "_mx_size", "_mx_h"), weights, total_share, max_repeat), "cuts")
    return applied(rows if keep else everything, list(keep or docs.columns), cuts)


def source_cuts(rows: DataFrame, weights: tuple[int, ...], total_share: float, max_repeat: int) -> DataFrame:
    """One row per source: size, target, whole passes and hash threshold, from (_mx_source, _mx_size, _mx_h)."""
    sources = numbered_sources(rows.groupBy("_mx_source").agg(F.sum("_mx_size").alias("_mx_total")))
    turn = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("_mx_i") % len(weights)).cast("int"))
    return thresholds(rows, shares(sources, turn, total_share, max_repeat))


def applied(rows: DataFrame, columns: list[str], cuts: DataFrame) -> DataFrame:
    kept = [c for c in columns if c not in ("size", "source_size", "target", "times")]
    right = cuts.withColumnsRenamed({"_mx_source": "_mx_key", "target": "_mx_target"})
    joined = rows.join(right, rows["_mx_source"].eqNullSafe(F.col("_mx_key")))
    times = F.col("_mx_times") + (F.col("_mx_h") <= F.col("_mx_cut")).cast("long")
    return joined.select(
        *kept, F.col("_mx_size").alias("size"), F.col("_mx_total").alias("source_size"), F.col("_mx_target").alias("target"),
        times.alias("times"))
