"""Removal of lines that several documents share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import SPACE, ascii_lower, pair_hash


def line_key(line):
    """A line without white space at both ends, ``A-Z`` lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2,
) -> DataFrame:
    """``docs`` with shared lines dropped from the text, plus ``n_lines`` (before) and ``n_dropped``.

    A line whose key has at least ``min_chars`` code points and occurs in at least ``min_docs`` documents stays only in
    the smallest id that holds it (there, with all its repeats). Lines are exploded, hashed to 128 bits, counted by
    distinct document, and only positions travel back; the text itself is shuffled once, by id.

    Null or empty text is one empty line and comes back empty. Rows without an id count together as one document that
    is never the smallest. Repeated rows of an id count once; each keeps or loses its own lines. Other columns are kept;
    input columns named ``n_lines`` or ``n_dropped`` are replaced. An empty table gives an empty result.
    """
    base = docs.withColumns({
        "_ld_lines": F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), "_ld_row": F.xxhash64(text_col)})
    key = line_key(F.col("_ld_line"))
    lines = base.select(
        F.col(id_col).alias("_ld_id"), "_ld_row", F.posexplode("_ld_lines").alias("_ld_pos", "_ld_line"),
    ).withColumn("_ld_key", key).where(F.char_length("_ld_key") >= min_chars)
    h1, h2 = pair_hash(F.col("_ld_key"))
    hashed = lines.select("_ld_id", "_ld_row", "_ld_pos", h1.alias("_ld_h1"), h2.alias("_ld_h2"))

    # Distinct documents first, so that repeats inside a document do not count; both steps combine before they shuffle.
    shared = (
        hashed.select("_ld_h1", "_ld_h2", "_ld_id").distinct()
        .groupBy("_ld_h1", "_ld_h2").agg(F.count(F.lit(1)).alias("_ld_n"), F.min("_ld_id").alias("_ld_first"))
        .where(F.col("_ld_n") >= min_docs).drop("_ld_n"))
    dropped = (
        hashed.join(shared, ["_ld_h1", "_ld_h2"]).where(~F.col("_ld_id").eqNullSafe(F.col("_ld_first")))
        .groupBy("_ld_id", "_ld_row").agg(F.collect_set("_ld_pos").alias("_ld_drop")))

    # The lines are split below the join, so the lambda above it reads a stored array.
    left = base.drop(text_col).alias("l")
    right = dropped.withColumnRenamed("_ld_row", "_ld_row2")
    joined = left.join(right, F.col(f"l.{id_col}").eqNullSafe(F.col("_ld_id")) & (F.col("l._ld_row") == F.col("_ld_row2")), "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("_ld_lines") - 1), F.col("_ld_drop"))
    kept = F.when(F.col("_ld_drop").isNull(), F.col("_ld_lines")).otherwise(F.transform(places, lambda i: F.get("_ld_lines", i)))
    out = joined.withColumns({
        text_col: F.array_join(kept, "\n"), "n_lines": F.size("_ld_lines").cast("long"),
        "n_dropped": F.coalesce(F.size("_ld_drop"), F.lit(0)).cast("long")})
    wanted = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*wanted, "n_lines", "n_dropped")
