"""Line-item matching.

Golden lines are visited in order; each takes the unused predicted line whose amount agrees within the tolerance and
whose description overlaps most, if that overlap reaches the minimum; ties go to the earliest predicted line. The
order matters, so no plain join gives the result. Two forms:

* :func:`line_match` works on the arrays inside a document row (one document is one record) and shuffles nothing.
* :func:`match_line_tables` works on line *tables*, where a document may be of any length. Lines whose amounts lie
  further apart than the tolerance can never meet, so a document splits into runs of neighbouring amounts that are
  matched apart and summed; no task needs the whole document. Inside a run, lines of one side with equal amounts and
  token sets are one entry with their places, so descriptions are compared once per pair of entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.amounts import TOLERANCE, amount_match
from tallymark.functions.names import token_jaccard, tokens

# Fixed value: the smallest description overlap of a match, inclusive.
MIN_OVERLAP = 0.5


def _prepared(lines: Column) -> Column:
    return F.transform(lines, lambda line, i: F.struct(
        i.alias("i"), line["amount"].alias("amount"), tokens(line["description"]).alias("tokens")))


def _fold(golden: Column, predicted: Column, min_overlap: float, tol) -> Column:
    def step(state, line):
        near = F.filter(state["left"], lambda x: amount_match(line["amount"], x["amount"], tol))
        ranked = F.transform(near, lambda x: F.struct(
            (-token_jaccard(line["tokens"], x["tokens"])).alias("key"), x["i"].alias("i")))
        best = F.array_min(F.filter(ranked, lambda x: x["key"] <= F.lit(-min_overlap)))
        return F.when(best.isNull(), state).otherwise(F.struct(
            (state["matched"] + 1).alias("matched"),
            F.filter(state["left"], lambda x: x["i"] != best["i"]).alias("left")))

    start = F.struct(F.lit(0).alias("matched"), predicted.alias("left"))
    return F.aggregate(golden, start, step, lambda state: state["matched"])


def _fold_entries(golden: Column, predicted: Column, min_overlap: float, tol) -> Column:
    """Matches of two arrays of entries struct(amount, tokens, places), the places of an entry in order.

    The lines of the golden entries are visited in golden order. An entry's options are the predicted entries that it can
    match, best overlap first; a line takes the first option with a place left, of equal overlaps the earliest place.
    """
    def options(g):
        rated = F.transform(predicted, lambda p, j: F.struct(
            F.when(amount_match(g["amount"], p["amount"], tol), -token_jaccard(g["tokens"], p["tokens"])).alias("key"), j.alias("j")))
        return F.array_sort(F.filter(rated, lambda x: x["key"] <= F.lit(-min_overlap)))

    visits = F.array_sort(F.flatten(F.transform(golden, lambda g, i: F.transform(g["places"], lambda at: F.struct(at.alias("at"), i.alias("i"))))))
    # What stays the same is carried along, so it is worked out once and not for every line.
    start = F.struct(
        F.lit(0).alias("matched"), F.transform(predicted, lambda p: F.lit(0)).alias("used"),
        F.transform(golden, options).alias("options"), F.transform(predicted, lambda p: p["places"]).alias("places"))

    def step(state, visit):
        used, places = state["used"], state["places"]
        free = F.filter(F.get(state["options"], visit["i"]), lambda o: F.get(used, o["j"]) < F.size(F.get(places, o["j"])))
        top = F.get(free, F.lit(0))["key"]
        taken = F.array_min(F.transform(F.filter(free, lambda o: o["key"] == top), lambda o: F.struct(
            F.get(F.get(places, o["j"]), F.get(used, o["j"])).alias("at"), o["j"].alias("j"))))["j"]
        return F.when(taken.isNull(), state).otherwise(F.struct(
            (state["matched"] + 1).alias("matched"), F.transform(used, lambda u, j: u + (j == taken).cast("int")).alias("used"),
            state["options"].alias("options"), places.alias("places")))

    return F.aggregate(visits, start, step, lambda state: state["matched"])


def line_match(golden_lines: Column, predicted_lines: Column, min_overlap: float = MIN_OVERLAP, tol=TOLERANCE) -> Column:
    """Number of matched lines of two line arrays; null when the golden array is null.

    Arrays printed alike are settled without the fold: a line always finds itself or an equal line before it.
    """
    folded = _fold(_prepared(golden_lines), _prepared(predicted_lines), min_overlap, tol)
    alike = (F.size(golden_lines) == F.size(predicted_lines)) & F.forall(F.zip_with(golden_lines, predicted_lines, lambda g, p: (
        g["amount"].eqNullSafe(p["amount"]) & g["description"].eqNullSafe(p["description"]))), lambda same: same)
    itself = F.size(F.filter(golden_lines, lambda line: amount_match(line["amount"], line["amount"], tol)))
    matched = F.when(alike & F.lit(min_overlap <= 1), itself).otherwise(folded)
    return F.when(golden_lines.isNull(), F.lit(None)).when(predicted_lines.isNull(), F.lit(0)).otherwise(matched)


def line_items_prf(matched: Column, n_golden: Column, n_predicted: Column) -> Column:
    """struct(precision, recall, f1). Two empty sides are perfect; a ratio over an empty side is 0."""
    precision = F.when(n_predicted == 0, (n_golden == 0).cast("double")).otherwise(matched / F.nullif(n_predicted, F.lit(0)))
    recall = F.when(n_golden == 0, (n_predicted == 0).cast("double")).otherwise(matched / F.nullif(n_golden, F.lit(0)))
    both = precision + recall
    f1 = F.when(both == 0, F.lit(0.0)).otherwise(2 * precision * recall / F.nullif(both, F.lit(0.0)))
    applies = n_golden.isNotNull()
    return F.struct(
        F.when(applies, precision).alias("precision"), F.when(applies, recall).alias("recall"),
        F.when(applies, f1).alias("f1"))


def line_items(scored: DataFrame, tol=TOLERANCE) -> DataFrame:
    """Adds line-item precision, recall and F1. An unparsed answer counts as no predicted lines."""
    gold, pred = F.col("expected.lineItems"), F.col("predicted.lineItems")
    counted = scored.withColumn("_m", line_match(gold, pred, tol=tol))
    n_gold = F.when(gold.isNotNull(), F.size(gold))
    n_pred = F.when(pred.isNull(), F.lit(0)).otherwise(F.size(pred))
    rated = counted.withColumn("_prf", line_items_prf(F.col("_m"), n_gold, n_pred))
    return rated.withColumns({
        "line_items_precision": F.col("_prf.precision"), "line_items_recall": F.col("_prf.recall"),
        "line_items_f1": F.col("_prf.f1"),
    }).drop("_m", "_prf")


def match_line_tables(
    golden: DataFrame, predicted: DataFrame, keys: list[str], min_overlap: float = MIN_OVERLAP, tol=TOLERANCE,
    documents: DataFrame | None = None,
) -> DataFrame:
    """(keys, n_golden, n_predicted, matched) for line tables with columns (keys, idx, description, amount).

    A line without an amount is counted but never matches. ``documents`` lists by ``keys`` those with annotated lines,
    which may be none; without it, documents absent from ``golden`` are absent from the result.
    """
    sides = golden.select(*keys, F.lit(True).alias("is_golden"), "idx", "description", "amount").unionByName(
        predicted.select(*keys, F.lit(False).alias("is_golden"), "idx", "description", "amount"))
    counts = sides.groupBy(*keys).agg(
        F.count_if("is_golden").alias("n_golden"), F.count_if(~F.col("is_golden")).alias("n_predicted"))

    # Runs of neighbouring amounts, found over the distinct amounts of a document rather than its lines.
    by_amount = Window.partitionBy(*keys).orderBy("amount")
    amounts = sides.where(F.col("amount").isNotNull()).groupBy(*keys, "amount").agg(
        F.bool_or("is_golden").alias("g"), F.bool_or(~F.col("is_golden")).alias("p"))
    gap = F.col("amount") - F.lag("amount").over(by_amount)
    runs = amounts.withColumn("_new", F.coalesce(gap > F.lit(tol), F.lit(True)).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(by_amount)).drop("g", "p", "_new")

    placed = sides.where(F.col("amount").isNotNull()).join(runs, [*keys, "amount"])
    kinds = placed.withColumn("tokens", F.array_sort(tokens(F.col("description")))).groupBy(
        *keys, "_run", "is_golden", "amount", "tokens").agg(F.array_sort(F.collect_list("idx")).alias("places"))
    entry = F.struct("amount", "tokens", "places")
    grouped = kinds.groupBy(*keys, "_run").agg(
        F.collect_list(F.when(F.col("is_golden"), entry)).alias("gold"), F.collect_list(F.when(~F.col("is_golden"), entry)).alias("pred"))
    hits = grouped.where((F.size("gold") > 0) & (F.size("pred") > 0)).select(
        *keys, _fold_entries(F.col("gold"), F.col("pred"), min_overlap, tol).alias("m"))
    matched = hits.groupBy(*keys).agg(F.sum("m").alias("matched"))
    if documents is None:
        known = counts.where("n_golden > 0")
    else:
        known = documents.select(*keys).distinct().join(counts, keys, "left").fillna(0, ["n_golden", "n_predicted"])
    return (
        known.join(matched, keys, "left")
        .withColumn("matched", F.coalesce("matched", F.lit(0)).cast("long"))
    )
