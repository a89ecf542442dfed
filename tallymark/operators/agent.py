"""Scoring of tool-using runs from their transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.amounts import TOLERANCE, amount_match, recomputed
from tallymark.functions.answers import warnings_of, whole_json, with_invoice
from tallymark.functions.text import currency_marker, not_blank, trim_ws
from tallymark.schemas import AMOUNT

# Tool names, the warning prefix, and the number of tool rounds a run may take.
VALIDATE_TOTALS, NORMALIZE_CURRENCY = "validate_totals", "normalize_currency"
TOTALS_WARNING = "totals_inconsistent:"
MAX_TOOL_ROUNDS = 6


def final_answer(messages: DataFrame, keys=("doc_id",)) -> DataFrame:
    """(keys, text, parses): the last assistant text that parses, else the last one, else all texts joined.

    Only conversations without any assistant text need their texts gathered; the rest combine map side.
    """
    assistant = (F.col("role") == "assistant") & not_blank(F.col("text"))
    read = with_invoice(messages.withColumn("_said", F.when(assistant, F.col("text"))), "_said")
    rated = read.select(
        *keys, "turn", "text", F.col("_said").isNotNull().alias("_a"), F.col("predicted").isNotNull().alias("_ok"))
    place = F.when(F.col("_a"), F.struct("_ok", "turn"))
    best = rated.groupBy(*keys).agg(
        F.max_by(F.when(F.col("_a"), F.col("text")), place).alias("text"), F.max("_ok").alias("parses"))
    silent = best.where(F.col("text").isNull()).select(*keys)
    joined = messages.join(silent, list(keys), "left_semi").groupBy(*keys).agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))),
                    lambda m: m["text"]), "").alias("_all"))
    return best.join(joined, list(keys), "left").select(
        *keys, F.coalesce("text", "_all").alias("text"), "parses")


def tool_results_join(tool_calls: DataFrame, tool_results: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Calls with ``consistent`` and ``reconciled_total`` of their result; a result that cannot be read as a whole gives nulls.

    Property names are read whatever their case, the last of a name counts, and one value of a wrong type spoils the
    result. Of several results of one call the smallest text counts, so a call stays one row.
    """
    one = tool_results.groupBy(*keys, "call_id").agg(F.min("result").alias("result"))
    entries = F.map_entries(F.try_variant_get(whole_json(F.col("result")), "$", "map<string,variant>"))
    parts = one.withColumn("_e", entries)

    def part(name: str) -> Column:
        return F.try_element_at(F.filter("_e", lambda e: F.lower(e["key"]) == name), F.lit(-1))["value"]

    parts = parts.withColumns({f"_{n}": part(n) for n in ("consistent", "difference", "reconciledtotal")})
    kinds = {n: F.coalesce(F.schema_of_variant(f"_{n}"), F.lit("VOID")) for n in ("consistent", "difference", "reconciledtotal")}
    number = r"^(VOID|BIGINT|DECIMAL.*|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)$"
    sound = kinds["consistent"].isin("BOOLEAN", "VOID") & kinds["difference"].rlike(number) & kinds["reconciledtotal"].rlike(number)
    read = parts.select(
        *keys, "call_id", F.when(sound, F.try_variant_get("_consistent", "$", "boolean")).alias("consistent"),
        F.when(sound, F.try_variant_get("_reconciledtotal", "$", AMOUNT.simpleString())).alias("reconciled_total"))
    return tool_calls.join(read, [*keys, "call_id"], "left")


def agent_behaviour(scored: DataFrame, calls: DataFrame, keys=("doc_id",), tol=TOLERANCE) -> DataFrame:
    """One row per document with the six agent metrics.

    ``scored`` has expected, predicted, response_text and text_layer; ``calls`` comes from :func:`tool_results_join`.
    Calls are counted down per document before they meet the documents, and reconciled totals are made distinct, so a
    document with very many calls costs no more than one with few.
    """
    keys = list(keys)
    used = calls.groupBy(*keys).agg(
        F.count("*").alias("_calls"),
        F.max((F.col("name") == VALIDATE_TOTALS).cast("int")).alias("_validated"),
        F.max((F.col("name") == NORMALIZE_CURRENCY).cast("int")).alias("_normalized"))
    totals = calls.where(
        (F.col("name") == VALIDATE_TOTALS) & ~F.col("consistent") & F.col("reconciled_total").isNotNull()
    ).select(*keys, "reconciled_total").distinct()

    g, p = F.col("expected"), F.col("predicted")
    docs = scored.select(
        *keys, p.isNotNull().alias("_parsed"), p["total"].alias("_total"), g["total"].alias("_printed"),
        (g["subtotal"].isNotNull() & g["total"].isNotNull() & ~amount_match(
            g["total"], recomputed(g["subtotal"], g["discount"], g["tax"]), tol)).alias("_inconsistent"),
        currency_marker(F.col("text_layer")).alias("_marker"),
        F.exists(warnings_of(F.col("response_text")), lambda w: F.startswith(
            F.lower(trim_ws(w)), F.lit(TOTALS_WARNING))).alias("_warned"))
    hits = totals.join(docs.select(*keys, "_total", "_printed"), keys).groupBy(*keys).agg(F.max(F.coalesce(
        ~amount_match(F.col("_total"), F.col("_printed"), tol)
        & amount_match(F.col("_total"), F.col("reconciled_total"), tol), F.lit(False)).cast("double")).alias("_override"))

    joined = docs.join(used, keys, "left").join(hits, keys, "left")
    called = F.coalesce("_normalized", F.lit(0)).cast("double")
    return joined.select(
        *keys,
        F.coalesce("_calls", F.lit(0)).cast("double").alias("tool_call_count"),
        F.coalesce("_validated", F.lit(0)).cast("double").alias("validate_totals_called"),
        F.when(F.col("_marker") == "Symbol", called).alias("normalize_currency_called_symbol"),
        F.when(F.col("_marker") == "Code", called).alias("normalize_currency_called_code"),
        F.when(F.col("_parsed") & F.col("_printed").isNotNull(), F.col("_override")).alias("tool_override"),
        F.when(F.col("_warned"), F.coalesce("_inconsistent", F.lit(False)).cast("double")).alias("totals_warning_correct"))


def usage_rollup(turns: DataFrame, keys=("doc_id",), max_rounds: int = MAX_TOOL_ROUNDS) -> DataFrame:
    """Tokens and latency summed over the model turns of a document, tool rounds, first model id, and the round-limit flag.

    ``turns``: (keys, turn, model, has_tool_call, input_tokens, output_tokens, thinking_tokens, latency_ms).
    """
    tokens = ("input_tokens", "output_tokens", "thinking_tokens")
    rolled = turns.groupBy(*keys).agg(
        *[F.sum(t).alias(t) for t in tokens], F.sum("latency_ms").alias("latency_ms"),
        F.count("*").alias("turns"), F.count_if("has_tool_call").alias("tool_rounds"),
        F.min_by("model", F.when(F.col("model").isNotNull(), F.col("turn"))).alias("model"),
        F.max_by("has_tool_call", "turn").alias("_open"))
    stopped = F.col("_open") | ((F.col("tool_rounds") >= max_rounds) & (F.col("turns") > F.col("tool_rounds")))
    return rolled.withColumn("round_limit", stopped).drop("_open")
