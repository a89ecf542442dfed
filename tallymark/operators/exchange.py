"""Replay of stored responses, score export, snapshots and cost estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.hashing import item_id
from tallymark.operators.ranks import global_index
from tallymark.operators.summary import cost
from tallymark.session import scratch_path

# Estimate heuristics.
CHARS_PER_TOKEN = 3.5
SCHEMA_OVERHEAD_TOKENS = 600
MARGIN = 1.2
JUDGE_OUTPUT_TOKENS = 80
CALIBRATION_OVERHEAD_TOKENS, CALIBRATION_OUTPUT_TOKENS = 300, 80
TOOL_USE_OVERHEAD_TOKENS = 350
TOOL_TURN_OUTPUT_TOKENS = 120
TOOL_ROUND_HISTORY_TOKENS = 200
EXPECTED_TURNS = 3
QUALITY_TEMPLATE_TOKENS, QUALITY_OUTPUT_TOKENS = 1200, 300
EXCERPT_CHARS = 1500

# Score export.
BATCH_SIZE, COMMENT_CHARS = 100, 500


# ---------- replay ----------

def request_fingerprint() -> Column:
    """Content key of a request: model, messages, options and tool definitions."""
    return F.sha2(F.to_json(F.struct("model", "messages", "options", "tools"), {"ignoreNullFields": "false"}), 256)


def replay_join(requests: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(served, misses). ``responses`` holds (fingerprint, response_text, latency_ms); the original latency is kept.

    Only the fingerprint travels with a request's own key columns: prompts and texts are hashed before the shuffle. The
    join is made and written once, in a folder per state, so each output reads its own rows and neither joins again.
    """
    keyed = requests.withColumn("fingerprint", request_fingerprint()).drop("model", "messages", "options", "tools")
    kept = responses.groupBy("fingerprint").agg(F.min(F.struct("response_text", "latency_ms")).alias("r")).select(
        "fingerprint", "r.*")
    joined = keyed.join(kept.withColumn("_hit", F.lit(True)), "fingerprint", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    path = scratch_path(requests.sparkSession, "replayed")
    joined.write.partitionBy("_hit").parquet(path)
    back = requests.sparkSession.read.schema(joined.schema).parquet(path)
    return back.where("_hit").drop("_hit"), back.where("NOT _hit").select(*keyed.columns)


# ---------- export ----------

def score_export(doc_metrics: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """(id, trace_id, name, value, comment, batch): one row per metric that has a value, in batches of ``size``.

    ``doc_metrics`` has (trace_id, metric, value, reason).
    """
    rows = doc_metrics.where(F.col("value").isNotNull()).select(
        F.concat_ws("-", "trace_id", "metric").alias("id"), "trace_id", F.col("metric").alias("name"), "value",
        F.when(F.length("reason") > COMMENT_CHARS, F.concat(F.substring("reason", 1, COMMENT_CHARS), F.lit("…"))).otherwise(
            F.col("reason")).alias("comment"))
    numbered = global_index(rows, F.col("id"), ["id"], "_i")
    return numbered.withColumn("batch", F.expr(f"_i div {size}")).drop("_i")


def snapshot_sync(current: DataFrame, previous: DataFrame, prefix: str) -> DataFrame:
    """(doc_id, item_id, status): documents of now are ACTIVE under a fixed id, vanished ones ARCHIVED, none deleted."""
    now = current.select("doc_id").distinct().withColumn("_now", F.lit(True))
    before = previous.select("doc_id", F.col("item_id").alias("_old"))
    return now.join(before, "doc_id", "full_outer").select(
        "doc_id", F.when(F.col("_now"), item_id(F.col("doc_id"), prefix)).otherwise(F.col("_old")).alias("item_id"),
        F.when(F.col("_now"), "ACTIVE").otherwise("ARCHIVED").alias("status"))


# ---------- estimates ----------

def _one_price(prices: DataFrame, model: str) -> DataFrame:
    """The single price row of a model; a missing price stops the job rather than giving a free run."""
    row = prices.where(F.col("model") == model).agg(
        F.max("input_per_mtok").cast("double").alias("input_per_mtok"),
        F.max("output_per_mtok").cast("double").alias("output_per_mtok"))
    return row.withColumn("input_per_mtok", F.coalesce("input_per_mtok", F.raise_error(F.lit(f"no price for {model}")).cast("double")))


def _priced(totals: DataFrame, prices: DataFrame, model: str) -> DataFrame:
    return totals.join(F.broadcast(_one_price(prices, model))).withColumn(
        "usd", cost(F.col("input_tokens"), F.col("output_tokens"))
    ).withColumn("usd_per_1k", F.col("usd") / F.greatest(F.col("docs"), F.lit(1)) * 1000).drop(
        "input_per_mtok", "output_per_mtok")


def _sizes(docs: DataFrame) -> DataFrame:
    """One row: documents, text characters, golden JSON characters. Everything the estimates need of the table."""
    return docs.agg(
        F.count("*").alias("docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("double").alias("text_chars"),
        F.coalesce(F.sum(F.length("expected_json")), F.lit(0)).cast("double").alias("json_chars"))


def estimate_direct(docs: DataFrame, prompt_chars: int, prices: DataFrame, model: str, margin: float = MARGIN) -> DataFrame:
    """(docs, input_tokens, output_tokens, usd, usd_per_1k) for (text, expected_json) documents, one call each."""
    n = F.col("docs")
    totals = _sizes(docs).select(
        "docs",
        (((n * prompt_chars + F.col("text_chars")) / CHARS_PER_TOKEN + n * SCHEMA_OVERHEAD_TOKENS) * margin).alias("input_tokens"),
        (F.col("json_chars") / CHARS_PER_TOKEN * margin).alias("output_tokens"))
    return _priced(totals, prices, model)


def estimate_agent(
    docs: DataFrame, prompt_chars: int, tool_chars: int, prices: DataFrame, model: str, judge_model: str,
    turns=(3, 7), margin: float = MARGIN,
) -> DataFrame:
    """One row per number of turns, and one (``turns`` 0) for the two quality-judge calls per document."""
    n = F.col("docs")
    tools = tool_chars / CHARS_PER_TOKEN + TOOL_USE_OVERHEAD_TOKENS
    request = (n * prompt_chars + F.col("text_chars")) / CHARS_PER_TOKEN
    t = F.col("turns")
    sizes = _sizes(docs)
    runs = sizes.withColumn("turns", F.explode(F.array(*[F.lit(x) for x in turns]))).select(
        "turns", "docs",
        ((t * (request + n * (SCHEMA_OVERHEAD_TOKENS + tools)) + n * TOOL_ROUND_HISTORY_TOKENS * t * (t - 1) / 2.0)
         * margin).alias("input_tokens"),
        ((n * (t - 1) * TOOL_TURN_OUTPUT_TOKENS + F.col("json_chars") / CHARS_PER_TOKEN) * margin).alias("output_tokens"))
    judges = sizes.select(
        F.lit(0).alias("turns"), "docs",
        ((n * (QUALITY_TEMPLATE_TOKENS + tools + EXPECTED_TURNS * TOOL_ROUND_HISTORY_TOKENS) + request) * 2 * margin).alias("input_tokens"),
        (n * 2 * QUALITY_OUTPUT_TOKENS * margin).alias("output_tokens"))
    return _priced(runs, prices, model).unionByName(_priced(judges, prices, judge_model))


def estimate_judge(docs: DataFrame, prompt_chars: int, prices: DataFrame, model: str, margin: float = MARGIN) -> DataFrame:
    """Upper bound: both names of every document are judged, each with the longest excerpt."""
    per_call = (prompt_chars + EXCERPT_CHARS) / CHARS_PER_TOKEN + SCHEMA_OVERHEAD_TOKENS
    calls = F.col("docs") * 2
    totals = docs.agg(F.count("*").alias("docs")).select(
        "docs", (calls * per_call * margin).alias("input_tokens"), (calls * JUDGE_OUTPUT_TOKENS * margin).alias("output_tokens"))
    return _priced(totals, prices, model)


def estimate_calibration(pairs: DataFrame, prompt_chars: int, prices: DataFrame, model: str) -> DataFrame:
    """One call per pair: its own text and excerpt, without a margin."""
    own = sum((F.length(F.coalesce(c, F.lit(""))) for c in ("golden", "predicted", "excerpt")), F.lit(prompt_chars))
    totals = pairs.agg(
        F.count("*").alias("docs"), F.sum(own / CHARS_PER_TOKEN + CALIBRATION_OVERHEAD_TOKENS).alias("input_tokens"),
        (F.count("*") * CALIBRATION_OUTPUT_TOKENS).cast("double").alias("output_tokens"))
    return _priced(totals, prices, model)
