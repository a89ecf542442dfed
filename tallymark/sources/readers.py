"""Readers. Schemas are declared, never inferred; a malformed record is an error, not a silent null."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.text import doc_key, not_blank
from tallymark.operators.gate import summary_cells
from tallymark.schemas import CELL, GOLDEN, PAIR, RUN_CONFIG
from tallymark.session import setting

INPUT_MODES = ("text", "ocr")
# Names of files that Spark's text reader unpacks.
PACKED = r"\.(gz|bz2|deflate|snappy|lz4|zst)$"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines of golden documents. Blank lines are skipped; a line that is not a golden record stops the job."""
    rows = spark.read.schema(GOLDEN).option("mode", "FAILFAST").option("dateFormat", "yyyy-MM-dd").json(path)
    no_record = F.raise_error(F.lit("null record in the golden set")).cast("string")
    return rows.withColumn("id", F.coalesce(F.col("id"), no_record))


def read_text_layers(spark: SparkSession, root: str) -> DataFrame:
    """(path, text): one row per file below ``root``, keyed by its path relative to ``root``; packed files are unpacked.

    Files are read as bytes, since the text reader copies Hadoop's whole configuration for each; only packed ones go through it.
    """
    # Folders are listed by a few tasks per core: by default every folder is a task, up to 10,000 of them.
    with setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism)):
        plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        packed = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{gz,bz2,deflate,snappy,lz4,zst}")
    file = F.col("_metadata.file_path").alias("file")
    files = plain.where(~F.col("_metadata.file_path").rlike(PACKED)).select(file, F.col("content").cast("string").alias("value")).unionByName(
        packed.select(file, "value"))
    # By default a scan has a task per 32 small files, and a shuffle after it as many outputs per partition.
    files = files.coalesce(16 * spark.sparkContext.defaultParallelism)
    prefix = re.sub("^file:/+", "/", root.rstrip("/")) + "/"
    path = F.url_decode(F.replace(F.regexp_replace("file", r"^file:/+", "/"), F.lit("+"), F.lit("%2B")))
    return files.select(F.substring_index(path, prefix, -1).alias("path"), F.col("value").alias("text"))


def eval_set(golden: DataFrame, synthetic: DataFrame, layers: DataFrame, mode: str) -> DataFrame:
    """Both golden sets with the text shown to the model and the text layer.

    ``ocr`` mode reads the OCR layer where a document has one and falls back to the text layer elsewhere.
    """
    if mode not in INPUT_MODES:
        raise ValueError(f"unknown input mode: {mode}")
    docs = golden.unionByName(synthetic)
    layer = layers.select(F.col("path").alias("textPath"), F.col("text").alias("text_layer"))
    docs = docs.join(layer, "textPath", "left")
    if mode == "text":
        return docs.withColumn("text", F.col("text_layer"))
    ocr = layers.select(F.col("path").alias("_path"), F.col("text").alias("_ocr"))
    # A document without an OCR path gets a key of its own that no file has: it falls back, and null is no hot key.
    own = F.concat(F.lit("\0"), F.col("id").cast("string"))
    keyed = docs.withColumn("_path", F.coalesce("ocrTextPath", own))
    return keyed.join(ocr, "_path", "left").withColumn(
        "text", F.when(F.col("ocrTextPath").isNotNull(), F.col("_ocr")).otherwise(F.col("text_layer"))).drop("_ocr", "_path")


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(RUN_CONFIG).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.fillna({"disableThinking": False, "extractor": "direct"})


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """(model, input_per_mtok, output_per_mtok); keys that start with an underscore are comments."""
    price = "map<string,variant>"
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.map_entries(F.from_json("value", price))).alias("e"))
    return entries.where(~F.startswith("e.key", F.lit("_"))).select(
        F.col("e.key").alias("model"),
        F.variant_get("e.value", "$.inputPerMTok", "decimal(18,6)").alias("input_per_mtok"),
        F.variant_get("e.value", "$.outputPerMTok", "decimal(18,6)").alias("output_per_mtok"))


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(metric, subset, maxDrop, position) in file order; an invalid or empty list is an error."""
    schema = T.StructType([T.StructField("thresholds", T.ArrayType(T.StructType([
        T.StructField("metric", T.StringType()), T.StructField("subset", T.StringType()),
        T.StructField("maxDrop", T.DoubleType())])))])
    file = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    listed = file.where(F.size("thresholds") > 0).withColumn("thresholds", F.col("thresholds"))
    if listed.isEmpty():  # a configuration file: one small row
        raise ValueError(f"{path}: no thresholds")
    rows = listed.select(F.posexplode("thresholds").alias("position", "t")).select("t.*", "position")
    valid = not_blank(F.col("metric")) & not_blank(F.col("subset")) & (F.coalesce("maxDrop", F.lit(0.0)) >= 0)
    wrong = rows.where(~valid)
    if not wrong.isEmpty():
        raise ValueError(f"{path}: a threshold needs metric, subset and maxDrop >= 0")
    return rows.fillna({"maxDrop": 0.0})


def read_summary_csv(spark: SparkSession, path: str, thresholds: DataFrame) -> DataFrame:
    """Metric cells of the latest execution per configuration; a gated metric that is no column is an error."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    # The threshold list is a configuration file, so its metric names may come to the driver.
    metrics = [r.metric for r in thresholds.select("metric").distinct().orderBy("metric").collect()]
    return summary_cells(rows, metrics, digits=None)


def read_baseline_csv(spark: SparkSession, path: str) -> DataFrame:
    """(config, subset, metric, value); the header must be exactly these names."""
    header = spark.read.text(path).where(F.startswith("value", F.lit("config,")))
    if header.where(F.rtrim(F.col("value"), F.lit("\r")) == ",".join(CELL.fieldNames())).isEmpty():
        raise ValueError(f"{path}: expected header {','.join(CELL.fieldNames())}")
    return spark.read.schema(CELL).option("header", True).option("enforceSchema", False).option(
        "mode", "FAILFAST").csv(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR).option("mode", "FAILFAST").json(path)


# ---------- stored results ----------

def _tag(prefix: str):
    hit = F.try_element_at(F.filter("tags", lambda t: F.startswith(t, F.lit(prefix))), F.lit(1))
    return F.coalesce(F.substr(hit, F.lit(len(prefix) + 1)), F.lit(""))


def flatten_results(stored: DataFrame) -> DataFrame:
    """Stored nested results to score rows: tags to columns, metrics to maps, error diagnostics to one text."""
    metrics = F.col("metrics")
    numeric = F.filter(metrics, lambda m: m["numeric"])
    with_outcome = F.filter(metrics, lambda m: m["outcome"].isNotNull())
    errors = F.filter(
        F.flatten(F.transform(metrics, lambda m: F.coalesce(m["diagnostics"], F.array().cast(
            "array<struct<severity:string,message:string>>")))),
        lambda d: d["severity"] == "error")

    def count(c):
        return F.coalesce(c, F.lit(0).cast("long")).alias(c)

    return stored.select(
        "execution", "config", _tag("model:").alias("model"), _tag("prompt:").alias("prompt"),
        _tag("input:").alias("input_mode"), doc_key(F.col("scenario")).alias("doc_id"),
        _tag("source:").alias("source"), _tag("layout:").alias("layout"),
        F.map_from_entries(F.transform(numeric, lambda m: F.struct(m["name"], m["value"]))).alias("values"),
        F.map_from_entries(F.transform(with_outcome, lambda m: F.struct(m["name"], m["outcome"]))).alias("outcomes"),
        F.array_join(F.transform(errors, lambda d: d["message"]), " | ").alias("errors"),
        F.coalesce("stamped_latency_ms", "turn_latency_ms", F.lit(0.0)).alias("latency_ms"),
        count("input_tokens"), count("output_tokens"), count("thinking_tokens"),
        F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"), "response_text")
