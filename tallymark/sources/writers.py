"""Writers. Ordered outputs are range-partitioned by Spark: the files, read in name order, are in order."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.ordering import CONFIG_ORDER
from tallymark.operators.gate import baseline_order, promote_baseline
from tallymark.operators.sampling import sampled_pools

# Decimals printed per summary column; four elsewhere.
DECIMALS = {
    "latency_mean_ms": 0, "latency_p50_ms": 0, "latency_p95_ms": 0, "latency_ms": 0,
    "input_tokens_mean": 1, "output_tokens_mean": 1, "thinking_tokens_mean": 1, "usd_per_1k_docs": 2,
}


def fixed(value: Column, digits: int = 4) -> Column:
    """Text with a fixed number of decimals, half away from zero; null stays null."""
    return F.replace(F.format_number(F.round(value.cast("double"), digits), digits), F.lit(","), F.lit(""))


def _printed(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))]
    return df.withColumns({c: fixed(F.col(c), DECIMALS.get(c, 4)) for c in doubles})


def write_golden(df: DataFrame, path: str) -> None:
    """JSON Lines ordered by id, with explicit nulls."""
    df.orderBy("id").write.option("ignoreNullFields", False).json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Summary rows as CSV: one file, since there is one row per run, configuration and subset."""
    _printed(df).orderBy("execution", "config", "subset").coalesce(1).write.option("header", True).option(
        "escape", '"').option("emptyValue", "").csv(path)


def write_documents(df: DataFrame, path: str) -> None:
    """Per-document scores, one directory per execution. Rows of one execution may lie in many files."""
    clean = df.withColumn("errors", F.regexp_replace("errors", r"\r\n|[\r\n]", " ")) if "errors" in df.columns else df
    _printed(clean).write.partitionBy("execution").option("header", True).option("escape", '"').csv(path)


def write_baseline(cells: DataFrame, thresholds: DataFrame, path: str, ranked=CONFIG_ORDER) -> None:
    """The gated cells in configuration order, then in the order of the thresholds."""
    gated = promote_baseline(cells, thresholds).withColumn("value", fixed(F.col("value")))
    baseline_order(gated, thresholds, ranked).coalesce(1).write.option("header", True).csv(path)


def write_pairs(df: DataFrame, path: str) -> None:
    df.orderBy("id").write.option("ignoreNullFields", False).json(path)


def write_pools(
    converted: DataFrame, path: str, count: int, dev_strata: int, dev_count: int, seed: int,
    key: str = "name", stratum: str = "layout",
) -> None:
    """Two datasets, written at once: a sample of the held-out strata under ``pool=dev``, one of the rest under ``pool=golden``."""
    sampled_pools(converted, key, stratum, count, dev_strata, dev_count, seed).orderBy("pool", key).write.option(
        "ignoreNullFields", False).partitionBy("pool").json(path)


def _text_files(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive ordered by path. A file gets its name when it is whole, so one of a failed attempt is never read."""
        files, base = pafs.FileSystem.from_uri(root)
        made, at, out = set(), None, None

        def close():
            if out is not None:
                out.close()
                files.move(hidden, f"{base}/{at}")

        for batch in batches:
            for path, text in zip(batch["path"].to_pylist(), batch["text"]):
                if path != at:
                    close()
                    folder = f"{base}/{path}".rpartition("/")[0]
                    if folder not in made:
                        files.create_dir(folder, recursive=True)
                        made.add(folder)
                    at, hidden = path, f"{folder}/.{uuid.uuid4().hex}"
                    out = files.open_output_stream(hidden)
                out.write(text.as_buffer())
                out.write(b"\n")
        close()
        return iter(())
    return run


def write_text_layers(df: DataFrame, root: str) -> None:
    """A file per path of ``df`` (path, text) below ``root``, as ``read_text_layers`` reads them.

    Every text ends with a line feed, as Spark's text files do, since a scan leaves out files of no bytes; null is an empty
    text. Rows of one path go to one file. Tasks write the files themselves: a file writer of Spark makes a
    temporary folder and an output per file, which on a local or mounted disk starts three processes for each.
    ``root`` is a folder that all tasks share, of a kind that ``pyarrow.fs`` opens.
    """
    rows = df.select(F.col("path").cast("string").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows.repartition("path").sortWithinPartitions("path", "text").mapInArrow(
        _text_files(re.sub("^file:/+", "/", root.rstrip("/"))), "none int").write.format("noop").mode("overwrite").save()
