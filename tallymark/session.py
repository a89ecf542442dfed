"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def builder(app: str = "tallymark") -> SparkSession.Builder:
    """A session builder with the settings every job here assumes; the master is left to the caller."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # A property written twice in an answer: the last one counts, instead of failing the answer.
        .config("spark.sql.variant.allowDuplicateKeys", "true")
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage: ``spark.checkpoint.dir``, or ``tallymark.scratch.dir`` where the
    cluster names none. Every table gets a folder of its own there; whoever owns the folder removes it after the job.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tallymark.scratch.dir", None)
    if not shared:
        raise ValueError("spark.checkpoint.dir (or tallymark.scratch.dir) must name a shared folder")
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the scratch folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, to cut lineage where a result is used repeatedly."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, name: str, column: str) -> Iterator[DataFrame]:
    """``stored`` in as many buckets by ``column`` as a shuffle has partitions, so what is run inside can join by it again
    and again without a shuffle of this table. The catalog forgets it afterwards; its files stay, as all of that folder do.
    """
    spark, table = df.sparkSession, f"tallymark_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).option(
        "path", scratch_path(spark, name)).saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session setting ``key`` is ``value`` for what is run inside, and what it was before afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
