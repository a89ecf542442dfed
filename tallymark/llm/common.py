"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the white space of the contracts, [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """``A-Z`` lower-cased and nothing else. Pure ASCII takes the fast path of ``lower``, which is the same there."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def pair_hash(col: Column) -> tuple[Column, Column]:
    """128 bits of hash as two longs, which aggregate and join faster than a digest string."""
    return F.xxhash64(col), F.xxhash64(F.lit(1), col)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Places of a membership filter: a broadcast of at most four million bytes, whatever the size of the tables.
PLACES = 1 << 25


def maybe_in(rows: DataFrame, keys: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``rows`` without most of those whose ``columns`` are not in ``keys``, before a join shuffles them; none in ``keys`` is lost."""
    place = F.pmod(F.xxhash64(*columns), F.lit(PLACES)) + 1
    bits = keys.select(place.alias("_m_at")).groupBy(F.bitmap_bucket_number("_m_at").alias("_m_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_m_at")).alias("_m_bits"))
    at = rows.withColumn("_m_at", place).join(F.broadcast(bits), F.bitmap_bucket_number("_m_at") == F.col("_m_bucket"))
    bit = F.bitmap_bit_position("_m_at")
    byte = F.conv(F.hex(F.col("_m_bits").substr(F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return at.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)
