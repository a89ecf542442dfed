"""Byte-level BPE: encoding by overlapping chunks, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import shuffle_partitions

# Code points of a chunk, of the overlap with the next one, and the end of a chunk where a match may still change.
CHUNK, OVERLAP, MARGIN = 32_768, 1_024, 4
# Pieces a task remembers, and rows it hands over at once.
MEMO, ROWS = 200_000, 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class PieceEncoder(dict):
    """Ids of pre-tokens as 32-bit integers in bytes, each pre-token merged once while it is remembered."""

    def __init__(self, ranks_path: str, pattern: str):
        super().__init__()
        self.pieces = regex.compile(pattern).findall
        self.merge = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})._encode_single_piece

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        got = self[piece] = np.asarray(self.merge(piece), np.int32).tobytes()
        return got

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text)))


def _starts(pattern: str):
    """For a chunk and its place: the pre-token starts in the zone shared with the chunk before, and with the one after."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).finditer
        for batch in batches:
            heads, tails = [], []
            for i, text in zip(batch["_b_i"].to_pylist(), batch["_b_chunk"].to_pylist()):
                at = i * CHUNK
                starts = [m.start() for m in find(text)]
                end = len(text) - MARGIN
                heads.append([at + s for s in starts if s < OVERLAP])
                tails.append([at + s for s in starts if CHUNK <= s <= end])
            yield pa.RecordBatch.from_arrays(
                [batch["_b_id"], batch["_b_row"], batch["_b_n"], batch["_b_i"], batch["_b_chunk"],
                 pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                ["_b_id", "_b_row", "_b_n", "_b_i", "_b_chunk", "_b_head", "_b_tail"])
    return run


def _offsets(lengths) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())


def _encoded(ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                coded = [encoder.encode(t) for t in part["_b_text"].to_pylist()]
                ids = pa.ListArray.from_arrays(_offsets([len(c) // 4 for c in coded]), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                names = [n for n in part.schema.names if n != "_b_text"]
                yield pa.RecordBatch.from_arrays([*[part[n] for n in names], ids], [*names, "ids"])
    return run


def segments(long: DataFrame, pattern: str) -> DataFrame:
    """(_b_id, _b_row, _b_n, _b_run, _b_text): texts cut at true pre-token starts only.

    Chunk i is pre-tokenised from its own start and covers the next one's first ``OVERLAP`` code points. Matching looks
    only ahead, so from a start that both chunks agree on, chunk i+1 has the true pre-tokens. Where two chunks agree
    nowhere (a run of one kind longer than the overlap), nothing after that place is cut.
    """
    step = F.sequence(F.lit(0), ((F.greatest(F.char_length("_b_text"), F.lit(1)) - 1) / CHUNK).cast("int"))
    chunks = long.select("_b_id", "_b_row", "_b_n", "_b_text", F.explode(step).alias("_b_i")).select(
        "_b_id", "_b_row", "_b_n", "_b_i",
        F.substring(F.col("_b_text"), F.col("_b_i") * CHUNK + 1, F.lit(CHUNK + OVERLAP)).alias("_b_chunk"))
    spread = chunks.repartition(shuffle_partitions(long.sparkSession), "_b_id", "_b_row", "_b_i")
    kind = dict(spread.dtypes)
    found = spread.mapInArrow(
        _starts(pattern), ", ".join(f"{c} {kind[c]}" for c in spread.columns) + ", _b_head array<long>, _b_tail array<long>")
    document = Window.partitionBy("_b_id", "_b_row").orderBy("_b_i")
    meet = F.array_min(F.array_intersect(F.lag("_b_tail").over(document), "_b_head"))
    cut = found.withColumn("_b_meet", F.when(F.col("_b_i") == 0, F.lit(0).cast("long")).otherwise(meet)).withColumn(
        "_b_lost", F.max(F.col("_b_meet").isNull()).over(document)).withColumn(
        "_b_from", F.when(F.col("_b_lost"), F.col("_b_i").cast("long") * CHUNK).otherwise(F.col("_b_meet"))).withColumn(
        "_b_to", F.lead("_b_from").over(document)).withColumn(
        "_b_run", F.count_if(~F.col("_b_lost")).over(document))
    at = F.col("_b_from") - F.col("_b_i") * CHUNK
    length = F.coalesce(F.col("_b_to") - F.col("_b_from"), F.lit(2**31 - 1).cast("long"))
    part = F.substring(F.col("_b_chunk"), (at + 1).cast("int"), length.cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("_b_i", part.alias("t"))))
    return cut.groupBy("_b_id", "_b_row", "_b_n", "_b_run").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("_b_text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>), one row per row of ``docs``; no special tokens.

    Texts of one chunk are encoded where they are read. Longer ones are cut into overlapping chunks, pre-tokenised and
    later encoded in parallel, and put together by position. Null and empty texts have no ids. Rows that repeat an id or
    a whole document are encoded and returned each; null ids are kept. Other columns are not used. ``ranks_path`` must be
    readable on every executor.
    """
    base = docs.select(F.col(id_col).alias("_b_id"), F.coalesce(text_col, F.lit("")).alias("_b_text"))
    kind = dict(base.dtypes)["_b_id"]
    short = base.where(F.char_length("_b_text") <= CHUNK).mapInArrow(
        _encoded(ranks_path, pattern), f"_b_id {kind}, ids array<int>")
    # Equal rows are cut once and counted; a digest tells apart texts under one id.
    long = base.where(F.char_length("_b_text") > CHUNK).groupBy("_b_id", "_b_text").agg(F.count(F.lit(1)).alias("_b_n")).withColumn(
        "_b_row", F.md5("_b_text"))
    cut = segments(long, pattern).repartition(shuffle_partitions(docs.sparkSession), "_b_id", "_b_row", "_b_run")
    coded = cut.mapInArrow(_encoded(ranks_path, pattern), f"_b_id {kind}, _b_row string, _b_n long, _b_run long, ids array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("_b_run", "ids")))
    whole = coded.groupBy("_b_id", "_b_row", "_b_n").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
    repeated = whole.withColumn("_b_k", F.explode(F.sequence(F.lit(1).cast("long"), "_b_n"))).select("_b_id", "ids")
    return short.unionByName(repeated).withColumnRenamed("_b_id", id_col)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` plus the bytes of its ids. Null ids give null; an id that the ranks do not hold fails the job."""
    kept = [c for c in encoded.columns if c != out_col]
    kinds = dict(encoded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = {rank: token for token, rank in read_ranks(ranks_path).items()}
        tokens = pa.array([by_rank.get(i) for i in range(max(by_rank) + 1)], pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = part[ids_col]
                # Taking tokens by id lays their bytes side by side, so a text is a span of that buffer.
                taken = tokens.take(ids.flatten())
                if taken.null_count:
                    raise KeyError("an id that the ranks do not hold")
                ends = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1)
                spans = ends[np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0))))]
                texts = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(spans), taken.buffers()[2]])
                yield pa.RecordBatch.from_arrays(
                    [*[part[n] for n in kept], pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.binary()))], [*kept, out_col])

    return encoded.select(*kept).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", {out_col} binary")
