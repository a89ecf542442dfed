"""Token counts per document from counts per distinct pre-token."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallymark.llm.common import shuffle_partitions

# Fixed value: the pattern of byte-level pre-tokenizers.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A block of documents ends when it holds so many distinct pre-tokens, occurrences, or rows.
PIECES, HELD, BLOCK_ROWS = 200_000, 3_000_000, 1 << 14
# Counts are handed over by block after so many (pre-token, block) rows.
COUNTED = 300_000


def special_strings(path: str) -> list[str]:
    """Added tokens, which the library takes out of a text before it pre-tokenises. Other kinds of files are refused."""
    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    kind = config.get("pre_tokenizer") or {}
    odd = [t for t in config["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if kind.get("type") != "ByteLevel" or not kind.get("use_regex") or kind.get("add_prefix_space") or config.get("normalizer") or odd:
        raise ValueError(f"{path}: only plain byte-level tokenizers have context-free pre-tokens")
    return [t["content"] for t in config["added_tokens"]]


def splitter(specials: list[str]):
    """A function from a text to its pre-tokens; a special string is one of its own."""
    find = regex.compile(BYTE_LEVEL).findall
    special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None

    def pieces(text: str) -> list[str]:
        if special is None or not special.search(text):
            return find(text)
        out: list[str] = []
        for i, part in enumerate(special.split(text)):
            out += [part] if i % 2 else find(part)
        return out
    return pieces


class _Places(dict):
    """Numbers pre-tokens as they come."""

    def __missing__(self, piece: str) -> int:
        got = self[piece] = len(self)
        return got


def blocks(specials: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, int], list]]:
    """(first row, pre-tokens and their numbers, rows as (id, bytes, numbers)) of one block after another.

    A block is a run of input rows named by its first one. The same rows give the same blocks and numbers each time.
    """
    pieces = splitter(specials)
    place, rows, held, first = _Places(), [], 0, 0
    for batch in batches:
        for row, key, value in zip(batch["_t_row"].to_pylist(), batch["_t_id"], batch["_t_text"]):
            first = first if rows else row
            text = value.as_py()
            found = pieces(text)
            rows.append((key, len(text.encode()), np.fromiter(map(place.__getitem__, found), np.int32, len(found))))
            held += len(found)
            if len(place) >= PIECES or held >= HELD or len(rows) >= BLOCK_ROWS:
                yield first, place, rows
                place, rows, held = _Places(), [], 0
    if rows:
        yield first, place, rows


def _pieces(specials: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, place, _ in blocks(specials, batches):
            names = list(place)
            for a in range(0, len(names), 20_000):
                part = names[a:a + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string()), pa.array(np.full(len(part), block, np.int64)),
                     pa.array(np.arange(a, a + len(part), dtype=np.int32))], ["piece", "block", "number"])
    return run


def packed(numbers: np.ndarray) -> bytes:
    """The distinct numbers of a document with their frequencies, as differences, compressed."""
    distinct, counts = np.unique(numbers, return_counts=True)
    return zlib.compress(np.concatenate((np.diff(distinct, prepend=0), counts)).astype(np.int32).tobytes(), 1)


def total(blob: bytes, tokens: np.ndarray) -> int:
    steps, counts = np.frombuffer(zlib.decompress(blob), np.int32).reshape(2, -1)
    return int(tokens[np.cumsum(steps)] @ counts)


def _frequencies(specials: list[str], kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, rows in blocks(specials, batches):
            for a in range(0, len(rows), 4096):
                part = rows[a:a + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), block, np.int64)), pa.array([k.as_py() for k, _, _ in part], kind),
                     pa.array([n for _, n, _ in part], pa.int64()), pa.array([packed(x) for _, _, x in part], pa.binary())],
                    ["block", "_t_id", "n_bytes", "frequencies"])
    return run


def _counted(path: str):
    """Token counts for rows (piece, block, number) that come sorted by piece: each distinct piece goes to the library once."""
    def by_block(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        block, number, tokens = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(block, kind="stable")
        names, starts = np.unique(block[order], return_index=True)
        split = [np.split(x[order], starts[1:]) for x in (number, tokens)]
        return pa.RecordBatch.from_arrays(
            [pa.array(names), *[pa.array([x.astype(np.int32).tobytes() for x in s], pa.binary()) for s in split]],
            ["block", "numbers", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encode = Tokenizer.from_file(path).encode_batch
        last, last_tokens, held = None, 0, []
        for batch in batches:
            coded = batch["piece"].dictionary_encode()
            names = coded.dictionary.to_pylist()
            known = {last: last_tokens} if last is not None else {}
            new = [n for n in names if n not in known]
            for a in range(0, len(new), 4096):
                known.update(zip(new[a:a + 4096], (len(e.ids) for e in encode(new[a:a + 4096], add_special_tokens=False))))
            counts = np.fromiter((known[n] for n in names), np.int64, len(names))
            held.append((np.asarray(batch["block"]), np.asarray(batch["number"]), counts[np.asarray(coded.indices)]))
            if batch.num_rows:
                last = batch["piece"][batch.num_rows - 1].as_py()
                last_tokens = known[last]
            if sum(len(h[0]) for h in held) >= COUNTED:
                yield by_block(held)
                held = []
        if held:
            yield by_block(held)
    return run


def _summed(documents: pa.Table, counts: pa.Table) -> pa.Table:
    numbers = np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(x.as_py(), np.int32) for x in counts["numbers"]]])
    tokens = np.zeros(numbers.max(initial=-1) + 1, np.int64)
    tokens[numbers] = np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(x.as_py(), np.int32) for x in counts["tokens"]]])
    sums = [total(x.as_py(), tokens) for x in documents["frequencies"]]
    return pa.table([documents["_t_id"], documents["n_bytes"], pa.array(sums, pa.int64())], ["_t_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens), one row per row of ``docs``.

    Pre-tokens are brought together, so that the library counts each distinct one once; the counts go back to the blocks
    of documents that asked for them, are joined there to the pre-token frequencies of every document, and summed. A
    block is a run of input rows of bounded size, so a pre-token of every document is one row per block. No ids are kept
    anywhere. Null and empty texts have no bytes and no tokens. Rows that repeat an id are counted each; null ids are
    kept. Blocks are cut twice, so the input must be read in the same order by every attempt, as files are.
    """
    specials = special_strings(tokenizer_path)
    base = docs.select(
        F.monotonically_increasing_id().alias("_t_row"), F.col(id_col).alias("_t_id"), F.coalesce(text_col, F.lit("")).alias("_t_text"))
    kind = base.schema["_t_id"].dataType
    partitions = shuffle_partitions(docs.sparkSession)
    wanted = base.mapInArrow(_pieces(specials), "piece string, block long, number int")
    counts = wanted.repartition(partitions, "piece").sortWithinPartitions("piece").mapInArrow(
        _counted(tokenizer_path), "block long, numbers binary, tokens binary")
    frequencies = base.mapInArrow(
        _frequencies(specials, to_arrow_type(kind)), f"block long, _t_id {kind.simpleString()}, n_bytes long, frequencies binary")
    return frequencies.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(
        _summed, f"_t_id {kind.simpleString()}, n_bytes long, n_tokens long").withColumnRenamed("_t_id", id_col)
