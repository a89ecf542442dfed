"""Ranked lexical search: documents of a block are grouped by which terms of an item they hold, best groups first."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bytes of a text that are cut into terms at once, and code points of item text that are searched for in one pass.
PIECE, ITEM_CHARS = 1 << 20, 1 << 22
# Documents and postings of a block, documents whose scores are worked out at once, and bits of a mask's word.
DOCS, POSTINGS, AT_ONCE, BITS = 4_096, 1 << 20, 256, 62
# Parts in which the best of all tasks meet before they meet as one.
SALTS = 64
# Bytes that end a term become spaces, A-Z become a-z; all others, those above 0x7F too, are parts of terms.
_TERM = [chr(b).isalnum() or b > 0x7F for b in range(256)]
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if _TERM[b] else 0x20 for b in range(256))


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded part of it at a time; parts end where a term does."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and _TERM[data[end]]:
            end += 1
        yield data[at:end].translate(_BYTES).split()
        at = end


def terms_of(text: str) -> Counter:
    """How often a text holds each term."""
    found: Counter = Counter()
    for part in pieces(text.encode("utf-8", "surrogatepass")):
        found.update(part)
    return found


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def damping(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents of so many terms."""
    if 25 * int(sizes.max(initial=0)) * n_docs < 1 << 63:
        return 75 + 25 * sizes * n_docs // n_terms
    return np.array([75 + 25 * int(n) * n_docs // n_terms for n in sizes], np.int64)


def _counted(data: bytes, wanted: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """(terms with repeats, numbers of the wanted ones, their occurrences) of one text."""
    n, numbers, counts = 0, [], []
    for part in pieces(data):
        n += len(part)
        at = np.fromiter(map(wanted.get, part, repeat(-1)), np.int64, len(part))
        number, count = np.unique(at[at >= 0], return_counts=True)
        numbers.append(number)
        counts.append(count)
    if len(numbers) == 1:
        return n, numbers[0], counts[0]
    if not numbers:
        return 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    number, back = np.unique(np.concatenate(numbers), return_inverse=True)
    return n, number, np.bincount(back, np.concatenate(counts), len(number)).astype(np.int64)


def _statistics(wanted: dict[bytes, int], text: str):
    """(term number, documents that hold it) of a task; -1 counts documents with terms, -2 all their terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_terms = np.zeros(len(wanted), np.int64), 0, 0
        for batch in batches:
            for value in batch[text]:
                if value.is_valid:
                    n, number, _ = _counted(value.as_buffer().to_pybytes(), wanted)
                    df[number] += 1
                    n_docs, n_terms = n_docs + (n > 0), n_terms + n
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *held.tolist()], pa.int64()), pa.array([n_docs, n_terms, *df[held].tolist()], pa.int64())], ["number", "df"])
    return run


class Block:
    """Postings of a few thousand documents, by term: places of documents, and what the term adds to their scores."""

    def __init__(self, ids: list, sizes: list[int], number: list[np.ndarray], tf: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids, self.n = ids, len(ids)
        flat, count = np.concatenate(number), np.concatenate(tf)
        place = np.repeat(np.arange(len(number)), [len(x) for x in number])
        order = np.argsort(flat, kind="stable")
        flat, count, self.place = flat[order], count[order], place[order]
        m = damping(np.asarray(sizes, np.int64), n_docs, n_terms)[self.place]
        self.adds = weights[flat] * ((10**9 * count) // (1000 * count + 12 * m))
        first = np.flatnonzero(np.diff(flat, prepend=-1))
        self.ends = np.append(first, len(flat))
        self.tops = np.maximum.reduceat(self.adds, first)
        self.slot = np.full(len(weights), -1)
        self.slot[flat[first]] = np.arange(len(first))

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best) -> None:
        """Take the documents of this block that belong into ``best``.

        Every term is a bit of the masks of the documents that hold it. Documents of one mask have the same highest
        possible score: what the terms of the mask add at most in this block. Masks are looked at from the highest on,
        until the next one cannot reach what ``best`` asks for; at equality the smaller id may still win, so those are.
        """
        slots = self.slot[terms]
        times, slots = times[slots >= 0], slots[slots >= 0]
        tops = times * self.tops[slots]
        if tops.sum() < best.least():
            return
        mask, most, bit = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64), 0
        for slot, top in zip(slots.tolist(), tops.tolist()):
            held = self.place[self.ends[slot]:self.ends[slot + 1]]
            mask[held] |= 1 << bit
            most[held] += top
            bit += 1
            if bit == BITS:  # name the masks so far by small numbers, and go on above them
                names, mask = np.unique(mask, return_inverse=True)
                bit = len(names).bit_length()
        docs = np.flatnonzero(most >= best.least())
        if not len(docs):
            return
        _, first, group = np.unique(mask[docs], return_index=True, return_inverse=True)
        bound = most[docs][first]
        turn = np.argsort(-bound, kind="stable")
        rank = np.empty_like(turn)
        rank[turn] = np.arange(len(turn))
        docs = docs[np.argsort(rank[group], kind="stable")]
        ends = np.cumsum(np.bincount(rank[group]))  # of each mask's documents, in the order of the masks
        at, done = 0, 0
        while at < len(turn) and bound[turn[at]] >= best.least():
            to = max(at + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
            while to > at + 1 and bound[turn[to - 1]] < best.least():
                to -= 1
            some = np.sort(docs[done:ends[to - 1]])
            scores = np.zeros(len(some), np.int64)
            for slot, q in zip(slots.tolist(), times.tolist()):
                low, high = self.ends[slot], self.ends[slot + 1]
                held = self.place[low:high]
                found = np.minimum(np.searchsorted(held, some), len(held) - 1)
                scores += np.where(held[found] == some, q * self.adds[low + found], 0)
            best.take(scores, some, self.ids)
            at, done = to, int(ends[to - 1])


class Best:
    """The best so far of one item: highest scores, equal ones by ascending id, those without an id last."""

    __slots__ = ("k", "rows")

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> int:
        """The score below which a document cannot belong here."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def take(self, scores: np.ndarray, docs: np.ndarray, ids: list) -> None:
        good = np.flatnonzero(scores >= self.least())
        if len(good):
            found = [(s, ids[d]) for s, d in zip(scores[good].tolist(), docs[good].tolist())]
            self.rows = heapq.nsmallest(self.k, self.rows + found, key=lambda r: (-r[0], r[1] is None, r[1]))


def _search(wanted: dict[bytes, int], items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, names: tuple[str, str]):
    """(item, id, score): the best of a task's documents, block by block; later blocks have to beat the earlier ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        ids, sizes, number, tf, postings, kind = [], [], [], [], 0, None

        def searched():
            nonlocal ids, sizes, number, tf, postings
            if ids:
                block = Block(ids, sizes, number, tf, weights, n_docs, n_terms)
                for (terms, times), top in zip(items, best):
                    block.search(terms, times, top)
            ids, sizes, number, tf, postings = [], [], [], [], 0

        for batch in batches:
            kind = batch.schema.field(names[0]).type
            for name, value in zip(batch[names[0]], batch[names[1]]):
                if not value.is_valid:
                    continue
                n, held, counts = _counted(value.as_buffer().to_pybytes(), wanted)
                if len(held):
                    ids.append(name.as_py())
                    sizes.append(n)
                    number.append(held)
                    tf.append(counts)
                    postings += len(held)
                    if len(ids) == DOCS or postings >= POSTINGS:
                        searched()
        searched()
        rows = [(i, d, s) for i, top in enumerate(best) for s, d in top.rows]
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64())], ["item", "found", "score"])
    return run


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item, rank, document, score): the ``k`` documents with the highest scores above 0 for every item; exact.

    A term is a run of ASCII letters and digits and of all that is not ASCII, ``A-Z`` lower-cased. Weights and lengths
    come from all documents (a first pass that only counts); a second pass searches blocks of documents (see
    :meth:`Block.search`). Nothing is shuffled but the best of each task, so no document, term or item is hot.

    Items are read to the driver in groups of about four million code points, and both passes run once per group: the
    items are a query set against all rows, in blocks. Equal items (id and text) are one; texts that share an id are
    searched for each on its own, with ranks of their own. Null, empty and term-free texts match nothing, as item or as
    document, and such a document is not counted. A repeated document counts and is found as often as it is there. One
    without an id counts too and comes after all others of its score. Other columns are not used. Empty tables give no rows.
    Scores, and the products under a weight, must fit 64 bits; numpy is guarded where lengths could pass them.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("_item"), F.col(item_text).alias("_text")).where(F.col("_text").isNotNull()).distinct()
    chars = asked.agg(F.sum(F.char_length("_text"))).first()[0] or 0
    groups = -(-chars // ITEM_CHARS) or 1
    kinds = dict(docs.dtypes)
    texts = docs.select(F.col(id_col).alias("_r_id"), F.col(text_col).alias("_r_text"))
    item_kind = asked.schema["_item"].dataType
    out = spark.createDataFrame([], f"`{item_col}` {item_kind.simpleString()}, rank int, `{id_col}` {kinds[id_col]}, score long")
    for g in range(groups):
        some = asked.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(groups)) == g).collect()
        some = [(r["_item"], c) for r in some if (c := terms_of(r["_text"]))]
        if not some:
            continue
        wanted = {t: i for i, t in enumerate(sorted({t for _, c in some for t in c}))}
        counted = texts.select("_r_text").mapInArrow(_statistics(wanted, "_r_text"), "number long, df long").groupBy("number").agg(F.sum("df").alias("df"))
        totals = {r["number"]: r["df"] for r in counted.collect()}  # one row per term of this group, and two
        n_docs, n_terms = totals[-1], totals[-2]
        if not n_terms:
            continue
        weights = np.array([weight(n_docs, totals.get(i, 0)) for i in range(len(wanted))], np.int64)
        queries = [(np.array([wanted[t] for t in c]), np.array(list(c.values()), np.int64)) for _, c in some]
        found = texts.mapInArrow(
            _search(wanted, queries, weights, n_docs, n_terms, k, ("_r_id", "_r_text")), f"item long, found {kinds[id_col]}, score long")
        order = [F.col("score").desc(), F.col("found").asc_nulls_last()]
        salted = found.withColumn("salt", F.spark_partition_id() % SALTS)
        part = salted.withColumn("r", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("r") <= k)
        top = part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        # At most the items of this group, which the driver has read.
        names = F.broadcast(spark.createDataFrame([(i, name) for i, (name, _) in enumerate(some)], f"item long, name {item_kind.simpleString()}"))
        out = out.unionAll(top.join(names, "item").select("name", "rank", "found", "score"))
    return out
