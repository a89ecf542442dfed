"""Similarity join of texts by the Jaccard index of word n-grams, with token-combination prefixes."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import maybe_in, pair_hash
from tallymark.llm.components import components
from tallymark.session import bucketed, stored

# Words a task remembers; texts, and bytes of them, that are looked at together.
MEMO, ROWS, BYTES = 250_000, 1_024, 1 << 22
# Shingles in at most so many sets are rare (indexed alone), in at most so many frequent (in pairs), else very frequent
# (in triples). Sets of fewer than 2**SMALL shingles index all of theirs alone.
RARE, FREQUENT, SMALL = 32, 1_024, 4
# Passes that try one candidate per set before all that is left is tried, and shingles of either side that meet at once.
TRIES, LOAD = 2, 250_000
# Growth of the size classes of the first pass, and parts there for each shingle that linked sets may differ in.
STEP, MORE, KIND_BITS = 1.25, 1.25, 7


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def shingles(text: str, width: int, known: WordHashes) -> np.ndarray:
    """Distinct hashes of the ``width``-word shingles, in order; fewer words are one shingle, no words none.

    Bytes split at exactly the white space of the contract, and only ``A-Z`` of them change case.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    with np.errstate(over="ignore"):
        h = np.full(len(words) - size + 1, size, np.uint64)
        for i in range(size):
            h = (h ^ codes[i:len(words) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def spare(n, num: int, den: int):
    """How many of a set's ``n`` shingles may be missing in a set that it links to: n - ceil(num * n / den)."""
    return n - -(-num * n // den)


class SizeClass(NamedTuple):
    """Sets of at least ``low`` shingles that miss at most ``spare`` of each other's, cut into ``parts``."""

    low: int
    spare: int
    parts: int


def size_classes(num: int, den: int) -> list[SizeClass]:
    """Classes of the smaller one of two linked sets; ``spare`` is the most that lies in only one of them.

    There are ``MORE`` times as many parts, and as many again as are expected to be empty.
    """
    out, low = [], 1
    while low < 1 << 40:
        high = max(low + 1, int(low * STEP))
        spare = (high - 1) * (den - num) // num
        parts = enough = int((spare + 1) * MORE) + 1
        for _ in range(8):
            parts = enough + int(parts * np.exp(-low / parts))
        out.append(SizeClass(low, spare, parts))
        low = high
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def part_hashes(grams: np.ndarray, classes: list[SizeClass], lows: list[int], num: int, den: int) -> list[tuple[int, int, np.ndarray]]:
    """(class, need, hashes of the parts that are not empty) for every class in which a set can be linked with another;
    the lowest bits of a hash are its class.

    Two linked sets meet in the class of the smaller one. What lies in only one of them touches at most ``spare`` parts,
    so all other parts are the same in both, and of those at most as many are empty as this set has empty ones: ``need``
    is what is left. A set that shares fewer parts than that with all others together is not linked in that class; one
    that needs none cannot be ruled out.
    """
    out = []
    codes = _mixed(grams.view(np.uint64))
    for at in range(bisect_right(lows, -(-num * len(grams) // den)) - 1, bisect_right(lows, len(grams))):
        kind = classes[at]
        if kind.spare == 0:  # different sets cannot link
            continue
        place = ((grams >> 32) + (1 << 31)) * kind.parts >> 32  # the shingles are in order, and so are their parts
        first = np.flatnonzero(np.diff(place, prepend=-1))
        with np.errstate(over="ignore"):
            held = np.add.reduceat(codes, first)
        hashes = _mixed(held ^ _mixed(place[first].astype(np.uint64))) << np.uint64(KIND_BITS) | np.uint64(at)
        out.append((at, len(first) - kind.spare, hashes.view(np.int64)))
    return out


def _digest(grams: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), np.int64).tolist())


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of bounded rows, and of bounded bytes where no text alone is longer."""
    sizes = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch[column]])
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BYTES, "right"))
        to = max(at + 1, min(to, at + ROWS))
        yield batch.slice(at, to - at)
        at = to


def _sets(width: int, num: int, den: int):
    """(the row's key, n, node, check, parts, needs) of every text.

    Of texts looked at together that share a part only the first keeps it, so a large group of copies does not come
    whole to one place. If they are not all equal, each of them has got that part already: it is in its ``got``, and
    ``counted`` where it is kept.
    """
    classes = size_classes(num, den)
    lows = [c.low for c in classes]

    def listed(counts: np.ndarray, fields: dict) -> pa.ListArray:
        return pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], list(fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in _slices(batch, "_j_text"):
                sets = [shingles(x.as_py() or "", width, known) for x in part["_j_text"]]
                digests = [_digest(s) for s in sets]
                node = np.array([d[0] for d in digests], np.int64)
                found = [part_hashes(s, classes, lows, num, den) if len(s) else [] for s in sets]
                groups = np.array([len(f) for f in found])
                rows = [x for f in found for x in f]  # one per text and class
                kind = np.array([k for k, _, _ in rows], np.int32)
                flat = np.concatenate([h for _, _, h in rows]) if rows else np.zeros(0, np.int64)
                row = np.repeat(np.arange(len(rows)), [len(h) for _, _, h in rows])
                owner = np.repeat(np.arange(len(sets)), groups)[row]
                first, shared = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
                if len(flat):
                    order = np.argsort(flat, kind="stable")
                    begin = np.flatnonzero(np.diff(flat[order], prepend=flat[order[0]] ^ 1))
                    nodes = node[owner[order]]
                    several = np.minimum.reduceat(nodes, begin) != np.maximum.reduceat(nodes, begin)
                    shared[order] = np.repeat(several, np.diff(np.append(begin, len(flat))))
                    first[order[begin]] = True
                yield pa.RecordBatch.from_arrays(
                    [*[part[c] for c in KEY], pa.array([len(s) for s in sets], pa.int64()), pa.array(node), pa.array([d[1] for d in digests], pa.int64()),
                     listed(np.bincount(owner[first], minlength=len(sets)), {"part": flat[first], "counted": shared[first]}),
                     listed(groups, {"kind": kind, "need": np.array([n for _, n, _ in rows], np.int32), "got": np.bincount(row, shared, len(rows)).astype(np.int32)})],
                    [*KEY, "n", "node", "check", "parts", "needs"])
    return run


def _whole(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in _slices(batch, "_j_text"):
                sets = [shingles(x.as_py() or "", width, known) for x in part["_j_text"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(s)[0] for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                    ["node", "n", "grams"])
    return run


def levels_of(n: int, num: int, den: int) -> range:
    """Size classes, by powers of two, of all sets that a set of ``n`` can link to; its own is among them."""
    return range((-(-num * n // den)).bit_length() - 1, (den * n // num).bit_length())


def signatures(
    n: int, counts: np.ndarray, grams: np.ndarray, level: int, num: int, den: int, classes: tuple[int, int] = (RARE, FREQUENT),
) -> list[int]:
    """What a set is indexed under for partners of one size class.

    ``grams`` are its shingles that other sets hold too, rarest first, and ``counts`` in how many sets. A linked set may
    miss ``spare`` of all ``n``. The prefix is extended until more than that many would have to be missing for nothing to
    be in common: a rare shingle counts one, and of the k-combination class each part beyond its first k - 1. Of two
    linked sets the one whose prefix ends first then shares a rare shingle, or k of one part, with the other's prefix.
    """
    need = spare(n, num, den) + 1 - (n - len(grams))
    if need <= 0:
        return []
    parts = max(1, (1 << level) // 32)  # few enough to be reached by every set of the class, many enough to keep parts small
    out, taken = [], defaultdict(list)
    for count, gram in zip(counts.tolist(), grams.tolist()):
        k = 1 if level < SMALL or count <= classes[0] else 2 if count <= classes[1] else 3
        if k == 1:
            out.append((level, gram))
            need -= 1
        else:
            held = taken[k, gram % parts]
            out += [(level, *sorted((gram, *rest))) for rest in combinations(held, k - 1)]
            need -= len(held) >= k - 1
            held.append(gram)
        if need <= 0:
            break
    return [xxhash.xxh3_64_intdigest(np.array(s, np.int64).tobytes()) - (1 << 63) for s in out]


def _signed(num: int, den: int, classes: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                nodes, sizes, sigs = [], [], []
                part = batch.slice(at, ROWS)
                for node, n, counts, grams in zip(part["node"].to_pylist(), part["n"].to_pylist(), part["counts"], part["grams"]):
                    counts, grams = counts.values.to_numpy(), grams.values.to_numpy()
                    order = np.lexsort((grams, counts))
                    found = [s for level in levels_of(n, num, den) for s in signatures(n, counts[order], grams[order], level, num, den, classes)]
                    nodes += [node] * len(found)
                    sizes += [n] * len(found)
                    sigs += found
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (sigs, nodes, sizes)], ["sig", "node", "n"])
    return run


def _met(num: int, den: int):
    """(a, b): for every asking node one link to each other label that it meets, found on whole sets."""
    def run(group: pa.Table) -> pa.Table:
        asks = group["asks"].to_numpy(zero_copy_only=False)
        held, asking = group.filter(pa.array(~asks)), group.filter(pa.array(asks))
        out_a, out_b = [], []
        if held.num_rows and asking.num_rows:
            node, label = held["node"].to_numpy(), held["label"].to_numpy()
            grams = held["grams"].combine_chunks()
            size = np.asarray(grams.value_lengths())
            flat, owner = grams.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for a, own, mine in zip(asking["node"].to_pylist(), asking["label"].to_pylist(), asking["grams"]):
                mine = mine.values.to_numpy()
                low, high = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
                hits = np.repeat(low, high - low) + np.arange((high - low).sum()) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
                common = np.bincount(owner[hits], minlength=len(size))
                linked_to = np.flatnonzero((den * common >= num * (size + len(mine) - common)) & (label != own))
                _, first = np.unique(label[linked_to], return_index=True)
                out_a += [a] * len(first)
                out_b += node[linked_to[first]].tolist()
        return pa.table([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
    return run


def meet(held: DataFrame, asking: DataFrame, labels: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of ``asking`` (cell, node, n) nodes to those ``held`` (cell, node, n) in the same cell under another label.

    Both sides of a cell are cut by hash into parts of bounded shingles, and every part meets every part of the other
    side. A set travels once to its parts, not once per pair. ``sets`` lie in buckets by node and are joined where they lie.
    """
    loads = [side.groupBy("cell").agg(F.ceil(F.sum("n") / LOAD).cast("long").alias(f"of_{name}")) for side, name in ((held, "held"), (asking, "asking"))]
    both = loads[0].join(loads[1], "cell")
    mine = lambda of: F.pmod(F.xxhash64("node"), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    roles = held.join(both, "cell").select("cell", "node", F.lit(False).alias("asks"), mine("of_held").alias("part"), every("of_asking").alias("turn")).unionByName(
        asking.join(both, "cell").select("cell", "node", F.lit(True).alias("asks"), every("of_held").alias("part"), mine("of_asking").alias("turn")))
    sent = sets.select("node", "grams").join(roles.join(labels, "node"), "node")
    return stored(sent.groupBy("cell", "part", "turn").applyInArrow(_met(num, den), "a long, b long"), "links")


def merged_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) with the labels that ``links`` (a, b) join made one."""
    named = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(
        labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    joined = components(named.where(F.col("a") != F.col("b"))).select(F.col("node").alias("label"), F.col("label").alias("new"))
    return stored(labels.join(joined, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")


def linked(index: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, label) of all nodes with links, from (sig, node, n): the components of the similarity graph.

    Only components are asked for, so pairs inside one that is known already need no look, and signatures that only one
    component holds are dropped. First every node tries one node at a time that shares the most signatures with it, out
    of those that stand for the largest component of a signature. The node tried first names a node's cell. Then every
    node outside the largest component of one of its signatures meets, on whole sets, all nodes of other components in
    the cells that share a signature with it. So all candidates left are verified, without a row per pair.
    """
    labels = stored(index.select("node").distinct().select("node", F.col("node").alias("label")), "labels")
    cells = None
    for attempt in range(TRIES + 1):
        now = index.join(labels, "node")
        sizes = now.groupBy("sig", "label").agg(
            F.count(F.lit(1)).alias("c"), F.min_by(F.struct("node", "n"), F.xxhash64(F.lit(attempt), "node")).alias("stand"))
        largest = sizes.groupBy("sig").agg(F.max(F.struct("c", "label", "stand")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
        mixed = stored(now.join(largest.select("sig", F.col("top.label").alias("major"), "top.stand"), "sig"), "mixed")
        index = mixed.select("sig", "node", "n")
        minor = mixed.where(F.col("label") != F.col("major"))
        if attempt < TRIES:
            tried = minor.where(den * F.least("n", "stand.n") >= num * F.greatest("n", "stand.n")).groupBy(
                F.col("node").alias("a"), "n", F.col("stand").alias("b")).agg(F.count(F.lit(1)).alias("c"))
            pairs = stored(tried.groupBy("a", "n").agg(F.max_by("b", F.struct("c", "b")).alias("b")), "tries")
            if cells is None:
                cells = stored(sets.select("node", "n").join(labels, "node").join(pairs.select(F.col("a").alias("node"), "b"), "node", "left").select(
                    "node", "n", F.coalesce("b.node", "node").alias("cell")), "cells")
            stands = pairs.select(F.col("b.node").alias("cell"), F.col("b.node").alias("node"), F.col("b.n").alias("n")).distinct()
            links = meet(stands, pairs.select(F.col("b.node").alias("cell"), F.col("a").alias("node"), "n"), labels, sets, num, den)
        else:
            # A node asks a cell only where a signature of theirs holds another label there.
            near = mixed.select("sig", "node", "label").join(cells.select("node", "cell"), "node").groupBy("sig", "cell").agg(
                F.min("label").alias("least"), F.max("label").alias("most"))
            asking = stored(minor.select("sig", "node", "n", "label").join(near, "sig").where(
                (F.col("least") != F.col("label")) | (F.col("most") != F.col("label"))).select("cell", "node", "n").distinct(), "asking")
            links = meet(cells.join(asking.select("cell").distinct(), "cell"), asking, labels, sets, num, den)
        if not links.isEmpty():
            labels = merged_labels(labels, links)
    return labels


# What names a row of the input: its id, and 128 bits of its text.
KEY = ("_j_id", "_j_high", "_j_low")


def labelled(
    docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
    classes: tuple[int, int] = (RARE, FREQUENT),
) -> DataFrame:
    """(_j_id, _j_high, _j_low, n, node, check, label) per row: ``label`` is the same exactly if links join two rows.

    Two documents link if ``den`` times their common shingles are at least ``num`` times all of theirs (at least half).
    Equal sets are one node. A first pass cuts every set by hash into more parts than a linked set can differ in, and
    keeps the sets that share enough parts with others. These are ordered rarest shingle first and indexed by
    token-combination prefixes (see :func:`signatures`), and candidates are verified on whole sets. Shingles and parts
    are known by 64-bit hashes, sets by digests of which nodes carry 64 bits, texts by 128-bit hashes.

    Null, empty and blank texts have no shingles and a null label. Rows that repeat an id, or have none, are looked at
    each. Other columns are not used. An empty table gives no rows.
    """
    if not 2 * num >= den >= num > 0:
        raise ValueError("the similarity must lie between 0.5 and 1")
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("_j_id"), *[h.alias(k) for h, k in zip(pair_hash(text), KEY[1:])], text.alias("_j_text"))
    kind = base.schema["_j_id"].dataType.simpleString()
    members = stored(base.mapInArrow(_sets(width, num, den), f"""_j_id {kind}, _j_high long, _j_low long, n long, node long, check long,
        parts array<struct<part: long, counted: boolean>>, needs array<struct<kind: int, need: int, got: int>>"""), "members")
    shares = Window.partitionBy("part").orderBy("node")
    other = (F.lag("node").over(shares) != F.col("node")) | (F.lead("node").over(shares) != F.col("node"))
    parted = members.select("node", F.explode("parts").alias("p")).select("node", "p.*").withColumn("other", other).where("other and not counted").withColumn(
        "kind", F.col("part").bitwiseAND((1 << KIND_BITS) - 1).cast("int"))
    needs = members.select("node", F.explode("needs").alias("p")).select("node", "p.*")
    candidates = needs.unionByName(parted.select("node", "kind", F.lit(None).cast("int").alias("need"), F.lit(1).alias("got"))).groupBy("node", "kind").agg(
        F.min("need").alias("need"), F.sum("got").alias("got")).where("got >= need").select("node").distinct()
    # One text per candidate: the first row's, known by its id and its text.
    first = F.min(F.struct(F.col("_j_id").isNull(), *KEY)).alias("s")
    kept = stored(members.where("n > 0").select("node", *KEY).join(candidates, "node", "left_semi").groupBy("node").agg(first).select(
        "node", *[f"s.{k}" for k in KEY]), "kept")
    a, b = maybe_in(base, kept, KEY).alias("a"), kept.alias("b")
    same = F.col("a._j_id").eqNullSafe(F.col("b._j_id")) & (F.col("a._j_high") == F.col("b._j_high")) & (F.col("a._j_low") == F.col("b._j_low"))
    # Texts are dealt by node, not their larger sets, so every task fills the buckets of its own nodes only.
    texts = a.join(b, same).select("b.node", "a._j_text").dropDuplicates(["node"])
    with bucketed(texts.mapInArrow(_whole(width), "node long, n long, grams array<long>"), "sets", "node") as sets:
        rows = sets.select("node", "n", F.explode("grams").alias("gram"))
        counts = stored(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").withColumn("c", F.least("c", F.lit(2**31 - 1)).cast("int")), "counts")
        ordered = maybe_in(rows, counts, ("gram",)).join(counts, "gram").groupBy("node", "n").agg(F.collect_list("c").alias("counts"), F.collect_list("gram").alias("grams"))
        index = ordered.mapInArrow(_signed(num, den, classes), "sig long, node long, n long")
        several = index.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("sig")
        index = stored(index.join(several, "sig"), "index")
        labels = linked(index, sets, num, den)
    return members.drop("parts", "needs").join(labels, "node", "left").withColumn("label", F.when(F.col("n") > 0, F.coalesce("label", "node")))


def similar_groups(
    docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
    classes: tuple[int, int] = (RARE, FREQUENT),
) -> DataFrame:
    """(id, n_shingles, component_id) per row of ``docs``: the smallest id reachable by links (see :func:`labelled`).

    Texts without shingles are linked with nothing and keep their own id. A row without an id links as all others do,
    but names no component: where no linked row has an id, the component is null. Empty tables give no rows.
    """
    rows = labelled(docs, width, num, den, id_col, text_col, classes)
    smallest = rows.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("_j_id").alias("component_id"))
    return rows.join(smallest, "label", "left").select(
        F.col("_j_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("_j_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every group of similar texts: that of the smallest id, null ids last, then by text hash.

    Of rows with equal ids and texts one stays. Texts without shingles are similar to nothing and all stay.
    """
    rows = labelled(docs, width, num, den, id_col, text_col).where(F.col("label").isNotNull()).select(
        "label", F.struct(F.col("_j_id").isNull().alias("none"), *KEY).alias("row"))
    keys = rows.groupBy("label", "row").agg(F.count(F.lit(1)).alias("c"))
    stays = rows.groupBy("label").agg(F.min("row").alias("stay"))
    told = stored(keys.join(stays, "label").select(*[f"row.{k}" for k in KEY], (F.col("row") != F.col("stay")).alias("goes"), (F.col("c") > 1).alias("again")).where("goes or again"), "told")
    text = F.col(text_col)
    a, b = docs.withColumns({"_j_id": F.col(id_col), "_j_high": pair_hash(text)[0], "_j_low": pair_hash(text)[1]}).alias("a"), told.alias("b")
    on = F.col("a._j_id").eqNullSafe(F.col("b._j_id")) & (F.col("a._j_high") == F.col("b._j_high")) & (F.col("a._j_low") == F.col("b._j_low"))
    left = a.join(b, on, "left").where(~F.coalesce("b.goes", F.lit(False))).select("a.*", F.coalesce("b.again", F.lit(False)).alias("_j_again"))
    left = left if told.where("again and not goes").isEmpty() else left.where(~F.col("_j_again")).unionByName(left.where("_j_again").dropDuplicates(list(KEY)))
    return left.select(*docs.columns)
