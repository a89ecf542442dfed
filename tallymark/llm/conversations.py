"""Faults of conversations, and the cheapest edits that make their roles alternate legally.

The search is a Viterbi search over the rows of a conversation in turn order. Its survivors (one per state) hang in a
tree of back pointers whose nodes count their references: a node that no survivor comes from goes, a node with a single
child left is joined with it, and what all survivors share is decided and leaves the tree at once. Rows themselves are
never held, only one short edit per undecided row. So a conversation of any length is read as a stream.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import SPACE, pair_hash
from tallymark.session import stored

# Costs of the edits, in the letters of the audit; an undeleted truncated row costs one more.
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST, CUT_COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}, 1
# What was last written: nothing, system, user, assistant; legal ends; and what an inserted or reroled row becomes.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
TURN = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
SENTENCE_ENDS = (".", "!", "?")
# Two insertions in a row bring back the state (or end a lone system row), so three are never cheapest.
INSERTS = 2
# Records handed over at once, and code points of text in them.
ROWS, CHARS = 4_096, 1 << 22
# Kinds of the records of `steps`: a row, the edits before and at a row, the figures of a conversation.
ROW, EDITS, FIGURES = range(3)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def after_kept(state: int, initial: str) -> int | None:
    """The state after a kept row, or None where its role is not legal there."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    return TURN[state] if initial == {USER: "u", ASSISTANT: "a"}[TURN[state]] else None


def transitions(initial: str, must_go: bool, cut: bool) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits) over one row, insertions before it included; of equal ends the cheapest, then ASCII-least.

    Edits of one row start at one path and end in the row's own letter, so none is the beginning of another.
    """
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in (NOTHING, SYSTEM, USER, ASSISTANT):
        state = start
        for k in range(INSERTS + 1):
            ways = [(DELETE, state, 0)]
            if not must_go:
                ways += [(REROLE, TURN[state], CUT_COST * cut), (KEEP, after_kept(state, initial), CUT_COST * cut)]
            for letter, end, more in ways:
                if end is not None:
                    found = (k * COST[INSERT] + COST[letter] + more, INSERT * k + letter)
                    best[start, end] = min(best.get((start, end), found), found)
            state = TURN[state]
    return [(a, b, cost, edits) for (a, b), (cost, edits) in best.items()]


def _extra() -> dict[tuple[int, int], int]:
    """(y, x): by how much the rest of a conversation can cost more from state y than from x, whatever the rest is."""
    states = (NOTHING, SYSTEM, USER, ASSISTANT)
    extra = {(y, x): 0 if y == x else 1 << 30 for y in states for x in states}
    # What an assistant or a system row allows next, the start allows too; after an assistant a kept system row must go.
    extra |= {(NOTHING, ASSISTANT): 0, (NOTHING, SYSTEM): 0, (ASSISTANT, SYSTEM): 0, (ASSISTANT, NOTHING): COST[DELETE]}
    for state in states:
        extra[state, TURN[state]] = min(extra[state, TURN[state]], COST[INSERT])
    for z in states:
        for y in states:
            for x in states:
                extra[y, x] = min(extra[y, x], extra[y, z] + extra[z, x])
    return extra


EXTRA = _extra()


class Node:
    """Edits of consecutive rows that every path through this node has in common; ``refs`` counts children, and 1 if it is a survivor."""

    __slots__ = ("parent", "refs", "children", "edits")

    def __init__(self, parent: Node | None, edits):
        self.parent, self.refs, self.children, self.edits = parent, 1, set(), deque(edits)
        if parent is not None:
            parent.refs += 1
            parent.children.add(self)


class Survivors:
    """The cheapest path to every state, ties broken by the whole ASCII-least audit.

    Paths of equal cost into one state are compared by all that is undecided. They have the same rows behind them and
    each ends in a row's letter, so neither begins the other, and their order is the order of the paths they extend,
    then of their last edits. ``order`` carries it from row to row, so a comparison never walks back through the tree.
    """

    _tables: dict[tuple[str, bool, bool], list[tuple[int, int, int, str]]] = {}

    def __init__(self):
        self.root = Node(None, ())
        self.tips, self.costs, self.order = {NOTHING: self.root}, {NOTHING: 0}, {NOTHING: 0}

    def step(self, initial: str, must_go: bool, cut: bool) -> list[str]:
        """Take one row; the edits, row by row, that are decided by now and were not before."""
        key = (initial if initial in ("s", "u", "a") else "", must_go, cut)
        table = self._tables.get(key)
        if table is None:
            table = self._tables[key] = transitions(*key)
        best: dict[int, tuple[int, int, str, int]] = {}
        for start, end, cost, edits in table:
            if start in self.tips:
                found = (self.costs[start] + cost, self.order[start], edits, start)
                if end not in best or found < best[end]:
                    best[end] = found
        # A path that another one beats whatever follows does not survive; at equal cost both do, for the order decides.
        best = {x: found for x, found in best.items() if all(found[0] <= other[0] + EXTRA[y, x] for y, other in best.items())}
        old = self.tips
        self.tips = {end: Node(old[start], (edits,)) for end, (_, _, edits, start) in best.items()}
        self.costs = {end: found[0] for end, found in best.items()}
        self.order = {end: i for i, end in enumerate(sorted(best, key=lambda e: best[e][1:3]))}
        for node in old.values():
            self._release(node)
        return self._decided()

    def finish(self) -> tuple[int, list[str], str]:
        """(cost, the edits still undecided, insertions at the end) of the cheapest legal path."""
        ways = []
        for start, cost in self.costs.items():
            state = start
            for k in range(INSERTS + 1):
                if state in ENDS:
                    ways.append((cost + k * COST[INSERT], self.order[start], INSERT * k, start))
                state = TURN[state]
        cost, _, inserts, start = min(ways)
        parts, node = [], self.tips[start]
        while node is not None:
            parts.append(node.edits)
            node = node.parent
        return cost, [e for part in reversed(parts) for e in part], inserts

    def undecided(self) -> int:
        seen: set[int] = set()
        total = 0
        for node in self.tips.values():
            while node is not None and id(node) not in seen:
                seen.add(id(node))
                total += len(node.edits)
                node = node.parent
        return total

    def _release(self, node: Node) -> None:
        """One reference less; without any the node goes, with one child left it is joined with that child."""
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            parent = node.parent
            parent.children.discard(node)
            parent.refs -= 1
            node = parent
        if node.refs == 1 and len(node.children) == 1:
            (child,) = node.children
            if len(child.edits) <= len(node.edits):  # the shorter part moves, so no edit moves often
                node.edits.extend(child.edits)
                child.edits = node.edits
            else:
                child.edits.extendleft(reversed(node.edits))
            child.parent = node.parent
            if node.parent is None:
                self.root = child
            else:
                node.parent.children.discard(node)
                node.parent.children.add(child)

    def _decided(self) -> list[str]:
        out = list(self.root.edits)
        self.root.edits.clear()
        return out


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)


class _Out:
    """Records of the columns ``names``, handed over in bounded batches."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.chars = schema, [], 0

    def add(self, *values, chars: int = 0) -> None:
        self.rows.append(values)
        self.chars += chars

    def full(self) -> bool:
        return len(self.rows) >= ROWS or self.chars >= CHARS

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows, self.chars = [], 0
        return batch


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (conversation, turn, role, text): each row as it comes, its edits once decided, then the figures."""
    out, name, search = None, None, None

    def ended():
        cost, edits, inserts = search.finish()
        for e in (*edits, *([inserts] if inserts else [])):
            out.add(name, at[0], EDITS, None, None, None, e, *[None] * len(COUNTS))
            at[0] += 1
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
        out.add(name, n, FIGURES, None, None, None, None, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost)

    for batch in batches:
        if out is None:
            out = _Out(pa.schema([
                ("conv", batch.schema.field("conv").type), ("pos", pa.int64()), ("kind", pa.int32()), ("role", pa.string()), ("text", pa.string()),
                ("fault", pa.string()), ("edits", pa.string()), *[(c, pa.int64()) for c in COUNTS]]))
        for conv, turn, role, text, seen, live in zip(*[batch[c].to_pylist() for c in ("conv", "turn", "role", "text", "seen", "live")]):
            if search is None or not _same(conv, name):
                if search is not None:
                    ended()
                name, search, n, at, before = conv, Survivors(), 0, [0], None
                counts, illegal, turns = dict.fromkeys(COUNTS, 0), 0, [None, None, 0]
            if not live:
                continue
            if turn is not None and turn != turns[1]:
                turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
            end = text.rstrip(SPACE)[-1:]
            row = (turn, role, text)
            fault = "blank" if not end else "duplicate" if seen or row == before else None if end in SENTENCE_ENDS else "truncated"
            if fault:
                counts[fault] += 1
            illegal += before is not None and before[1][:1] + role[:1] not in LEGAL
            before = row
            out.add(conv, n, ROW, role, text, fault, None, *[None] * len(COUNTS), chars=len(text))
            for e in search.step(role[:1], fault in ("blank", "duplicate"), fault == "truncated"):
                out.add(conv, at[0], EDITS, None, None, None, e, *[None] * len(COUNTS))
                at[0] += 1
            n += 1
            if out.full():
                yield out.take()
    if search is not None:
        ended()
    if out is not None:
        yield out.take()


def repair_steps(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", live_col: str | None = None,
) -> DataFrame:
    """What is found in the conversations of ``rows``, stored: (conv, pos, kind, role, text, fault, edits, figures).

    ``kind`` 0 is a row at its position, 1 the edits before and at that position (one after the last row holds the
    insertions at the end), 2 the figures of a conversation. :func:`repaired` and :func:`figures` read it.

    A conversation's rows are taken by turn, nulls first; rows of one turn by role, then text. Null roles and texts count
    as one space. Equal rows are duplicates of the first of them. Rows without a conversation id are one conversation.
    Rows where ``live_col`` is false only name a conversation that may hold no row. Other columns are not used, whatever
    their names. An empty table gives no records; a conversation without rows needs no edits. Turns are whole numbers.

    Rows seen before are found by one aggregation over (conversation, role, 128-bit hash of the text) and sent back; then
    one shuffle by conversation. A conversation is one ordered stream in one task, whose memory does not grow with it but
    for one reference per undecided row.
    """
    base = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), (F.col(live_col) if live_col else F.lit(True)).alias("live"))
    high, low = pair_hash(F.col("text"))
    keyed = base.withColumns({"h": high, "l": low})
    key = ("conv", "role", "h", "l")
    # The first turn of every text that is there at several turns; null turns come first.
    first = keyed.where("live").groupBy(*key).agg(
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.max(F.col("turn").isNull()).alias("open")).where(
        (F.col("low") < F.col("high")) | (F.col("open") & F.col("low").isNotNull()))
    a, b = keyed.alias("a"), first.alias("b")
    on = F.col("a.conv").eqNullSafe(F.col("b.conv"))
    for c in key[1:]:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    seen = F.coalesce(F.col("a.turn").isNotNull() & (F.col("b.open") | (F.col("a.turn") > F.col("b.low"))), F.lit(False))
    marked = a.join(b, on, "left").select(*[f"a.{c}" for c in ("conv", "turn", "role", "text")], seen.alias("seen"), "a.live")
    ordered = marked.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    kind = base.schema["conv"].dataType.simpleString()
    return stored(ordered.mapInArrow(
        _steps, f"conv {kind}, pos long, kind int, role string, text string, fault string, edits string, " + ", ".join(f"{c} long" for c in COUNTS)), "steps")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Records in order of (conversation, position, kind): (conv, pos, letter, role, text) per edit, and (conv, figures) at its end."""
    name, state, row, fresh = None, NOTHING, None, True
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("conv", "pos", "kind", "role", "text", "edits")]
        figures = list(zip(*[batch[c].to_pylist() for c in COUNTS]))
        for i, (conv, pos, kind, role, text, edits) in enumerate(zip(*columns)):
            if fresh or not _same(conv, name):
                name, state, row, fresh = conv, NOTHING, None, False
            if kind == ROW:
                row = (role, text)
            elif kind == EDITS:
                for letter in edits:
                    if letter == DELETE:
                        yield conv, pos, letter, None, None
                        continue
                    was, state = state, TURN[state] if letter != KEEP else after_kept(state, row[0][:1])
                    yield conv, pos, letter, row[0] if letter == KEEP else ROLES[TURN[was]], "" if letter == INSERT else row[1]
            else:
                yield conv, figures[i]
                fresh = True


def _in_order(steps: DataFrame) -> DataFrame:
    return steps.repartition("conv").sortWithinPartitions("conv", "pos", "kind")


def repaired(steps: DataFrame) -> DataFrame:
    """(conv, pos, edit, role, text): the rows of the repaired conversations; ``pos`` is the input row an edit belongs to.

    Rows of a conversation are in one partition and in order. Deleted rows are left out, inserted ones have empty texts.
    """
    kind = steps.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None

        def typed():
            nonlocal out
            for batch in batches:
                if out is None:
                    out = _Out(pa.schema([("conv", batch.schema.field("conv").type), ("pos", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
                yield batch

        for event in _replayed(typed()):
            if len(event) == 5 and event[2] != DELETE:
                out.add(*event, chars=len(event[4]))
                if out.full():
                    yield out.take()
        if out is not None:
            yield out.take()

    return _in_order(steps).mapInArrow(run, f"conv {kind}, pos long, edit string, role string, text string")


def figures(steps: DataFrame) -> DataFrame:
    """(conv, counts, cost, audit, repaired_sha256) per conversation; the digest is of ``role:text`` joined by newlines, read as a stream."""
    kind = steps.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None

        def typed():
            nonlocal out
            for batch in batches:
                if out is None:
                    out = _Out(pa.schema([("conv", batch.schema.field("conv").type), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())]))
                yield batch

        audit, digest, rows = [], hashlib.sha256(), 0
        for event in _replayed(typed()):
            if len(event) == 2:
                letters = "".join(audit)
                out.add(event[0], *event[1], letters, digest.hexdigest(), chars=len(letters))
                audit, digest, rows = [], hashlib.sha256(), 0
                if out.full():
                    yield out.take()
                continue
            _, _, letter, role, text = event
            audit.append(letter)
            if letter != DELETE:
                digest.update((("\n" if rows else "") + role + ":" + text).encode())
                rows += 1
        if out is not None:
            yield out.take()

    return _in_order(steps).mapInArrow(run, f"conv {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """The test damage of a contract, by crc32(``conv_id:turn``) % 20 (nulls: one space): 0 drops a row (``live`` is false),
    1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's. All rows of a conversation stay named.
    """
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.coalesce("text", space)
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 0, "").when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind != 0).alias("live"), F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    ).drop("_copy")
