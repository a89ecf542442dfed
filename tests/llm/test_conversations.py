import hashlib
import random
import zlib
from itertools import product

from pyspark.sql import functions as F

from tallymark.llm.conversations import Survivors, damaged, figures, repair_steps, repaired
from tallymark.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import SF, duck, needs_data

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def legal(roles):
    rest = roles[1:] if roles[:1] == "s" else roles
    return roles == "" or (len(rest) > 0 and rest == "ua" * (len(rest) // 2))


def cheapest(rows):
    """(cost, audit, repaired rows) of (role, text, must go, cut), by trying all edits; up to two insertions before each row and at the end."""
    best = None
    for letters in product("KRD", repeat=len(rows)):
        if any(r[2] and x != "D" for r, x in zip(rows, letters)):
            continue
        for inserts in product(range(3), repeat=len(rows) + 1):
            out, cost, audit = [], 0, ""
            turn = lambda: ("user", "assistant")[bool(out) and out[-1][0][:1] == "u"]  # noqa: B023, E731
            for (role, text, _, cut), letter, n in zip([*rows, (None,) * 4], [*letters, ""], inserts):
                for _ in range(n):
                    out.append((turn(), ""))
                    cost, audit = cost + 2, audit + "I"
                audit += letter
                if letter == "D":
                    cost += 3
                elif letter:
                    out.append((role if letter == "K" else turn(), text))
                    cost += 2 * (letter == "R") + bool(cut)
            # A rerole or insertion that is not the only legal one makes an illegal whole, so `turn` loses nothing.
            if legal("".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def plain(table):
    """The digest rows of a small table, read from the contract."""
    after: dict = {}
    for conv, turn, role, text in table:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        rows = after.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        rows += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, rows in after.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
            seen.add((role, text))
        turns = sorted({t for t, _, _ in rows if t is not None})
        gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, kept = cheapest([(r, t, f in ("b", "d"), f == "t") for (_, r, t), f in zip(rows, faults)])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def result(spark, table, parts=2):
    df = spark.createDataFrame(table, SCHEMA).repartition(parts)
    got = figures(repair_steps(damaged(df), live_col="live")).withColumnRenamed("conv", "conv_id").select(*COLUMNS).collect()
    return sorted(map(tuple, got), key=lambda r: (r[0] is not None, r[0] or 0))


def rows_of(rng, conv, n):
    return [(conv, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "tool", None, "unknown", ""]),
             rng.choice(["Yes.", "No!", "and then", " \t", "", None, "Why? ", "é…"])) for _ in range(n)]


def test_every_small_conversation_matches_trying_all_edits(spark):
    rng = random.Random(5)
    table = [r for conv in range(150) for r in rows_of(rng, conv, rng.randrange(1, 5))]
    table += rows_of(rng, None, 3)
    assert result(spark, table) == plain(table)


def test_path_order_equals_comparing_whole_audits():
    """A plain search that keeps whole audits, over long rows of few kinds, where ties are open for long."""
    rng = random.Random(1)
    for case in range(300):
        kinds = rng.choice(["u", "ua", "uas", "ut", "uast"])
        rows = [(rng.choice(kinds), rng.random() < 0.1, rng.random() < 0.2) for _ in range(rng.randrange(0, 40))]
        search, decided = Survivors(), []
        states = {0: (0, "")}
        for initial, must_go, cut in rows:
            decided += search.step(initial, must_go, cut)
            new = {}
            for start, (cost, audit) in states.items():
                state = start
                for k in range(3):
                    turn = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                    kept = 1 if initial == "s" and state == 0 else turn if initial == {2: "u", 3: "a"}[turn] else None
                    ways = [(3, "D", state)]
                    if not must_go:
                        ways += [(2 + cut, "R", turn)] + ([(int(cut), "K", kept)] if kept is not None else [])
                    for c, letter, end in ways:
                        found = (cost + 2 * k + c, audit + "I" * k + letter)
                        new[end] = min(new.get(end, found), found)
                    state = turn
            states = new
        ends = [(states[0][0], states[0][1])] if 0 in states else []
        ends += [(states[3][0], states[3][1])] if 3 in states else []
        ends += [(states[2][0] + 2, states[2][1] + "I")] if 2 in states else []
        ends += [(states[1][0] + 4, states[1][1] + "II")] if 1 in states else []
        cost, rest, inserts = search.finish()
        assert (cost, "".join(decided) + "".join(rest) + inserts) == min(ends), (case, rows)


def test_what_survivors_share_leaves_the_tree():
    search, most = Survivors(), 0
    for i in range(20_000):
        search.step("ua"[i % 2], False, i % 7 == 0)
        most = max(most, search.undecided())
    assert most < 10
    nodes, stack = 0, [search.root]
    while stack:
        node = stack.pop()
        nodes += 1
        assert node.refs == len(node.children) + (node in search.tips.values())
        stack += node.children
    assert nodes <= 7
    # Two phases that never meet keep their rows undecided, in a handful of nodes.
    search = Survivors()
    for _ in range(5_000):
        search.step("u", False, False)
    assert search.undecided() <= 2 * 5_000
    assert search.finish()[0] == 5_000


def test_real_rows_long_conversation_and_other_columns(spark):
    rng = random.Random(3)
    table = [(1, t, ("user", "assistant")[t % 2], f"Row {t}.") for t in range(3_000)] + rows_of(rng, 2, 4)
    df = spark.createDataFrame(table, SCHEMA).withColumns({"kind": F.lit("x"), "pos": F.lit(1), "h": F.lit(2)})
    steps = repair_steps(df)
    rows = [(r["role"], r["text"]) for r in repaired(steps).where("conv = 1").orderBy("pos").collect()]
    assert rows == [(r, t) for _, _, r, t in table[:3_000]]
    one = figures(steps).where("conv = 1").first()
    assert one["audit"] == "K" * 3_000 and one["cost"] == 0
    assert one["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()


def test_empty_table_and_nothing_left(spark):
    assert result(spark, []) == []
    dropped = [(c, 0, "user", "Hi.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert dropped
    empty = hashlib.sha256(b"").hexdigest()
    assert result(spark, dropped) == [(c, 0, 0, 0, 0, 0, 0, "", empty) for c, *_ in dropped]


def test_long_text_is_read_whole(spark):
    text = "word " * 400_000 + "end."
    table = [(7, 1, "user", text), (7, 2, "assistant", text), (7, 3, "user", text)]
    assert result(spark, table) == plain(table)


@needs_data
def test_sql_and_rerun_agree(spark):
    name = "op12_conversation_repair"
    want = sorted(duck(ORACLE_SQL[name]))
    for parts in (4, 3):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = QUERIES[name](spark, SF).select(*COLUMNS).collect()
        assert sorted(map(tuple, got)) == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)
