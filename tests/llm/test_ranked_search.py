import math
import random
import re
from collections import Counter

import pandas as pd
import pytest

from tallymark.llm import ranked_search
from tallymark.llm.queries import ORACLE_SQL, QUERIES
from tallymark.llm.ranked_search import pieces, rank_documents
from tests.llm.conftest import SF, duck, needs_data

NAME = "op13_ranked_search"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=20):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    out = []
    for name, text in dict.fromkeys(items):
        rows = []
        for d, c in held:
            n = sum(c.values())
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = 0
            for t in terms(text):
                if t in c:
                    df = sum(t in o for _, o in held)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                rows.append((d, score))
        rows.sort(key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        out += [(name, i + 1, d, s) for i, (d, s) in enumerate(rows[:k])]
    return sorted(out, key=str)


def ranked(spark, docs, items, k=20):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item string, score int").repartition(3)
    i = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, rank string")
    return sorted(map(tuple, rank_documents(d, i, k).collect()), key=str)


def corpus(rng, n):
    words = [f"w{i}" for i in range(30)] + ["É", "ß1", "日本", "A", "a"]
    return [(d, rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(words, weights=range(1, 36), k=rng.randrange(0, 40)))) for d in range(n)]


@pytest.mark.parametrize("bits,docs,at_once", [(62, 4_096, 256), (3, 20, 4)])
def test_equals_brute_force(spark, monkeypatch, bits, docs, at_once):
    for name, value in (("BITS", bits), ("DOCS", docs), ("AT_ONCE", at_once)):
        monkeypatch.setattr(ranked_search, name, value)
    rng = random.Random(2)
    table = corpus(rng, 150)
    table += [table[3]] * 4 + [(900 + i, table[5][1]) for i in range(30)] + [(None, table[5][1]), (901, None), (902, ""), (903, "!? \x01")]
    items = [(i, t) for i, (_, t) in enumerate(corpus(rng, 12))] + [(50, None), (51, ""), (52, "nothing here matches"), (1, "w3 w3 W3 é É"), (None, "w1 w20")]
    items.append(items[0])
    for k in (20, 3):
        assert ranked(spark, table, items, k) == plain(table, items, k)


def test_items_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "ITEM_CHARS", 60)
    rng = random.Random(4)
    table, items = corpus(rng, 40), corpus(rng, 9)
    assert ranked(spark, table, items) == plain(table, items)


def test_long_texts_are_cut_between_terms(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "PIECE", 7)
    text = "Ab1 éé-日本日本日本日本 x" * 50 + "Z"
    assert [t.decode() for part in pieces(text.encode()) for t in part] == terms(text)
    table = [(1, text), (2, "ab1"), (3, "word " * 300_000 + "ab1")]
    assert ranked(spark, table, [(1, "AB1 x")]) == plain(table, [(1, "AB1 x")])


def test_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == [] and ranked(spark, [(1, "a")], []) == [] and ranked(spark, [(1, "..")], [(1, "a")]) == []


def test_sql_on_odd_rows(spark):
    rng = random.Random(6)
    table = [*corpus(rng, 60), (200, None), (201, "")]
    items = corpus(rng, 5)
    want = duck(ORACLE_SQL[NAME], {"documents": pd.DataFrame(table, columns=["doc_id", "text"]), "benchmark": pd.DataFrame(items, columns=["item_id", "text"])})
    assert ranked(spark, table, items) == sorted(map(tuple, want), key=str)


@needs_data
def test_equals_the_sql_on_the_given_tables(spark):
    got = sorted(map(tuple, QUERIES[NAME](spark, SF).collect()))
    assert got == sorted(duck(ORACLE_SQL[NAME])) and len(got) > 100
