import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import ngram_join as j
from tallymark.llm.common import maybe_in
from tallymark.llm.components import components
from tallymark.session import setting
from tests.llm.conftest import SF, needs_data
from tests.llm.plain import similar

SCHEMA = "doc_id long, text string, n_shingles string"


def variants(seed=0):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    rows, name = [], 0
    for size, copies in ((12, 6), (40, 8), (150, 60), (150, 12), (11, 30), (700, 5)):
        words = [rnd.choice(vocabulary) for _ in range(size)]
        for _ in range(copies):
            changed = list(words)
            for _ in range(rnd.randrange(0, max(2, size // 25))):
                changed[rnd.randrange(size)] = rnd.choice(vocabulary)
            rows.append((name, rnd.choice([" ", "\t", "\n "]).join(changed)))
            name += 1
    rows += [(name + i, passage + " " + " ".join(rnd.choice(vocabulary) for _ in range(30))) for i in range(40)]
    name += 40
    # Nine shingles in ten: exactly at the limit; and a chain whose ends do not link.
    rows += [(name, "a b c d e f g h i j k"), (name + 1, "a b c d e f g h i j k l"), (name + 2, "A b  c d e f g h i j k"), (name + 3, "x y"), (name + 4, "X\ty")]
    chain = [f"c{i}" for i in range(62)]
    rows += [(name + 10 + i, " ".join(chain[i:i + 50])) for i in range(0, 12, 2)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("classes", [(32, 1024), (3, 8)])
def test_groups_equal_all_pairs(spark, classes):
    rows = variants() + [(9000, ""), (9001, None), (9002, " \n")]
    plain = similar(rows)
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.similar_groups(docs, classes=classes).collect()}
    assert got == {rows[x][0]: v for x, v in plain.items()}
    assert sum(v[1] != i for i, v in got.items()) > 50


@pytest.mark.parametrize("num", [50, 80, 90])
def test_linked_sets_share_a_signature(num):
    rnd = random.Random(num)
    for _ in range(400):
        n = rnd.randint(1, 120)
        a = rnd.sample(range(10_000), n)
        b = a[:n - rnd.randint(0, n // 4)] + rnd.sample(range(20_000, 30_000), rnd.randint(0, n // 4))
        common = len(set(a) & set(b))
        if 100 * common < num * (len(a) + len(b) - common) or set(a) == set(b):
            continue
        df = {g: rnd.choice([2, 20, 40, 500, 2000]) for g in set(a) & set(b)}
        found = []
        for s in (a, b):
            shared = sorted((df[g], g) for g in s if g in df)
            counts, grams = (np.array([x[i] for x in shared], np.int64) for i in (0, 1))
            found.append({x for level in j.levels_of(len(s), num, 100) for x in j.signatures(len(s), counts, grams, level, num, 100)})
        assert found[0] & found[1], (len(a), len(b), common)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(5, text), (5, text), (3, text + " more"), (None, text), (None, "alone here at last"), (5, "another text of five"), (None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in j.similar_groups(docs).collect())
    assert got == [(-1, 0, -1), (-1, 2, -1), (-1, 28, 3), (3, 29, 3), (5, 2, 5), (5, 28, 3), (5, 28, 3)]
    assert j.similar_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("num", [50, 80, 90, 95])
def test_linked_sets_share_as_many_parts_as_they_need(num):
    rnd, classes = random.Random(num), j.size_classes(num, 100)
    lows, open_to_all, tried = [c.low for c in classes], 0, 0
    for _ in range(1_500):
        n = rnd.choice([rnd.randint(1, 30), rnd.randint(1, 600)])
        a = [rnd.getrandbits(64) - (1 << 63) for _ in range(n)]
        most = n // rnd.choice([3, 30])
        b = a[:n - rnd.randint(0, most)] + [rnd.getrandbits(64) - (1 << 63) for _ in range(rnd.randint(0, most))]
        common = len(set(a) & set(b))
        if 100 * common < num * (len(a) + len(b) - common) or set(a) == set(b):
            continue
        p, q = ({k: (need, set(h.tolist())) for k, need, h in j.part_hashes(np.unique(np.array(s, np.int64)), classes, lows, num, 100)} for s in (a, b))
        assert any(len(p[k][1] & q[k][1]) >= max(p[k][0], q[k][0]) for k in set(p) & set(q)), (len(a), len(b), common)
        open_to_all, tried = open_to_all + (min(need for need, _ in p.values()) <= 0), tried + 1
    assert tried > 100 and (num == 50 or open_to_all < 0.1 * tried)


def test_membership_filter_loses_nothing(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("k"), F.xxhash64("id").alias("v"))
    keys = rows.where("v % 50 = 0")
    left = maybe_in(rows, keys, ("k", "v"))
    assert left.columns == rows.columns and left.where("v % 50 = 0").count() == keys.count()
    assert left.count() < keys.count() + 200 and maybe_in(rows, keys.limit(0), ("k", "v")).count() == 0


def test_one_id_with_several_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " y"), (None, b + " x"), (None, " ".join(f"n{i}" for i in range(60))), (None, " ".join(f"n{i}" for i in range(59)))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in j.similar_groups(docs).collect())
    assert got == [(-1, -1), (-1, -1), (-1, 1), (1, 1), (1, 1), (2, 1), (3, 1)]


def test_one_row_of_each_group_stays(spark):
    k, m, q = (" ".join(f"{c}{i}" for i in range(100)) for c in "kmq")
    rows = [(0, k), (1, k + " end"), (1, m), (2, m), (2, m), (None, q), (None, q + " end"), (None, q), (4, ""), (4, ""), (None, None), (5, "few words"), (5, "few words")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    kept = j.one_of_each(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert sum(got[r] for r in ((None, q), (None, q + " end"))) == 1
    assert {r: n for r, n in got.items() if r[1] not in (q, q + " end")} == {(0, k): 1, (1, m): 1, (4, ""): 2, (None, None): 1, (5, "few words"): 1}


def test_large_groups_are_cut(spark, monkeypatch):
    monkeypatch.setattr(j, "LOAD", 300)
    monkeypatch.setattr(j, "ROWS", 7)
    rows = variants(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.similar_groups(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    assert got == {rows[x][0]: v for x, v in similar(rows).items()}


def test_sets_travel_only_to_their_cells(spark, monkeypatch):
    """Joined by node, whole sets stay in their buckets: only the other side is shuffled, and shingles are counted once."""
    tried, names, meet, stored = [], [], j.meet, j.stored

    def watched(held, asking, labels, sets, num, den):
        plan = sets.join(labels, "node")._jdf.queryExecution().executedPlan().toString()
        tried.append(plan.count("Exchange hashpartitioning(node"))
        return meet(held, asking, labels, sets, num, den)

    monkeypatch.setattr(j, "meet", watched)
    monkeypatch.setattr(j, "stored", lambda df, name: names.append(name) or stored(df, name))
    rows, tables = variants(5), {t.name for t in spark.catalog.listTables()}
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.similar_groups(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    assert got == {rows[x][0]: v for x, v in similar(rows).items()}
    assert tried == [1] * (j.TRIES + 1) and names.count("counts") == 1
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}


@needs_data
def test_query_equals_all_pairs(spark):
    from tallymark.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op7_ngram_jaccard_join"](spark, SF).collect()}
    assert got == {rows[x][0]: v for x, v in similar(rows).items()}
