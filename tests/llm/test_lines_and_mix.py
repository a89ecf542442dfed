import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallymark.llm.line_dedup import dedup_lines
from tallymark.llm.mixing import mix
from tallymark.llm.queries import LINES_SQL, MIX_SQL, QUERIES
from tests.llm.conftest import SF, duck, needs_data
from tests.llm.plain import deduped

DOCS = "doc_id long, text string, source string, n_lines string, size string"


def frame(spark, rows, source="s"):
    return spark.createDataFrame([(*r, "x", "y") if len(r) == 3 else (*r, source, "x", "y") for r in rows], DOCS)


LINES = [
    (1, "Shared Line here\nown one of one\n\nshort\nÉcole des MINES"), (2, " shared line HERE\t\nown line of two\nshort\n"), (3, "short\nshort"),
    (4, None), (5, ""), (6, "twice inside me\ntwice inside me"), (7, "école des mines\n\x0bÉcole des mines "), (8, "filler line\n" * 30_000 + "shared line here"),
    (9, "a\x0cb c d e f g h\nfiller line")]


def test_lines_equal_the_plain_version_and_the_sql(spark):
    got = dedup_lines(frame(spark, LINES))
    assert got.columns == ["doc_id", "text", "source", "size", "n_lines", "n_dropped"]
    rows = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect())
    assert rows == deduped(LINES)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    sql = duck(f"SELECT doc_id, kept_sha256, n_lines, n_dropped FROM ({LINES_SQL}) ORDER BY 1", {"documents": pd.DataFrame(LINES, columns=["doc_id", "text"])})
    assert sql == [(i, sha(t), n, d) for i, t, n, d in rows]


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "the same line\nx"), (1, "the same line\nx"), (1, "y\nthe same line"), (None, "the same line\nq"), (None, "only nameless rows"),
            (None, "only nameless rows"), (2, "THE SAME LINE")]
    got = sorted(((r["doc_id"], r["text"]) for r in dedup_lines(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, "the same line\nx")] * 2 + [(1, "y\nthe same line"), (None, "q"), (2, "")] + [(None, "only nameless rows")] * 2, key=str)
    assert dedup_lines(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_a_higher_number_of_documents(spark):
    rows = [(i, "everyone has this\nhalf of them has it" if i < 2 else "everyone has this") for i in range(3)]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(frame(spark, rows), min_docs=3).collect()}
    assert got == {0: "everyone has this\nhalf of them has it", 1: "half of them has it", 2: ""}


def mixed_rows():
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 4}") for i in range(400)]
    rows += [(1000 + i, "word " * 30_000 if i == 0 else "b c", "big") for i in range(20)]
    rows += [(2000, None, "null text"), (2001, "", None), (2002, "a b\tc\x0bd\n", None), (2003, " ", "s0"), (2004, "z", "Ä"), (2005, "z", "z")]
    return rows


@pytest.mark.parametrize("few", [False, True])
def test_mix_equals_its_sql(spark, monkeypatch, few):
    if few:  # refine down to single documents
        monkeypatch.setattr("tallymark.llm.mixing.FEW", 0)
    rows = mixed_rows()
    mixed = mix(frame(spark, rows))
    assert mixed.columns == ["doc_id", "text", "source", "n_lines", "size", "source_size", "target", "times"]
    got = sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["times"] * r["size"]) for r in mixed.collect())
    sql = duck(f"SELECT doc_id, size, source_size, round(target, 6), taken FROM ({MIX_SQL}) ORDER BY 1", {"documents": pd.DataFrame(rows, columns=["doc_id", "text", "source"])})
    assert got == sql
    by = mixed.groupBy("source").agg(F.sum(F.col("times") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.max("size").alias("most"), F.max("times").alias("times"))
    for r in by.collect():
        assert abs(r["taken"] - r["target"]) <= r["most"] / 2 + 1e-6
    narrow = mix(frame(spark, rows), keep=("doc_id",))
    assert sorted((r["doc_id"], r["times"]) for r in narrow.collect()) == sorted((r["doc_id"], r["times"]) for r in mixed.collect())


def test_mix_of_repeated_rows_null_ids_and_nothing(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", "s"), (None, "f", None)]
    got = mix(frame(spark, rows)).collect()
    assert len(got) == 4 and len({r["times"] for r in got if r["doc_id"] == 1}) == 1
    assert mix(frame(spark, rows).limit(0)).count() == 0
    assert all(r["target"] == 0 for r in mix(frame(spark, [(1, "", "a"), (2, None, "b")])).collect())


@needs_data
@pytest.mark.parametrize("name, sql", [("op5_line_dedup", LINES_SQL), ("op10_mixing", MIX_SQL)])
def test_queries_equal_their_sql(spark, name, sql):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    plain = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert plain(got.select(*columns).collect()) == plain(duck(f"SELECT {', '.join(columns)} FROM ({sql})"))
