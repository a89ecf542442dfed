import random
import re

import pytest
from pyspark.sql import functions as F

from tallymark.operators.lines import line_items_prf, line_match, match_line_tables

LINES = "array<struct<description:string,amount:long>>"


def words(s):
    return set(re.findall(r"\w+", (s or "").lower()))


def greedy(gold, pred):
    left, matched = list(range(len(pred))), 0
    for gd, ga in gold:
        best = None
        for i in left:
            pd, pa = pred[i]
            if ga is None or pa is None or abs(ga - pa) > 1:
                continue
            a, b = words(gd), words(pd)
            overlap = len(a & b) / len(a | b) if a | b else 1
            if overlap >= 0.5 and (best is None or overlap > best[0]):
                best = (overlap, i)
        if best:
            left.remove(best[1])
            matched += 1
    return matched


def cases(n):
    rng = random.Random(5)
    pick = lambda k: [(" ".join(rng.choices("red blue big ring bolt".split(), k=rng.randint(0, 3))) or None,
                       rng.choice([None, *range(10, 16), 40, 41, 43])) for _ in range(rng.randint(0, k))]
    return [(i, pick(7), pick(7)) for i in range(n)]


def test_both_forms_agree_with_brute_force(spark):
    data = cases(400)
    rows = spark.createDataFrame(data, f"doc_id long, g {LINES}, p {LINES}")
    got = {r[0]: r[1] for r in rows.select("doc_id", line_match(F.col("g"), F.col("p"), tol=1)).collect()}
    want = {i: greedy(g, p) for i, g, p in data}
    assert got == want

    def table(c):
        return rows.select("doc_id", F.posexplode(c).alias("idx", "l")).select("doc_id", "idx", "l.*")

    tables = {r.doc_id: r for r in match_line_tables(table("g"), table("p"), ["doc_id"], tol=1).collect()}
    assert {i: r.matched for i, r in tables.items()} == {i: want[i] for i, g, _ in data if g}
    assert all((r.n_golden, r.n_predicted) == (len(data[i][1]), len(data[i][2])) for i, r in tables.items())


@pytest.mark.parametrize("m,g,p,want", [
    (2, 3, 4, (0.5, 2 / 3)), (1, 2, 1, (1.0, 0.5)), (0, 0, 0, (1.0, 1.0)), (0, 0, 2, (0.0, 0.0)), (0, 2, 0, (0.0, 0.0))])
def test_precision_and_recall(spark, m, g, p, want):
    row = spark.range(1).select(line_items_prf(F.lit(m), F.lit(g), F.lit(p)).alias("x")).select("x.*").first()
    assert (row.precision, row.recall) == pytest.approx(want)
    both = sum(want)
    assert row.f1 == pytest.approx(2 * want[0] * want[1] / both if both else 0)


def test_not_annotated_is_null_and_no_prediction_is_zero(spark):
    rows = spark.createDataFrame([(None, []), ([("a", 1)], None)], f"g {LINES}, p {LINES}")
    assert [r[0] for r in rows.select(line_match(F.col("g"), F.col("p"), tol=1)).collect()] == [None, 0]


def test_entries_of_equal_lines_agree_with_brute_force(spark):
    rng = random.Random(9)
    texts = ["red ring", "ring red", "Red  RING!", "red bolt", "big red ring", "", None, "blue"]
    side = lambda: [(rng.choice(texts), rng.choice([5, 6, 6, 7])) for _ in range(rng.randint(0, 25))]
    data = [(i, side(), side()) for i in range(150)]
    rows = spark.createDataFrame(data, f"doc_id long, g {LINES}, p {LINES}")
    table = lambda c: rows.select("doc_id", F.posexplode(c).alias("idx", "l")).select("doc_id", "idx", "l.*")
    got = {r.doc_id: r.matched for r in match_line_tables(table("g"), table("p"), ["doc_id"], tol=1).collect()}
    assert got == {i: greedy(g, p) for i, g, p in data if g}


def test_a_document_of_a_hundred_thousand_equal_amounts(spark):
    n = 100_000
    side = lambda shift: spark.range(n).select(
        F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("idx"), F.lit(10).cast("long").alias("amount"),
        F.element_at(F.array(F.lit("red ring"), F.lit("blue bolt"), F.lit("red bolt"), F.lit("green nut")), ((F.col("id") + shift) % 4 + 1).cast("int")).alias("description"))
    row = match_line_tables(side(0), side(1).where("idx % 8 <> 7"), ["doc_id"], tol=1).first()
    # Every kind finds its equals; of the kind that lost half its lines the others take nothing, as overlaps stay below a half.
    assert (row.n_golden, row.n_predicted, row.matched) == (n, n - n // 8, n - n // 8)


def test_long_tables_equal_the_row_form(spark):
    rng = random.Random(11)
    side = lambda: [(" ".join(rng.choices("red blue big ring bolt".split(), k=rng.randint(1, 3))), rng.choice([10, 10, 11])) for _ in range(120)]
    rows = spark.createDataFrame([(1, side(), side())], f"doc_id long, g {LINES}, p {LINES}")
    table = lambda c: rows.select("doc_id", F.posexplode(c).alias("idx", "l")).select("doc_id", "idx", "l.*")
    want = rows.select(line_match(F.col("g"), F.col("p"), tol=1)).first()[0]
    assert match_line_tables(table("g"), table("p"), ["doc_id"], tol=1).first().matched == want


def test_lines_printed_alike_match_without_those_that_have_no_amount(spark):
    lines = [("red", 10), (None, 10), ("red", None), ("red", 10), ("big ring", 11)]
    row = spark.createDataFrame([(lines, lines)], f"g {LINES}, p {LINES}")
    assert row.select(line_match(F.col("g"), F.col("p"), tol=1)).first()[0] == greedy(lines, lines) == 4
