import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymark.functions.amounts import amount_match
from tallymark.functions.names import names_match, normalize_name
from tallymark.functions.text import doc_key, excerpt
from tallymark.operators.scoring import parse_answers
from tallymark.plans.evaluation import register_scorer, score_documents, unregister_scorer
from tallymark.schemas import FIELDS, INVOICE

GOLDEN = {
    "vendor": {"name": "Acme GmbH & Co. KG"}, "customer": {"name": "Jane Doe"}, "invoiceNumber": "INV-1",
    "invoiceDate": "2024-01-31", "dueDate": None, "currency": "EUR", "subtotal": 100.00, "discount": None, "tax": 19.00,
    "total": 150.00, "lineItems": None,
}


def scored(spark, answers, golden=GOLDEN):
    rows = spark.createDataFrame([(i, a, json.dumps(golden)) for i, a in enumerate(answers)], "doc_id long, response_text string, g string")
    expected = rows.withColumn("expected", F.from_json("g", INVOICE)).drop("g")
    return {r.doc_id: r for r in score_documents(parse_answers(expected)).collect()}


def answer(**changes):
    return json.dumps(GOLDEN | changes)


def test_perfect_and_unparsed(spark):
    rows = scored(spark, [answer(), "sorry", "null", answer() + " bye"])
    assert rows[0].composite == pytest.approx(1.0) and rows[0].outcome_due_date == "correct_null"
    assert all(rows[i].composite == 0 and rows[i].outcome_total == "unparsed" for i in (1, 2, 3))


def test_amount_tolerance_is_inclusive_and_exact(spark):
    rows = scored(spark, [answer(total=x) for x in (150.01, 149.99, 150.011, 150.02)])
    assert [rows[i].outcome_total for i in range(4)] == ["correct_value", "correct_value", "mismatch", "mismatch"]
    a = spark.createDataFrame([(Decimal("150.011"), Decimal("150"))], "a decimal(28,6), b decimal(28,6)")
    assert a.select(amount_match(F.col("a"), F.col("b"))).first()[0] is False


def test_outcomes_and_composite_of_nine_fields(spark):
    rows = scored(spark, [answer(dueDate="2024-02-01"), answer(total=None), answer(total=119.0), answer(total="150.00", Currency="EUR")])
    assert rows[0].outcome_due_date == "false_positive"
    # Printed amounts do not reconcile, so the recomputed-total part applies and the line items do not.
    assert rows[0].composite == pytest.approx((0.1 + 0.6 * 0.9 + 0.1) / 0.8)
    assert rows[1].outcome_total == "miss"
    assert rows[2].recomputed_total_rate == 1 and rows[2].composite == pytest.approx((0.1 + 0.54) / 0.8)
    assert rows[3].composite == pytest.approx(1.0)


def test_composite_drops_parts_that_do_not_apply(spark):
    golden = GOLDEN | {"total": 119.0}
    rows = scored(spark, [json.dumps(golden | {"dueDate": "2024-02-01"})], golden)
    assert rows[0].recomputed_total_rate is None
    assert rows[0].composite == pytest.approx((0.1 + 0.54) / 0.7)


def test_schema_violations(spark):
    rows = scored(spark, [
        answer(invoiceNumber=None, invoiceDate=None, total=None), answer(currency="eur"), answer(currency="EURO"),
        answer(lineItems=[{"description": "a"}, {"description": " "}, {"amount": 1}]), answer(invoiceDate="31.01.2024"), answer(currency=5)])
    assert [rows[i].schema_validity for i in range(6)] == [0] * 6
    assert rows[3].violations == ["Lines without a description: 1, 2"]
    assert rows[1].outcome_currency == "correct_value"
    assert rows[4].outcome_total == "unparsed" and rows[5].outcome_total == "unparsed"


def test_names(spark):
    pairs = [("Acme, Inc.", "ACME"), ("Foo S.à r.l.", "foo"), ("A & B Co. Ltd", "a and b"), ("Bar K.K.", "bar"), ("Müller GmbH & Co. KG", "müller")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    assert all(r[0] for r in rows.select(names_match(F.col("a"), F.col("b"))).collect())
    bare = spark.createDataFrame([("Inc",), ("Co Ltd",), ("foo and co ltd",), ("x inc ltd gmbh sa",)], "a string")
    assert [r[0] for r in bare.select(normalize_name(F.col("a"))).collect()] == ["inc", "co", "foo and", "x"]


def test_excerpt_and_key(spark):
    text = "\n".join(f"line {i}" for i in range(20)).replace("line 9", "Acme  International, LTD")
    rows = spark.createDataFrame([(text, "acme international", None), (text, "nobody", "line 15"), (text, "nobody", None)], "t string, g string, p string")
    got = [r[0] for r in rows.select(excerpt(F.col("t"), F.col("g"), F.col("p"))).collect()]
    assert got[0].split("\n")[0] == "line 6" and len(got[0].split("\n")) == 7
    assert got[1].startswith("line 12") and got[2].startswith("line 0") and got[2].endswith("line 6")
    keys = spark.createDataFrame([("fatura.T1_I0",), ("plain",), ("a.b.c",)], "s string")
    assert [r[0] for r in keys.select(doc_key(F.col("s"))).collect()] == ["fatura/T1_I0", "plain", "a/b.c"]


def test_registered_scorer_adds_a_metric(spark):
    register_scorer("has_vendor", lambda df: {"has_vendor": F.col("predicted.vendor.name").isNotNull().cast("double")})
    try:
        assert scored(spark, [answer()])[0].has_vendor == 1
    finally:
        unregister_scorer("has_vendor")
    assert len(FIELDS) == 10
