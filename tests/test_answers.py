"""One look at the type of a whole answer settles a plain one; whatever is not plain is looked at as before."""

import json

from pyspark.sql import functions as F

from tallymark.functions import answers as A

PARTY = {"name": "Ann", "address": {"city": None, "country": "PT"}}
FULL = {
    "invoiceNumber": "7", "invoiceDate": "2024-01-02", "dueDate": None, "currency": "EUR", "subtotal": 1, "discount": None, "tax": "0.50", "total": 1.5,
    "vendor": PARTY, "customer": None, "lineItems": [{"description": "a", "quantity": 1, "unitPrice": 1e30, "amount": 2.25}, {"description": None}]}
PLAIN = [FULL, {}, {"vendor": {}}, {"lineItems": []}, {**FULL, "warnings": ["note"], "confidence": 0.5, "checked": True, "notes": []}]
# Plain for the old look, but not for the new one; and wrong under each kind of name.
OTHER = [{"a b": 1}, {"extra": {"x": 1}}, {"nickname": 1}, {"lineItems": [{"x": {"y": 1}}]}, {"mixed": [1, "a"]}, {"x": {"name": 3}}]
WRONG = [
    {"currency": 7}, {"invoiceNumber": True}, {"invoiceDate": ["2024-01-02"]}, {"total": True}, {"tax": {"x": 1}}, {"vendor": "Ann"}, {"customer": [1]},
    {"vendor": {"name": 1}}, {"vendor": {"address": "x"}}, {"vendor": {"address": {"city": 2}}}, {"lineItems": {"amount": 1}}, {"lineItems": [1]},
    {"lineItems": ["x"]}, {"lineItems": [{"amount": True}]}, {"lineItems": [{"amount": " 5 "}]}, {"lineItems": [{"description": 1}]}, {"lineItems": [{"amount": 1}, 2]}]


def looked(spark, values):
    texts = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i long, t string")
    kind = F.schema_of_variant(F.parse_json("t"))
    rows = A.with_invoice(texts, "t").withColumns({"plain": kind.rlike(A._PLAIN), "unusual": kind.rlike(A._UNUSUAL)}).orderBy("i").collect()
    return [(r.plain, r.unusual, r.parse_error) for r in rows]


def test_plain_answers_need_one_look(spark):
    assert looked(spark, PLAIN) == [(True, False, None)] * len(PLAIN)
    assert [(plain, error) for plain, _, error in looked(spark, OTHER)] == [(False, None)] * len(OTHER)


def test_wrong_answers_are_not_plain(spark):
    got = looked(spark, [*WRONG, *({**FULL, "warnings": ["w"], **w} for w in WRONG)])
    assert not any(plain for plain, _, _ in got) and all(error for _, _, error in got)


def test_names_in_other_cases_are_found_once(spark):
    """A quoted name that is a value, or an unknown name, stays; spaces before the colon and repeats do not matter."""
    text = '{"TOTAL" : 1, "vendor":{"Name":"total"}, "LINEITEMS":[{"Amount":1,"note":"Tax"},{"Amount":2}], "Totals":3}'
    df = A.with_invoice(spark.createDataFrame([(text,), (None,)], "t string"), "t")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "(?i:" in plan and plan.count("(?i:") == 1
    good, missing = sorted(df.collect(), key=lambda r: r.t is None)
    assert good.parse_error is None and str(good.predicted.total) == "1.000000" and good.predicted.vendor.name == "total"
    assert [str(x.amount) for x in good.predicted.lineItems] == ["1.000000", "2.000000"]
    assert missing.predicted is None and missing.parse_error == "Response is not one JSON value."
