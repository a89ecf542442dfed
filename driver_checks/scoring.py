"""Parsing, field scoring, line items and the composite."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_checks import CENT, check
from driver_checks import tables as t
from driver_checks.ctes import score, sql
from tallymark.functions.amounts import amount_match, fold_match
from tallymark.functions.names import normalize_name, token_jaccard, tokens
from tallymark.functions.rating import rating_band
from tallymark.functions.text import currency_marker, excerpt
from tallymark.operators import judge as J
from tallymark.operators import lines as L
from tallymark.operators import scoring as S
from tallymark.operators.summary import reconcile_totals
from tallymark.schemas import FIELDS

KEYS = ["execution", "config", "doc_id"]


def r6(c):
    return F.round(c, 6)


def _answer_text(flat):
    """The answer as JSON text, with the ways in which a text can fail to be an answer on fixed residues."""
    money = {f: (F.col(f"p_{f}") / 100).cast("decimal(18,2)").alias(f) for f in ("subtotal", "discount", "tax", "total")}
    # Amounts as numbers or as numeric strings, property names in two spellings.
    text = F.to_json(F.struct(
        F.struct(F.col("p_vendor_name").alias("name")).alias("vendor"),
        F.struct(F.col("p_customer_name").alias("name"), F.lit(None).cast("string").alias("address")).alias("customer"),
        F.col("p_invoice_number").alias("invoiceNumber"), F.col("p_invoice_date").cast("string").alias("invoiceDate"),
        F.col("p_due_date").cast("string").alias("dueDate"), F.col("p_currency").alias("currency"),
        money["subtotal"], money["discount"], money["tax"].cast("string").alias("tax"), money["total"],
        F.transform("p_line_items", lambda x: F.struct(
            x["description"].alias("description"), (x["amount"] / 100).cast("decimal(18,2)").alias("amount"))).alias("lineItems"),
        F.array(F.lit("note")).alias("warnings"),
    ), {"ignoreNullFields": "false"})
    text = F.when(F.col("doc_id") % 2 == 0, F.replace(text, F.lit('"total":'), F.lit('"Total" :'))).otherwise(text)
    kind = F.col("doc_id") % 31
    return (
        F.when(kind == 0, F.concat(text, F.lit(" done")))
        .when(kind == 1, F.lit("null"))
        .when(kind == 2, F.regexp_replace(text, '"invoiceDate":"[^"]*"', '"invoiceDate":"2020-02-30"'))
        .when(kind == 3, F.replace(text, F.lit('"currency":'), F.lit('"currency":7,"x":')))
        .when(kind == 4, F.lit(""))
        .when(kind == 5, F.concat(F.lit("["), text, F.lit("]")))
        .when(kind == 6, F.concat(F.lit(" "), text, F.lit("\n")))
        # Amounts in strings must be numbers and nothing else: neither padded nor with a plus sign.
        .when(kind == 7, F.regexp_replace(text, '"subtotal":[^,]*,', '"subtotal":" 5 ",'))
        .when(kind == 8, F.regexp_replace(text, '"tax":[^,]*,', '"tax":"+5",'))
        .otherwise(text)
    )


def answer_texts(spark, d):
    flat = t.flat_answers(spark, d)
    return flat.select(*KEYS, _answer_text(flat).alias("response_text"))


@check("parse_answers", sql("""
    SELECT execution, config, doc_id, bad AS failed,
           CASE WHEN NOT bad THEN p_invoice_number END AS invoice_number,
           CASE WHEN NOT bad THEN CAST(p_invoice_date AS VARCHAR) END AS invoice_date,
           CASE WHEN NOT bad THEN CAST(p_due_date AS VARCHAR) END AS due_date,
           CASE WHEN NOT bad THEN p_currency END AS currency,
           CASE WHEN NOT bad THEN p_subtotal END AS subtotal, CASE WHEN NOT bad THEN p_discount END AS discount,
           CASE WHEN NOT bad THEN p_tax END AS tax, CASE WHEN NOT bad THEN p_total END AS total,
           CASE WHEN NOT bad THEN p_vendor_name END AS vendor_name, CASE WHEN NOT bad THEN p_customer_name END AS customer_name,
           CASE WHEN NOT bad THEN CAST(len(p_line_items) AS BIGINT) END AS n_lines,
           CASE WHEN NOT bad THEN array_to_string(list_transform(p_line_items,
                lambda x: coalesce(x.description, '-') || '=' || x.amount), ';') END AS line_text
    FROM (SELECT *, doc_id % 31 IN (0, 1, 2, 3, 4, 5, 7, 8) AS bad FROM answers)""", "answers"))
def parse_answers(spark, d):
    parsed = S.parse_answers(answer_texts(spark, d))
    p = F.col("predicted")
    cents = lambda c: (c * 100).cast("long")
    return parsed.select(
        *KEYS, p.isNull().alias("failed"), p["invoiceNumber"].alias("invoice_number"),
        p["invoiceDate"].cast("string").alias("invoice_date"), p["dueDate"].cast("string").alias("due_date"),
        p["currency"].alias("currency"), *[cents(p[f]).alias(f) for f in ("subtotal", "discount", "tax", "total")],
        p["vendor"]["name"].alias("vendor_name"), p["customer"]["name"].alias("customer_name"),
        F.when(p["lineItems"].isNotNull(), F.size(p["lineItems"])).cast("long").alias("n_lines"),
        F.array_join(F.transform(p["lineItems"], lambda x: F.concat(
            F.coalesce(x["description"], F.lit("-")), F.lit("="), cents(x["amount"]).cast("string"))), ";").alias("line_text"))


_LONG = " UNION ALL ".join(
    f"SELECT execution, config, doc_id, '{f}' AS field, CAST({f} AS VARCHAR) AS expected_value, "
    f"CASE WHEN parsed THEN CAST(p_{f} AS VARCHAR) END AS actual_value, outcome_{f} AS outcome, "
    f"{score(f'outcome_{f}')} AS score FROM outcomes" for f in FIELDS)


@check("field_outcomes", sql(_LONG, "outcomes"))
def field_outcomes(spark, d):
    return S.field_outcomes(t.scored(spark, d), keys=tuple(KEYS), tol=CENT).drop("reason")


def _shown(f: str, c: str) -> str:
    if f in ("subtotal", "discount", "tax", "total"):
        return f"CAST({c} AS VARCHAR)"
    return f"strftime({c}, '%Y-%m-%d')" if f.endswith("_date") else f"'''' || {c} || ''''"


_REASONS = " UNION ALL ".join(
    f"SELECT execution, config, doc_id, '{f}' AS field, outcome_{f} AS outcome, {_shown(f, f)} AS e, CASE WHEN parsed THEN {_shown(f, 'p_' + f)} END AS a FROM outcomes"
    for f in FIELDS)


@check("outcome_reason", sql(f"""
    SELECT execution, config, doc_id, field, outcome || ': expected ' || coalesce(e, 'null') || ', got ' || coalesce(a, 'null') AS reason
    FROM ({_REASONS})""", "outcomes"))
def outcome_reason(spark, d):
    rows = S.field_outcomes(t.scored(spark, d), keys=tuple(KEYS), tol=CENT)
    return rows.select(*KEYS, "field", "reason")


@check("amount_match", """
    SELECT l_orderkey AS doc_id, l_linenumber AS line, l_partkey AS part, count(*) AS n,
           count(*) FILTER (abs(CAST(round(l_extendedprice * 100) AS BIGINT)
               - CAST(round(l_quantity * p_retailprice * 100) AS BIGINT)) <= 1) AS matching
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def amount_match_(spark, d):
    """Printed line amount against quantity times list price, as exact decimals."""
    item, part = t.table(spark, d, "lineitem"), t.table(spark, d, "part")
    money = lambda c: F.round(c * 100).cast("decimal(18,0)") / F.lit(100)
    listed = item.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        amount_match(money(F.col("l_extendedprice")), money(F.col("l_quantity") * F.col("p_retailprice"))).alias("same"))
    return listed.groupBy("doc_id", "line", "part").agg(F.count("*").alias("n"), F.count_if("same").alias("matching"))


@check("fold_match", sql("""
    SELECT execution, config, count(*) FILTER (upper(trim(p_currency)) = upper(trim(currency))) AS currency_matches,
           count(*) FILTER (upper(trim(' ' || p_invoice_number)) = upper(trim(invoice_number))) AS number_matches
    FROM answers GROUP BY execution, config""", "answers"))
def fold_match_(spark, d):
    flat = t.flat_answers(spark, d)
    return flat.groupBy("execution", "config").agg(
        F.count_if(fold_match(F.col("p_currency"), F.col("currency"))).alias("currency_matches"),
        F.count_if(fold_match(F.concat(F.lit(" "), "p_invoice_number"), F.col("invoice_number"))).alias("number_matches"))


@check("schema_validity", sql("""
    SELECT execution, config, doc_id, schema_validity,
           CASE WHEN NOT parsed THEN 'No invoice could be read. not JSON' ELSE concat_ws(' ',
             CASE WHEN p_invoice_number IS NULL AND p_invoice_date IS NULL AND p_total IS NULL
                  THEN 'Number, date and total are missing, all three.' END,
             CASE WHEN NOT regexp_full_match(p_currency, '[A-Z]{3}') THEN 'No currency code: ' || p_currency END,
             CASE WHEN len(list_filter(p_line_items, lambda x: x.description IS NULL)) > 0
                  THEN 'Lines without a description: 0' END) END AS violations
    FROM rated""", "rated"))
def schema_validity(spark, d):
    rows = S.schema_validity(t.scored(spark, d))
    return rows.select(*KEYS, "schema_validity", F.array_join("violations", " ").alias("violations"))


@check("reconcile_totals", sql("""
    SELECT doc_id, abs(total - rebuilt) <= 1 AS consistent, total - rebuilt AS difference, rebuilt AS reconciled_total,
           CASE WHEN abs(total - rebuilt) <= 1 THEN 'The parts add up to the total.'
                ELSE 'The parts add up to ' || rebuilt || ', the total says ' || total || ': off by ' || (total - rebuilt) END AS reason
    FROM (SELECT *, subtotal - coalesce(discount, 0) + coalesce(tax, 0) AS rebuilt FROM golden)""", "golden"))
def reconcile_totals_(spark, d):
    rows = reconcile_totals(t.golden(spark, d).select("doc_id", "subtotal", "discount", "tax", "total"), CENT)
    return rows.select("doc_id", "consistent", "difference", "reconciled_total", "reason")


@check("recomputed_total", sql("SELECT execution, config, doc_id, recomputed_total_rate FROM rated", "rated"))
def recomputed_total(spark, d):
    return S.recomputed_total(t.scored(spark, d), CENT).select(*KEYS, "recomputed_total_rate")


@check("composite_score", sql("SELECT execution, config, doc_id, round(composite, 6) AS composite FROM scores", "scores"))
def composite_score(spark, d):
    return t.doc_scores(spark, d).select(*KEYS, r6("composite").alias("composite"))


@check("rating_band", sql("""
    SELECT execution, config, doc_id,
           CASE WHEN composite >= 1 THEN 'Exceptional' WHEN composite >= 0.9e0 THEN 'Good' WHEN composite >= 0.7e0 THEN 'Average'
                WHEN composite >= 0.5e0 THEN 'Poor' ELSE 'Unacceptable' END AS rating, composite < 0.9e0 AS failed,
           CASE WHEN recomputed_total_rate IS NULL THEN 'Inconclusive' WHEN recomputed_total_rate = 1 THEN 'Unacceptable'
                ELSE 'Exceptional' END AS recomputed_rating, coalesce(recomputed_total_rate = 1, false) AS recomputed_failed
    FROM (SELECT * REPLACE (round(composite, 9) AS composite) FROM scores)""", "scores"))
def rating_band_(spark, d):
    rows = t.doc_scores(spark, d).select(
        *KEYS, rating_band(F.round("composite", 9), 0.9).alias("b"), rating_band(F.col("recomputed_total_rate"), inverted=True).alias("i"))
    return rows.select(*KEYS, "b.*", F.col("i.rating").alias("recomputed_rating"), F.col("i.failed").alias("recomputed_failed"))


@check("golden_x_answers", sql("""
    SELECT execution, config, source, count(*) AS n, count(*) FILTER (parsed) AS parsed FROM answers GROUP BY ALL""", "answers"))
def golden_x_answers(spark, d):
    scored = t.scored(spark, d)
    answers = scored.select(*KEYS, "predicted")
    golden = t.golden(spark, d).select("doc_id", "source", t.invoice().alias("expected"))
    return S.golden_x_answers(golden, answers).groupBy("execution", "config", "source").agg(
        F.count("*").alias("n"), F.count("predicted").alias("parsed"))


@check("line_match", sql("""
    SELECT execution, config, doc_id, CAST(coalesce(matched, 0) AS BIGINT) AS matched, CAST(n_gold AS BIGINT) AS n_golden,
           CAST(n_pred AS BIGINT) AS n_predicted FROM rated WHERE n_gold IS NOT NULL""", "rated"))
def line_match(spark, d):
    """From line tables: long documents split into runs of neighbouring amounts."""
    scored = t.scored(spark, d)

    def side(column):
        rows = scored.select(*KEYS, F.posexplode(column).alias("idx", "l"))
        return rows.select(*KEYS, "idx", "l.description", "l.amount")

    return L.match_line_tables(side("expected.lineItems"), side("predicted.lineItems"), KEYS, tol=CENT,
                               documents=scored.where(F.col("expected.lineItems").isNotNull())).select(
        *KEYS, "matched", "n_golden", "n_predicted")


@check("line_items_prf", sql("""
    SELECT execution, config, doc_id, round(line_items_precision, 6) AS "precision", round(line_items_recall, 6) AS recall,
           round(line_items_f1, 6) AS f1 FROM scores""", "scores"))
def line_items_prf(spark, d):
    rows = L.line_items(t.scored(spark, d), CENT)
    return rows.select(*KEYS, *[r6(f"line_items_{m}").alias(m) for m in ("precision", "recall", "f1")])


_T = ("list_distinct(list_filter(string_split(regexp_replace(lower(p_name || ' ' || p_brand), "
      "'[^\\p{L}\\p{Nd}]+', ' ', 'g'), ' '), lambda x: x <> ''))")
_U = "list_distinct(list_filter(string_split(regexp_replace(lower(p_name || ' ' || p_type), '[^\\p{L}\\p{Nd}]+', ' ', 'g'), ' '), lambda x: x <> ''))"


@check("token_jaccard", f"""
    SELECT p_partkey, round(len(list_intersect({_T}, {_U}))::DOUBLE / len(list_distinct(list_concat({_T}, {_U}))), 6) AS overlap
    FROM part""")
def token_jaccard_(spark, d):
    part = t.table(spark, d, "part")
    a, b = tokens(F.concat_ws(" ", "p_name", "p_brand")), tokens(F.concat_ws(" ", "p_name", "p_type"))
    return part.select("p_partkey", r6(token_jaccard(a, b)).alias("overlap"))


@check("gray_zone", sql("""
    SELECT execution, config,
           count(*) FILTER (outcome_vendor_name = 'mismatch') AS vendor_gray,
           count(*) FILTER (outcome_customer_name = 'mismatch') AS customer_gray
    FROM outcomes GROUP BY execution, config""", "outcomes"))
def gray_zone(spark, d):
    rows = t.scored(spark, d)
    e, p = F.col("expected"), F.col("predicted")
    return rows.groupBy("execution", "config").agg(*[
        F.count_if(J.gray_zone(e[x]["name"], p[x]["name"])).alias(f"{x}_gray") for x in ("vendor", "customer")])


@check("vendor_in_input", sql("""
    SELECT config, source, count(*) AS n, count(*) FILTER (NOT (input_mode = 'ocr' AND ocr_path IS NOT NULL)) AS in_input
    FROM answers GROUP BY config, source""", "answers"))
def vendor_in_input(spark, d):
    return t.flat_answers(spark, d).groupBy("config", "source").agg(
        F.count("*").alias("n"), F.count_if(J.vendor_in_input(F.col("input_mode"), F.col("ocr_path"))).alias("in_input"))


@check("currency_marker", """
    SELECT doc_id, CASE WHEN regexp_matches(text, '(^|[^\\w])(USD|EUR|GBP|JPY|CHF|CAD|AUD|CNY|INR|SEK|NOK|DKK|PLN)($|[^\\w])') THEN 'Code'
                        WHEN regexp_matches(text, '[$€£¥₹]') THEN 'Symbol' ELSE 'None' END AS marker
    FROM (SELECT doc_id, text FROM documents
          UNION ALL SELECT -1 - l_orderkey, 'TOTAL ' || max(l_extendedprice) || (['$', ' EUR', '', ' USDX', '₹ 5'])[l_orderkey % 5 + 1]
          FROM lineitem GROUP BY l_orderkey)""")
def currency_marker_(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", "text")
    priced = t.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("x")).select(
        (-1 - F.col("l_orderkey")).alias("doc_id"), F.concat(F.lit("TOTAL "), F.col("x").cast("string"), F.expr(
            "element_at(array('$', ' EUR', '', ' USDX', '₹ 5'), cast(l_orderkey % 5 as int) + 1)")).alias("text"))
    return docs.unionAll(priced).select("doc_id", currency_marker(F.col("text")).alias("marker"))


@check("real_mismatches", sql("SELECT execution, config, doc_id, field, golden, predicted FROM mismatches", "mismatches"))
def real_mismatches(spark, d):
    return J.real_mismatches(S.with_field_outcomes(t.scored(spark, d), CENT))


@check("verdict_join", sql("""
    SELECT execution, config, doc_id, 'vendor_name' AS field, judged_vendor_name AS judged_outcome, judge_state_vendor_name AS judge_state
    FROM judged_scores UNION ALL
    SELECT execution, config, doc_id, 'customer_name', judged_customer_name, judge_state_customer_name FROM judged_scores""",
    "judged_scores"))
def verdict_join(spark, d):
    rows = S.with_field_outcomes(t.scored(spark, d), CENT)
    verdicts = t.verdicts(J.real_mismatches(rows))
    long = rows.select(*KEYS, "input_mode", "ocr_path", F.explode(F.array(*[F.struct(
        F.lit(f).alias("field"), S.field_value(F.col("expected"), f).alias("golden"),
        S.field_value(F.col("predicted"), f).alias("predicted"), F.col(f"outcome_{f}").alias("outcome"),
    ) for f in ("vendor_name", "customer_name")])).alias("n")).select(*KEYS, "input_mode", "ocr_path", "n.*")
    in_input = (F.col("field") != "vendor_name") | J.vendor_in_input(F.col("input_mode"), F.col("ocr_path"))
    return J.verdict_join(long, verdicts, in_input).select(*KEYS, "field", "judged_outcome", "judge_state")


@check("normalize_name", """
    SELECT c_custkey, n.name_out FROM (
      SELECT c_custkey, rtrim(regexp_replace(lower(replace(c_name, '#', ' ')), ' +', ' ', 'g')) AS name_out FROM customer) n""")
def normalize_name_(spark, d):
    """Every customer name with a stack of legal forms; what is left is the bare name."""
    forms = F.expr("element_at(array(' Inc.', ', GmbH & Co. KG', ' S.A. Ltd', ' Co. Ltd', ''), cast(c_custkey % 5 as int) + 1)")
    return t.table(spark, d, "customer").select("c_custkey", normalize_name(F.concat("c_name", forms)).alias("name_out"))


_HIT = "list_position(list_transform(ls, lambda x: contains(lower(x), lower(needle))), true)"


@check("excerpt", f"""
    SELECT doc_id, substr(trim(array_to_string(ls[a:b], chr(10)), chr(10) || chr(13) || chr(9) || ' '), 1, 1500) AS excerpt
    FROM (SELECT doc_id, ls, CASE WHEN hit IS NULL THEN 1 ELSE greatest(1, hit - 3) END AS a,
                 CASE WHEN hit IS NULL THEN 7 ELSE hit + 3 END AS b
          FROM (SELECT *, {_HIT} AS hit
                FROM (SELECT doc_id, string_split(text, chr(10)) AS ls,
                             (regexp_extract_all(text, '[^\\s]+'))[1 + len(regexp_extract_all(text, '[^\\s]+')) // 2] AS needle
                      FROM documents)))""")
def excerpt_(spark, d):
    """The lines around the first use of each document's middle word."""
    words = F.regexp_extract_all("text", F.lit(r"([^\s]+)"), 1)
    docs = t.table(spark, d, "documents").select("doc_id", "text", F.get(words, (F.size(words) / 2).cast("int")).alias("needle"))
    return docs.select("doc_id", excerpt(F.col("text"), F.col("needle"), F.lit(None).cast("string")).alias("excerpt"))
