"""Annotation corpora, sampling and invoice tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_checks import CENT, check
from driver_checks import tables as t
from driver_checks.ctes import sql
from tallymark.operators import convert as V
from tallymark.operators import summary as Y
from tallymark.operators.sampling import holdout_strata, stratified_sample

# Where each span sits on the page: left, bottom, right, top.
_BOXES = {
    "BILL_TO": (316.0, 699.0, 511.0, 783.0), "BUYER": (316.0, 699.0, 511.0, 783.0), "SELLER_NAME": (36.0, 739.0, 99.0, 751.0),
    "SELLER_ADDRESS": (36.0, 708.0, 249.0, 734.0), "NUMBER": (36.0, 639.0, 154.0, 651.0), "DUE_DATE": (301.0, 637.0, 435.0, 649.0),
    "DATE": (36.0, 621.0, 176.0, 649.0), "SUB_TOTAL": (323.0, 284.0, 474.0, 296.0), "GST(5%)": (322.0, 244.0, 416.0, 256.0),
    "GST(12%)": (322.0, 205.0, 422.0, 217.0), "TAX": (322.0, 205.0, 422.0, 217.0), "DISCOUNT": (322.0, 168.0, 429.0, 180.0),
    "TOTAL": (324.0, 47.0, 440.0, 59.0), "AMOUNT_DUE": (324.0, 47.0, 440.0, 59.0),
}


def _money(c: str) -> str:
    return f"concat({c} div 100, '.', lpad({c} % 100, 2, '0'))"


_CUR = "element_at(array('USD', '$', 'EUR'), cast(doc_id % 3 as int) + 1)"
_DATE = "date_format({}, 'dd-MMM-yyyy')"
_TEXTS = {
    "TOTAL": f"if(doc_id % 10 <> 9, concat('TOTAL : ', {_money('total')}, ' ', {_CUR}), null)",
    "AMOUNT_DUE": f"if(doc_id % 10 = 9, concat('AMOUNT DUE 1 of 1: ', {_money('total')}, {_CUR}, ' '), null)",
    "SUB_TOTAL": f"concat('SUB_TOTAL : ', {_money('subtotal')}, '  ', if(doc_id % 41 = 7, if(doc_id % 3 = 2, 'USD', 'EUR'), {_CUR}))",
    "DISCOUNT": f"if(doc_id % 37 = 2, 'DISCOUNT : none', concat('DISCOUNT(5.00%): (-) ', {_money('discount')}))",
    "GST(5%)": f"if(doc_id % 2 = 0, concat('GST(5%) : ', {_money('tax div 3')}), null)",
    "GST(12%)": f"if(doc_id % 2 = 0, concat('GST(12%) : ', {_money('(tax - tax div 3)')}), null)",
    "TAX": f"if(doc_id % 2 = 1, concat('TAX:VAT (5.28%): ', {_money('tax')}), null)",
    "DATE": f"concat(if(doc_id % 43 = 5, ' due date : ', 'Invoice Date: '), {_DATE.format('invoice_date')})",
    "DUE_DATE": f"if(doc_id % 47 = 3, 'Due Date : soon', concat('Due Date : ', {_DATE.format('due_date')}))",
    "NUMBER": "concat('INVOICE ID  ', invoice_number, ' ')",
    "SELLER_NAME": "concat('  ', vendor_name, ' ')",
    "SELLER_ADDRESS": "if(doc_id % 53 = 11, 'Address:12 Main St', concat('Address:', doc_id % 90, ' Main St\\nApt 4\\nSpring Field, TN ', lpad(doc_id % 99999, 5, '0'), ' US\\nEmail:x'))",
    "BILL_TO": "if(doc_id % 2 = 0, concat('Bill to:', customer_name, '\\n99 Oak Rd\\nLake City SC 20257 US\\nTel:+1'), null)",
    "BUYER": "if(doc_id % 2 = 1, concat('Buyer :', customer_name, '\\n7 Elm Rd\\nHubbardstad, WV 60201 US'), null)",
}


_ODD = """concat(
    if(doc_id % 59 = 4 and invoice_number is not null, '"NUMBER":{"text":"INVOICE ID OLD","bbox":[[1,2],[3,4]]},', ''),
    if(doc_id % 59 = 4 and invoice_date is not null, '"DATE":{"text":"soon"},', ''), if(doc_id % 59 = 4, '"TOTAL":[],"OTHER":{"text":"old page"},', ''),
    if(doc_id % 59 = 4, concat('"OTHER":', to_json(struct(concat('Page ', doc_id, '  \\r\\n', customer_name, ' \\n\\n') as text)), ','), ''),
    if(doc_id % 61 = 6, '"STAMP":{"text":"PAID","bbox":[[5.0,900.0]]},"MARK":{"text":"COPY"},"SEAL":{"text":"X","bbox":[[1.0],[2.0]]},', ''),
    if(doc_id % 67 = 8 and doc_id % 2 = 1 and tax is not null, '"TAX":{"text":"none"},', ''))"""


def annotations(spark, d):
    """(name, raw, doc_id, ...): one annotation document per invoice, with tables, boxes without text, and OCR text.

    Some name a key twice, of which the last counts, or hold a span whose box has one corner or none, which has no place.
    """
    golden = t.golden(spark, d)
    spans = F.create_map(*[x for key, text in _TEXTS.items() for x in (F.lit(key), F.when(F.expr(text).isNotNull(), F.struct(
        F.expr(text).alias("text"), F.array(F.array(*map(F.lit, _BOXES[key][:2])), F.array(*map(F.lit, _BOXES[key][2:]))).alias("bbox"))))])
    body = F.to_json(F.map_filter(spans, lambda k, v: v.isNotNull()))
    ocr = F.to_json(F.struct(F.expr("concat('Page ', doc_id, '  \\r\\n', customer_name, ' \\n\\n')").alias("text")))
    fixed = F.lit('{"TABLE":[[{"bbox":[[27.0,459.9],[527.0,387.9]]}]],"INVOICE_INFO":[],"LOGO":{"bbox":[[20,841],[110,751]]},"OTHER":')
    return golden.select(
        F.expr("concat('Template', 1 + doc_id % 50, '_Instance', doc_id)").alias("name"), "doc_id",
        F.concat(fixed, ocr, F.lit(","), F.expr(_ODD), F.substr(body, F.lit(2))).alias("raw"))


_M = "({c} // 100) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0')"
_ANN = {
    "ann": f"""SELECT *, (['USD', '$', 'EUR'])[doc_id % 3 + 1] AS cur, CASE WHEN doc_id % 3 = 2 THEN 'EUR' ELSE 'USD' END AS iso,
        'DISCOUNT(5.00%): (-) ' || {_M.format(c='discount')} AS discount_text, strftime(invoice_date, '%d-%b-%Y') AS date_text FROM golden""",
    "reasons": """SELECT *, CASE
        WHEN doc_id % 43 = 5 THEN 'DATE carries a due-date label: '' due date : ' || date_text || '''.'
        WHEN doc_id % 41 = 7 THEN CASE WHEN iso = 'EUR' THEN 'Several currencies printed: EUR, USD.' ELSE 'Several currencies printed: USD, EUR.' END
        WHEN doc_id % 53 = 11 THEN 'SELLER_ADDRESS: street and city not found in ''Address:12 Main St''.'
        WHEN doc_id % 47 = 3 THEN 'DUE_DATE: no readable date in ''Due Date : soon''.'
        WHEN doc_id % 37 = 2 THEN 'DISCOUNT: no number in ''DISCOUNT : none''.' END AS reject_reason0 FROM ann""",
    # The first amount key present decides the order in which currencies are listed.
    "converted": """SELECT *, CASE WHEN doc_id % 43 <> 5 AND doc_id % 41 = 7 AND doc_id % 10 = 9 THEN
          CASE WHEN iso = 'EUR' THEN 'Several currencies printed: USD, EUR.' ELSE 'Several currencies printed: EUR, USD.' END ELSE reject_reason0 END AS reject_reason
        FROM reasons""",
}


def _ok(c: str) -> str:
    return f"CASE WHEN reject_reason IS NULL THEN {c} END"


@check("convert_annotations", sql(f"""
    SELECT doc_id, reject_reason, {_ok('trim(vendor_name)')} AS vendor,
           {_ok("(doc_id % 90) || ' Main St, Apt 4|Spring Field|TN|' || lpad(CAST(doc_id % 99999 AS VARCHAR), 5, '0') || '|US'")} AS vendor_address,
           {_ok('customer_name')} AS customer,
           {_ok("CASE WHEN doc_id % 2 = 0 THEN '99 Oak Rd|Lake City|SC|20257|US' ELSE '7 Elm Rd|Hubbardstad|WV|60201|US' END")} AS customer_address,
           {_ok('invoice_number')} AS invoice_number, {_ok('CAST(invoice_date AS VARCHAR)')} AS invoice_date, {_ok('CAST(due_date AS VARCHAR)')} AS due_date,
           {_ok('iso')} AS currency, {_ok('subtotal')} AS subtotal, {_ok('discount')} AS discount, {_ok('tax')} AS tax, {_ok('total')} AS total
    FROM converted""", "golden", extra=_ANN))
def convert_annotations(spark, d):
    i = F.col("invoice")
    address = lambda p: F.concat_ws("|", *[i[p]["address"][f] for f in ("street", "city", "region", "postalCode", "country")])
    cents = lambda f: (i[f] * 100).cast("long").alias(f)
    return V.convert_annotations(annotations(spark, d)).select(
        "doc_id", "reject_reason", i["vendor"]["name"].alias("vendor"), F.when(i.isNotNull(), address("vendor")).alias("vendor_address"),
        i["customer"]["name"].alias("customer"), F.when(i.isNotNull(), address("customer")).alias("customer_address"),
        i["invoiceNumber"].alias("invoice_number"), i["invoiceDate"].cast("string").alias("invoice_date"),
        i["dueDate"].cast("string").alias("due_date"), i["currency"].alias("currency"), *[cents(f) for f in ("subtotal", "discount", "tax", "total")])


@check("ingest_annotations", sql("""
    SELECT 'Template' || (1 + doc_id % 50) AS layout, CASE WHEN reject_reason IS NULL THEN 'good' ELSE 'rejected' END AS state,
           count(*) AS n, count(DISTINCT reject_reason) AS reasons FROM converted GROUP BY ALL""", "golden", extra=_ANN))
def ingest_annotations(spark, d):
    good, bad = V.ingest_annotations(annotations(spark, d).select("name", "raw"))
    rows = good.select("layout", F.lit("good").alias("state"), F.lit(None).cast("string").alias("reason")).unionAll(
        bad.select("layout", F.lit("rejected"), "reject_reason"))
    return rows.groupBy("layout", "state").agg(F.count("*").alias("n"), F.countDistinct("reason").alias("reasons"))


@check("tax_rollup", sql("SELECT doc_id, tax FROM golden", "golden"))
def tax_rollup(spark, d):
    return V.tax_rollup(annotations(spark, d)).select("doc_id", (F.col("tax") * 100).cast("long").alias("tax"))


@check("currency_conflict", sql("""
    SELECT doc_id, CASE WHEN doc_id % 41 = 7 THEN 2 ELSE 1 END AS n, doc_id % 41 = 7 AS conflict FROM ann""", "golden", extra=_ANN))
def currency_conflict(spark, d):
    return V.currency_conflict(annotations(spark, d)).select("doc_id", F.size("currencies").alias("n"), "conflict")


_ORDERED = ["CASE WHEN doc_id % 2 = 0 THEN 'Bill to:' || customer_name || chr(10) || '99 Oak Rd' || chr(10) || 'Lake City SC 20257 US' || chr(10) || 'Tel:+1' ELSE 'Buyer :' || customer_name || chr(10) || '7 Elm Rd' || chr(10) || 'Hubbardstad, WV 60201 US' END",
            "vendor_name",
            "CASE WHEN doc_id % 53 = 11 THEN 'Address:12 Main St' ELSE 'Address:' || (doc_id % 90) || ' Main St' || chr(10) || 'Apt 4' || chr(10) || 'Spring Field, TN ' || lpad(CAST(doc_id % 99999 AS VARCHAR), 5, '0') || ' US' || chr(10) || 'Email:x' END",
            "'INVOICE ID  ' || invoice_number",
            "CASE WHEN doc_id % 43 = 5 THEN 'due date : ' ELSE 'Invoice Date: ' END || date_text",
            "CASE WHEN doc_id % 47 = 3 THEN 'Due Date : soon' ELSE 'Due Date : ' || strftime(due_date, '%d-%b-%Y') END",
            f"'SUB_TOTAL : ' || {_M.format(c='subtotal')} || '  ' || CASE WHEN doc_id % 41 = 7 THEN CASE WHEN doc_id % 3 = 2 THEN 'USD' ELSE 'EUR' END ELSE cur END",
            f"CASE WHEN doc_id % 2 = 0 THEN 'GST(5%) : ' || {_M.format(c='(tax // 3)')} END",
            f"CASE WHEN doc_id % 2 = 0 THEN 'GST(12%) : ' || {_M.format(c='(tax - tax // 3)')} ELSE 'TAX:VAT (5.28%): ' || {_M.format(c='tax')} END",
            "CASE WHEN doc_id % 37 = 2 THEN 'DISCOUNT : none' ELSE discount_text END",
            f"CASE WHEN doc_id % 10 = 9 THEN 'AMOUNT DUE 1 of 1: ' || {_M.format(c='total')} || cur ELSE 'TOTAL : ' || {_M.format(c='total')} || ' ' || cur END"]


@check("reading_order", sql(f"""
    SELECT doc_id, array_to_string(list_filter([{', '.join(_ORDERED)}], lambda x: x IS NOT NULL), chr(10)) || chr(10) AS text FROM ann""",
    "golden", extra=_ANN))
def reading_order(spark, d):
    return V.with_spans(annotations(spark, d)).select("doc_id", V.reading_order(F.col("spans")).alias("text"))


@check("ocr_text", sql("SELECT doc_id, 'Page ' || doc_id || chr(10) || customer_name || chr(10) AS text FROM golden", "golden"))
def ocr_text(spark, d):
    return V.with_spans(annotations(spark, d)).select("doc_id", V.ocr_text(F.col("spans")).alias("text"))


# ---------- sampling ----------

@check("stratified_sample", """
    SELECT doc_id, source FROM (
      SELECT d.doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY sha256('42:' || doc_id)) AS rn, s.place, s.n
      FROM documents d JOIN (SELECT source, row_number() OVER (ORDER BY sha256('42:' || source)) AS place, count(*) OVER () AS n
                             FROM (SELECT DISTINCT source FROM documents)) s USING (source))
    WHERE rn <= 150 // n + CASE WHEN place <= 150 % n THEN 1 ELSE 0 END""")
def stratified_sample_(spark, d):
    return stratified_sample(t.table(spark, d, "documents").select("doc_id", "source"), "doc_id", "source", 150, 42)


@check("stratified_sample_skewed", """
    SELECT l_orderkey, stratum, key FROM (
      SELECT l_orderkey, l.stratum, key, row_number() OVER (PARTITION BY l.stratum ORDER BY sha256('7:' || key), key) AS rn, place, n
      FROM (SELECT DISTINCT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE strftime(l_shipdate, '%Y-%m') END AS stratum,
                   l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS key FROM lineitem) l
      JOIN (SELECT stratum, row_number() OVER (ORDER BY sha256('7:' || stratum)) AS place, count(*) OVER () AS n
            FROM (SELECT DISTINCT CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE strftime(l_shipdate, '%Y-%m') END AS stratum FROM lineitem)) USING (stratum))
    WHERE rn <= 20000 // n + CASE WHEN place <= 20000 % n THEN 1 ELSE 0 END""")
def stratified_sample_skewed(spark, d):
    """A third of all lines in one stratum."""
    rows = t.table(spark, d, "lineitem").select(
        "l_orderkey", F.expr("if(l_orderkey % 3 = 0, 'hot', substring(cast(to_date(l_shipdate) as string), 1, 7))").alias("stratum"),
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key")).distinct()
    return stratified_sample(rows, "key", "stratum", 20000, 7)


@check("holdout_strata", """
    SELECT doc_id, source, source IN (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY sha256('42:holdout:' || source) LIMIT 5) AS held
    FROM documents""")
def holdout_strata_(spark, d):
    held, rest = holdout_strata(t.table(spark, d, "documents").select("doc_id", "source"), "source", 5, 42)
    return held.withColumn("held", F.lit(True)).unionAll(rest.withColumn("held", F.lit(False)))


# ---------- invoice tables ----------

@check("invoice_rollup", """
    WITH l AS (SELECT l_orderkey AS k, CASE WHEN l_orderkey % 4 = 0 THEN 100 ELSE 1 END AS u,
                      CAST(round(l_quantity) AS BIGINT) * CAST(round(p_retailprice * 100) AS BIGINT) AS x
               FROM lineitem JOIN part ON p_partkey = l_partkey),
    s AS (SELECT k, u, count(*) AS n_lines, CAST(sum((x + u // 2) // u) AS BIGINT) AS sub FROM l GROUP BY k, u),
    b AS (SELECT *, CASE WHEN k % 5 = 0 THEN NULL ELSE (sub * (2 + k % 14) + 50) // 100 END AS disc FROM s),
    t AS (SELECT *, sub - coalesce(disc, 0) AS base FROM b),
    x AS (SELECT *, CASE WHEN k % 6 = 1 THEN NULL ELSE (base * 50 + 500) // 1000 + CASE WHEN k % 2 = 0 THEN (base * 15 + 500) // 1000 ELSE 0 END END AS tx FROM t)
    SELECT k AS invoice_id, n_lines, sub * u AS subtotal, disc * u AS discount, tx * u AS tax, (base + coalesce(tx, 0)) * u AS total FROM x""")
def invoice_rollup(spark, d):
    item, part = t.table(spark, d, "lineitem"), t.table(spark, d, "part")
    lines = item.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("invoice_id"), F.col("l_quantity").cast("decimal(12,0)").alias("quantity"),
        F.round("p_retailprice", 2).cast("decimal(12,2)").alias("unit_price"))
    ids = lines.select("invoice_id").distinct()
    discounts = ids.where("invoice_id % 5 <> 0").withColumn("pct", F.expr("cast(2 + invoice_id % 14 as decimal(4,1))"))
    rates = ids.where("invoice_id % 6 <> 1").withColumn("rate", F.explode(F.expr(
        "if(invoice_id % 2 = 0, array(5.0BD, 1.5BD), array(5.0BD))")))
    currencies = ids.withColumn("decimals", F.expr("if(invoice_id % 4 = 0, 0, 2)"))
    rolled = Y.invoice_rollup(lines, discounts, rates, currencies)
    return rolled.select("invoice_id", "n_lines", *[(F.col(c) * 100).cast("long").alias(c) for c in ("subtotal", "discount", "tax", "total")])


@check("corpus_profile", sql("""
    SELECT count(*) AS invoices, count(*) FILTER (subtotal IS NOT NULL AND total IS NOT NULL) AS checkable,
           count(*) FILTER (abs(total - (subtotal - coalesce(discount, 0) + coalesce(tax, 0))) <= 1) AS reconcile,
           count(*) FILTER (due_date IS NOT NULL AND invoice_date IS NOT NULL) AS both_dates,
           count(*) FILTER (due_date < invoice_date) AS due_before_invoice, count(DISTINCT vendor_name) AS distinct_vendors FROM golden""", "golden"))
def corpus_profile(spark, d):
    return Y.corpus_profile(t.golden(spark, d), CENT)
