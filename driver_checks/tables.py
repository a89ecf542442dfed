"""Invoice tables derived from the driver's tables with DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driver_checks import CENT
from tallymark.functions.hashing import pair_id
from tallymark.operators.judge import judged_wide, real_mismatches
from tallymark.operators.scoring import field_outcome
from tallymark.plans.evaluation import score_documents
from tallymark.schemas import JUDGED_FIELDS
from tallymark.session import setting, stored

# (config, execution, model, prompt, input mode, m): the residues of m decide which answers are wrong.
RUNS = (
    ("mini-plain", "20260201T000000Z-bbb", "model-small", "plain@1.0", "text", 11),
    ("strong-plain", "20260201T000000Z-bbb", "model-large", "plain@1.0", "ocr", 13),
    ("mini-plain", "20260101T000000Z-aaa", "model-small", "plain@0.9", "text", 17),
)
PRICES = (("model-small", 1.0, 5.0), ("model-large", 2.0, 10.0))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    item = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey", "l_suppkey",
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount"),
        F.round(F.col("l_discount") * 100).cast("long").alias("pct_d"),
        F.round(F.col("l_tax") * 100).cast("long").alias("pct_t"))
    part = table(spark, d, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", "p_type").alias("description"))
    return item.join(part, "l_partkey")


def golden(spark: SparkSession, d: str, with_lines: bool = True) -> DataFrame:
    """One row per order with lines. An invoice is one record, so its lines are held in one array.

    Sums of all documents are a hash aggregation without descriptions; only the documents that print their lines have
    them collected, and without ``with_lines`` none has (no column but ``line_items`` needs them). What is joined by
    another key comes first, so arrays are never shuffled again and rows end up dealt by document.
    """
    totals = lines(spark, d).groupBy("doc_id").agg(
        F.sum("amount").alias("subtotal"),
        F.sum(F.expr("(amount * pct_d + 50) div 100")).alias("all_discount"),
        F.sum(F.expr("(amount * pct_t + 50) div 100")).alias("all_tax"),
        F.min("l_suppkey").alias("suppkey"))
    printed = lines(spark, d).where("doc_id % 6 = 0").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "amount", "description"))).alias("l"))
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("layout"),
        F.to_date("o_orderdate").alias("invoice_date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("printed"))
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), "c_name")
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("suppkey"), "s_name")
    rows = orders.join(customer, "custkey").join(totals.join(supplier, "suppkey"), "doc_id")
    if with_lines:
        rows = rows.join(printed, "doc_id", "left")
    else:
        rows = rows.withColumn("l", F.lit(None).cast(printed.schema["l"].dataType))
    rows = rows.withColumns({
        "source": F.expr("if(doc_id % 6 = 0, 'synthetic', 'fatura')"),
        "discount": F.expr("if(doc_id % 5 = 0, null, all_discount)"),
        "tax": F.expr("if(doc_id % 7 = 0, null, all_tax)"),
    })
    rows = rows.withColumns({
        "total": F.expr("if(source = 'fatura', printed, subtotal - coalesce(discount, 0) + coalesce(tax, 0))"),
        "invoice_number": F.expr("if(doc_id % 11 = 4, null, concat('INV-', doc_id))"),
        "due_date": F.expr("if(doc_id % 9 = 2, null, date_add(invoice_date, cast(doc_id % 61 - 10 as int)))"),
        "currency": F.expr("case when doc_id % 13 = 5 then null when doc_id % 3 = 0 then 'USD' when doc_id % 3 = 1 then 'EUR' else 'GBP' end"),
        "customer_name": F.expr("concat(c_name, element_at(array(' Inc.', ' GmbH & Co. KG', ' Intl.', ''), cast(doc_id % 4 as int) + 1))"),
        "vendor_name": F.expr("if(doc_id % 17 = 6, null, concat(s_name, element_at(array(' Ltd', ', S.A.', ''), cast(doc_id % 3 as int) + 1)))"),
        "line_items": F.when(F.col("source") == "synthetic", F.transform(
            "l", lambda x: F.struct(x["description"].alias("description"), x["amount"].alias("amount")))),
        "ocr_path": F.expr("if(source = 'fatura', concat('golden/', doc_id, '.ocr.txt'), null)"),
    })
    return rows.select(
        "doc_id", "source", "layout", "ocr_path", "c_name", "invoice_number", "invoice_date", "due_date", "currency",
        "subtotal", "discount", "tax", "total", "vendor_name", "customer_name", "line_items")


def invoice(prefix: str = ""):
    """Invoice struct of the flat columns named with ``prefix``."""
    c = lambda name: F.col(prefix + name)
    return F.struct(
        F.struct(c("vendor_name").alias("name")).alias("vendor"), F.struct(c("customer_name").alias("name")).alias("customer"),
        c("invoice_number").alias("invoiceNumber"), c("invoice_date").alias("invoiceDate"), c("due_date").alias("dueDate"),
        c("currency").alias("currency"), c("subtotal").alias("subtotal"), c("discount").alias("discount"),
        c("tax").alias("tax"), c("total").alias("total"), c("line_items").alias("lineItems"))


def flat_answers(spark: SparkSession, d: str, with_lines: bool = True) -> DataFrame:
    """Golden columns, run columns and the answer's ``p_`` columns: three runs per document."""
    runs = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(
        run, ("config", "execution", "model", "prompt", "input_mode", "m"))]) for run in RUNS])
    rows = golden(spark, d, with_lines).withColumn("run", F.explode(runs)).select("*", "run.*").drop("run")
    rows = rows.withColumns({"r": F.expr("doc_id % m"), "parsed": F.expr("doc_id % (m + 20) <> 3")})
    li = F.col("line_items")
    changed = {
        2: F.slice(li, F.lit(2), F.greatest(F.size(li) - 1, F.lit(0))),
        4: F.transform(li, lambda x: F.struct(x["description"].alias("description"), (x["amount"] + 1).alias("amount"))),
        5: F.transform(li, lambda x: F.struct(x["description"].alias("description"), (x["amount"] + 2).alias("amount"))),
        6: F.transform(li, lambda x: F.struct(F.lit("misc item").alias("description"), x["amount"].alias("amount"))),
        8: F.reverse(li),
        9: F.transform(li, lambda x, i: F.struct(
            F.when(i > 0, x["description"]).alias("description"), x["amount"].alias("amount"))),
    }
    p_lines = F.when(F.lit(False), li)
    for r, value in changed.items():
        p_lines = p_lines.when(F.col("r") == r, value)
    return rows.withColumns({
        "p_invoice_number": F.expr("case when r = 10 then lower(invoice_number) when r = 4 then coalesce(invoice_number, 'X-1') else invoice_number end"),
        "p_invoice_date": F.expr("if(r = 5, date_add(invoice_date, 1), invoice_date)"),
        "p_due_date": F.expr("case when r = 7 then null when r = 8 then coalesce(due_date, invoice_date) else due_date end"),
        "p_currency": F.expr("case when r = 3 then lower(currency) when r = 9 then 'USD' else currency end"),
        "p_subtotal": F.expr("case r when 1 then subtotal + 1 when 2 then subtotal + 2 when 3 then null else subtotal end"),
        "p_discount": F.expr("case r when 4 then coalesce(discount, subtotal div 10) when 5 then null else discount end"),
        "p_tax": F.expr("if(r = 8, coalesce(tax, 0) + 5, tax)"),
        "p_total": F.expr("case r when 6 then subtotal - coalesce(discount, 0) + coalesce(tax, 0) when 7 then total + 2 else total end"),
        "p_vendor_name": F.expr("case r when 9 then concat('Acme ', vendor_name) when 10 then null else vendor_name end"),
        "p_customer_name": F.expr("case r when 8 then upper(c_name) when 9 then concat(customer_name, ' Logistics') else customer_name end"),
        "p_line_items": p_lines.otherwise(li),
        "latency_ms": F.expr("cast(100 + (doc_id * 37 + m * 101) % 5000 as double)"),
        "input_tokens": F.expr("500 + (doc_id * 7) % 1000 + m"),
        "output_tokens": F.expr("100 + doc_id % 300"),
        "thinking_tokens": F.expr("doc_id % 50"),
        "cache_hit": F.expr("doc_id % 2 = 0"),
    })


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Answers with ``expected`` and ``predicted`` structs, as the scorers take them."""
    return flat_answers(spark, d).select(
        "execution", "config", "model", "prompt", "input_mode", "doc_id", "source", "layout", "ocr_path", "m", "r",
        invoice().alias("expected"), F.when(F.col("parsed"), invoice("p_")).alias("predicted"),
        F.expr("if(parsed, null, 'not JSON')").alias("parse_error"),
        "latency_ms", "input_tokens", "output_tokens", "thinking_tokens", "cache_hit")


def doc_scores(spark: SparkSession, d: str) -> DataFrame:
    return score_documents(scored(spark, d), CENT)


def verdicts(mismatches: DataFrame) -> DataFrame:
    """A judge response per distinct mismatch, by the lowest document that has it; every fifth has none."""
    keyed = mismatches.groupBy("field", "golden", "predicted").agg((F.min("doc_id") % 5).alias("v"))
    return keyed.where("v < 4").select(
        pair_id(F.col("field"), F.col("golden"), F.col("predicted")).alias("pair_id"),
        F.expr("""element_at(array('{"reason":"same party","equivalent":true}',
            'I think: {"equivalent":"false","reason":"another company"} as asked', 'no idea',
            '{"Equivalent":true}'), cast(v as int) + 1)""").alias("response_text"))


def name_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """The strict name mismatches of :func:`scored`, from the names alone: nothing else of an answer is built or compared."""
    names = lambda p: F.struct(*[F.struct(F.col(f"{p}{side}_name").alias("name")).alias(side) for side in ("vendor", "customer")])
    rows = flat_answers(spark, d, with_lines=False).select(
        "execution", "config", "doc_id", "input_mode", "ocr_path", names("").alias("expected"), F.when(F.col("parsed"), names("p_")).alias("predicted"))
    return real_mismatches(rows.withColumns({f"outcome_{f}": field_outcome(f, CENT) for f in JUDGED_FIELDS}))


_STORED: dict[tuple[str, str], DataFrame] = {}


def judged_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of every run as a written table, the way a report reads them: scored once per session and input folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED:
        # Mismatches are few, and found from the names; the scores are then worked out once, where their documents lie.
        mismatches = stored(name_mismatches(spark, d), "name-mismatches")
        scores = judged_wide(
            doc_scores(spark, d).drop("violations"), verdicts(mismatches), drop=("expected", "predicted"), mismatches=mismatches)
        # All field outcomes in one method are more than the JVM compiles; beyond this limit Spark splits them up.
        with setting(spark, "spark.sql.codegen.hugeMethodLimit", "8000"):
            _STORED[key] = stored(scores, "judged-scores")
    return _STORED[key]


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICES), "model string, input_per_mtok double, output_per_mtok double")
