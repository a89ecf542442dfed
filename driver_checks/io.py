"""Sources and sinks: written to the shared folder, read back, compared with the tables they came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_checks import check
from driver_checks import tables as t
from driver_checks.ctes import sql
from driver_checks.reports import _GATE, _SUMMARY_ROWS, _THRESHOLDS, thresholds
from tallymark.operators import gate as G
from tallymark.operators.calibrate import dedupe_mismatches
from tallymark.operators.judge import real_mismatches
from tallymark.operators.scoring import with_field_outcomes
from tallymark.plans import evaluation as E
from tallymark.schemas import AGENT_METRICS, AMOUNT, FIELDS, GOLDEN, JUDGED_FIELDS, PAIR, RUN_CONFIG, STORED_RESULT
from tallymark.session import scratch_path
from tallymark.sources import readers as R
from tallymark.sources import writers as W

CENT = 1


def golden_documents(spark, d):
    """Invoices as golden documents with decimal amounts."""
    g = t.golden(spark, d)
    money = lambda c: (c / 100).cast("decimal(18,2)").cast(AMOUNT)
    address = GOLDEN["expected"].dataType["vendor"].dataType["address"].dataType.simpleString()
    party = lambda c: F.struct(F.col(c).alias("name"), F.lit(None).cast(address).alias("address"))
    lines = F.transform("line_items", lambda x: F.struct(
        x["description"].alias("description"), F.lit(None).cast(AMOUNT).alias("quantity"),
        F.lit(None).cast(AMOUNT).alias("unitPrice"), money(x["amount"]).alias("amount")))
    return g.select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("id"), "source", "layout",
        F.concat(F.lit("golden/"), F.col("doc_id"), F.lit(".jpg")).alias("documentPath"),
        F.concat(F.lit("golden/"), F.col("doc_id"), F.lit(".txt")).alias("textPath"), F.col("ocr_path").alias("ocrTextPath"),
        F.struct(
            party("vendor_name").alias("vendor"), party("customer_name").alias("customer"), F.col("invoice_number").alias("invoiceNumber"),
            F.col("invoice_date").alias("invoiceDate"), F.col("due_date").alias("dueDate"), "currency",
            *[money(F.col(c)).alias(c) for c in ("subtotal", "discount", "tax", "total")], lines.alias("lineItems")).alias("expected"))


_GOLDEN_SQL = sql("""
    SELECT source || '/' || doc_id AS id, source, layout, ocr_path, vendor_name, customer_name, invoice_number,
           CAST(due_date AS VARCHAR) AS due_date, currency, discount, total,
           CASE WHEN line_items IS NULL THEN -1 ELSE CAST(len(line_items) AS INTEGER) END AS n_lines,
           array_to_string(list_transform(line_items, lambda x: x.description || '=' || x.amount), ';') AS line_text FROM golden""", "golden")


def _golden_columns(df):
    e = F.col("expected")
    cents = lambda c: (c * 100).cast("long")
    return df.select(
        "id", "source", "layout", F.col("ocrTextPath").alias("ocr_path"), e["vendor"]["name"].alias("vendor_name"),
        e["customer"]["name"].alias("customer_name"), e["invoiceNumber"].alias("invoice_number"), e["dueDate"].cast("string").alias("due_date"),
        e["currency"].alias("currency"), cents(e["discount"]).alias("discount"), cents(e["total"]).alias("total"),
        F.coalesce(F.size(e["lineItems"]), F.lit(-1)).alias("n_lines"),
        F.array_join(F.transform(e["lineItems"], lambda x: F.concat(
            x["description"], F.lit("="), cents(x["amount"]).cast("string"))), ";").alias("line_text"))


def _written_golden(spark, d):
    path = scratch_path(spark, "golden")
    W.write_golden(golden_documents(spark, d), path)
    return path


@check("read_golden", _GOLDEN_SQL)
def read_golden(spark, d):
    return _golden_columns(R.read_golden(spark, _written_golden(spark, d)))


@check("write_golden", sql("""
    SELECT count(*) AS n, count(*) AS with_explicit_nulls, min(source || '/' || doc_id) AS first_id, max(source || '/' || doc_id) AS last_id FROM golden""", "golden"))
def write_golden(spark, d):
    """The written text: every key is present, nulls included."""
    lines = spark.read.text(_written_golden(spark, d))
    keys = [F.contains("value", F.lit(f'"{k}":')) for k in ("ocrTextPath", "dueDate", "discount", "lineItems", "address")]
    whole = keys[0] & keys[1] & keys[2] & keys[3] & keys[4]
    first = F.get_json_object("value", "$.id")
    return lines.agg(F.count("*").alias("n"), F.count_if(whole).alias("with_explicit_nulls"), F.min(first).alias("first_id"), F.max(first).alias("last_id"))


def _layers(spark, d):
    """Every page's HTML as a file of its own, read back whole: (path, text). Files lie in 256 folders, by their keys."""
    path = scratch_path(spark, "layers")
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    file = F.concat(F.pmod(F.xxhash64("page_id"), F.lit(256)).cast("string"), F.lit("/"), key, F.lit(".txt"))
    W.write_text_layers(t.table(spark, d, "pages").select(file.alias("path"), F.col("html").alias("text")), path)
    layers = R.read_text_layers(spark, path)
    return layers.select(
        F.regexp_replace("path", r"^\d+/(.*)$", "pages/$1").alias("path"), F.regexp_replace("text", r"\n\z", "").alias("text"))


@check("read_text_layers", "SELECT 'pages/' || page_id || '.txt' AS path, html AS text FROM pages")
def read_text_layers(spark, d):
    return _layers(spark, d)


@check("eval_set", """
    SELECT 'doc-' || a.page_id AS id, CASE WHEN a.page_id % 5 = 0 THEN 'synthetic' ELSE 'fatura' END AS source,
           CASE WHEN a.page_id % 5 <> 0 AND a.page_id % 3 = 0 THEN b.html ELSE a.html END AS text, a.html AS text_layer
    FROM pages a LEFT JOIN pages b ON b.page_id = a.page_id // 2""")
def eval_set(spark, d):
    """OCR mode: a third of the documents have an OCR layer, the rest fall back to their text."""
    docs = t.table(spark, d, "pages").select(
        F.concat(F.lit("doc-"), "page_id").alias("id"), F.expr("if(page_id % 5 = 0, 'synthetic', 'fatura')").alias("source"),
        F.concat(F.lit("pages/"), "page_id", F.lit(".txt")).alias("textPath"),
        F.expr("if(page_id % 5 <> 0 and page_id % 3 = 0, concat('pages/', page_id div 2, '.txt'), null)").alias("ocrTextPath"))
    sets = R.eval_set(docs.where("source = 'fatura'"), docs.where("source = 'synthetic'"), _layers(spark, d), "ocr")
    return sets.select("id", "source", "text", "text_layer")


@check("read_dims", """
    SELECT n_name AS model, n_regionkey + 0.5e0 AS input_per_mtok, count(c_custkey) AS customers,
           round(sum(c_acctbal), 2) AS balance FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 5 <> 0 GROUP BY ALL""")
def read_dims(spark, d):
    """A price file with one model per nation, comments dropped, applied to every customer."""
    nation = t.table(spark, d, "nation")
    entry = F.struct(F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("_"), "n_name")).otherwise(F.col("n_name")).alias("key"),
                     F.struct((F.col("n_regionkey") + F.lit(0.5)).alias("inputPerMTok"), F.lit(5).alias("outputPerMTok")).alias("value"))
    path = scratch_path(spark, "prices")
    nation.agg(F.map_from_entries(F.collect_list(entry)).alias("m")).select(F.to_json("m").alias("value")).write.text(path)
    prices = R.read_prices(spark, path).withColumn("input_per_mtok", F.col("input_per_mtok").cast("double"))
    configs_path = scratch_path(spark, "configs")
    config = F.struct(*[F.col("n_name").alias(f) if f in ("name", "model") else F.lit(None).cast(RUN_CONFIG[f].dataType).alias(f)
                        for f in RUN_CONFIG.fieldNames()])
    nation.agg(F.to_json(F.collect_list(config)).alias("value")).write.text(configs_path)
    configs = R.read_configs(spark, configs_path).select("name", "model")
    customers = t.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_name", "name")
    return customers.join(configs, "name").join(prices, "model").groupBy("model", "input_per_mtok").agg(
        F.count("c_custkey").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@check("flatten_results", sql("""
    SELECT execution, config, model, prompt, input_mode, source || '/' || doc_id AS doc_id, source, layout,
           round(composite, 6) AS composite, outcome_total AS total_outcome,
           CASE WHEN schema_validity = 0 THEN 'invalid | again' ELSE '' END AS errors,
           CASE WHEN doc_id % 3 = 0 THEN latency_ms WHEN doc_id % 3 = 1 THEN 7.0e0 ELSE 0.0e0 END AS latency_ms,
           CASE WHEN doc_id % 4 = 0 THEN 0 ELSE input_tokens END AS input_tokens, cache_hit FROM scores""", "scores"))
def flatten_results(spark, d):
    s = t.judged_scores(spark, d)
    text = lambda v: F.lit(v) if isinstance(v, str) else v
    diagnostic = lambda severity, m: F.struct(F.lit(severity).alias("severity"), text(m).alias("message"))
    errors = F.when(F.col("schema_validity") == 0, F.array(diagnostic("error", "invalid"), diagnostic("warning", "w"), diagnostic("error", "again")))
    metric = lambda name, value, outcome, diag=F.lit(None): F.struct(
        F.lit(name).alias("name"), F.lit(True).alias("numeric"), value.cast("double").alias("value"), outcome.cast("string").alias("outcome"),
        diag.cast("array<struct<severity:string,message:string>>").alias("diagnostics"))
    none = F.lit(None)
    tag = lambda k, c: F.concat(F.lit(f"{k}:"), c)
    nested = s.select(
        "execution", "config", F.concat_ws(".", "source", F.col("doc_id").cast("string")).alias("scenario"),
        F.array(tag("model", "model"), tag("prompt", "prompt"), tag("input", "input_mode"), tag("source", "source"), tag("layout", "layout")).alias("tags"),
        F.array(metric("schema_validity", F.col("schema_validity"), none, errors), metric("composite", F.col("composite"), none),
                metric("field.total", F.lit(1.0), F.col("outcome_total"))).alias("metrics"),
        F.when(F.col("doc_id") % 3 == 0, F.col("latency_ms")).alias("stamped_latency_ms"),
        F.when(F.col("doc_id") % 3 == 1, F.lit(7.0)).alias("turn_latency_ms"), "cache_hit",
        F.when(F.col("doc_id") % 4 != 0, F.col("input_tokens")).alias("input_tokens"), "output_tokens", "thinking_tokens", F.lit("").alias("response_text"))
    path = scratch_path(spark, "results")
    # As text every row repeats all names and tags: compressed, and in files that many tasks can read.
    nested.write.option("compression", "gzip").option("maxRecordsPerFile", 500_000).json(path)
    flat = R.flatten_results(spark.read.schema(STORED_RESULT).json(path))
    return flat.select(
        "execution", "config", "model", "prompt", "input_mode", "doc_id", "source", "layout",
        F.round(F.col("values")["composite"], 6).alias("composite"), F.col("outcomes")["field.total"].alias("total_outcome"),
        "errors", "latency_ms", "input_tokens", "cache_hit")


def _summary_path(spark, d):
    path = scratch_path(spark, "summary")
    W.write_summary(E.report(t.judged_scores(spark, d), t.prices(spark)), path)
    return path


# Every column of a summary: numbers with so many decimals (null is an empty cell), counts and names as they are.
_DECIMAL = {"latency_mean_ms": 0, "latency_p50_ms": 0, "latency_p95_ms": 0, "input_tokens_mean": 1, "output_tokens_mean": 1, "thinking_tokens_mean": 1, "usd_per_1k_docs": 2}
_WHOLE = ["docs", "recomputed_total_n", "line_items_coverage", *[f"{c}_n" for c in AGENT_METRICS]]
_PRINTED = [
    "schema_validity", *[f"{f}_accuracy" for f in FIELDS], *[f"{f}_judged_accuracy" for f in JUDGED_FIELDS], *[f"{f}_false_positive_rate" for f in FIELDS],
    *[f"{f}_miss_rate" for f in FIELDS], "recomputed_total_rate", "line_items_precision", "line_items_recall", "line_items_f1", "composite", *_DECIMAL, *AGENT_METRICS]


@check("write_summary", sql(
    "SELECT execution, config, subset, model, prompt, input_mode, " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _WHOLE) + ", "
    + ", ".join(f"printf('%.{_DECIMAL.get(c, 4)}f', round({c}, {_DECIMAL.get(c, 4)})) AS {c}" for c in _PRINTED)
    # Rounded once, from the whole number: a value rounded to six digits first could be rounded the other way.
    + f" FROM ({_SUMMARY_ROWS.replace(', 6)', ', 15)')})", "judged_scores", "prices"))
def write_summary(spark, d):
    """All columns of the file: it has no others."""
    return spark.read.option("header", True).csv(_summary_path(spark, d))


@check("read_summary_csv", sql("""
    SELECT config, subset, metric, value FROM cells WHERE execution LIKE '%bbb'""", "scores", extra=_GATE))
def read_summary_csv(spark, d):
    return R.read_summary_csv(spark, _summary_path(spark, d), thresholds(spark))


@check("write_documents", sql("""
    SELECT execution, config, doc_id, printf('%.4f', round(composite, 4)) AS composite, outcome_total AS total, CAST(input_tokens AS VARCHAR) AS input_tokens FROM scores""", "scores"))
def write_documents(spark, d):
    path = scratch_path(spark, "documents")
    rows = t.judged_scores(spark, d).select("execution", "config", "doc_id", "composite", *[F.col(f"outcome_{f}").alias(f) for f in FIELDS],
                                            "latency_ms", "input_tokens", F.lit("a\nb").alias("errors"))
    W.write_documents(rows, path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("execution", "config", F.col("doc_id").cast("long").alias("doc_id"), "composite", "total", "input_tokens")


def _baseline_path(spark, d):
    path = scratch_path(spark, "baseline")
    cells = G.summary_cells(E.report(t.judged_scores(spark, d), t.prices(spark)), sorted({m for m, _, _ in _THRESHOLDS}))
    W.write_baseline(cells, thresholds(spark), path)
    return path


@check("write_baseline", sql("""
    SELECT place, config || ',' || subset || ',' || metric || ',' || CASE WHEN value IS NULL THEN '' ELSE printf('%.4f', value) END AS line FROM (
      SELECT *, row_number() OVER (ORDER BY CASE config WHEN 'mini-plain' THEN 0 ELSE 3 END, CASE metric || subset
             WHEN 'compositecombined' THEN 0 WHEN 'total_accuracycombined' THEN 1 WHEN 'line_items_f1synthetic' THEN 2 ELSE 3 END) AS place
      FROM (SELECT config, subset, metric, value FROM cur JOIN thresholds USING (metric, subset)))""", "scores", extra=_GATE))
def write_baseline(spark, d):
    """Lines of the one file, in the order they were written."""
    text = spark.read.text(_baseline_path(spark, d), wholetext=True)
    lines = text.select(F.posexplode(F.split("value", "\n")).alias("place", "line"))
    return lines.where("place > 0 and line <> ''").select(F.col("place").cast("long").alias("place"), "line")


@check("read_baseline_csv", sql("SELECT config, subset, metric, value FROM cur JOIN thresholds USING (metric, subset)", "scores", extra=_GATE))
def read_baseline_csv(spark, d):
    return R.read_baseline_csv(spark, _baseline_path(spark, d))


@check("pairs_io", sql("""
    SELECT 'p-' || substr(sha256(field || chr(10) || golden || chr(10) || predicted), 1, 12) AS id, field, CAST(min(doc_id) AS VARCHAR) AS doc_id, golden, predicted,
           'run:' || string_agg(DISTINCT config, ',' ORDER BY config) AS origin, CASE WHEN min(doc_id) % 2 = 0 THEN min(doc_id) % 4 = 0 END AS human_label
    FROM mismatches GROUP BY field, golden, predicted""", "mismatches"))
def pairs_io(spark, d):
    pairs = dedupe_mismatches(real_mismatches(with_field_outcomes(t.scored(spark, d), CENT)))
    labelled = pairs.withColumns({
        "excerpt": F.lit('two\nlines "quoted"'), "human_label": F.expr("if(doc_id % 2 = 0, doc_id % 4 = 0, null)"), "doc_id": F.col("doc_id").cast("string")})
    path = scratch_path(spark, "pairs")
    W.write_pairs(labelled.select(*PAIR.fieldNames()), path)
    return R.read_pairs(spark, path).drop("excerpt")


@check("write_pools", """
    WITH held AS (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY sha256('42:holdout:' || source) LIMIT 5),
    d AS (SELECT doc_id, source, CASE WHEN source IN (SELECT source FROM held) THEN 'dev' ELSE 'golden' END AS pool FROM documents),
    s AS (SELECT pool, source, row_number() OVER (PARTITION BY pool ORDER BY sha256('42:' || source)) AS place, count(*) OVER (PARTITION BY pool) AS n
          FROM (SELECT DISTINCT pool, source FROM d)),
    r AS (SELECT d.*, place, n, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id)) AS rn FROM d JOIN s USING (pool, source))
    SELECT pool, doc_id, source FROM r WHERE rn <= CASE WHEN pool = 'dev' THEN 20 // n + CASE WHEN place <= 20 % n THEN 1 ELSE 0 END
        ELSE 150 // n + CASE WHEN place <= 150 % n THEN 1 ELSE 0 END END""")
def write_pools(spark, d):
    path = scratch_path(spark, "pools")
    docs = t.table(spark, d, "documents").select("doc_id", "source")
    W.write_pools(docs, path, 150, 5, 20, 42, key="doc_id", stratum="source")
    pools = [spark.read.schema("doc_id long, source string").json(f"{path}/pool={p}").select(F.lit(p).alias("pool"), "doc_id", "source") for p in ("golden", "dev")]
    return pools[0].unionAll(pools[1])
