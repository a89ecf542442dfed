"""Transcripts of tool-using runs, usage, currencies, calibration statistics, replay, export and estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_checks import CENT, check
from driver_checks import tables as t
from driver_checks.ctes import sql
from tallymark.functions.hashing import hash_draw, hash_rank
from tallymark.functions.text import doc_key, scenario_of
from tallymark.operators import agent as A
from tallymark.operators import calibrate as K
from tallymark.operators import exchange as X
from tallymark.operators import judge as J
from tallymark.operators import scoring as S
from tallymark.operators import summary as Y
from tallymark.operators.currency import AMBIGUOUS, ISO_CODES, UNAMBIGUOUS, normalize_currency
from tallymark.schemas import AGENT_METRICS
from tallymark.session import stored


def r6(c):
    return F.round(c, 6)


def text_sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# ---------- transcripts ----------

_MESSAGES = """
    SELECT conv_id, turn, role,
           CASE WHEN role = 'assistant' AND (conv_id + turn) % 3 = 0 THEN '{"invoiceNumber":"C' || conv_id || '","total":' || turn || '}'
                WHEN role = 'assistant' AND conv_id % 7 = 0 THEN '  ' ELSE text END AS text
    FROM conversations"""


def messages(spark, d):
    """Conversations in which a third of the assistant turns hold an answer and some say nothing."""
    said = F.expr("""case when role = 'assistant' and (conv_id + turn) % 3 = 0
                          then concat('{"invoiceNumber":"C', conv_id, '","total":', turn, '}')
                          when role = 'assistant' and conv_id % 7 = 0 then '  ' else text end""")
    return t.table(spark, d, "conversations").withColumn("text", said)


@check("final_answer", f"""
    WITH m AS ({_MESSAGES}),
    a AS (SELECT *, text LIKE '{{"invoiceNumber"%' AS ok FROM m WHERE role = 'assistant' AND trim(text) <> ''),
    b AS (SELECT conv_id, arg_max(text, CASE WHEN ok THEN 1000000 ELSE 0 END + turn) AS best, bool_or(ok) AS ok FROM a GROUP BY conv_id),
    c AS (SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS everything FROM m GROUP BY conv_id)
    SELECT conv_id, CASE WHEN best IS NULL THEN everything ELSE best END AS text, coalesce(ok, false) AS parses
    FROM c LEFT JOIN b USING (conv_id)""")
def final_answer(spark, d):
    return A.final_answer(messages(spark, d), ("conv_id",))


_TURNS = """SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN NULL ELSE 'model-' || (turn % 2) END AS model,
    (conv_id + turn) % 2 = 0 AS has_tool_call, length(text) AS input_tokens, 3 * turn + 1 AS output_tokens,
    conv_id % 5 AS thinking_tokens, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE turn * 100.0e0 END AS latency_ms
    FROM conversations WHERE role = 'assistant'"""


@check("usage_rollup", f"""
    SELECT conv_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
           CAST(sum(thinking_tokens) AS BIGINT) AS thinking_tokens, sum(latency_ms) AS latency_ms, count(*) AS turns,
           count(*) FILTER (has_tool_call) AS tool_rounds, arg_min(model, turn) FILTER (model IS NOT NULL) AS model,
           arg_max(has_tool_call, turn) OR (count(*) FILTER (has_tool_call) >= 2 AND count(*) > count(*) FILTER (has_tool_call)) AS round_limit
    FROM ({_TURNS}) GROUP BY conv_id""")
def usage_rollup(spark, d):
    turns = t.table(spark, d, "conversations").where("role = 'assistant'").select(
        "conv_id", "turn", F.expr("if(turn % 4 = 1, null, concat('model-', turn % 2))").alias("model"),
        F.expr("(conv_id + turn) % 2 = 0").alias("has_tool_call"), F.length("text").cast("long").alias("input_tokens"),
        F.expr("3 * turn + 1").alias("output_tokens"), F.expr("conv_id % 5").alias("thinking_tokens"),
        F.expr("if(conv_id % 4 = 0, null, turn * 100.0d)").alias("latency_ms"))
    return A.usage_rollup(turns, ("conv_id",), max_rounds=2)


def _calls(spark, d):
    """(calls, results) of the agent run: up to three calls per document; every 23rd result cannot be read."""
    golden = t.golden(spark, d)
    calls = golden.select("doc_id", F.explode(F.expr("sequence(0, cast(doc_id % 4 as int))")).alias("j"), "subtotal", "discount", "tax", "total").where("j > 0")
    calls = calls.withColumn("call_id", F.concat_ws("-", F.lit("c"), "j")).withColumn(
        "name", F.expr("if(j % 2 = 1, 'validate_totals', 'normalize_currency')"))
    checked = Y.reconcile_totals(calls.where("name = 'validate_totals'"), CENT)
    results = checked.select("doc_id", "call_id", F.when(F.col("doc_id") % 23 == 0, "oops").otherwise(F.to_json(F.struct(
        "consistent", "difference", F.col("reconciled_total").alias("reconciledTotal"), "reason"))).alias("result"))
    return calls.select("doc_id", F.col("j").alias("turn"), "call_id", "name"), results


_CALLS = {
    "calls": """SELECT doc_id, j AS turn, 'c-' || j AS call_id, CASE WHEN j % 2 = 1 THEN 'validate_totals' ELSE 'normalize_currency' END AS name,
        CASE WHEN j % 2 = 1 AND doc_id % 23 <> 0 THEN abs(total - rebuilt) <= 1 END AS consistent,
        CASE WHEN j % 2 = 1 AND doc_id % 23 <> 0 THEN rebuilt END AS reconciled_total
        FROM (SELECT *, subtotal - coalesce(discount, 0) + coalesce(tax, 0) AS rebuilt, unnest(range(1, doc_id % 4 + 1)) AS j FROM golden)""",
}


@check("tool_results_join", sql("""
    SELECT doc_id, call_id, name, consistent, reconciled_total FROM calls""", "golden", extra=_CALLS))
def tool_results_join(spark, d):
    joined = A.tool_results_join(*_calls(spark, d))
    return joined.select("doc_id", "call_id", "name", "consistent", F.col("reconciled_total").cast("long").alias("reconciled_total"))


def _agent_rows(spark, d):
    rows = t.scored(spark, d).where("config = 'strong-plain'").withColumns({
        "text_layer": F.expr("element_at(array('TOTAL 5 USD', 'TOTAL $5', 'no currency'), cast(doc_id % 3 as int) + 1)"),
        "response_text": F.expr("""case doc_id % 5 when 0 then '{"warnings":["Totals_Inconsistent: by 3",4]}'
                                   when 1 then '{"warnings":["round_limit: 6"]}' when 2 then 'none' else '{"total":1}' end""")})
    return A.agent_behaviour(rows, A.tool_results_join(*_calls(spark, d)), tol=CENT)


_AGENT = dict(_CALLS)
_AGENT |= {
    "used": """SELECT doc_id, count(*) AS n, max(CASE WHEN name = 'validate_totals' THEN 1 ELSE 0 END) AS v,
        max(CASE WHEN name = 'normalize_currency' THEN 1 ELSE 0 END) AS c,
        max(CASE WHEN NOT consistent THEN reconciled_total END) AS rt FROM calls GROUP BY doc_id""",
    "agent": """SELECT doc_id, source, CAST(coalesce(n, 0) AS DOUBLE) AS tool_call_count, CAST(coalesce(v, 0) AS DOUBLE) AS validate_totals_called,
        CASE WHEN doc_id % 3 = 1 THEN CAST(coalesce(c, 0) AS DOUBLE) END AS normalize_currency_called_symbol,
        CASE WHEN doc_id % 3 = 0 THEN CAST(coalesce(c, 0) AS DOUBLE) END AS normalize_currency_called_code,
        CASE WHEN parsed AND total IS NOT NULL AND rt IS NOT NULL
             THEN CASE WHEN abs(p_total - total) > 1 AND abs(p_total - rt) <= 1 THEN 1.0e0 ELSE 0.0e0 END END AS tool_override,
        CASE WHEN doc_id % 5 = 0 THEN CASE WHEN abs(total - (subtotal - coalesce(discount, 0) + coalesce(tax, 0))) > 1 THEN 1.0e0 ELSE 0.0e0 END
        END AS totals_warning_correct
        FROM answers LEFT JOIN used USING (doc_id) WHERE config = 'strong-plain'""",
}
_SIX = list(AGENT_METRICS.values())[:6]


@check("agent_behaviour", sql(f"SELECT doc_id, {', '.join(_SIX)} FROM agent", "answers", extra=_AGENT))
def agent_behaviour(spark, d):
    return _agent_rows(spark, d)


@check("agent_rates", sql("SELECT doc_id % 6 = 0 AS synthetic, " + ", ".join(
    f"round(avg({m}), 6) AS {c}, count({m}) AS {c}_n" for c, m in AGENT_METRICS.items()) + """
    FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 1.0e0 END AS tool_call_accuracy, CAST(1 + doc_id % 5 AS DOUBLE) AS task_adherence FROM agent)
    GROUP BY 1""", "answers", extra=_AGENT))
def agent_rates(spark, d):
    rows = _agent_rows(spark, d).withColumns({
        "synthetic": F.col("doc_id") % 6 == 0, "tool_call_accuracy": F.expr("if(doc_id % 2 = 0, 1.0d, null)"),
        "task_adherence": F.expr("cast(1 + doc_id % 5 as double)")})
    rates = Y.agent_rates(rows, ["synthetic"])
    return rates.withColumns({c: r6(c) for c in AGENT_METRICS})


# ---------- currencies ----------

_WORDS = [*ISO_CODES, *UNAMBIGUOUS, *AMBIGUOUS, "XYZ", "doubloons", "", "Euros", "swiss  francs"]
_PICK = "list_value(" + ", ".join(text_sql(w) for w in _WORDS) + ")"
_DICT = " UNION ALL ".join(
    [f"SELECT {text_sql(k)} AS k, {text_sql(v)} AS c, NULL AS r" for k, v in UNAMBIGUOUS.items()]
    + [f"SELECT {text_sql(k)}, NULL, {text_sql(v)}" for k, v in AMBIGUOUS.items()])


@check("normalize_currency", f"""
    WITH raw AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
                        ({_PICK})[1 + (l_orderkey * 7 + l_partkey) % {len(_WORDS)}] AS w FROM lineitem),
    cased AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN upper(w) ELSE ' ' || w END AS printed FROM raw),
    keyed AS (SELECT *, trim(printed) AS tr, upper(trim(printed)) AS u, regexp_replace(lower(trim(printed)), '\\s+', ' ', 'g') AS k1 FROM cased),
    one AS (SELECT *, CASE WHEN k1 LIKE '%s' AND k1 NOT LIKE '%ss' THEN left(k1, length(k1) - 1) ELSE k1 END AS k2 FROM keyed),
    dict AS ({_DICT}),
    hit AS (SELECT one.*, CASE WHEN a.k IS NOT NULL THEN a.c ELSE b.c END AS c, CASE WHEN a.k IS NOT NULL THEN a.r ELSE b.r END AS r
            FROM one LEFT JOIN dict a ON a.k = k1 LEFT JOIN dict b ON b.k = k2)
    SELECT printed, code, reason, count(*) AS n FROM (
      SELECT printed,
        CASE WHEN tr = '' THEN NULL WHEN u IN ({', '.join(text_sql(c) for c in ISO_CODES)}) THEN u ELSE c END AS code,
        CASE WHEN tr = '' THEN 'No text.' WHEN u IN ({', '.join(text_sql(c) for c in ISO_CODES)}) THEN '''' || tr || ''' is a known code.'
             WHEN c IS NOT NULL THEN '''' || tr || ''' stands for ' || c || '.' WHEN r IS NOT NULL THEN 'Several readings: ' || r
             WHEN regexp_full_match(u, '[A-Z]{{3}}') THEN '''' || tr || ''' has the form of a code that is not known.'
             ELSE 'No reading for ''' || tr || '''.' END AS reason FROM hit) GROUP BY ALL""")
def normalize_currency_(spark, d):
    words = F.array(*[F.lit(w) for w in _WORDS])
    item = t.table(spark, d, "lineitem").select("l_linenumber", F.element_at(
        words, F.expr(f"cast(1 + (l_orderkey * 7 + l_partkey) % {len(_WORDS)} as int)")).alias("w"))
    printed = item.select(F.when(F.col("l_linenumber") % 2 == 0, F.upper("w")).otherwise(F.concat(F.lit(" "), "w")).alias("printed"))
    return normalize_currency(printed, "printed").groupBy("printed", "code", "reason").agg(F.count("*").alias("n"))


# ---------- calibration ----------

@check("confusion_kappa", """
    SELECT tt, tf, ft, ff, round(o, 6) AS observed, round(e, 6) AS expected, round((o - e) / (1 - e), 6) AS kappa, (o - e) / (1 - e) >= 0.75e0 AS accepted
    FROM (SELECT *, (tt + ff) / n AS o, (tt + tf) / n * ((tt + ft) / n) + (ft + ff) / n * ((tf + ff) / n) AS e
          FROM (SELECT count(*) FILTER (h AND j) AS tt, count(*) FILTER (h AND NOT j) AS tf, count(*) FILTER (NOT h AND j) AS ft,
                       count(*) FILTER (NOT h AND NOT j) AS ff, count(*)::DOUBLE AS n
                FROM (SELECT quality = 1 AS h, (toxic = 0 AND doc_id % 10 <> 0) AS j FROM labels)))""")
def confusion_kappa(spark, d):
    ratings = t.table(spark, d, "labels").select(
        (F.col("quality") == 1).alias("human"), F.expr("toxic = 0 and doc_id % 10 <> 0").alias("judge"))
    k = J.confusion_kappa(ratings)
    return k.withColumns({c: r6(c) for c in ("observed", "expected", "kappa")})


_ORIGIN_ARRAY = "['run:mini-plain', 'synthetic:ocr_noise', 'synthetic:reordered', 'run:mini-plain,strong-plain']"


@check("agreement_by_origin", f"""
    SELECT origin, count(*) AS pairs, count(*) FILTER (h) AS human_true, count(*) FILTER (j) AS judge_true,
           round(avg(CASE WHEN h = j THEN 1.0e0 ELSE 0.0e0 END), 6) AS agreement,
           count(*) FILTER (j AND NOT h) AS too_lenient, count(*) FILTER (NOT j AND h) AS too_strict
    FROM (SELECT CASE WHEN o LIKE 'run:%' THEN 'real (runs)' ELSE replace(o, 'synthetic:', '') END AS origin, h, j
          FROM (SELECT ({_ORIGIN_ARRAY})[1 + doc_id % 4] AS o, quality = 1 AS h, toxic = 0 AS j FROM labels)) GROUP BY origin""")
def agreement_by_origin(spark, d):
    ratings = t.table(spark, d, "labels").select(
        F.expr(f"element_at(array({_ORIGIN_ARRAY[1:-1]}), cast(doc_id % 4 as int) + 1)").alias("origin"),
        (F.col("quality") == 1).alias("human"), (F.col("toxic") == 0).alias("judge"))
    return J.agreement_by_origin(ratings).withColumn("agreement", r6("agreement"))


def mismatches(spark, d):
    return J.real_mismatches(S.with_field_outcomes(Y.latest_rows(t.scored(spark, d)), CENT))


_LATEST = {"latest": "SELECT * FROM mismatches WHERE execution = '20260201T000000Z-bbb'"}


@check("dedupe_mismatches", sql("""
    SELECT 'p-' || substr(sha256(field || chr(10) || golden || chr(10) || predicted), 1, 12) AS id, field, golden, predicted,
           min(doc_id) AS doc_id, 'run:' || string_agg(DISTINCT config, ',' ORDER BY config) AS origin
    FROM latest GROUP BY field, golden, predicted""", "mismatches", extra=_LATEST))
def dedupe_mismatches(spark, d):
    return K.dedupe_mismatches(mismatches(spark, d)).select("id", "field", "golden", "predicted", "doc_id", "origin")


def names(spark, d):
    return t.golden(spark, d).select("doc_id", F.explode(F.array(
        F.struct(F.lit("vendor_name").alias("field"), F.col("vendor_name").alias("name")),
        F.struct(F.lit("customer_name").alias("field"), F.col("customer_name").alias("name")))).alias("n")).select("doc_id", "n.*")


@check("distinct_names", sql("""
    SELECT field, arg_min(name, doc_id) AS name, min(doc_id) AS doc_id FROM (
      SELECT doc_id, 'vendor_name' AS field, vendor_name AS name, regexp_replace(lower(vendor_name), '( ltd|, s\\.a\\.)$', '') AS k FROM golden
      WHERE vendor_name IS NOT NULL
      UNION ALL
      SELECT doc_id, 'customer_name', customer_name, regexp_replace(lower(customer_name), '( inc\\.| gmbh & co\\. kg)$', '') FROM golden)
    GROUP BY field, k""", "golden"))
def distinct_names(spark, d):
    return K.distinct_names(names(spark, d))


@check("calibration_pairs")
def calibration_pairs(spark, d):
    return K.calibration_pairs(mismatches(spark, d), names(spark, d), target=3000, seed=42)


@check("perturb")
def perturb(spark, d):
    """Every kind over every distinct name."""
    pool = stored(K.distinct_names(names(spark, d)), "pool")
    out = None
    for kind in K.KINDS:
        rows = K.perturb(pool, kind, 42).withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out


def labelled(spark, d):
    """Deduplicated mismatches with a human label by document number."""
    pairs = K.dedupe_mismatches(mismatches(spark, d)).withColumn("excerpt", F.lit(""))
    return pairs.withColumn("human_label", F.col("doc_id") % 3 != 0)


_PAIRS = dict(_LATEST)
_PAIRS |= {
    "pairs": """SELECT 'p-' || substr(sha256(field || chr(10) || golden || chr(10) || predicted), 1, 12) AS id, field, golden, predicted,
        min(doc_id) AS doc_id, min(doc_id) % 3 <> 0 AS human_label FROM latest GROUP BY field, golden, predicted""",
    "rated_pairs": """SELECT p.*, human_label AS h, coalesce(v IN (0, 3), false) AS j FROM pairs p LEFT JOIN verdicts USING (field, golden, predicted)""",
}


@check("calibration_report", sql("""
    SELECT tt, tf, ft, ff, round(o, 6) AS observed, round((o - e) / (1 - e), 6) AS kappa, disagreements
    FROM (SELECT *, (tt + ff) / n AS o, (tt + tf) / n * ((tt + ft) / n) + (ft + ff) / n * ((tf + ff) / n) AS e
          FROM (SELECT count(*) FILTER (h AND j) AS tt, count(*) FILTER (h AND NOT j) AS tf, count(*) FILTER (NOT h AND j) AS ft,
                       count(*) FILTER (NOT h AND NOT j) AS ff, count(*)::DOUBLE AS n, count(*) FILTER (h <> j) AS disagreements FROM rated_pairs))""",
    "mismatches", "verdicts", extra=_PAIRS))
def calibration_report(spark, d):
    all_runs = J.real_mismatches(S.with_field_outcomes(t.scored(spark, d), CENT))
    kappa, _, wrong = J.calibration_report(labelled(spark, d), t.verdicts(all_runs))
    row = kappa.select("tt", "tf", "ft", "ff", r6("observed").alias("observed"), r6("kappa").alias("kappa"))
    return row.join(F.broadcast(wrong.agg(F.count("*").alias("disagreements"))))


@check("label_carry_over", sql("""
    SELECT id, CASE WHEN doc_id % 2 = 0 THEN human_label END AS human_label, 0 AS dropped FROM pairs""", "mismatches", extra=_PAIRS | {"z": "SELECT 1"}))
def label_carry_over(spark, d):
    before = labelled(spark, d).where("doc_id % 2 = 0")
    fresh = labelled(spark, d).withColumn("human_label", F.lit(None).cast("boolean"))
    merged, dropped = K.label_carry_over(fresh, before)
    return merged.select("id", "human_label").join(F.broadcast(dropped.select(F.col("dropped").cast("int").alias("dropped"))))


# ---------- hashing ----------

@check("hash_rank", "SELECT doc_id, sha256('42:' || doc_id) AS rank FROM documents")
def hash_rank_(spark, d):
    return t.table(spark, d, "documents").select("doc_id", hash_rank(F.col("doc_id"), 42).alias("rank"))


_BYTE = " + ".join(
    f"(CAST(instr('0123456789abcdef', substr(h, {2 * i + 1}, 1)) - 1 AS UHUGEINT) * 16 + CAST(instr('0123456789abcdef', substr(h, {2 * i + 2}, 1)) - 1 AS UHUGEINT)) * {256 ** i}::UHUGEINT"
    for i in range(8))


@check("hash_draw", f"""
    SELECT doc_id, CAST(({_BYTE}) % 1000 AS BIGINT) AS draw FROM (SELECT doc_id, sha256('7:' || doc_id || ':3') AS h FROM documents)""")
def hash_draw_(spark, d):
    return t.table(spark, d, "documents").select("doc_id", hash_draw(7, F.col("doc_id"), 3, 1000).alias("draw"))


_POOL = {
    "names": """SELECT doc_id, 'vendor_name' AS field, vendor_name AS name, regexp_replace(lower(vendor_name), '( ltd|, s\\.a\\.)$', '') AS k FROM golden
        WHERE vendor_name IS NOT NULL UNION ALL
        SELECT doc_id, 'customer_name', customer_name, regexp_replace(lower(customer_name), '( inc\\.| gmbh & co\\. kg)$', '') FROM golden""",
    "firsts": "SELECT field, k, arg_min(name, doc_id) AS name, min(doc_id) AS doc_id FROM names GROUP BY field, k",
    "pool": """SELECT *, row_number() OVER (ORDER BY substr(sha256(field || ':' || name), 1, 3), field, name, doc_id) - 1 AS idx, count(*) OVER () AS size FROM firsts""",
    "hashed": "SELECT *, sha256('42:different_party:' || field || ':' || name || ':' || attempt) AS h FROM pool CROSS JOIN (VALUES (0), (1)) AS v(attempt)",
    "drawn": f"SELECT field, doc_id, name, k, CAST(({_BYTE}) % size::UHUGEINT AS BIGINT) AS other FROM hashed",
}


@check("different_party", sql("""
    SELECT DISTINCT a.field, a.doc_id, a.name AS golden, b.name AS predicted FROM drawn a JOIN pool b ON b.idx = a.other WHERE a.k <> b.k""", "golden", extra=_POOL))
def different_party(spark, d):
    return K.different_party(names(spark, d), 2, 42)


@check("doc_key", "SELECT page_id, url AS key FROM pages")
def doc_key_(spark, d):
    """Scenario names back to document keys: ids have one slash and no dot before it."""
    rows = t.table(spark, d, "pages").select("page_id", "url", F.concat(F.lit("p/"), F.replace("url", F.lit("/"), F.lit("|"))).alias("id"))
    back = doc_key(scenario_of(F.col("id")))
    return rows.select("page_id", F.replace(F.substr(back, F.lit(3)), F.lit("|"), F.lit("/")).alias("key"))


# ---------- replay ----------

@check("replay_join", """
    WITH req AS (SELECT conv_id, turn, role || '|' || text AS content FROM conversations),
    res AS (SELECT DISTINCT content, min(conv_id * 1000 + turn) OVER (PARTITION BY content) AS k FROM req)
    SELECT conv_id, turn, CASE WHEN k % 4 = 0 THEN 'miss' ELSE 'served' END AS state,
           CASE WHEN k % 4 <> 0 THEN 'r' || k END AS response_text, CASE WHEN k % 4 <> 0 THEN CAST(k % 97 AS DOUBLE) END AS latency_ms
    FROM req JOIN res USING (content)""")
def replay_join(spark, d):
    """Requests by content: a quarter of the distinct contents has no stored response."""
    req = t.table(spark, d, "conversations").select(
        "conv_id", "turn", F.lit("model-small").alias("model"), F.concat_ws("|", "role", "text").alias("messages"),
        F.lit("t=0").alias("options"), F.lit("").alias("tools"))
    made = req.groupBy(X.request_fingerprint().alias("fingerprint")).agg(F.min(F.expr("conv_id * 1000 + turn")).alias("k"))
    stored = made.where("k % 4 <> 0").select("fingerprint", F.concat(F.lit("r"), F.col("k").cast("string")).alias("response_text"),
                                             (F.col("k") % 97).cast("double").alias("latency_ms"))
    served, misses = X.replay_join(req, stored)
    none = [F.lit(None).cast("string").alias("response_text"), F.lit(None).cast("double").alias("latency_ms")]
    return served.select("conv_id", "turn", F.lit("served").alias("state"), "response_text", "latency_ms").unionAll(
        misses.select("conv_id", "turn", F.lit("miss").alias("state"), *none))


# ---------- export ----------

_EXPORTED = ["composite", "schema_validity", "recomputed_total_rate", "line_items_precision", "line_items_recall", "line_items_f1"]


@check("score_export", sql("""
    SELECT id, name, round(value, 6) AS value, comment, (row_number() OVER (ORDER BY substr(sha256(id), 1, 3), id) - 1) // 100 AS batch FROM (
      SELECT doc_id || '-' || metric AS id, metric AS name, value,
             CASE WHEN length(reason) > 500 THEN substr(reason, 1, 500) || '…' ELSE reason END AS comment FROM rows)""", "scores", extra={
    "rows": "SELECT config || ':' || execution || ':' || doc_id AS doc_id, metric, value, repeat('why ' || metric || ' ', 1 + CAST(doc_id % 60 AS INTEGER)) AS reason FROM ("
    + " UNION ALL ".join(f"SELECT config, execution, doc_id, '{m}' AS metric, {m} AS value FROM scores" for m in _EXPORTED) + ") WHERE value IS NOT NULL"}))
def score_export(spark, d):
    """Every metric of a document, and for every row the batch that it is sent in."""
    long = S.doc_metrics(t.judged_scores(spark, d), _EXPORTED, ["config", "execution", "doc_id"])
    rows = long.select(
        F.concat_ws(":", "config", "execution", "doc_id").alias("trace_id"), "metric", "value",
        F.expr("repeat(concat('why ', metric, ' '), 1 + cast(doc_id % 60 as int))").alias("reason"))
    return X.score_export(rows).select("id", "name", r6("value").alias("value"), "comment", "batch")


@check("snapshot_sync", """
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, 'item-' || substr(sha256(CAST(coalesce(a.doc_id, b.doc_id) AS VARCHAR)), 1, 24) AS item_id,
           CASE WHEN a.doc_id IS NULL THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status
    FROM documents a FULL JOIN (SELECT doc_id FROM labels UNION ALL SELECT -1 - doc_id FROM labels) b USING (doc_id)""")
def snapshot_sync(spark, d):
    from tallymark.functions.hashing import item_id

    labels = t.table(spark, d, "labels").select("doc_id")
    before = labels.unionAll(labels.select((-1 - F.col("doc_id")).alias("doc_id")))
    return X.snapshot_sync(t.table(spark, d, "documents"), before.withColumn("item_id", item_id(F.col("doc_id"), "item-")), "item-")


# ---------- estimates ----------

def _estimate_docs(spark, d):
    return t.table(spark, d, "documents").select("doc_id", "text", F.concat(F.lit('{"id":"'), F.col("doc_id").cast("string"), F.lit('"}')).alias("expected_json"))


_EST = "(SELECT count(*)::DOUBLE AS n, sum(length(text))::DOUBLE AS tc, sum(length('{\"id\":\"' || doc_id || '\"}'))::DOUBLE AS jc FROM documents)"
_USD = "(input_tokens * {i} + output_tokens * {o}) / 1e6"


@check("estimate_direct", f"""
    SELECT docs, round(input_tokens, 3) AS input_tokens, round(output_tokens, 3) AS output_tokens, round({_USD.format(i=1, o=5)}, 6) AS usd,
           round({_USD.format(i=1, o=5)} / docs * 1000, 6) AS usd_per_1k
    FROM (SELECT CAST(n AS BIGINT) AS docs, ((n * 2000 + tc) / 3.5e0 + n * 600) * 1.2e0 AS input_tokens, jc / 3.5e0 * 1.2e0 AS output_tokens FROM {_EST})""")
def estimate_direct(spark, d):
    return _estimate_rounded(X.estimate_direct(_estimate_docs(spark, d), 2000, t.prices(spark), "model-small"))


def _estimate_rounded(df):
    return df.withColumns({"input_tokens": F.round("input_tokens", 3), "output_tokens": F.round("output_tokens", 3),
                           "usd": r6("usd"), "usd_per_1k": r6("usd_per_1k")})


@check("estimate_agent", f"""
    SELECT turns, docs, round(input_tokens, 3) AS input_tokens, round(output_tokens, 3) AS output_tokens, round(usd, 6) AS usd, round(usd / docs * 1000, 6) AS usd_per_1k
    FROM (SELECT *, CASE WHEN turns = 0 THEN {_USD.format(i=1, o=5)} ELSE {_USD.format(i=2, o=10)} END AS usd FROM (
      SELECT turns, CAST(n AS BIGINT) AS docs,
             CASE WHEN turns = 0 THEN (n * (1200 + tools + 600) + (n * 2000 + tc) / 3.5e0) * 2.4e0
                  ELSE (turns * ((n * 2000 + tc) / 3.5e0 + n * (600 + tools)) + n * 200 * turns * (turns - 1) / 2.0e0) * 1.2e0 END AS input_tokens,
             CASE WHEN turns = 0 THEN n * 600 * 1.2e0 ELSE (n * (turns - 1) * 120 + jc / 3.5e0) * 1.2e0 END AS output_tokens
      FROM (SELECT *, 700 / 3.5e0 + 350 AS tools FROM {_EST}) CROSS JOIN (VALUES (0), (3), (7)) AS v(turns)))""")
def estimate_agent(spark, d):
    return _estimate_rounded(X.estimate_agent(_estimate_docs(spark, d), 2000, 700, t.prices(spark), "model-large", "model-small"))


@check("estimate_judge", f"""
    SELECT docs, round(input_tokens, 3) AS input_tokens, round(output_tokens, 3) AS output_tokens, round({_USD.format(i=1, o=5)}, 6) AS usd,
           round({_USD.format(i=1, o=5)} / docs * 1000, 6) AS usd_per_1k
    FROM (SELECT CAST(n AS BIGINT) AS docs, n * 2 * ((900 + 1500) / 3.5e0 + 600) * 1.2e0 AS input_tokens, n * 2 * 80 * 1.2e0 AS output_tokens FROM {_EST})""")
def estimate_judge(spark, d):
    return _estimate_rounded(X.estimate_judge(_estimate_docs(spark, d), 900, t.prices(spark), "model-small"))


@check("estimate_calibration", f"""
    SELECT docs, round(input_tokens, 3) AS input_tokens, round(output_tokens, 3) AS output_tokens, round({_USD.format(i=1, o=5)}, 6) AS usd,
           round({_USD.format(i=1, o=5)} / docs * 1000, 6) AS usd_per_1k
    FROM (SELECT count(*) AS docs, sum((900 + length(c.c_name) + length(o.o_orderpriority) + length(o.o_orderstatus)) / 3.5e0 + 300) AS input_tokens,
                 count(*) * 80.0e0 AS output_tokens FROM orders o JOIN customer c ON c_custkey = o_custkey)""")
def estimate_calibration(spark, d):
    pairs = t.table(spark, d, "orders").join(t.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_name").alias("golden"), F.col("o_orderpriority").alias("predicted"), F.col("o_orderstatus").alias("excerpt"))
    return _estimate_rounded(X.estimate_calibration(pairs, 900, t.prices(spark), "model-small"))
