"""Summaries, percentiles, comparisons, the gate, and document sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_checks import CENT, check
from driver_checks import tables as t
from driver_checks.ctes import score, sql
from tallymark.functions import aggregates as A
from tallymark.functions.ordering import config_order, layout_order
from tallymark.operators import compare as C
from tallymark.operators import gate as G
from tallymark.operators import ranks as R
from tallymark.operators import scoring as S
from tallymark.operators import summary as Y
from tallymark.plans import evaluation as E
from tallymark.schemas import AGENT_METRICS, FIELDS, JUDGED_FIELDS

RUN = ["execution", "config"]


def r6(c):
    return F.round(c, 6)


def rounded(df, digits=6):
    doubles = [c for c, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in doubles})  # a rounded negative zero becomes zero


def outcomes(spark, d):
    return S.with_field_outcomes(t.scored(spark, d), CENT)


# ---------- summary ----------

def _avg(x: str) -> str:
    return f"round(avg({x}), 6)"


def _fp(f: str) -> str:
    return (f"round(count(*) FILTER (outcome_{f} = 'false_positive')::DOUBLE / "
            f"nullif(count(*) FILTER (outcome_{f} IN ('false_positive', 'correct_null')), 0), 6)")


def _miss(f: str) -> str:
    return (f"round(count(*) FILTER (outcome_{f} = 'miss')::DOUBLE / "
            f"nullif(count(*) FILTER (outcome_{f} IN ('miss', 'correct_value', 'mismatch')), 0), 6)")


def _rank(col: str, p: int) -> str:
    return f"list_sort(list({col}))[(count({col}) * {p} + 99) // 100]"


_SUMMARY_COLS = ", ".join(
    ["count(*) AS docs", f"{_avg('schema_validity')} AS schema_validity"]
    + [f"{_avg(score(f'outcome_{f}'))} AS {f}_accuracy" for f in FIELDS]
    + [f"{_avg(score(f'judged_{f}'))} AS {f}_judged_accuracy" for f in JUDGED_FIELDS]
    + [f"{_fp(f)} AS {f}_false_positive_rate" for f in FIELDS] + [f"{_miss(f)} AS {f}_miss_rate" for f in FIELDS]
    + [f"{_avg('recomputed_total_rate')} AS recomputed_total_rate", "count(recomputed_total_rate) AS recomputed_total_n"]
    + [f"{_avg(m)} AS {m}" for m in ("line_items_precision", "line_items_recall", "line_items_f1")]
    + ["count(line_items_f1) AS line_items_coverage", f"{_avg('composite')} AS composite",
       f"{_avg('latency_ms')} AS latency_mean_ms", f"{_rank('latency_ms', 50)} AS latency_p50_ms", f"{_rank('latency_ms', 95)} AS latency_p95_ms"]
    + [f"{_avg(f'{x}_tokens')} AS {x}_tokens_mean" for x in ("input", "output", "thinking")]
    # These scores hold no agent metrics: their columns are there and empty.
    + [x for c in AGENT_METRICS for x in (f"CAST(NULL AS DOUBLE) AS {c}", f"CAST(0 AS BIGINT) AS {c}_n")])
_SUMMARY_ROWS = (
    "SELECT s.execution, s.config, s.model, s.prompt, s.input_mode, x.subset, " + _SUMMARY_COLS
    + ", round((avg(input_tokens) * min(input_per_mtok) + avg(output_tokens) * min(output_per_mtok)) / 1e6 * 1000, 6) AS usd_per_1k_docs"
    + " FROM judged_scores s CROSS JOIN (VALUES ('fatura'), ('synthetic'), ('combined')) AS x(subset)"
    " LEFT JOIN prices p ON p.model = s.model WHERE x.subset = 'combined' OR x.subset = s.source"
    " GROUP BY s.execution, s.config, s.model, s.prompt, s.input_mode, x.subset")


@check("summary", sql(_SUMMARY_ROWS, "judged_scores", "prices"))
def summary(spark, d):
    return rounded(E.report(t.judged_scores(spark, d), t.prices(spark)))


@check("mean_applicable", sql("""
    SELECT execution, config, round(avg(recomputed_total_rate), 6) AS recomputed, round(avg(line_items_f1), 6) AS lines
    FROM scores GROUP BY execution, config""", "scores"))
def mean_applicable(spark, d):
    return rounded(t.judged_scores(spark, d).groupBy(*RUN).agg(
        A.mean_applicable("recomputed_total_rate").alias("recomputed"), A.mean_applicable("line_items_f1").alias("lines")))


@check("false_positive_rate", sql(
    "SELECT execution, config, " + ", ".join(f"{_fp(f)} AS {f}" for f in FIELDS) + " FROM outcomes GROUP BY execution, config", "outcomes"))
def false_positive_rate(spark, d):
    return rounded(outcomes(spark, d).groupBy(*RUN).agg(*[A.false_positive_rate(f).alias(f) for f in FIELDS]))


@check("miss_rate", sql(
    "SELECT execution, config, " + ", ".join(f"{_miss(f)} AS {f}" for f in FIELDS) + " FROM outcomes GROUP BY execution, config", "outcomes"))
def miss_rate(spark, d):
    return rounded(outcomes(spark, d).groupBy(*RUN).agg(*[A.miss_rate(f).alias(f) for f in FIELDS]))


@check("judged_accuracy", sql("SELECT execution, config, " + ", ".join(
    f"{_avg(score(f'judged_{f}'))} AS {f}" for f in JUDGED_FIELDS) + " FROM judged_scores GROUP BY execution, config", "judged_scores"))
def judged_accuracy(spark, d):
    return rounded(t.judged_scores(spark, d).groupBy(*RUN).agg(*[A.judged_accuracy(f).alias(f) for f in JUDGED_FIELDS]))


@check("coverage", sql("""
    SELECT execution, config, source, count(line_items_f1) AS lines, count(recomputed_total_rate) AS recomputed, count(composite) AS composite
    FROM scores GROUP BY execution, config, source""", "scores"))
def coverage(spark, d):
    return t.judged_scores(spark, d).groupBy(*RUN, "source").agg(
        A.coverage("line_items_f1").alias("lines"), A.coverage("recomputed_total_rate").alias("recomputed"),
        A.coverage("composite").alias("composite"))


@check("latency_percentiles", f"""
    SELECT event_type, round(avg(value), 6) AS mean, {_rank('value', 50)} AS p50, {_rank('value', 95)} AS p95
    FROM events GROUP BY event_type""")
def latency_percentiles(spark, d):
    return Y.latency_percentiles(t.table(spark, d, "events"), ["event_type"], "value").withColumn("mean", r6("mean"))


@check("nearest_rank", f"SELECT o_orderpriority, {_rank('o_totalprice', 90)} AS value FROM orders GROUP BY o_orderpriority")
def nearest_rank(spark, d):
    return R.nearest_rank(t.table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", 0.9)


@check("token_means", sql("""
    SELECT execution, config, round(avg(input_tokens), 6) AS input_tokens_mean, round(avg(output_tokens), 6) AS output_tokens_mean,
           round(avg(thinking_tokens), 6) AS thinking_tokens_mean FROM answers GROUP BY execution, config""", "answers"))
def token_means(spark, d):
    return rounded(Y.token_means(t.flat_answers(spark, d), RUN))


@check("dates_accuracy", sql(f"""
    SELECT execution, config, subset, round((a + b) / 2, 6) AS dates FROM (
      SELECT execution, config, subset, avg({score('outcome_invoice_date')}) AS a, avg({score('outcome_due_date')}) AS b
      FROM outcomes CROSS JOIN (VALUES ('fatura'), ('synthetic'), ('combined')) AS x(subset)
      WHERE subset = 'combined' OR subset = source GROUP BY ALL)""", "outcomes"))
def dates_accuracy(spark, d):
    rows = Y.by_subset(outcomes(spark, d), RUN, {f"{f}_accuracy": A.accuracy_value(f) for f in ("invoice_date", "due_date")})
    return Y.dates_accuracy(rows).select(*RUN, "subset", r6("dates").alias("dates"))


@check("layout_pivot", sql("""
    SELECT source, layout, count(DISTINCT doc_id) AS docs,
           round(avg(composite) FILTER (config = 'mini-plain'), 6) AS "mini-plain",
           round(avg(composite) FILTER (config = 'strong-plain'), 6) AS "strong-plain"
    FROM scores WHERE execution = '20260201T000000Z-bbb' GROUP BY source, layout""", "scores"))
def layout_pivot(spark, d):
    return rounded(Y.layout_pivot(Y.latest_rows(t.judged_scores(spark, d)), ["mini-plain", "strong-plain"]))


@check("price_join", sql("""
    SELECT a.model, input_per_mtok, count(*) AS n FROM answers a LEFT JOIN (SELECT * FROM prices WHERE model <> 'model-large') p
    ON p.model = a.model GROUP BY ALL""", "answers", "prices"))
def price_join(spark, d):
    known = t.prices(spark).where(F.col("model") != "model-large")
    return Y.price_join(t.flat_answers(spark, d), known).groupBy("model", "input_per_mtok").agg(F.count("*").alias("n"))


@check("cost_usd", sql("""
    SELECT config, doc_id, execution, round((input_tokens * input_per_mtok + output_tokens * output_per_mtok) / 1e6, 9) AS usd,
           round((input_tokens * input_per_mtok + output_tokens * output_per_mtok) / 1e6 * 1000, 6) AS usd_per_1k_docs
    FROM answers a JOIN prices p ON p.model = a.model""", "answers", "prices"))
def cost_usd(spark, d):
    rows = t.flat_answers(spark, d).select("config", "doc_id", "execution", "model", "input_tokens", "output_tokens")
    priced = Y.cost_usd(rows, t.prices(spark), "input_tokens", "output_tokens")
    return priced.select("config", "doc_id", "execution", F.round("usd", 9).alias("usd"), r6("usd_per_1k_docs").alias("usd_per_1k_docs"))


def _broken(scores):
    """A tenth of the evaluations failed; half of those on a cache miss."""
    failed, miss = F.col("doc_id") % 10 == 3, F.col("doc_id") % 20 == 3
    return scores.withColumns({
        "composite": F.when(~failed, F.col("composite")),
        "errors": F.when(miss, "CacheMissException: no stored response").when(failed, "timeout").otherwise("")})


_BROKEN = {"broken": """
    SELECT * REPLACE (CASE WHEN doc_id % 10 <> 3 THEN composite END AS composite),
           CASE WHEN doc_id % 20 = 3 THEN 'CacheMissException: no stored response' WHEN doc_id % 10 = 3 THEN 'timeout' ELSE '' END AS errors
    FROM scores"""}


@check("failed_evaluations", sql("""
    SELECT execution, config, count(*) AS n, count(*) FILTER (errors LIKE '%CacheMissException%') AS n_cache_miss
    FROM broken WHERE composite IS NULL GROUP BY execution, config""", "scores", extra=_BROKEN))
def failed_evaluations(spark, d):
    return Y.failed_evaluations(_broken(t.judged_scores(spark, d)))


@check("run_health", sql("""
    SELECT execution, config, count(*) AS documents, count(*) FILTER (source = 'fatura') AS fatura_documents,
           count(*) FILTER (source = 'synthetic') AS synthetic_documents, count(*) FILTER (cache_hit) AS cache_hits,
           count(*) FILTER (composite IS NULL AND errors NOT LIKE '%CacheMiss%') AS failures,
           count(*) FILTER (composite IS NULL AND errors LIKE '%CacheMiss%') AS misses
    FROM broken GROUP BY execution, config""", "scores", extra=_BROKEN))
def run_health(spark, d):
    return Y.run_health(_broken(t.judged_scores(spark, d)))


@check("top_failures", sql("""
    SELECT execution, config, doc_id, errors FROM broken WHERE errors <> ''
    ORDER BY doc_id, execution, config LIMIT 20""", "scores", extra=_BROKEN))
def top_failures(spark, d):
    failures = _broken(t.judged_scores(spark, d)).where("errors <> ''").select(*RUN, "doc_id", "errors")
    return Y.top_failures(failures)


# ---------- latest runs and orders ----------

@check("latest_execution", """
    SELECT event_type, user_id % 7 AS bucket, max(strftime(ts, '%Y%m%dT%H%M%SZ')) AS execution
    FROM events GROUP BY ALL""")
def latest_execution(spark, d):
    runs = t.table(spark, d, "events").select(
        "event_type", (F.col("user_id") % 7).alias("bucket"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("execution"))
    keyed = runs.withColumn("config", F.struct("event_type", "bucket"))
    return Y.latest_execution(keyed).select("config.event_type", "config.bucket", "execution")


@check("latest_rows", sql("""
    SELECT config, execution, doc_id FROM answers WHERE execution = '20260201T000000Z-bbb'""", "answers"))
def latest_rows(spark, d):
    return Y.latest_rows(t.flat_answers(spark, d).select("config", "execution", "doc_id"))


@check("first_n_documents", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 25")
def first_n_documents(spark, d):
    return Y.first_n_documents(t.table(spark, d, "documents").select("doc_id", "lang", "source"), 25)


@check("config_order", """
    SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1
           WHEN 'error' THEN 2 ELSE 99 END, event_type) AS place FROM events GROUP BY event_type""")
def config_order_(spark, d):
    from pyspark.sql import Window

    counts = t.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    order = Window.orderBy(config_order(F.col("event_type"), ("view", "click", "error")), "event_type")
    return counts.withColumn("place", F.row_number().over(order).cast("long"))


@check("layout_order", """
    SELECT layout, n, row_number() OVER (ORDER BY CASE WHEN layout LIKE 'Template%' THEN CAST(substr(layout, 9) AS INTEGER) ELSE 0 END,
           CASE WHEN layout LIKE 'Template%' THEN '' ELSE layout END) AS place
    FROM (SELECT CASE WHEN l_partkey % 10 = 0 THEN l_returnflag ELSE 'Template' || (1 + l_partkey % 50) END AS layout, count(*) AS n
          FROM lineitem GROUP BY 1)""")
def layout_order_(spark, d):
    from pyspark.sql import Window

    layout = F.expr("if(l_partkey % 10 = 0, l_returnflag, concat('Template', 1 + l_partkey % 50))")
    counts = t.table(spark, d, "lineitem").groupBy(layout.alias("layout")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(*layout_order(F.col("layout")))).cast("long"))


# ---------- document sets ----------

@check("union_sets", """
    SELECT 'document' AS kind, doc_id, lang FROM documents UNION ALL SELECT 'benchmark', item_id, 'en' FROM benchmark""")
def union_sets(spark, d):
    docs = t.table(spark, d, "documents").select(F.lit("document").alias("kind"), "doc_id", "lang")
    extra = t.table(spark, d, "benchmark").select(F.lit("en").alias("lang"), F.col("item_id").alias("doc_id"), F.lit("benchmark").alias("kind"))
    return Y.union_sets(docs, extra)


@check("common_documents", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def common_documents(spark, d):
    return Y.common_documents(t.table(spark, d, "documents"), t.table(spark, d, "labels"))


@check("unpaired_documents", """
    SELECT coalesce(o_orderkey, l_orderkey) AS doc_id, CASE WHEN l_orderkey IS NULL THEN 'left' ELSE 'right' END AS side
    FROM orders FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey
    WHERE l_orderkey IS NULL OR o_orderkey IS NULL""")
def unpaired_documents(spark, d):
    a = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return Y.unpaired_documents(a, t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id")))


# ---------- comparison ----------

_METRICS = ("composite", "schema_validity", *[f"field_{f}" for f in FIELDS], *[f"field_{f}_judged" for f in JUDGED_FIELDS], "line_items_f1")


def _metric_sql(m: str) -> str:
    if not m.startswith("field_"):
        return m
    name = m.removeprefix("field_")
    return score(f"judged_{name.removesuffix('_judged')}") if name.endswith("_judged") else score(f"outcome_{name}")


_SIDES = "SELECT config, doc_id, source, " + ", ".join(f"{_metric_sql(m)} AS {m}" for m in _METRICS) + \
    " FROM judged_scores WHERE execution = '20260201T000000Z-bbb'"
_PAIRED = {"sides": _SIDES, "paired": " UNION ALL ".join(
    f"SELECT doc_id, a.source, '{m}' AS metric, a.{m} AS l, b.{m} AS r, b.{m} - a.{m} AS delta FROM sides a JOIN sides b USING (doc_id) "
    "WHERE a.config = 'mini-plain' AND b.config = 'strong-plain'" for m in _METRICS)}


def paired(spark, d, metrics=_METRICS):
    scores = S.field_scores(t.judged_scores(spark, d))
    return C.paired_runs(scores, "mini-plain", "strong-plain", metrics)


@check("paired_runs", sql("""
    SELECT doc_id, source, metric, round(l, 6) AS "left", round(r, 6) AS "right", round(delta, 6) + 0.0e0 AS delta FROM paired""",
    "judged_scores", extra=_PAIRED))
def paired_runs(spark, d):
    return rounded(paired(spark, d))


@check("delta_listing", sql("""
    SELECT doc_id, round(delta, 6) + 0.0e0 AS delta, (SELECT count(*) FROM paired WHERE metric = 'composite' AND delta = 0) AS n_zero
    FROM paired WHERE metric = 'composite' AND delta <> 0""", "judged_scores", extra=_PAIRED))
def delta_listing(spark, d):
    rows, zero = C.delta_listing(paired(spark, d, ("composite",)))
    return rounded(rows.select("doc_id", "delta")).join(F.broadcast(zero))


def _bootstrap_sql(where: str, resamples: int) -> str:
    """Intervals by the same stream: every draw of every resample, once per distinct group size."""
    bits = "18446744073709551615::UHUGEINT"
    low, high = (-(-resamples * p // 1000) for p in (25, 975))
    return sql(f"""
    SELECT metric, subset, n, round(mean, 6) + 0.0e0 AS mean, round(m[{low}], 6) + 0.0e0 AS low, round(m[{high}], 6) + 0.0e0 AS high,
           m[{low}] > 0 OR m[{high}] < 0 AS significant, 'stream' AS method
    FROM (SELECT metric, subset, any_value(n) AS n, any_value(mean) AS mean, list_sort(list(total / n)) AS m FROM resampled GROUP BY metric, subset)""",
        "judged_scores", extra=_PAIRED | {
            "subsets": f"SELECT doc_id, metric, source AS subset, delta FROM paired WHERE {where} UNION ALL SELECT doc_id, metric, 'combined', delta FROM paired WHERE {where}",
            "placed": """SELECT metric, subset, delta, count(*) OVER g AS n, avg(delta) OVER g AS mean, row_number() OVER (g ORDER BY doc_id, delta) - 1 AS idx
                FROM subsets WHERE delta IS NOT NULL WINDOW g AS (PARTITION BY metric, subset)""",
            "z0": f"""SELECT n, r, (42::UHUGEINT + (r * n + i + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) & {bits} AS z
                FROM (SELECT DISTINCT n FROM placed), range({resamples}) AS x(r), unnest(range(n)) AS y(i)""",
            "z1": f"SELECT n, r, (xor(z, z >> 30::UHUGEINT) * 13787848793156543929::UHUGEINT) & {bits} AS z FROM z0",
            "z2": f"SELECT n, r, (xor(z, z >> 27::UHUGEINT) * 10723151780598845931::UHUGEINT) & {bits} AS z FROM z1",
            "drawn": "SELECT n, r, ((xor(z, z >> 31::UHUGEINT) * n::UHUGEINT) >> 64::UHUGEINT)::BIGINT AS idx FROM z2",
            "counted": "SELECT n, r, idx, count(*) AS c FROM drawn GROUP BY n, r, idx",
            "resampled": """SELECT metric, subset, r, any_value(p.n) AS n, any_value(mean) AS mean, sum(delta * c) AS total
                FROM placed p JOIN counted USING (n, idx) GROUP BY metric, subset, r"""})


@check("paired_bootstrap", _bootstrap_sql("true", 200))
def paired_bootstrap(spark, d):
    """All metrics and subsets, with 200 resamples; ``compare_intervals`` has the default number."""
    return rounded(C.paired_bootstrap(C.subset_rows(paired(spark, d)), ["metric", "subset"], resamples=200))


@check("compare_intervals", _bootstrap_sql("metric = 'composite'", 10_000))
def compare_intervals(spark, d):
    """The intervals of a comparison at the default 10,000 resamples, for the composite in every subset."""
    return rounded(C.paired_bootstrap(C.subset_rows(paired(spark, d, ("composite",))), ["metric", "subset"]))


@check("compare_rows")
def compare_rows(spark, d):
    """All metrics with the default 10,000 resamples."""
    return C.ordered_comparison(C.compare_rows(paired(spark, d)))


@check("compare_shown", sql("""
    SELECT metric, CASE WHEN subset = 'combined' AND f IS NULL THEN 'synthetic' WHEN subset = 'combined' AND s IS NULL THEN 'fatura'
                        ELSE subset END AS subset, n, round(mean, 6) + 0.0e0 AS mean
    FROM (SELECT metric, subset, count(delta) AS n, avg(delta) AS mean,
                 max(CASE WHEN subset = 'fatura' THEN avg(delta) END) OVER (PARTITION BY metric) AS f,
                 max(CASE WHEN subset = 'synthetic' THEN avg(delta) END) OVER (PARTITION BY metric) AS s
          FROM paired CROSS JOIN (VALUES ('fatura'), ('synthetic'), ('combined')) AS x(subset)
          WHERE delta IS NOT NULL AND (subset = source OR subset = 'combined') GROUP BY metric, subset)
    WHERE subset = 'combined' OR sign(round(f, 12)) * sign(round(s, 12)) < 0""", "judged_scores", extra=_PAIRED))
def compare_shown(spark, d):
    """Which rows a comparison shows, without intervals."""
    known = paired(spark, d).where("delta IS NOT NULL")
    means = Y.by_subset(known, ["metric"], {"mean": F.col("delta")}, {"n": F.col("delta")}).drop("docs")
    return rounded(C.shown_rows(means.withColumn("mean", F.round("mean", 12))))


# ---------- gate ----------

_THRESHOLDS = (("composite", "combined", 0.01), ("total_accuracy", "combined", 0.0001), ("line_items_f1", "synthetic", 0.03),
               ("line_items_f1", "fatura", 0.03))
_GATED = ("composite", "total_accuracy", "line_items_f1")


def thresholds(spark):
    return spark.createDataFrame([(*row, i) for i, row in enumerate(_THRESHOLDS)], "metric string, subset string, maxDrop double, position int")


def _cells(spark, d):
    """One row per run and subset with the gated columns."""
    return Y.by_subset(t.judged_scores(spark, d), RUN, {
        "composite": F.col("composite"), "total_accuracy": A.accuracy_value("total"), "line_items_f1": F.col("line_items_f1")})


def baseline_and_current(spark, d):
    rows = _cells(spark, d)
    old = rows.where("execution = '20260101T000000Z-aaa'")
    # A configuration that was dropped since, to be missing from the current run.
    gone = old.withColumn("config", F.lit("retired"))
    return G.summary_cells(old.unionAll(gone), list(_GATED)), G.summary_cells(rows.where("execution = '20260201T000000Z-bbb'"), list(_GATED))


_GATE = {
    "cells0": f"""SELECT execution, config, subset, avg(composite) AS composite, avg({score('outcome_total')}) AS total_accuracy,
        avg(line_items_f1) AS line_items_f1 FROM scores CROSS JOIN (VALUES ('fatura'), ('synthetic'), ('combined')) AS x(subset)
        WHERE subset = source OR subset = 'combined' GROUP BY execution, config, subset""",
    "cells": " UNION ALL ".join(f"SELECT execution, config, subset, '{m}' AS metric, round({m}, 4) AS value FROM cells0" for m in _GATED),
    "thresholds": "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{s}', {x}e0)" for m, s, x in _THRESHOLDS) + ") AS v(metric, subset, max_drop)",
    "base": """SELECT config, subset, metric, value FROM cells WHERE execution LIKE '%aaa'
        UNION ALL SELECT 'retired', subset, metric, value FROM cells WHERE execution LIKE '%aaa'""",
    "cur": "SELECT config, subset, metric, value FROM cells WHERE execution LIKE '%bbb'",
    "joined": """SELECT coalesce(b.config, c.config) AS config, metric, subset, b.value AS baseline, c.value AS current, max_drop,
        b.config IS NOT NULL AS hb, c.config IS NOT NULL AS hc,
        coalesce(b.config, c.config) IN (SELECT config FROM base) AS cb, coalesce(b.config, c.config) IN (SELECT config FROM cur) AS cc
        FROM base b FULL JOIN cur c USING (config, subset, metric) JOIN thresholds USING (metric, subset)""",
}


@check("gate", sql("SELECT config, metric, subset, baseline, current, max_drop, hb AS has_baseline, hc AS has_current FROM joined", "scores", extra=_GATE))
def gate(spark, d):
    base, cur = baseline_and_current(spark, d)
    return G.gate(base, cur, thresholds(spark)).select(
        "config", "metric", "subset", "baseline", "current", "max_drop", "has_baseline", "has_current")


@check("gate_verdicts", sql("""
    SELECT config, metric, subset, baseline, current, max_drop, result, result LIKE '❌%' AS breach FROM (
      SELECT *, CASE WHEN NOT hb AND NOT cb THEN 'new config, no baseline' WHEN NOT hb THEN 'no baseline'
                     WHEN NOT hc AND NOT cc THEN '❌ config not run' WHEN baseline IS NULL THEN 'n/a' WHEN current IS NULL THEN '❌ missing'
                     WHEN baseline - current > max_drop + 1e-9 THEN '❌ regression' ELSE '✅' END AS result FROM joined)""", "scores", extra=_GATE))
def gate_verdicts(spark, d):
    base, cur = baseline_and_current(spark, d)
    return G.gate_verdicts(G.gate(base, cur, thresholds(spark)))


@check("promote_baseline", sql("""
    SELECT config, subset, metric, value FROM cur JOIN thresholds USING (metric, subset)""", "scores", extra=_GATE))
def promote_baseline(spark, d):
    return G.promote_baseline(baseline_and_current(spark, d)[1], thresholds(spark))
