"""The same derived tables in SQL, as named common table expressions."""

from __future__ import annotations

from driver_checks.tables import PRICES, RUNS
from tallymark.functions.names import LEGAL_FORMS
from tallymark.schemas import FIELDS

_FORMS = "|".join(sorted(LEGAL_FORMS, key=lambda f: -len(f.split())))


def norm(c: str) -> str:
    """Name normalisation, one legal form at a time, twelve times over."""
    words = f"trim(regexp_replace(lower(replace({c}, '&', ' and ')), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'))"
    strip = f"regexp_replace(a, '^(\\S+(?: \\S+)*?) (?:{_FORMS})$', '\\1')"
    return f"list_reduce([{words}] || list_transform(range(12), lambda q: ''), lambda a, b: {strip})"


def toks(c: str) -> str:
    return (f"list_distinct(list_filter(string_split(regexp_replace(lower(coalesce({c}, '')), "
            f"'[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'), ' '), lambda t: t <> ''))")


def jaccard(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(CASE WHEN {union} = 0 THEN 1.0e0 ELSE len(list_intersect({a}, {b}))::DOUBLE / {union} END)"


def _outcome(f: str, equal: str) -> str:
    g, p = f, f"p_{f}"
    return (f"CASE WHEN NOT parsed THEN 'unparsed' WHEN {g} IS NULL AND {p} IS NULL THEN 'correct_null' "
            f"WHEN {g} IS NULL THEN 'false_positive' WHEN {p} IS NULL THEN 'miss' "
            f"WHEN {equal} THEN 'correct_value' ELSE 'mismatch' END AS outcome_{f}")


def _equal(f: str) -> str:
    if f in ("subtotal", "discount", "tax", "total"):
        return f"abs({f} - p_{f}) <= 1"
    if f.endswith("_date"):
        return f"{f} = p_{f}"
    if f.endswith("_name"):
        return f"{norm(f)} = {norm('p_' + f)}"
    return f"upper(trim({f})) = upper(trim(p_{f}))"


def score(outcome: str) -> str:
    return f"(CASE WHEN {outcome} IN ('correct_value', 'correct_null') THEN 1.0e0 WHEN {outcome} IS NOT NULL THEN 0.0e0 END)"


_RUN_ROWS = ", ".join(f"('{c}', '{e}', '{mo}', '{p}', '{i}', {m})" for c, e, mo, p, i, m in RUNS)
_PRICE_ROWS = ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in PRICES)
_MEAN = " + ".join(score(f"outcome_{f}") for f in FIELDS)

# name -> (SQL, names it uses)
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "prices": (f"SELECT * FROM (VALUES {_PRICE_ROWS}) AS v(model, input_per_mtok, output_per_mtok)", ()),
    "lines": ("""
        SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_suppkey,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS amount, CAST(round(l_discount * 100) AS BIGINT) AS pct_d,
               CAST(round(l_tax * 100) AS BIGINT) AS pct_t, p_name || ' ' || p_type AS description
        FROM lineitem JOIN part ON p_partkey = l_partkey""", ()),
    "totals": ("""
        SELECT doc_id, CAST(sum(amount) AS BIGINT) AS subtotal,
               CAST(sum((amount * pct_d + 50) // 100) AS BIGINT) AS all_discount,
               CAST(sum((amount * pct_t + 50) // 100) AS BIGINT) AS all_tax, min(l_suppkey) AS suppkey,
               list({'description': description, 'amount': amount}
                    ORDER BY l_linenumber, l_partkey, l_suppkey, amount, description) AS l
        FROM lines GROUP BY doc_id""", ("lines",)),
    "golden0": ("""
        SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 6 = 0 THEN 'synthetic' ELSE 'fatura' END AS source,
               o_orderpriority AS layout, c_name, subtotal,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE all_discount END AS discount,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE all_tax END AS tax,
               CAST(round(o_totalprice * 100) AS BIGINT) AS printed,
               CASE WHEN o_orderkey % 11 = 4 THEN NULL ELSE 'INV-' || o_orderkey END AS invoice_number,
               CAST(o_orderdate AS DATE) AS invoice_date,
               CASE WHEN o_orderkey % 9 = 2 THEN NULL
                    ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 61 - 10 AS INTEGER) END AS due_date,
               CASE WHEN o_orderkey % 13 = 5 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'USD'
                    WHEN o_orderkey % 3 = 1 THEN 'EUR' ELSE 'GBP' END AS currency,
               c_name || ([' Inc.', ' GmbH & Co. KG', ' Intl.', ''])[o_orderkey % 4 + 1] AS customer_name,
               CASE WHEN o_orderkey % 17 = 6 THEN NULL
                    ELSE s_name || ([' Ltd', ', S.A.', ''])[o_orderkey % 3 + 1] END AS vendor_name, l
        FROM orders JOIN totals ON doc_id = o_orderkey JOIN customer ON c_custkey = o_custkey
             JOIN supplier ON s_suppkey = suppkey""", ("totals",)),
    "golden": ("""
        SELECT doc_id, source, layout,
               CASE WHEN source = 'fatura' THEN 'golden/' || doc_id || '.ocr.txt' END AS ocr_path,
               c_name, invoice_number, invoice_date, due_date, currency, subtotal, discount, tax,
               CASE WHEN source = 'fatura' THEN printed ELSE subtotal - coalesce(discount, 0) + coalesce(tax, 0) END AS total,
               vendor_name, customer_name, CASE WHEN source = 'synthetic' THEN l END AS line_items
        FROM golden0""", ("golden0",)),
    "runs": (f"SELECT * FROM (VALUES {_RUN_ROWS}) AS v(config, execution, model, prompt, input_mode, m)", ()),
    "answers0": ("""
        SELECT *, doc_id % m AS r, doc_id % (m + 20) <> 3 AS parsed FROM golden CROSS JOIN runs""", ("golden", "runs")),
    "answers": ("""
        SELECT *,
          CASE WHEN r = 10 THEN lower(invoice_number) WHEN r = 4 THEN coalesce(invoice_number, 'X-1') ELSE invoice_number END AS p_invoice_number,
          CASE WHEN r = 5 THEN invoice_date + 1 ELSE invoice_date END AS p_invoice_date,
          CASE WHEN r = 7 THEN NULL WHEN r = 8 THEN coalesce(due_date, invoice_date) ELSE due_date END AS p_due_date,
          CASE WHEN r = 3 THEN lower(currency) WHEN r = 9 THEN 'USD' ELSE currency END AS p_currency,
          CASE r WHEN 1 THEN subtotal + 1 WHEN 2 THEN subtotal + 2 WHEN 3 THEN NULL ELSE subtotal END AS p_subtotal,
          CASE r WHEN 4 THEN coalesce(discount, subtotal // 10) WHEN 5 THEN NULL ELSE discount END AS p_discount,
          CASE WHEN r = 8 THEN coalesce(tax, 0) + 5 ELSE tax END AS p_tax,
          CASE r WHEN 6 THEN subtotal - coalesce(discount, 0) + coalesce(tax, 0) WHEN 7 THEN total + 2 ELSE total END AS p_total,
          CASE r WHEN 9 THEN 'Acme ' || vendor_name WHEN 10 THEN NULL ELSE vendor_name END AS p_vendor_name,
          CASE r WHEN 8 THEN upper(c_name) WHEN 9 THEN customer_name || ' Logistics' ELSE customer_name END AS p_customer_name,
          CASE r WHEN 2 THEN line_items[2:]
                 WHEN 4 THEN list_transform(line_items, lambda x: {'description': x.description, 'amount': x.amount + 1})
                 WHEN 5 THEN list_transform(line_items, lambda x: {'description': x.description, 'amount': x.amount + 2})
                 WHEN 6 THEN list_transform(line_items, lambda x: {'description': 'misc item', 'amount': x.amount})
                 WHEN 8 THEN list_reverse(line_items)
                 WHEN 9 THEN list_transform(line_items, lambda x, i: {'description': CASE WHEN i > 1 THEN x.description END, 'amount': x.amount})
                 ELSE line_items END AS p_line_items,
          CAST(100 + (doc_id * 37 + m * 101) % 5000 AS DOUBLE) AS latency_ms,
          500 + (doc_id * 7) % 1000 + m AS input_tokens, 100 + doc_id % 300 AS output_tokens,
          doc_id % 50 AS thinking_tokens, doc_id % 2 = 0 AS cache_hit
        FROM answers0""", ("answers0",)),
    "outcomes": (
        "SELECT *, " + ",\n          ".join(_outcome(f, _equal(f)) for f in FIELDS) + " FROM answers", ("answers",)),
    # Greedy matching, one golden line per step; only annotated documents take part.
    "match_steps": (f"""
        SELECT execution, config, doc_id, 0 AS step, 0 AS matched, line_items AS gold,
               list_transform(CASE WHEN parsed THEN p_line_items ELSE p_line_items[1:0] END,
                    lambda x, i: {{'i': i, 'amount': x.amount, 't': {toks('x.description')}}}) AS pool
        FROM answers WHERE line_items IS NOT NULL
        UNION ALL
        SELECT execution, config, doc_id, step + 1, matched + CASE WHEN best IS NULL THEN 0 ELSE 1 END, gold,
               list_filter(pool, lambda x: best IS NULL OR x.i <> best.i)
        FROM (SELECT *, list_min(list_filter(list_transform(
                   list_filter(pool, lambda x: abs(x.amount - gold[step + 1].amount) <= 1),
                   lambda x: {{'o': -{jaccard('x.t', toks('gold[step + 1].description'))}, 'i': x.i}}),
                   lambda y: y.o <= -0.5e0)) AS best
              FROM match_steps WHERE step < len(gold))""", ("answers",)),
    "matched": ("SELECT execution, config, doc_id, matched FROM match_steps WHERE step = len(gold)", ("match_steps",)),
    "rated": ("""
        SELECT o.*,
          CASE WHEN NOT parsed THEN 0.0e0
               WHEN p_invoice_number IS NULL AND p_invoice_date IS NULL AND p_total IS NULL THEN 0.0e0
               WHEN p_currency IS NOT NULL AND NOT regexp_full_match(p_currency, '[A-Z]{3}') THEN 0.0e0
               WHEN len(list_filter(p_line_items, lambda x: coalesce(trim(x.description), '') = '')) > 0 THEN 0.0e0
               ELSE 1.0e0 END AS schema_validity,
          CASE WHEN parsed AND total IS NOT NULL AND subtotal IS NOT NULL
                    AND abs(total - (subtotal - coalesce(discount, 0) + coalesce(tax, 0))) > 1
               THEN CASE WHEN abs(p_total - total) > 1 AND abs(p_total - (subtotal - coalesce(discount, 0) + coalesce(tax, 0))) <= 1
                         THEN 1.0e0 ELSE 0.0e0 END END AS recomputed_total_rate,
          CASE WHEN line_items IS NULL THEN NULL ELSE len(line_items) END AS n_gold,
          CASE WHEN line_items IS NULL THEN NULL WHEN parsed THEN len(p_line_items) ELSE 0 END AS n_pred,
          m.matched
        FROM outcomes o LEFT JOIN matched m USING (execution, config, doc_id)""", ("outcomes", "matched")),
    "rated2": ("""
        SELECT *,
          CASE WHEN n_gold IS NULL THEN NULL WHEN n_pred = 0 THEN CASE WHEN n_gold = 0 THEN 1.0e0 ELSE 0.0e0 END
               ELSE matched::DOUBLE / n_pred END AS line_items_precision,
          CASE WHEN n_gold IS NULL THEN NULL WHEN n_gold = 0 THEN CASE WHEN n_pred = 0 THEN 1.0e0 ELSE 0.0e0 END
               ELSE matched::DOUBLE / n_gold END AS line_items_recall
        FROM rated""", ("rated",)),
    "rated3": (f"""
        SELECT *,
          CASE WHEN line_items_precision + line_items_recall = 0 THEN 0.0e0
               ELSE 2 * line_items_precision * line_items_recall / (line_items_precision + line_items_recall) END AS line_items_f1,
          ({_MEAN}) / 10.0e0 AS field_mean
        FROM rated2""", ("rated2",)),
    "scores": ("""
        SELECT *, (0.1e0 * schema_validity + 0.6e0 * field_mean + coalesce(0.2e0 * line_items_f1, 0.0e0)
                   + coalesce(0.1e0 * (1 - recomputed_total_rate), 0.0e0))
                / (0.1e0 + 0.6e0 + CASE WHEN line_items_f1 IS NULL THEN 0.0e0 ELSE 0.2e0 END
                   + CASE WHEN recomputed_total_rate IS NULL THEN 0.0e0 ELSE 0.1e0 END) AS composite
        FROM rated3""", ("rated3",)),
    "mismatches": ("""
        SELECT execution, config, doc_id, 'vendor_name' AS field, vendor_name AS golden, p_vendor_name AS predicted
        FROM outcomes WHERE outcome_vendor_name = 'mismatch' AND NOT (input_mode = 'ocr' AND ocr_path IS NOT NULL)
        UNION ALL
        SELECT execution, config, doc_id, 'customer_name', customer_name, p_customer_name
        FROM outcomes WHERE outcome_customer_name = 'mismatch'""", ("outcomes",)),
    "verdicts": ("""
        SELECT field, golden, predicted, min(doc_id) % 5 AS v,
               'p-' || substr(sha256(field || chr(10) || golden || chr(10) || predicted), 1, 12) AS pair_id
        FROM mismatches GROUP BY field, golden, predicted""", ("mismatches",)),
    "judged": ("""
        SELECT s.*,
          CASE WHEN outcome_vendor_name <> 'mismatch' THEN 'not_needed' WHEN mv.doc_id IS NULL THEN 'not_in_model_input'
               WHEN vv.v IN (0, 3) THEN 'equivalent' WHEN vv.v = 1 THEN 'not_equivalent' ELSE 'unparsed' END AS judge_state_vendor_name,
          CASE WHEN outcome_customer_name <> 'mismatch' THEN 'not_needed'
               WHEN vc.v IN (0, 3) THEN 'equivalent' WHEN vc.v = 1 THEN 'not_equivalent' ELSE 'unparsed' END AS judge_state_customer_name
        FROM scores s
        LEFT JOIN mismatches mv ON mv.field = 'vendor_name' AND mv.execution = s.execution AND mv.config = s.config AND mv.doc_id = s.doc_id
        LEFT JOIN verdicts vv ON vv.field = 'vendor_name' AND vv.golden = mv.golden AND vv.predicted = mv.predicted
        LEFT JOIN mismatches mc ON mc.field = 'customer_name' AND mc.execution = s.execution AND mc.config = s.config AND mc.doc_id = s.doc_id
        LEFT JOIN verdicts vc ON vc.field = 'customer_name' AND vc.golden = mc.golden AND vc.predicted = mc.predicted""",
               ("scores", "mismatches", "verdicts")),
    "judged_scores": ("""
        SELECT *, CASE WHEN judge_state_vendor_name = 'equivalent' THEN 'correct_value' ELSE outcome_vendor_name END AS judged_vendor_name,
               CASE WHEN judge_state_customer_name = 'equivalent' THEN 'correct_value' ELSE outcome_customer_name END AS judged_customer_name
        FROM judged""", ("judged",)),
}


def sql(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the named expressions, and all they use, in front; ``extra`` adds local ones at the end."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for used in CTES[name][1]:
            visit(used)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({CTES[n][0]})" for n in ordered] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    recursive = "RECURSIVE " if "match_steps" in ordered else ""
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + body if parts else body
