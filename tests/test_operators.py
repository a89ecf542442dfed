import hashlib
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tallymark.functions.answers import parse_verdict, warnings_of
from tallymark.functions.hashing import hash_draw
from tallymark.operators import agent, calibrate, convert, exchange, gate, judge, summary
from tallymark.operators.currency import normalize_currency
from tallymark.operators.exchange import replay_join, request_fingerprint
from tallymark.operators.sampling import holdout_strata, stratified_sample
from tallymark.schemas import AGENT_METRICS, FIELDS, JUDGED_FIELDS
from tallymark.session import scratch_path
from tallymark.sources import readers, writers

TH = "metric string, subset string, maxDrop double, position int"
CELL = "config string, subset string, metric string, value double"


def verdicts(spark, baseline, current, thresholds=(("composite", "combined", 0.01, 0), ("line_items_f1", "synthetic", 0.03, 1))):
    cells = gate.gate(spark.createDataFrame(baseline, CELL), spark.createDataFrame(current, CELL), spark.createDataFrame(thresholds, TH))
    return {(r.config, r.metric): r for r in gate.gate_verdicts(cells).collect()}


def test_gate_arms(spark):
    rows = verdicts(spark, [("a", "combined", "composite", 0.900), ("a", "synthetic", "line_items_f1", 0.8), ("old", "combined", "composite", None),
                            ("n", "combined", "composite", 0.9), ("z", "synthetic", "line_items_f1", None)],
                    [("a", "combined", "composite", 0.890), ("a", "synthetic", "line_items_f1", 0.76), ("new", "combined", "composite", 0.1),
                     ("n", "combined", "composite", None), ("z", "synthetic", "line_items_f1", None), ("z", "combined", "composite", 1.0)])
    got = {k: (r.result.split(" ", 1)[-1] if r.breach else r.result, r.breach) for k, r in rows.items()}
    assert got == {
        ("a", "composite"): ("✅", False), ("a", "line_items_f1"): ("regression", True), ("old", "composite"): ("config not run", True),
        ("new", "composite"): ("new config, no baseline", False), ("n", "composite"): ("missing", True),
        ("z", "line_items_f1"): ("n/a", False), ("z", "composite"): ("no baseline", False)}


def test_sample_sizes_and_order_independence(spark):
    rows = spark.createDataFrame([(f"k{i}", f"s{i % 5}") for i in range(100)], "key string, stratum string")
    taken = stratified_sample(rows, "key", "stratum", 12, 42).collect()
    assert sorted(map(len, [[r for r in taken if r.stratum == f"s{j}"] for j in range(5)])) == [2, 2, 2, 3, 3]
    again = stratified_sample(rows.orderBy(F.desc("key")).repartition(7), "key", "stratum", 12, 42).collect()
    assert sorted(taken) == sorted(again)
    held, rest = holdout_strata(rows, "stratum", 2, 42)
    assert held.count() == 40 and rest.count() == 60


def test_short_strata_are_not_topped_up(spark):
    rows = spark.createDataFrame([("a", "x")] + [(f"b{i}", "y") for i in range(50)], "key string, stratum string")
    assert sorted(r.stratum for r in stratified_sample(rows, "key", "stratum", 20, 1).collect()) == ["x"] + ["y"] * 10
    assert stratified_sample(rows, "key", "stratum", 0, 1).count() == 0
    assert stratified_sample(rows, "key", "stratum", 500, 1).count() == 51


def test_samples_of_many_strata_equal_plain_ranking(spark):
    sha = lambda x: hashlib.sha256(f"5:{x}".encode()).hexdigest()
    data = [(f"k{i}", f"s{i % 97}" if i % 10 else "hot", i) for i in range(5_000)]
    rows = spark.createDataFrame(data, "key string, stratum string, _n int")
    for count in (40, 97, 300, 4_000):
        strata = sorted({s for _, s, _ in data}, key=sha)
        each, more = divmod(count, len(strata))
        want = set()
        for place, stratum in enumerate(strata):
            want |= set(sorted((k for k, s, _ in data if s == stratum), key=sha)[:each + (place < more)])
        sample = stratified_sample(rows, "key", "stratum", count, 5)
        assert sample.columns == rows.columns and {r.key for r in sample.collect()} == want


def test_documented_holdout(spark):
    rows = spark.createDataFrame([(f"Template{i}",) for i in range(1, 51)], "layout string")
    held, _ = holdout_strata(rows, "layout", 5, 42)
    assert sorted(int(r.layout[8:]) for r in held.collect()) == [2, 25, 28, 29, 48]


def test_hash_draw(spark):

    rows = spark.range(200).select("id", hash_draw(9, F.concat(F.lit("k"), "id"), 4, 37).alias("d")).collect()
    for r in rows:
        assert r.d == int.from_bytes(hashlib.sha256(f"9:k{r.id}:4".encode()).digest()[:8], "little") % 37


@pytest.mark.parametrize("text,code", [
    ("usd", "USD"), (" EUR ", "EUR"), ("€", "EUR"), ("US Dollars", "USD"), ("CA$", "CAD"), ("swiss  francs", "CHF"), ("$", None),
    ("kr", None), ("dollars", None), ("ABC", None), ("beads", None), ("", None)])
def test_currency(spark, text, code):
    row = normalize_currency(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert row.code == code
    if text in ("$", "kr", "dollars"):
        assert row.reason.startswith("Several readings: ")
    if text == "ABC":
        assert "not known" in row.reason


def test_verdict_and_warnings(spark):
    cases = [('{"reason":" r ","equivalent":true}', True, "r"), ("```json\n{\"equivalent\":\"False\"}\n```", False, ""), ('{"Equivalent":true}', True, ""),
             ("", None, None), ("yes", None, None), ('{"equivalent":1}', None, None), ('{"equivalent":tru}', None, None)]
    rows = spark.createDataFrame([(c[0],) for c in cases], "t string").select(parse_verdict(F.col("t")).alias("v")).select("v.*").collect()
    for (_, flag, reason), row in zip(cases, rows):
        assert row.equivalent == flag
        assert row.reason == reason if flag is not None else row.reason.endswith(".")
    w = spark.createDataFrame([('{"warnings":["a",3,"b"]}',), ('{"warnings":{}}',), ("x",)], "t string").select(warnings_of(F.col("t")))
    assert [r[0] for r in w.collect()] == [["a", "b"], [], []]


def test_final_answer_prefers_the_last_that_parses(spark):
    rows = spark.createDataFrame([
        (1, 0, "assistant", '{"total":1}'), (1, 1, "assistant", '{"total":2}'), (1, 2, "assistant", "done"), (1, 3, "assistant", " "),
        (2, 0, "assistant", "first"), (2, 1, "assistant", "second"), (3, 0, "user", "a"), (3, 1, "tool", "b")], "doc_id long, turn long, role string, text string")
    got = {r.doc_id: (r.text, r.parses) for r in agent.final_answer(rows).collect()}
    assert got == {1: ('{"total":2}', True), 2: ("second", False), 3: ("ab", False)}


def test_converted_annotation(spark):
    span = lambda text: {"text": text, "bbox": [[10.0, 20.0], [60.0, 26.0]]}
    good = {"TABLE": [[{"bbox": [[0, 0], [9, 9]]}]], "DATE": span("Issued 19-Oct-2021"), "TOTAL": span("Sum 88.40 EUR"),
            "TAX": span("Tax 3.10"), "GST(7%)": span("GST(7%) 1.30"), "NUMBER": span("Doc No. Q-77"),
            "BUYER": span("Buyer :Nadia Koval\n7 Quay Road\nHarborview, TX 40417 US\nfax 12")}
    bad = [{"DATE": span("due date 02-Feb-2022")}, {"TOTAL": span("5.00 USD"), "AMOUNT_DUE": span("5.00 EUR")}, {"SUB_TOTAL": span("open")}]
    rows = spark.createDataFrame([(f"Layout{i}_a", json.dumps(a)) for i, a in enumerate([good, *bad])], "name string, raw string")
    ok, rejected = convert.ingest_annotations(rows)
    i = ok.first().invoice
    assert (i.vendor, i.customer.name, i.customer.address.city, i.customer.address.postalCode) == (None, "Nadia Koval", "Harborview", "40417")
    assert (i.invoiceNumber, str(i.invoiceDate), i.currency, float(i.tax), float(i.total), i.subtotal) == ("Q-77", "2021-10-19", "EUR", 4.4, 88.4, None)
    reasons = {r.layout: r.reject_reason for r in rejected.collect()}
    assert reasons == {"Layout1": "DATE carries a due-date label: 'due date 02-Feb-2022'.",
                       "Layout2": "Several currencies printed: USD, EUR.", "Layout3": "SUB_TOTAL: no number in 'open'."}


def test_odd_annotations_become_values_or_rejects(spark):
    raws = ['{"TOTAL": {"text": "1.00"}, "TOTAL": {"text": "2.00"}}', '{"NUMBER": {"text": "N 1", "bbox": [[1, 2]]}, "DATE": {"text": "3-Mar-2020", "bbox": [[1, 2], [3]]}, "TAX": {"text": "4", "bbox": [[1, 9], [2, 3]]}}',
            '{"TOTAL": 5}', '{"TOTAL": {"text": "2.00"}, "TOTAL": "x"}', "[]", "", None]
    rows = spark.createDataFrame([(f"L{i}_a", r) for i, r in enumerate(raws)], "name string, raw string")
    got = {r.name: r for r in convert.convert_annotations(rows).collect()}
    assert float(got["L0_a"].invoice.total) == 2.0 and got["L2_a"].invoice.total is None and got["L3_a"].invoice.total is None
    assert all((r.invoice is None) != (r.reject_reason is None) for r in got.values())
    order = convert.with_spans(rows).select("name", convert.reading_order(F.col("spans")).alias("t")).where("name = 'L1_a'").first()
    assert order.t == "4\n"


def test_tool_results_are_read_as_a_whole(spark):
    results = [("a", '{"consistent":false,"difference":"oops","reconciledTotal":9}'), ("b", '{"Consistent":false,"ReconciledTotal":9}'),
               ("c", '{"consistent":true} tail'), ("d", '{"consistent":true,"reconciledTotal":null}'), ("e", "[1]"), ("f", None),
               ("g", '{"consistent":true,"reconciledTotal":4}'), ("g", '{"consistent":true,"reconciledTotal":5}')]
    calls = spark.createDataFrame([(1, c) for c in "abcdefgh"], "doc_id int, call_id string")
    read = agent.tool_results_join(calls, spark.createDataFrame([(1, *r) for r in results], "doc_id int, call_id string, result string"))
    got = {r.call_id: (r.consistent, r.reconciled_total and float(r.reconciled_total)) for r in read.collect()}
    assert read.count() == 8
    assert got == {"a": (None, None), "b": (False, 9.0), "c": (None, None), "d": (True, None), "e": (None, None), "f": (None, None), "g": (True, 4.0), "h": (None, None)}


def test_verdicts_leave_other_rows_alone(spark):
    rows = spark.createDataFrame([(i, "vendor_name", "Acme Ltd", f"Other {i}" if i == 0 else "Acme Ltd", "mismatch" if i == 0 else None) for i in range(50)],
                                 "doc_id int, field string, golden string, predicted string, outcome string")
    verdicts = spark.createDataFrame([("none", "{}")], "pair_id string, response_text string")
    got = judge.verdict_join(rows, verdicts, F.lit(True))
    assert got.count() == 50


def test_calibration_pairs_hold_their_guarantees(spark):
    names = [(f"d{i}", "vendor_name", n) for i, n in enumerate([
        "Acme International Ltd", "Kelly-Moss", "Blue Mountain Foods Inc.", "Saint Mary Services", "Olsen, Group", "Delta Systems GmbH"])]
    names += [(f"c{i}", "customer_name", n) for i, n in enumerate(["Jane Doe", "Brian Miller", "Pamela Harris", "Denise Perez"])]
    names = spark.createDataFrame(names, "doc_id string, field string, name string")
    real = spark.createDataFrame([("d0", "vendor_name", "Acme International Ltd", "Acme Intl.", "b"), ("d0", "vendor_name", "Acme International Ltd", "Acme Intl.", "a"),
                                  ("d1", "vendor_name", "Kelly-Moss", "kelly moss inc", "a")], "doc_id string, field string, golden string, predicted string, config string")
    pairs = calibrate.calibration_pairs(real, names, 60, 42).collect()
    again = calibrate.calibration_pairs(real.repartition(3), names.repartition(3), 60, 42).collect()
    assert sorted(pairs) == sorted(again)
    assert 40 <= len(pairs) <= 60 and len({p.id for p in pairs}) == len(pairs)
    assert [p.origin for p in pairs if p.origin.startswith("run:")] == ["run:a,b"]  # the other one only differs by a legal form
    kinds = {p.origin for p in pairs}
    assert {f"synthetic:{k}" for k in calibrate.KINDS} <= kinds
    zone = spark.createDataFrame([(p.golden, p.predicted) for p in pairs], "g string, p string")
    assert zone.where(~judge.gray_zone(F.col("g"), F.col("p"))).count() == 0
    table = spark.createDataFrame(pairs).withColumn("excerpt", F.lit("")).withColumn("human_label", F.lit(None).cast("boolean"))
    before = spark.createDataFrame([(pairs[0].id, True), ("gone", False)], "id string, human_label boolean")
    merged, dropped = calibrate.label_carry_over(table, before)
    assert merged.where("human_label").count() == 1 and dropped.first().dropped == 1


@pytest.mark.parametrize("kind,name,want", [
    (calibrate.ABBREVIATION, "Acme International, Ltd", r"Acme Intl\., Ltd"), (calibrate.ABBREVIATION, "Acme Intl. Ltd", "Acme International Ltd"),
    (calibrate.ABBREVIATION, "Jane Doe", r"J\. Doe"), (calibrate.REORDERED, "Jane Doe", "Doe, Jane"), (calibrate.REORDERED, "A B, C", "C A B,"),
    (calibrate.LEGAL_SUFFIX, "Acme.", r"Acme[ ,].+"), (calibrate.SUBSTRING_TRAP, "Acme", r"(North|New|United) Acme|Acme \w.+"), (calibrate.OCR_NOISE, "Solis Global", r"(?!Solis Global$).+")])
def test_perturbations(spark, kind, name, want):
    rows = spark.createDataFrame([("d", "vendor_name", name)], "doc_id string, field string, name string")
    assert re.fullmatch(want, calibrate.perturb(rows, kind, 3).first().predicted)


def test_unlabelled_pair_stops_the_report(spark):
    pairs = spark.createDataFrame([("p-1", "run:a", True), ("p-2", "run:a", None)], "id string, origin string, human_label boolean")
    none = spark.createDataFrame([], "pair_id string, response_text string")
    with pytest.raises(Exception, match="human_label"):
        judge.calibration_report(pairs, none)[0].collect()


def test_replay_keeps_latency_and_lists_misses(spark):
    req = spark.createDataFrame([("d1", "m", "hi", "", ""), ("d2", "m", "hi", "", "changed")], "doc_id string, model string, messages string, options string, tools string")
    stored = req.where("doc_id = 'd1'").select(request_fingerprint().alias("fingerprint"), F.lit("{}").alias("response_text"), F.lit(12.5).alias("latency_ms"))
    served, misses = replay_join(req, stored)
    assert [(r.doc_id, r.latency_ms) for r in served.collect()] == [("d1", 12.5)]
    assert [r.doc_id for r in misses.collect()] == ["d2"]


def test_gate_files_round_trip(spark, tmp_path):
    """Two configurations in three executions; a cell without a value lies between two that have one."""
    summary = tmp_path / "report.csv"
    summary.write_text("\n".join([
        "config,execution,subset,line_items_f1,docs,schema_validity",
        'wide,20251105T080000Z-c1,combined,0.8125,40,0.9750', "wide,20251105T080000Z-c1,synthetic,,8,1.0000",
        "narrow,20251103T200000Z-b9,combined,0.9900,40,0.9900", "narrow,20251104T200000Z-b9,combined,0.5000,40,0.8500",
        "narrow,20251104T200000Z-b9,synthetic,0.2500,8,", ""]))
    limits = tmp_path / "limits.json"
    limits.write_text(json.dumps({"thresholds": [
        {"metric": "schema_validity", "subset": "combined", "maxDrop": 0.1}, {"metric": "line_items_f1", "subset": "synthetic", "maxDrop": 0.0},
        {"metric": "line_items_f1", "subset": "combined", "maxDrop": 0.3}]}))
    thresholds = readers.read_thresholds(spark, str(limits))
    cells = readers.read_summary_csv(spark, str(summary), thresholds)
    held = {(r.config, r.subset, r.metric): r.value for r in cells.collect()}
    assert held["narrow", "combined", "line_items_f1"] == 0.5 and held.get(("wide", "synthetic", "line_items_f1")) is None
    out = str(tmp_path / "kept")
    writers.write_baseline(cells, thresholds, out)
    lines = "".join(p.read_text() for p in sorted((tmp_path / "kept").glob("part-*"))).splitlines()
    of = lambda config: [x.split(",")[1:] for x in lines if x.startswith(config)]
    assert lines[0] == "config,subset,metric,value" and [x.split(",")[0] for x in lines[1:]] == ["narrow"] * 3 + ["wide"] * 3
    assert of("narrow") == [["combined", "schema_validity", "0.8500"], ["synthetic", "line_items_f1", "0.2500"], ["combined", "line_items_f1", "0.5000"]]
    assert of("wide") == [["combined", "schema_validity", "0.9750"], ["synthetic", "line_items_f1", ""], ["combined", "line_items_f1", "0.8125"]]
    same = gate.gate_verdicts(gate.gate(readers.read_baseline_csv(spark, out), cells, thresholds)).collect()
    assert sorted(r.result for r in same if r.config == "wide") == ["n/a", "✅", "✅"] and not any(r.breach for r in same)
    with pytest.raises(ValueError, match="no_such_metric"):
        readers.read_summary_csv(spark, str(summary), spark.createDataFrame([("no_such_metric", "combined", 0.1, 0)], TH))
    (tmp_path / "torn.csv").write_text("config,value\nwide,1\n")
    with pytest.raises(ValueError, match="expected header"):
        readers.read_baseline_csv(spark, str(tmp_path / "torn.csv"))
    limits.write_text('{"thresholds": []}')
    with pytest.raises(ValueError, match="no thresholds"):
        readers.read_thresholds(spark, str(limits))


def test_stored_runs_are_pruned_to_the_latest(spark, tmp_path):
    rows = [("c1", f"2026010{d}T000000Z-a", i, d / 10) for d in (1, 2, 3) for i in range(4)] + [("20", "20260101T000000Z-b", i, 0.5) for i in range(3)]
    scores = spark.createDataFrame(rows, "config string, execution string, doc_id long, composite double")
    path = str(tmp_path / "scores")
    summary.store_scores(scores, path)
    summary.store_scores(scores.where("execution like '20260103%'").withColumn("composite", F.lit(0.9)), path)
    latest = summary.latest_stored(spark, path)
    got = sorted((r.config, r.execution, r.doc_id, r.composite) for r in latest.select("config", "execution", "doc_id", "composite").collect())
    assert got == [("20", "20260101T000000Z-b", i, 0.5) for i in range(3)] + [("c1", "20260103T000000Z-a", i, 0.9) for i in range(4)]
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [" in plan and "<=> c1" in plan.split("PartitionFilters")[1]


def test_both_sides_of_a_replay_come_from_one_join(spark):
    requests = spark.createDataFrame([(i, "m", f"p{i % 3}", "o", "t") for i in range(9)], "id int, model string, messages string, options string, tools string")
    keys = requests.select(exchange.request_fingerprint().alias("fingerprint"), "messages").distinct().where("messages <> 'p1'")
    served, misses = exchange.replay_join(requests, keys.select("fingerprint", F.concat(F.lit("r-"), "messages").alias("response_text"), F.lit(3.0).alias("latency_ms")))
    assert sorted((r.id, r.response_text) for r in served.collect()) == [(i, f"r-p{i % 3}") for i in range(9) if i % 3 != 1]
    assert sorted(r.id for r in misses.collect()) == [1, 4, 7] and misses.columns == ["id", "fingerprint"]
    for side in (served, misses):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan and "PartitionFilters: [" in plan


def test_a_summary_always_has_its_columns(spark):
    from tallymark.operators.summary import summary as summarise

    base = {"execution": "e", "config": "c", "model": "m", "prompt": "p", "input_mode": "text", "doc_id": 1, "source": "fatura", "latency_ms": 5.0,
            "input_tokens": 1, "output_tokens": 1, "thinking_tokens": 0, "schema_validity": 1.0, "recomputed_total_rate": None, "line_items_precision": 1.0,
            "line_items_recall": 1.0, "line_items_f1": 1.0, "composite": 1.0}
    base |= {f"outcome_{f}": "correct_value" for f in FIELDS}
    kind = ", ".join(f"{k} {'string' if isinstance(v, str) else 'long' if isinstance(v, int) else 'double'}" for k, v in base.items())
    prices = spark.createDataFrame([("m", 1.0, 2.0)], "model string, input_per_mtok double, output_per_mtok double")
    bare = summarise(spark.createDataFrame([tuple(base.values())], kind), prices)
    more = {f"judged_{f}": "correct_value" for f in JUDGED_FIELDS} | {m: 0.5 for m in AGENT_METRICS.values()}
    full = spark.createDataFrame([(*base.values(), *more.values())], kind + ", " + ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in more.items()))
    whole = summarise(full, prices)
    assert bare.columns == whole.columns and bare.dtypes == whole.dtypes
    a, b = bare.where("subset = 'combined'").first(), whole.where("subset = 'combined'").first()
    for column in AGENT_METRICS:
        assert (a[column], a[f"{column}_n"], b[column], b[f"{column}_n"]) == (None, 0, 0.5, 1)
    assert all(a[f"{f}_judged_accuracy"] is None and b[f"{f}_judged_accuracy"] == 1.0 for f in JUDGED_FIELDS)


def test_slots_take_what_they_would_take_one_after_another(spark):
    rng = random.Random(12)
    for pairs in (3, 12, 40):
        rows = [(slot, attempt, f"p{rng.randrange(pairs)}") for slot in range(25) for attempt in sorted(rng.sample(range(64), rng.randrange(0, 9)))]
        taken, want = set(), {}
        for slot in range(25):
            for _, _, pair in sorted(r for r in rows if r[0] == slot):
                if pair not in taken:
                    taken.add(pair)
                    want[slot] = pair
                    break
        got = calibrate.assigned(spark.createDataFrame(rows, "slot int, attempt int, id string")).collect()
        assert {r.slot: r.id for r in got} == want


def test_latest_rows_are_not_sent_by_run(spark):
    """Sent by configuration and execution, the rows of a run would meet in one task, whatever the size of the list of runs."""
    from tallymark.operators.summary import latest_rows

    rows = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 3), (None, "9", 4)], "config string, execution string, doc_id int")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        latest = latest_rows(rows)
        assert sorted(r.doc_id for r in latest.collect()) == [2, 3]
        plan = latest._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_ocr_noise_against_a_plain_loop(spark):
    """Draws by (seed, key, counter); a name of one file is dealt to all tasks."""
    names = ["Solis Global", "Immense Gnome Mmm", "zzz", "Böhm & Söhne", "a", "  Omega  ", "X" * 40 + "o", "mmmmmm"]
    rows = spark.createDataFrame([(i, "vendor_name", n) for i, n in enumerate(names)], "doc_id int, field string, name string").coalesce(1)
    got = calibrate.perturb(rows, calibrate.OCR_NOISE, 3)

    def draw(key, counter, n):
        return int.from_bytes(hashlib.sha256(f"3:{key}:{counter}".encode()).digest()[:8], "little") % n

    for r in got.collect():
        key, text = f"ocr_noise:vendor_name:{r.golden}", r.golden.strip()
        for e in range(draw(key, 1, calibrate.MAX_OCR_EDITS) + 1):
            places = [draw(key, 100 + e * calibrate.OCR_ATTEMPTS + a, len(text)) for a in range(calibrate.OCR_ATTEMPTS)]
            at = next((p for p in places if text[p] in calibrate.CONFUSABLES), None)
            if at is not None:
                text = text[:at] + calibrate.CONFUSABLES[text[at]] + text[at + 1:]
        assert r.predicted == text
    assert got.count() == len(names)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_stored_results_are_written_compressed(spark, monkeypatch):
    from driver_checks import io, tables

    rows = spark.range(100).selectExpr(
        "'e' execution", "'c' config", "'m' model", "'p' prompt", "'text' input_mode", "'fatura' source", "'Template1' layout", "id doc_id",
        "0.5 + id % 2 composite", "cast(id % 2 as double) schema_validity", "'miss' outcome_total", "1.5D latency_ms", "id input_tokens",
        "1L output_tokens", "2L thinking_tokens", "id % 2 = 0 cache_hit")
    made = []
    monkeypatch.setattr(tables, "judged_scores", lambda spark, d: rows)
    monkeypatch.setattr(io, "scratch_path", lambda spark, name: made.append(scratch_path(spark, name)) or made[-1])
    flat = io.flatten_results(spark, "unused").orderBy("input_tokens", "doc_id").collect()
    assert len(flat) == 100 and {r.total_outcome for r in flat} == {"miss"} and sum(r.errors == "invalid | again" for r in flat) == 50
    files = [f for f in os.listdir(made[0]) if f.startswith("part-")]
    assert files and all(f.endswith(".gz") for f in files)
