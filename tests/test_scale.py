"""Shapes of plans and short cuts that let the larger queries grow with their input."""

import pytest
from pyspark.sql import functions as F

from driver_checks import tables
from tallymark.operators import judge, scoring
from tallymark.session import setting

NAMES = "struct<vendor:struct<name:string>,customer:struct<name:string>>"
SCORED = f"""execution string, config string, doc_id long, input_mode string, ocr_path string, expected {NAMES}, predicted {NAMES},
    outcome_vendor_name string, outcome_customer_name string, composite double"""


def party(vendor, customer):
    return ((vendor,), (customer,))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scored(spark):
    """A document without a mismatch, one with both, one listed twice with different outcomes, one without an id, a run without a name."""
    m, c = "mismatch", "correct_value"
    rows = [
        ("e", "a", 1, "text", None, party("Ann", "Bob"), party("Ann", "Bob"), c, c, 0.1),
        ("e", "a", 2, "text", None, party("Ann", "Bob"), party("Eve", "Kim"), m, m, 0.2),
        ("e", "b", 2, "ocr", "p", party("Ann", "Bob"), party("Eve", "Kim"), m, m, 0.3),
        ("e", "b", 3, "text", None, party("Ann", "Bob"), party("Eve", "Bob"), m, c, 0.4),
        ("e", "b", 3, "text", None, party("Ann", "Bob"), party("Ann", "Lee"), c, m, 0.5),
        ("e", "b", None, "text", None, party("Ann", "Bob"), party("Eve", "Bob"), m, c, 0.6),
        (None, "b", 4, "text", None, party("Ann", "Bob"), party("Eve", "Bob"), m, c, 0.7)]
    return spark.createDataFrame(rows, SCORED)


def judged_rows(df):
    return sorted((r.composite, r.judge_state_vendor_name, r.judged_vendor_name, r.judge_state_customer_name, r.judged_customer_name) for r in df.collect())


def test_judged_rows_keep_their_document_order(spark):
    """Scores that lie by document are not sent by (execution, config, document) again; the mismatches may be given."""
    rows = scored(spark)
    found = judge.real_mismatches(rows)
    verdicts = found.where("predicted in ('Eve', 'Lee')").select(
        judge.pair_id(F.col("field"), F.col("golden"), F.col("predicted")).alias("pair_id"), F.lit('{"reason":"r","equivalent":true}').alias("response_text"))
    same, right, wrong = ("not_needed", "correct_value"), ("equivalent", "correct_value"), ("unparsed", "mismatch")
    want = [
        (0.1, *same, *same), (0.2, *right, *wrong), (0.3, "not_in_model_input", "mismatch", *wrong), (0.4, *right, *same),
        (0.5, "not_needed", "correct_value", *right), (0.6, "not_in_model_input", "mismatch", *same), (0.7, "not_in_model_input", "mismatch", *same)]
    assert judged_rows(judge.judged_wide(rows, verdicts)) == want
    assert judged_rows(judge.judged_wide(rows, verdicts, mismatches=found)) == want
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"), setting(spark, "spark.sql.adaptive.enabled", "false"):
        wide = judge.judged_wide(rows.repartition(4, "doc_id"), verdicts, mismatches=found)
        assert plan(wide).count("Exchange hashpartitioning(execution") == 1  # of the verdicts, not of the scores
    with pytest.raises(RuntimeError), setting(spark, "spark.sql.adaptive.enabled", "false"):
        raise RuntimeError
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def write_tables(spark, folder):
    """Orders 6 and 7 with a line each; order 6 prints its line."""
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    save([(1, "part", "tin")], "p_partkey long, p_name string, p_type string", "part")
    save([(1, "Sup")], "s_suppkey long, s_name string", "supplier")
    save([(1, "Cus")], "c_custkey long, c_name string", "customer")
    save([(k, 1, 1, 1, 10.0, 0.1, 0.1) for k in (6, 7, 9)], """l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long,
        l_extendedprice double, l_discount double, l_tax double""", "lineitem")
    save([(k, 1, "1-URGENT", "2024-01-02", 11.0) for k in (6, 7, 8, 9)], """o_orderkey long, o_custkey long, o_orderpriority string,
        o_orderdate string, o_totalprice double""", "orders")


def test_name_mismatches_need_no_lines(spark, tmp_path):
    folder = str(tmp_path)
    write_tables(spark, folder)
    key = lambda r: (r.execution, r.config, r.doc_id, r.field, r.golden, r.predicted)
    full = judge.real_mismatches(scoring.with_field_outcomes(tables.scored(spark, folder), 1))
    names = tables.name_mismatches(spark, folder)
    assert sorted(map(key, names.collect())) == sorted(map(key, full.collect())) and not names.isEmpty()
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        assert "collect_list" not in plan(tables.name_mismatches(spark, folder))
