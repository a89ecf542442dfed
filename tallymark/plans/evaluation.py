"""The end-to-end jobs, composed from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.amounts import TOLERANCE
from tallymark.operators.compare import compare_rows, ordered_comparison, paired_runs
from tallymark.operators.gate import gate, gate_verdicts, summary_cells
from tallymark.operators.judge import judged_wide
from tallymark.operators.lines import line_items
from tallymark.operators.scoring import (
    composite_score, field_scores, golden_x_answers, parse_answers, recomputed_total, schema_validity,
    with_field_outcomes,
)
from tallymark.operators.summary import summary

Scorer = Callable[[DataFrame], dict[str, Column]]
_SCORERS: dict[str, Scorer] = {}


def register_scorer(name: str, scorer: Scorer) -> None:
    """Adds a scorer: a function from the scored table to named numeric columns (null = not applicable)."""
    if name in _SCORERS:
        raise ValueError(f"scorer already registered: {name}")
    _SCORERS[name] = scorer


def unregister_scorer(name: str) -> None:
    _SCORERS.pop(name, None)


def score_documents(scored: DataFrame, tol=TOLERANCE) -> DataFrame:
    """Every document metric for rows with ``expected``, ``predicted`` and ``parse_error``. A projection: no shuffle."""
    rows = schema_validity(with_field_outcomes(scored, tol))
    rows = line_items(recomputed_total(rows, tol), tol)
    rows = composite_score(rows)
    for scorer in _SCORERS.values():
        rows = rows.withColumns(scorer(rows))
    return rows


def evaluate(golden: DataFrame, answers: DataFrame, tol=TOLERANCE) -> DataFrame:
    """Answers as text against golden documents: parse before the join, so texts are not shuffled."""
    return score_documents(golden_x_answers(golden, parse_answers(answers).drop("response_text")), tol)


def report(doc_scores: DataFrame, prices: DataFrame) -> DataFrame:
    return summary(doc_scores, prices)


def judged(scored: DataFrame, verdicts: DataFrame) -> DataFrame:
    return judged_wide(scored, verdicts)


def compare(doc_scores: DataFrame, a: str, b: str, **bootstrap) -> DataFrame:
    """Interval rows of one comparison, in report order."""
    return ordered_comparison(compare_rows(paired_runs(field_scores(doc_scores), a, b), **bootstrap))


def run_gate(summary_rows: DataFrame, baseline: DataFrame, thresholds: DataFrame) -> DataFrame:
    metrics = [r.metric for r in thresholds.select("metric").distinct().orderBy("metric").collect()]
    return gate_verdicts(gate(baseline, summary_cells(summary_rows, metrics), thresholds))


def passed(verdicts: DataFrame) -> bool:
    """True when no cell breaches."""
    return verdicts.where(F.col("breach")).isEmpty()
