"""Aggregate columns of the summary. ``prefix`` names the wide outcome columns, e.g. ``outcome_total``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions.rating import CORRECT_NULL, CORRECT_VALUE, FALSE_POSITIVE, MISMATCH, MISS, outcome_score


def mean_applicable(metric: str | Column) -> Column:
    """Mean over the documents the metric applies to; null when there are none."""
    return F.avg(metric)


def coverage(metric: str | Column) -> Column:
    return F.count(metric)


def accuracy_value(field: str) -> Column:
    return outcome_score(F.col(f"outcome_{field}"))


def judged_value(field: str) -> Column:
    return outcome_score(F.col(f"judged_{field}"))


def _hit(outcome: Column, hit: str, population: tuple[str, ...]) -> Column:
    return F.when(outcome.isin(*population), (outcome == hit).cast("double"))


def false_positive_value(field: str) -> Column:
    """1 for an invented value, 0 for a correct null, null elsewhere."""
    return _hit(F.col(f"outcome_{field}"), FALSE_POSITIVE, (FALSE_POSITIVE, CORRECT_NULL))


def miss_value(field: str) -> Column:
    """1 for a missed value, 0 for another answer where a value is printed, null elsewhere."""
    return _hit(F.col(f"outcome_{field}"), MISS, (MISS, CORRECT_VALUE, MISMATCH))


def field_accuracy(field: str) -> Column:
    return F.avg(accuracy_value(field))


def judged_accuracy(field: str) -> Column:
    return F.avg(judged_value(field))


def false_positive_rate(field: str) -> Column:
    """Invented values over the parsed documents where nothing is printed."""
    return F.avg(false_positive_value(field))


def miss_rate(field: str) -> Column:
    """Missed values over the parsed documents where a value is printed."""
    return F.avg(miss_value(field))
