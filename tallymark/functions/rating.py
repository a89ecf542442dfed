"""Rating bands and the outcome names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Outcome names.
UNPARSED, CORRECT_NULL, FALSE_POSITIVE = "unparsed", "correct_null", "false_positive"
MISS, CORRECT_VALUE, MISMATCH = "miss", "correct_value", "mismatch"
OUTCOMES = (UNPARSED, CORRECT_NULL, FALSE_POSITIVE, MISS, CORRECT_VALUE, MISMATCH)


def outcome_score(outcome: Column) -> Column:
    return F.when(outcome.isin(CORRECT_VALUE, CORRECT_NULL), F.lit(1.0)).when(outcome.isNotNull(), F.lit(0.0))


def rating_band(value: Column, pass_at: float = 1.0, inverted: bool = False) -> Column:
    """struct(rating, failed). Inverted metrics are failures when they fire: 1 is unacceptable, anything else exceptional."""
    if inverted:
        rating = F.when(value.isNull(), "Inconclusive").when(value == 1, "Unacceptable").otherwise("Exceptional")
        failed = F.coalesce(value == 1, F.lit(False))
    else:
        rating = (
            F.when(value.isNull(), "Inconclusive")
            .when(value >= 1.0, "Exceptional")
            .when(value >= 0.9, "Good")
            .when(value >= 0.7, "Average")
            .when(value >= 0.5, "Poor")
            .otherwise("Unacceptable")
        )
        failed = F.coalesce(value < pass_at, F.lit(False))
    return F.struct(rating.alias("rating"), failed.alias("failed"))
