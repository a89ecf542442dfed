"""Amount, code and money rules. Amounts are exact: decimals, or integers in a smaller unit with a matching tolerance."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions.text import trim_ws

# Fixed value: the largest difference between two equal amounts, inclusive.
TOLERANCE = Decimal("0.01")


def amount_match(a: Column, b: Column, tol=TOLERANCE) -> Column:
    return F.abs(a - b) <= F.lit(tol)


def fold_match(a: Column, b: Column) -> Column:
    """Equal after trimming, ignoring case."""
    return (a == b) | (F.lower(trim_ws(a)) == F.lower(trim_ws(b)))


def recomputed(subtotal: Column, discount: Column, tax: Column) -> Column:
    """subtotal - discount + tax, where an amount that is not printed counts as zero."""
    return subtotal - F.coalesce(discount, F.lit(0)) + F.coalesce(tax, F.lit(0))


def show(c: Column, kind: str) -> Column:
    """Printable value for reasons: plain for dates and amounts, quoted for text, ``null`` when absent."""
    if kind == "date":
        text = F.date_format(c, "yyyy-MM-dd")
    elif kind == "amount":
        text = c.cast("string")
    else:
        text = F.concat(F.lit("'"), c, F.lit("'"))
    return F.coalesce(text, F.lit("null"))


def outcome_reason(outcome: Column, expected: Column, actual: Column, kind: str = "text") -> Column:
    return F.concat(outcome, F.lit(": expected "), show(expected, kind), F.lit(", got "), show(actual, kind))
