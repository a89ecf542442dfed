"""String rules shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions.names import normalize_name

# The characters that count as white space when trimming.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0            "
    "    　"
)

# How many lines of context an excerpt takes on each side, and its largest length.
EXCERPT_CONTEXT = 3
EXCERPT_CHARS = 1500

# Currency codes and signs looked for in a text layer.
MARKER_CODES = ("USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD", "CNY", "INR", "SEK", "NOK", "DKK", "PLN")
MARKER_SIGNS = "$€£¥₹"


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def not_blank(c: Column) -> Column:
    """True when ``c`` has a non-space character; false (never null) otherwise."""
    return F.coalesce(F.length(trim_ws(c)) > 0, F.lit(False))


def scenario_of(doc_id: Column) -> Column:
    return F.replace(doc_id, F.lit("/"), F.lit("."))


def doc_key(scenario: Column) -> Column:
    """Inverse of :func:`scenario_of`: only the first dot was a slash."""
    return F.regexp_replace(scenario, r"^([^.]*)\.", "$1/")


def currency_marker(text: Column) -> Column:
    codes = r"\b(" + "|".join(MARKER_CODES) + r")\b"
    return F.when(text.rlike(codes), "Code").when(text.rlike(f"[{MARKER_SIGNS}]"), "Symbol").otherwise("None")


def _first_true(flags: Column) -> Column:
    return F.coalesce(F.array_position(flags, True), F.lit(0))


def _line_of(lines: Column, name: Column) -> Column:
    """1-based number of the first line naming ``name`` (as printed, then normalised); 0 when there is none."""
    printed = F.lower(trim_ws(name))
    exact = _first_true(F.transform(lines, lambda line: F.contains(F.lower(line), printed)))
    key = normalize_name(name)
    loose = F.when(
        F.length(key) > 0, _first_true(F.transform(lines, lambda line: F.contains(normalize_name(line), key)))
    ).otherwise(F.lit(0))
    return F.when(~not_blank(name), F.lit(0)).when(exact > 0, exact).otherwise(loose)


def excerpt(text: Column, golden: Column, predicted: Column) -> Column:
    """The lines around the first mention of the annotated name, else of the predicted name, else the head of the text."""
    lines = F.split(F.regexp_replace(text, r"\r\n|[\r\f\x{85}\x{2028}\x{2029}]", "\n"), "\n", -1)
    by_golden = _line_of(lines, golden)
    hit = F.when(by_golden > 0, by_golden).otherwise(_line_of(lines, predicted))
    width = 2 * EXCERPT_CONTEXT + 1
    start = F.greatest(F.lit(1), hit - EXCERPT_CONTEXT).cast("int")
    stop = F.when(hit > 0, hit + EXCERPT_CONTEXT).otherwise(F.lit(width)).cast("int")
    part = trim_ws(F.array_join(F.slice(lines, start, stop - start + 1), "\n"))
    return F.substring(part, 1, EXCERPT_CHARS)
