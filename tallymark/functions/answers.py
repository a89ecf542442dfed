"""Strict reading of model answers and judge verdicts.

``from_json`` alone is too lenient here: it accepts text after the object, turns numbers into strings and returns
partial rows. Answers are therefore parsed into VARIANT, whose type names tell a number from a string.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.text import not_blank, trim_ws
from tallymark.schemas import ADDRESS, AMOUNT, INVOICE, LINE_ITEM, PARTY

_SENTINEL = "⊣end"
_KEYS = tuple(dict.fromkeys(
    f for schema in (INVOICE, PARTY, ADDRESS, LINE_ITEM) for f in schema.fieldNames()
))
# The first look-ahead settles that a quoted word is a property name before any name is tried.
_MISCASED = '("(?=[A-Za-z]{{3,13}}+"\\s*+:)(?!(?:{0})")(?i:{0})"\\s*+:)'.format("|".join(_KEYS))
_ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
_NUMBER = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"

_ALL = "|".join
_PARTY_TEXTS = ("name", *ADDRESS.fieldNames())
_TEXTS = ("invoiceNumber", "invoiceDate", "dueDate", "currency", "description", *_PARTY_TEXTS)
_AMOUNTS = ("subtotal", "discount", "tax", "total")
_LINE_AMOUNTS = ("quantity", "unitPrice", "amount")


def _typed(names, types: str) -> str:
    """One of ``names`` followed by one of ``types``: the type is looked for first, since most properties lack it."""
    return f": (?:{types})(?<=(?:{_ALL(names)}): (?:{types}))"


# A property somewhere in the answer whose type is not the plain one expected under that name.
_UNUSUAL = "|".join((
    _typed(_TEXTS, "BI|BO|D|O|A|VA"), _typed(_AMOUNTS, "BO|O|A|VA"), _typed(_LINE_AMOUNTS, "BO|O|A|VA|S"),
    _typed(("vendor", "customer", "address"), "BI|BO|D|A|VA|S"), _typed(("lineItems",), "BI|BO|D|O|VA|S|ARRAY<[^OV]|ARRAY<VA"),
))

# An answer in which every property, wherever it stands, has the plain type: nothing of ``_UNUSUAL`` can be in it. It is read
# once from left to right. Other properties hold a plain value or a list of them, and no name of ours ends theirs.
_NUMERIC = r"BIGINT|DECIMAL\([\d,]++\)|DOUBLE|VOID"
_PLAIN = "^OBJECT<>*+(?:{})*+$".format("|".join(f"{pair}[>, ]*+" for pair in (
    f"(?:{_ALL(_TEXTS)}): (?:STRING|VOID)", f"(?:{_ALL(_AMOUNTS)}): (?:{_NUMERIC}|STRING)", f"(?:{_ALL(_LINE_AMOUNTS)}): (?:{_NUMERIC})",
    "(?:vendor|customer|address): (?:VOID|OBJECT<)", "lineItems: (?:VOID|ARRAY<(?:VOID|OBJECT<))",
    rf"(?!\w*?(?:{_ALL(_KEYS)}):)\w++: (?:ARRAY<)?+(?:STRING|BOOLEAN|{_NUMERIC})")))


def _miscased(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_MISCASED), 1)


def _canonical_keys(text: Column, found: Column) -> Column:
    """Property names match in any case: names written differently (rare) are ``found`` once and replaced literally."""
    canonical = F.create_map(*[F.lit(x) for key in _KEYS for x in (key.lower(), f'"{key}":')])

    def rename(c, hit):
        return F.replace(c, hit, F.try_element_at(canonical, F.lower(F.substring_index(F.substr(hit, F.lit(2)), '"', 1))))

    return F.when(F.size(found) > 0, F.aggregate(F.array_distinct(found), text, rename)).otherwise(text)


def _boxed(text: Column) -> Column:
    """``text`` and a sentinel as one JSON array; null when that does not parse."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f', "{_SENTINEL}"]')))


def _unboxed(boxed: Column) -> Column:
    """The boxed VARIANT, or null unless the sentinel follows it: then nothing else was in the text."""
    whole = F.coalesce(F.try_variant_get(boxed, "$[1]", "string") == _SENTINEL, F.lit(False))
    return F.when(whole, F.try_variant_get(boxed, "$[0]", "variant"))


def whole_json(text: Column) -> Column:
    return _unboxed(_boxed(text))


def _kind(v: Column) -> Column:
    """Type name of a variant; a missing value and a JSON null are both ``VOID``."""
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _amount(v: Column) -> Column:
    return F.try_variant_get(v, "$", AMOUNT.simpleString())


def _bad_amount(v: Column) -> Column:
    """True when a value is present but is neither a number nor a string that holds a number and nothing else."""
    padded = (_kind(v) == "STRING") & ~F.try_variant_get(v, "$", "string").rlike(_NUMBER)
    return (_kind(v) != "VOID") & (_kind(v).rlike("^(BOOLEAN|OBJECT|ARRAY)") | _amount(v).isNull() | padded)


def _part(v: Column, f: str) -> Column:
    return F.try_variant_get(v, f"$.{f}", "variant")


def _wrong_part(root: Column) -> Column:
    """Name of the first property whose type is wrong, looking at every property by itself; null when all are right."""

    def bad_text(f):
        return ~_kind(_part(root, f)).isin("STRING", "VOID")

    def bad_party(f):
        kind = _kind(_part(root, f))
        return (
            ~kind.rlike("^(VOID$|OBJECT<)")
            | kind.rlike(rf"\b({_ALL(_PARTY_TEXTS)}): (?!STRING|VOID)")
            | kind.rlike(r"\baddress: (?!OBJECT|VOID)")
        )

    bad_line = F.exists(
        F.try_variant_get(root, "$.lineItems", "array<variant>"),
        lambda v: ~_kind(v).rlike("^OBJECT<")
        | ~_kind(_part(v, "description")).isin("STRING", "VOID")
        | _bad_amount(_part(v, "quantity")) | _bad_amount(_part(v, "unitPrice")) | _bad_amount(_part(v, "amount")),
    )
    checks = [(f, bad_text(f)) for f in ("invoiceNumber", "currency", "invoiceDate", "dueDate")]
    checks += [(f, _bad_amount(_part(root, f))) for f in ("subtotal", "discount", "tax", "total")]
    checks += [(f, bad_party(f)) for f in ("vendor", "customer")]
    checks += [("lineItems", ~_kind(_part(root, "lineItems")).rlike("^(VOID$|ARRAY<)") | F.coalesce(bad_line, F.lit(False)))]
    wrong = F.lit(None).cast("string")
    for field, bad in reversed(checks):
        wrong = F.when(bad, field).otherwise(wrong)
    return wrong


def with_invoice(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``predicted`` and ``parse_error`` of an answer text; exactly one is null. One bad value fails the whole answer.

    Every step is a column of its own, so a text is parsed once. One look at the type of the whole answer settles nearly
    all of them; the property-by-property check runs only where that type looks unusual.
    """
    df = df.withColumn("_found", _miscased(F.col(text_col)))
    df = df.withColumn("_text", _canonical_keys(F.col(text_col), F.col("_found")))
    df = df.withColumn("_boxed", _boxed(F.col("_text")))
    df = df.withColumn("_root", _unboxed(F.col("_boxed")))
    as_text = "struct<{}>".format(",".join(f"{f}:string" for f in ("invoiceDate", "dueDate", *_AMOUNTS)))
    df = df.withColumns({
        "_kind": _kind(F.col("_root")),
        "_printed": F.try_variant_get("_root", "$", as_text),
        "_invoice": F.try_variant_get("_root", "$", INVOICE.simpleString()),
    })
    root, kind = F.col("_root"), F.col("_kind")
    error = (
        F.when(root.isNull(), "Response is not one JSON value.")
        .when(kind == "VOID", "Response is JSON null.")
        .when(~F.startswith(kind, F.lit("OBJECT<")), "Response is not a JSON object.")
    )
    for f in ("invoiceDate", "dueDate"):
        printed = F.col(f"_printed.{f}")
        error = error.when(
            printed.isNotNull() & (~printed.rlike(_ISO_DATE) | F.col(f"_invoice.{f}").isNull()), f"{f} is not an ISO date.")
    for f in _AMOUNTS:
        printed = F.col(f"_printed.{f}")
        error = error.when(printed.isNotNull() & (~printed.rlike(_NUMBER) | F.col(f"_invoice.{f}").isNull()), f"{f} is not an amount.")
    error = error.when(~kind.rlike(_PLAIN) & kind.rlike(_UNUSUAL), F.concat(_wrong_part(root), F.lit(" has the wrong type.")))
    df = df.withColumn("parse_error", error)
    return df.withColumn("predicted", F.when(F.col("parse_error").isNull(), F.col("_invoice"))).drop(
        "_found", "_text", "_boxed", "_root", "_kind", "_printed", "_invoice")


def warnings_of(text: Column) -> Column:
    """String elements of the top-level ``warnings`` array; empty when there is none or the text is not JSON."""
    items = F.try_variant_get(whole_json(text), "$.warnings", "array<variant>")
    strings = F.filter(items, lambda v: _kind(v) == "STRING")
    return F.coalesce(
        F.transform(strings, lambda v: F.try_variant_get(v, "$", "string")), F.array().cast("array<string>")
    )


def parse_verdict(text: Column) -> Column:
    """struct(equivalent, reason) of a judge response: prose around the outermost braces is ignored."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    keyed = F.regexp_replace(
        F.regexp_replace(body, r'"(?i:reason)"(\s*:)', '"reason"$1'), r'"(?i:equivalent)"(\s*:)', '"equivalent"$1'
    )
    root = whole_json(keyed)
    flag = F.try_variant_get(root, "$.equivalent", "variant")
    word = F.lower(trim_ws(F.try_variant_get(flag, "$", "string")))
    equivalent = F.when(
        _kind(flag).isin("BOOLEAN", "STRING"), F.when(word == "true", True).when(word == "false", False)
    )
    reason_value = F.try_variant_get(root, "$.reason", "variant")
    reason = F.when(_kind(reason_value) == "STRING", trim_ws(F.try_variant_get(reason_value, "$", "string"))).otherwise("")
    why = (
        F.when(~not_blank(text), "The judge wrote nothing.")
        .when(body == "", "There are no braces in what the judge wrote.")
        .when(root.isNull(), "What the judge put in braces is not JSON.")
        .when(equivalent.isNull(), "Neither true nor false is given under equivalent.")
    )
    return F.struct(F.when(why.isNull(), equivalent).alias("equivalent"), F.coalesce(why, reason).alias("reason"))
