"""Annotation corpora to typed invoices, with a quarantine. One projection per annotation: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.text import not_blank, trim_ws
from tallymark.schemas import AMOUNT, LINE_ITEM, SPAN
from tallymark.session import stored

# Annotation keys and patterns.
AMOUNT_KEYS = ("TOTAL", "SUB_TOTAL", "AMOUNT_DUE")
NUMBER = r"(\d+(?:\.\d+)?)"
TRAILING_CURRENCY = r"(\$|USD|EUR)\s*$"
DATE_PATTERN, DATE_FORMAT = r"\b\d{1,2}-[A-Za-z]{3}-\d{4}\b", "d-MMM-yyyy"
PARTY_LABEL = r"(?i)^\s*(?:Bill to|Buyer|BILL_TO)\s*:\s*"
ADDRESS_LABEL = r"(?i)^\s*Address\s*:\s*"
CITY_LINE = r"^(.+?),?\s+([A-Z]{2})\s+(\d{5})\s+([A-Z]{2})$"


def with_spans(df: DataFrame, raw: str = "raw", name: str = "spans") -> DataFrame:
    """Adds MAP<key, SPAN> of an annotation document; of a repeated key the last entry counts, and only objects are kept.

    The document is read once: its entries, and their keys from the last on, are columns of their own, for an expression
    inside a lambda is worked out again for every entry.
    """
    df = df.withColumn("_parts", F.map_entries(F.from_json(F.col(raw), "map<string,string>")))
    df = df.withColumn("_keys", F.reverse(F.transform("_parts", lambda e: e["key"])))
    last = F.filter("_parts", lambda e, i: F.array_position(F.col("_keys"), e["key"]) == F.size("_keys") - i)
    df = df.withColumn("_parts", F.filter(last, lambda e: F.startswith(F.ltrim(e["value"]), F.lit("{"))))
    spans = F.transform("_parts", lambda e: F.struct(e["key"].alias("key"), F.from_json(e["value"], SPAN).alias("value")))
    return df.withColumn(name, F.map_from_entries(spans)).drop("_parts", "_keys")


def span_text(spans: Column, key: str) -> Column:
    return F.try_element_at(spans, F.lit(key))["text"]


def last_number(text: Column) -> Column:
    """The last number printed in a text, as an amount; null when there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(NUMBER), 1), F.lit(-1)).try_cast(AMOUNT)


def trailing_currency(text: Column) -> Column:
    found = F.regexp_extract(text, TRAILING_CURRENCY, 1)
    return F.when(found.isin("$", "USD"), "USD").when(found == "EUR", "EUR")


def parse_date(text: Column) -> Column:
    return F.try_to_date(F.nullif(F.regexp_extract(text, DATE_PATTERN, 0), F.lit("")), DATE_FORMAT)


def last_token(text: Column) -> Column:
    return F.element_at(F.split(trim_ws(text), r"[\s\x{85}\p{Z}]+"), -1)


def block_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), trim_ws), lambda line: line != "")


def city_index(lines: Column) -> Column:
    """0-based place of the first city line; -1 when there is none."""
    return F.coalesce(F.array_position(F.transform(lines, lambda line: line.rlike(CITY_LINE)), True), F.lit(0)).cast("int") - 1


def address_at(lines: Column, at: Column) -> Column:
    """Address struct from trimmed lines and the place of the city line; null when no street line precedes it.

    Lines after the city are ignored. Keep ``lines`` and ``at`` in columns of their own: both are used several times.
    """
    city = F.get(lines, at)
    return F.when(at >= 1, F.struct(
        F.array_join(F.slice(lines, F.lit(1), at), ", ").alias("street"),
        F.regexp_extract(city, CITY_LINE, 1).alias("city"), F.regexp_extract(city, CITY_LINE, 2).alias("region"),
        F.regexp_extract(city, CITY_LINE, 3).alias("postalCode"), F.regexp_extract(city, CITY_LINE, 4).alias("country")))


def with_address(df: DataFrame, name: str, lines: str) -> DataFrame:
    """Adds the address struct ``name`` read from the line array column ``lines``."""
    placed = df.withColumn("_at", city_index(F.col(lines)))
    return placed.withColumn(name, address_at(F.col(lines), F.col("_at"))).drop("_at")


def with_party(df: DataFrame, name: str, block: str) -> DataFrame:
    """Adds struct(name, address) read from a labelled party block; the first line is the name."""
    df = df.withColumn("_all", block_lines(F.regexp_replace(F.col(block), PARTY_LABEL, "")))
    df = df.withColumn("_rest", F.slice("_all", F.lit(2), F.greatest(F.size("_all") - 1, F.lit(0))))
    df = with_address(df, "_address", "_rest")
    party = F.struct(F.get("_all", F.lit(0)).alias("name"), F.col("_address").alias("address"))
    return df.withColumn(name, F.when(F.col(block).isNotNull(), party)).drop("_all", "_rest", "_address")


def tax_entries(spans: Column) -> Column:
    return F.map_filter(spans, lambda k, v: ((k == "TAX") | F.startswith(k, F.lit("GST("))) & v["text"].isNotNull())


def tax_sum(spans: Column) -> Column:
    values = F.filter(F.transform(F.map_values(tax_entries(spans)), lambda v: last_number(v["text"])),
                      lambda x: x.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(
        values, F.lit(0).cast(AMOUNT), lambda a, x: (a + x).cast(AMOUNT)))


def currencies_of(spans: Column) -> Column:
    found = F.array(*[trailing_currency(span_text(spans, k)) for k in AMOUNT_KEYS])
    return F.array_distinct(F.array_compact(found))


def _with_spans(annotations: DataFrame) -> DataFrame:
    return annotations if "spans" in annotations.columns else with_spans(annotations)


def tax_rollup(annotations: DataFrame) -> DataFrame:
    return _with_spans(annotations).withColumn("tax", tax_sum(F.col("spans")))


def currency_conflict(annotations: DataFrame) -> DataFrame:
    listed = _with_spans(annotations).withColumn("currencies", currencies_of(F.col("spans")))
    return listed.withColumn("conflict", F.size("currencies") > 1)


# Span keys whose text the conversion reads.
_READ = ("DATE", "DUE_DATE", "SELLER_NAME", "SELLER_ADDRESS", "BILL_TO", "BUYER", "NUMBER", "SUB_TOTAL", "DISCOUNT",
         "TOTAL", "AMOUNT_DUE")


def convert_annotations(annotations: DataFrame) -> DataFrame:
    """Adds ``invoice`` and ``reject_reason``; exactly one of the two is null. The first failing rule names the reason.

    A chain of projections over one row at a time: values used more than once are columns, so they are computed once.
    """
    df = _with_spans(annotations)
    kept = df.columns
    s = F.col("spans")
    df = df.withColumns({
        **{f"_{k}": span_text(s, k) for k in _READ}, "_currencies": currencies_of(s), "_taxes": tax_entries(s)})
    df = df.withColumns({
        "_total_text": F.coalesce("_TOTAL", "_AMOUNT_DUE"), "_block": F.coalesce("_BILL_TO", "_BUYER"),
        "_seller_lines": block_lines(F.regexp_replace("_SELLER_ADDRESS", ADDRESS_LABEL, "")),
        "_tax_values": F.transform(F.map_entries("_taxes"), lambda e: F.struct(
            e["key"].alias("key"), e["value"]["text"].alias("text"), last_number(e["value"]["text"]).alias("amount")))})
    amounts = {"subtotal": ("SUB_TOTAL", "_SUB_TOTAL"), "discount": ("DISCOUNT", "_DISCOUNT"), "total": ("TOTAL", "_total_text")}
    dates = {"invoiceDate": ("DATE", "_DATE"), "dueDate": ("DUE_DATE", "_DUE_DATE")}
    df = df.withColumns({
        **{f"_v_{f}": last_number(F.col(c)) for f, (_, c) in amounts.items()},
        **{f"_v_{f}": parse_date(F.col(c)) for f, (_, c) in dates.items()},
        "_bad_tax": F.get(F.filter("_tax_values", lambda v: v["amount"].isNull()), F.lit(0)),
        "_tax": F.when(F.size("_tax_values") > 0, F.aggregate(
            "_tax_values", F.lit(0).cast(AMOUNT), lambda a, v: (a + v["amount"]).cast(AMOUNT))),
        "_seller_name": trim_ws(F.col("_SELLER_NAME"))})
    df = with_party(with_address(df, "_seller", "_seller_lines"), "_customer", "_block")

    def failed(f, label, column, what):
        return F.when(F.col(column).isNotNull() & F.col(f"_v_{f}").isNull(), F.concat(
            F.lit(f"{label}: no {what} in '"), F.col(column), F.lit("'.")))

    block, seller, customer = F.col("_block"), F.col("_seller"), F.col("_customer")
    reason = F.coalesce(
        F.when(s.isNull(), F.lit("The text holds no JSON object.")),
        F.when(F.startswith(F.lower(trim_ws(F.col("_DATE"))), F.lit("due")), F.concat(
            F.lit("DATE carries a due-date label: '"), F.col("_DATE"), F.lit("'."))),
        F.concat(F.col("_bad_tax.key"), F.lit(": no number in '"), F.col("_bad_tax.text"), F.lit("'.")),
        F.when(F.size("_currencies") > 1, F.concat(
            F.lit("Several currencies printed: "), F.array_join("_currencies", ", "), F.lit("."))),
        F.when(F.col("_SELLER_ADDRESS").isNotNull() & seller.isNull(), F.concat(
            F.lit("SELLER_ADDRESS: street and city not found in '"), F.col("_SELLER_ADDRESS"), F.lit("'."))),
        F.when(block.isNotNull() & customer["name"].isNull(), F.concat(F.lit("Party block without a name '"), block, F.lit("'."))),
        F.when(block.isNotNull() & customer["address"].isNull(), F.concat(
            F.lit("BUYER: street and city not found in '"), block, F.lit("'."))),
        *[failed(f, label, c, "readable date") for f, (label, c) in dates.items()],
        *[failed(f, label, c, "number") for f, (label, c) in amounts.items()],
    )
    vendor = F.when(F.col("_seller_name").isNotNull() | seller.isNotNull(), F.struct(
        F.col("_seller_name").alias("name"), seller.alias("address")))
    invoice = F.struct(
        vendor.alias("vendor"), customer.alias("customer"),
        F.when(not_blank(F.col("_NUMBER")), last_token(F.col("_NUMBER"))).alias("invoiceNumber"),
        *[F.col(f"_v_{f}").alias(f) for f in dates], F.get("_currencies", F.lit(0)).alias("currency"),
        F.col("_v_subtotal").alias("subtotal"), F.col("_v_discount").alias("discount"), F.col("_tax").alias("tax"),
        F.col("_v_total").alias("total"), F.lit(None).cast(f"array<{LINE_ITEM.simpleString()}>").alias("lineItems"))
    done = df.withColumn("reject_reason", reason)
    return done.withColumn("invoice", F.when(F.col("reject_reason").isNull(), invoice)).select(
        *kept, "invoice", "reject_reason")


def layout_of(name: Column) -> Column:
    return F.element_at(F.split(name, "_"), 1)


def ingest_annotations(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected). ``raw`` has (name, raw); rejected rows keep their text and the reason.

    The conversion is written once and both sides read it: a filter on the reason would otherwise convert every
    annotation once for the good rows and once more for the rejected ones.
    """
    converted = stored(convert_annotations(raw.withColumn("layout", layout_of(F.col("name")))).drop("spans"), "converted")
    good = converted.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, converted.where(F.col("reject_reason").isNotNull()).select("name", "layout", "raw", "reject_reason")


def _joined(lines: Column) -> Column:
    """Lines joined by newlines: carriage returns dropped, exactly one newline at the end."""
    text = F.array_join(F.transform(lines, lambda line: F.replace(line, F.lit("\r"), F.lit(""))), "\n")
    return F.concat(F.regexp_replace(text, r"\n+\z", ""), F.lit("\n"))


def reading_order(spans: Column) -> Column:
    """Text of the boxed spans from top to bottom (y grows upwards), left to right, then by text.

    A box without two corners of two numbers has no place, so its span is left out.
    """
    def corner(e, which, axis):
        return F.get(F.get(e["value"]["bbox"], F.lit(which)), F.lit(axis))

    def has_place(e):
        return (e["value"]["text"].isNotNull() & not_blank(e["value"]["text"])
                & F.forall(F.array(*[corner(e, c, x) for c in (0, 1) for x in (0, 1)]), lambda v: v.isNotNull()))

    boxed = F.filter(F.map_entries(spans), lambda e: (e["key"] != "OTHER") & F.coalesce(has_place(e), F.lit(False)))

    def placed(e):
        return F.struct((-F.greatest(corner(e, 0, 1), corner(e, 1, 1))).alias("up"), F.least(corner(e, 0, 0), corner(e, 1, 0)).alias("left"),
                        trim_ws(e["value"]["text"]).alias("text"))

    return _joined(F.transform(F.array_sort(F.transform(boxed, placed)), lambda x: x["text"]))


def ocr_text(spans: Column) -> Column:
    """The full-page text with right-trimmed lines; null where there is none."""
    text = span_text(spans, "OTHER")
    lines = F.transform(F.split(text, "\n"), lambda line: F.regexp_replace(line, r"[\s\x{85}\p{Z}]+$", ""))
    return F.when(not_blank(text), _joined(lines))
