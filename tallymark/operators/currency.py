"""Currency texts to ISO 4217 codes, over a whole column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.text import trim_ws

# Codes in active use that are recognised.
ISO_CODES = (
    "AED", "ARS", "AUD", "BGN", "BRL", "CAD", "CHF", "CLP", "CNY", "COP", "CZK", "DKK", "EGP", "EUR", "GBP", "HKD",
    "HUF", "IDR", "ILS", "INR", "ISK", "JPY", "KRW", "MXN", "MYR", "NOK", "NZD", "PHP", "PKR", "PLN", "RON", "RUB",
    "SAR", "SEK", "SGD", "THB", "TRY", "TWD", "UAH", "USD", "VND", "XAF", "XOF", "ZAR",
)

# Texts with exactly one reading.
UNAMBIGUOUS = {
    "€": "EUR", "£": "GBP", "₹": "INR", "₩": "KRW", "₽": "RUB", "₺": "TRY", "₪": "ILS", "₫": "VND", "฿": "THB",
    "₱": "PHP", "zł": "PLN",
    "us$": "USD", "u.s.$": "USD", "ca$": "CAD", "c$": "CAD", "can$": "CAD", "a$": "AUD", "au$": "AUD", "nz$": "NZD",
    "hk$": "HKD", "s$": "SGD", "mx$": "MXN", "r$": "BRL",
    "chf": "CHF", "fr.": "CHF", "sfr": "CHF",
    "us dollar": "USD", "u.s. dollar": "USD", "american dollar": "USD", "canadian dollar": "CAD",
    "australian dollar": "AUD", "new zealand dollar": "NZD", "hong kong dollar": "HKD", "singapore dollar": "SGD",
    "euro": "EUR", "pound sterling": "GBP", "british pound": "GBP", "sterling": "GBP",
    "japanese yen": "JPY", "yen": "JPY", "chinese yuan": "CNY", "renminbi": "CNY", "yuan": "CNY",
    "swiss franc": "CHF", "indian rupee": "INR", "swedish krona": "SEK", "norwegian krone": "NOK",
    "danish krone": "DKK", "polish zloty": "PLN", "mexican peso": "MXN", "brazilian real": "BRL",
    "south african rand": "ZAR",
}

# Texts that several currencies share, and those that are named for them.
SHARED = {
    "$": "USD CAD AUD NZD SGD HKD MXN", "dollar": "USD CAD AUD NZD SGD HKD", "¥": "JPY CNY", "kr": "SEK NOK DKK ISK", "krona": "SEK ISK",
    "krone": "NOK DKK", "rs": "INR PKR LKR NPR", "rs.": "INR PKR LKR NPR", "rupee": "INR PKR LKR NPR", "pound": "GBP EGP",
    "franc": "CHF XOF XAF", "peso": "MXN ARS COP CLP PHP",
}
AMBIGUOUS = {text: f"{text} may mean {', '.join(codes.split())}" for text, codes in SHARED.items()}


def normalize_currency(
    df: DataFrame, text_col: str, codes=ISO_CODES, unambiguous=UNAMBIGUOUS, ambiguous=AMBIGUOUS
) -> DataFrame:
    """Adds ``code`` and ``reason``. The dictionaries are short fixed lists, so their join is a broadcast."""
    spark = df.sparkSession
    known = [(k, v, None) for k, v in unambiguous.items()] + [(k, None, v) for k, v in ambiguous.items()]
    words = spark.createDataFrame(known, "k string, c string, r string")

    trimmed = trim_ws(F.coalesce(F.col(text_col), F.lit("")))
    key = F.regexp_replace(F.lower(trimmed), r"[\s\x{85}\p{Z}]+", " ")
    singular = F.when(F.endswith(key, F.lit("s")) & ~F.endswith(key, F.lit("ss")), F.expr("left(_key, length(_key) - 1)"))
    prepared = df.withColumn("_t", trimmed).withColumn("_key", key)
    prepared = prepared.withColumn("_one", F.coalesce(singular, F.col("_key")))
    for name, on in (("a", "_key"), ("b", "_one")):
        side = words.select(F.col("k").alias(on), F.struct("c", "r").alias(f"_{name}"))
        prepared = prepared.join(side, on, "left")

    upper, t = F.upper("_t"), F.col("_t")
    hit = F.coalesce("_a", "_b")
    is_code = upper.isin(*codes)
    code = F.when(t == "", None).when(is_code, upper).otherwise(hit["c"])
    reason = (
        F.when(t == "", "No text.")
        .when(is_code, F.concat(F.lit("'"), t, F.lit("' is a known code.")))
        .when(hit["c"].isNotNull(), F.concat(F.lit("'"), t, F.lit("' stands for "), hit["c"], F.lit(".")))
        .when(hit["r"].isNotNull(), F.concat(F.lit("Several readings: "), hit["r"]))
        .when(upper.rlike("^[A-Z]{3}$"), F.concat(
            F.lit("'"), t, F.lit("' has the form of a code that is not known.")))
        .otherwise(F.concat(F.lit("No reading for '"), t, F.lit("'.")))
    )
    return prepared.withColumns({"code": code, "reason": reason}).select(*df.columns, "code", "reason")
