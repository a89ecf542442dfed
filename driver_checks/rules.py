"""Column rules over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_checks import check
from driver_checks import tables as t
from driver_checks.ctes import toks
from tallymark.functions.answers import parse_verdict, warnings_of
from tallymark.functions.hashing import pair_id as pair_id_rule
from tallymark.functions.hashing import splitmix_draw as splitmix_rule
from tallymark.functions.names import tokens as token_rule
from tallymark.operators import convert as V

_M64 = "18446744073709551616::UHUGEINT"


@check("splitmix_draw", f"""
    SELECT k, CAST((xor(z2, z2 >> 31) * 1000003::UHUGEINT) >> 64 AS BIGINT) AS draw FROM (
      SELECT k, (xor(z1, z1 >> 27) * 10723151780598845931::UHUGEINT) % {_M64} AS z2 FROM (
        SELECT k, (xor(z0, z0 >> 30) * 13787848793156543929::UHUGEINT) % {_M64} AS z1 FROM (
          SELECT event_id AS k, (42::UHUGEINT + event_id::UHUGEINT * 11400714819323198485::UHUGEINT) % {_M64} AS z0 FROM events)))""")
def splitmix_draw(spark, d):
    return t.table(spark, d, "events").select(
        F.col("event_id").alias("k"), splitmix_rule(42, F.col("event_id"), 1_000_003).alias("draw"))


@check("tokens", f"SELECT doc_id, array_to_string(list_sort({toks('text')}), ' ') AS tokens FROM documents")
def tokens(spark, d):
    return t.table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(token_rule(F.col("text"))), " ").alias("tokens"))


@check("pair_id", """
    SELECT o_orderkey, 'p-' || substr(sha256('customer_name' || chr(10) || c_name || chr(10) || o_orderpriority), 1, 12) AS id
    FROM orders JOIN customer ON c_custkey = o_custkey""")
def pair_id(spark, d):
    rows = t.table(spark, d, "orders").join(t.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.select("o_orderkey", pair_id_rule(F.lit("customer_name"), F.col("c_name"), F.col("o_orderpriority")).alias("id"))


_KIND = "event_id % 6"


@check("parse_verdict", f"""
    SELECT event_id, CASE {_KIND} WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS equivalent,
           CASE {_KIND} WHEN 0 THEN event_type WHEN 1 THEN '' WHEN 2 THEN props WHEN 3 THEN 'There are no braces in what the judge wrote.'
                WHEN 4 THEN 'Neither true nor false is given under equivalent.' ELSE 'The judge wrote nothing.' END AS reason FROM events""")
def parse_verdict_(spark, d):
    text = F.expr(f"""case {_KIND} when 0 then concat('{{"reason":" ', event_type, ' ","equivalent":true}}')
        when 1 then concat('So: {{"Equivalent":"False"}} (', value, ')')
        when 2 then concat('```json\n', to_json(struct(props as reason, true as equivalent)), '\n```')
        when 3 then event_type when 4 then props else ' ' end""")
    return t.table(spark, d, "events").select("event_id", parse_verdict(text).alias("v")).select("event_id", "v.*")


@check("warnings_of", """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || ';' || user_id WHEN 1 THEN event_type ELSE '' END AS warnings FROM events""")
def warnings(spark, d):
    text = F.expr("""case event_id % 4 when 0 then to_json(struct(array(event_type, cast(user_id as string)) as warnings))
        when 1 then concat('{"warnings":["', event_type, '",', user_id, ',null,{}]}') when 2 then props else event_type end""")
    return t.table(spark, d, "events").select("event_id", F.array_join(warnings_of(text), ";").alias("warnings"))


_TEXT = "(p_name || ' ' || p_size || '.' || p_partkey || ' - ' || p_retailprice || (['USD', ' $ ', ' EUR', '', ' x'])[p_partkey % 5 + 1])"


def _texts(spark, d):
    return t.table(spark, d, "part").select("p_partkey", F.expr("""concat(p_name, ' ', p_size, '.', p_partkey, ' - ', p_retailprice,
        element_at(array('USD', ' $ ', ' EUR', '', ' x'), cast(p_partkey % 5 as int) + 1))""").alias("text"))


@check("last_number", "SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part")
def last_number(spark, d):
    return _texts(spark, d).select("p_partkey", (V.last_number(F.col("text")) * 100).cast("long").alias("cents"))


@check("trailing_currency", "SELECT p_partkey, (['USD', 'USD', 'EUR', NULL, NULL])[p_partkey % 5 + 1] AS currency FROM part")
def trailing_currency(spark, d):
    return _texts(spark, d).select("p_partkey", V.trailing_currency(F.col("text")).alias("currency"))


@check("last_token", "SELECT c_custkey, c_name AS token FROM customer")
def last_token(spark, d):
    text = F.concat_ws(" ", F.lit(" No "), "c_mktsegment", "c_name", F.lit("\t"))
    return t.table(spark, d, "customer").select("c_custkey", V.last_token(text).alias("token"))


@check("parse_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date FROM orders")
def parse_date(spark, d):
    text = F.expr("if(o_orderkey % 7 = 3, 'Date: 31-Feb-2020', concat('Invoice Date: ', date_format(o_orderdate, 'd-MMM-yyyy'), '.'))")
    return t.table(spark, d, "orders").select("o_orderkey", V.parse_date(text).cast("string").alias("date"))


_BLOCK = "concat('BILL_TO : ', c_name, ' \n ', c_custkey, ' Oak Rd \n\n', if(c_custkey % 9 = 4, 'no city', concat('Port ', c_mktsegment, ', NY ', lpad(c_custkey % 99999, 5, '0'), ' US')), '\nTel:1')"


def _parties(spark, d):
    return V.with_party(t.table(spark, d, "customer").withColumn("block", F.expr(_BLOCK)), "party", "block")


@check("parse_party", "SELECT c_custkey, c_name AS name, c_custkey % 9 <> 4 AS has_address FROM customer")
def parse_party(spark, d):
    return _parties(spark, d).select("c_custkey", F.col("party.name").alias("name"), F.col("party.address").isNotNull().alias("has_address"))


@check("parse_address", """
    SELECT c_custkey, c_custkey || ' Oak Rd' AS street, 'Port ' || c_mktsegment AS city, 'NY' AS region,
           lpad(CAST(c_custkey % 99999 AS VARCHAR), 5, '0') AS postal_code, 'US' AS country FROM customer WHERE c_custkey % 9 <> 4""")
def parse_address(spark, d):
    a = F.col("party.address")
    return _parties(spark, d).where(a.isNotNull()).select(
        "c_custkey", a["street"].alias("street"), a["city"].alias("city"), a["region"].alias("region"),
        a["postalCode"].alias("postal_code"), a["country"].alias("country"))
