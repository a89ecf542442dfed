"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import bpe, langid, toxicity
from tallymark.llm.ann import nearest
from tallymark.llm.common import table
from tallymark.llm.conversations import damaged, figures, repair_steps
from tallymark.llm.html_extract import extract
from tallymark.llm.line_dedup import dedup_lines
from tallymark.llm.mixing import mix
from tallymark.llm.ngram_join import similar_groups
from tallymark.llm.ranked_search import rank_documents
from tallymark.llm.surrogates import replace_entities
from tallymark.llm.token_counts import count_tokens
from tallymark.llm.topk import exact_top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn
    return register


# The white space of the contracts as a DuckDB string, and a text's words.
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINES_SQL = f"""
WITH l AS (
  SELECT doc_id, pos, lines[pos] AS line, {_LOWER.format(f"trim(lines[pos], {_SPACE})")} AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS r(pos)),
shared AS (SELECT key, min(doc_id) AS keep FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.*, shared.keep IS NOT NULL AND shared.keep <> doc_id AS gone FROM l LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


@query("op5_line_dedup", LINES_SQL)
def op5(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


# Shares by the breakpoint of the sorted limits; documents by a running sum in hash order.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS s, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, (SELECT sum(s) FROM s) AS t, 3 * s / w AS c, row_number() OVER (ORDER BY 3 * s / w, source) AS k FROM s),
p AS (SELECT *, coalesce(sum(3 * s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
             sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM o),
b AS (SELECT t - held AS rest, open_w FROM p WHERE (t - held) / open_w <= c ORDER BY k LIMIT 1),
g AS (SELECT source, s, least(w::DOUBLE * rest / open_w::DOUBLE, 3 * s) AS target FROM o, b),
f AS (SELECT *, CASE WHEN s = 0 THEN 0 ELSE floor(target / s) END AS whole FROM g),
u AS (SELECT source, h, sum(size) AS sz FROM d GROUP BY source, h),
v AS (SELECT *, sum(sz) OVER (PARTITION BY source ORDER BY h) - sz AS before FROM u)
SELECT d.doc_id, d.size, f.s::BIGINT AS source_size, f.target,
       ((f.whole + CASE WHEN 2 * v.before + v.sz <= 2 * (f.target - f.whole * f.s) THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source JOIN v ON d.h = v.h AND d.source IS NOT DISTINCT FROM v.source"""


@query("op10_mixing", MIX_SQL)
def op10(spark: SparkSession, d: str) -> DataFrame:
    mixed = mix(table(spark, d, "documents").select("doc_id", "text", "source"), keep=("doc_id",))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Encoded and decoded again: counts and digests of ids and bytes."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_byte_bpe")
def op3(spark: SparkSession, d: str) -> DataFrame:
    return bpe_digests(table(spark, d, "documents"))


@query("op4_token_counts")
def op4(spark: SparkSession, d: str) -> DataFrame:
    counted = count_tokens(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op1_html_extraction")
def op1(spark: SparkSession, d: str) -> DataFrame:
    return extract(table(spark, d, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


# Fixed value: the score from which a text counts as toxic.
TOXIC = 0.7


def held_out() -> Column:
    """Rows that stay out of the training sample; a row without an id is none of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def toxicity_scores(spark: SparkSession, docs: DataFrame, d: str) -> DataFrame:
    """``docs`` with ``score``, by a model of the labelled rows of the original documents that are not held out."""
    model = toxicity.fit(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels"), use=~held_out())
    return toxicity.score(docs, model)


@query("op2_toxicity")
def op2(spark: SparkSession, d: str) -> DataFrame:
    scored = toxicity_scores(spark, table(spark, d, "documents").select("doc_id", "text"), d)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


# A demonstration key; a production run passes its own secret to the operator.
SURROGATE_KEY = b"tallymark"


@query("op9_surrogates")
def op9(spark: SparkSession, d: str) -> DataFrame:
    replaced = replace_entities(table(spark, d, "documents").select("doc_id", "text"), SURROGATE_KEY)
    return replaced.select("doc_id", "text", F.col("n_replaced").cast("long").alias("n_replaced"), "replaced")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::DOUBLE FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, "rank", vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS "rank" FROM p) WHERE "rank" <= 5"""


@query("op6_exact_top_k", TOP_K_SQL)
def op6(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


@query("op8_multiprobe_ann")
def op8(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


# All pairs with a common shingle, then the ids that links reach.
GROUPS_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
r AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION SELECT z.y, r.c FROM r JOIN (SELECT x, y FROM l UNION ALL SELECT y, x FROM l) z ON z.x = r.doc_id)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


@query("op7_ngram_jaccard_join", GROUPS_SQL)
def op7(spark: SparkSession, d: str) -> DataFrame:
    return similar_groups(table(spark, d, "documents").select("doc_id", "text"))


# The damage (crc32 by its table), then a search that keeps whole audits and whole texts per state.
REPAIR_SQL = r"""WITH RECURSIVE b AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) AS r(i))),
o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda s: ascii(s)::BIGINT),
           lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295), 4294967295) % 20 AS kind
  FROM conversations, b),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM o, unnest(CASE kind WHEN 0 THEN []::INTEGER[] WHEN 3 THEN [1, 2] ELSE [1] END) AS u(copy)),
n AS (
  SELECT *, row_number() OVER w AS pos, lag(role) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text))),
f AS (
  SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd'
           WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault FROM n),
-- States: 0 nothing, 1 system, 2 user, 3 assistant. k insertions, then one letter.
ins(a, k, z) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)),
nxt(a, z, r) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
mid AS (
  SELECT ins.a, ins.k, ins.z, repeat('I', ins.k) AS letters,
         CASE ins.k WHEN 0 THEN '' WHEN 1 THEN n1.r || ':' || chr(10) ELSE n1.r || ':' || chr(10) || n2.r || ':' || chr(10) END AS made
  FROM ins JOIN nxt n1 ON n1.a = ins.a JOIN nxt n2 ON n2.a = n1.z),
op AS (
  SELECT m.*, x.letter, x.cost + 2 * m.k AS cost, CASE x.letter WHEN 'D' THEN m.z WHEN 'S' THEN 1 ELSE nxt.z END AS e, nxt.r
  FROM mid m JOIN nxt ON nxt.a = m.z, (VALUES ('D', 3), ('R', 2), ('K', 0), ('S', 0)) AS x(letter, cost) WHERE x.letter <> 'S' OR m.z = 0),
p AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS st, {'cost': 0, 'audit': '', 'made': ''} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT p.conv_id, any_value(f.pos), op.e,
         min({'cost': p.best.cost + op.cost + CASE WHEN f.fault = 't' AND op.letter <> 'D' THEN 1 ELSE 0 END,
              'audit': p.best.audit || op.letters || CASE op.letter WHEN 'S' THEN 'K' ELSE op.letter END,
              'made': p.best.made || op.made || CASE op.letter WHEN 'D' THEN '' WHEN 'R' THEN op.r || ':' || f.text || chr(10) ELSE f.role || ':' || f.text || chr(10) END})
  FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos + 1 JOIN op ON op.a = p.st
  WHERE op.letter = 'D' OR (f.fault NOT IN ('b', 'd') AND (op.letter = 'R' OR (op.letter = 'S' AND f.i = 's') OR (op.letter = 'K' AND f.i = left(op.r, 1))))
  GROUP BY p.conv_id, op.e),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (pos > 1 AND left(before, 1) || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
z AS (
  SELECT p.conv_id, min({'cost': p.best.cost + 2 * m.k, 'audit': p.best.audit || m.letters, 'made': p.best.made || m.made}) AS best
  FROM p LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM p.conv_id JOIN mid m ON m.a = p.st AND m.z IN (0, 3)
  WHERE p.pos = coalesce(c.n, 0) GROUP BY p.conv_id)
SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, z.best.cost::BIGINT AS cost, z.best.audit AS audit, sha256(left(z.best.made, greatest(length(z.best.made) - 1, 0))) AS repaired_sha256
FROM z LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM z.conv_id"""


@query("op12_conversation_repair", REPAIR_SQL)
def op12(spark: SparkSession, d: str) -> DataFrame:
    steps = repair_steps(damaged(table(spark, d, "conversations")), live_col="live")
    return figures(steps).withColumnRenamed("conv", "conv_id")


RANKED_SQL = r"""
WITH r AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS (SELECT doc_id, k, ts, len(ts)::BIGINT AS n FROM r WHERE len(ts) > 0),
a AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d),
p AS (SELECT k, t, count(*)::BIGINT AS tf FROM (SELECT k, unnest(ts) AS t FROM d) GROUP BY k, t),
w AS (SELECT t, floor(1000 * ln((2 * a.docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, a GROUP BY t, a.docs),
m AS (SELECT k, doc_id, 100 - 25 + (25 * n * a.docs) // a.terms AS m FROM d, a),
i AS (SELECT item_id, t, count(*)::BIGINT AS q FROM (
  SELECT item_id, unnest(regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, t),
s AS (
  SELECT item_id, doc_id, k, sum(q * w.w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM i JOIN p USING (t) JOIN w USING (t) JOIN m USING (k) GROUP BY item_id, doc_id, k)
SELECT item_id, "rank", doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS "rank" FROM s WHERE score > 0) WHERE "rank" <= 20""".replace("{lower}", _LOWER.format("text"))


@query("op13_ranked_search", RANKED_SQL)
def op13(spark: SparkSession, d: str) -> DataFrame:
    return rank_documents(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text"))


def lang_held_out() -> Column:
    """Rows that no language is learned from; a row without an id is none of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


@query("op11_language_id")
def op11(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang"), use=~lang_held_out())
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", lang_held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
