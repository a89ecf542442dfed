"""Training corpus from documents: toxic ones go, shared lines go, near copies go, sources are mixed, texts are encoded.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import table
from tallymark.llm.line_dedup import dedup_lines
from tallymark.llm.mixing import mix
from tallymark.llm.ngram_join import one_of_each
from tallymark.llm.queries import TOXIC, bpe_digests, toxicity_scores
from tallymark.session import stored

# Words of a shingle, and the similarity of near copies as a fraction.
NEAR = (5, 80, 100)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit; the model learns from the labelled rows of the original table.

    Null, empty and blank texts have the score of the bias alone and stay unless most labelled documents are toxic.
    Repeated rows score alike and stay or go together. Without labels, or with those of one class, the share of that
    class decides. An empty table stays empty.
    """
    return toxicity_scores(spark, docs, sf_dir).where(F.col("score") < TOXIC).select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a document with a smaller id holds too; ``n_chars`` follows the text."""
    kept = dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of similar documents the row with the smallest id; rows without an id come last and are compared too.

    Rows are known by id and text, so an id that is repeated with another text loses neither, and of equal rows one
    stays. Texts without words are similar to nothing and all stay. Near copies share four fifths of their five-word
    shingles; the values of op7_ngram_jaccard_join bind that query alone.
    """
    return one_of_each(docs, *NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each copy a row.

    Null sources are one source. Texts without words weigh nothing and come as often as their source's whole passes;
    repeated rows share a hash and are taken together. An empty table stays empty.
    """
    mixed = mix(docs).where(F.col("times") > 0)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return mixed.withColumn("_copy", copies).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row of the mix: number of tokens, and digests of its ids and of the bytes they decode to.

    A null or empty text has no tokens and the digests of nothing; a copy in the mix gets a row of its own. An empty
    table stays empty.
    """
    return bpe_digests(docs)


STAGES = [
    ("toxicity", drop_toxic), ("line_dedup", drop_shared_lines), ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources), ("byte_bpe", encode_texts),
]

# Neither the trained scores nor the merges of an encoder are SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
