import hashlib
import random

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallymark.llm import bpe
from tallymark.llm.token_counts import count_tokens, packed, special_strings, total
from tests.llm.conftest import SF, needs_data

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def long_text(seed: int, words: int) -> str:
    rnd = random.Random(seed)
    kinds = ["word", " the", "\n\n", "   ", "don't", "1234567", "Ééç", "中文字", "🙂", "!?!", "\t", "x"]
    return "".join(rnd.choice(kinds) * rnd.randint(1, 3) for _ in range(words))


def texts():
    rows = [(1, "a  b\n\n c's"), (2, ""), (3, None), (None, "no id"), (4, "same"), (4, "same"), (5, "<|endoftext|> x <|endoftext|>")]
    rows += [(10, long_text(1, 30_000)), (11, "a" * 40_000 + " b"), (12, " " * 70_000 + "z" + long_text(3, 9000)), (13, long_text(2, 12_000))]
    return rows + [rows[7], (10, long_text(5, 15_000)), (14, "x " * bpe.CHUNK)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in texts()], DOCS)


def test_encoding_equals_the_library_and_round_trips(spark, docs, library):
    coded = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    key = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    expected = key([(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts()])
    assert key([(r["doc_id"], r["ids"], bytes(r["decoded"])) for r in coded]) == expected


def test_cuts_lie_at_true_starts_and_do_cut(spark):
    text = long_text(7, 30_000)
    long = spark.createDataFrame([(1, text, 1, "k")], "_b_id long, _b_text string, _b_n long, _b_row string")
    parts = [r["_b_text"] for r in bpe.segments(long, public_tokenizers.PATTERN).orderBy("_b_run").collect()]
    assert "".join(parts) == text and len(parts) > 2 and max(map(len, parts)) <= bpe.CHUNK + bpe.OVERLAP


def test_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert bpe.decode(bpe.encode(none, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
    assert count_tokens(none, JSON).count() == 0


def test_unknown_ids_fail_and_null_ids_stay(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(rows, RANKS).collect()} == {1: None, 2: bytearray()}
    with pytest.raises(Exception, match="KeyError|IndexError"):
        bpe.decode(spark.createDataFrame([(1, [50_256])], "doc_id long, ids array<int>"), RANKS).collect()


def test_counts_equal_the_library(spark, docs):
    tokenizer = Tokenizer.from_file(JSON)
    expected = sorted(
        (i is None, i or 0, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in texts())
    got = sorted((r[0] is None, r[0] or 0, r[1], r[2]) for r in count_tokens(docs, JSON).collect())
    assert got == expected


def test_packed_frequencies():
    tokens = np.array([3, 0, 5, 7])
    assert total(packed(np.array([2, 0, 2, 3], np.int32)), tokens) == 20 and total(packed(np.zeros(0, np.int32)), tokens) == 0


def test_only_plain_byte_level_files_are_accepted():
    assert special_strings(JSON) == ["<|endoftext|>"]
    with pytest.raises(ValueError, match="byte-level"):
        special_strings(public_tokenizers.path("word_bpe_49k.json"))


@needs_data
def test_queries_over_the_documents(spark, library):
    from tallymark.llm.queries import QUERIES

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    tokenizer = Tokenizer.from_file(JSON)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {d: library.encode_ordinary(t or "") for d, t in zip(docs["doc_id"], docs["text"])}
    plain = {d: (len(i), sha(" ".join(map(str, i)).encode()), sha((t or "").encode())) for (d, i), t in zip(ids.items(), docs["text"])}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op3_byte_bpe"](spark, SF).collect()} == plain
    counts = {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t in zip(docs["doc_id"], docs["text"])}
    got = QUERIES["op4_token_counts"](spark, SF)
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == counts
    assert got.where(F.col("over_limit") != (F.col("n_tokens") > 512)).count() == 0
