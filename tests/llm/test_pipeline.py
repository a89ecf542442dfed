import hashlib
from collections import Counter

import pandas as pd
import public_tokenizers
import tiktoken

import corpus_pipeline
from tallymark.llm import bpe
from tallymark.llm.queries import MIX_SQL, QUERIES
from tests.llm.conftest import SF, duck, needs_data
from tests.llm.plain import deduped, similar


@needs_data
def test_every_stage_equals_its_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.toPandas())
    original, clean, lines, single, mixed, coded = seen
    assert all(list(x.columns) == list(original.columns) for x in seen[:-1])

    scores = {r["doc_id"]: r["score"] for r in QUERIES["op2_toxicity"](spark, SF).collect()}
    pairs = lambda frame: list(zip(frame["doc_id"].tolist(), frame["text"].tolist()))
    assert sorted(pairs(clean)) == sorted(p for p in pairs(original) if scores[p[0]] < 0.7)
    assert sorted(pairs(lines)) == sorted((i, t) for i, t, _, _ in deduped(pairs(clean)))
    assert (lines["n_chars"] == lines["text"].str.len()).all()
    rows = pairs(lines)
    groups = similar(rows, *corpus_pipeline.NEAR)
    assert sorted(pairs(single)) == sorted(r for x, r in enumerate(rows) if groups[x][1] == r[0])
    times = Counter(dict(duck(f"SELECT doc_id, CASE WHEN size = 0 THEN 0 ELSE taken // size END FROM ({MIX_SQL})", {"documents": single})))
    empty = {i for i, t in pairs(single) if not t.split()}
    taken = Counter(mixed["doc_id"].tolist())
    assert {i: n for i, n in taken.items() if i not in empty} == {i: n for i, n in times.items() if n}
    assert dict(pairs(mixed)) == {i: t for i, t in pairs(single) if taken[i]}
    encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    plain = Counter((i, hashlib.sha256(" ".join(map(str, encoder.encode_ordinary(t))).encode()).hexdigest()) for i, t in pairs(mixed))
    assert Counter(zip(coded["doc_id"].tolist(), coded["ids_sha256"])) == plain


def test_stages_keep_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "a text without an id", "en", "s", 20), (2, "", "en", None, 0), (None, None, None, "s", None), (2, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    assert kept.count() == len(rows)
    again = [(7, "one row written twice", "en", "s", 21)] * 2
    assert corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(again, schema), str(tmp_path)).count() == 1
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_near_copies_of_a_similarity_from_four_fifths_go(spark):
    words = [f"w{i}" for i in range(204)]
    rows = [
        (1, " ".join(words)), (2, " ".join(words[:174])),  # 170 of 200 shingles: 0.85
        (3, " ".join(words[:164])),  # 160 of 200: exactly 0.8
        (4, " ".join(words[:120])), (5, " ".join(f"v{i}" for i in range(50))),
    ]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    plain = similar(rows, 5, 80, 100)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5] == sorted(r[0] for x, r in enumerate(rows) if plain[x][1] == r[0])
