import random
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import langid
from tallymark.llm.langid import SWITCH, Model, Words, fit, identify, label_words, words_of
from tallymark.llm.queries import QUERIES
from tests.llm.conftest import SF, needs_data

TEXTS = {
    "en": ["the weather was nice and they walked through the old town with their friends", "which of these things would you like to have for the evening"],
    "de": ["das wetter war schön und sie gingen durch die alte stadt mit ihren freunden", "welche von diesen sachen möchten sie für den abend haben"],
    "el": ["ο καιρός ήταν καλός και περπάτησαν στην παλιά πόλη με τους φίλους τους"],
    "ru": ["погода была хорошая и они гуляли по старому городу со своими друзьями"],
    "zh": ["天气很好他们和朋友一起走过古城"],
}
DOCS = "doc_id long, text string, lang string, score int, spans string"


def learned(spark, more=()):
    rows = [(i, t, lang, 1, "x") for i, (lang, t) in enumerate((lang, t) for lang, ts in TEXTS.items() for t in ts * 5)]
    return fit(spark.createDataFrame([*rows, *more], DOCS).repartition(3))


def value(scores, labels):
    return sum(scores[i, k] for i, k in enumerate(labels)) - SWITCH * sum(a != b for a, b in zip(labels, labels[1:]))


def test_labels_are_the_best_of_all_labelings():
    rng = np.random.default_rng(3)
    for _ in range(200):
        scores = rng.normal(0, rng.choice([2, 8, 20]), (rng.integers(1, 8), rng.integers(1, 4))).astype(np.float32)
        got = label_words(scores, np.array([len(scores)]))
        best = max(value(scores, x) for x in product(range(scores.shape[1]), repeat=len(scores)))
        assert value(scores, got.tolist()) == pytest.approx(best, abs=1e-3)


def plain_viterbi(scores):
    total, back = scores[0].astype(float), []
    for row in scores[1:]:
        top = int(total.argmax())
        switched = total[top] - SWITCH
        back.append([top if switched > t else k for k, t in enumerate(total)])
        total = np.maximum(total, switched) + row
    return total.max()


def test_long_texts_in_one_go_equal_the_plain_search():
    rng = np.random.default_rng(4)
    parts = []
    for n in (1, 700, 0, 40, 2_000, 3):
        main = np.repeat(rng.integers(0, 4, n // 20 + 1), 20)[:n]
        parts.append((rng.normal(0, 3, (n, 4)) + 2 * np.eye(4)[main]).astype(np.float32))
    ends = np.cumsum([len(p) for p in parts])
    got = label_words(np.concatenate(parts), ends)
    for p, labels in zip(parts, np.split(got, ends[:-1])):
        if len(p):
            assert value(p, labels.tolist()) == pytest.approx(plain_viterbi(p), abs=1e-2)
            assert len(p) < 100 or len(set(labels.tolist())) > 1


def test_words_scripts_and_memory(monkeypatch):
    assert [(w, s) for _, w, s in words_of("don't ПриветHello 2x 天气 é́a ก็ดี")] == [
        ("don", "Latin"), ("t", "Latin"), ("Привет", "Cyrillic"), ("Hello", "Latin"), ("x", "Latin"), ("天", "Han"), ("气", "Han"),
        ("é́a", "Latin"), ("ก็", "Thai"), ("ดี", "Thai")]
    model = Model(["a", "b"], np.random.default_rng(0).normal(0, 1, (langid.BUCKETS, 2)).astype(np.float32), np.ones((len(langid.NAMES), 2), bool))
    monkeypatch.setattr(langid, "MEMO", 100)
    words, rng = Words(model), random.Random(1)
    for _ in range(50):
        tokens = ["".join(rng.choices("ab1-é", k=rng.randrange(1, 6))) for _ in range(20)]
        words.learn(set(tokens))
        got = words.scores[words.numbers(tokens)]
        plain = [(w, s) for t in tokens for _, w, s in words_of(t)]
        want = model.word_scores([w for w, _ in plain], [s for _, s in plain]) if plain else np.zeros((0, 2))
        assert np.allclose(got, want)


def test_spans_of_mixed_text_and_odd_rows(spark):
    model = learned(spark, [(900, None, "en", 1, "x"), (901, "zzz", None, 1, "x"), (902, "12 !", "xx", 1, "x")])
    assert model.langs == ["de", "el", "en", "ru", "zh"]
    a, b, c = TEXTS["de"][0], TEXTS["en"][1], TEXTS["ru"][0]
    texts = [a, f"{b} {c}", f"{a}. {b} {a}", None, "", "12 34 !?", "ηλιος", "天", "Ω", f"{b} " * 20_000 + a, "한국어", "x"]
    rows = [(i, t, "??", 1, "x") for i, t in enumerate(texts)] + [(0, a, "??", 1, "x")]
    got = sorted(identify(spark.createDataFrame(rows, DOCS).repartition(2), model).collect(), key=lambda r: r["doc_id"])
    assert len(got) == len(rows) and got[0]["lang"] == "??" and tuple(got[0])[3:] == tuple(got[1])[3:]
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9)] == ["de", "ru" if len(c) > len(b) else "en", "de", "und", "und", "und", "el", "zh", "el", "en"]
    assert by[11]["lang_pred"] in ("de", "en") and by[10]["lang_pred"] in model.langs
    assert [by[i]["score"] for i in (3, 4, 5)] == [0, 0, 0] and all(0 <= r["score"] <= 1 for r in got) and by[0]["score"] > 0.9
    assert [(s["lang"], s["start"]) for s in by[1]["spans"]] == [("en", 0), ("ru", len(b) + 1)]
    assert [s["lang"] for s in by[2]["spans"]] == ["de", "en", "de"] and by[2]["spans"][-1]["end"] == len(texts[2])
    assert [s["lang"] for s in by[9]["spans"]] == ["en", "de"] and by[9]["spans"][0]["end"] == by[9]["spans"][1]["start"]


def test_nothing_to_learn_from_and_empty_tables(spark):
    none = fit(spark.createDataFrame([(1, "text", None, 1, "x")], DOCS))
    df = spark.createDataFrame([(1, "some text", "en", 1, "x")], DOCS)
    row = identify(df, none).first()
    assert (row["lang_pred"], row["score"], row["spans"]) == ("und", 0.0, [])
    assert identify(df.limit(0), learned(spark)).collect() == []


def test_sample_is_bounded_per_language_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 3)
    rows = [(i, f"word{chr(97 + i % 26)} again", ("en", "de")[i % 4 == 0], 1, "x") for i in range(200)]
    df = spark.createDataFrame(rows, DOCS)
    few, again = fit(df.repartition(5)), fit(df.repartition(2))
    assert np.array_equal(few.table, again.table)
    hashes = {r["lang"]: sorted(r["h"]) for r in df.groupBy("lang").agg(F.collect_list(F.xxhash64("doc_id")).alias("h")).collect()}
    kept = fit(df.where(F.xxhash64("doc_id") <= F.when(F.col("lang") == "en", hashes["en"][2]).otherwise(hashes["de"][2])))
    assert np.array_equal(few.table, kept.table)


@needs_data
def test_held_out_rows_of_the_given_tables(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_language_id"](spark, SF).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]] is not None]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
