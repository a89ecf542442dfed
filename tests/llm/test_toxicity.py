import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallymark.llm import toxicity as t
from tests.llm.conftest import SF, needs_data


def corpus(n=120):
    rng = np.random.default_rng(0)
    plain = ["house", "tree", "river", "stone", "cloud", "garden", "window", "paper", "silver", "winter"]
    rude = ["horrible", "stupid", "idiot"]
    rows = []
    for i in range(n):
        words = list(rng.choice(plain, 40))
        if i % 3 == 0:
            words[int(rng.integers(40))] = str(rng.choice(rude))
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


def test_misspelt_words_are_found_by_their_grams(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7, None), (None, 1)], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    again = t.fit(docs, labels)
    assert np.array_equal(model.grams, again.grams) and model.bias == again.bias
    new = spark.createDataFrame(
        [(1, "house stupiid tree", "s"), (2, "river stone winter", "s"), (3, "", "s"), (4, None, "s"), (None, "an idiott " + "tree " * 5000, "s"),
         (2, "river stone winter", "s")], "doc_id long, text string, score string")
    got = t.score(new, model)
    assert dict(got.dtypes)["score"] == "double"
    found = {(r["doc_id"], r["text"] is None): r["score"] for r in got.collect()}
    assert got.count() == 6 and found[1, False] > 0.5 and found[None, False] > 0.5 and found[2, False] < 0.3
    assert found[3, False] == found[4, True] < 0.5
    assert t.score(new.limit(0), model).count() == 0


def test_no_labels_or_one_class(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels, expected in ((none, 0.0), (spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), 1.0)):
        assert all(abs(r["score"] - expected) < 1e-6 for r in t.score(docs, t.fit(docs, labels)).collect())


def test_vectorised_grams_equal_a_plain_loop():
    words = ["ab", "ünï", "idiot", "idiott", "x"]
    bucket, owner = t.word_grams(words)
    counts = [sum(max(0, len(w) + 2 - n + 1) for n in t.GRAMS) + 1 for w in words]
    assert np.bincount(owner).tolist() == counts
    shared = set(bucket[owner == 2]) & set(bucket[owner == 3])
    assert len(shared) >= 9 and not set(bucket[owner == 0]) & set(bucket[owner == 2])


def plain_train(texts, labels, passes, seed=7):
    """The training rule, word by word and window by window."""
    docs = [t.words_of(x) for x in texts]
    grams = {w: t.word_grams([w])[0].tolist() for d in docs for w in d}
    share_of = {1: 0.5 / sum(labels), 0: 0.5 / (len(labels) - sum(labels))}
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (t.BUCKETS, t.DIM)), rng.normal(0, 1.0, t.DIM), np.array([-1.0])]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, passes + 1):
        table, out, bias = params
        sharp = t.SHARP[0] * (t.SHARP[1] / t.SHARP[0]) ** (step / t.PASSES)
        grad, total = np.zeros(t.BUCKETS), 0.0
        for words, y in zip(docs, labels):
            pairs = list(zip(words, words[1:])) or [(words[0], words[0])]
            value = {w: np.mean([table[g] @ out for g in grams[w]]) for w in words}
            window = np.array([(value[a] + value[b]) / 2 for a, b in pairs])
            weight = np.exp(sharp * (window - window.max()))
            weight /= weight.sum()
            error = (1 / (1 + np.exp(-(weight @ window + bias[0]))) - y) * share_of[y]
            total += error
            for (a, b), x in zip(pairs, weight):
                for w in (a, b):
                    for g in grams[w]:
                        grad[g] += error * x / 2 / len(grams[w])
        for i, g in enumerate([np.outer(grad, out), grad @ table, np.array([total])]):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - t.RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-9)
        params[0] = params[0] * (1 - t.RATE * t.DECAY)
    return params[0] @ params[1], params[2][0]


def test_training_and_scoring_equal_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(t, "PASSES", 4)
    monkeypatch.setattr(t, "WORDS", 3)
    texts = ["you stupid tree", "river", "stone cloud garden stone", "idiot", "a paper idiot window", "winter winter"]
    labels = [1, 0, 0, 1, 1, 0]
    model = t.train(texts, labels)
    grams, bias = plain_train(texts, labels, 4)
    assert np.allclose(model.grams, grams, atol=1e-5) and abs(model.bias - bias) < 1e-6
    rows = [(i, x) for i, x in enumerate([*texts, "", "new words stupidd here"])]
    got = {r["doc_id"]: r["score"] for r in t.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, x in rows:
        words = t.words_of(x)
        value = [np.mean(model.grams[t.word_grams([w])[0]]) for w in words]
        top = max([(a + b) / 2 for a, b in zip(value, value[1:])] or value or [0.0])
        assert abs(got[i] - 1 / (1 + np.exp(-(top + model.bias)))) < 1e-6


def test_a_word_in_front_hides_nothing(spark):
    rows = corpus()
    model = t.train([x for _, x, _ in rows], [y for _, _, y in rows])
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows] + [(1_000 + i, "garden " + x) for i, x, _ in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in t.score(docs, model).collect()}
    assert all(got[1_000 + i] >= got[i] - 1e-9 for i, _, _ in rows)


def test_repeated_and_contradicting_labels(spark):
    docs = spark.createDataFrame([(i, x) for i, x, _ in corpus()] + [(3, "another text")] * 5, "doc_id long, text string")
    labels = [(i, y) for i, _, y in corpus()]
    one = t.sample(docs, spark.createDataFrame(labels * 3, "doc_id long, toxic int"), F.lit(True), "doc_id", "text", "toxic").collect()
    assert len(one) == len(labels) and {r["_x_text"] for r in one if r["_x_id"] == 3} == {"another text"}
    both = t.sample(docs, spark.createDataFrame([*labels, (4, 1), (4, 0)], "doc_id long, toxic int"), F.lit(True), "doc_id", "text", "toxic").collect()
    assert sorted(r["_x_label"] for r in both if r["_x_id"] == 4) == [0, 1]


@needs_data
def test_query_on_held_out_rows(spark):
    from tallymark.llm.queries import QUERIES

    got = QUERIES["op2_toxicity"](spark, SF.replace("0.001", "0.1")).toPandas()
    assert got["score"].between(0, 1).all() and got["doc_id"].is_unique
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.7)).all()
    labels = pd.read_parquet(f"{SF.replace('0.001', '0.1')}/labels.parquet").merge(got[got["held_out"]], on="doc_id")
    hit = labels[labels["toxic"] == 1]["predicted"].mean()
    false = labels[labels["toxic"] == 0]["predicted"].mean()
    # 300 toxic documents to learn from, some of them marked by rare words only; five times as many give over 0.99.
    assert hit > 0.65 and false < 0.02, (hit, false)
