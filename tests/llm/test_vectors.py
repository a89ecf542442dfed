import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallymark.llm import ann
from tallymark.llm.ann import FOUND, _reranked, _salted, fit, nearest, probe_template
from tallymark.llm.topk import ImpactIndex, exact_top_k
from tests.llm.conftest import SF, needs_data

SCHEMA = "vec_id long, embedding array<double>, ids long, vec string"
BAD = [(900, None), (901, [1.0, None, 0.5]), (902, [float("nan"), 1.0, 2.0]), (903, [float("inf"), 0.0, 0.0]), (904, []), (None, [1.0, 1.0, 1.0])]


def rows():
    rng = np.random.default_rng(3)
    out = [(i, rng.normal(size=3).round(2).tolist()) for i in range(150)]
    out += [(200 + i, [0.25, -0.5, 0.75]) for i in range(40)] + [(300, [1.0, 2.0]), (301, [2.0, 1.0]), (302, [0.5, 0.5])]
    return out + [(400, [0.0, 0.0, 0.0])]


def frame(spark, data):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in data], SCHEMA)


def brute(data, asked, k, score, largest):
    out = set()
    for q, qv in asked:
        found = [(score(np.array(qv), np.array(v)), i) for i, v in data if i != q and len(v) == len(qv)]
        found.sort(key=lambda x: (-x[0] if largest else x[0], x[1]))
        out |= {(q, r + 1, i, s) for r, (s, i) in enumerate(found[:k])}
    return out


def test_exact_top_k_equals_brute_force(spark):
    data = rows()
    asked = [r for r in data if r[0] % 10 == 0]
    whole = lambda a, b: int(np.floor(a * 256).astype(int) @ np.floor(b * 256).astype(int))
    got = exact_top_k(frame(spark, data + BAD), frame(spark, asked + BAD), 5)
    assert {tuple(r) for r in got.collect()} == brute(data, asked, 5, whole, True)
    assert exact_top_k(frame(spark, BAD), frame(spark, BAD), 5).count() == 0
    assert exact_top_k(frame(spark, data[:3]), frame(spark, data[:1]), 5).count() == 2


def test_search_stops_early_and_keeps_the_best():
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(5000, 16)) * 100).astype(np.int64)
    index = ImpactIndex(vectors)
    for weight in (rng.normal(size=16), np.eye(16)[3], np.zeros(16)):
        query = (weight * 50).astype(np.int64)
        where, score = index.search(query, 6)
        assert (vectors[where] @ query == score).all()
        assert sorted(score)[-6:] == sorted(vectors @ query)[-6:]
    assert len(index.search((np.eye(16)[3] * 50).astype(np.int64), 6)[0]) < 5000


def test_probes_come_in_order_of_expected_success():
    found = probe_template(3, 27)
    assert found[:3] == [(), (1,), (2,)] and len(set(found)) == len(found) == 27
    assert all(not (j in r and 7 - j in r) for r in found for j in range(1, 4))


def test_probed_buckets_are_distinct_neighbours():
    x = np.random.default_rng(0).normal(size=(300, 8))
    made = fit(x, 300, 5, 3)
    probed, home = made.probed(x[:5]), made.buckets(x[:5])
    assert (probed[:, :, 0] == home).all() and np.abs(probed - home[:, :, None]).max() <= 1
    assert len(np.unique(probed[0, 0], axis=0)) == made.probes


def test_nearest_scores_are_exact_and_short_results_only_for_small_tables(spark):
    data = rows()
    asked = [r for r in data if r[0] % 10 == 0]
    far = lambda a, b: float(np.sqrt(((a - b) ** 2).sum()))
    got = {tuple(r) for r in nearest(frame(spark, data + BAD), frame(spark, asked + BAD), 4).collect()}
    data, asked = [r for r in data if any(r[1])], [r for r in asked if any(r[1])]
    expected = brute(data, asked, 4, far, False)
    vectors = dict(data)
    assert len(got) == len(expected) and all(s == pytest.approx(far(np.array(vectors[q]), np.array(vectors[i]))) for q, _, i, s in got)
    pairs = lambda x: {(q, i) for q, _, i, _ in x}
    assert len(pairs(got) & pairs(expected)) >= 0.9 * len(expected)
    assert {(q, i) for q, i in pairs(got) if q == 300} == {(300, 301), (300, 302)}
    assert nearest(frame(spark, BAD), frame(spark, BAD), 4).count() == 0


@needs_data
def test_queries_against_brute_force(spark):
    from tallymark.llm.queries import QUERIES

    table = pd.read_parquet(f"{SF}/embeddings.parquet")
    data = [(int(i), np.asarray(v, float)) for i, v in zip(table["vec_id"], table["embedding"])]
    whole = lambda a, b: int(np.floor(a * 256).astype(int) @ np.floor(b * 256).astype(int))
    got = {tuple(r) for r in QUERIES["op6_exact_top_k"](spark, SF).collect()}
    assert got == brute(data, [r for r in data if r[0] % 50 == 0], 5, whole, True)
    found = {(r[0], r[2]) for r in QUERIES["op8_multiprobe_ann"](spark, SF).collect()}
    expected = {(q, i) for q, _, i, _ in brute(data, [r for r in data if r[0] % 100 == 0], 10, lambda a, b: np.sqrt(((a - b) ** 2).sum()), False)}
    assert len(found) == len(expected) and len(found & expected) >= 0.9 * len(expected)


def test_scores_that_could_leave_64_bits_are_an_error(spark):
    from tallymark.llm.topk import exact_top_k

    fits = [(i, [2.0**20 * (i + 1), -3.0]) for i in range(4)]
    docs = spark.createDataFrame(fits, "vec_id long, embedding array<double>")
    top = exact_top_k(docs, docs.where("vec_id = 0"), 1).first()
    assert (top["vec_id"], top["score"]) == (3, (2**28) * (2**30) + 768 * 768)
    large = spark.createDataFrame([*fits, (9, [1e17, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="leave 64 bits: id 9"):
        exact_top_k(large, docs.where("vec_id = 0"), 1).collect()


def test_the_sizes_of_cells_are_broadcast_and_never_the_probes(spark):
    """Queries are few and their probes are many: an optimizer that takes the first for the second sends all to the driver."""
    vec, cell = F.array(F.col("id").cast("double")), (F.col("id") % 50).alias("cell")
    index = spark.range(1_000_000).select(F.lit(0).alias("tab"), cell, F.col("id").alias("bucket"), vec.alias("vec"), F.array("id").alias("ids"))
    asked = spark.range(100).select(F.lit(0).alias("tab"), cell, vec.alias("vec"), F.col("id").alias("q"), F.array("id").alias("buckets"))
    plan = _salted(index, asked, ["tab", "cell"]).applyInArrow(_reranked(3), FOUND)._jdf.queryExecution().executedPlan().toString().splitlines()
    below = [plan[i + 1] for i, line in enumerate(plan) if "BroadcastExchange" in line]
    assert below and all("HashAggregate" in line for line in below)


def test_fitting_takes_little_memory_however_many_probes():
    x = np.random.default_rng(2).normal(size=(2000, 32))
    tracemalloc.start()
    made = fit(x, 15_000_000, 10, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.axes.shape[1] == 8 and made.probes > 500 and peak < 60e6


def test_the_sample_is_the_vectors_with_the_smallest_hashes(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 7)
    rows = spark.range(100).select(F.array(F.col("id").cast("double")).alias("vec"))
    assert ann._sample(rows) == [r["vec"] for r in rows.orderBy(F.xxhash64("vec")).limit(7).collect()] and ann._sample(rows.limit(0)) == []


def test_cells_of_a_table_have_a_bound_and_change_nothing(spark, monkeypatch):
    data = rows()
    results = []
    for block, cells in ((8_192, 16_384), (8, 16_384), (8, 3)):
        monkeypatch.setattr(ann, "BLOCK", block)
        monkeypatch.setattr(ann, "CELLS", cells)
        results.append(sorted(tuple(r) for r in nearest(frame(spark, data), frame(spark, data[::9]), 4).collect()))
    assert results[0] and results[0] == results[1] == results[2]
