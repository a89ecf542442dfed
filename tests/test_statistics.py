import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.functions.hashing import splitmix, splitmix_draw
from tallymark.operators import compare as C
from tallymark.operators.judge import confusion_kappa
from tallymark.operators.ranks import global_index, nearest_ranks, rank_of

M64 = (1 << 64) - 1


def sequential(seed, count, n):
    state, out = seed, []
    for _ in range(count):
        state = (state + 0x9E3779B97F4A7C15) & M64
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & M64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & M64
        out.append(((z ^ (z >> 31)) * n) >> 64)
    return out


def test_draws_are_addressable(spark):
    assert splitmix(42, np.arange(1, 2001), 1_000_003).tolist() == sequential(42, 2000, 1_000_003)
    rows = spark.range(1, 101).select(splitmix_draw(7, F.col("id"), 7).alias("d")).collect()
    assert [r.d for r in rows] == sequential(7, 100, 7)


def interval(spark, deltas, **options):
    rows = spark.createDataFrame([("m", i, float(x)) for i, x in enumerate(deltas)], "metric string, doc_id long, delta double")
    return C.paired_bootstrap(rows, ["metric"], **options).first()


@pytest.mark.parametrize("deltas,want", [
    ([0, 1], (0.5, 0, 1, False)), ([1, 2], (1.5, 1, 2, True)), ([0, 0, 0, 1], (0.25, 0, 0.75, False)), ([-0.25] * 50, (-0.25,) * 3 + (True,))])
def test_bootstrap_known_intervals(spark, deltas, want):
    row = interval(spark, deltas)
    assert (row.mean, row.low, row.high, row.significant) == want


def test_bootstrap_follows_the_stream(spark):
    rng = random.Random(3)
    deltas = [rng.choice([-1.0, 0.0, 0.5]) for _ in range(37)]
    row = interval(spark, deltas, resamples=600)
    draws = sequential(42, 600 * 37, 37)
    means = []
    for r in range(600):
        total = 0.0
        for i in draws[r * 37:(r + 1) * 37]:
            total += deltas[i]
        means.append(total / 37)
    means.sort()
    assert (row.low, row.high) == (means[14], means[584])


@pytest.mark.parametrize("n", [300, 20_500])
def test_default_bootstrap_on_both_sides_of_any_size(spark, n):
    rng = random.Random(n)
    deltas = np.array([rng.choice([-1.0, 0.0, 0.25, 0.5]) for _ in range(n)])
    row = interval(spark, deltas)
    means = []
    for r in range(10_000):  # quarters add up exactly in any order
        means.append(deltas[splitmix(42, np.arange(r * n + 1, r * n + n + 1), n)].sum() / n)
    means.sort()
    assert (row.n, row.low, row.high) == (n, means[249], means[9749])
    assert row.significant == (means[249] > 0 or means[9749] < 0)


@pytest.mark.parametrize("block", [1, 7, 100, 1000])
def test_blocks_of_deltas_change_nothing(spark, block):
    rng = random.Random(4)
    deltas = [rng.choice([-1.0, 0.0, 0.0, 1.0]) for _ in range(101)]
    assert interval(spark, deltas, resamples=700, index_block=block) == interval(spark, deltas, resamples=700)


def test_shares_of_blocks_are_one_multinomial():
    """Every resample's shares add up to n, and over many resamples they have the means and variances of draws by size."""
    n, size = 2_350, 300
    blocks, shares = -(-n // size), []
    for r0 in range(0, 4_000, 500):
        rs = np.arange(r0, r0 + 500)
        shares.append(np.stack([C.block_draws(42, n, b, rs, size) for b in range(blocks)], axis=1))
    shares = np.concatenate(shares)
    assert (shares.sum(axis=1) == n).all() and shares.min() >= 0
    p = np.minimum(size, n - size * np.arange(blocks)) / n
    assert np.abs(shares.mean(axis=0) - n * p).max() < 4 * math.sqrt(n / 4 / len(shares))
    assert np.allclose(shares.var(axis=0), n * p * (1 - p), rtol=0.12)
    assert not np.array_equal(shares[:500], shares[500:1_000])


def test_a_block_makes_only_its_own_draws():
    n, size, made = 1_000, 64, 0
    for b in range(-(-n // size)):
        made += sum(int(c.sum()) for c in C.hierarchical_counts(7, n, b, np.arange(20), size))
    assert made == 20 * n


def test_both_methods_agree_but_for_chance(spark):
    rng = random.Random(5)
    deltas = [rng.choice([-1.0, 0.0, 0.25, 0.5]) for _ in range(2_000)]
    stream = interval(spark, deltas, resamples=4_000)
    tree = interval(spark, deltas, resamples=4_000, method=C.HIERARCHICAL, index_block=128)
    error = np.std(deltas) / math.sqrt(len(deltas))
    assert (stream.method, tree.method) == ("stream", "hierarchical") and stream.n == tree.n and stream.mean == tree.mean
    assert abs(stream.low - tree.low) < 0.2 * error and abs(stream.high - tree.high) < 0.2 * error and stream.low != tree.low
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    assert interval(spark, deltas, resamples=4_000, method=C.HIERARCHICAL, index_block=128) == tree
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert tuple(interval(spark, [-0.25] * 50, method=C.HIERARCHICAL, index_block=7))[2:5] == (-0.25,) * 3


def test_no_deltas_are_an_error(spark):
    rows = spark.createDataFrame([("m", 1, None)], "metric string, doc_id long, delta double")
    with pytest.raises(ValueError, match="no deltas"):
        C.paired_bootstrap(rows, ["metric"])


def test_bootstrap_arguments(spark):
    rows = spark.createDataFrame([("m", 1, 0.5)], "metric string, doc_id long, delta double")
    for options in ({"resamples": 0}, {"confidence": 1.0}, {"confidence": 0.0}, {"method": "other"}):
        with pytest.raises(ValueError):
            C.paired_bootstrap(rows, ["metric"], **options)


@pytest.mark.parametrize("p,n,index", [(0.025, 10000, 249), (0.975, 10000, 9749), (0.5, 5, 2), (0, 5, 0), (1, 5, 4)])
def test_nearest_rank_index(spark, p, n, index):
    assert spark.range(1).select(rank_of(p, F.lit(n).cast("long"))).first()[0] - 1 == index


def test_ranks_against_sorting_with_a_hot_key_and_a_hot_value(spark):
    rng = random.Random(8)
    data = [("hot" if rng.random() < 0.8 else rng.choice("abc"), rng.choice([7.0, rng.gauss(0, 100)])) for _ in range(5000)]
    got = nearest_ranks(spark.createDataFrame(data, "k string, v double"), ["k"], "v", {"a": 0.5, "b": 0.95, "c": 0.01}).collect()
    for row in got:
        values = sorted(v for k, v in data if k == row.k)
        assert row.n == len(values)
        for name, p in (("a", 50), ("b", 95), ("c", 1)):
            assert row[name] == values[max(0, -(-p * len(values) // 100) - 1)]


@pytest.mark.parametrize("ordered", [1, 3, 50])
def test_ranges_narrow_until_they_are_small(spark, ordered):
    rng = random.Random(9)
    data = [(k, rng.choice([0.0, float(rng.randrange(300)), rng.gauss(0, 5)]), rng.randrange(1, 4)) for k in ("a", "b", None) for _ in range(400)]
    data += [("c", 1.0, 1), ("a", None, 5)]
    rows = spark.createDataFrame(data, "k string, v double, w long").where("k is not null")
    ps = {"low": 0.01, "mid": 0.5, "high": 0.99}
    for row in nearest_ranks(rows, ["k"], "v", ps, weight="w", ordered=ordered).collect():
        values = sorted(v for k, v, w in data if k == row.k and v is not None for _ in range(w))
        assert row.n == len(values)
        assert [row[name] for name in ps] == [values[max(0, math.ceil(round(p * len(values), 9)) - 1)] for p in ps.values()]
    whole = nearest_ranks(rows, [], "v", ps, ordered=ordered).first()
    values = sorted(v for k, v, _ in data if k is not None and v is not None)
    assert [whole[name] for name in ps] == [values[max(0, math.ceil(round(p * len(values), 9)) - 1)] for p in ps.values()]


def test_one_key_of_ten_million_distinct_values(spark):
    n = 10_000_000
    rows = spark.range(n).select(F.lit("hot").alias("k"), ((F.col("id") * 7_368_787) % n).alias("v"))
    row = nearest_ranks(rows, ["k"], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (row.n, row.p50, row.p95) == (n, n // 2 - 1, n * 95 // 100 - 1)


def test_global_index_is_dense(spark):
    rows = global_index(spark.range(1000).selectExpr("id * 7 as id"), F.col("id"), ["id"])
    assert sorted(r.idx for r in rows.collect()) == list(range(1000))


@pytest.mark.parametrize("cells,kappa", [((4, 1, 1, 4), 0.6), ((45, 5, 15, 35), 0.6), ((3, 0, 0, 0), math.nan)])
def test_kappa(spark, cells, kappa):
    pairs = [p for p, n in zip([(True, True), (True, False), (False, True), (False, False)], cells) for _ in range(n)]
    row = confusion_kappa(spark.createDataFrame(pairs, "human boolean, judge boolean")).first()
    assert (row.tt, row.tf, row.ft, row.ff) == cells and not row.accepted
    assert math.isnan(row.kappa) if math.isnan(kappa) else row.kappa == pytest.approx(kappa)


def test_opposite_signs_show_both_subsets(spark):
    rows = spark.createDataFrame([
        ("composite", "fatura", 0.1), ("composite", "synthetic", -0.1), ("composite", "combined", 0.05),
        ("field_total", "fatura", 0.1), ("field_total", "synthetic", 0.2), ("field_total", "combined", 0.15),
        ("line_items_f1", "synthetic", 0.1), ("line_items_f1", "combined", 0.1)], "metric string, subset string, mean double")
    shown = sorted((r.metric, r.subset) for r in C.shown_rows(rows).collect())
    assert shown == [("composite", "combined"), ("composite", "fatura"), ("composite", "synthetic"),
                     ("field_total", "combined"), ("line_items_f1", "synthetic")]


def test_a_stream_draws_once_for_as_many_blocks_as_a_task_holds(spark):
    """Blocks far smaller than what a task holds are one span; a smaller hold gives more spans and the same sums."""
    deltas = [(g, i, (i * 7 + len(g)) % 5 * 0.25) for g in ("a", "bc") for i in range(101)]
    placed = spark.createDataFrame([(g, d, i) for g, i, d in deltas], "gid string, delta double, idx long")
    sizes = placed.groupBy("gid").agg(F.count("*").alias("n"))
    rows = C._block_sums(placed, sizes, 30, 42, 7, C.STREAM).collect()
    assert {r.block for r in rows} == {0} and len(rows) == 60
    draws = sequential(42, 30 * 101, 101)
    want = {(g, r): sum(deltas[(0 if g == "a" else 101) + i][2] for i in draws[r * 101:(r + 1) * 101]) for g in ("a", "bc") for r in range(30)}
    assert {(r.gid, r.r): r.total for r in rows} == want
    values = np.array([[d] for g, _, d in deltas if g == "a"])
    parts = [C.stream_totals(42, 101, low, values[low:low + 40], np.arange(30)) for low in (0, 40, 80)]
    assert sum(parts)[:, 0].tolist() == [want["a", r] for r in range(30)]


def _held(columns, size, coded=True):
    held = C.Held()
    for deltas in columns:
        column = C.Column(size, coded)
        for low in range(0, size, 13):
            column.add(deltas[low:low + 13])
        held.add(column)
    return held


def test_one_code_stands_for_a_row_of_deltas(monkeypatch):
    """Packed or not, coded or spelled out, a resample has the sums of a plain loop over the stream."""
    n, rs = 101, np.arange(3, 9)
    few = [np.array([(i * (g + 3)) % 3 * 0.5 - 0.5 for i in range(n)]) for g in range(6)]
    many = np.arange(n) * 0.25
    columns = [*few[:3], many, *few[3:], np.array([0.0, -0.0, np.inf] * 33 + [1.0, 2.0])]
    want = np.array([np.sum([c[sequential(42, 9 * n, n)[r * n:(r + 1) * n]] for c in columns], axis=1) for r in rs.tolist()])
    for codes in (1 << 16, 60, 5):
        monkeypatch.setattr(C, "CODES", codes)
        held = _held(columns, n)
        assert np.array_equal(held.totals(42, n, 0, n, rs), want)
        assert len(held.raws) == (1 if codes == 1 << 16 else 2) and len(held.packs) == 1
    apart = _held([np.arange(n) % 5 * 0.5, np.arange(n) // 5 % 5 * 0.5], n)
    assert len(apart.packs) == 2 and apart.totals(42, n, 0, n, rs)[0].tolist() == [
        sum(i // by % 5 * 0.5 for i in sequential(42, 4 * n, n)[3 * n:]) for by in (1, 5)]
    assert np.array_equal(_held(columns, n, False).totals(42, n, 0, n, rs), want)
    assert np.array_equal(_held(few, n).totals(42, n, 0, n, rs), want[:, [0, 1, 2, 4, 5, 6]])
    halves = [_held([c[low:low + 51] for c in few], len(few[0][low:low + 51])).totals(42, n, low, len(few[0][low:low + 51]), rs) for low in (0, 51)]
    assert np.array_equal(sum(halves), want[:, [0, 1, 2, 4, 5, 6]])


def test_groups_of_few_different_deltas_take_one_span(spark, monkeypatch):
    """What a task holds is counted in bytes: eight groups of a few different deltas need five a place, not 64."""
    monkeypatch.setattr(C, "HELD", 2_000)
    placed = spark.createDataFrame([(f"g{g}", (i * g) % 5 * 0.25, i) for g in range(8) for i in range(201)], "gid string, delta double, idx long")
    sizes = placed.groupBy("gid").agg(F.count("*").alias("n"), F.approx_count_distinct("delta").alias("kinds"))
    rows = C._block_sums(placed, sizes, 120, 42, 50, C.STREAM).collect()
    draws = sequential(42, 120 * 201, 201)
    want = {(f"g{g}", r): sum((i * g) % 5 * 0.25 for i in draws[r * 201:(r + 1) * 201]) for g in range(8) for r in range(120)}
    assert len(rows) == 960 and {r.block for r in rows} == {0} and {(r.gid, r.r): r.total for r in rows} == want


def test_a_comparison_makes_its_draws_once(spark):
    paired = spark.createDataFrame(
        [(i, ("fatura", "synthetic")[i % 2], m, (i % 5 - 1.5) * (1, -1)[i % 2]) for i in range(20) for m in ("composite", "field_total")],
        "doc_id long, source string, metric string, delta double")
    rows = C.compare_rows(paired, resamples=60)
    assert "MapInPandas" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 6
