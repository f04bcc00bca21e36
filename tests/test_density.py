"""Vector aggregates, the metric index and distributed density clusters against their plain definitions."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexilar.functions.aggregate import vector_states
from vexilar.functions.vectors import column_stats, mean_by
from vexilar.operators import cluster, density, knn
from vexilar.operators.metric_index import Balls
from vexilar.session import materialize


def frame(spark, x, parts=None):
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(np.asarray(x, float))], "id bigint, v array<double>")
    return materialize(df if parts is None else df.repartition(parts), "test_rows")


# ---- vector states ----


@pytest.mark.parametrize("held", [None, 50])
def test_vector_states_match_plain_statistics(spark, monkeypatch, held):
    from vexilar.functions import aggregate

    if held:
        monkeypatch.setattr(aggregate, "HELD_NUMBERS", held)
    rng = np.random.default_rng(4)
    x, keys = rng.normal(3, 2, (700, 5)), [(random.Random(i).choice([None, 1, 2, 9]), random.Random(i + 5).choice(["a", "b"])) for i in range(700)]
    rows = [(k, s, None if i % 50 == 0 else x[i].tolist()) for i, (k, s) in enumerate(keys)]
    got = vector_states(spark.createDataFrame(rows, "k int, s string, v array<float>").repartition(5), ["k", "s"], "v").collect()
    want = defaultdict(list)
    for k, s, v in rows:
        if v is not None:
            want[k, s].append(np.array(v, np.float32).astype(float))
    assert {(r["k"], r["s"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        y = np.array(want[r["k"], r["s"]])
        assert r["_n"] == len(y) and np.allclose(r["_mean"], y.mean(axis=0)) and np.allclose(r["_m2"], ((y - y.mean(axis=0)) ** 2).sum(axis=0))


def test_means_send_a_row_a_group_and_task(spark):
    df = frame(spark, np.random.default_rng(0).normal(size=(400, 16)), 6).withColumn("label", F.col("id") % 3)
    plan = mean_by(df, ["label"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    stats = {r["i"]: r for r in column_stats(df, "v").collect()}
    x = np.array([r["v"] for r in df.collect()])
    assert np.allclose([stats[i]["mean"] for i in range(16)], x.mean(axis=0)) and np.allclose([stats[i]["std"] for i in range(16)], x.std(axis=0))
    assert mean_by(df.where("id < 0"), ["label"], "v").count() == 0 and column_stats(df.where("id < 0"), "v").count() == 0


def test_null_components_are_left_out(spark):
    df = spark.createDataFrame([(1, [1.0, None, None]), (1, [3.0, 4.0, None]), (2, [None, 8.0, 1.0]), (2, None)], "k int, v array<double>").repartition(4)
    assert {r["k"]: (r["n"], r["v"]) for r in mean_by(df, ["k"], "v").collect()} == {1: (2, [2.0, 4.0, None]), 2: (1, [None, 8.0, 1.0])}
    assert [(r["mean"], r["std"]) for r in column_stats(df, "v").orderBy("i").collect()] == [(2.0, 1.0), (6.0, 2.0), (1.0, 0.0)]


def test_lengths_of_a_group_must_agree(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "k int, v array<double>")
    with pytest.raises(Exception, match="components"):
        mean_by(df, ["k"], "v").collect()


# ---- nearest neighbours ----


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 5, (25, 12))
    x = centres[rng.integers(0, 25, 1500)] + rng.normal(0, 0.4, (1500, 12))
    x[5] = x[6] = x[900]  # ties
    x[7] = x[8] = 0
    x[1200:1400] = x[1200]  # a hot ball
    return frame(spark, x)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("own", [True, False])
def test_balls_give_the_rows_of_all_pairs_and_compare_few(spark, planted, metric, own):
    want = {(r["src"], r["dst"]): r["w"] for r in knn.top_k(planted, 6, metric=metric, include_self=own).collect()}
    rows, compared = Balls.build(planted, metric).nearest(planted, 6, own, part_rows=90)
    got = {(r["src"], r["dst"]): r["w"] for r in rows.collect()}
    few = {k for k in want if k[0] not in range(1200, 1400)}  # of the equal rows, rounding decides which of 200 ties come first
    assert few == {k for k in got if k in few} and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in few) and len(got) == len(want)
    assert sorted(round(w, 9) for w in got.values()) == sorted(round(w, 9) for w in want.values())
    assert compared < 0.3 * 1500**2


def test_balls_with_fewer_rows_than_neighbours_and_other_queries(spark):
    x = np.random.default_rng(3).normal(size=(9, 4))
    df, asked = frame(spark, x), frame(spark, x[:3] * 7)
    rows, _ = Balls.build(df, "euclidean").nearest(df, 20, False)
    assert rows.count() == 9 * 8
    want = {(r["src"], r["dst"]) for r in knn.top_k(df, 2, asked, "euclidean").collect()}
    assert want == {(r["src"], r["dst"]) for r in Balls.build(df, "euclidean", pivots=3).nearest(asked, 2)[0].collect()}


@pytest.mark.parametrize("block_bytes", [knn.BLOCK_BYTES, 60 * 12 * 8])
def test_neighbours_and_median_in_one_pass(spark, planted, block_bytes):
    some = materialize(planted.where("id < 400"), "some")
    near, median = knn.neighbours_and_median(some, 4, block_bytes=block_bytes)
    x = np.array([r["v"] for r in some.orderBy("id").collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert math.isclose(median, np.median(d[d > 0]), rel_tol=1e-12)
    assert {(r["src"], r["dst"]) for r in near.collect()} == {(r["src"], r["dst"]) for r in knn.top_k(some, 4, metric="euclidean").collect()}
    assert knn.neighbours_and_median(some.limit(1), 3)[1] is None


# ---- density clusters ----


def fixtures():
    rng = np.random.default_rng(1)
    yield "three", np.vstack([rng.normal(c, 0.3, (60, 4)) for c in (0, 4, 9)] + [rng.uniform(-5, 15, (20, 4))]), 10, 5
    yield "grid", np.array([[i % 7, i // 7] for i in range(63)] + [[30 + i % 5, i // 5] for i in range(25)]), 5, 3
    yield "equal rows", np.vstack([np.zeros((30, 2)), np.ones((30, 2)), rng.normal(0, 0.3, (60, 2))]), 6, 4
    yield "widening chain", np.cumsum(np.linspace(1, 3, 150))[:, None] * np.ones((1, 2)), 8, 3
    yield "uniform", rng.uniform(0, 1, (300, 3)), 12, 5
    yield "nested", np.vstack([rng.normal(c, s, (n, 3)) for c, s, n in ((0, 0.1, 80), (0.8, 0.1, 80), (6, 1, 90), (6.5, 0.05, 50))]), 15, 6
    yield "all equal", np.ones((20, 3)), 5, 3
    yield "too few", np.ones((4, 3)), 5, 3


CASES = {name: rest for name, *rest in fixtures()}


def assert_labels(got, x, m, k, method="eom"):
    labels, probs = cluster.hdbscan(np.asarray(x, float), m, k, method)
    rows = sorted((r["id"], r["cluster"], r["probability"]) for r in got.collect())
    assert [r[1] for r in rows] == labels.tolist() and np.allclose([r[2] for r in rows], probs)


@pytest.mark.parametrize("name", CASES)
def test_density_clusters_match_the_definition(spark, name):
    x, m, k = CASES[name]
    assert_labels(density.density_clusters(frame(spark, x), "v", m, k), x, m, k)
    if name in ("nested", "equal rows"):
        assert_labels(density.density_clusters(frame(spark, x), "v", m, k, "leaf"), x, m, k, "leaf")


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_partitions_and_blocks_change_no_label(spark, parts):
    x, m, k = CASES["three"]
    assert_labels(density.density_clusters(frame(spark, x, parts), "v", m, k, block_rows=20 + parts), x, m, k)


def test_rounds_of_all_tasks_give_the_same_labels(spark, monkeypatch):
    """With room for 30 edges a task, components, forest and condensed tree all go through their distributed rounds."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 0.1, (18, 2)), rng.normal(0.8, 0.1, (18, 2)), np.ones((9, 2)) * 6, rng.normal(6, 1, (12, 2))])
    monkeypatch.setattr(density, "LOCAL_EDGES", 30)
    assert_labels(density.density_clusters(frame(spark, x, 3), "v", 6, 3, block_rows=30), x, 6, 3)


def test_leaving_edges_are_the_first_with_enough_rows(spark):
    rng = random.Random(6)
    n, m = 60, 5
    edges = [(rank, float(rank), rng.randrange(k), k) for rank, k in zip(rng.sample(range(1, n), n - 1), range(1, n), strict=True)]
    tree = materialize(spark.createDataFrame(edges, "rank bigint, w double, a bigint, b bigint"), "tree")
    parent, want = list(range(n)), {}
    find = lambda a: a if parent[a] == a else find(parent[a])
    for rank, _, a, b in sorted(edges):
        parent[find(a)] = find(b)
        group = [x for x in range(n) if find(x) == find(b)]
        for x in group if len(group) >= m else ():
            want.setdefault(x, rank)
    for room in (1000, 8):
        assert {r["id"]: r["rank"] for r in density.leaving(tree, m, room).collect()} == want


def test_clusters_of_rows_by_climbing():
    pieces = np.array([3, 5, 8, 11, 40])
    tree = density.Tree.build(pieces, [(10, 1.0, 3, 5), (20, 2.0, 8, 11), (30, 3.0, 5, 11), (40, 4.0, 40, 3)])
    assert tree.clusters(np.array([3, 3, 3, 8, 40, 40, 5]), np.array([4, 15, 35, 25, 1, 50, 45])).tolist() == [0, 5, 7, 6, 4, 8, 8]


@pytest.mark.parametrize("name", [c for c in CASES if c != "too few"])
@pytest.mark.parametrize("block_bytes", [knn.BLOCK_BYTES, 4_000])
def test_passes_in_the_order_of_a_tree_give_the_tree_of_all(spark, monkeypatch, name, block_bytes):
    """From two nearest rows only, so that trees must be joined; with ties, copies and several chunks."""
    x, _, k = CASES[name]
    monkeypatch.setattr(density, "NEAR", 2)
    t = density.tree_by_order(frame(spark, x, 3), k, len(x), block_bytes)
    want = density.spanning_tree(np.arange(len(x)), np.asarray(x, float), cluster._core_distances(np.asarray(x, float), k))
    got, of = (sorted(zip(a.tolist(), b.tolist(), w.tolist(), strict=True)) for a, b, w in ([t.column(c).to_numpy() for c in "abw"], want))
    assert [e[:2] for e in got] == [e[:2] for e in of] and np.allclose([e[2] for e in got], [e[2] for e in of])


def test_passes_in_order_give_the_labels_and_keep_few_pairs(spark, monkeypatch):
    """Rows of a larger table meet in passes: of nearly all pairs nothing is kept (a tree a pair of blocks before)."""
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(c, 0.3, (150, 12)) for c in (0, 4, 9)] + [rng.normal(3, 4, (150, 12))])
    found, take = [], density._Cheaper._met
    monkeypatch.setattr(density, "LEAST_ORDERED", 100)
    monkeypatch.setattr(density, "reachability_edges", None)
    assert_labels(density.density_clusters(frame(spark, x, 4), "v", 10, 5), x, 10, 5)
    n, core = len(x), cluster._core_distances(x, 5)
    order = density.Order.of(n, *(np.asarray(c) for c in density.spanning_tree(np.arange(n), x, core)))
    once = density._Cheaper(order, core[order.row])
    once._met = lambda *args: found.append(len(args[-1])) or take(once, *args)
    y = x[order.row]
    for lo in range(0, n, 100):
        once.take(lo // 100, np.arange(lo, min(n, lo + 100)), y[lo : lo + 100])
    for lo in range(0, n, 100):
        once.meet(lo // 100, np.arange(lo, min(n, lo + 100)), y[lo : lo + 100])
    assert sum(found) < 20 * n
    kept = [c.to_numpy() for c in next(once.rows()).columns]
    both = density.Order.of(n, *(np.concatenate(c) for c in zip(kept, order.edges, strict=True)))
    assert len(both.edges[2]) == n - 1 and math.isclose(both.edges[2].sum(), order.edges[2].sum(), rel_tol=1e-12)
