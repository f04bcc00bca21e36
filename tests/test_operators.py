"""Operators against small cases worked out by hand, planted clusters and plain numpy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexilar.functions import registry, rf, vectors
from vexilar.operators import cluster, components, consolidate, graph, knn, metrics, prototypes, reports, splits
from vexilar.plans import baselines, discovery
from vexilar.sources import files
from vexilar.streaming import rounds


def blobs(n=40, classes=5, seed=0, noise=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 6, (classes, 24))
    x = np.concatenate([c + rng.normal(0, 0.5, (n, 24)) for c in centres] + [rng.uniform(-12, 12, (noise, 24))])
    y = np.concatenate([np.repeat(np.arange(classes), n), np.full(noise, -1)])
    return x, y


@pytest.fixture(scope="module")
def planted(spark):
    x, y = blobs()
    return spark.createDataFrame([(k, int(c), r[:16].tolist(), r[16:].tolist(), r.tolist()) for k, (r, c) in enumerate(zip(x, y))], "id bigint, label bigint, deep array<double>, rf array<double>, v array<double>").persist()


def numbers(df):
    return df.toPandas().sort_values("id")


# ---- vectors and neighbours ----


def test_standardize_guards_flat_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id bigint, v array<double>")
    assert [r["v"] for r in vectors.standardize(df, "v", unit_if_flat=True).orderBy("id").collect()] == [[-1.0, 0.0], [1.0, 0.0]]


def test_top_k_is_the_same_for_any_blocks(planted):
    want = {tuple(r) for r in knn.top_k(planted, 4, metric="euclidean", include_self=False).select("src", "dst").collect()}
    assert want == {tuple(r) for r in knn.top_k(planted, 4, metric="euclidean", include_self=False, block_bytes=37 * 24 * 8).select("src", "dst").collect()}
    x = np.stack(numbers(planted)["v"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert want == {(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:4]}


def test_distance_median_is_exact(planted):
    x = np.stack(numbers(planted)["v"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert knn.distance_median(planted, block_bytes=50 * 24 * 8) == pytest.approx(np.median(d[d > 0]), abs=1e-12)
    assert knn.distance_median(planted.limit(1)) is None


def test_graph_invariants(planted):
    g = graph.adaptive_fusion(graph.cosine_graph(planted, 6, "deep"), graph.rbf_graph(planted, 6, "rf"), reliability=knn.cross_view_consistency(planted, "deep", "rf", 5)).toPandas()
    w = {(r.src, r.dst): r.w for r in g.itertuples()}
    assert all(0 <= x <= 1 and w[(b, a)] == x for (a, b), x in w.items())
    assert all(w[(i, i)] == 1.0 for i in {a for a, _ in w})


def test_tiny_graph_by_hand(spark):
    g = spark.createDataFrame([(1, 2, 0.4), (2, 1, 0.2), (2, 3, 2.0)], "src bigint, dst bigint, w double")
    mx = {(r[0], r[1]): r[2] for r in graph.symmetrize(g).collect()}
    av = {(r[0], r[1]): round(r[2], 9) for r in graph.symmetrize(g, "avg").collect()}
    assert mx[(1, 2)] == mx[(2, 1)] == 0.4 and mx[(3, 2)] == 1.0 and av[(1, 2)] == 0.3 and av[(2, 3)] == 1.0 and mx[(1, 1)] == 1.0


def test_components_of_chains_stars_and_loops(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    rows = [*chain, (5, 5), (7, 6), (6, 7), (6, 7), (None, 3), *[(1000, 1000 + k) for k in range(1, 200)]]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(rows, "src bigint, dst bigint")).collect()}
    assert all(got[k] == 100 for k in range(100, 161)) and got[7] == 6 and 5 not in got and 3 not in got and got[1199] == 1000
    assert components.connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_neighbour_components_cover_every_row(spark, sf):
    from vexilar.plans.queries import queries

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim = x @ x.T
    np.fill_diagonal(sim, -np.inf)
    near = [set(np.argsort(-s, kind="stable")[:5]) for s in sim]
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in near[a]:
            if a in near[b]:
                i, j = find(a), find(b)
                root[max(i, j)] = min(i, j)
    got = {r["node"]: r["component"] for r in queries()["neighbour_components"](spark, sf).collect()}
    assert got == {ids[k]: ids[find(k)] for k in range(len(ids))}


# ---- clusters ----


def test_density_clusters_find_planted_blobs():
    x, y = blobs()
    labels, probs = cluster.hdbscan(x, 10, 5)
    assert len(set(labels) - {-1}) == 5
    for c in range(5):
        own = labels[y == c]
        assert (own == np.bincount(own[own >= 0]).argmax()).mean() > 0.95
    assert (labels[y == -1] == -1).mean() > 0.8 and probs.min() >= 0 and probs.max() <= 1
    assert set(cluster.hdbscan(x, 10, 5, "leaf")[0]) - {-1}
    assert (cluster.hdbscan(x[:5], 10, 5)[0] == -1).all()


def test_spectral_embedding_parts_a_block_graph():
    w = np.kron(np.eye(3), np.ones((6, 6))) + 0.01
    e = cluster.spectral_embedding(w, 2)
    assert e.shape == (18, 2) and all(np.ptp(e[6 * k : 6 * k + 6], axis=0).max() < 1e-6 for k in range(3))


def test_two_means_and_silhouette():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.1, (20, 3)), rng.normal(5, 0.1, (30, 3))])
    labels = cluster.two_means(x)
    assert labels[:20].sum() == 0 and labels[20:].sum() == 30 and cluster.silhouette(x, labels) > 0.9 and cluster.silhouette(x, np.zeros(50)) == 0


def _views(df):
    return df.withColumn("graph", F.col("deep"))


def test_merge_restores_and_assignment_leaves_no_noise(planted):
    rows = _views(planted).withColumn("cluster", F.when(F.col("label") == -1, -1).otherwise(2 * F.col("label") + F.col("id") % 2).cast("bigint"))
    merged = consolidate.iterative_merge(rows, 0.9)
    table = metrics.contingency(merged.where("label <> -1"))
    assert merged.where("cluster <> -1").select("cluster").distinct().count() == 5 and metrics.hungarian_accuracy(table) == 1.0
    full = consolidate.assign_noise(merged)
    assert full.where("cluster = -1").count() == 0 and consolidate.coverage(full).first()[0] == 1.0
    everyone = consolidate.assign_noise(rows.withColumn("cluster", F.lit(-1).cast("bigint")))
    assert [r[0] for r in everyone.select("cluster").distinct().collect()] == [0]


def test_split_parts_joined_blobs(planted):
    rows = _views(planted.where("label >= 0")).withColumn("cluster", F.when(F.col("label") == 4, 3).otherwise(F.col("label")).cast("bigint"))
    out = consolidate.adaptive_split(rows)
    assert out.select("cluster").distinct().count() == 5 and metrics.hungarian_accuracy(metrics.contingency(out)) == 1.0


def test_second_look_merges_and_adds_classes(planted):
    rows = _views(planted.where("label >= 0")).withColumn("probability", F.lit(1.0))
    half = rows.withColumn("cluster", F.when((F.col("label") == 0) & (F.col("id") % 2 == 0), 0).when(F.col("label") == 1, 1).otherwise(-1).cast("bigint"))
    out, counts = consolidate.recluster(half, [0, 1], consolidate.Recluster(10, 5, 10, 0.95))
    table = metrics.contingency(out)
    assert counts["merged"] == 1 and counts["new"] + counts["rejected"] == 3 and counts["uncertain"] == 140
    assert metrics.purity(table).first()[0] == 1.0
    few, counts = consolidate.recluster(half.limit(5), [0, 1])
    assert counts["secondary"] == 0 and few.count() == 5


def test_accepted_clusters_merge(planted):
    rows = _views(planted.where("label >= 0")).withColumn("cluster", (2 * F.col("label") + F.col("id") % 2).cast("bigint"))
    out = consolidate.merge_accepted(rows, [0, 1, 2], 0.9)
    assert out.select("cluster").distinct().count() == 9


def test_learners_over_rounds(planted):
    known = planted.where("label between 0 and 2").select("id", "label", "v")
    new = [planted.where(f"label = {c}").select("id", "label", "v") for c in (3, 4)]
    from vexilar.plans import baselines

    out = baselines.compare(known, new, planted.where("label >= 0").select("id", "label", "v"), ("lwf", "icarl", "tpcil", "doi"))
    rows = {(r["method"], r["stage"]): r for r in out.collect()}
    assert len(rows) == 12 and rows[("icarl", "After R2")]["overall"] > 0.95 and rows[("icarl", "Initial")]["forgetting"] is None
    assert set(baselines.wide(out, 2).columns) == {"method", "Initial", "After R1", "After R2", "mean"}


def test_metrics_on_trivial_partitions(spark):
    t = spark.createDataFrame([(0, 0, 5), (1, 1, 5)], "truth bigint, cluster bigint, n bigint")
    assert metrics.ari(t).first()[0] == 1.0 and metrics.nmi(t).first()[0] == pytest.approx(1.0) and metrics.purity(t).first()[0] == 1.0
    one = spark.createDataFrame([(0, 0, 5)], "truth bigint, cluster bigint, n bigint")
    assert metrics.ari(one).first()[0] == 1.0 and metrics.nmi(one).first()[0] == 1.0
    noise = spark.createDataFrame([(0, -1, 5)], "truth bigint, cluster bigint, n bigint")
    assert metrics.purity(noise).first()[0] == 0.0 and metrics.hungarian_accuracy(noise) == 0.0
    lost = spark.createDataFrame([(0, 0, 5), (0, 1, 3)], "truth bigint, cluster bigint, n bigint")
    assert {tuple(r) for r in metrics.posthoc_map(lost).collect()} == {(0, 0), (1, -1_000_001)}


def test_assignment_is_optimal():
    import itertools

    rng = np.random.default_rng(0)
    for n, m in [(1, 1), (2, 4), (4, 4), (5, 3)]:
        for _ in range(20):
            c = rng.normal(size=(n, m)).round(2)
            big, small = (c, range(n)) if n <= m else (c.T, range(m))
            best = min(sum(big[i, p[i]] for i in small) for p in itertools.permutations(range(big.shape[1]), len(small)))
            assert sum(c[i, j] for i, j in metrics.assign(c)) == pytest.approx(best)


def test_roc_ties(spark):
    df = spark.createDataFrame([(0.5, True), (0.5, False), (0.9, True), (0.1, False)], "score double, unknown boolean")
    assert metrics.auroc(df).first()[0] == 0.875 and metrics.fpr_at_tpr(df).first()[0] == 0.5
    assert metrics.auroc(df.where("unknown")).first()[0] is None


# ---- splits and reports ----


def test_splits(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(100)], "id bigint, label bigint")
    out = splits.order_block(df, ["label"], ["id"], rounding="round").groupBy("label", "split").count().collect()
    assert {(r["label"], r["split"], r["count"]) for r in out} == {(0, "train", 24), (0, "eval", 10), (1, "train", 23), (1, "eval", 10), (2, "train", 23), (2, "eval", 10)}
    val = splits.stratified(df.withColumn("g", F.col("id") % 10), "label", "id", 0.2, group="g")
    assert val.select("g", "label", "split").distinct().count() == val.select("g", "label").distinct().count()
    assert splits.per_class(df, "label", "id", 5).count() == 15 and splits.choose_classes(df, "label", 2).count() == 2
    with pytest.raises(AssertionError):
        splits.assert_disjoint(df, df, "id")
    chosen = lambda d: sorted(r["id"] for r in splits.seeded(d, ["label"], "id").where("split = 'train'").collect())
    assert chosen(df) == chosen(df.repartition(3)) and len(chosen(df)) == 69


def test_pivot_ignores_missing_rounds(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 5.0)], "method string, round int, acc double")
    got = {r["method"]: (r["1"], r["2"], r["mean"]) for r in reports.pivot_rounds(df, ["method"], "round", [1, 2, 3], "acc").collect()}
    assert got == {"a": (1.0, 3.0, 2.0), "b": (5.0, None, 5.0)}


# ---- signals ----


def test_tone_features():
    t = np.arange(64)
    f = rf.features(np.cos(0.3 * t)[None], np.sin(0.3 * t)[None])[0]
    named = dict(zip(rf.BASE, f))
    assert named["amp_mean"] == pytest.approx(1.0, abs=1e-6) and named["amp_std"] < 1e-6 and named["freq_offset_mean"] == pytest.approx(0.3) and named["freq_offset_std"] < 1e-9
    assert {n: len(v) for n, v in rf.VIEWS.items()} == {"amplitude_8d": 8, "phase_frequency_4d": 4, "iq_imbalance_9d": 9, "spectral_3d": 3, "all24_base": 24, "all48_extended": 48, "transient_14d": 14, "oscillator_8d": 8, "iq_hardware_7d": 7, "spectral_shape_8d": 8, "hardware_23d": 23, "all37d": 37}


def test_expressions_match_batched_features(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(k, rng.normal(size=32).tolist(), rng.normal(size=32).tolist()) for k in range(20)], "id bigint, i array<double>, q array<double>")
    both = rf.balance_expressions(rf.amplitude_expressions(df)).withColumn("v", registry.feature("all24_base")("i", "q")).collect()
    names = list(rf.BASE)
    for r in both:
        for n in [*rf.VIEWS["amplitude_8d"], *rf.VIEWS["iq_imbalance_9d"]]:
            assert r[n] == pytest.approx(r["v"][names.index(n)], abs=1e-9)


def test_ragged_and_null_records(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], [1.0, 0.0, 1.0]), (2, None, None), (3, [1.0] * 8, [0.0] * 8)], "id bigint, i array<double>, q array<double>")
    got = {r["id"]: r["v"] for r in df.select("id", rf.feature_column("i", "q").alias("v")).collect()}
    assert got[2] is None and len(got[1]) == len(got[3]) == 24


def test_chirp_alignment():
    n, spread = 512, 7
    rng = np.random.default_rng(1)
    x = np.concatenate([0.01 * rng.normal(size=100), np.tile(rf.up_chirp(n, spread), 6)]) + 0.01 * rng.normal(size=100 + 6 * n)
    assert abs(rf.chirp_offset(x, n, spread) - 100) <= 2
    assert rf.dechirped(x, n, 64, spread).shape == (6, 64)


# ---- sources ----


def test_file_sources(spark, tmp_path):
    import pickle

    rng = np.random.default_rng(0)
    cube = {"data": [[[[rng.normal(size=(3, 16, 2))], [np.zeros((0, 16, 2))]]], [[[rng.normal(size=(2, 16, 2))], [rng.normal(size=(1, 16, 2))]]]], "tx_list": ["t0", "t1"], "rx_list": ["r"], "capture_date_list": ["d0", "d1"], "equalized_list": [0]}
    (tmp_path / "c").mkdir()
    (tmp_path / "c/cube.pkl").write_bytes(pickle.dumps(cube))
    rows = files.read_cube(spark, str(tmp_path / "c"))
    assert rows.count() == 6 and rows.select("sample_id").distinct().count() == 6 and files.describe_cube(rows).count() == 3
    (tmp_path / "n").mkdir()
    np.savez(tmp_path / "n/a.npz", train_X=rng.normal(size=(4, 2, 8)), train_y=np.arange(4), train_rx_index=np.arange(4), eval_X=rng.normal(size=(2, 2, 8)), eval_y=np.arange(2))
    got = files.read_arrays(spark, str(tmp_path / "n"))
    assert {(r["stage"], r["count"]) for r in got.groupBy("stage").count().collect()} == {("train", 4), ("eval", 2)}
    assert files.archive_directory(spark, str(tmp_path / "n")).count() == 5
    np.save(tmp_path / "x.npy", rng.normal(size=(5, 8, 2)))
    np.save(tmp_path / "y.npy", np.eye(3)[[0, 1, 2, 0, 1]])
    assert [r["label"] for r in files.read_npy(spark, str(tmp_path / "x.npy"), str(tmp_path / "y.npy")).orderBy("sample_idx").collect()] == [0, 1, 2, 0, 1]
    (tmp_path / "s").mkdir()
    (tmp_path / "s/dev1_10ft_run2.sigmf-meta").write_text(json.dumps({"global": {"core:sample_rate": 5e6, "core:datatype": "cf32"}}))
    (rng.normal(size=2048) + 1j * rng.normal(size=2048)).astype("<c16").tofile(tmp_path / "s/dev1_10ft_run2.sigmf-data")
    sig = files.read_sigmf(spark, str(tmp_path / "s"), datatype="cf64")  # the header is wrong
    assert sig.count() == 4 and sig.first()["serial"] == "dev1" and sig.first()["distance_ft"] == 10 and sig.first()["sample_rate"] == 5e6
    (tmp_path / "bom.csv").write_text("﻿a,b\n1,2\n", encoding="utf-8")
    assert files.read_csv(spark, str(tmp_path / "bom.csv")).columns == ["a", "b"]


def test_pickles_with_code_are_refused(spark, tmp_path):
    import os
    import pickle

    class Bad:
        def __reduce__(self):
            return os.getcwd, ()

    with pytest.raises(ValueError):
        import io

        files._ArraysOnly(io.BytesIO(pickle.dumps(Bad()))).load()


# ---- plans and streams ----


def test_discovery_calibration_and_rounds(spark, planted):
    s = discovery.Settings(top_k=10, dims=6, least_cluster=10, local_k=8)
    tuned, grid = discovery.calibrate(planted.where("label >= 0"), s, (0.05,), (0.86, 0.95))
    assert grid.count() == 2 and tuned.ratio == 0.05
    found, stats = discovery.discover(planted.where("label >= 0").select("id", "deep", "rf"), tuned)
    truth = planted.select("id", "label")
    assert metrics.hungarian_accuracy(metrics.contingency(found.join(truth, "id"))) >= 0.8 and found.where("cluster = -1").count() == 0
    assert 0.65 <= stats.first()["alpha_min"] <= stats.first()["alpha_max"] <= 1.0
    known = planted.where("label between 0 and 2").select("id", "label", "v")
    state = discovery.start(known, 3)
    new = planted.where("label >= 3").select("id", "v")
    state = discovery.enroll_round(state, truth.where("label >= 3").select("id", (F.col("label") - 3).alias("cluster")), new, truth, round_no=1)
    out = discovery.evaluate(state, planted.where("label >= 0").select("id", "label", "v"), 3, 5, 3, 1.0).first()
    assert state.next_label == 5 and out["overall"] > 0.95 and out["macro_f1"] > 0.95 and out["forgetting"] < 0.05
    assert state.memory.groupBy("label").count().agg(F.max("count")).first()[0] == 20


def test_view_selection(spark):
    rng = np.random.default_rng(0)
    rows = [(k, k % 2, ((1 + k % 2) * rng.normal(size=32)).tolist(), rng.normal(size=32).tolist()) for k in range(40)]
    name, purity, is_open = discovery.select_view(spark.createDataFrame(rows, "id bigint, label bigint, i array<double>, q array<double>"), k=3)
    assert set(purity) >= {"all24_base", "iq_imbalance_9d"} and (is_open or name == "all24_base")


def test_linear_heads():
    x, y = blobs(noise=0)
    w, b = discovery.train_head(x[y < 3], y[y < 3], 3, epochs=300, rate=0.01)
    assert ((x[y < 3] @ w + b).argmax(1) == y[y < 3]).mean() > 0.95
    w2, b2 = discovery.train_head(x, y, 5, (w, b), distill=1.0, epochs=300, rate=0.01)
    assert ((x @ w2 + b2).argmax(1) == y).mean() > 0.9


def test_learners_beyond_the_drivers_rows(spark, planted, monkeypatch):
    rows = planted.where("label >= 0").select("id", "label", F.transform("v", lambda x: x / 10).alias("v"))
    given = (rows.where("label < 3"), [rows.where("label >= 3")], rows)
    want = baselines.compare(*given, learners=baselines.LEARNERS[:3]).collect()
    x, y = blobs(noise=0)
    old = discovery.train_head(x[y < 3] / 10, y[y < 3], 3, epochs=20)
    local = discovery.train_head(x / 10, y, 5, old, 1.0, epochs=20)
    spread = discovery.train_head_on(rows.repartition(3), 5, old, 1.0, epochs=20)
    assert all(np.abs(a - b).max() < 1e-9 for a, b in zip(local, spread))
    monkeypatch.setattr(baselines, "LOCAL_ROWS", 0)
    assert sorted(map(str, baselines.compare(*given, learners=baselines.LEARNERS[:1]).collect())) == sorted(str(r) for r in want if r["method"] == "finetune")


def test_prototype_operators(spark, planted):
    known = planted.where("label >= 0")
    protos = prototypes.known_prototypes(known, 5)
    assert prototypes.predict(known, protos).join(known.select("id", "label"), "id").where("pred <> label").count() == 0
    with pytest.raises(ValueError):
        prototypes.known_prototypes(known, 7)
    rel = prototypes.library_reliability(known.withColumn("cluster", F.col("label")).withColumn("slot", F.col("id") % 2), protos.where("label < 2"), min_size=50)
    assert {r["status"] for r in rel.collect()} == {"reject"} and rel.first()["hard_fail_reasons"] == ["size"]
    enrolled = prototypes.enroll(spark.createDataFrame([(3, 1.7, [1.0]), (1, -0.2, [0.0])], "cluster bigint, reliability double, v array<double>"), 10)
    assert {(r["cluster"], r["label"], r["reliability"]) for r in enrolled.collect()} == {(1, 10, 0.0), (3, 11, 1.0)}


def test_prototypes_of_a_class_with_two_modes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    modes = {0: [(9, 0, 0), (0, 9, 0)], 1: [(0, 0, 9), (-9, 0, 0)], 2: [(6, 6, 0)]}
    rows = [(int(c), (np.array(m) + rng.normal(0, 0.1, 3)).tolist()) for c, ms in modes.items() for m in ms for _ in range(30 if c < 2 else 1)]
    df = spark.createDataFrame([(k, c, v) for k, (c, v) in enumerate(rows)], "id bigint, label bigint, v array<double>")
    for drawn in (1000, 8):  # starts from all rows of a class, and from a few
        monkeypatch.setattr(prototypes, "START_ROWS", drawn)
        found = prototypes.make_prototypes(df, prototypes_per_class=2)
        got = sorted((r["label"], r["n"]) for r in found.collect())
        assert got == [(0, 30), (0, 30), (1, 30), (1, 30), (2, 1)]
        for r in found.collect():
            near = [np.mean([v for c, v in rows if c == r["label"] and np.abs(np.array(v) - m).max() < 2], axis=0) for m in modes[r["label"]]]
            assert min(np.abs(np.array(r["v"]) - m / np.linalg.norm(m)).max() for m in near) < 1e-6
        wrong = lambda protos: prototypes.predict(df, protos).join(df.select("id", "label"), "id").where("pred <> label").count()
        assert wrong(found) == 0 and wrong(prototypes.make_prototypes(df)) > 0


def test_library_reliability_rules(spark):
    rows = [(c, [float(10 * c), x], [5.0 * x if c == 2 else 0.0], 0, 0.1 if c == 1 else 0.9) for c in range(4) for x in (-0.1, 0.1) for _ in range(5)]
    df = spark.createDataFrame(rows, "cluster bigint, v array<double>, low array<double>, slot bigint, unknown double")
    known = spark.createDataFrame([(0, [0.0, 0.5])], "label bigint, v array<double>")
    rel = prototypes.library_reliability(df, known, min_size=5, tau_known=1.0, tau_conf=0.5, tau=0.9, rf="low", confidence="unknown")
    got = {r["cluster"]: r for r in rel.collect()}
    assert [got[c]["hard_fail_reasons"] for c in range(4)] == [["too_close_to_known"], ["unknown_confidence_too_low"], [], []]
    assert [got[c]["status"] for c in range(4)] == ["reject", "reject", "pending", "reliable"]
    parts = [np.exp(-0.1), 1 - np.exp(-10.0), 1.0, np.exp(-0.5)]
    assert abs(got[2]["score"] - np.prod(parts) ** 0.25) < 1e-6 and abs(got[2]["rf_consistency"] - parts[3]) < 1e-9
    plain = {r["cluster"]: r for r in prototypes.library_reliability(df, known, min_size=5).collect()}
    assert plain[0]["hard_fail_reasons"] == [] and abs(plain[2]["score"] - np.prod(parts[:3]) ** (1 / 3)) < 1e-6


def test_streams(spark, sf, tmp_path, planted):
    known = planted.where("label >= 0").select("id", "label", "v")
    known.write.parquet(str(tmp_path / "in"))
    protos = prototypes.make_prototypes(vectors.unit(known, "v"))
    stream = spark.readStream.schema(known.schema).parquet(str(tmp_path / "in"))
    q = rounds.score_stream(stream, protos).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").where("pred <> label").count() == 0 and spark.table("scored").count() == known.count()
    seen = []
    w = rounds.staged_rounds(stream, lambda batch, n: seen.append((n, batch.count())), str(tmp_path / "ck")).trigger(availableNow=True).start()
    w.awaitTermination(60)
    assert sum(n for _, n in seen) == known.count()
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    live = rounds.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")))
    q = live.writeStream.format("memory").outputMode("complete").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    plain = lambda df: sorted((str(r["start"]), r["event_type"], r["n"]) for r in df.collect())
    assert plain(spark.table("hours")) == plain(rounds.windowed_counts(events))


# ---- against definitions ----


def plain_density(x, least, samples):
    """Density clusters of the greatest stability, from components of ever smaller distances: quadratic in everything."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, samples - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))

    def parts(members, limit):
        left, out = set(members), []
        while left:
            todo, got = [left.pop()], []
            while todo:
                a = todo.pop()
                got.append(a)
                near = [b for b in left if reach[a, b] < limit]
                left -= set(near)
                todo += near
            out.append(frozenset(got))
        return out

    def grow(members, birth):
        """(stability of the best choice below, clusters of it), for a cluster born at 1 / distance."""
        stability, now = 0.0, members
        for limit in sorted({reach[a, b] for a in members for b in members if a != b}, reverse=True):
            big = [p for p in parts(now, limit) if len(p) >= least]
            if len(big) == 1 and len(big[0]) == len(now):
                continue
            stability += (len(now) - sum(map(len, big)) if len(big) == 1 else len(now)) * (1 / limit - birth)
            if len(big) != 1:
                below = [grow(p, 1 / limit) for p in big]
                total = sum(b for b, _ in below)
                return (total, [c for _, cs in below for c in cs]) if total > stability else (stability, [members])
            now = big[0]
        return stability, [members]

    every, now = frozenset(range(n)), frozenset(range(n))
    for limit in sorted(set(reach[np.triu_indices(n, 1)]), reverse=True):
        big = [p for p in parts(now, limit) if len(p) >= least]
        if len(big) > 1:
            return {c for p in big for c in grow(p, 1 / limit)[1]}
        if not big:
            return set()
        now = big[0]
    return {every}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_density_clusters_are_those_of_the_definition(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, s, (n, 2)) for c, s, n in (((0, 0), 0.4, 14), ((3, 0), 0.3, 10), ((3.2, 2), 0.3, 9), ((9, 9), 1.5, 7))])
    labels, probs = cluster.hdbscan(x, 5, 3)
    assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels) - {-1}} == plain_density(x, 5, 3)
    assert ((probs >= 0) & (probs <= 1)).all() and (probs[labels == -1] == 0).all()


def test_spectral_columns_solve_the_eigenproblem():
    rng = np.random.default_rng(0)
    w = rng.random((30, 30))
    w = np.maximum(w, w.T) * (rng.random((30, 30)) < 0.4)
    w = np.maximum(w, w.T)
    np.fill_diagonal(w, 1)
    v = cluster.spectral_embedding(w, 4)
    off = w - np.diag(np.diag(w))
    degree = off.sum(axis=1)
    laplacian = np.diag(degree) - off
    values = [float(c @ laplacian @ c / (c @ (degree * c))) for c in v.T]
    assert values == sorted(values) and all(np.abs(laplacian @ c - k * degree * c).max() < 1e-9 for c, k in zip(v.T, values))
    assert all(abs((degree * c).sum()) < 1e-9 for c in v.T)  # orthogonal to the trivial one
    every = np.sort(np.linalg.eigvals(np.diag(1 / degree) @ laplacian).real)
    assert np.allclose(values, every[1:5])


def test_projection_keeps_the_most_variance(spark, planted):
    x = np.stack(numbers(planted)["v"])
    got = cluster.project_groups(planted.withColumn("g", F.lit(0)), ["g"]).toPandas().sort_values("id")[["x", "y"]].to_numpy()
    centred = x - x.mean(axis=0)
    values, vectors_ = np.linalg.eigh(centred.T @ centred)
    for k, column in enumerate(got.T):
        want = centred @ vectors_[:, -1 - k]
        assert min(np.abs(column - want).max(), np.abs(column + want).max()) < 1e-8


def test_methods_by_name(spark, planted):
    from vexilar.plans import methods

    truth = planted.select("id", "label")
    df = planted.select("id", "deep", "rf")
    s = discovery.Settings(dims=4, ratio=0.1)
    for name in [*methods.METHODS, "IterMerge-2"]:
        found = methods.run_discovery(name, df, s, truth, new_classes=5)
        r = found.report.first()
        assert r["method"] == name and r["samples"] == found.rows.count() == df.count() and r["clusters"] == found.rows.where("cluster <> -1").select("cluster").distinct().count()
        if "a" in methods.method_of(name).steps:
            assert r["noise"] == 0 and found.clusters.count() == r["clusters"]
        if name in ("MV-ACC", "No-drop consolidation (ablation)"):
            assert r["count_error"] == 0 and r["hungarian"] > 0.9
    with pytest.raises(ValueError, match="unknown method"):
        methods.method_of("Else")


def test_view_modes_and_feature_sets(spark):
    from vexilar.plans import methods

    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(k, rng.normal(size=16).tolist(), rng.normal(size=16).tolist()) for k in range(5)], "id bigint, i array<double>, q array<double>")
    size = lambda d: {len(r["rf"]) for r in d.collect()}
    assert size(methods.rf_view(df)) == {24} and size(methods.rf_view(df, "local", "spectral_3d")) == {3} and size(methods.rf_view(df, "global", "spectral_3d")) == {3}
    assert all(r["rf"] == [0.0] * 24 for r in methods.rf_view(df, "global", "spectral_3d", False).collect())
    assert size(methods.rf_view(df, "local", "spectral_3d", False)) == {3}
    assert methods.gated(discovery.Settings(), False).weights == consolidate.Weights(0.6, 0.0, 0.4)
    full = [r["rf"] for r in methods.feature_set(df, "all24").collect()]
    assert np.allclose(full, [r["rf"] for r in methods.rf_view(df).collect()]) and [r["rf"] for r in methods.feature_set(df, "phase").collect()] == [f[8:12] for f in full]


def test_recordings_calibration_and_ablation(spark, planted):
    from vexilar.plans import methods

    rows = planted.where("label >= 0").withColumn("recording_id", F.floor(F.col("id") / 4))
    found = methods.discover_recordings("MV-ACC", rows, discovery.Settings(dims=4, ratio=0.1, least_cluster=4))
    assert found.rows.count() == rows.count() and found.rows.groupBy("recording_id").agg(F.countDistinct("cluster").alias("n")).where("n > 1").count() == 0
    flat = spark.createDataFrame([(r, t, 3, 1, 0.5, 0.5, 0.5) for r in (0.1, 0.2) for t in (0.7, 0.8)], "ratio double, threshold double, clusters bigint, error bigint, nmi double, ari double, hungarian double")
    s = discovery.Settings()
    assert methods.calibrated(flat, s) == (s, False)
    best, informative = methods.calibrated(flat.withColumn("nmi", F.when(F.col("ratio") == 0.2, 0.9).otherwise(0.5)), s)
    assert informative and (best.ratio, best.threshold) == (0.2, 0.7)
    s2, grid = methods.calibrate_by("MV-ACC", planted.select("id", "deep", "rf"), planted.select("id", "label"), discovery.Settings(dims=4), (0.1,), (0.74, 0.86))
    assert grid.count() == 2 and s2.ratio in (0.1, 0.045)


def test_content_digests_and_varied_records(spark):
    import hashlib

    df = spark.createDataFrame([(1, [0.5, -1.25]), (2, None)], "id bigint, v array<double>")
    got = {r["id"]: r["d"] for r in df.select("id", registry.blake2b_128(registry.float32_bytes(F.col("v"))).alias("d")).collect()}
    assert got == {1: hashlib.blake2b(np.array([0.5, -1.25], "<f4").tobytes(), digest_size=16).hexdigest(), 2: None}
    rng = np.random.default_rng(1)
    records = spark.createDataFrame([(k, rng.normal(size=64).tolist(), rng.normal(size=64).tolist()) for k in range(6)], "id bigint, i array<double>, q array<double>")
    one = {r["id"]: r["i"] for r in rf.augmented(records).collect()}
    assert one == {r["id"]: r["i"] for r in rf.augmented(records.repartition(3)).collect()} and all(len(v) == 64 for v in one.values())


def test_recordings_of_a_stated_type(spark, tmp_path):
    (tmp_path / "A1_10ft_run2.sigmf-data").write_bytes(np.arange(64, dtype="<c8").tobytes())
    (tmp_path / "A1_10ft_run2.sigmf-meta").write_text(json.dumps({"global": {"core:datatype": "cf32_le", "core:sample_rate": 1.0}}))
    read = lambda **o: files.read_sigmf(spark, str(tmp_path), 16, quantile=0.0, **o).orderBy("start").collect()
    assert [r["i"][0] for r in read()] == [0.0, 16.0, 32.0, 48.0]  # an even number of samples isn't taken for half as many of twice the size
    assert len(read(datatype="cf64_le")) == 2
    (tmp_path / "A1_10ft_run2.sigmf-data").write_bytes(b"x" * 12)
    with pytest.raises(Exception, match="whole number"):
        read()


def test_chosen_nodes_and_cubes(spark, tmp_path):
    import pickle

    cells = [[[[np.full((3, 4, 2), 100.0 * t + 10 * r + d)] for d in range(2)] for r in range(2)] for t in range(3)]
    (tmp_path / "c.pkl").write_bytes(pickle.dumps({"data": cells, "tx_list": ["a", "b", "c"], "rx_list": ["r", "s"], "capture_date_list": ["m", "n"], "equalized_list": [0]}))
    got = files.read_cube(spark, str(tmp_path), tx=[0, 2], cells=[(1, 0, 0)], max_per_cell=2, seed=3).collect()
    assert sorted((r["tx"], r["i"][0]) for r in got) == [("a", 10.0)] * 2 + [("c", 210.0)] * 2
    with pytest.raises(Exception, match="transmitters"):
        files.read_cube(spark, str(tmp_path), least_tx=40).collect()
    nodes = tmp_path / "nodes"
    nodes.mkdir()
    (nodes / "n.pkl").write_bytes(pickle.dumps({"data": [np.zeros((5, 4, 2)), np.ones((2, 4, 2))], "node_list": ["1-1.", "2-2."]}))
    got = files.read_nodes(spark, str(nodes), nodes=["2-2.", "1-1."], max_per_node=3, seed=1).groupBy("node", "label").count().collect()
    assert sorted(map(tuple, got)) == [("1-1.", 1, 3), ("2-2.", 0, 2)]
    with pytest.raises(Exception, match="lacks"):
        files.read_nodes(spark, str(nodes), nodes=["9-9."]).collect()


def test_remote_ranges(tmp_path):
    import hashlib
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    data, failed = bytes(range(256)) * 20, []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            if a not in failed:
                failed.append(a)
                self.send_error(503)
                return
            self.send_response(206)
            self.end_headers()
            self.wfile.write(data[a : b + 1])

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x"
    parts = [(0, 100), (100, 1000), (4000, 5120)]
    joined = b"".join(data[a:b] for a, b in parts)
    assert b"".join(files.fetch_ranges(url, parts, wait=0.01, sha256=hashlib.sha256(joined).hexdigest())) == joined
    with pytest.raises(ValueError, match="contents"):
        files.fetch_ranges(url, parts, wait=0.01, sha256="0")
    server.shutdown()


def test_running_sums_and_cycles(spark):
    from vexilar.operators.prefix import running

    rows = spark.createDataFrame([(k % 3 if k % 5 else None, k, (k * 37) % 11) for k in range(300)], "g bigint, k bigint, x bigint")
    got = {(r["g"], r["k"]): (r["s"], r["n"]) for r in running(rows, ["g"], ["k"], s=F.col("x"), n=F.lit(1)).collect()}
    totals = {}
    for k in range(300):
        g = k % 3 if k % 5 else None
        s, n = totals.get(g, (0, 0))
        totals[g] = got_now = (s + (k * 37) % 11, n + 1)
        assert got[(g, k)] == got_now
    assert running(rows.limit(0), [], ["k"], s=F.col("x")).count() == 0
    memory = spark.createDataFrame([(7,), (9,)], "m bigint")
    assert sorted(tuple(r) for r in splits.cycled(rows.limit(5).select("k"), memory, "k", "m").collect()) == [(0, 7), (1, 9), (2, 7), (3, 9), (4, 7)]
    assert splits.cycled(rows.select("k"), memory.limit(0), "k", "m").count() == 0


def test_sparse_eigenvectors_span_those_of_the_whole_matrix(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.6, (60, 3)) for c in (0, 2, 4, 30)])  # the last part is apart: the value 1 comes twice
    d = cluster._distances(x, x)
    w = np.exp(-(d**2)) * (d < 2.5)
    row, col = np.nonzero(w)
    m = cluster.Affinity(row, col, w[row, col], len(x))
    whole = cluster.top_eigenvectors(m, 6)
    monkeypatch.setattr(cluster, "DENSE_NODES", 10)
    sparse = cluster.top_eigenvectors(m, 6)
    assert np.abs(sparse - whole @ (whole.T @ sparse)).max() < 1e-7
    values = [float(c @ m.times(c[:, None])[:, 0]) for c in sparse.T]
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(m.dense()))[::-1][:6], atol=1e-9)


@pytest.mark.parametrize("method", ["tsne", "neighbours"])
def test_layouts_keep_neighbours_together(spark, planted, method):
    from vexilar.operators import project

    rows = planted.where("label >= 0").withColumn("g", F.lit(0))
    one = project.project(rows, ["g"], method).join(rows.select("id", "label"), "id").toPandas().sort_values("id")
    two = project.project(rows.repartition(3), ["g"], method).toPandas().sort_values("id")
    assert np.allclose(one[["x", "y"]], two[["x", "y"]])
    xy, label = one[["x", "y"]].to_numpy(), one["label"].to_numpy()
    d = ((xy[:, None] - xy[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert (label[np.argsort(d, axis=1)[:, :5]] == label[:, None]).mean() > 0.97
    for n in (1, 2, 3):
        assert project.METHODS[method](np.arange(n * 4.0).reshape(n, 4)).shape[0] == n


def test_ties_of_matches_fall_to_the_first():
    from itertools import permutations

    rng = np.random.default_rng(5)
    for _ in range(60):
        n = rng.integers(0, 3, (rng.integers(1, 5), rng.integers(1, 5)))
        wide = np.hstack([n, np.zeros((len(n), len(n)), int)])  # a column of their own for rows without one
        every = [p for p in permutations(range(wide.shape[1]), len(n))]
        total = max(sum(wide[i, j] for i, j in enumerate(p)) for p in every)
        best = {tuple(j if wide[i, j] > 0 else 99 for i, j in enumerate(p)) for p in every if sum(wide[i, j] for i, j in enumerate(p)) == total}
        assert metrics._first_of_best(n) == [None if j == 99 else j for j in min(best)]
