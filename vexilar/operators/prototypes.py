"""Prototypes, open-set scores and class-incremental memories over unit vectors (id, label, v)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexilar.functions.vectors import NORM_EPS, clip, distance, dot, mean_by, scale, unit
from vexilar.operators.cluster import k_means
from vexilar.operators.splits import seeded_order
from vexilar.session import materialize

#: Prototypes that are broadcast at most; there are a few for each class.
BROADCAST_PROTOTYPES = 20_000
#: Rows of a class, by hash, from which starting centres are taken; all rows then move the centres.
START_ROWS = 1_000


def make_prototypes(df: DataFrame, label: str = "label", vec: str = "v", prototypes_per_class: int = 1, seed: int = 7) -> DataFrame:
    """(label, n, v): the unit mean of each class, or of each of its K-means parts, at most ``prototypes_per_class``.

    A class with fewer rows has a prototype a row. ``smooth``, ``align`` and ``imprint`` take one a class.
    """
    if prototypes_per_class > 1:
        return unit(_part_means(df.select(F.col(label).alias("label"), F.col(vec).alias("v")), prototypes_per_class, seed), "v")
    return unit(mean_by(df, [label], vec, "v"), "v").withColumnRenamed(label, "label") if label != "label" else unit(mean_by(df, [label], vec, "v"), "v")


def _part_means(df: DataFrame, k: int, seed: int, rounds: int = 300) -> DataFrame:
    """(label, n, v): K-means of every class at once, over all rows; only centres, a few a class, reach the driver."""
    rows = materialize(df, "kmeans")
    r = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("v", F.lit(seed)), "v"))
    drawn = rows.withColumn("_r", r).where(F.col("_r") <= START_ROWS)

    def begin(group: pd.DataFrame) -> pd.DataFrame:
        found = k_means(np.stack(group["v"].to_numpy()), k, seed)
        return pd.DataFrame({"label": group["label"].iloc[0], "part": range(len(found)), "v": list(found)})

    kind = dict(rows.dtypes)["label"]
    centres: dict = {}
    for r in drawn.groupBy("label").applyInPandas(begin, f"label {kind}, part int, v array<double>").orderBy("label", "part").collect():
        centres.setdefault(r["label"], []).append(np.array(r["v"]))
    for _ in range(rounds):
        table = {c: np.stack(v) for c, v in centres.items()}

        @F.pandas_udf("int")
        def part(label: pd.Series, v: pd.Series) -> pd.Series:
            out = np.zeros(len(label), np.int32)
            for c, at in label.groupby(label).indices.items():
                x = np.stack(v.to_numpy()[at])
                out[at] = np.stack([((x - y) ** 2).sum(axis=1) for y in table[c]], axis=1).argmin(axis=1)
            return pd.Series(out)

        means = mean_by(rows.withColumn("part", part("label", "v")), ["label", "part"], "v").collect()
        moved = 0.0
        for r in means:
            now = np.array(r["v"])
            moved = max(moved, float(np.abs(now - centres[r["label"]][r["part"]]).max()))
            centres[r["label"]][r["part"]] = now
        if moved <= 1e-9:
            break
    return df.sparkSession.createDataFrame([(r["label"], r["n"], r["v"]) for r in means] if centres else [], f"label {kind}, n bigint, v array<double>")


def _collected(protos: DataFrame) -> list[tuple]:
    """(label, v) of all prototypes, worked out once and in order; a table too large to send to every task is refused."""
    rows = protos.select("label", "v").orderBy("label").limit(BROADCAST_PROTOTYPES + 1).collect()  # a few a class; one job
    if len(rows) > BROADCAST_PROTOTYPES:
        raise ValueError(f"more than {BROADCAST_PROTOTYPES} prototypes are too many to compare every row with; use operators.knn.top_k with k = 1")
    return sorted((r["label"], tuple(r["v"])) for r in rows)


def known_prototypes(df: DataFrame, classes: int, label: str = "label", vec: str = "v") -> DataFrame:
    """(label, v) of classes 0 .. classes - 1 from unit rows, already worked out; raises if one has no rows."""
    found = _collected(make_prototypes(unit(df, vec), label, vec).where(F.col("label").between(0, classes - 1)))
    if missing := set(range(classes)) - {c for c, _ in found}:
        raise ValueError(f"classes without rows: {sorted(missing)}")
    return df.sparkSession.createDataFrame(found, f"label {dict(df.dtypes)[label]}, v array<double>")


def _with_prototypes(df: DataFrame, protos: DataFrame) -> DataFrame:
    """Rows by prototypes; prototypes (a few a class) are worked out once and broadcast after a check of their number."""
    p = df.sparkSession.createDataFrame(_collected(protos), f"p_label {dict(protos.dtypes)['label']}, p_v array<double>")
    return df.crossJoin(F.broadcast(p))


def nearest_of(protos: DataFrame, old_classes: int = 0, bonus: float = 0.0) -> Callable[[str], Column]:
    """A function of a vector column: (pred, sim) of the prototype with the greatest cosine.

    Old classes get a bonus; ties fall to the smaller label. The prototypes go to the workers as one matrix after a check
    of their number, and a batch of rows costs one product. A null vector, or no prototypes, has null pred.
    """
    known = _collected(protos)
    if not known:
        return lambda v: F.lit(None).cast("struct<pred: bigint, sim: double>")
    labels = np.array([label for label, _ in known])
    sent = protos.sparkSession.sparkContext.broadcast((labels, np.array([v for _, v in known]).T, np.where(labels < old_classes, bonus, 0.0)))

    @F.pandas_udf("pred bigint, sim double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        labels, matrix, extra = sent.value
        out = pd.DataFrame({"pred": pd.Series(pd.NA, v.index, "Int64"), "sim": pd.Series(np.nan, v.index)})
        at = v.notna().to_numpy()
        if at.any():
            x = np.stack(v[at].to_numpy()).astype(np.float64)
            sims = x / (np.linalg.norm(x, axis=1, keepdims=True) + NORM_EPS) @ matrix + extra
            best = sims.argmax(axis=1)
            out.loc[at, "pred"], out.loc[at, "sim"] = labels[best], sims[np.arange(len(best)), best]
        return out

    return nearest


def predict(df: DataFrame, protos: DataFrame, old_classes: int = 0, bonus: float = 0.0) -> DataFrame:
    """(id, pred, sim): see ``nearest_of``. One row for each of ``df``, whatever its id; nothing is shuffled."""
    found = df.select("id", nearest_of(protos, old_classes, bonus)("v").alias("_b"))
    return found.select("id", F.col("_b.pred").alias("pred"), F.when(F.col("_b.pred").isNotNull(), F.col("_b.sim")).alias("sim"))


def distance_scores(df: DataFrame, protos: DataFrame) -> DataFrame:
    """(id, score): 1 - greatest cosine to a known prototype; greater is less known."""
    return predict(df, protos).select("id", (1 - F.col("sim")).alias("score"))


def msp_scores(df: DataFrame, logits: str) -> DataFrame:
    """(id, score): 1 - greatest softmax probability."""
    top = F.array_max(logits)
    den = F.aggregate(F.col(logits), F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_t")))
    return df.select("id", logits, top.alias("_t")).select("id", (1 - 1 / den).alias("score"))


def nearest_to_mean(df: DataFrame, k: int = 20) -> DataFrame:
    """(id, label, rank): the k rows of each class nearest to the class's mean, ties by id."""
    means = mean_by(df, ["label"], "v", "m").select("label", "m")
    d = df.select("id", "label", "v").join(means, "label").select("id", "label", distance(F.col("v"), F.col("m")).alias("d"))
    r = F.row_number().over(Window.partitionBy("label").orderBy("d", "id"))
    return d.withColumn("rank", r).where(F.col("rank") <= k).select("id", "label", "rank")


def replay_memory(old: DataFrame, new: DataFrame, per_class: int = 20, seed: int = 7, round_no: int = 0) -> DataFrame:
    """At most ``per_class`` rows a class, drawn anew from memory and new rows by a seeded hash of the id."""
    every = old.unionByName(new)
    r = F.row_number().over(Window.partitionBy("label").orderBy(*seeded_order("id", seed + round_no)))
    return every.withColumn("_r", r).where(F.col("_r") <= per_class).drop("_r")


def smooth(protos: DataFrame, share: float = 0.20) -> DataFrame:
    """P <- unit((1 - share) P + share A P), A: (cos + 1) / 2 between different prototypes, rows summing to 1.

    protos: a few rows a class; both sides of the comparison are that table.
    """
    a = protos.select("label", F.col("v").alias("a"))
    b = protos.select(F.col("label").alias("other"), F.col("v").alias("b"))
    if protos.count() > BROADCAST_PROTOTYPES:
        raise ValueError("too many prototypes to compare each with each")
    w = (clip(dot(F.col("a"), F.col("b")) / (F.sqrt(dot(F.col("a"), F.col("a"))) * F.sqrt(dot(F.col("b"), F.col("b")))), -1.0, 1.0) + 1) / 2
    pairs = a.crossJoin(F.broadcast(b)).where("label <> other").select("label", "b", w.alias("w"))
    sums = pairs.groupBy("label").agg(F.sum("w").alias("s"))
    parts = pairs.select("label", "w", F.posexplode("b").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.col("w") * F.col("x")).alias("wx"))
    near = parts.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "wx"))).alias("n")).join(sums, "label")
    mixed = a.join(near, "label", "left").select("label", F.when(F.col("n").isNull(), F.col("a")).otherwise(F.zip_with("a", "n", lambda x, y: (1 - share) * x + share * y["wx"] / F.col("s"))).alias("v"))
    return unit(mixed, "v")


def align(old: DataFrame, new: DataFrame, keep: float = 0.7) -> DataFrame:
    """(label, v): keep * old + (1 - keep) * new for classes in both, as unit vectors; others as they are."""
    both = old.select("label", F.col("v").alias("o")).join(new.select("label", F.col("v").alias("n")), "label", "full_outer")
    mixed = F.zip_with("o", "n", lambda x, y: keep * x + (1 - keep) * y)
    return unit(both.select("label", F.when(F.col("o").isNull(), F.col("n")).when(F.col("n").isNull(), F.col("o")).otherwise(mixed).alias("v")), "v")


def enroll(clusters: DataFrame, next_label: int) -> DataFrame:
    """(cluster, label, reliability, v): new labels from ``next_label`` in the order of clusters; reliability in [0, 1]."""
    r = F.row_number().over(Window.orderBy("cluster"))  # a row a cluster
    return clusters.select("cluster", (F.lit(next_label) + r - 1).alias("label"), clip(F.col("reliability"), 0.0, 1.0).alias("reliability"), "v")


def imprint(protos: DataFrame, old_norm: float) -> DataFrame:
    """(label, w, b): rows of a linear head: unit class means as long as the old rows are on average, without bias."""
    return unit(protos, "v").select("label", scale(F.col("v"), old_norm).alias("w"), F.lit(0.0).alias("b"))


def sample_weights(df: DataFrame, floor: float = 0.20) -> DataFrame:
    """(id, weight): the cluster probability, at least the floor; rows that were noise get the floor."""
    return df.select("id", F.when(F.col("raw_cluster") == -1, floor).otherwise(F.greatest(F.lit(floor), F.col("probability"))).alias("weight"))


def cluster_geometry(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(cluster, n, radius, separation): mean distance to the cluster's mean and distance of the nearest other mean."""
    means = materialize(mean_by(df.where("cluster <> -1"), ["cluster"], "v", "m"), "cluster_means")
    radius = df.join(means, "cluster").groupBy("cluster").agg(F.avg(distance(F.col("v"), F.col("m"))).alias("radius"))
    if means.count() > BROADCAST_PROTOTYPES:
        raise ValueError("too many clusters to compare each with each")
    other = means.select(F.col("cluster").alias("c2"), F.col("m").alias("m2"))
    apart = means.crossJoin(F.broadcast(other)).where("cluster <> c2").groupBy("cluster").agg(F.min(distance(F.col("m"), F.col("m2"))).alias("separation"))  # clusters by clusters
    return means.select("cluster", "n").join(radius, "cluster").join(apart, "cluster", "left")


def reliability(df: DataFrame, min_size: int = 10, min_prob: float = 0.30, threshold: float = 0.50) -> DataFrame:
    """(cluster, n, mean_prob, score, accepted): clusters by compactness, separation and membership.

    With medians r and s of radii and separations (1 for a single cluster): score = cube root of exp(-radius / r)
    (1 - exp(-separation / s)) mean_prob, each at least 1e-8; 0 for a cluster that is too small or too uncertain.
    accepted: the score of one that is neither reaches the threshold.
    """
    g = cluster_geometry(df).withColumn("separation", F.coalesce("separation", F.lit(1.0)))
    prob = df.where("cluster <> -1").groupBy("cluster").agg(F.avg("probability").alias("mean_prob"))
    ref = g.agg((F.expr("percentile(radius, 0.5)") + 1e-8).alias("r"), (F.expr("percentile(separation, 0.5)") + 1e-8).alias("s"))  # one row
    both = g.join(prob, "cluster").crossJoin(F.broadcast(ref))
    parts = (F.exp(-F.col("radius") / F.col("r")), 1 - F.exp(-F.col("separation") / F.col("s")), F.col("mean_prob"))
    score = F.exp(sum((F.log(clip(x, 1e-8, 1.0)) for x in parts), F.lit(0.0)) / 3)
    fits = (F.col("n") >= min_size) & (F.col("mean_prob") >= min_prob)
    out = both.select("cluster", "n", "mean_prob", fits.alias("_fits"), F.when(fits, score).otherwise(0.0).alias("score"))
    return out.withColumn("accepted", F.col("_fits") & (F.col("score") >= threshold)).drop("_fits")


def library_reliability(
    df: DataFrame, known: DataFrame, min_size: int = 30, tau: float = 0.5, tau_known: float | None = None, tau_conf: float | None = None, rf: str | None = None, confidence: str | None = None,
) -> DataFrame:
    """(cluster, n, known_distance, compactness, separation, slot_consistency, rf_consistency, confidence, score, status, hard_fail_reasons).

    compactness: exp(-mean distance to the mean), 0 for a single row; separation: 1 - exp(-nearest distance to another
    cluster's mean), 1 for the only cluster; slot consistency: share of the most frequent slot; RF consistency:
    compactness in the column ``rf``; confidence: mean of the column with unknown scores. score: geometric mean of the
    first three and, with ``rf``, the fourth. status: reliable, pending (score too low) or reject, where a hard rule
    fails: size, too_close_to_known (distance at most tau_known), unknown_confidence_too_low (at most tau_conf).
    """
    own = df.where("cluster <> -1")
    out = cluster_geometry(df).withColumnRenamed("separation", "_apart")
    near = _with_prototypes(mean_by(own, ["cluster"], "v", "m"), known).groupBy("cluster").agg(F.min(distance(F.col("m"), F.col("p_v"))).alias("known_distance"))
    slots = own.groupBy("cluster", "slot").count().groupBy("cluster").agg((F.max("count") / F.sum("count")).alias("slot_consistency"))
    out = out.join(near, "cluster").join(slots, "cluster")
    compact = lambda c: F.when(F.col("n") <= 1, 0.0).otherwise(F.exp(-F.col(c)))
    if rf is not None:
        spread = cluster_geometry(own.select("cluster", F.col(rf).alias("v"))).select("cluster", F.col("radius").alias("_rf"))
        out = out.join(spread, "cluster").withColumn("rf_consistency", compact("_rf"))
    else:
        out = out.withColumn("rf_consistency", F.lit(None).cast("double"))
    if confidence is not None:
        out = out.join(own.groupBy("cluster").agg(F.avg(confidence).alias("confidence")), "cluster")
    else:
        out = out.withColumn("confidence", F.lit(None).cast("double"))
    out = out.withColumn("compactness", compact("radius")).withColumn("separation", F.when(F.col("_apart").isNull(), 1.0).otherwise(1 - F.exp(-F.col("_apart"))))
    parts = ["compactness", "separation", "slot_consistency", *(["rf_consistency"] if rf is not None else [])]
    out = out.withColumn("score", F.exp(sum((F.log(clip(F.col(c), 1e-8, 1.0)) for c in parts), F.lit(0.0)) / len(parts)))
    why = [F.when(F.col("n") < min_size, F.lit("size"))]
    if tau_known is not None:
        why.append(F.when(F.col("known_distance") <= tau_known, F.lit("too_close_to_known")))
    if tau_conf is not None and confidence is not None:
        why.append(F.when(F.col("confidence") <= tau_conf, F.lit("unknown_confidence_too_low")))
    out = out.withColumn("hard_fail_reasons", F.array_compact(F.array(*why)))
    out = out.withColumn("status", F.when(F.size("hard_fail_reasons") > 0, "reject").when(F.col("score") >= tau, "reliable").otherwise("pending"))
    return out.select("cluster", "n", "known_distance", "compactness", "separation", "slot_consistency", "rf_consistency", "confidence", "score", "status", "hard_fail_reasons")
