"""One query an operator, each with the SQL that gives the same rows where SQL can express it.

Numbers are rounded in both forms, since sums differ in their last digits with the order of addition. The driver's
tables hold no signals: a vector's first and second half stand for the I and Q channels of a record.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexilar.functions import registry, rf, vectors
from vexilar.operators import cluster, components, consolidate, density, graph, knn, metrics, prototypes, recordings, reports, spectral, splits
from vexilar.operators.prefix import running
from vexilar.plans import baselines, signal_sql
from vexilar.session import materialize, scratch_path, table
from vexilar.streaming import memory, rounds

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def _registered() -> None:
    from vexilar.plans import more, scans  # noqa: F401 - they register their queries, and need what this module defines


def queries() -> dict[str, Query]:
    _registered()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _registered()
    return dict(_sql)


def _r(c, digits: int = 6):
    """Rounded, without a negative zero."""
    return F.round(c if not isinstance(c, str) else F.col(c), digits) + F.lit(0.0)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("label"), vectors.doubles(F.col("embedding")).alias("v"))


def _two_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("id", "label", "v", F.slice("v", 1, 32).alias("deep"), F.slice("v", 33, 32).alias("rf"))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label classes as truth, a fixed function of the id as clusters, with noise."""
    return _vectors(spark, sf_dir).select("id", "label", "v", F.when(F.col("id") % 11 == 0, -1).otherwise((F.col("label") + F.when(F.col("id") % 7 == 0, 1).otherwise(0)) % 8).cast("bigint").alias("cluster"))


# ---- SQL pieces ----

E = "e AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
R = lambda x, d=6: f"round({x}, {d}) + 0.0"
CLUSTER = "CASE WHEN id % 11 = 0 THEN -1 ELSE (label + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END) % 8 END"


def _parts(v: str, source: str, name: str) -> str:
    return f"{name} AS (SELECT id, label, unnest({v}) AS x, generate_subscripts({v}, 1) AS i FROM {source})"


def _z(v: str, source: str, name: str, eps: str) -> str:
    return f"{_parts(v, source, name + '_p')}, {name}_s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS sd FROM {name}_p GROUP BY i), {name} AS (SELECT id, label, list((x - m) / (sd + {eps}) ORDER BY i) AS v FROM {name}_p JOIN {name}_s USING (i) GROUP BY id, label)"


def _near(source: str, name: str, k: int, value: str, own: bool) -> str:
    skip = "" if own else "WHERE a.id <> b.id"
    return f"{name} AS (SELECT src, dst, w FROM (SELECT a.id AS src, b.id AS dst, {value} AS w FROM {source} a, {source} b {skip}) QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) <= {k})"


COS = "greatest(-1.0, least(1.0, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))))"


def _sym(source: str, name: str) -> str:
    return f"{name} AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, w FROM {source} WHERE src <> dst UNION ALL SELECT dst, src, w FROM {source} WHERE src <> dst) GROUP BY src, dst UNION ALL SELECT DISTINCT src, src, 1.0 FROM {source})"


def _cos_graph(source: str, name: str, k: int = 20) -> str:
    return f"{_near(source, name + '_n', k, COS, True)}, {name}_w AS (SELECT src, dst, (w + 1) / 2 AS w FROM {name}_n), {_sym(name + '_w', name)}"


def _rbf_graph(source: str, name: str, k: int = 20) -> str:
    sigma = f"{name}_m AS (SELECT median(d) AS s FROM (SELECT list_distance(a.v, b.v) AS d FROM {source} a, {source} b WHERE a.id <> b.id) WHERE d > 0)"
    return f"{sigma}, {_near(source, name + '_n', k, '-list_distance(a.v, b.v)', True)}, {name}_w AS (SELECT src, dst, exp(-w * w / (2 * s * s + 1e-8)) AS w FROM {name}_n, {name}_m), {_sym(name + '_w', name)}"


HALVES = "da AS (SELECT id, label, v[1:32] AS v FROM e), rb AS (SELECT id, label, v[33:64] AS v FROM e)"
MEANS = "mp AS (SELECT label, i, avg(x) AS x FROM ep GROUP BY label, i), m AS (SELECT label, list(x ORDER BY i) AS v FROM mp GROUP BY label)"
UNIT = "u AS (SELECT id, label, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-8)) AS v FROM e)"
PROTO = f"{UNIT}, {_parts('v', 'u', 'ep')}, {MEANS}, pr AS (SELECT label, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-8)) AS v FROM m)"


# ---- vectors, neighbours, graphs ----


@query(f"WITH {E}, {_z('v', 'e', 'z', '1e-6')}, {_near('z', 'n', 10, '-list_distance(a.v, b.v)', False)} SELECT 10 AS k, {R('avg(p)')} AS purity FROM (SELECT src, avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END) AS p FROM n JOIN e a ON src = a.id JOIN e b ON dst = b.id GROUP BY src)")
def knn_purity_k10(spark, sf_dir):
    return knn.knn_purity(_vectors(spark, sf_dir), 10).select("k", _r("purity").alias("purity"))


@query(f"WITH {E} SELECT id, {R('sqrt(list_inner_product(v, v))')} AS norm FROM e")
def l2_norm(spark, sf_dir):
    return _vectors(spark, sf_dir).select("id", _r(vectors.norm(F.col("v"))).alias("norm"))


@query(f"WITH {E}, {_z('v', 'e', 'z', '1e-8')} SELECT id, {R('v[1]')} AS first, {R('v[64]')} AS last, {R('list_sum(v)')} AS total FROM z")
def zscore_columns(spark, sf_dir):
    return vectors.standardize(_vectors(spark, sf_dir), "v").select("id", _r(F.get("v", F.lit(0))).alias("first"), _r(F.get("v", F.lit(63))).alias("last"), _r(vectors.total(F.col("v"))).alias("total"))


@query(f"WITH {E}, {_parts('v', 'e', 'ep')} SELECT label, i - 1 AS i, {R('avg(x)')} AS mean FROM ep GROUP BY label, i")
def vector_mean_by_label(spark, sf_dir):
    return vectors.mean_by(_vectors(spark, sf_dir), ["label"], "v").select("label", F.posexplode("v").alias("i", "x")).select("label", F.col("i").cast("bigint").alias("i"), _r("x").alias("mean"))


@query(f"WITH {E}, {_near('e', 'n', 20, COS, True)} SELECT src, dst, {R('w')} AS w FROM n")
def cosine_topk(spark, sf_dir):
    return knn.top_k(_vectors(spark, sf_dir), 20).select("src", "dst", _r("w").alias("w"))


@query(f"WITH {E} SELECT {R('median(d)', 9)} AS sigma FROM (SELECT list_distance(a.v, b.v) AS d FROM e a, e b WHERE a.id <> b.id) WHERE d > 0")
def rbf_sigma_median(spark, sf_dir):
    s = knn.distance_median(_vectors(spark, sf_dir))
    return spark.createDataFrame([(s,)], "sigma double").select(_r("sigma", 9).alias("sigma"))


@query(f"WITH {E}, {_cos_graph('e', 'g')} SELECT src, dst, {R('w')} AS w FROM g")
def cosine_graph_sym(spark, sf_dir):
    return graph.cosine_graph(_vectors(spark, sf_dir)).select("src", "dst", _r("w").alias("w"))


@query(f"WITH {E}, {_rbf_graph('e', 'g')} SELECT src, dst, {R('w')} AS w FROM g")
def rbf_graph_sym(spark, sf_dir):
    return graph.rbf_graph(_vectors(spark, sf_dir)).select("src", "dst", _r("w").alias("w"))


@query(f"WITH {E}, {_cos_graph('e', 'g')}, t AS (SELECT src, dst, w FROM g QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) <= 5), s AS (SELECT src, dst, sum(w) / 2 AS w FROM (SELECT src, dst, w FROM t WHERE src <> dst UNION ALL SELECT dst, src, w FROM t WHERE src <> dst) GROUP BY src, dst UNION ALL SELECT DISTINCT src, src, 1.0 FROM t) SELECT src, dst, {R('w')} AS w FROM s")
def graph_topk_average(spark, sf_dir):
    g = materialize(graph.cosine_graph(_vectors(spark, sf_dir)).select("src", "dst", "w"), "graph")
    return graph.symmetrize(graph.keep_top_k(g, 5), "avg").select("src", "dst", _r("w").alias("w"))


@query(f"WITH {E}, {_cos_graph('e', 'g')}, d AS (SELECT src AS n, sum(w) AS d FROM g GROUP BY src) SELECT src, dst, {R('w / (a.d + 1e-8)')} AS row_w, {R('w / sqrt((a.d + 1e-8) * (b.d + 1e-8))')} AS sym_w, {R('w / ((SELECT max(w) FROM g) + 1e-8)')} AS max_w FROM g JOIN d a ON src = a.n JOIN d b ON dst = b.n")
def graph_degree_normalised(spark, sf_dir):
    g = materialize(graph.cosine_graph(_vectors(spark, sf_dir)), "graph")
    modes = {"row_w": "row", "sym_w": "symmetric", "max_w": "max"}
    return graph.normalized_columns(g, modes).select("src", "dst", *[_r(c).alias(c) for c in modes])


FUSED = f"{E}, {HALVES}, {_cos_graph('da', 'g')}, {_rbf_graph('rb', 'h')}, j AS (SELECT src, dst, coalesce(g.w, 0) AS a, coalesce(h.w, 0) AS b FROM g FULL JOIN h USING (src, dst))"


@query(f"WITH {FUSED}, f AS (SELECT src, dst, 0.7 * a + 0.3 * b AS w FROM j), {_sym('f', 's')} SELECT src, dst, {R('w')} AS w FROM s")
def fused_graph_fixed(spark, sf_dir):
    return graph.multiview_graph(_two_views(spark, sf_dir), "deep", "rf").select("src", "dst", _r("w").alias("w"))


CONSISTENT = f"{_z('v', 'da', 'za', '1e-6')}, {_z('v', 'rb', 'zb', '1e-6')}, {_near('za', 'na', 12, '-list_distance(a.v, b.v)', False)}, {_near('zb', 'nb', 12, '-list_distance(a.v, b.v)', False)}, c AS (SELECT e.id, 0.10 + 0.90 * count(nb.dst) / 12 AS r FROM e LEFT JOIN na ON na.src = e.id LEFT JOIN nb ON nb.src = na.src AND nb.dst = na.dst GROUP BY e.id)"
ADAPT = f"{FUSED}, {CONSISTENT}, al AS (SELECT src, dst, a, b, least(greatest(0.95 - 0.30 * b / (a + b + 1e-8), 0.65), 0.95) AS x FROM j), ar AS (SELECT src, dst, a, b, x + (1 - x) * (1 - sqrt(s.r * d.r)) AS x FROM al JOIN c s ON s.id = src JOIN c d ON d.id = dst)"


def _adaptive(spark, sf_dir):
    df = _two_views(spark, sf_dir)
    trust = knn.cross_view_consistency(df, "deep", "rf", 12)
    return graph.adaptive_edges(graph.cosine_graph(df, 20, "deep"), graph.rbf_graph(df, 20, "rf"), reliability=trust)


@query(f"WITH {ADAPT}, f AS (SELECT src, dst, x * a + (1 - x) * b AS w FROM ar), {_sym('f', 's')} SELECT src, dst, {R('w')} AS w FROM s")
def fused_graph_adaptive(spark, sf_dir):
    return graph.symmetrize(_adaptive(spark, sf_dir).select("src", "dst", "w")).select("src", "dst", _r("w").alias("w"))


@query(f"WITH {ADAPT} SELECT {R('avg(x)')} AS alpha_mean, {R('min(x)')} AS alpha_min, {R('max(x)')} AS alpha_max FROM ar WHERE src <> dst")
def fusion_statistics(spark, sf_dir):
    return graph.fusion_stats(_adaptive(spark, sf_dir)).select(*[_r(c).alias(c) for c in ("alpha_mean", "alpha_min", "alpha_max")])


@query(f"WITH {E}, {HALVES}, {CONSISTENT} SELECT id, {R('r')} AS reliability FROM c")
def cross_view_overlap(spark, sf_dir):
    return knn.cross_view_consistency(_two_views(spark, sf_dir), "deep", "rf", 12).select("id", _r("reliability").alias("reliability"))


# ---- prototypes, open-set scores, memories ----

PREDICT = "p AS (SELECT u.id, u.label, pr.label AS pred, list_inner_product(u.v, pr.v) AS sim FROM u, pr QUALIFY row_number() OVER (PARTITION BY u.id ORDER BY sim DESC, pr.label) = 1)"


def _protos(spark, sf_dir):
    return prototypes.make_prototypes(vectors.unit(_vectors(spark, sf_dir), "v"))


@query(f"WITH {E}, {PROTO} SELECT label, i - 1 AS i, {R('x')} AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM pr)")
def class_prototypes(spark, sf_dir):
    return _protos(spark, sf_dir).select("label", F.posexplode("v").alias("i", "x")).select("label", F.col("i").cast("bigint").alias("i"), _r("x").alias("x"))


@query(f"WITH {E}, {PROTO}, {PREDICT} SELECT id, pred, {R('sim')} AS sim FROM p")
def prototype_predict(spark, sf_dir):
    return prototypes.predict(_vectors(spark, sf_dir), _protos(spark, sf_dir)).select("id", "pred", _r("sim").alias("sim"))


@query(f"WITH {E} SELECT label, CAST(k AS INT) AS rank, id FROM (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || id), id) AS k FROM e) WHERE k <= 20")
def replay_memory_stream(spark, sf_dir):
    """The memory that a stream of three micro-batches keeps, the last of them after a restart."""
    path = scratch_path(spark, "replay")
    df = _vectors(spark, sf_dir)
    for k in range(3):
        df.where(F.pmod(F.xxhash64("id"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
        if k:  # the first two parts are two batches of one run
            source = spark.readStream.schema("id bigint, label bigint, v array<double>").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
            memory.run_replay(source, path).awaitTermination()
    return memory.read_replay(spark, path).select("label", "rank", "id")


@query(f"WITH {E}, {PROTO}, {PREDICT} SELECT id, pred, {R('sim')} AS sim FROM p")
def saved_pipeline_predict(spark, sf_dir):
    """The same rows from a pipeline that was fitted, saved and loaded."""
    from pyspark.ml import Pipeline, PipelineModel

    from vexilar.models.ml import NearestPrototype

    df, path = _vectors(spark, sf_dir), scratch_path(spark, "pipeline")
    Pipeline(stages=[NearestPrototype(inputCol="v")]).fit(df).write().overwrite().save(path)
    return PipelineModel.load(path).transform(df).select("id", "pred", _r("sim").alias("sim"))


@query(f"WITH {E}, {PROTO}, p AS (SELECT u.id, pr.label AS pred, list_inner_product(u.v, pr.v) + CASE WHEN pr.label < 4 THEN 0.05 ELSE 0 END AS sim FROM u, pr QUALIFY row_number() OVER (PARTITION BY u.id ORDER BY sim DESC, pr.label) = 1) SELECT id, pred, {R('sim')} AS sim FROM p")
def prototype_bonus(spark, sf_dir):
    return prototypes.predict(_vectors(spark, sf_dir), _protos(spark, sf_dir), 4, 0.05).select("id", "pred", _r("sim").alias("sim"))


KNOWN = f"{E}, {PROTO}, kp AS (SELECT * FROM pr WHERE label < 6), sc AS (SELECT u.id, u.label >= 6 AS unknown, 1 - max(list_inner_product(u.v, kp.v)) AS score FROM u, kp GROUP BY u.id, u.label)"


def _scores(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    s = prototypes.distance_scores(df, prototypes.known_prototypes(df.where("label < 6"), 6))
    return materialize(s.join(df.select("id", (F.col("label") >= 6).alias("unknown")), "id"), "scores")


@query(f"WITH {KNOWN} SELECT id, {R('score')} AS score FROM sc")
def prototype_distance_score(spark, sf_dir):
    return _scores(spark, sf_dir).select("id", _r("score").alias("score"))


@query(f"WITH {E}, l AS (SELECT id, v[1:10] AS l FROM e) SELECT id, {R('1 - 1 / list_sum(list_transform(l, lambda x: exp(x - list_max(l))))')} AS score FROM l")
def msp_score(spark, sf_dir):
    return prototypes.msp_scores(_vectors(spark, sf_dir).withColumn("logits", F.slice("v", 1, 10)), "logits").select("id", _r("score").alias("score"))


@query(f"WITH {KNOWN}, rk AS (SELECT unknown, round(score, 4) AS s FROM sc), mr AS (SELECT unknown, avg(r) OVER (PARTITION BY s) AS r FROM (SELECT unknown, s, row_number() OVER (ORDER BY s) AS r FROM rk)) SELECT {R('(sum(CASE WHEN unknown THEN r ELSE 0 END) - count(*) FILTER (unknown) * (count(*) FILTER (unknown) + 1) / 2) / (count(*) FILTER (unknown) * count(*) FILTER (NOT unknown))')} AS auroc FROM mr")
def auroc(spark, sf_dir):
    return metrics.auroc(_scores(spark, sf_dir).withColumn("score", F.round("score", 4))).select(_r("auroc").alias("auroc"))


@query(f"WITH {KNOWN}, rk AS (SELECT unknown, round(score, 4) AS s FROM sc), t AS (SELECT s, sum(count(*) FILTER (unknown)) OVER (ORDER BY s DESC) AS tp, sum(count(*) FILTER (NOT unknown)) OVER (ORDER BY s DESC) AS fp FROM rk GROUP BY s) SELECT {R('coalesce(min(fp / (SELECT count(*) FROM rk WHERE NOT unknown)), 1.0)')} AS fpr FROM t WHERE tp / (SELECT count(*) FROM rk WHERE unknown) >= 0.95")
def fpr95(spark, sf_dir):
    return metrics.fpr_at_tpr(_scores(spark, sf_dir).withColumn("score", F.round("score", 4))).select(_r("fpr").alias("fpr"))


@query(f"WITH {KNOWN}, rk AS (SELECT unknown, round(score, 4) >= 0.7 AS rej FROM sc), n AS (SELECT count(*) FILTER (NOT unknown) AS known, count(*) FILTER (unknown) AS unknowns, count(*) FILTER (NOT unknown AND NOT rej) AS ka, count(*) FILTER (NOT unknown AND rej) AS kr, count(*) FILTER (unknown AND rej) AS ur, count(*) FILTER (unknown AND NOT rej) AS ua FROM rk) SELECT known, unknowns, {R('ka / greatest(known, 1)')} AS known_accept, {R('kr / greatest(known, 1)')} AS known_reject, {R('ur / greatest(unknowns, 1)')} AS unknown_reject, {R('ua / greatest(unknowns, 1)')} AS unknown_accept FROM n")
def openset_stats(spark, sf_dir):
    s = metrics.openset_stats(_scores(spark, sf_dir).withColumn("score", F.round("score", 4)), 0.7)
    return s.select("known", "unknowns", *[_r(c).alias(c) for c in ("known_accept", "known_reject", "unknown_reject", "unknown_accept")])


@query(f"WITH {E}, {_parts('v', 'e', 'ep')}, {MEANS}, d AS (SELECT e.id, e.label, round(list_distance(e.v, m.v), 9) AS d FROM e JOIN m USING (label)) SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY d, id) AS rank FROM d QUALIFY rank <= 20")
def exemplars_top20(spark, sf_dir):
    return prototypes.nearest_to_mean(_vectors(spark, sf_dir)).select("id", "label", F.col("rank").cast("bigint").alias("rank"))


SMOOTH = "w AS (SELECT a.label, b.label AS other, a.v AS a, b.v AS b, (greatest(-1.0, least(1.0, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))))) + 1) / 2 AS w FROM pr a, pr b WHERE a.label <> b.label), ws AS (SELECT label, sum(w) AS s FROM w GROUP BY label), wx AS (SELECT label, unnest(b) * w AS x, generate_subscripts(b, 1) AS i FROM w), wv AS (SELECT label, i, sum(x) AS x FROM wx GROUP BY label, i), sm AS (SELECT pr.label, list(0.8 * pr.v[i] + 0.2 * x / s ORDER BY i) AS v FROM pr JOIN wv USING (label) JOIN ws USING (label) GROUP BY pr.label)"


@query(f"WITH {E}, {PROTO}, {SMOOTH} SELECT label, i - 1 AS i, {R('x / (sqrt(n) + 1e-8)')} AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i, list_inner_product(v, v) AS n FROM sm)")
def smoothed_prototypes(spark, sf_dir):
    return prototypes.smooth(_protos(spark, sf_dir)).select("label", F.posexplode("v").alias("i", "x")).select("label", F.col("i").cast("bigint").alias("i"), _r("x").alias("x"))


@query(f"WITH {E}, {UNIT}, {_parts('v', 'u', 'ep')}, q AS (SELECT label, id % 2 AS h, i, avg(x) AS x FROM ep GROUP BY ALL), n AS (SELECT label, h, sqrt(sum(x * x)) + 1e-8 AS n FROM q GROUP BY label, h), o AS (SELECT label, i, sum(CASE WHEN h = 0 THEN 0.7 ELSE 0.3 END * x / n) AS x FROM q JOIN n USING (label, h) GROUP BY label, i), t AS (SELECT label, sqrt(sum(x * x)) + 1e-8 AS n FROM o GROUP BY label) SELECT label, i - 1 AS i, {R('x / n')} AS x FROM o JOIN t USING (label)")
def aligned_prototypes(spark, sf_dir):
    u = vectors.unit(_vectors(spark, sf_dir), "v")
    half = lambda h: prototypes.make_prototypes(u.where(F.col("id") % 2 == h))
    return prototypes.align(half(0), half(1)).select("label", F.posexplode("v").alias("i", "x")).select("label", F.col("i").cast("bigint").alias("i"), _r("x").alias("x"))


@query(f"WITH {E}, {PROTO}, o AS (SELECT avg(sqrt(list_inner_product(v, v))) AS k FROM m) SELECT label, {R('v[1] * k')} AS w_first, {R('sqrt(list_inner_product(v, v)) * k')} AS w_norm, 0.0 AS b FROM pr, o")
def imprinted_head(spark, sf_dir):
    u = vectors.unit(_vectors(spark, sf_dir), "v")
    k = vectors.mean_by(u, ["label"], "v").agg(F.avg(vectors.norm(F.col("v")))).first()[0]
    head = prototypes.imprint(_protos(spark, sf_dir), k)
    return head.select("label", _r(F.get("w", F.lit(0))).alias("w_first"), _r(vectors.norm(F.col("w"))).alias("w_norm"), "b")


@query(f"WITH {E}, c AS (SELECT id, {CLUSTER} AS cluster, (id % 100) / 100 AS p FROM e) SELECT id, {R('CASE WHEN cluster = -1 THEN 0.2 ELSE greatest(0.2, p) END')} AS weight FROM c")
def pseudo_label_weights(spark, sf_dir):
    df = _clusters(spark, sf_dir).select("id", F.col("cluster").alias("raw_cluster"), (F.col("id") % 100 / 100).alias("probability"))
    return prototypes.sample_weights(df).select("id", _r("weight").alias("weight"))


# ---- clusters and metrics ----

CL = f"{E}, c AS (SELECT id, label, v, CAST({CLUSTER} AS BIGINT) AS cluster FROM e)"
GEO = f"{CL}, cp AS (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM c WHERE cluster <> -1), cm AS (SELECT cluster, i, avg(x) AS x, count(*) AS n FROM cp GROUP BY cluster, i), m AS (SELECT cluster, max(n) AS n, list(x ORDER BY i) AS v FROM cm GROUP BY cluster), ra AS (SELECT c.cluster, avg(list_distance(c.v, m.v)) AS radius FROM c JOIN m USING (cluster) GROUP BY c.cluster), se AS (SELECT a.cluster, min(list_distance(a.v, b.v)) AS separation FROM m a, m b WHERE a.cluster <> b.cluster GROUP BY a.cluster)"


@query(f"WITH {GEO} SELECT cluster, n, {R('radius')} AS radius, {R('separation')} AS separation FROM m JOIN ra USING (cluster) LEFT JOIN se USING (cluster)")
def compactness_separation(spark, sf_dir):
    return prototypes.cluster_geometry(_clusters(spark, sf_dir)).select("cluster", "n", _r("radius").alias("radius"), _r("separation").alias("separation"))


RELIABLE = f"{GEO}, pb AS (SELECT cluster, avg((id % 100) / 100) AS mean_prob FROM c WHERE cluster <> -1 GROUP BY cluster), g AS (SELECT cluster, n, mean_prob, radius, coalesce(separation, 1.0) AS separation FROM m JOIN ra USING (cluster) LEFT JOIN se USING (cluster) JOIN pb USING (cluster)), f AS (SELECT median(radius) + 1e-8 AS r, median(separation) + 1e-8 AS s FROM g), o AS (SELECT cluster, n, mean_prob, CASE WHEN n >= 10 AND mean_prob >= 0.3 THEN exp((ln(greatest(exp(-radius / r), 1e-8)) + ln(greatest(1 - exp(-separation / s), 1e-8)) + ln(greatest(mean_prob, 1e-8))) / 3) ELSE 0 END AS score FROM g, f)"


@query(f"WITH {RELIABLE} SELECT cluster, n, {R('mean_prob')} AS mean_prob, {R('score')} AS score, n >= 10 AND mean_prob >= 0.3 AND score >= 0.5 AS accepted FROM o")
def reliability_filter(spark, sf_dir):
    df = _clusters(spark, sf_dir).withColumn("probability", F.col("id") % 100 / 100)
    return prototypes.reliability(df).select("cluster", "n", _r("mean_prob").alias("mean_prob"), _r("score").alias("score"), "accepted")


LIBRARY = (
    f"{GEO}, kn AS (SELECT label, list(x ORDER BY i) AS k FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e WHERE label < 3) GROUP BY label, i) GROUP BY label), "
    "ku AS (SELECT label, list_transform(k, lambda x: x / (sqrt(list_inner_product(k, k)) + 1e-8)) AS k FROM kn), kd AS (SELECT cluster, min(list_distance(v, k)) AS known_distance FROM m, ku GROUP BY cluster), "
    "sl AS (SELECT cluster, max(n) / sum(n) AS slot_consistency FROM (SELECT cluster, id % 3 AS slot, count(*) AS n FROM c WHERE cluster <> -1 GROUP BY ALL) GROUP BY cluster), "
    "rc AS (SELECT cluster, exp(-avg(d)) AS rf_consistency FROM (SELECT c.cluster, list_distance(c.v[33:64], m.v[33:64]) AS d FROM c JOIN m USING (cluster)) GROUP BY cluster), "
    "cf AS (SELECT cluster, avg((id % 10) / 10) AS confidence FROM c WHERE cluster <> -1 GROUP BY cluster), "
    "q AS (SELECT cluster, n, known_distance, CASE WHEN n <= 1 THEN 0 ELSE exp(-radius) END AS compactness, coalesce(1 - exp(-separation), 1.0) AS separation, slot_consistency, CASE WHEN n <= 1 THEN 0 ELSE rf_consistency END AS rf_consistency, confidence "
    "FROM m JOIN ra USING (cluster) LEFT JOIN se USING (cluster) JOIN kd USING (cluster) JOIN sl USING (cluster) JOIN rc USING (cluster) JOIN cf USING (cluster)), "
    "t AS (SELECT *, exp((ln(greatest(compactness, 1e-8)) + ln(greatest(separation, 1e-8)) + ln(greatest(slot_consistency, 1e-8)) + ln(greatest(rf_consistency, 1e-8))) / 4) AS score, "
    "array_to_string(list_filter([CASE WHEN n < 50 THEN 'size' END, CASE WHEN known_distance <= 0.9 THEN 'too_close_to_known' END, CASE WHEN confidence <= 0.45 THEN 'unknown_confidence_too_low' END], lambda x: x IS NOT NULL), ',') AS why FROM q)"
)


@query(f"WITH {LIBRARY} SELECT cluster, n, {', '.join(f'{R(x)} AS {x}' for x in ('known_distance', 'compactness', 'separation', 'slot_consistency', 'rf_consistency', 'confidence', 'score'))}, CASE WHEN why <> '' THEN 'reject' WHEN score >= 0.4 THEN 'reliable' ELSE 'pending' END AS status, why FROM t")
def library_reliability(spark, sf_dir):
    df = _clusters(spark, sf_dir).select("id", "label", "cluster", "v", (F.col("id") % 3).alias("slot"), (F.col("id") % 10 / 10).alias("unknown"), F.slice("v", 33, 32).alias("rf"))
    known = prototypes.make_prototypes(_vectors(spark, sf_dir).where("label < 3"))
    t = prototypes.library_reliability(df, known, 50, 0.4, 0.9, 0.45, "rf", "unknown")
    return t.select("cluster", "n", *[_r(c).alias(c) for c in ("known_distance", "compactness", "separation", "slot_consistency", "rf_consistency", "confidence", "score")], "status", F.array_join("hard_fail_reasons", ",").alias("why"))


@query(f"WITH {CL} SELECT label AS truth, cluster, count(*) AS n FROM c GROUP BY ALL")
def contingency(spark, sf_dir):
    return metrics.contingency(_clusters(spark, sf_dir))


@query(f"WITH {CL}, t AS (SELECT cluster, label, count(*) AS n FROM c WHERE cluster <> -1 GROUP BY ALL), p AS (SELECT cluster, max(n) AS top, sum(n) AS n FROM t GROUP BY cluster) SELECT {R('sum(top) / sum(n)')} AS purity FROM p")
def cluster_purity(spark, sf_dir):
    return metrics.purity(metrics.contingency(_clusters(spark, sf_dir))).select(_r("purity").alias("purity"))


INFO = f"{CL}, t AS (SELECT label, cluster, count(*) AS n FROM c GROUP BY ALL), a AS (SELECT label, sum(n) AS a FROM t GROUP BY label), b AS (SELECT cluster, sum(n) AS b FROM t GROUP BY cluster), z AS (SELECT sum(n) AS z FROM t), mi AS (SELECT sum(n / z * ln(n * z / (a * b))) AS mi FROM t JOIN a USING (label) JOIN b USING (cluster), z), ha AS (SELECT -sum(a / z * ln(a / z)) AS ha FROM a, z), hb AS (SELECT -sum(b / z * ln(b / z)) AS hb FROM b, z)"


@query(f"WITH {INFO} SELECT {R('2 * mi / (ha + hb)')} AS nmi FROM mi, ha, hb")
def nmi(spark, sf_dir):
    return metrics.nmi(materialize(metrics.contingency(_clusters(spark, sf_dir)), "table")).select(_r("nmi").alias("nmi"))


@query(f"WITH {INFO} SELECT {R('mi / ha')} AS homogeneity, {R('mi / hb')} AS completeness, {R('2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb)')} AS v_measure FROM mi, ha, hb")
def v_measure(spark, sf_dir):
    t = metrics.homogeneity_completeness(materialize(metrics.contingency(_clusters(spark, sf_dir)), "table"))
    return t.select(*[_r(c).alias(c) for c in t.columns])


@query(f"WITH {INFO}, s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS ij, (SELECT sum(a * (a - 1) / 2) FROM a) AS pa, (SELECT sum(b * (b - 1) / 2) FROM b) AS pb, (SELECT z * (z - 1) / 2 FROM z) AS pz) SELECT {R('(ij - pa * pb / pz) / ((pa + pb) / 2 - pa * pb / pz)')} AS ari FROM s")
def ari(spark, sf_dir):
    return metrics.ari(materialize(metrics.contingency(_clusters(spark, sf_dir)), "table")).select(_r("ari").alias("ari"))


def _match_sql() -> str:
    """The best one-to-one match of clusters 0 to 7 with labels, cluster by cluster, for every set of labels used."""
    first = "g0 AS (SELECT 0 AS used, 0::HUGEINT AS total, []::BIGINT[] AS mapped)"
    step = lambda k: (
        f"g{k + 1} AS (SELECT used, max(total) AS total, arg_min(mapped, {{'a': -total, 'b': mapped}}) AS mapped FROM (SELECT used, total, list_append(mapped, NULL) AS mapped FROM g{k} "
        f"UNION ALL SELECT used | (1 << label), total + n, list_append(mapped, label) FROM g{k} JOIN t ON cluster = {k} AND used & (1 << label) = 0) GROUP BY used)"
    )
    return ", ".join([f"{CL}, t AS (SELECT cluster, label, count(*) AS n FROM c WHERE cluster <> -1 GROUP BY ALL)", first, *map(step, range(8))])


@query(f"WITH {_match_sql()} SELECT {R('max(total) / (SELECT count(*) FROM c)')} AS accuracy FROM g8")
def hungarian_accuracy(spark, sf_dir):
    t = materialize(metrics.contingency(_clusters(spark, sf_dir)), "table")
    return spark.createDataFrame([(metrics.hungarian_accuracy(t),)], "accuracy double").select(_r("accuracy").alias("accuracy"))


@query(f"WITH {_match_sql()}, best AS (SELECT arg_min(mapped, {{'a': -total, 'b': mapped}}) AS mapped FROM g8) SELECT cluster, coalesce(mapped[cluster + 1], -(1000000 + cluster)) AS mapped FROM (SELECT DISTINCT cluster FROM t), best")
def posthoc_alignment(spark, sf_dir):
    return metrics.posthoc_map(materialize(metrics.contingency(_clusters(spark, sf_dir)), "table"))


@query(f"WITH {CL}, k AS (SELECT CAST(range AS BIGINT) AS label FROM range(12)), t AS (SELECT label, count(*) AS nt FROM c GROUP BY label), p AS (SELECT cluster AS label, count(*) AS np FROM c GROUP BY cluster), h AS (SELECT label, count(*) AS tp FROM c WHERE label = cluster GROUP BY label) SELECT {R('avg(CASE WHEN coalesce(nt, 0) + coalesce(np, 0) = 0 THEN 0.0 ELSE 2 * coalesce(tp, 0) / (coalesce(nt, 0) + coalesce(np, 0)) END)')} AS macro_f1 FROM k LEFT JOIN t USING (label) LEFT JOIN p USING (label) LEFT JOIN h USING (label)")
def macro_f1(spark, sf_dir):
    labels = spark.range(12).withColumnRenamed("id", "label")
    return metrics.macro_f1(_clusters(spark, sf_dir), labels, pred="cluster").select(_r("macro_f1").alias("macro_f1"))


@query(f"WITH {CL} SELECT count(*) AS n, {R('avg(CASE WHEN label = cluster THEN 1.0 ELSE 0.0 END)')} AS overall, {R('avg(CASE WHEN label = cluster THEN 1.0 ELSE 0.0 END) FILTER (label < 5)')} AS old_acc, {R('avg(CASE WHEN label = cluster THEN 1.0 ELSE 0.0 END) FILTER (label >= 5)')} AS new_acc, {R('avg(CASE WHEN label = cluster THEN 1.0 ELSE 0.0 END) FILTER (label < 3)')} AS initial_acc, {R('0.9 - avg(CASE WHEN label = cluster THEN 1.0 ELSE 0.0 END) FILTER (label < 3)')} AS forgetting FROM c WHERE label < 8")
def stage_accuracy(spark, sf_dir):
    t = metrics.stage_accuracy(_clusters(spark, sf_dir), 5, 8, 3, 0.9, pred="cluster")
    return t.select("n", *[_r(c).alias(c) for c in t.columns if c != "n"])


@query(f"WITH {CL} SELECT count(DISTINCT cluster) FILTER (cluster <> -1) AS clusters, {R('avg(CASE WHEN cluster = -1 THEN 1.0 ELSE 0.0 END)')} AS noise FROM c")
def clustering_summary(spark, sf_dir):
    return metrics.summary(materialize(_clusters(spark, sf_dir), "clusters")).select("clusters", _r("noise").alias("noise"))


def _three_views(spark, sf_dir):
    return _clusters(spark, sf_dir).select("id", "label", "cluster", F.slice("v", 1, 32).alias("deep"), F.slice("v", 33, 16).alias("rf"), F.slice("v", 49, 16).alias("graph"))


VIEWS3 = f"{CL}, x AS (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM c WHERE cluster <> -1), xm AS (SELECT cluster, i, avg(x) AS x FROM x GROUP BY cluster, i), m AS (SELECT cluster, list(x ORDER BY i) AS v FROM xm GROUP BY cluster), sg AS (SELECT median(d) AS s FROM (SELECT list_distance(a.v[33:48], b.v[33:48]) AS d FROM m a, m b WHERE a.cluster <> b.cluster) WHERE d > 0)"
SIM = lambda a, b: f"0.5 * (list_inner_product({a}[1:32], {b}[1:32]) / ((sqrt(list_inner_product({a}[1:32], {a}[1:32])) + 1e-8) * (sqrt(list_inner_product({b}[1:32], {b}[1:32])) + 1e-8)) + 1) / 2 + 0.1 * exp(-pow(list_distance({a}[33:48], {b}[33:48]), 2) / (2 * s * s + 1e-8)) + 0.4 * (list_inner_product({a}[49:64], {b}[49:64]) / ((sqrt(list_inner_product({a}[49:64], {a}[49:64])) + 1e-8) * (sqrt(list_inner_product({b}[49:64], {b}[49:64])) + 1e-8)) + 1) / 2"


@query(f"WITH {VIEWS3}, p AS (SELECT a.cluster AS a, b.cluster AS b, {SIM('a.v', 'b.v')} AS w FROM m a, m b, sg WHERE a.cluster <> b.cluster), n AS (SELECT a, b, w FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, b) = 1) SELECT x.a, x.b, {R('x.w')} AS w FROM n x JOIN n y ON x.b = y.a AND y.b = x.a WHERE x.a < x.b AND x.w >= 0.4")
def mutual_nearest_pairs(spark, sf_dir):
    names, s = consolidate.similarity(consolidate.prototypes(_three_views(spark, sf_dir)), consolidate.Weights())
    at = {c: k for k, c in enumerate(names)}
    rows = [(int(a), int(b), float(s[at[a], at[b]])) for a, b in consolidate.mutual_pairs(names, s, 0.4)]
    return spark.createDataFrame(rows, "a bigint, b bigint, w double").select("a", "b", _r("w").alias("w"))


@query(f"WITH {VIEWS3}, p AS (SELECT c.id, m.cluster, {SIM('c.v', 'm.v')} AS w FROM c, m, sg WHERE c.cluster = -1), n AS (SELECT id, cluster FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, cluster) = 1) SELECT c.id, coalesce(n.cluster, c.cluster) AS cluster FROM c LEFT JOIN n ON c.id = n.id")
def noise_assignment(spark, sf_dir):
    return consolidate.assign_noise(_three_views(spark, sf_dir)).select("id", "cluster")


def _merge_sql(threshold: float, rounds: int, w: str, accepted: str = "") -> str:
    """Rounds of merging mutually nearest clusters of c0 (id, cluster, v), with means taken anew; the last is c{rounds}."""
    out = []
    for k in range(rounds):
        out += [
            f"x{k} AS (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM c{k} WHERE cluster <> -1)",
            f"m{k} AS MATERIALIZED (SELECT cluster, list(x ORDER BY i) AS v FROM (SELECT cluster, i, avg(x) AS x FROM x{k} GROUP BY cluster, i) GROUP BY cluster)", f"u{k} AS (SELECT * FROM m{k} {accepted})",
            f"sg{k} AS (SELECT coalesce(median(d) FILTER (d > 0), 1.0) AS s FROM (SELECT list_distance(a.v[33:48], b.v[33:48]) AS d FROM u{k} a, u{k} b))",
            f"p{k} AS (SELECT a.cluster AS a, b.cluster AS b, {w} AS w FROM u{k} a, u{k} b, sg{k} WHERE a.cluster <> b.cluster)",
            f"n{k} AS (SELECT a, b, w FROM p{k} QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, b) = 1)",
            f"q{k} AS (SELECT x.a, x.b FROM n{k} x JOIN n{k} y ON x.b = y.a AND y.b = x.a WHERE x.a < x.b AND x.w >= {threshold})",
            f"d{k} AS (SELECT cluster, dense_rank() OVER (ORDER BY coalesce(q.a, cluster)) - 1 AS now FROM m{k} LEFT JOIN q{k} q ON cluster = q.b)",
            f"c{k + 1} AS MATERIALIZED (SELECT id, CAST(coalesce(now, c.cluster) AS BIGINT) AS cluster, v FROM c{k} c LEFT JOIN d{k} USING (cluster))",
        ]
    return f"{CL}, c0 AS (SELECT id, cluster, v FROM c), {', '.join(out)}"


GEOMETRIC = "sqrt((list_inner_product(a.v[49:64], b.v[49:64]) / ((sqrt(list_inner_product(a.v[49:64], a.v[49:64])) + 1e-8) * (sqrt(list_inner_product(b.v[49:64], b.v[49:64])) + 1e-8)) + 1) / 2 * exp(-pow(list_distance(a.v[33:48], b.v[33:48]), 2) / (2 * s * s + 1e-8)))"


@query(f"WITH {_merge_sql(0.3, 7, SIM('a.v', 'b.v'))} SELECT id, cluster FROM c7")
def iterative_merge(spark, sf_dir):
    return consolidate.iterative_merge(_three_views(spark, sf_dir), 0.3).select("id", "cluster")


@query()
def adaptive_split(spark, sf_dir):
    return consolidate.adaptive_split(_three_views(spark, sf_dir).withColumn("cluster", F.when(F.col("cluster") < 4, F.lit(0)).otherwise(F.col("cluster")).cast("bigint")), quality=0.0).select("id", "cluster")


@query("SELECT vec_id AS id, CASE WHEN vec_id % 6 = (SELECT min(vec_id) FROM embeddings WHERE vec_id % 6 < 2) % 6 THEN 0 WHEN vec_id % 6 < 2 THEN 6 ELSE vec_id % 6 END AS cluster FROM embeddings")
def split_of_planted_classes(spark, sf_dir):
    """Six classes planted in every view, two of them given as one cluster, which is found to be two."""
    df = _vectors(spark, sf_dir).withColumn("g", F.col("id") % 6)
    at = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: (k == F.col("g")).cast("double"))
    planted = F.concat(at, F.transform("v", lambda x: x * 0.05))
    rows = df.select("id", *[planted.alias(v) for v in consolidate.VIEWS], F.when(F.col("g") < 2, F.lit(0)).otherwise(F.col("g")).cast("bigint").alias("cluster"))
    return consolidate.adaptive_split(rows).select("id", "cluster")


SCALED = lambda v: f"list_transform({v}, lambda z: z / (sqrt(list_inner_product({v}, {v})) + 1e-8))"


def _planted(df, classes, spread):
    """A vector for each row: the class id % classes, one-hot, with some of the row's own vector beside it in the same places."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (k == F.col("id") % classes).cast("double") + spread * F.get("v", k))


PLANTED = "g AS (SELECT id, id % {n} AS g, list_transform(range(0, {n}), lambda k: CASE WHEN k = id % {n} THEN 1.0 ELSE 0.0 END + {s} * v[k + 1]) AS x FROM e)"


@query(f"WITH {E}, {PLANTED.format(n=4, s=0.1)}, u AS (SELECT g, {SCALED('x')} AS x FROM g), m AS (SELECT g, i, avg(x) AS m, count(*) AS n FROM (SELECT g, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM u) GROUP BY g, i), k AS (SELECT g, max(n) AS n, list(m ORDER BY i) AS m FROM m GROUP BY g) SELECT g // 2 AS label, n, {R('m[1] / (sqrt(list_inner_product(m, m)) + 1e-8)')} AS a, {R('m[2] / (sqrt(list_inner_product(m, m)) + 1e-8)')} AS b, {R('m[3] / (sqrt(list_inner_product(m, m)) + 1e-8)')} AS c, {R('m[4] / (sqrt(list_inner_product(m, m)) + 1e-8)')} AS d FROM k")
def kmeans_prototypes(spark, sf_dir):
    """Classes of two modes each, which K-means gives a prototype each."""
    df = _vectors(spark, sf_dir)
    rows = vectors.unit(df.select(F.floor(F.col("id") % 4 / 2).cast("bigint").alias("label"), _planted(df, 4, 0.1).alias("v")), "v")
    found = prototypes.make_prototypes(rows, prototypes_per_class=2)
    return found.select("label", "n", *[_r(F.get("v", F.lit(k))).alias(c) for k, c in enumerate("abcd")])


@query("SELECT 'MV-ACC' AS method, 'Round 1' AS round, count(*) AS samples, CAST(3 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS count_error, 1.0 AS over_clustering, 0.0 AS noise, 1.0 AS purity, 1.0 AS nmi, 1.0 AS ari, 1.0 AS hungarian FROM embeddings")
def discovery_of_planted_classes(spark, sf_dir):
    """A whole round of discovery over three classes planted in both views."""
    from vexilar.plans import methods

    df = _vectors(spark, sf_dir)
    rows = materialize(df.select("id", _planted(df, 3, 0.05).alias("deep"), _planted(df, 3, 0.04).alias("rf"), (F.col("id") % 3).alias("label")), "planted")
    report = methods.run_discovery("MV-ACC", rows.select("id", "deep", "rf"), None, rows.select("id", "label"), "Round 1", 3).report
    scores = [_r(c).alias(c) for c in ("over_clustering", "noise", "purity", "nmi", "ari", "hungarian")]
    return report.select("method", "round", "samples", "clusters", "count_error", *scores)


CLOSURE = "h AS (SELECT a, b FROM g UNION SELECT b, a FROM g), r AS (SELECT a, b FROM h UNION SELECT r.a, h.b FROM r JOIN h ON r.b = h.a)"


@query(f"WITH RECURSIVE {E}, {_near('e', 'n', 1, COS, False)}, g AS (SELECT src AS a, dst AS b FROM n), {CLOSURE} SELECT a AS node, min(b) AS component FROM r GROUP BY a")
def merged_components(spark, sf_dir):
    """Every row's component over the links to nearest rows."""
    return components.connected_components(knn.top_k(_vectors(spark, sf_dir).select("id", "v"), 1, include_self=False).select("src", "dst"))


@query(f"WITH RECURSIVE {E}, {_near('e', 'n', 5, COS, False)}, g AS (SELECT x.src AS a, x.dst AS b FROM n x JOIN n y ON x.src = y.dst AND x.dst = y.src), {CLOSURE} SELECT id AS node, least(id, coalesce(min(b), id)) AS component FROM e LEFT JOIN r ON a = id GROUP BY id")
def neighbour_components(spark, sf_dir):
    """Every row's component over mutual links among its five nearest; rows without one are their own."""
    df = _vectors(spark, sf_dir).select("id", "v")
    near = materialize(knn.top_k(df, 5, include_self=False).select("src", "dst"), "near")
    links = near.join(near.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"])
    found = components.connected_components(links)
    return df.select(F.col("id").alias("node")).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


@query()
def hdbscan_clusters(spark, sf_dir):
    return density.density_clusters(_vectors(spark, sf_dir), "v", 5, 3)


@query()
def spectral_embedding(spark, sf_dir):
    return spectral.spectral_of(graph.cosine_graph(_vectors(spark, sf_dir), 20), 16).select("id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@query("SELECT c, 0.0 AS residual, 0.0 AS off FROM (SELECT unnest(range(least(16, count(*) - 2))) AS c FROM embeddings)")
def spectral_residuals(spark, sf_dir):
    """For each column of the embedding: how far it is from an eigenvector, and from being orthogonal to the others and of length 1."""
    edges = materialize(graph.cosine_graph(_vectors(spark, sf_dir), 20), "residual_edges")
    found = materialize(spectral.spectral_of(edges, 16), "residual_rows")
    off = edges.where("src <> dst and w <> 0")
    degree = off.groupBy("src").agg(F.sum("w").alias("d"))
    columns = found.agg(F.max(F.size("v"))).first()[0]
    at = found.join(degree, found["id"] == degree["src"]).select("id", "d", F.posexplode("v").alias("c", "y"))
    sums = [F.sum(F.col("w") * F.get("v", F.lit(c))).alias(f"z{c}") for c in range(columns)]  # an edge is shuffled once, not once a column
    image = off.join(found.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(*sums)
    image = image.select("id", F.posexplode(F.array(*[f"z{c}" for c in range(columns)])).alias("c", "z"))
    both = materialize(at.join(image, ["id", "c"]), "images")  # W y = value D y
    value = both.groupBy("c").agg((F.sum(F.col("y") * F.col("z")) / F.sum(F.col("d") * F.col("y") * F.col("y"))).alias("value"))
    residual = both.join(value, "c").groupBy("c").agg(F.sqrt(F.sum(F.pow(F.col("z") - F.col("value") * F.col("d") * F.col("y"), 2) / F.col("d"))).alias("residual"))
    other = at.select("id", F.col("c").alias("c2"), F.col("y").alias("y2"))
    dots = at.join(other, "id").groupBy("c", "c2").agg(F.sum(F.col("d") * F.col("y") * F.col("y2")).alias("p"))
    straight = dots.groupBy("c").agg(F.max(F.abs(F.col("p") - (F.col("c") == F.col("c2")).cast("double"))).alias("off"))
    return residual.join(straight, "c").select(F.col("c").cast("bigint").alias("c"), _r("residual").alias("residual"), _r("off").alias("off"))


@query()
def projection_2d(spark, sf_dir):
    return cluster.project_groups(_vectors(spark, sf_dir).withColumn("g", F.lit(0)), ["g"]).select("id", _r("x", 6).alias("x"), _r("y", 6).alias("y"))


@query(f"WITH {E}, r AS (SELECT id // 10 AS rec, {CLUSTER} AS pred FROM e), n AS (SELECT rec, pred, count(*) AS n FROM r GROUP BY ALL) SELECT CAST(rec AS BIGINT) AS recording_id, CAST(pred AS BIGINT) AS pred FROM n QUALIFY row_number() OVER (PARTITION BY rec ORDER BY n DESC, pred) = 1")
def recording_vote(spark, sf_dir):
    df = _clusters(spark, sf_dir).select(F.floor(F.col("id") / 10).alias("recording_id"), F.col("cluster").alias("pred"))
    return recordings.vote(df)


@query(f"WITH {E}, p AS (SELECT id // 10 AS rec, id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), m AS (SELECT rec, i, avg(x) AS x, count(*) AS n FROM p GROUP BY rec, i) SELECT e.id, n, {R('x')} AS first FROM e JOIN m ON e.id // 10 = rec AND i = 1")
def recording_means(spark, sf_dir):
    df = _vectors(spark, sf_dir).withColumn("recording_id", F.floor(F.col("id") / 10))
    means = recordings.aggregate_recordings(df, ["v"])
    return recordings.propagate(df.select("id", "recording_id"), means).select("id", "n", _r(F.get("v", F.lit(0))).alias("first"))


@query(f"WITH {_merge_sql(0.3, 1, GEOMETRIC, 'WHERE cluster < 5')} SELECT id, cluster FROM c1")
def accepted_merge(spark, sf_dir):
    return consolidate.merge_accepted(_three_views(spark, sf_dir), [0, 1, 2, 3, 4], 0.3).select("id", "cluster")


@query()
def second_look(spark, sf_dir):
    df = _three_views(spark, sf_dir).withColumn("probability", F.lit(1.0))
    return consolidate.recluster(df, [0, 1, 2], consolidate.Recluster(5, 2, 5, 0.5))[0].select("id", "cluster")


@query()
def learner_comparison(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    part = lambda a, b: df.where(F.col("label").between(a, b) & (F.col("id") % 4 != 0))
    return baselines.compare(part(0, 5), [part(6, 7), part(8, 9)], df.where("id % 4 = 0"))


# ---- signal features ----


def _iq(spark, sf_dir):
    return _vectors(spark, sf_dir).select("id", "label", F.slice("v", 1, 32).alias("i"), F.slice("v", 33, 32).alias("q"))


IQ = f"{E}, r AS (SELECT id, v[1:32] AS i, v[33:64] AS q FROM e)"


@query(f"WITH {IQ}, a AS (SELECT id, list_transform(range(1, 33), lambda k: sqrt(i[k] * i[k] + q[k] * q[k] + 1e-8)) AS a FROM r), b AS (SELECT id, a, list_avg(a) AS m, list_avg(list_transform(a, lambda x: x * x)) AS p FROM a), c AS (SELECT *, sqrt(list_avg(list_transform(a, lambda x: (x - m) * (x - m)))) AS s FROM b) SELECT id, {R('m')} AS amp_mean, {R('s')} AS amp_std, {R('list_max(a)')} AS amp_max, {R('list_min(a)')} AS amp_min, {R('sqrt(p + 1e-8)')} AS amp_rms, {R('pow(list_max(a), 2) / (p + 1e-8)')} AS papr, {R('list_avg(list_transform(a, lambda x: pow((x - m) / (s + 1e-8), 3)))')} AS amp_skew, {R('list_avg(list_transform(a, lambda x: pow((x - m) / (s + 1e-8), 4)))')} AS amp_kurtosis FROM c")
def rf_amplitude_features(spark, sf_dir):
    names = list(rf.VIEWS["amplitude_8d"])
    return rf.amplitude_expressions(_iq(spark, sf_dir)).select("id", *[_r(n).alias(n) for n in names])


@query(f"WITH {IQ}, a AS (SELECT id, i, q, list_avg(i) AS im, list_avg(q) AS qm, list_avg(list_transform(i, lambda x: x * x)) AS ip, list_avg(list_transform(q, lambda x: x * x)) AS qp FROM r), b AS (SELECT *, sqrt(list_avg(list_transform(i, lambda x: (x - im) * (x - im)))) AS sd_i, sqrt(list_avg(list_transform(q, lambda x: (x - qm) * (x - qm)))) AS sd_q, list_avg(list_transform(range(1, 33), lambda k: (i[k] - im) * (q[k] - qm))) AS cv FROM a) SELECT id, {R('ip')} AS i_power, {R('qp')} AS q_power, {R('ip / (qp + 1e-8)')} AS iq_power_ratio, {R('abs(ip - qp)')} AS iq_power_diff, {R('im')} AS i_mean, {R('qm')} AS q_mean, {R('sd_i')} AS i_std, {R('sd_q')} AS q_std, {R('cv / (sd_i * sd_q + 1e-8)')} AS iq_corr FROM b")
def rf_balance_features(spark, sf_dir):
    return rf.balance_expressions(_iq(spark, sf_dir)).select("id", *[_r(n).alias(n) for n in rf.VIEWS["iq_imbalance_9d"]])


ALL_FEATURES = [*rf.VIEWS["all48_extended"], *rf.VIEWS["all37d"]]


@query(f"WITH {IQ}, {signal_sql.STEPS} {signal_sql.features(ALL_FEATURES)}")
def rf_all_views(spark, sf_dir):
    df, views = _iq(spark, sf_dir), ("all48_extended", "all37d")
    found = df.select("id", *[registry.feature(v)("i", "q").alias(v) for v in views])
    return found.select("id", *[_r(F.get(v, F.lit(k)), 5).alias(n) for v in views for k, n in enumerate(rf.VIEWS[v])])


@query(f"WITH {IQ}, p AS (SELECT id, i, q, sqrt(greatest(list_avg(list_transform(range(1, 33), lambda k: i[k] * i[k] + q[k] * q[k])), 1e-12)) AS e FROM r) SELECT id, {R('list_sum(i) / e')} AS i_sum, {R('list_sum(q) / e')} AS q_sum FROM p")
def rms_normalised(spark, sf_dir):
    return rf.rms_normalize(_iq(spark, sf_dir)).select("id", _r(vectors.total(F.col("i"))).alias("i_sum"), _r(vectors.total(F.col("q"))).alias("q_sum"))


@query(f"WITH {IQ}, w AS (SELECT id, unnest(range(0, 4)) AS k, i FROM r) SELECT id, k AS \"window\", {R('list_sum(i[k * 8 + 1:k * 8 + 8])')} AS total FROM w")
def strided_windows(spark, sf_dir):
    return rf.windows(_iq(spark, sf_dir), ["i", "q"], 8, 8).select("id", "window", _r(vectors.total(F.col("i"))).alias("total"))


@query(f"WITH {E} SELECT id, {R('v[11] - v[10]')} AS step, {R('v[64]')} AS first_of_rotated, {R('list_sum(v[1:20])')} AS running_20, list_position(v, list_max(v)) - 1 AS top FROM e")
def array_operators(spark, sf_dir):
    df, v = _vectors(spark, sf_dir), F.col("v")
    return df.select(
        "id", _r(F.get(registry.differences(v), F.lit(9))).alias("step"), _r(F.get(registry.rotate(v, 1), F.lit(0))).alias("first_of_rotated"),
        _r(F.get(registry.running_sum(F.slice(v, 1, 20)), F.lit(19))).alias("running_20"), registry.argmax("v").alias("top"),
    )


# ---- splits, samples, audits ----


@query("SELECT l_orderkey, l_linenumber, CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= floor(0.7 * count(*) OVER (PARTITION BY l_orderkey)) THEN 'train' ELSE 'eval' END AS split FROM lineitem")
def order_block_split(spark, sf_dir):
    return splits.order_block(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber"])


@query("WITH g AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT event_id, CASE WHEN r <= floor(n * 0.6 + 1e-9) THEN 'train' WHEN r <= floor(n * 0.7 + 1e-9) THEN 'val' ELSE 'eval' END AS split FROM g")
def block_split_60_10_30(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return splits.blocks(df, ["user_id"], ["ts", "event_id"], {"train": 0.6, "val": 0.1, "eval": 0.3}).select("event_id", "split")


DRAWN = lambda i, seed=7: f"md5('{seed}:' || CAST({i} AS VARCHAR)), {i}"


@query(f"SELECT event_id, event_type, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY {DRAWN('event_id')}) <= floor(0.7 * count(*) OVER (PARTITION BY event_type)) THEN 'train' ELSE 'eval' END AS split FROM events")
def seeded_split(spark, sf_dir):
    return splits.seeded(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_type"], "event_id")


@query(f"WITH {E}, g AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {DRAWN('id')}) AS r, count(*) OVER (PARTITION BY label) AS n FROM e) SELECT id, label, CASE WHEN r <= least(greatest(round_even(n / 7, 0), 1), n - 1) THEN 'val' ELSE 'train' END AS split FROM g")
def stratified_split(spark, sf_dir):
    return splits.stratified(_vectors(spark, sf_dir).select("id", "label"), "label", "id")


@query(f"WITH g AS (SELECT CAST(o_orderkey AS BIGINT) AS id, o_custkey, o_orderpriority, round(0.7 * count(*) OVER (PARTITION BY o_custkey)) FROM orders), h AS (SELECT o_custkey, id, row_number() OVER w AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM g WINDOW w AS (PARTITION BY o_custkey ORDER BY id)) SELECT id, CASE WHEN r <= least(greatest(round_even(0.7 * n, 0), 1), n - 1) THEN 'train' ELSE 'eval' END AS split FROM h")
def rounded_block_split(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("id"), "o_custkey")
    return splits.order_block(df, ["o_custkey"], ["id"], rounding="round").select("id", "split")


@query(f"WITH l AS (SELECT DISTINCT o_custkey FROM orders) SELECT CAST(o_custkey AS BIGINT) AS o_custkey FROM l ORDER BY {DRAWN('o_custkey')} LIMIT 40")
def chosen_classes(spark, sf_dir):
    return splits.choose_classes(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("bigint").alias("o_custkey")), "o_custkey", 40)


@query(f"WITH {E}, g AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {DRAWN('id')}) AS r FROM e) SELECT id, label FROM g WHERE r <= 20")
def replay_memory_rows(spark, sf_dir):
    df = _vectors(spark, sf_dir).select("id", "label")
    return prototypes.replay_memory(df.where("id % 2 = 0"), df.where("id % 2 = 1"))


@query("WITH d AS (SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders) SELECT o_orderstatus, o_orderkey FROM d QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def head_n_per_group(spark, sf_dir):
    return splits.head(table(spark, sf_dir, "orders"), ["o_orderstatus"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_orderstatus", "o_orderkey")


@query("WITH r AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), q AS (SELECT l_suppkey, min(n) AS least_n FROM r GROUP BY l_suppkey HAVING count(*) = (SELECT count(DISTINCT l_returnflag) FROM lineitem) AND min(n) >= 10) SELECT l_suppkey, least_n FROM q ORDER BY l_suppkey LIMIT 40")
def min_count_eligibility(spark, sf_dir):
    return splits.eligible(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag"), "l_suppkey", "l_returnflag", 10, 40)


@query("SELECT event_type FROM (SELECT event_type, extract('hour' FROM ts) AS h FROM events) GROUP BY event_type HAVING count(DISTINCT h) = (SELECT count(DISTINCT extract('hour' FROM ts)) FROM events)")
def relational_division(spark, sf_dir):
    return splits.common_to_all(table(spark, sf_dir, "events").select("event_type", F.hour("ts").alias("h")), "event_type", "h")


@query("SELECT 'novel' AS kind, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'known', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_anti_ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    part = lambda how, kind: c.join(o, "c_custkey", how).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return part("left_anti", "novel").union(part("left_semi", "known"))


@query("SELECT CAST(n_regionkey AS BIGINT) AS key FROM nation INTERSECT SELECT CAST(r_regionkey AS BIGINT) FROM region WHERE r_regionkey > 0 EXCEPT SELECT CAST(3 AS BIGINT)")
def set_operations(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("bigint").alias("key"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("key"))
    return n.intersect(r.where("key > 0")).subtract(spark.range(3, 4).withColumnRenamed("id", "key"))


@query("SELECT (SELECT count(*) FROM documents) AS left_rows, (SELECT count(*) FROM benchmark) AS right_rows, (SELECT count(*) FROM (SELECT DISTINCT sha256(text) AS d FROM documents INTERSECT SELECT sha256(text) FROM benchmark)) AS overlap")
def content_hash_overlap_audit(spark, sf_dir):
    return splits.content_overlap(table(spark, sf_dir, "documents").select("text"), table(spark, sf_dir, "benchmark").select("text"), "text")


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS dense FROM part")
def dense_label_remap(spark, sf_dir):
    return splits.dense_labels(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", F.col("dense").cast("bigint").alias("dense"))


@query(f"SELECT doc_id, toxic, {R('1 / count(*) OVER (PARTITION BY toxic)', 9)} AS weight FROM labels")
def class_balanced_weights(spark, sf_dir):
    return splits.class_weights(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic").select("doc_id", "toxic", _r("weight", 9).alias("weight"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def confusion_counts(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


PROTOCOL = f"{E}, s AS (SELECT id, label, CASE WHEN label < 4 THEN 0 ELSE CAST(floor((label - 4) / 2) AS BIGINT) + 1 END AS g, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY id) <= floor(0.7 * count(*) OVER (PARTITION BY label)) THEN 'train' ELSE 'eval' END AS split FROM e)"


@query(f"WITH {PROTOCOL}, x AS (SELECT id, CASE WHEN g = 0 THEN 'day1_known_train' ELSE 'day' || (g + 1) || '_unknown_round' || g END AS stage FROM s WHERE split = 'train' UNION ALL SELECT id, 'day1_initial_eval' FROM s WHERE split = 'eval' AND g = 0 UNION ALL SELECT id, 'day' || (k + 1) || '_eval_after_r' || k FROM s, range(1, 4) t(k) WHERE split = 'eval' AND k >= g) SELECT stage, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM x GROUP BY stage")
def staged_protocol(spark, sf_dir):
    df = splits.order_block(_vectors(spark, sf_dir).select("id", "label"), ["label"], ["id"])
    return splits.protocol(df, 4, 2, 3).groupBy("stage").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


# ---- reports ----


@query(f"SELECT o_orderpriority, o_orderstatus, {R('avg(o_totalprice)', 3)} AS o_totalprice_mean, {R('stddev_samp(o_totalprice)', 3)} AS o_totalprice_std FROM orders GROUP BY ALL")
def grouped_mean_std(spark, sf_dir):
    df = reports.mean_std(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], ["o_totalprice"])
    return df.select("o_orderpriority", "o_orderstatus", *[_r(c, 3).alias(c) for c in ("o_totalprice_mean", "o_totalprice_std")])


TYPES = ("click", "view", "purchase")


@query(f"WITH p AS (SELECT user_id, {', '.join(f'avg(value) FILTER (event_type = ' + chr(39) + t + chr(39) + f') AS {t}' for t in TYPES)} FROM events GROUP BY user_id) SELECT user_id, {', '.join(f'{R(t)} AS {t}' for t in TYPES)}, {R('list_avg(list_filter([' + ', '.join(TYPES) + '], lambda x: x IS NOT NULL))')} AS mean FROM p")
def pivot_by_type(spark, sf_dir):
    df = reports.pivot_rounds(table(spark, sf_dir, "events").select("user_id", "event_type", "value"), ["user_id"], "event_type", list(TYPES), "value")
    return df.select("user_id", *[_r(c).alias(c) for c in (*TYPES, "mean")])


@query("WITH i AS (SELECT o_custkey % 5 AS method, 'After R' || (1 + o_orderkey % 3) AS stage, o_orderkey FROM orders), c AS (SELECT DISTINCT o_custkey % 4 AS method, 1 + o_orderkey % 2 AS round, '0.25' AS noise FROM orders) SELECT i.method, stage, o_orderkey, 1 - CAST(noise AS DOUBLE) AS coverage FROM i LEFT JOIN c ON i.method = c.method AND CAST(substr(stage, 8) AS BIGINT) = c.round")
def left_join_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    inc = o.select((F.col("o_custkey") % 5).alias("method"), F.concat(F.lit("After R"), (1 + F.col("o_orderkey") % 3).cast("string")).alias("stage"), "o_orderkey")
    clu = o.select((F.col("o_custkey") % 4).alias("method"), (1 + F.col("o_orderkey") % 2).cast("int").alias("round"), F.lit("0.25").alias("noise")).distinct()
    return reports.per_round_summary(inc, clu).select("method", "stage", "o_orderkey", "coverage")


@query("WITH p AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 99 END AS place FROM orders) SELECT o_orderkey, place, row_number() OVER (ORDER BY place, o_orderkey) AS position FROM p")
def custom_sort(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", reports.mapped(F.col("o_orderpriority"), {"1-URGENT": 0, "2-HIGH": 1}, 99).alias("place"))
    return running(df, [], ["place", "o_orderkey"], position=F.lit(1).cast("bigint"))


@query(f"SELECT event_id, {R('TRY_CAST(CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) WHEN event_id % 3 = 1 THEN ' + chr(39) + '-' + chr(39) + ' ELSE ' + chr(39) + '0.5' + chr(39) + ' END AS DOUBLE)')} AS value FROM events")
def try_cast_coerce(spark, sf_dir):
    c = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, F.lit("-")).otherwise(F.lit("0.5"))
    return table(spark, sf_dir, "events").select("event_id", c.alias("c")).select("event_id", _r(F.expr("try_cast(c as double)")).alias("value"))


@query("SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS nation, NULL::BIGINT AS region FROM nation UNION ALL SELECT r_name, NULL, CAST(r_regionkey AS BIGINT) FROM region")
def union_by_name(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("nation"))
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("bigint").alias("region"))
    return reports.union_rows(n, r)


@query("WITH a AS (SELECT DISTINCT l_returnflag FROM lineitem), b AS (SELECT DISTINCT l_linestatus FROM lineitem), c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, coalesce(n, 0) AS n, coalesce(n, 0) >= 120 AS valid, coalesce(n, 0) = 0 AS empty FROM a CROSS JOIN b LEFT JOIN c USING (l_returnflag, l_linestatus)")
def env_grid_counts(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus")
    return reports.cell_grid(df, [df.select("l_returnflag").distinct(), df.select("l_linestatus").distinct()], ["l_returnflag", "l_linestatus"], 120)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def best_row(spark, sf_dir):
    return reports.best_row(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT p_partkey, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '_') AS name, split_part(p_type, ' ', 1) AS kind FROM part")
def string_functions(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", registry.safe_name(F.col("p_name")).alias("name"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'reject' ELSE 'accept' END AS decision FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice BETWEEN 1000 AND 400000")
def predicates(spark, sf_dir):
    df = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1") & F.col("o_totalprice").between(1000, 400000))
    return df.select("o_orderkey", F.when(F.col("o_totalprice") >= 200000, "reject").otherwise("accept").alias("decision"))


# ---- events: differences, cumulative shares, windows ----


@query(f"SELECT event_id, {R('value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} AS step FROM events")
def per_user_first_diff(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", _r(F.col("value") - F.lag("value").over(w)).alias("step"))


@query("WITH c AS (SELECT event_type, event_id, row_number() OVER w AS r, sum(value) OVER w / sum(value) OVER (PARTITION BY event_type) AS share FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) SELECT event_type, min(r) AS rolloff FROM c WHERE share >= 0.9 GROUP BY event_type")
def cumulative_rolloff(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value")
    c = running(df, ["event_type"], ["ts", "event_id"], r=F.lit(1).cast("bigint"), upto=F.col("value"))
    total = df.groupBy("event_type").agg(F.sum("value").alias("total"))  # a row a type
    return c.join(total, "event_type").where(F.col("upto") / F.col("total") >= 0.9).groupBy("event_type").agg(F.min("r").alias("rolloff"))


@query(f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, {R('sum(value)', 4)} AS total FROM events GROUP BY ALL")
def window_tumbling(spark, sf_dir):
    return rounds.windowed_counts(table(spark, sf_dir, "events")).select("start", "event_type", "n", _r("total", 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM n GROUP BY user_id, k")
def user_sessions(spark, sf_dir):
    return rounds.sessions(table(spark, sf_dir, "events"))
