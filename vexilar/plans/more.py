"""Further queries: row operations, normalisations, complex columns, banks, memories and choices, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexilar.functions import registry, rf, vectors
from vexilar.models import networks, training
from vexilar.operators import consolidate, graph, prototypes, recordings, splits
from vexilar.operators.prefix import running
from vexilar.operators.quantiles import exact_quantiles
from vexilar.plans import discovery, methods, signal_sql
from vexilar.plans.queries import CL, E, HALVES, IQ, MEANS, R, _clusters, _cos_graph, _iq, _parts, _r, _sym, _two_views, _vectors, query
from vexilar.session import materialize, table

UNIT_OF = lambda v: f"list_transform({v}, lambda x: x / (sqrt(list_inner_product({v}, {v})) + 1e-8))"


# ---- rows ----


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 150000")
def half_open_range(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_totalprice >= 50000 and o_totalprice < 150000").select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, p_size FROM lineitem JOIN part ON l_partkey = p_partkey")
def index_lookup(spark, sf_dir):
    found = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(found, "l_partkey").select("l_orderkey", "l_linenumber", "p_size")


@query(f"WITH {CL} SELECT id, CASE cluster WHEN 2 THEN 20 WHEN 5 THEN 50 ELSE cluster END AS cluster FROM c")
def mapping_with_default(spark, sf_dir):
    return consolidate.rename(_clusters(spark, sf_dir).select("id", "cluster"), {2: 20, 5: 50}).select("id", "cluster")


@query("SELECT c_custkey AS key, 'customer' AS kind, 1 AS weight FROM customer UNION ALL SELECT s_suppkey, 'supplier', 1 FROM supplier")
def constant_fill(spark, sf_dir):
    part = lambda name, key, kind: table(spark, sf_dir, name).select(F.col(key).alias("key"), F.lit(kind).alias("kind"), F.lit(1).alias("weight"))
    return part("customer", "c_custkey", "customer").union(part("supplier", "s_suppkey", "supplier"))


@query(f"WITH {E} SELECT id, CASE WHEN label < 6 THEN 'known' ELSE 'unknown' END AS kind, CASE WHEN label < 6 THEN label ELSE label - 6 END AS local, CASE WHEN label < 6 THEN label ELSE label - 6 + 90 END AS label FROM e")
def label_offset(spark, sf_dir):
    return splits.known_unknown(_vectors(spark, sf_dir).select("id", "label"), 6, 90)


@query("SELECT event_id, user_id % 4 AS receiver, CASE WHEN user_id % 4 IN (1, 3) THEN 'eval' ELSE 'train' END AS split FROM events")
def disjoint_split(spark, sf_dir):
    return splits.held_out(table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("receiver")), "receiver", [1, 3])


@query("WITH e AS (SELECT DISTINCT vec_id, embedding, coalesce(vec_id % 3 = 0, false) AS l FROM embeddings) SELECT count(*) FILTER (l) AS left_rows, count(*) FILTER (NOT l) AS right_rows, (SELECT count(DISTINCT embedding) FROM e WHERE embedding IN (SELECT embedding FROM e WHERE l) AND embedding IN (SELECT embedding FROM e WHERE NOT l)) AS overlap FROM e")
def record_overlap_audit(spark, sf_dir):
    """Two splits that together hold every vector."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    left = F.coalesce(F.col("vec_id") % 3 == 0, F.lit(False))
    return splits.record_overlap(e.where(left), e.where(~left), "embedding")


@query(f"WITH {E}, {HALVES}, {_cos_graph('da', 'g')}, {_cos_graph('rb', 'h')}, j AS (SELECT src, dst, coalesce(g.w, 0) AS a, coalesce(h.w, 0) AS b FROM g FULL JOIN h USING (src, dst)), f AS (SELECT src, dst, 0.6 * a + 0.4 * b AS w FROM j), {_sym('f', 's')} SELECT src, dst, {R('w')} AS w FROM s")
def multiview_cosine_graph(spark, sf_dir):
    return graph.multiview_graph(_two_views(spark, sf_dir), "deep", "rf", alpha=0.6, kinds=("cosine", "cosine")).select("src", "dst", _r("w").alias("w"))


@query(f"WITH {CL}, n AS (SELECT cluster, count(*) AS n FROM c WHERE cluster <> -1 GROUP BY cluster) SELECT cluster, n, row_number() OVER (ORDER BY n DESC, cluster) AS place FROM n")
def clusters_by_size(spark, sf_dir):
    n = _clusters(spark, sf_dir).where("cluster <> -1").groupBy("cluster").agg(F.count("*").alias("n"))
    return running(n, [], [F.desc("n"), "cluster"], place=F.lit(1).cast("bigint"))


@query(f"SELECT event_type, {', '.join(f'{R(f'quantile_cont(value, {q})')} AS q{int(100 * q)}' for q in (0.1, 0.25, 0.5, 0.9, 0.99))} FROM events GROUP BY event_type")
def quantiles(spark, sf_dir):
    q = (0.1, 0.25, 0.5, 0.9, 0.99)
    found = exact_quantiles(table(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value", q)
    return found.groupBy("event_type").agg(*[_r(F.max(F.when(F.col("q") == x, F.col("value")))).alias(f"q{int(100 * x)}") for x in q])


@query(f"WITH a AS (SELECT user_id, value >= 50 AS act, lag(value >= 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, count(*) FILTER (act AND before) AS adjacent, {R('avg(CASE WHEN act <> before THEN 1.0 ELSE 0.0 END) FILTER (before IS NOT NULL)')} AS transitions FROM a GROUP BY user_id")
def adjacent_and_transitions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    act = F.col("value") >= 50
    rows = table(spark, sf_dir, "events").select("user_id", act.alias("act"), F.lag(act).over(w).alias("before"))
    return rows.groupBy("user_id").agg(F.count_if(F.col("act") & F.col("before")).alias("adjacent"), _r(F.avg(F.when(F.col("before").isNotNull(), (F.col("act") != F.col("before")).cast("double")))).alias("transitions"))


@query(f"WITH m AS (SELECT CAST(o_orderkey AS BIGINT) AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders WHERE o_orderpriority LIKE '1%'), r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events) SELECT event_id, k AS m_key FROM r JOIN m ON r.p % (SELECT count(*) FROM m) = m.p")
def cycling_join(spark, sf_dir):
    memory = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").cast("bigint").alias("key"))
    return splits.cycled(table(spark, sf_dir, "events").select("event_id"), memory, "event_id", "key")


# ---- vectors and signals ----

DIRTY = f"{E}, d AS (SELECT id, label, list_transform(range(1, 65), lambda k: CASE WHEN (id + k) % 50 = 0 THEN NULL ELSE v[k] * CASE WHEN k = 7 THEN 0 ELSE 1 END END) AS v FROM e)"


@query(f"WITH {DIRTY}, {_parts('v', 'd', 'dp')}, ds AS (SELECT i, avg(x) AS m, stddev_pop(x) AS sd FROM dp GROUP BY i), z AS (SELECT id, i, CASE WHEN x IS NULL THEN 0 ELSE (x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END END AS z FROM dp JOIN ds USING (i)) SELECT id, {R('sum(z)')} AS total, {R('sum(z * z)')} AS squares, count(*) FILTER (z = 0) AS zeros FROM z GROUP BY id")
def clean_scale(spark, sf_dir):
    v = F.transform("v", lambda x, k: F.when((F.col("id") + k + 1) % 50 == 0, F.lit(None)).otherwise(x * F.when(k == 6, 0.0).otherwise(1.0)))
    z = vectors.standardize(_vectors(spark, sf_dir).select("id", v.alias("v")), "v", unit_if_flat=True)
    return z.select("id", _r(vectors.total(F.col("v"))).alias("total"), _r(vectors.dot(F.col("v"), F.col("v"))).alias("squares"), F.size(F.filter("v", lambda x: x == 0)).cast("bigint").alias("zeros"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 0 ELSE value END AS value FROM events")
def finite_values(spark, sf_dir):
    x = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", vectors.clean(x).alias("value"))


@query(f"WITH {IQ}, m AS (SELECT id, i, q, list_avg(i) AS mi, list_avg(q) AS mq FROM r), s AS (SELECT *, sqrt(list_avg(list_transform(i, lambda x: pow(x - mi, 2)))) + 1e-8 AS si, sqrt(list_avg(list_transform(q, lambda x: pow(x - mq, 2)))) + 1e-8 AS sq, sqrt(greatest(list_avg(list_transform(range(1, 33), lambda k: i[k] * i[k] + q[k] * q[k])), 1e-12)) + 1e-6 AS e FROM m) SELECT id, {R('(i[1] - mi) / si')} AS i_first, {R('(q[32] - mq) / sq')} AS q_last, {R('i[1] / e')} AS i_rms FROM s")
def channel_normalised(spark, sf_dir):
    df = _iq(spark, sf_dir)
    z = rf.channel_zscore(df, "i", "q").select("id", _r(F.get("i", F.lit(0))).alias("i_first"), _r(F.get("q", F.lit(31))).alias("q_last"))
    return z.join(rf.rms_normalize(df, eps=1e-6).select("id", _r(F.get("i", F.lit(0))).alias("i_rms")), "id")


@query(f"WITH {E}, u AS (SELECT id, {UNIT_OF('v[1:32]')} AS a, {UNIT_OF('v[33:48]')} AS b, {UNIT_OF('v[49:64]')} AS c FROM e) SELECT id, {R('0.75 * list_sum(a) + 0.25 * list_sum(b) + list_sum(c)')} AS total, len(a) + len(b) + len(c) AS dims FROM u")
def weighted_concat(spark, sf_dir):
    df = _vectors(spark, sf_dir).select("id", F.slice("v", 1, 32).alias("a"), F.slice("v", 33, 16).alias("b"), F.slice("v", 49, 16).alias("c"))
    for v in "abc":
        df = vectors.unit(df, v)
    joined = F.concat(vectors.scale(F.col("a"), 0.75), vectors.scale(F.col("b"), 0.25), F.col("c"))
    return df.select("id", _r(vectors.total(joined)).alias("total"), F.size(joined).cast("bigint").alias("dims"))


@query(f"SELECT k, {R('cos(pi() * (t * t / 128 - t))')} AS i, {R('sin(pi() * (t * t / 128 - t))')} AS q FROM (SELECT range AS k, range * (128.0::DOUBLE / 1024) AS t FROM range(1024))")
def chirp_samples(spark, sf_dir):
    return rf.chirp_samples(spark, 1024).select("k", _r("i").alias("i"), _r("q").alias("q"))


@query(f"WITH {IQ}, {signal_sql.STEPS}, p AS (SELECT id, max(pw) AS peak, arg_max(k, pw) AS bin, sum(pw) AS power FROM ft GROUP BY id), t AS (SELECT id, sum(sqrt(p)) AS magnitude, sum(a0) AS angles FROM a GROUP BY id), s AS (SELECT id, sum(st) AS steps FROM ph GROUP BY id), w AS (SELECT id, sum(i * cos(0.3) - q * sin(0.3)) AS turned FROM a GROUP BY id) SELECT id, {R('peak')} AS peak, bin, {R('power')} AS power, {R('magnitude')} AS magnitude, {R('angles')} AS angles, {R('steps')} AS steps, {R('turned')} AS turned FROM p JOIN t USING (id) JOIN s USING (id) JOIN w USING (id)")
def complex_columns(spark, sf_dir):
    df, i, q = _iq(spark, sf_dir), F.col("i"), F.col("q")
    rows = df.select("id", registry.spectrum_power(i, q).alias("p"), registry.magnitude(i, q).alias("m"), registry.angle(i, q).alias("a"), registry.angle(*registry.step_product(i, q)).alias("s"), registry.turned(i, q, F.lit(0.3))[0].alias("t"))
    sums = {"power": "p", "magnitude": "m", "angles": "a", "steps": "s", "turned": "t"}
    return rows.select("id", _r(F.array_max("p")).alias("peak"), registry.argmax("p").cast("bigint").alias("bin"), *[_r(vectors.total(F.col(c))).alias(n) for n, c in sums.items()])


@query(f"WITH {E} SELECT id, list_position(v, list_sort(v[1:10])[1]) - 1 AS least, list_position(v, list_sort(v[1:10])[10]) - 1 AS most, {R('list_sum(v[1:4]) * list_sum(v[5:8])')} AS products FROM e")
def argsort_and_outer(spark, sf_dir):
    v = F.col("v")
    order = registry.argsort(F.slice(v, 1, 10))
    return _vectors(spark, sf_dir).select("id", F.get(order, F.lit(0)).cast("bigint").alias("least"), F.get(order, F.lit(9)).cast("bigint").alias("most"), _r(vectors.total(registry.outer(F.slice(v, 1, 4), F.slice(v, 5, 4)))).alias("products"))


@query(f"WITH {IQ}, {signal_sql.STEPS} SELECT id, {R(' + '.join(n for n in rf.VIEWS['all24_base'] if n not in rf.VIEWS['iq_imbalance_9d']), 5)} AS total, 15 AS dims FROM ti JOIN hw USING (id) JOIN sp USING (id)")
def feature_set_without_iq(spark, sf_dir):
    found = methods.feature_set(_iq(spark, sf_dir), "no_iq")
    return found.select("id", _r(vectors.total(F.col("rf")), 5).alias("total"), F.size("rf").alias("dims"))


SELECTABLE = ("amplitude_8d", "phase_frequency_4d", "iq_imbalance_9d", "spectral_3d", "all24_base", "all48_extended")


def _purity_sql() -> str:
    """Neighbour purity (k = 10, standardised columns) of each named view of the signal features."""
    out = [f"WITH {IQ}, {signal_sql.STEPS}, fe AS (SELECT r.id, label, ti.*, hw.*, sp.* FROM r JOIN e USING (id) JOIN ti USING (id) JOIN hw USING (id) JOIN sp USING (id))"]
    for k, (name, of) in enumerate((n, rf.VIEWS[n]) for n in SELECTABLE):
        out.append(f"w{k} AS (SELECT id, label, [{', '.join(of)}] AS v FROM fe)")
        out.append(f"{_parts('v', f'w{k}', f'wp{k}')}, ws{k} AS (SELECT i, avg(x) AS m, stddev_pop(x) AS sd FROM wp{k} GROUP BY i), wz{k} AS MATERIALIZED (SELECT id, label, list((x - m) / (sd + 1e-6) ORDER BY i) AS v FROM wp{k} JOIN ws{k} USING (i) GROUP BY id, label)")
        out.append(f"wn{k} AS (SELECT a.id, a.label = b.label AS hit FROM wz{k} a, wz{k} b WHERE a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) <= 10)")
        out.append(f"wq{k} AS (SELECT '{name}' AS view, avg(CAST(hit AS INT)) AS purity FROM wn{k})")
    every = " UNION ALL ".join(f"SELECT {k} AS place, * FROM wq{k}" for k in range(len(SELECTABLE)))
    return ", ".join(out) + f", pu AS ({every}) SELECT view, {R('purity')} AS purity, place = (SELECT place FROM pu ORDER BY purity DESC, place LIMIT 1) AND purity >= 0.8 OR view = 'all24_base' AND (SELECT max(purity) FROM pu) < 0.8 AS chosen FROM pu"




@query(_purity_sql())
def selected_view(spark, sf_dir):
    chosen, found, _ = discovery.select_view(_iq(spark, sf_dir))
    return spark.createDataFrame([(n, p, n == chosen) for n, p in found.items()], "view string, purity double, chosen boolean").select("view", _r("purity").alias("purity"), "chosen")


# ---- learning ----

BANK = f"{E}, {HALVES}, {_parts('v', 'da', 'dp')}, {_parts('v', 'rb', 'rp')}, " + ", ".join(
    f"{n}s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS sd FROM {n}p WHERE label < 5 GROUP BY i), {n}z AS (SELECT id, list((x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END ORDER BY i) AS v FROM {n}p JOIN {n}s USING (i) GROUP BY id)" for n in "dr"
) + f", b AS (SELECT id, {UNIT_OF('d.v')} AS deep, {UNIT_OF('r.v')} AS rf, {UNIT_OF('(d.v || r.v)')} AS hybrid FROM dz d JOIN rz r USING (id))"


@query(f"WITH {BANK} SELECT id, {R('list_sum(deep)')} AS deep, {R('list_sum(rf)')} AS rf, {R('list_sum(hybrid)')} AS hybrid FROM b")
def feature_bank(spark, sf_dir):
    df = _two_views(spark, sf_dir)
    train, later = discovery.feature_bank(df.where("label < 5"), df.where("label >= 5"))
    return train.union(later).select("id", *[_r(vectors.total(F.col(c))).alias(c) for c in ("deep", "rf", "hybrid")])


@query(f"WITH {CL}, cp AS (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM c WHERE cluster <> -1), cm AS (SELECT cluster, i, avg(x) AS x, count(*) AS n FROM cp GROUP BY cluster, i) SELECT cluster, 9 + dense_rank() OVER (ORDER BY cluster) AS label, {R('least(n / 40, 1)')} AS reliability, {R('x')} AS first FROM cm WHERE i = 1")
def enrolled_prototypes(spark, sf_dir):
    means = vectors.mean_by(_clusters(spark, sf_dir).where("cluster <> -1"), ["cluster"], "v").withColumn("reliability", F.col("n") / 40)
    return prototypes.enroll(means, 10).select("cluster", F.col("label").cast("bigint").alias("label"), _r("reliability").alias("reliability"), _r(F.get("v", F.lit(0))).alias("first"))


@query(f"WITH {E}, {_parts('v', 'e', 'ep')}, {MEANS}, rd AS (SELECT unnest(range(0, 4)) AS round), pr AS (SELECT round, label, {UNIT_OF('v')} AS v FROM m, rd WHERE label < 4 + 2 * round), s AS (SELECT round, e.id, e.label, pr.label AS pred FROM e, pr WHERE e.label < 4 QUALIFY row_number() OVER (PARTITION BY round, e.id ORDER BY list_inner_product(e.v, pr.v) DESC, pr.label) = 1) SELECT round, {R('avg(CAST(label = pred AS INT))')} AS accuracy FROM s GROUP BY round")
def day1_retention(spark, sf_dir):
    """Accuracy on the first classes after each round, whose prototypes join those of the rounds before."""
    df = _vectors(spark, sf_dir)
    protos, first = materialize(prototypes.make_prototypes(df), "protos"), df.where("label < 4")
    rows = None
    for k in range(4):
        pred = prototypes.predict(first.select("id", "v"), protos.where(F.col("label") < 4 + 2 * k))
        judged = first.select("id", "label").join(pred, "id").agg(_r(F.avg((F.col("label") == F.col("pred")).cast("double"))).alias("accuracy")).select(F.lit(k).cast("bigint").alias("round"), "accuracy")
        rows = judged if rows is None else rows.union(judged)
    return rows


@query(f"WITH {E}, p AS (SELECT id // 10 AS id, 0 AS label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), g0 AS (SELECT id, i, avg(x) AS x FROM p GROUP BY id, i), rm AS (SELECT id, 0 AS label, list(x ORDER BY i) AS v FROM g0 GROUP BY id), {_cos_graph('rm', 'g', 7)} SELECT src, dst, {R('w')} AS w FROM g")
def recording_graph(spark, sf_dir):
    df = _vectors(spark, sf_dir).withColumn("recording_id", F.floor(F.col("id") / 10))
    return graph.cosine_graph(materialize(recordings.aggregate_recordings(df, ["v"]), "recordings"), 7).select("src", "dst", _r("w").alias("w"))


@query(f"WITH {CL} SELECT cluster, count(*) AS n, 1.0 AS score, true AS accepted FROM c WHERE cluster <> -1 GROUP BY cluster")
def accepted_all(spark, sf_dir):
    return methods.accept_all(_clusters(spark, sf_dir))


GRID = "g AS (SELECT p_size AS clusters, p_size % 7 AS error, (p_partkey % 97) / 97 AS nmi, (p_partkey % 89) / 89 AS ari, (p_partkey % 83) / 83 AS hungarian, p_partkey / 10000 AS ratio, p_size / 100 AS threshold FROM part)"


@query(f"WITH {GRID} SELECT {R('ratio')} AS ratio, {R('threshold')} AS threshold, true AS informative FROM g ORDER BY error, nmi + ari + hungarian - 0.25 * error DESC, ratio, threshold LIMIT 1")
def calibration_choice(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    grid = table(spark, sf_dir, "part").select(size.alias("clusters"), (size % 7).alias("error"), (key % 97 / 97).alias("nmi"), (key % 89 / 89).alias("ari"), (key % 83 / 83).alias("hungarian"), (key / 10000).alias("ratio"), (size / 100).alias("threshold"))
    s, informative = methods.calibrated(grid, discovery.Settings())
    return spark.createDataFrame([(s.ratio, s.threshold, informative)], "ratio double, threshold double, informative boolean").select(_r("ratio").alias("ratio"), _r("threshold").alias("threshold"), "informative")


@query()
def network_predictions(spark, sf_dir):
    """A small network trained on three quarters of the records, and its predictions for all of them."""
    df = _iq(spark, sf_dir)
    recipe = training.Recipe(epochs=2, rates={"": 2e-3}, vary=False)
    net, _ = training.train_closed_set(df.where("id % 4 <> 0"), df.where("id % 4 = 0"), networks.Network("residual", 10, 16), recipe)
    return training.extract(df, net).select("id", "label", "pred", F.transform("feature", lambda x: F.round(x, 3)).alias("feature"))
