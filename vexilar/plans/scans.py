"""Queries over files that they write themselves, by tasks, into the shared folder: each scan gives back its rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from vexilar.functions import rf, sql, vectors
from vexilar.operators import splits
from vexilar.plans.queries import IQ, PROTOCOL, R, _iq, _r, _vectors, query
from vexilar.session import scratch_path, table
from vexilar.sources import files, recordings, sinks

#: Records of a file: small enough for a task, whatever the table.
FILE_ROWS = 5_000
_PART = f"id // {FILE_ROWS}"


def _records(spark, sf_dir):
    """file, sample_idx, label, i, q: at most FILE_ROWS records of a label in a file."""
    part = F.floor(F.col("id") / FILE_ROWS)
    return _iq(spark, sf_dir).select("id", F.concat_ws("_", "label", part).alias("file"), F.col("id").alias("sample_idx"), "label", "i", "q")


#: Names of a cube's dimensions: a file of few records has all of them too.
PLACES = {"rx": ["rx0", "rx1"], "day": ["day0", "day1", "day2"], "eq": ["no"]}


def _first_last(df, *columns):
    return df.select(*columns, _r(F.get("i", F.lit(0))).alias("i_first"), _r(F.element_at("q", -1)).alias("q_last"))


ENDS = f"{R('i[1]')} AS i_first, {R('q[32]')} AS q_last"


@query(f"WITH {IQ} SELECT CAST(label AS VARCHAR) AS tx, 'rx' || (id % 2) AS rx, 'day' || ((id // 2) % 3) AS day, row_number() OVER (PARTITION BY label, {_PART}, id % 2, (id // 2) % 3 ORDER BY id) - 1 AS sample_idx, {ENDS} FROM r JOIN e USING (id)")
def cube_scan(spark, sf_dir):
    path = scratch_path(spark, "cubes")
    names = {"tx": F.col("label").cast("string"), "rx": F.concat(F.lit("rx"), F.col("id") % 2), "day": F.concat(F.lit("day"), F.floor(F.col("id") / 2) % 3), "eq": F.lit("no")}
    sinks.write_cubes(_records(spark, sf_dir).withColumns(names).drop("id", "label"), path, **PLACES)
    return _first_last(files.read_cube(spark, path), "tx", "rx", "day", F.col("sample_idx").cast("bigint").alias("sample_idx"))


@query(f"WITH {IQ}, n AS (SELECT label, id, i, q, row_number() OVER (PARTITION BY label, {_PART}, (id // 2) % 3 ORDER BY id) AS k FROM r JOIN e USING (id) WHERE id % 2 = 1 AND (id // 2) % 3 <> 1) SELECT CAST(label AS VARCHAR) AS tx, 'day' || ((id // 2) % 3) AS day, k - 1 AS sample_idx, {ENDS} FROM n WHERE k <= 4")
def cube_scan_chosen(spark, sf_dir):
    path = scratch_path(spark, "cubes")
    names = {"tx": F.col("label").cast("string"), "rx": F.concat(F.lit("rx"), F.col("id") % 2), "day": F.concat(F.lit("day"), F.floor(F.col("id") / 2) % 3), "eq": F.lit("no")}
    sinks.write_cubes(_records(spark, sf_dir).withColumns(names).drop("id", "label"), path, **PLACES)
    found = files.read_cube(spark, path, cells=[(1, 0, 0), (1, 2, 0)], max_per_cell=4, least_days=3)
    return _first_last(found, "tx", "day", F.col("sample_idx").cast("bigint").alias("sample_idx"))


@query(f"WITH {IQ}, n AS (SELECT label, {_PART} AS part, id % 2 AS rx, (id // 2) % 3 AS day, i, q, row_number() OVER (PARTITION BY label, {_PART}, id % 2, (id // 2) % 3 ORDER BY id) - 1 AS k FROM r JOIN e USING (id)), c AS (SELECT *, 'rx' || rx || '/day' || day || '/no/' || k AS cell FROM n WHERE (rx, day) IN ((0, 0), (1, 0), (1, 2))), h AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('5:' || label || '_' || part || '.pkl/' || cell), part, cell) AS place FROM c) SELECT CAST(label AS VARCHAR) AS tx, 'rx' || rx AS rx, 'day' || day AS day, k AS sample_idx, {ENDS} FROM h WHERE place <= 7")
def cube_scan_environments(spark, sf_dir):
    """At most so many records of a transmitter, drawn from the union of its chosen (rx, day, eq) cells."""
    path = scratch_path(spark, "cubes")
    names = {"tx": F.col("label").cast("string"), "rx": F.concat(F.lit("rx"), F.col("id") % 2), "day": F.concat(F.lit("day"), F.floor(F.col("id") / 2) % 3), "eq": F.lit("no")}
    sinks.write_cubes(_records(spark, sf_dir).withColumns(names).drop("id", "label"), path, **PLACES)
    found = files.read_cube(spark, path, cells=[(0, 0, 0), (1, 0, 0), (1, 2, 0)], max_per_tx=7, seed=5)
    return _first_last(found, "tx", "rx", "day", F.col("sample_idx").cast("bigint").alias("sample_idx"))


@query(f"WITH {IQ}, n AS (SELECT label, id, i, row_number() OVER (PARTITION BY label, {_PART} ORDER BY id) AS k FROM r JOIN e USING (id)), z AS (SELECT *, list_avg(i) AS m FROM n WHERE k <= 10) SELECT 'n' || label AS node, k - 1 AS sample_idx, {R('(i[1] - m) / (sqrt(list_avg(list_transform(i, lambda x: pow(x - m, 2)))) + 1e-8)')} AS i_first FROM z")
def node_scan(spark, sf_dir):
    path = scratch_path(spark, "nodes")
    sinks.write_nodes(_records(spark, sf_dir).withColumn("node", F.concat(F.lit("n"), "label")).drop("id", "label"), path)
    found = files.read_nodes(spark, path, max_per_node=10, zscore=True)
    return found.select("node", F.col("sample_idx").cast("bigint").alias("sample_idx"), _r(F.get("i", F.lit(0))).alias("i_first"))


@query(f"WITH {IQ} SELECT CASE WHEN id % 3 = 0 THEN 'eval' ELSE 'train' END AS stage, row_number() OVER (PARTITION BY label, {_PART}, id % 3 = 0 ORDER BY id) - 1 AS sample_idx, label, id AS sequence, {ENDS} FROM r JOIN e USING (id)")
def arrays_scan(spark, sf_dir):
    path = scratch_path(spark, "arrays")
    rows = _records(spark, sf_dir).withColumn("stage", F.when(F.col("id") % 3 == 0, "eval").otherwise("train")).withColumnRenamed("id", "sequence")
    sinks.write_arrays(rows, path, "sequence")
    found = files.read_arrays(spark, path, classes=10)
    return _first_last(found, "stage", F.col("sample_idx").cast("bigint").alias("sample_idx"), "label", F.element_at("extra", F.lit("sequence")).alias("sequence"))


@query(f"WITH {IQ}, n AS (SELECT label, {_PART} AS part, CASE WHEN id % 3 = 0 THEN 'eval' ELSE 'train' END AS stage, count(*) AS n FROM e GROUP BY ALL) SELECT stage || '_' || m || '.npy' AS member, '[' || n || CASE m WHEN 'X' THEN ', 2, 32]' ELSE ']' END AS shape, CASE m WHEN 'X' THEN 'float64' ELSE 'int64' END AS dtype FROM n, (VALUES ('X'), ('y')) AS t(m)")
def archive_listing(spark, sf_dir):
    path = scratch_path(spark, "arrays")
    sinks.write_arrays(_records(spark, sf_dir).withColumn("stage", F.when(F.col("id") % 3 == 0, "eval").otherwise("train")).drop("id"), path)
    return files.archive_directory(spark, path).select("member", "shape", "dtype")


@query(f"WITH {IQ} SELECT label || '_' || ({_PART}) AS file, row_number() OVER (PARTITION BY label, {_PART} ORDER BY id) - 1 AS sample_idx, label, {ENDS} FROM r JOIN e USING (id)")
def array_pairs_scan(spark, sf_dir):
    path = scratch_path(spark, "pairs")
    sinks.write_array_pairs(_records(spark, sf_dir).drop("id"), path)
    return _first_last(files.read_npy_pairs(spark, path), "file", "sample_idx", "label")


@query(f"WITH {IQ}, n AS (SELECT label, id, i, q, {_PART} AS run, 32 * (row_number() OVER (PARTITION BY label, {_PART} ORDER BY id) - 1) AS start, list_avg(list_transform(range(1, 33), lambda k: i[k] * i[k] + q[k] * q[k])) AS energy FROM r JOIN e USING (id)), h AS (SELECT label, run, quantile_cont(energy, 0.5) AS least FROM n GROUP BY ALL) SELECT 'S' || label AS serial, CAST(2 + label AS INT) AS distance_ft, CAST(run AS INT) AS run, start, {R('energy')} AS energy, {ENDS} FROM n JOIN h USING (label, run) WHERE energy >= least")
def recording_scan(spark, sf_dir):
    path = scratch_path(spark, "recordings")
    name = F.concat(F.lit("S"), F.col("label"), F.lit("_"), F.col("label") + 2, F.lit("ft_run"), F.floor(F.col("id") / FILE_ROWS))
    sinks.write_sigmf(_records(spark, sf_dir).withColumn("file", name).drop("id", "label"), path)
    found = files.read_sigmf(spark, path, 32, FILE_ROWS)
    return _first_last(found, "serial", "distance_ft", "run", "start", _r("energy").alias("energy"))


@query(f"WITH {IQ}, n AS (SELECT label, {_PART} AS run, 32 * (row_number() OVER (PARTITION BY label, {_PART} ORDER BY id) - 1) AS start, i, q FROM r JOIN e USING (id)) SELECT 'S' || label AS serial, CAST(run AS INT) AS run, start, {ENDS} FROM n WHERE label IN (1, 4, 7) AND start >= 64 AND start < 640")
def recording_ranges(spark, sf_dir):
    """Filters that reach the reader: three recordings' byte ranges are opened, and of those the wanted part."""
    path = scratch_path(spark, "recordings")
    name = F.concat(F.lit("S"), F.col("label"), F.lit("_"), F.col("label") + 2, F.lit("ft_run"), F.floor(F.col("id") / FILE_ROWS))
    recordings.write_recordings(_records(spark, sf_dir).withColumn("file", name).drop("id", "label"), path)
    found = recordings.read_recordings(spark, path, length=32, rangeBytes=32 * 16 * 8).where("serial in ('S1', 'S4', 'S7') and start >= 64 and start < 640")
    return _first_last(found, "serial", "run", "start")


@query(f"WITH {IQ}, w AS (SELECT id, unnest(range(0, 7)) AS k, i, q FROM r) SELECT id, k AS \"window\", {R('list_sum(i[k * 4 + 1:k * 4 + 8])')} AS total, {R('q[k * 4 + 8]')} AS last FROM w")
def windows_in_sql(spark, sf_dir):
    """Windows by a table function through LATERAL."""
    sql.register(spark)
    _iq(spark, sf_dir).repartition(4).createOrReplaceTempView("signal_records")
    found = spark.sql("SELECT id, w.* FROM signal_records, LATERAL strided_windows(i, q, 8, 4) w")
    return found.select("id", "window", _r(vectors.total(F.col("i"))).alias("total"), _r(F.element_at("q", -1)).alias("last"))


@query(f"SELECT event_id, {R('value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} AS change FROM events")
def changes_in_sql(spark, sf_dir):
    """A table function over partitions in order, one row kept."""
    sql.register(spark)
    table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value").createOrReplaceTempView("event_rows")
    found = spark.sql("SELECT event_id, change FROM row_changes(TABLE(event_rows) PARTITION BY user_id ORDER BY (ts, event_id), column => 'value')")
    return found.select("event_id", _r("change").alias("change"))


@query(f"WITH {IQ}, p AS (SELECT id, list_transform(range(1, 33), lambda k: sqrt(i[k] * i[k] + q[k] * q[k] + 1e-8)) AS a FROM r) SELECT id, {R('list_avg(a)')} AS amp_mean, {R('list_max(a)')} AS amp_max FROM p")
def features_in_sql(spark, sf_dir):
    """Named features called from SQL."""
    sql.register(spark)
    _iq(spark, sf_dir).createOrReplaceTempView("signal_records")
    at = {n: k for k, n in enumerate(rf.VIEWS["amplitude_8d"])}
    found = spark.sql("SELECT id, feature_amplitude_8d(i, q) AS f FROM signal_records")
    return found.select("id", *[_r(F.get("f", F.lit(at[n]))).alias(n) for n in ("amp_mean", "amp_max")])


@query("SELECT c_custkey, c_name, round(c_acctbal, 2) + 0.0 AS c_acctbal FROM customer")
def csv_scan(spark, sf_dir):
    path = scratch_path(spark, "csv")
    files.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path, mark=True)
    found = files.read_csv(spark, path)
    return found.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", _r(F.col("c_acctbal").cast("double"), 2).alias("c_acctbal"))


@query("SELECT p_partkey, p_name, p_size FROM part")
def json_scan(spark, sf_dir):
    path = scratch_path(spark, "json")
    files.write_json(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), path)
    return files.read_json(spark, path, "p_partkey bigint, p_name string, p_size int", lines=True)


@query(f"WITH {PROTOCOL} SELECT 'day2_unknown_round1' AS asked, id, label FROM s WHERE split = 'train' AND g = 1 UNION ALL SELECT 'absent', id, label FROM s WHERE split = 'train' AND g = 0")
def stage_lookup(spark, sf_dir):
    path = scratch_path(spark, "stages")
    df = splits.order_block(_vectors(spark, sf_dir).select("id", "label"), ["label"], ["id"])
    sinks.write_stages(splits.protocol(df, 4, 2, 3).select("stage", "id", "label"), path)
    ask = lambda name: files.read_stage(spark, path, name, "day1_known_train").select(F.lit(name).alias("asked"), "id", "label")
    return ask("day2_unknown_round1").union(ask("absent"))


@query(f"WITH {IQ}, n AS (SELECT label, {_PART} AS part, id % 2 AS rx, (id // 2) % 3 AS day, count(*) AS records FROM e GROUP BY ALL) SELECT CAST(rx AS INT) AS rx_idx, CAST(day AS INT) AS day_idx, records, 32 AS length FROM n")
def cube_inspection(spark, sf_dir):
    path = scratch_path(spark, "cubes")
    names = {"tx": F.col("file"), "rx": F.concat(F.lit("rx"), F.col("id") % 2), "day": F.concat(F.lit("day"), F.floor(F.col("id") / 2) % 3), "eq": F.lit("no")}
    sinks.write_cubes(_records(spark, sf_dir).withColumns(names).withColumn("file", F.floor(F.col("id") / FILE_ROWS).cast("string")).drop("id", "label"), path, **PLACES)
    return files.describe_cube(files.read_cube(spark, path)).select("rx_idx", "day_idx", "records", "length")
