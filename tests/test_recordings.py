"""The recordings source, its writer, remote ranges, and the functions for SQL."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from vexilar.functions import sql
from vexilar.sources import recordings, sinks


@pytest.fixture()
def folder(tmp_path):
    rng = np.random.default_rng(2)
    made = {}
    for k, n in enumerate((1000, 70, 16)):
        name = f"dev{k}_{10 * k + 2}ft_run{k}"
        made[name] = (rng.normal(size=n) + 1j * rng.normal(size=n)).astype("<c16")
        made[name].tofile(tmp_path / f"{name}.sigmf-data")
        (tmp_path / f"{name}.sigmf-meta").write_text(json.dumps({"global": {"core:sample_rate": 5e6, "core:datatype": "cf64_le"}}))
    return tmp_path, made


def got(df):
    return {(r["file"], r["start"]): np.array(r["i"]) + 1j * np.array(r["q"]) for r in df.collect()}


@pytest.mark.parametrize("range_bytes", [1, 16 * 16 * 7, 10**9])
def test_windows_are_read_by_ranges(spark, folder, range_bytes, monkeypatch):
    path, made = folder
    df = recordings.read_recordings(spark, str(path), length=16, rangeBytes=range_bytes)
    assert df.rdd.getNumPartitions() == {1: 62 + 4 + 1, 16 * 16 * 7: 9 + 1 + 1, 10**9: 3}[range_bytes]
    want = {(n, s): z[s : s + 16] for n, z in made.items() for s in range(0, len(z) - 15, 16)}
    found = got(df)
    assert set(found) == set(want) and all((found[k] == want[k]).all() for k in want)
    row = df.where("file = 'dev1_12ft_run1' and window = 2").first()
    assert (row["serial"], row["distance_ft"], row["run"], row["start"], row["sample_rate"]) == ("dev1", 12, 1, 32, 5e6)
    assert row["energy"] == pytest.approx((np.abs(want[row["file"], 32]) ** 2).mean())


def test_filters_leave_out_recordings_and_ranges(spark, folder):
    path, _ = folder
    reader = recordings.RecordingReader({"path": str(path), "length": "16", "rangeBytes": str(16 * 16)})
    left = list(reader.pushFilters([EqualTo(("serial",), "dev0"), In(("run",), (0, 2)), GreaterThanOrEqual(("start",), 160), LessThan(("start",), 200)]))
    assert [f.attribute for f in left] == [("start",), ("start",)]
    assert [(p.first, p.last) for p in reader.partitions()] == [(10, 11), (11, 12), (12, 13)]
    df = recordings.read_recordings(spark, str(path), length=16, rangeBytes=16 * 16)
    some = df.where("serial = 'dev0' and start >= 160 and start < 200")
    assert sorted(k[1] for k in got(some)) == [160, 176, 192] and some.rdd.getNumPartitions() == 3
    assert df.where("serial = 'nobody'").count() == 0


def test_chosen_windows_are_evenly_spaced(spark, folder):
    path, _ = folder
    for size in (300, 10**9):
        df = recordings.read_recordings(spark, str(path), length=16, candidates=5, rangeBytes=size)
        assert sorted(k[1] for k in got(df) if k[0].startswith("dev0")) == (np.linspace(0, 61, 5).astype(int) * 16).tolist()


def rows(spark, names):
    return spark.createDataFrame([(n, k, [float(k)] * 4, [-1.0] * 4) for n in names for k in range(30)], "file string, sample_idx int, i array<double>, q array<double>")


def test_written_recordings_come_back(spark, tmp_path):
    names = [f"a{k}_1ft_run{k}" for k in range(9)]
    sinks.write_sigmf(rows(spark, names).repartition(5), str(tmp_path), "cf32_le")
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(n + e for n in names for e in (".sigmf-data", ".sigmf-meta"))
    back = recordings.read_recordings(spark, str(tmp_path), length=4)
    assert back.count() == 9 * 30 and back.where("i[0] <> window or q[3] <> -1").count() == 0
    recordings.write_recordings(rows(spark, names[:2]), str(tmp_path), "overwrite")
    assert len(list(tmp_path.iterdir())) == 4


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    fails = F.udf(lambda n, k: 1 // 0 if n == "b_1ft_run3" and k == 29 else k, "int")
    df = rows(spark, [f"b_1ft_run{k}" for k in range(6)])
    broken = df.withColumn("i", F.transform("i", lambda x: x)).withColumn("q", F.when(fails("file", "sample_idx") >= 0, F.col("q")))
    recordings.write_recordings(df.limit(30), str(tmp_path))
    before = sorted(p.name for p in tmp_path.iterdir())
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception):
            recordings.write_recordings(broken, str(tmp_path), mode)
        assert sorted(p.name for p in tmp_path.iterdir()) == before
    writer = recordings.RecordingWriter({"path": str(tmp_path / "x")}, False)
    batch = df.where("sample_idx < 2").orderBy("file").select("file", "i", "q").toArrow().to_batches()
    one, two = writer.write(iter(batch)), writer.write(iter(batch))
    with pytest.raises(ValueError, match="two tasks"):
        writer.commit([one, two, None])
    assert not list((tmp_path / "x").iterdir())


def test_payloads_are_read_over_http_by_tasks(spark, folder):
    path, made = folder
    asked = []

    class Ranges(BaseHTTPRequestHandler):
        def _data(self):
            return (path / self.path.strip("/")).read_bytes()

        def do_HEAD(self):  # noqa: N802
            self.send_response(200)
            self.send_header("Content-Length", str(len(self._data())))
            self.end_headers()

        def do_GET(self):  # noqa: N802
            data, part = self._data(), self.headers.get("Range")
            if part:
                a, z = map(int, part.removeprefix("bytes=").split("-"))
                asked.append((a, z))
                data = data[a : z + 1]
            self.send_response(206 if part else 200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            return

    server = ThreadingHTTPServer(("127.0.0.1", 0), Ranges)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        urls = [f"http://127.0.0.1:{server.server_port}/{n}.sigmf-data" for n in made]
        found = got(recordings.read_recordings(spark, urls=urls, length=16, rangeBytes=16 * 16 * 20))
    finally:
        server.shutdown()
    assert len(found) == 62 + 4 + 1 and all((z == made[n][s : s + 16]).all() for (n, s), z in found.items())
    assert len(asked) == 4 + 1 + 1 and max(z - a for a, z in asked) < 16 * 16 * 20


# ---- SQL ----


def test_window_function_checks_its_arguments(spark):
    sql.register(spark)
    spark.createDataFrame([(1, [1.0] * 5, [2.0] * 5), (2, None, [1.0]), (3, [1.0], [1.0])], "id int, i array<float>, q array<double>").createOrReplaceTempView("few_records")
    found = spark.sql("SELECT id, w.window, w.i FROM few_records, LATERAL strided_windows(i, q, 2, 2) w").collect()
    assert [(r["id"], r["window"], r["i"]) for r in sorted(found)] == [(1, 0, [1.0, 1.0]), (1, 1, [1.0, 1.0])]
    for bad in ("i, q, 0, 2", "i, q, id, 2", "id, q, 2, 2"):
        with pytest.raises(Exception, match="must be"):
            spark.sql(f"SELECT w.* FROM few_records, LATERAL strided_windows({bad}) w").collect()


def test_row_changes_by_partition(spark):
    sql.register(spark)
    data = [("a", 1, 5), ("a", 3, None), ("a", 2, 7), ("b", 1, 1), (None, 1, 4), (None, 2, 9), ("a", 4, 8), ("a", 5, 2)]
    spark.createDataFrame(data, "k string, t int, x int").repartition(3).createOrReplaceTempView("changing")
    found = spark.sql("SELECT * FROM row_changes(TABLE(changing) PARTITION BY k ORDER BY t, column => 'x')").collect()
    assert {(r["k"], r["t"]): r["change"] for r in found} == {("a", 1): None, ("a", 2): 2.0, ("a", 3): None, ("a", 4): None, ("a", 5): -6.0, ("b", 1): None, (None, 1): None, (None, 2): 5.0}
    for bad in ("'k'", "'nothing'"):
        with pytest.raises(Exception, match="column"):
            spark.sql(f"SELECT * FROM row_changes(TABLE(changing) PARTITION BY k ORDER BY t, column => {bad})").collect()
