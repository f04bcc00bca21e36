"""Scans of signal files through Spark's binaryFile source, which reads whatever store Spark reads.

Each reader gives rows with ``sample_id`` (a hash of the file and the place in it), the dimensions and i, q.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexilar.sources.recordings import fetch, read_recordings
from vexilar.sources.store import read_range

IQ = "i array<double>, q array<double>"


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def as_channels(x: np.ndarray) -> np.ndarray:
    """[N, 2, L] from [N, 2, L], [N, L, 2], [2, L], [L, 2], or [N, L] as one channel (q = 0)."""
    x = np.asarray(x)
    if np.iscomplexobj(x):
        x = np.atleast_2d(x)
        return np.stack([x.real, x.imag], axis=1)
    if x.ndim == 2:
        if x.shape[0] == 2:
            return x[None]
        if x.shape[1] == 2:
            return x.T[None]
        return np.stack([x, np.zeros_like(x)], axis=1)
    if x.ndim == 3 and x.shape[1] == 2:
        return x
    if x.ndim == 3 and x.shape[2] == 2:
        return x.transpose(0, 2, 1)
    raise ValueError(f"records of shape {x.shape} aren't I/Q")


def as_labels(y: np.ndarray) -> np.ndarray:
    """Integer labels from integers, floats or one-hot rows."""
    y = np.asarray(y)
    return y.argmax(axis=1).astype(np.int64) if y.ndim == 2 and y.shape[1] > 1 else y.reshape(-1).astype(np.int64)


class _ArraysOnly(__import__("pickle").Unpickler):
    """Loads plain containers and numpy arrays; anything else in a pickle is refused."""

    ALLOWED = {("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar"), ("_codecs", "encode"), ("numpy.core.numeric", "_frombuffer"), ("numpy._core.numeric", "_frombuffer")}

    def find_class(self, module: str, name: str):
        if (module, name) in self.ALLOWED:
            return super().find_class(module, name)
        raise ValueError(f"a pickle of signals may not hold {module}.{name}")


def _pickled(content: bytes):
    return _ArraysOnly(io.BytesIO(content), encoding="latin1").load()


def _taken(n: int, most: int | None, seed: int | None) -> np.ndarray:
    """Places of at most ``most`` of n records: the first ones, or with a seed random ones, in their order."""
    if most is None or n <= most:
        return np.arange(n)
    return np.arange(most) if seed is None else np.sort(np.random.default_rng(seed).permutation(n)[:most])


def read_cube(
    spark: SparkSession, path: str, pattern: str = "*.pkl", tx: list[int] | None = None, rx: list[int] | None = None, days: list[int] | None = None, eq: list[int] | None = None,
    cells: list[tuple[int, int, int]] | None = None, max_per_cell: int | None = None, seed: int | None = None, least_tx: int = 0, least_days: int = 0, max_per_tx: int | None = None,
) -> DataFrame:
    """Pickled cubes data[tx][rx][day][eq] -> [N, L, 2] with their dimension lists, a row a record.

    tx, rx, days and eq choose places in the dimensions, cells whole (rx, day, eq) triples; of each cell at most
    ``max_per_cell`` records are read, the first or random ones by a seed. Only chosen records are converted. Of each
    transmitter at most ``max_per_tx`` are kept, drawn by a seeded hash from all its chosen cells and files. A cube
    with fewer transmitters or days than asked for is refused. Columns: tx, rx, day, eq (names), tx_idx, rx_idx,
    day_idx, eq_idx, sample_idx, sample_id, file (its path), i, q. Empty cells give no row. A cube is one file and one task by nature;
    convert it once and keep the result partitioned by day_idx and rx_idx.
    """
    wanted = [None if c is None else set(c) for c in (tx, rx, days, eq)]
    triples = None if cells is None else {tuple(c) for c in cells}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                cube = _pickled(content)
                names = [cube.get(k) for k in ("tx_list", "rx_list", "capture_date_list", "equalized_list")]
                data = cube["data"]
                n_days = max((len(of_rx) for of_tx in data for of_rx in of_tx), default=0)
                if len(data) < least_tx or n_days < least_days:
                    raise ValueError(f"{path} has {len(data)} transmitters and {n_days} days; {least_tx} and {least_days} are needed")
                chosen = lambda seq, k: [(n, x) for n, x in enumerate(seq) if wanted[k] is None or n in wanted[k]]
                for t, of_tx in chosen(data, 0):
                    for r, of_rx in chosen(of_tx, 1):
                        for d, of_day in chosen(of_rx, 2):
                            for e, cell in chosen(of_day, 3):
                                if len(cell) == 0 or triples is not None and (r, d, e) not in triples:
                                    continue
                                keep = _taken(len(cell), max_per_cell, seed)
                                x = as_channels(np.asarray(cell)[keep]).astype(float)
                                at = (t, r, d, e)
                                yield pd.DataFrame(
                                    {n: [str(v[k]) if v is not None else str(k)] * len(x) for n, v, k in zip(("tx", "rx", "day", "eq"), names, at)}
                                    | {n: [k] * len(x) for n, k in zip(("tx_idx", "rx_idx", "day_idx", "eq_idx"), at)}
                                    | {"sample_idx": keep, "_file": [path] * len(x), "i": list(x[:, 0]), "q": list(x[:, 1])}
                                )

    schema = f"tx string, rx string, day string, eq string, tx_idx int, rx_idx int, day_idx int, eq_idx int, sample_idx int, _file string, {IQ}"
    rows = _files(spark, path, pattern).select("path", "content").mapInPandas(run, schema)
    if max_per_tx is not None:
        from vexilar.operators.splits import per_class

        name = F.concat_ws("/", F.element_at(F.split("_file", "/"), -1), "rx", "day", "eq", "sample_idx")
        rows = per_class(rows.withColumn("_name", name), "tx", "_name", max_per_tx, 7 if seed is None else seed).drop("_name")
    return rows.withColumn("sample_id", F.xxhash64("_file", "tx_idx", "rx_idx", "day_idx", "eq_idx", "sample_idx")).withColumnRenamed("_file", "file")


def read_nodes(spark: SparkSession, path: str, pattern: str = "*.pkl", nodes: list[str] | None = None, indices: list[int] | None = None, max_per_node: int | None = None, seed: int | None = None, zscore: bool = False) -> DataFrame:
    """Pickles of a list of [N, L, 2] arrays with node names: node, node_idx, label, sample_idx, i, q.

    nodes (names) or indices choose, not both, and number the labels in that order; a name that a file lacks is an
    error, and so is a chosen node without records. At most ``max_per_node`` records of each, the first or random ones
    by a seed; zscore: each channel of a record with mean 0 and deviation 1.
    """
    if nodes is not None and indices is not None:
        raise ValueError("choose by names or by indices")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                cube = _pickled(content)
                names = [str(n) for n in cube["node_list"]]
                if missing := [n for n in nodes or () if n not in names]:
                    raise ValueError(f"{path} lacks the nodes {missing}")
                for label, k in enumerate([names.index(n) for n in nodes] if nodes is not None else indices if indices is not None else range(len(names))):
                    if not len(cube["data"][k]):
                        raise ValueError(f"{path} has no records of node {names[k]}")
                    keep = _taken(len(cube["data"][k]), max_per_node, seed)
                    x = as_channels(np.asarray(cube["data"][k])[keep]).astype(float)
                    if zscore:
                        x = (x - x.mean(axis=2, keepdims=True)) / (x.std(axis=2, keepdims=True) + 1e-8)
                    yield pd.DataFrame({"node": names[k], "node_idx": k, "label": label, "sample_idx": keep, "i": list(x[:, 0]), "q": list(x[:, 1])})

    return _files(spark, path, pattern).select("path", "content").mapInPandas(run, f"node string, node_idx int, label bigint, sample_idx int, {IQ}")


def read_arrays(spark: SparkSession, path: str, pattern: str = "*.npz", classes: int | None = None) -> DataFrame:
    """Archives of arrays {stage}_X [N, 2, L], {stage}_y and further {stage}_* columns: stage, sample_idx, label, i, q, extra (map).

    classes: labels from 0 to below this number are expected, others are an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                z = np.load(io.BytesIO(content), allow_pickle=False)
                for key in (k for k in z.files if k.endswith("_X")):
                    stage = key[:-2]
                    x, y = as_channels(z[key]).astype(float), as_labels(z[f"{stage}_y"])
                    if classes is not None and len(y) and not 0 <= y.min() <= y.max() < classes:
                        raise ValueError(f"{path} has labels from {y.min()} to {y.max()} in {stage}; {classes} classes are expected")
                    more = {k[len(stage) + 1 :]: z[k] for k in z.files if k.startswith(f"{stage}_") and k not in (key, f"{stage}_y") and len(z[k]) == len(x)}
                    yield pd.DataFrame({"stage": stage, "sample_idx": np.arange(len(x)), "label": y, "i": list(x[:, 0]), "q": list(x[:, 1]), "extra": [{k: int(v[n]) for k, v in more.items()} for n in range(len(x))], "_file": path})

    rows = _files(spark, path, pattern).select("path", "content").mapInPandas(run, f"stage string, sample_idx int, label bigint, {IQ}, extra map<string,bigint>, _file string")
    return rows.withColumn("sample_id", F.xxhash64("_file", "stage", "sample_idx")).drop("_file")


#: Records of an array file that a task reads at once.
ARRAY_ROWS = 4_096


def _array_ranges(spark: SparkSession, path: str, pattern: str, columns: str, rows_of) -> DataFrame:
    """Array files by ranges of rows: headers are read first, then each range by a task of its own."""

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                head = io.BytesIO(read_range(name, 0, 4096))
                version = np.lib.format.read_magic(head)
                shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
                if fortran or dtype.hasobject:
                    raise ValueError(f"{name} isn't a plain array in row order")
                width = int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize
                starts = np.arange(0, shape[0], ARRAY_ROWS)
                yield pd.DataFrame({"path": name, "at": head.tell() + starts * width, "size": np.minimum(ARRAY_ROWS, shape[0] - starts) * width, "start": starts, "shape": json.dumps(shape[1:]), "dtype": dtype.str})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                x = np.frombuffer(read_range(r.path, r.at, r.size), r.dtype).reshape(-1, *json.loads(r.shape))
                yield rows_of(r.path, r.start, x)

    ranges = _files(spark, path, pattern).select("path").mapInPandas(headers, "path string, at bigint, size bigint, start bigint, shape string, dtype string")
    return ranges.repartition(spark.sparkContext.defaultParallelism * 2).mapInPandas(read, columns)


def _array_rows(spark: SparkSession, x_path: str, x_pattern: str, y_path: str, y_pattern: str) -> DataFrame:
    key = lambda path: re.sub(r"\A(X|y)_|\.npy\Z", "", path.rpartition("/")[2]) if "X_" in x_pattern else ""

    def x_rows(path: str, start: int, x: np.ndarray) -> pd.DataFrame:
        x = as_channels(x).astype(float)
        return pd.DataFrame({"file": key(path), "sample_idx": np.arange(start, start + len(x)), "i": list(x[:, 0]), "q": list(x[:, 1])})

    def y_rows(path: str, start: int, y: np.ndarray) -> pd.DataFrame:
        y = as_labels(y)
        return pd.DataFrame({"file": key(path), "sample_idx": np.arange(start, start + len(y)), "label": y})

    x = _array_ranges(spark, x_path, x_pattern, f"file string, sample_idx bigint, {IQ}", x_rows)
    return x.join(_array_ranges(spark, y_path, y_pattern, "file string, sample_idx bigint, label bigint", y_rows), ["file", "sample_idx"])


def read_npy(spark: SparkSession, x_path: str, y_path: str) -> DataFrame:
    """A pair of array files, records and labels, read by ranges: sample_idx, label, i, q. Files may be of any size."""
    return _array_rows(spark, x_path, "*.npy", y_path, "*.npy").drop("file")


def read_npy_pairs(spark: SparkSession, path: str) -> DataFrame:
    """All pairs X_{name}.npy and y_{name}.npy of a folder, read by ranges: file (the name), sample_idx, label, i, q."""
    return _array_rows(spark, path, "X_*.npy", path, "y_*.npy")


def read_sigmf(spark: SparkSession, path: str, length: int = 256, candidates: int = 12_000, quantile: float = 0.5, per_recording: int | None = None, seed: int = 7, datatype: str | None = None) -> DataFrame:
    """SigMF pairs: windows of each recording with at least the quantile of window energy.

    The header (*.sigmf-meta) names the sample rate; serial, distance and run come from the file name; the payload
    (*.sigmf-data) is of the header's type, or of ``datatype`` for recordings whose header is wrong; a size that is no
    whole number of such samples is an error. At most
    ``candidates`` evenly spaced windows that don't overlap are considered, and ``per_recording`` of the strong ones
    are drawn by a seeded hash. Payloads are read by byte ranges, once for the energies and once for the rows. Columns: serial, distance_ft, run, sample_rate, start, energy, i, q.
    """
    options = {"datatype": datatype} if datatype else {}
    windows = read_recordings(spark, path, length=length, candidates=candidates, **options)
    windows = windows.where(~F.isnan("energy") & (F.col("energy") != float("inf")))
    least = windows.groupBy("file").agg(F.percentile("energy", F.lit(quantile)).alias("_least")).withColumnRenamed("file", "_file")  # candidates bound a group
    rows = windows.join(least, F.col("file") == F.col("_file")).where("energy >= _least").select("serial", "distance_ft", "run", "sample_rate", "start", "energy", "i", "q")
    if per_recording is None:
        return rows
    from vexilar.operators.splits import head

    return head(rows, ["serial", "distance_ft", "run"], [F.xxhash64("serial", "distance_ft", "run", "start", F.lit(seed)), F.col("start")], per_recording)


def archive_directory(spark: SparkSession, path: str, pattern: str = "*.npz") -> DataFrame:
    """(path, bytes, sha256, member, member_bytes, shape, dtype): what each archive holds, without loading its arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                with zipfile.ZipFile(io.BytesIO(row.content)) as z:
                    out = []
                    for m in z.infolist():
                        with z.open(m) as f:
                            version = np.lib.format.read_magic(f)
                            shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
                        out.append((row.path, row.length, row.sha256, m.filename, m.file_size, json.dumps(shape), str(dtype)))
                yield pd.DataFrame(out, columns=["path", "bytes", "sha256", "member", "member_bytes", "shape", "dtype"])

    files = _files(spark, path, pattern).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")
    return files.mapInPandas(run, "path string, bytes bigint, sha256 string, member string, member_bytes bigint, shape string, dtype string")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; a byte-order mark before the first name is dropped."""
    reader = spark.read.option("header", "true")
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", "true").csv(path)
    return df.withColumnsRenamed({c: c.removeprefix("﻿") for c in df.columns})


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """JSON documents, one a file or, with ``lines``, one a line, where files are split between tasks."""
    reader = spark.read.option("multiLine", str(not lines).lower())
    return (reader.schema(schema) if schema else reader).json(path)


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with a header; mark: with a byte-order mark before it, in every file."""
    if mark:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_stage(spark: SparkSession, path: str, stage: str, fallback: str | None = None) -> DataFrame:
    """One stage of those that ``sinks.write_stages`` wrote, or the fallback where it is absent; KeyError without either."""
    have = {r["stage"] for r in spark.read.schema("stage string, rows bigint, checksum string").json(f"{path}/manifest").select("stage").collect()}  # stages
    name = stage if stage in have else fallback
    if name not in have:
        raise KeyError(f"no stage {stage}; there are {sorted(have)}")
    return spark.read.parquet(f"{path}/stages").where(F.col("stage") == name)


def fetch_ranges(url: str, ranges: list[tuple[int, int]], tries: int = 6, wait: float = 0.5, sha256: str | None = None, threads: int = 8) -> list[bytes]:
    """Parts of a remote file, [first, last) bytes each, over HTTP, on the driver: for directories and headers.

    Payloads are read by tasks, see ``sources.recordings``. sha256: of all parts together, checked if given.
    """
    import hashlib
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(threads) as pool:
        found = list(pool.map(lambda part: fetch(url, part[0], part[1] - part[0], tries, wait), ranges))
    if sha256 is not None and hashlib.sha256(b"".join(found)).hexdigest() != sha256:
        raise ValueError(f"{url} has other contents than expected")
    return found


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_records(df: DataFrame, path: str, *partitions: str) -> None:
    """Parquet, partitioned by low-cardinality columns such as split, stage or round."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def describe_cube(df: DataFrame) -> DataFrame:
    """(file, tx_idx, rx_idx, day_idx, eq_idx, records, length) of scanned cubes, a row a cell of each."""
    return df.groupBy("file", "tx_idx", "rx_idx", "day_idx", "eq_idx").agg(F.count("*").alias("records"), F.max(F.size("i")).alias("length"))
