"""Signal files written by tasks: cubes, archives of arrays, array pairs, SigMF recordings, staged tables.

Every file is one group of rows, named by a column of the caller's, so that a large table becomes many files; a task
that is run again writes its file again. Writers return (file, rows), a row a file.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexilar.session import materialize
from vexilar.sources.recordings import write_recordings
from vexilar.sources.store import write_file


def _each(df: DataFrame, path: str, extension: str, order: list[str], encode: Callable[[pd.DataFrame], dict[str, bytes]]) -> DataFrame:
    """Writes what ``encode`` makes of each file's rows: bytes by the beginnings of file names."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        name = str(pdf["file"].iloc[0])
        for prefix, data in encode(pdf).items():
            write_file(f"{path}/{prefix}{name}{extension if '.' not in prefix else ''}", data)
        return pd.DataFrame({"file": [name], "rows": [len(pdf)]})

    return materialize(df.groupBy("file").applyInPandas(write, "file string, rows bigint"), "written")


def _channels(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack([np.stack(pdf["i"].to_numpy()), np.stack(pdf["q"].to_numpy())], axis=-1)


def write_cubes(df: DataFrame, path: str, **names: list[str]) -> DataFrame:
    """Pickled cubes {name}.pkl, data[tx][rx][day][eq] -> [N, L, 2]. df: file, tx, rx, day, eq (strings), sample_idx, i, q.

    names: all of a dimension's, in order, so that a file that lacks some has the others at the same places; a
    dimension without has the file's own, sorted.
    """

    def encode(pdf: pd.DataFrame) -> dict[str, bytes]:
        dims = [names.get(c) or sorted(pdf[c].unique()) for c in ("tx", "rx", "day", "eq")]
        if any(not set(pdf[c]) <= set(names[c]) for c in names):
            raise ValueError(f"records of {pdf['file'].iloc[0]} have names that {names} lacks")
        length = len(pdf["i"].iloc[0])
        cells = {k: _channels(g) for k, g in pdf.groupby(["tx", "rx", "day", "eq"])}
        empty = np.zeros((0, length, 2))
        data = [[[[cells.get((t, r, d, e), empty) for e in dims[3]] for d in dims[2]] for r in dims[1]] for t in dims[0]]
        lists = dict(zip(("tx_list", "rx_list", "capture_date_list", "equalized_list"), dims))
        return {"": pickle.dumps({"data": data, **lists})}

    return _each(df, path, ".pkl", ["tx", "rx", "day", "eq", "sample_idx"], encode)


def write_nodes(df: DataFrame, path: str) -> DataFrame:
    """Pickles {name}.pkl of a list of [N, L, 2] arrays, one a node. df: file, node (string), sample_idx, i, q."""

    def encode(pdf: pd.DataFrame) -> dict[str, bytes]:
        groups = {n: _channels(g) for n, g in pdf.groupby("node")}
        return {"": pickle.dumps({"data": list(groups.values()), "node_list": list(groups)})}

    return _each(df, path, ".pkl", ["node", "sample_idx"], encode)


def write_arrays(df: DataFrame, path: str, *extra: str) -> DataFrame:
    """Compressed archives {name}.npz of {stage}_X [N, 2, L], {stage}_y and {stage}_{extra}. df: file, stage, sample_idx, label, i, q."""

    def encode(pdf: pd.DataFrame) -> dict[str, bytes]:
        arrays = {}
        for stage, g in pdf.groupby("stage"):
            arrays[f"{stage}_X"], arrays[f"{stage}_y"] = _channels(g).transpose(0, 2, 1), g["label"].to_numpy(np.int64)
            arrays |= {f"{stage}_{c}": g[c].to_numpy() for c in extra}
        out = io.BytesIO()
        np.savez_compressed(out, **arrays)
        return {"": out.getvalue()}

    return _each(df, path, ".npz", ["stage", "sample_idx"], encode)


def write_array_pairs(df: DataFrame, path: str) -> DataFrame:
    """Pairs X_{name}.npy [N, L, 2] and y_{name}.npy. df: file, sample_idx, label, i, q."""

    def saved(x: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.save(out, x)
        return out.getvalue()

    return _each(df, path, ".npy", ["sample_idx"], lambda pdf: {"X_": saved(_channels(pdf)), "y_": saved(pdf["label"].to_numpy(np.int64))})


def write_sigmf(df: DataFrame, path: str, datatype: str = "cf64_le", sample_rate: float = 5e6) -> DataFrame:
    """Recordings {name}.sigmf-data with headers: records of a file end to end. df: file, sample_idx, i, q.

    Returns (file, rows) of what is there after the job's commit; a job that fails leaves nothing.
    """
    df = materialize(df.select("file", "sample_idx", "i", "q"), "recordings")
    write_recordings(df, path, datatype=datatype, sampleRate=sample_rate)
    return df.groupBy("file").agg(F.count("*").alias("rows"))


def write_stages(df: DataFrame, path: str, stage: str = "stage") -> DataFrame:
    """A Parquet folder a stage below ``path``, and a manifest (stage, rows, checksum) as JSON, which is returned.

    checksum: the sum of 64-bit row hashes, which doesn't depend on the rows' order.
    """
    spark, kept = df.sparkSession, [c for c in df.columns if c != stage]
    df.write.mode("overwrite").partitionBy(stage).parquet(f"{path}/stages")
    written = spark.read.schema(df.schema).parquet(f"{path}/stages")  # counted as it lies, so the table is worked out once
    counted = written.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*kept).cast("decimal(38,0)")).cast("string").alias("checksum"))
    counted.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")  # a row a stage
    return spark.read.schema("stage string, rows bigint, checksum string").json(f"{path}/manifest")


def embedding_table(df: DataFrame) -> DataFrame:
    """(x, y, true_label, cluster_label), the table that plots of a round are drawn from. df: id, x, y, label, cluster."""
    return df.select("x", "y", F.col("label").cast("int").alias("true_label"), F.col("cluster").cast("int").alias("cluster_label"))
