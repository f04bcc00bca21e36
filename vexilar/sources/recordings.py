"""Recordings as a Spark data source: read by byte ranges with filters pushed down, written with commit and abort.

    spark.dataSource.register(Recordings)
    spark.read.format("recordings").option("length", 256).load(folder)

A recording is {serial}_{distance}ft_run{run}.sigmf-data, complex samples end to end, with its header in .sigmf-meta. A
partition is a range of windows of one recording, so no task holds a file; filters on serial, distance_ft and run leave
out recordings, those on start leave out ranges. Folders may be paths or URIs that pyarrow reaches. With the option
``urls`` (comma-separated) payloads are read over HTTP, range by range, by the tasks; each has its header beside it.

Writing takes rows of one recording after each other (see ``write_recordings``). A task writes under names of its own;
the job's commit gives files their names, and an abort removes what tasks have left.
"""

from __future__ import annotations

import json
import re
import time
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from vexilar.session import ship
from vexilar.sources.store import store

# Parts of a name, and sample types by the names that headers use.
IDENTITY = re.compile(r"(?P<serial>[A-Za-z0-9]+)_(?P<distance>\d+)ft_(?:run)?(?P<run>\d+)", re.IGNORECASE)
SAMPLE_TYPES = {"cf32": "<c8", "cf32_le": "<c8", "cf64": "<c16", "cf64_le": "<c16"}

SCHEMA = "file string, serial string, distance_ft int, run int, sample_rate double, window bigint, start bigint, energy double, i array<double>, q array<double>"
#: Bytes of a partition, and bytes read at once.
RANGE_BYTES, READ_BYTES = 32_000_000, 4_000_000


# ---- byte ranges of files and addresses ----


def fetch(url: str, start: int, size: int, tries: int = 6, wait: float = 0.5) -> bytes:
    """``size`` bytes of a remote file from ``start``; a failed request is repeated after a growing pause. A server that ignores ranges is refused."""
    for k in range(tries):
        try:
            ask = urllib.request.Request(url, headers={"Range": f"bytes={start}-{start + size - 1}"})
            with urllib.request.urlopen(ask, timeout=60) as answer:
                data = answer.read(size + 1) if answer.status == 206 else b""
                if answer.status != 206 or len(data) != size:
                    raise ValueError(f"{url} answered {answer.status} with {len(data)} bytes for {size} from {start}")
                return data
        except OSError:
            if k + 1 == tries:
                raise
            time.sleep(wait * 2**k)
    raise ValueError("at least one try is needed")


def _is_remote(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def _size(path: str) -> int:
    if _is_remote(path):
        with urllib.request.urlopen(urllib.request.Request(path, method="HEAD"), timeout=60) as answer:
            return int(answer.headers["Content-Length"])
    files, at = store(path)
    return files.get_file_info(at).size


def _whole(path: str) -> bytes:
    if _is_remote(path):
        with urllib.request.urlopen(path, timeout=60) as answer:
            return answer.read()
    files, at = store(path)
    with files.open_input_stream(at) as f:
        return f.read()


def read_bytes(path: str, start: int, size: int) -> bytes:
    if _is_remote(path):
        return fetch(path, start, size)
    files, at = store(path)
    with files.open_input_file(at) as f:
        return f.read_at(size, start)


def _payloads(folder: str) -> list[str]:
    from pyarrow import fs

    files, at = store(folder)
    found = files.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(f"{folder.rstrip('/')}/{x.path[len(at.rstrip('/')) + 1:]}" for x in found if x.is_file and x.path.endswith(".sigmf-data") and not x.base_name.startswith("."))


# ---- reading ----


@dataclass(eq=False)
class Range(InputPartition):
    """Windows number ``first`` to ``last`` (not included) of one recording; with a stride only evenly spaced ones."""

    path: str
    kind: str
    rate: float | None
    first: int
    last: int
    windows: int


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.folder, self.urls = options.get("path"), [u for u in options.get("urls", "").split(",") if u]
        self.length, self.most = int(options.get("length", 256)), int(options.get("candidates", 0))
        self.kind, self.range_bytes = options.get("datatype"), int(options.get("rangebytes", RANGE_BYTES))
        self.allowed: dict[str, set] = {}
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        """Takes equality on a recording's names, and bounds of start to the range; the bounds are also left to Spark."""
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if isinstance(f, (EqualTo, EqualNullSafe, In)) and column in ("serial", "distance_ft", "run"):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.allowed[column] = self.allowed.get(column, values) & values
                continue
            if column == "start" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, int(f.value))
            if column == "start" and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = int(f.value) if self.high is None else min(self.high, int(f.value))
            yield f

    def _identity(self, path: str) -> dict[str, object]:
        name = path.rpartition("/")[2].removesuffix(".sigmf-data")
        found = IDENTITY.search(name)
        if not found:
            raise ValueError(f"no serial, distance and run in {name}")
        return {"file": name, "serial": found["serial"], "distance_ft": int(found["distance"]), "run": int(found["run"])}

    def partitions(self) -> list[Range]:
        out = []
        for path in self.urls or _payloads(self.folder):
            names = self._identity(path)
            if any(names[c] not in values for c, values in self.allowed.items()):
                continue
            head = json.loads(_whole(path.removesuffix("-data") + "-meta"))["global"]
            kind = SAMPLE_TYPES.get(self.kind or head.get("core:datatype") or "")
            if kind is None:
                raise ValueError(f"{names['file']} has samples of type {self.kind or head.get('core:datatype')}; {', '.join(SAMPLE_TYPES)} can be read")
            size, item = _size(path), np.dtype(kind).itemsize
            if size % item:
                raise ValueError(f"{names['file']} isn't a whole number of {self.kind or head['core:datatype']} samples")
            windows = size // item // self.length
            first, last = min(windows, -(-self.low // self.length)), windows if self.high is None else max(0, min(windows, self.high // self.length + 1))
            step = max(1, self.range_bytes // (item * self.length))
            out += [Range(path, kind, head.get("core:sample_rate"), k, min(last, k + step), windows) for k in range(first, last, step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark asks once where there are no partitions
            return
        names, item = self._identity(part.path), np.dtype(part.kind).itemsize
        wanted = np.arange(part.first, part.last)
        if self.most and self.most < part.windows:  # evenly spaced over the whole recording
            even = np.unique(np.linspace(0, part.windows - 1, self.most).astype(np.int64))
            wanted = even[(even >= part.first) & (even < part.last)]
        step = max(1, READ_BYTES // (item * self.length))
        for lo in range(part.first, part.last, step):
            some = wanted[(wanted >= lo) & (wanted < lo + step)]
            if not len(some):
                continue
            a, z = int(some[0]), int(some[-1]) + 1
            held = np.frombuffer(read_bytes(part.path, a * self.length * item, (z - a) * self.length * item), part.kind).reshape(z - a, self.length)
            w = held[some - a].astype(np.complex128)
            n, energy = len(some), (np.abs(w) ** 2).mean(axis=1)
            ends = pa.array(np.arange(0, (n + 1) * self.length, self.length, dtype=np.int32))
            channel = lambda x, ends=ends: pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x).ravel()))
            same = lambda v, kind, n=n: pa.array([v] * n, kind)
            columns = [same(names["file"], pa.string()), same(names["serial"], pa.string()), same(names["distance_ft"], pa.int32()), same(names["run"], pa.int32()), same(part.rate, pa.float64())]
            columns += [pa.array(some), pa.array(some * self.length), pa.array(energy), channel(w.real), channel(w.imag)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


# ---- writing ----


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: (file under its own name, its final name)."""

    files: list[tuple[str, str]]


class RecordingWriter(DataSourceArrowWriter):
    """Rows (file, i, q) of one recording after each other become one payload and header; a file belongs to one task."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.folder, self.type, self.rate = options["path"].rstrip("/"), options.get("datatype", "cf64_le"), float(options.get("samplerate", 5e6))
        self.job, self.overwrite = uuid.uuid4().hex, overwrite
        if self.type not in SAMPLE_TYPES:
            raise ValueError(f"samples of type {self.type} can't be written")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        header = json.dumps({"global": {"core:datatype": self.type, "core:sample_rate": self.rate}, "captures": [], "annotations": []}).encode()
        files, root = store(self.folder)
        files.create_dir(root, recursive=True)
        done, now, out = [], None, None
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("file")).to_pylist()
            i, q = (batch.column(batch.schema.get_field_index(c)) for c in ("i", "q"))
            for k, name in enumerate(names):
                if name != now:
                    if out is not None:
                        out.close()
                    if name in {n for n, _ in done}:
                        raise ValueError(f"the rows of {name} aren't together; use write_recordings")
                    now = name
                    done.append((name, f"{root}/.{name}.{self.job}-{uuid.uuid4().hex}"))
                    out = files.open_output_stream(done[-1][1] + ".sigmf-data")
                    with files.open_output_stream(done[-1][1] + ".sigmf-meta") as f:
                        f.write(header)
                pair = np.asarray(i[k].values.to_numpy(zero_copy_only=False)) + 1j * np.asarray(q[k].values.to_numpy(zero_copy_only=False))
                out.write(pair.astype(SAMPLE_TYPES[self.type]).tobytes())
        if out is not None:
            out.close()
        return Written([(temp + end, f"{root}/{name}{end}") for name, temp in done for end in (".sigmf-meta", ".sigmf-data")])

    def commit(self, messages: list[Written | None]) -> None:
        files, root = store(self.folder)
        written = [pair for m in messages if m is not None for pair in m.files]
        ends = [end for _, end in written]
        if len(set(ends)) != len(ends):
            self.abort(messages)
            raise ValueError("a recording was written by two tasks; use write_recordings")
        if self.overwrite:
            from pyarrow import fs

            for x in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if x.is_file and x.path.endswith((".sigmf-data", ".sigmf-meta")) and not x.base_name.startswith("."):
                    files.delete_file(x.path)
        for temp, end in written:
            files.move(temp, end)
        self._sweep()

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """Removes the job's files that have no final name, those of lost tasks too."""
        from pyarrow import fs

        files, root = store(self.folder)
        for x in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if x.is_file and x.base_name.startswith(".") and f".{self.job}-" in x.base_name:
                files.delete_file(x.path)


class Recordings(DataSource):
    """Options: path or urls, length, candidates (evenly spaced windows a recording), datatype, rangeBytes; to write: datatype, sampleRate."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordingReader:  # noqa: ANN001 - Spark's signature
        return RecordingReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RecordingWriter:  # noqa: ANN001
        return RecordingWriter(dict(self.options), overwrite)


def read_recordings(spark: SparkSession, path: str | None = None, **options: object) -> DataFrame:
    """The windows of all recordings below ``path``, or of ``urls`` (a list). Filters reach the reader."""
    ship(spark)
    spark.dataSource.register(Recordings)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("recordings")
    for k, v in options.items():
        reader = reader.option(k, ",".join(v) if isinstance(v, (list, tuple)) else str(v))
    return reader.load(path) if path is not None else reader.load()


def write_recordings(df: DataFrame, path: str, mode: str = "append", **options: object) -> None:
    """Writes (file, sample_idx, i, q): a recording's rows meet in one task, in the order of sample_idx, and are streamed out."""
    spark = df.sparkSession
    ship(spark)
    spark.dataSource.register(Recordings)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    doubles = lambda c: F.col(c).cast("array<double>").alias(c)
    dealt = df.select("file", "sample_idx", doubles("i"), doubles("q")).repartition(n, "file").sortWithinPartitions("file", "sample_idx")
    writer = dealt.select("file", "i", "q").write.format("recordings").mode(mode)
    for k, v in options.items():
        writer = writer.option(k, str(v))
    writer.save(path)
