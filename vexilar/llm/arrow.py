"""Helpers for operators that run in Arrow-batched Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame

from vexilar.session import ship

#: Bytes of text a worker turns into Python objects at once; longer single rows stand alone.
SLICE_BYTES = 4_000_000


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose ``column`` holds (or, if it holds numbers, states) at most ``limit`` bytes, or one row, each."""
    if batch.num_rows == 0:
        return
    held = batch.column(column)
    sizes = pa.compute.fill_null(held if pa.types.is_integer(held.type) else pa.compute.binary_length(held), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for k, n in enumerate(sizes):
        if k > start and held + n > limit:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += int(n)
    yield batch.slice(start)


#: What goes to a worker at once, and what a scan holds at once; Spark's own defaults, 10,000 and 4,096 rows, are tens
#: of MB of text each.
BATCH_ROWS, BATCH_BYTES, SCAN_ROWS = 2_000, 4_000_000, 512


def _small_batches(df: DataFrame) -> None:
    """Bounds the session's Arrow batches and those of Parquet scans, where they are larger."""
    conf = df.sparkSession.conf
    arrow = "spark.sql.execution.arrow"
    for name, most in ((f"{arrow}.maxRecordsPerBatch", BATCH_ROWS), (f"{arrow}.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)):
        now = (conf.get(name, None) or "").rstrip("b")  # None: not set, so Spark's default
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))


#: Of glibc's mallopt: the size from which a block is mapped on its own, and so given back as soon as it is freed.
MMAP_THRESHOLD = -3


def give_back() -> None:
    """Returns what a worker has freed to the system: it is used again, perhaps for something larger."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def map_large_blocks(least: int = 1_000_000) -> None:
    """Keeps freed arrays of this size from staying with a worker, at the cost of some time for each."""
    try:
        ctypes.CDLL("libc.so.6").mallopt(MMAP_THRESHOLD, least)
    except (OSError, AttributeError):
        return


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, column: str, limit: int = SLICE_BYTES) -> DataFrame:
    """``df`` through a function of record batches. make() runs once a task, in the worker, and gives the function.

    limit: bytes of ``column`` that the function gets at once, or one row.
    """

    ship(df.sparkSession)
    _small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch, column, limit):
                yield step(part)
        give_back()

    return df.mapInArrow(run, schema)
