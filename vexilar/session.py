"""Session helpers: a tuned local session, table readers and lineage cuts in shared storage."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package, once an application.

    The package goes to executors as a zip file through Spark. Local workers that find it by their path need none.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    home = Path(__file__).resolve().parent
    path = [Path(p or ".").resolve() for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    if context.master.startswith("local") and home.parent in path:
        return
    out = Path(tempfile.mkdtemp(prefix="vexilar-"), f"{home.name}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    context.addPyFile(str(out))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``, read by Spark itself so that any store works."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset, a session of one process gets a temporary one; a cluster has none to fall back on, since each
    executor would write to its own disk, and is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="vexilar-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/vexilar/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a path through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends in storage that outlives any executor."""
    spark = df.sparkSession
    ship(spark)
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends; else they stay until the driver's heap happens to be collected.

    For rounds that shuffle something each. A frame that is collected again shuffles again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                delete_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder is scratch space
            return
