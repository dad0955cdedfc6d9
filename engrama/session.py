"""What a session needs: the package on its executors, and durable staging in the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, unless their Python path has it already."""
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root.parent) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name))
    _shipped.add(app)


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that are made inside go at the end, unless they are kept: for operators whose last step is staged with keep."""
    _scratch.append([])
    try:
        yield
    finally:
        for folder in _scratch.pop():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """A write made inside removes its shuffle files once it is done, as nothing reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shared_dir(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a local master gets a temporary one; a cluster must set it.

    Within scratch() the folder goes with it; keep hands it to the scratch() around that, if there is one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, base, True)
        base = f"file://{base}"
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    scopes = _scratch[:-1] if keep else _scratch
    if scopes:
        scopes[-1].append(folder)
    return folder


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and a lost executor costs one read."""
    path = shared_dir(df.sparkSession, name, keep)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
