"""Session defaults and the shared scratch folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def build_session(app: str = "landsieve", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC times and dynamic partition overwrite."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # Folder names such as 001 are names, not numbers.
        "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="landsieve-package-"), "landsieve")
    archive = shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def spread_small(df: DataFrame, split_bytes: int = 16 * 1024 * 1024) -> DataFrame:
    """Spread a scan that is too small to occupy the cluster over all its cores.

    A small file is one split and so one task, however much work follows. Larger scans already
    have enough splits and are left alone, so nothing large is ever shuffled here.
    """
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    planned = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(parallelism) if planned < parallelism * split_bytes else df


def shared_folder(spark: SparkSession) -> str | None:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting falls back to a temporary folder; on a
    cluster the answer is then ``None``.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not context.master.startswith("local"):
        return None
    if context.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="landsieve-")
    return _LOCAL_ROOTS[context.applicationId]


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes begun here delete their shuffle files when they end.

    Otherwise the files of every step so far stay on the executors' disks until the driver happens to collect its garbage.
    """
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Scratch:
    """Intermediate Parquet tables in the shared folder, dropped together by ``close``.

    A written table survives lost executors, cuts the lineage and stays columnar, so each later
    pass reads only the columns it needs.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = shared_folder(spark)
        self._paths: list[str] = []

    def materialize(self, df: DataFrame, name: str = "step") -> DataFrame:
        """Write ``df`` once and read it back.

        On a cluster that names no shared folder this fails: without one, every consumer would
        compute ``df`` again.
        """
        path = self.new_path(name)
        with freed_shuffles(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def new_path(self, name: str) -> str:
        """A folder of its own, dropped with the others."""
        if self.root is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        self._paths.append(f"{self.root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
        return self._paths[-1]

    def close(self) -> None:
        for path in self._paths:
            delete_path(self.spark, path)
        self._paths.clear()

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *exc) -> None:
        self.close()


_LASTING: list[Scratch] = []


def lasting_scratch(spark: SparkSession) -> Scratch:
    """A scratch folder for results that are read after the call that made them; it is dropped when the application ends."""
    _LASTING.append(Scratch(spark))
    return _LASTING[-1]


@atexit.register
def _close_lasting() -> None:
    for scratch in _LASTING:
        try:
            scratch.close()
        except Exception:  # noqa: BLE001  the JVM has gone already
            return


def delete_path(spark: SparkSession, path: str) -> bool:
    """Remove a file or folder through the Hadoop file system that owns it."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.delete(target, True)
