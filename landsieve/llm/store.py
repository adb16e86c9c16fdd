"""Intermediate tables in the shared folder, and reading texts out of Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, freed_shuffles, ship_package

_LOCAL: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only in local mode, where all share it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault(context.applicationId, tempfile.mkdtemp(prefix="landsieve-llm-"))


class Store:
    """Tables written once and read back: they cut the lineage and outlive lost executors.

    A result may read its tables long after the call that made it, so they stay until the
    application ends, or until ``drop``.
    """

    def __init__(self, spark: SparkSession):
        ship_package(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/llm-{uuid.uuid4().hex}"
        _WRITTEN.append((spark, self.root))
        self._tables = 0
        self._named: dict[str, list[str]] = {}

    def path(self, name: str) -> str:
        self._tables += 1
        path = f"{self.root}/{self._tables}-{name}"
        self._named.setdefault(name, []).append(path)
        return path

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with freed_shuffles(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def discard(self, name: str) -> None:
        """Delete the tables of that name, whose readers have all been written themselves."""
        for path in self._named.pop(name, []):
            delete_path(self.spark, path)

    def drop(self) -> None:
        delete_path(self.spark, self.root)


@atexit.register
def _drop_all() -> None:
    for spark, root in _WRITTEN:
        try:
            delete_path(spark, root)
        except Exception:  # noqa: BLE001  the JVM has gone already
            return


def whole_text(column: str | Column) -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in short slices, so that only few texts at a time are Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
