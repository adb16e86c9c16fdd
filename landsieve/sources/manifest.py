"""A table of parcels that is renewed county by county, under a manifest that changes as a whole.

``data/batch=<id>/state=<s>/county=<c>`` holds the rows of one load of one county and never changes.
``manifest/v=<n>`` names the batch that counts for each county, with a digest of the files it came from, and the
columns. Readers take the newest version; a load that is cut off leaves the one before.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import delete_path
from .discover import discover_layers, list_files, path_exists

ENTRIES = "state string, county string, digest string, batch string, n long"
KEY = ["state", "county"]


class Outpaced(RuntimeError):
    """Another load has put its version first; the load can be run again."""


def folder_digests(spark: SparkSession, root: str, state: str | None = None, salt: str = "") -> DataFrame:
    """state, county, digest of the names, sizes and times of all files beside its layer files; no file is opened.

    A file that changes without a new size or time (to the millisecond) goes unnoticed. ``salt``: whatever else the
    rows depend on; another salt makes every county count as changed.
    """
    folder = F.regexp_replace("path", "/[^/]*$", "")
    nested = f"{root.rstrip('/')}/parcels"
    base = nested if path_exists(spark, nested) else root
    files = list_files(spark, base, ["modificationTime", "length"]).withColumn("folder", folder)
    stamp = F.concat_ws("\n", "name", F.col("length").cast("string"), F.unix_millis("modificationTime").cast("string"))
    # Sums do not depend on the order of files, and need no list of them.
    digest = files.groupBy("folder").agg(F.count("*").alias("n"), F.sum(F.xxhash64(stamp).cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), stamp)).alias("b"))
    places = discover_layers(spark, root, state).withColumn("folder", folder).select(*KEY, "folder").distinct()
    parts = places.join(digest, "folder").groupBy(*KEY).agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.bit_xor("b").alias("b"))
    return parts.select(*KEY, F.sha2(F.concat_ws(",", "n", "a", "b", F.lit(salt)), 256).alias("digest"))


class CountyTable:
    """``path``: folder of the table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        return path_exists(spark, f"{path.rstrip('/')}/manifest")

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _listed(self, pattern: str) -> list[str]:
        target = self._hadoop(f"{self.path}/{pattern}")
        found = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(target)
        return [f.getPath().toString() for f in found or []]

    def version(self) -> int:
        """Number of the newest version; 0 without one."""
        return max((int(p.rsplit("=", 1)[1]) for p in self._listed("manifest/v=*")), default=0)

    def entries(self, version: int | None = None) -> DataFrame:
        """One row a county: its digest, batch and number of rows."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], ENTRIES)
        return self.spark.read.schema(ENTRIES).json(f"{self.path}/manifest/v={version}/counties")

    def schema(self, version: int | None = None) -> T.StructType:
        """Columns of all batches of a version, without state and county."""
        version = self.version() if version is None else version
        if not version:
            return T.StructType([])
        text = self.spark.read.text(f"{self.path}/manifest/v={version}/schema", wholetext=True).first()[0]
        return T.StructType.fromJson(json.loads(text))

    def read(self, state: str | None = None, county: str | None = None) -> DataFrame:
        """Rows of the newest version, or of one state or county of it; other folders are not listed."""
        version = self.version()
        entries = self.entries(version).where("n > 0")
        for name, value in (("state", state), ("county", county)):
            entries = entries if value is None else entries.where(F.col(name) == value)
        folders = [self._folder(r["batch"], r["state"], r["county"]) for r in entries.collect()]  # a row for each county
        keys = T.StructType([T.StructField(c, T.StringType()) for c in ("batch", *KEY)])
        schema = T.StructType([*self.schema(version).fields, *keys.fields])
        if not folders:
            return self.spark.createDataFrame([], schema).drop("batch")
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*folders).drop("batch")

    def _folder(self, batch: str, state: str, county: str) -> str:
        named = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        return f"{self.path}/data/batch={batch}/{named('state', state)}/{named('county', county)}"

    def changes(self, digests: DataFrame, state: str | None = None) -> DataFrame:
        """state, county, change ("new", "changed", "removed" or "same") against the newest version.

        With ``state`` the counties of other states are left out: nothing is said about them.
        """
        known = self.entries().select(*KEY, F.col("digest").alias("before"))
        known = known if state is None else known.where(F.col("state") == state)
        change = (
            F.when(F.col("before").isNull(), "new").when(F.col("digest").isNull(), "removed")
            .when(F.col("digest") != F.col("before"), "changed").otherwise("same")
        )
        return digests.join(known, KEY, "full").select(*KEY, "digest", change.alias("change"))

    def commit(self, rows: DataFrame, changes: DataFrame, max_records_per_file: int = 5_000_000) -> int:
        """Write the rows of new and changed counties and put the next version in force; returns its number.

        ``changes`` as ``changes`` gives it, written down before. Counties that it does not name stay as
        they are. Raises ``Outpaced`` when another load was first.
        """
        before, batch = self.version(), uuid.uuid4().hex
        columns = T.StructType([f for f in rows.schema.fields if f.name not in KEY])
        known = {f.name: f for f in self.schema(before).fields}
        for field in columns.fields:
            if field.name in known and known[field.name].dataType != field.dataType:
                raise ValueError(f"column {field.name} was {known[field.name].dataType.simpleString()}, is {field.dataType.simpleString()}")
        merged = T.StructType([*known.values(), *[f for f in columns.fields if f.name not in known]])
        folder = f"{self.path}/data/batch={batch}"
        (
            rows.hint("rebalance", F.col("state"), F.col("county"))
            .write.option("maxRecordsPerFile", max_records_per_file).partitionBy(*KEY).parquet(folder)
        )
        keys = T.StructType([*columns.fields, *[T.StructField(c, T.StringType()) for c in KEY]])
        counts = self.spark.read.schema(keys).parquet(folder).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        fresh = changes.where("change IN ('new', 'changed')").join(counts, KEY, "left")
        fresh = fresh.select(*KEY, "digest", F.lit(batch).alias("batch"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
        gone = changes.where("change != 'same'").select(*KEY)
        stays = self.entries(before).join(gone, KEY, "left_anti").select(*fresh.columns)
        staged = f"{self.path}/.staged-{batch}"
        stays.unionByName(fresh).coalesce(1).write.json(f"{staged}/counties")  # a row for each county
        self.spark.createDataFrame([(merged.json(),)], "value string").coalesce(1).write.text(f"{staged}/schema")
        self._put(staged, before + 1)
        return before + 1

    def _put(self, staged: str, version: int) -> None:
        """Rename to a name that must be free, which file systems do for one caller only."""
        jvm = self.spark._jvm
        source, target = self._hadoop(staged), self._hadoop(f"{self.path}/manifest/v={version}")
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(source), fs.makeQualified(target), options)
        except Exception as problem:
            fs.delete(source, True)
            if fs.exists(target):
                raise Outpaced(f"version {version} of {self.path} was put by another load") from problem
            raise

    def drop_unused(self) -> int:
        """Delete older versions, and the data that the newest one does not name; returns how many county folders went.

        Not to be run while a load or a reader of an older version is at work.
        """
        version = self.version()
        used = {self._folder(r["batch"], r["state"], r["county"]).removeprefix(f"{self.path}/") for r in self.entries(version).collect()}  # a row for each county
        dropped = 0
        for path in self._listed("data/batch=*/state=*/county=*"):
            below = path[path.rindex("/data/batch=") + 1 :]
            if below not in used:
                dropped += bool(delete_path(self.spark, path))
        old = [p for p in self._listed("manifest/v=*") if int(p.rsplit("=", 1)[1]) < version]
        for path in [*old, *self._listed(".staged-*")]:
            delete_path(self.spark, path)
        return dropped
