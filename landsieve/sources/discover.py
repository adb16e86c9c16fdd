"""Finding layer files in ``state/county`` folder trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File types that hold layers.
LAYER_TYPES = ["shp", "geojson", "gpkg", "csv"]


def qualified(spark: SparkSession, path: str) -> str:
    """Absolute URI of a path, without a trailing slash."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(target).toString().rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def list_files(spark: SparkSession, root: str, more: list[str] | None = None) -> DataFrame:
    """All files below ``root``: full path, path below root, name, type. Contents are not read.

    ``more``: ``modificationTime`` or ``length`` as well.
    """
    base = qualified(spark, root)
    below = F.expr(f"substring(path, {len(base) + 2})")
    name = F.element_at(F.split("below", "/"), -1)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", *(more or []))
        .withColumn("below", below)
        .withColumn("name", name)
        .withColumn("ext", F.regexp_extract("name", r"\.([^.]+)$", 1))
        .where(~F.col("name").startswith("."))
    )


def discover_layers(spark: SparkSession, root: str, state: str | None = None) -> DataFrame:
    """Parcel layer files as ``(state, county, path, ext)``.

    ``root`` may hold the states directly or in a ``parcels`` folder. A state with county folders
    uses only those; a state without them is its own county. Folders starting with a dot, and
    folders without any file, do not count.
    """
    nested = f"{root.rstrip('/')}/parcels"
    base = nested if path_exists(spark, nested) else root
    parts = F.split("below", "/")
    files = (
        list_files(spark, base)
        .withColumn("depth", F.size(parts))
        .withColumn("state", parts[0])
        .withColumn("folder", F.when(F.col("depth") >= 3, parts[1]))
        .where((F.col("depth") >= 2) & ~F.col("state").startswith("."))
        .where(F.col("folder").isNull() | ~F.col("folder").startswith("."))
    )
    if state is not None:
        files = files.where(F.col("state") == state)
    layers = files.where(F.col("ext").isin(LAYER_TYPES))
    in_counties = layers.where(F.col("depth") == 3).withColumn("county", F.col("folder"))
    split_states = files.where(F.col("depth") >= 3).select("state").distinct()
    loose = layers.where(F.col("depth") == 2).join(split_states, "state", "left_anti")
    columns = ["state", "county", "path", "ext"]
    return in_counties.select(*columns).unionByName(loose.withColumn("county", F.col("state")).select(*columns))


def discover_named_layers(spark: SparkSession, root: str) -> DataFrame:
    """Layer files at any depth as ``(layer, path, ext)``, the layer being the file stem."""
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    return (
        list_files(spark, root)
        .where(F.col("ext").isin(LAYER_TYPES))
        .select(stem.alias("layer"), "path", "ext")
    )
