"""Reading parcel and auxiliary layers of all supported file types.

Headers are read by a small Spark job. Shapefiles and GeoPackages are then cut into ranges of
records and the ranges are spread over the cluster, so one large file is read by many tasks; so is
GeoJSON and CSV, by byte ranges (``geojson``, ``csv_ranges``).

Records that cannot be read fail the read, are left out, or are reported: ``on_error`` is "raise",
"skip" or "report". With "report" there is a column ``read_error``, and a row with nothing but its file and the error for each such record.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import DEFAULT_SRID, checked_geojson, parse_wkt, with_envelope
from ..operators.standardize import quoted
from . import vector_files as vf
from .csv_ranges import RANGE_BYTES, csv_records
from .geojson import geojson_records
from .manifest import CountyTable

SLICE_RECORDS = 20_000
MAX_SLICES = 10_000
# Name of the file a record came from ("path" is a parcel attribute).
SOURCE = "source_file"
PROBLEM = "read_error"
# CSV columns taken for well-known text, first match wins.
WKT_COLUMNS = ["wkt", "geom_wkt", "geom", "geometry", "the_geom"]
HEADER_SCHEMA = "path string, ext string, columns array<string>, first long, last long, srid int, has_geometry boolean, error string"


def _paths_frame(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    if isinstance(paths, DataFrame):
        return paths.select("path", "ext")
    return spark.createDataFrame([(p, p.rsplit(".", 1)[-1].lower()) for p in paths], "path string, ext string")


def _read_headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, ext in zip(batch["path"], batch["ext"]):
            try:
                if ext == "geojson":
                    rows.append((path, ext, None, None, None, None, vf.geojson_has_geometry(path), None))
                else:
                    h = vf.HEADERS[ext](path)
                    rows.append((path, ext, h.columns, h.first, h.last, h.srid, h.has_geometry, None))
            except Exception as problem:  # a bad file is reported, the others go on
                rows.append((path, ext, None, None, None, None, None, f"{type(problem).__name__}: {problem}"))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in HEADER_SCHEMA.split(", ")])
        yield out.astype({"first": "Int64", "last": "Int64", "srid": "Int32", "has_geometry": "object"})


def file_headers(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """Per file: columns, record range, SRID, and the error if it cannot be opened."""
    files = _paths_frame(spark, paths)
    return files.repartition(spark.sparkContext.defaultParallelism * 4).mapInPandas(_read_headers, HEADER_SCHEMA)


def by_error(rows: DataFrame, on_error: str) -> DataFrame:
    """Rows with a ``read_error`` column, treated as ``on_error`` says."""
    if on_error == "report":
        return rows
    if on_error == "skip":
        return rows.where(F.col(PROBLEM).isNull()).drop(PROBLEM)
    checked = F.when(F.col(PROBLEM).isNotNull(), F.raise_error(F.concat(F.col(SOURCE), F.lit(": "), F.col(PROBLEM))).cast("string"))
    return rows.withColumn(PROBLEM, checked).where(F.col(PROBLEM).isNull()).drop(PROBLEM)


def _geojson_features(spark: SparkSession, paths: list[str], properties: T.DataType) -> DataFrame:
    """source_file, geometry, properties, read_error of every record that is a feature or should be one."""
    feature = T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("geometry", T.StringType()),
        T.StructField("properties", properties),
        T.StructField("_corrupt", T.StringType()),
    ])
    parsed = geojson_records(spark, paths).withColumn("f", F.from_json("text", feature, {"columnNameOfCorruptRecord": "_corrupt"}))
    at = F.concat(F.lit(" at byte "), F.col("place").cast("string"))
    is_feature = F.coalesce(F.col("f.type") == "Feature", F.lit(False)) & F.col("f._corrupt").isNull()
    error = F.when(F.col("error").isNotNull(), F.concat("error", at)).when(F.col("f._corrupt").isNotNull(), F.concat(F.lit("malformed record"), at)).when(~is_feature, F.concat(F.lit("not a feature"), at))
    # Other members of the root, such as its reference system, hold objects as well; they carry no feature's parts.
    other = ~is_feature & F.col("error").isNull() & F.col("f._corrupt").isNull() & F.col("f.geometry").isNull() & F.col("f.properties").isNull()
    rows = parsed.where(~other).withColumn(PROBLEM, error)
    good = F.col(PROBLEM).isNull()
    return rows.select(SOURCE, F.when(good, F.col("f.geometry")).alias("geometry"), F.when(good, F.col("f.properties")).alias("properties"), PROBLEM)


def read_geojson(spark: SparkSession, paths: list[str], columns: list[str], on_error: str = "raise") -> DataFrame:
    """GeoJSON features of any layout: ``source_file``, the named properties as text, ``geom_wkb`` and ``srid``.

    A record that does not parse, and a geometry that is none, is a record that cannot be read.
    """
    wanted = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = _geojson_features(spark, paths, wanted).withColumn("shape", checked_geojson("geometry"))
    failed = F.coalesce(PROBLEM, "shape.error")
    rows = rows.select(
        SOURCE, *[F.when(failed.isNull(), F.col("properties").getField(c)).alias(c) for c in columns],
        F.when(failed.isNull(), F.col("shape.geom_wkb")).alias("geom_wkb"), F.lit(DEFAULT_SRID).alias("srid"), failed.alias(PROBLEM),
    )
    return by_error(rows, on_error)


def geojson_columns(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Property names per file in order of appearance, as ``(path, columns)``."""
    rows = _geojson_features(spark, paths, T.MapType(T.StringType(), T.StringType())).where(F.col(PROBLEM).isNull())
    keys = rows.select(SOURCE, F.posexplode(F.map_keys("properties")).alias("pos", "key"))
    return (
        keys.groupBy(SOURCE, "key")
        .agg(F.min("pos").alias("pos"))
        .groupBy(SOURCE)
        .agg(F.sort_array(F.collect_list(F.struct("pos", "key"))).alias("found"))
        .select(F.col(SOURCE).alias("path"), F.transform("found", lambda f: f["key"]).alias("columns"))
    )


def read_binary_layer(spark: SparkSession, headers: DataFrame, columns: list[str], on_error: str = "raise") -> DataFrame:
    """Shapefile and GeoPackage records: ``source_file``, the named attributes as text, ``geom_wkb``, ``srid``.

    ``headers`` comes from ``file_headers``. A damaged record costs itself alone.
    """
    schema = T.StructType(
        [T.StructField(SOURCE, T.StringType())]
        + [T.StructField(c, T.StringType()) for c in columns]
        + [T.StructField("geom_wkb", T.BinaryType()), T.StructField("srid", T.IntegerType()), T.StructField(PROBLEM, T.StringType())]
    )
    # Sparse row ids make wider ranges, never more than MAX_SLICES of them.
    width = F.ceil((F.col("last") - F.col("first") + 1) / F.lit(MAX_SLICES))
    step = F.greatest(F.lit(SLICE_RECORDS), width).cast("long")
    slices = (
        headers.where(F.col("ext").isin(list(vf.ROWS)) & F.col("error").isNull() & (F.col("last") >= F.col("first")))
        .withColumn("step", step)
        .withColumn("start", F.explode(F.sequence("first", "last", "step")))
        .withColumn("stop", F.least(F.col("start") + F.col("step") - 1, F.col("last")))
        .select("path", "ext", "start", "stop")
        .repartition(spark.sparkContext.defaultParallelism * 4)
    )
    names = schema.names

    def records(path: str, ext: str, header, start: int, stop: int) -> list[tuple]:
        rows = vf.ROWS[ext](path, header, start, stop)
        return [(path, *[properties.get(c) for c in columns], geometry, header.srid, None) for properties, geometry in rows]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, ext, start, stop in batch.itertuples(index=False):
                def failed(problem: Exception, at: str, path: str = path) -> tuple:
                    return path, *[None] * (len(columns) + 2), f"{type(problem).__name__}: {problem}{at}"

                try:
                    header = vf.HEADERS[ext](path)
                    rows = records(path, ext, header, int(start), int(stop))
                except Exception:  # the slice is read again, record by record
                    rows = []
                    for at in range(int(start), int(stop) + 1):
                        try:
                            header = vf.HEADERS[ext](path) if at == int(start) else header
                            rows += records(path, ext, header, at, at)
                        except Exception as problem:  # noqa: BLE001  whatever the record makes the decoder do
                            rows.append(failed(problem, f" at record {at}"))
                yield pd.DataFrame(rows, columns=names).astype({"srid": "Int32"})

    return by_error(slices.mapInPandas(read, schema), on_error)


def read_csv_layer(
    spark: SparkSession, paths: list[str], header: list[str], columns: list[str], require_geometry: bool = False,
    on_error: str = "raise", range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """CSV files sharing one header: ``source_file``, the named columns as text, ``geom_wkb``, ``srid``.

    Quoted cells may hold line breaks, as legal descriptions do; files are read in byte ranges all the same
    (``csv_ranges``). Cells missing at the end of a record are NULL, surplus ones are dropped.

    A well-known text column becomes the geometry. Without one the geometry is NULL, or the files
    yield nothing when ``require_geometry`` is set.
    """
    wkt = next((c for c in WKT_COLUMNS if c in header), None)
    places = [f"c{i}" for i in range(len(header))]
    cells = ", ".join(f"{c} string" for c in places)
    records = csv_records(spark, paths, range_bytes)
    if wkt is None and require_geometry:
        records = records.limit(0)
    parsed = records.withColumn("cells", F.from_csv("text", cells, {"escape": '"', "maxCharsPerColumn": "-1"}))
    cell = {name: F.col(f"cells.{place}") for name, place in zip(header, places)}
    shape = parse_wkt(cell[wkt]) if wkt else F.lit(None).cast("struct<geom_wkb:binary,srid:int>")
    named = [(cell[c] if c in cell else F.lit(None).cast("string")).alias(c) for c in columns]
    rows = parsed.select(SOURCE, *named, shape.alias("_shape"), F.concat("error", F.lit(" at byte "), F.col("place").cast("string")).alias(PROBLEM))
    return by_error(rows.select(SOURCE, *map(quoted, columns), "_shape.geom_wkb", "_shape.srid", PROBLEM), on_error)


def union_rows(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def read_layers(
    spark: SparkSession, headers: DataFrame, columns: list[str], require_geometry: bool = False, on_error: str = "raise"
) -> DataFrame:
    """All readable files of any type in one frame: ``source_file``, the named columns, ``geom_wkb``, ``srid``.

    Files are grouped by type, and CSV files by header, so the number of scans follows the number
    of distinct layouts rather than the number of files.
    """
    usable = headers.where(F.col("error").isNull())
    # One row per file, not per record.
    texts = usable.where(F.col("ext").isin("csv", "geojson")).select("path", "ext", "columns").collect()
    frames = [read_binary_layer(spark, usable, columns, on_error)]
    by_header: dict[tuple, list[str]] = {}
    for row in texts:
        if row["ext"] == "csv":
            by_header.setdefault(tuple(row["columns"]), []).append(row["path"])
    for header, paths in by_header.items():
        frames.append(read_csv_layer(spark, paths, list(header), columns, require_geometry, on_error))
    if shaped := [row["path"] for row in texts if row["ext"] == "geojson"]:
        frames.append(read_geojson(spark, shaped, columns, on_error))
    return union_rows(frames)


def file_columns(spark: SparkSession, headers: DataFrame) -> DataFrame:
    """``(path, columns)`` of every readable file; files with shapes list ``geometry`` last."""
    spatial = F.col("ext") != "csv"
    listed = F.when(spatial, F.array_append("columns", F.lit("geometry"))).otherwise(F.col("columns"))
    plain = headers.where((F.col("ext") != "geojson") & F.col("error").isNull()).select("path", listed.alias("columns"))
    paths = [r["path"] for r in headers.where((F.col("ext") == "geojson") & F.col("error").isNull()).select("path").collect()]  # a row for each file
    if paths:
        found = geojson_columns(spark, paths)
        plain = plain.unionByName(found.withColumn("columns", F.array_append("columns", F.lit("geometry"))))
    return plain


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """One layer with its own columns as text, plus the geometry columns when it has shapes."""
    headers = file_headers(spark, [path])
    head = headers.first()
    if head["error"]:
        raise ValueError(f"{path}: {head['error']}")
    columns = head["columns"]
    if head["ext"] == "geojson":
        found = geojson_columns(spark, [path]).first()
        columns = found["columns"] if found else []
    rows = read_layers(spark, headers, columns).drop(SOURCE)
    if head["ext"] == "csv" and not any(c in columns for c in WKT_COLUMNS):
        return rows.drop("geom_wkb", "srid")
    return with_envelope(rows)


# --- tables --------------------------------------------------------------------------------------

def read_parcel_table(spark: SparkSession, path: str) -> DataFrame:
    """All parcels of a table, with a manifest or without."""
    return CountyTable(spark, path).read() if CountyTable.exists(spark, path) else spark.read.parquet(path)


def read_parcels(spark: SparkSession, path: str, state: str, county: str | None = None) -> DataFrame:
    """Parcels of a county, or of all counties of a state; only those partitions are read."""
    if CountyTable.exists(spark, path):
        return CountyTable(spark, path).read(state, county)
    parcels = spark.read.parquet(path).where(F.col("state") == state)
    return parcels if county is None else parcels.where(F.col("county") == county)


def read_results(spark: SparkSession, path: str, key, run_ts: str | None = None) -> DataFrame:
    """One result snapshot, by partition pruning; the newest one when no run is named."""
    results = spark.read.parquet(path)
    for name, value in key.columns().items():
        results = results.where(F.col(name) == value)
    if run_ts is None:
        run_ts = results.agg(F.max(F.col("run_ts").cast("string"))).first()[0]
    return results.where(F.col("run_ts").cast("string") == F.lit(run_ts))
