"""Loading parcel files and auxiliary layers, and checking their schema."""

from __future__ import annotations

import logging
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import with_envelope
from ..operators.catalog import county_counts
from ..operators.skew import lookup_join
from ..operators.standardize import apply_aliases, cast_parcels, normalize_geometry, schema_report, standardize
from ..schema import COLUMN_ALIASES, PARCEL_COLUMNS
from ..session import Scratch
from ..sources.discover import discover_layers, discover_named_layers, list_files, path_exists
from ..sources.readers import PROBLEM, SOURCE, WKT_COLUMNS, file_columns, file_headers, read_layer, read_layers, read_parcel_table
from ..sources.manifest import CountyTable, folder_digests
from ..sources.sinks import write_parcels, write_schema_report
from .enrichment import Enrichment, enrich

log = logging.getLogger(__name__)

# Attributes by which parcels are screened besides the standard ones; the distances are numbers.
ENRICHMENT = ("et_distance", "et_kv", "et_operator", "est_operator", "hwy_distance")
MEASURES = ("et_distance", "hwy_distance")


def load_parcels(
    spark: SparkSession, root: str, scratch: Scratch, state: str | None = None, require_geometry: bool = True,
    keep: tuple[str, ...] = ENRICHMENT, only: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Standardised, typed parcels of every file below ``root``, and the files and records left out with the reason.

    ``require_geometry`` leaves out CSV files without shapes and files whose shapes are all empty. ``keep``: columns outside the standard
    ones that are kept where files have them, such as those by which parcels are screened. Records are written down once,
    so that the files are read once for both results. ``only``: (state, county) of the counties to load.
    """
    found = discover_layers(spark, root, state)
    found = found if only is None else found.join(only, ["state", "county"], "left_semi")
    files = scratch.materialize(found, "files")
    headers = scratch.materialize(file_headers(spark, files), "headers")
    wanted = [*PARCEL_COLUMNS, *[c for c in COLUMN_ALIASES if COLUMN_ALIASES[c] in PARCEL_COLUMNS], *[c for c in keep if c not in PARCEL_COLUMNS]]
    texts = F.arrays_overlap("columns", F.array(*map(F.lit, WKT_COLUMNS)))
    bare = (F.col("ext") == "csv") & ~F.coalesce(texts, F.lit(False)) if require_geometry else F.lit(False)
    present = _present(headers.where(~bare), wanted)
    records = scratch.materialize(read_layers(spark, headers.where(~bare), present, require_geometry, "report"), "records")
    rows = records.where(F.col(PROBLEM).isNull()).drop(PROBLEM)
    rows = rows.select(SOURCE, *[F.col(c) if c in present else F.lit(None).cast("string").alias(c) for c in wanted], "geom_wkb", "srid")
    # One row per file; its folder names are the partition, next to the county attribute. Files without a single shape are left out.
    places = files.select(_plain("path").alias("_file"), F.col("state").alias("_state"), F.col("county").alias("_folder"))
    counted = normalize_geometry(rows) if require_geometry else rows
    sources = counted.select(SOURCE).distinct().withColumn("_file", _plain(SOURCE))
    sources = scratch.materialize(sources.join(places, "_file").select(SOURCE, "_state", "_folder"), "sources")
    placed = lookup_join(rows, sources, [SOURCE], "inner", present[:4])
    kept = [c for c in keep if c not in PARCEL_COLUMNS]
    typed = cast_parcels(standardize(apply_aliases(placed), keep=["_state", "_folder", *kept]))
    typed = typed.withColumns({c: F.expr(f"try_cast({c} AS DOUBLE)") for c in kept if c in MEASURES})
    parcels = with_envelope(typed)
    problems = headers.where(F.col("error").isNotNull()).select("path", "error")
    problems = problems.unionByName(records.where(F.col(PROBLEM).isNotNull()).select(F.col(SOURCE).alias("path"), F.col(PROBLEM).alias("error")))
    if require_geometry:
        shaped = records.where(F.col("geom_wkb").isNotNull()).select(SOURCE).distinct().select(_plain(SOURCE).alias("_file"))  # a row for each file at most
        readable = headers.where(F.col("error").isNull()).select("path", _plain("path").alias("_file"))
        problems = problems.unionByName(readable.join(shaped, "_file", "left_anti").select("path", F.lit("no geometry").alias("error")))
    return parcels, problems


def _present(headers: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted columns that some file has; all of them where files other than CSV are among these, whose headers need not name every column."""
    readable = headers.where(F.col("error").isNull())
    if not readable.where("ext <> 'csv'").isEmpty():
        return wanted
    names = readable.select(F.explode("columns").alias("name")).where(F.col("name").isin(wanted)).distinct()
    found = {r["name"] for r in names.collect()}  # as many as are wanted, at most
    return [c for c in wanted if c in found] or wanted


def _plain(path: str):
    """Paths come as ``file:/x`` and ``file:///x``, encoded or not; compare them in one form."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(F.col(path), r"\+", "%2B"), r"^file:/+", "file:/"))


def load_all(
    spark: SparkSession, root: str, out: str, scratch: Scratch, state: str | None = None, scripts: str | None = None,
    layer_folders: tuple[str, ...] = ("other_gis", "rextag"), enrichment: Enrichment | None = Enrichment(), changed_only: bool = False,
) -> DataFrame:
    """Load auxiliary layers and parcels below ``root`` into tables below ``out``; returns rows per county.

    Layers go to ``out/<folder>/<layer>``. Parcels are enriched by the layers that ``enrichment`` names and go to
    ``out/parcels``; what was left out goes to ``out/problems``. SQL scripts, if any, then run over views of the written tables.

    ``changed_only`` makes ``out/parcels`` a ``CountyTable``: only counties whose files have changed, or all when a
    layer that enriches them has, are read and written; counties without files leave the table. Either form of
    table stays what it is; ``out/problems`` then tells of the counties that were read.
    """
    target = f"{out.rstrip('/')}/parcels"
    if path_exists(spark, target) and CountyTable.exists(spark, target) != changed_only:
        raise ValueError(f"{target} was written {'without' if changed_only else 'with'} a manifest; load into another folder")
    layers: dict[str, DataFrame] = {}
    for folder in layer_folders:
        source = f"{root.rstrip('/')}/{folder}"
        if not path_exists(spark, source):
            log.warning("no folder %s", source)
            continue
        for name in load_layers(spark, source, f"{out.rstrip('/')}/{folder}")[0]:
            layers[name] = spark.read.parquet(f"{out.rstrip('/')}/{folder}/{name}")
            layers[name].createOrReplaceTempView(name)
    changes = None
    if changed_only:
        sources = [f"{root.rstrip('/')}/{folder}" for folder in layer_folders]
        digests = folder_digests(spark, root, state, _layers_stamp(spark, [s for s in sources if path_exists(spark, s)], enrichment))
        changes = scratch.materialize(CountyTable(spark, target).changes(digests, state), "changes")
        if changes.where("change != 'same'").isEmpty():
            log.info("no county has changed")
            CountyTable(spark, target).read().createOrReplaceTempView("parcels")
            if scripts is not None:
                run_sql_steps(spark, scripts)
            return county_counts(CountyTable(spark, target).read())
    only = None if changes is None else changes.where("change IN ('new', 'changed')").select("state", "county")
    parcels, problems = load_parcels(spark, root, scratch, state, only=only)
    if enrichment is not None:
        shaped = {name: layer for name, layer in layers.items() if "geom_wkb" in layer.columns}
        parcels = enrich(parcels, shaped, enrichment, scratch)
    # The county attribute stays available as ``county_name``; the folder is the partition.
    partition = {"county": "county_name", "_state": "state", "_folder": "county"}
    for old, new in partition.items():
        parcels = parcels.withColumnRenamed(old, new)
    if changes is None:
        write_parcels(parcels, target)
    else:
        CountyTable(spark, target).commit(parcels, changes)
    problems.write.mode("overwrite").json(f"{out.rstrip('/')}/problems")
    written = read_parcel_table(spark, target)
    written.createOrReplaceTempView("parcels")
    if scripts is not None:
        run_sql_steps(spark, scripts)
    return county_counts(written)


def _layers_stamp(spark: SparkSession, folders: list[str], enrichment: Enrichment | None) -> str:
    """Names, sizes and times of the layer files that parcels are enriched by, and how."""
    if enrichment is None:
        return "none"
    names = [enrichment.lines, enrichment.roads, enrichment.substations]
    stamps = []
    for folder in folders:
        files = list_files(spark, folder, ["modificationTime", "length"])
        used = files.where(F.substring_index("name", ".", 1).isin(names))  # a layer's files, up to six of them
        stamps += [f"{r['below']} {r['length']} {r['at']}" for r in used.select("below", "length", F.unix_millis("modificationTime").alias("at")).collect()]
    return "\n".join([repr(enrichment), *sorted(stamps)])


def load_layers(spark: SparkSession, root: str, out: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every layer file below ``root`` by its stem, and the files that could not be read.

    Of several files with one stem the last in path order counts. With ``out`` each layer is
    written to ``out/<name>``, replacing what was there.
    """
    layers: dict[str, DataFrame] = {}
    problems: list[tuple[str, str]] = []
    for row in discover_named_layers(spark, root).orderBy("path").collect():  # one row per layer file
        try:
            layer = read_layer(spark, row["path"])
            if "geom_wkb" in layer.columns and "id" not in layer.columns:  # spatial joins tell rows of a layer apart by it
                layer = layer.withColumn("id", F.monotonically_increasing_id())
            if out is not None:
                target = f"{out.rstrip('/')}/{row['layer']}"
                layer.write.mode("overwrite").parquet(target)
                layer = spark.read.parquet(target)
            layers[row["layer"]] = layer
        except Exception as problem:  # a bad file is reported, the rest continue
            log.error("layer %s: %s", row["path"], problem)
            problems.append((row["path"], f"{type(problem).__name__}: {problem}"))
    return layers, spark.createDataFrame(problems, "path string, error string")


def schema_check(
    spark: SparkSession, root: str, out: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compliance of every file below ``root`` with the standard schema; writes only the report.

    A file that cannot be opened counts as having no columns.
    """
    files = discover_layers(spark, root)
    headers = file_headers(spark, files)
    columns = file_columns(spark, headers).select(_plain("path").alias("path_"), "columns")
    described = (
        files.withColumn("path_", _plain("path"))
        .join(columns, "path_", "left")
        .select(
            "state", "county", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("path").alias("file_path"),
            F.coalesce("columns", F.array().cast("array<string>")).alias("columns"),
        )
    )
    report = schema_report(described)
    if out is not None:
        write_schema_report(report, out)
    return report


_STATEMENT = re.compile(r"""(?:'(?:[^'\\]|\\.|'')*'|"[^"]*"|`[^`]*`|--[^\n]*|/\*.*?\*/|[^;])+""", re.S)


def split_statements(text: str) -> list[str]:
    """Statements of a script; semicolons in quotes and comments do not count."""
    parts = (m.group().strip() for m in _STATEMENT.finditer(text))
    bare = lambda s: re.sub(r"--[^\n]*|/\*.*?\*/", "", s, flags=re.S).strip()
    return [p for p in parts if bare(p)]


def run_sql_steps(spark: SparkSession, folder: str) -> list[tuple[str, str | None]]:
    """Run the ``.sql`` files of a folder in name order, stopping at the first failure.

    Returns each file that was started with its error, or None.
    """
    scripts = list_files(spark, folder).where((F.col("ext") == "sql") & ~F.col("below").contains("/"))
    done: list[tuple[str, str | None]] = []
    for row in scripts.orderBy("name").collect():  # one row per script
        text = spark.read.text(row["path"], wholetext=True).head()
        try:
            for statement in split_statements(text["value"] if text else ""):
                spark.sql(statement)
            done.append((row["name"], None))
        except Exception as problem:
            log.error("script %s: %s", row["name"], problem)
            done.append((row["name"], str(problem)))
            break
    return done
