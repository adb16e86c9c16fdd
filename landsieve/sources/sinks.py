"""Writers: partitioned tables, ranking exports, run reports and map features."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import as_geojson
from ..functions.scalar import rank_band, sanitize_name
from ..operators.catalog import RUN_KEYS
from ..operators.scoring import RANK
from ..operators.stats import order_by_rank, ranking_stats, top_n
from ..session import delete_path

if TYPE_CHECKING:
    from ..plans.site_selection import Settings

# Columns of the ranking export, and the ones each method adds.
EXPORT_COLUMNS = [
    "parcelnumb", RANK, "{score}", "zoning_type", "zoning_subtype", "lbcs_site_desc", "fema_nri_risk_rating",
    "fema_flood_zone", "fema_flood_zone_subtype", "gisacre", "drive_time", "et_distance", "hwy_distance",
]
METHOD_COLUMNS = {
    "MCDA": [
        "zoning_score", "site_score", "nri_score", "flood_score", "size_score", "drive_score", "transmission_score",
    ],
    "MCO": ["size_score", "distance_score", "risk_score", "zoning_score"],
}
# Properties shown for a parcel on the map.
POPUP_COLUMNS = [
    "parcelnumb", RANK, "zoning_type", "zoning", "zoning_description", "zoning_code_link", "lbcs_activity_desc",
]


@dataclass(frozen=True)
class RunKey:
    """What a result snapshot belongs to; no county means all counties of the state."""

    state: str
    county: str | None = None
    provider: str | None = None

    def columns(self) -> dict[str, Column]:
        return {
            "state": F.lit(self.state),
            "county": F.lit(self.county or "all_counties"),
            "provider": sanitize_name(F.lit(self.provider).cast("string")),
        }


def run_stamp(moment: datetime | None = None) -> str:
    return (moment or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")


def without_nulls(df: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` without the columns, but for those ``needed``, that its plan knows to be NULL in every row, and what puts them back in place.

    Of some 160 standard columns files often have a few; the others cost as much at each step as those that are filled.
    """
    plan, nulls = df._jdf.queryExecution().optimizedPlan(), set()
    if plan.nodeName() == "Project":
        listed = plan.projectList()
        for i in range(listed.size()):
            child = listed.apply(i).children().headOption() if listed.apply(i).nodeName() == "Alias" else None
            if child is not None and child.get().nodeName() == "Literal" and child.get().value() is None:
                nulls.add(listed.apply(i).name())
    nulls -= set(needed)
    if not nulls or len(set(df.columns)) < len(df.columns):
        return df, lambda other: other
    names, kinds = df.columns, {f.name: f.dataType for f in df.schema.fields}

    def whole(other: DataFrame) -> DataFrame:
        put = [F.lit(None).cast(kinds[c]).alias(c) if c in nulls else F.col(f"`{c}`") for c in names]
        return other.select(*put, *[F.col(f"`{c}`") for c in other.columns if c not in kinds])

    return df.drop(*nulls), whole


def write_parcels(df: DataFrame, path: str, max_records_per_file: int = 5_000_000) -> None:
    """Write parcels partitioned by state and county, replacing just the counties in ``df``.

    Rows are rebalanced on the partition columns, so small counties make few files and a county
    holding a large share of all rows is still written by many tasks. Columns that are known to be NULL
    are put in behind that, so they are not shuffled.
    """
    filled, whole = without_nulls(df, "state", "county")
    dealt = filled.hint("rebalance", F.col("state"), F.col("county"))
    (
        whole(dealt)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy("state", "county")
        .parquet(path)
    )


def write_filtered(df: DataFrame, root: str) -> None:
    """Snapshot of the filtered parcels, partitioned like the parcel table."""
    write_parcels(df, f"{root.rstrip('/')}/filtered")


def write_results(df: DataFrame, path: str, key: RunKey, run_ts: str | None = None) -> str:
    """Write a ranked snapshot as one partition of the results table; returns its run stamp.

    The same run written again replaces its partition and leaves all others alone.
    """
    stamp = run_ts or run_stamp()
    keyed = df.withColumns({**key.columns(), "run_ts": F.lit(stamp)})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN_KEYS, "run_ts").parquet(path)
    return stamp


def drop_runs(spark: SparkSession, path: str, runs: DataFrame) -> int:
    """Delete the partitions of outdated runs (one row per run, not per parcel)."""
    dropped = 0
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for run in runs.select(*RUN_KEYS, "run_ts").toLocalIterator():
        folder = "/".join(escape(name, run[name]) for name in (*RUN_KEYS, "run_ts"))
        dropped += bool(delete_path(spark, f"{path.rstrip('/')}/{folder}"))
    return dropped


def export_columns(df: DataFrame, method: str = "MCDA") -> DataFrame:
    """The export columns that are present, highest rank first."""
    method = method.upper()
    wanted = [c.format(score=f"{method.lower()}_score") for c in EXPORT_COLUMNS] + METHOD_COLUMNS[method]
    ordered = order_by_rank(df) if RANK in df.columns else df
    return ordered.select(*[c for c in wanted if c in df.columns])


def export_csv(df: DataFrame, path: str, method: str = "MCDA") -> None:
    """Ranking export; part files are in rank order."""
    export_columns(df, method).write.mode("overwrite").option("header", True).csv(path)


def report_row(ranked: DataFrame, settings: "Settings", run_ts: str | None = None, n: int = 5) -> DataFrame:
    """One row: statistics, top parcels, the screening choices and the ranking parameters."""
    statistics = ranking_stats(ranked)
    statistics = statistics.select(F.struct(*statistics.columns).alias("statistics"))
    place = top_n(ranked, n)
    top = place.agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    (-F.col(RANK)).alias("_order"), *[F.col(c) for c in place.columns if c != "ogc_fid"],
                    *([F.col("ogc_fid")] if "ogc_fid" in place.columns else []),
                )
            )
        ).alias("top_parcels")
    ).select(F.transform("top_parcels", lambda p: p.dropFields("_order")).alias("top_parcels"))
    summary = {
        "state": settings.state, "county": settings.county or "all_counties", "min_size": settings.min_size,
        "transmission_distance": settings.transmission_distance, "min_kv": settings.min_kv,
        "roadway_distance": settings.roadway_distance, "power_provider": settings.provider or "all_providers",
        "ranking_method": settings.method.upper(), "run_ts": run_ts,
    }

    def as_map(values: dict) -> Column:
        pairs = [F.lit(x) for k, v in values.items() for x in (k, None if v is None else str(v))]
        return F.create_map(*pairs).cast("map<string,string>")

    # Statistics and the top list are one row each, so these broadcasts have a fixed size.
    return statistics.join(F.broadcast(top)).withColumns(
        {"summary": as_map(summary), "parameters": as_map(settings.params or {"none": None})}
    )


def run_report(ranked: DataFrame, settings: "Settings", path: str, run_ts: str | None = None) -> None:
    """Write the run report as JSON."""
    report_row(ranked, settings, run_ts or run_stamp()).write.mode("overwrite").json(path)


def write_schema_report(report: tuple[DataFrame, DataFrame, DataFrame], path: str) -> None:
    """Write the per-file, per-state and total parts of a schema report as JSON."""
    for part, name in zip(report, ("files", "states", "summary")):
        part.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")


def features(df: DataFrame, properties: list[str], geometry: str = "geom_wkb") -> DataFrame:
    """One GeoJSON feature text per row, next to the original columns, as ``feature``."""
    shown = F.to_json(F.struct(*[F.col(c) for c in properties]), {"ignoreNullFields": "false"})
    text = F.concat(
        F.lit('{"type": "Feature", "geometry": '), F.coalesce(as_geojson(geometry), F.lit("null")),
        F.lit(', "properties": '), shown, F.lit("}"),
    )
    return df.withColumn("feature", text)


def export_features(df: DataFrame, path: str, properties: list[str] = POPUP_COLUMNS) -> None:
    """Ranked parcels as newline-delimited GeoJSON, one folder per rank band.

    Properties that are absent are written as null. Ranks outside all bands are not shown.
    """
    present = df.withColumns({c: F.lit(None).cast("string") for c in properties if c not in df.columns})
    banded = features(present, properties).select("feature", rank_band(RANK).alias("band"))
    banded.where(F.col("band").isNotNull()).write.mode("overwrite").partitionBy("band").text(path)
