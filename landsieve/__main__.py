"""Command line: ``python -m landsieve {load,schema,select,cleanup,list} ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators import catalog
from .operators.lookups import build_lookups, validate_ranking
from .plans.enrichment import Enrichment
from .plans.loading import load_all, schema_check
from .plans.mapdata import map_data
from .plans.site_selection import Settings, site_selection
from .session import Scratch, build_session
from .sources.manifest import CountyTable
from .sources import readers, sheets, sinks
from .sources.discover import path_exists


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="landsieve", description="Parcel screening and ranking on Spark.")
    commands = top.add_subparsers(dest="command", required=True)

    load = commands.add_parser("load", help="load parcel files and layers into tables")
    load.add_argument("--raw", required=True)
    load.add_argument("--tables", required=True)
    load.add_argument("--state")
    load.add_argument("--changed-only", action="store_true", help="load only counties whose files or layers have changed since the last such load")
    load.add_argument("--scripts", help="folder of SQL scripts to run afterwards")
    load.add_argument("--lines", default=Enrichment.lines, help="layer of transmission lines, by file stem")
    load.add_argument("--roads", default=Enrichment.roads)
    load.add_argument("--substations", default=Enrichment.substations)
    load.add_argument("--max-distance", type=float, default=Enrichment.max_dist, help="reach of these searches in metres")

    schema = commands.add_parser("schema", help="report how files match the standard schema")
    schema.add_argument("--raw", required=True)
    schema.add_argument("--report", required=True)

    select = commands.add_parser("select", help="screen and rank parcels")
    select.add_argument("--tables", required=True)
    select.add_argument("--state", required=True)
    select.add_argument("--county")
    select.add_argument("--ranking-sheet", required=True)
    select.add_argument("--params", required=True, help="weights or preferences sheet")
    select.add_argument("--exclusions", help="exclusion sheet; a built-in list without it")
    select.add_argument("--ranking-method", choices=["MCDA", "MCO"], default="MCDA")
    select.add_argument("--min-size", type=float, default=50.0)
    select.add_argument("--transmission-distance", type=float, default=100.0)
    select.add_argument("--roadway-distance", type=float)
    select.add_argument("--min-kv", type=float)
    select.add_argument("--provider")
    select.add_argument("--airports", default="other_gis/us_civil_airports")
    select.add_argument("--isochrones", default="other_gis/iso_50")
    select.add_argument("--id-col", default="ogc_fid")
    select.add_argument("--quick-view", action="store_true", help="also write map features")

    cleanup = commands.add_parser("cleanup", help="drop all but the newest result runs")
    cleanup.add_argument("--tables", required=True)
    cleanup.add_argument("--keep", type=int, default=2)

    listing = commands.add_parser("list", help="show states, counties of a state, or providers")
    listing.add_argument("--tables", required=True)
    listing.add_argument("what", choices=["states", "counties", "providers", "runs"])
    listing.add_argument("--state")
    listing.add_argument("--county")
    return top


def _layer(spark: SparkSession, tables: str, name: str) -> DataFrame | None:
    path = f"{tables}/{name}"
    return spark.read.parquet(path) if path_exists(spark, path) else None


def select(spark: SparkSession, args: argparse.Namespace) -> str:
    """One run: rank, append the snapshot, export CSV and report; returns the run stamp."""
    sheet = sheets.read_ranking_sheet(spark, args.ranking_sheet)
    params = validate_ranking(sheet, sheets.read_params(spark, args.params), args.ranking_method)
    settings = Settings(
        state=args.state, county=args.county, provider=args.provider, min_size=args.min_size,
        transmission_distance=args.transmission_distance, roadway_distance=args.roadway_distance, min_kv=args.min_kv,
        method=args.ranking_method, id_col=args.id_col,
        **({"weights": params} if args.ranking_method == "MCDA" else {"preferences": params}),
        **({"exclusions": sheets.read_exclusions(spark, args.exclusions)} if args.exclusions else {}),
    )
    key = sinks.RunKey(args.state, args.county, args.provider)
    results = f"{args.tables}/results"
    with Scratch(spark) as scratch:
        ranked = site_selection(
            readers.read_parcels(spark, f"{args.tables}/parcels", args.state, args.county), build_lookups(sheet), settings,
            scratch, _layer(spark, args.tables, args.airports), _layer(spark, args.tables, args.isochrones),
        )
        if ranked.isEmpty():
            raise SystemExit("no parcels left to rank")
        # The snapshot's own partition columns take the place of the parcel table's.
        stamp = sinks.write_results(ranked.withColumnRenamed("county", "parcel_county"), results, key)
    snapshot = readers.read_results(spark, results, key, stamp)
    sinks.export_csv(snapshot, f"{args.tables}/exports/{stamp}/ranking", args.ranking_method)
    sinks.run_report(snapshot, settings, f"{args.tables}/exports/{stamp}/report", stamp)
    if args.quick_view and "geom_wkb" in snapshot.columns:
        shown = map_data(snapshot, args.state).parcels.select("band", "feature")
        shown.write.mode("overwrite").partitionBy("band").text(f"{args.tables}/exports/{stamp}/features")
    return stamp


def listed(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.what == "runs":
        return catalog.runs_info(catalog.run_folders(spark, f"{args.tables}/results"))
    parcels = f"{args.tables}/parcels"
    counted = CountyTable.exists(spark, parcels)
    places = CountyTable(spark, parcels).entries().where("n > 0") if counted else catalog.folders(spark, parcels, ["state", "county"])
    if args.what == "states":
        return catalog.states(places)
    if args.state is None:
        raise SystemExit("--state is needed")
    if args.what == "counties":
        return catalog.counties(places, args.state)
    return catalog.providers(readers.read_parcels(spark, f"{args.tables}/parcels", args.state, args.county))


def print_rows(df: DataFrame) -> None:
    """All rows as tab-separated lines under a heading, a partition at a time."""
    print(*df.columns, sep="\t")
    for row in df.toLocalIterator():
        print(*["" if value is None else value for value in row], sep="\t")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> object:
    args = parser().parse_args(argv)
    spark = spark or build_session()
    if hasattr(args, "tables"):
        args.tables = args.tables.rstrip("/")
    if args.command == "load":
        with Scratch(spark) as scratch:
            enrichment = Enrichment(args.lines, args.roads, args.substations, args.max_distance)
            print_rows(load_all(spark, args.raw, args.tables, scratch, args.state, args.scripts, enrichment=enrichment, changed_only=args.changed_only))
        return None
    if args.command == "schema":
        print_rows(schema_check(spark, args.raw, args.report)[1].drop("state_columns"))
        return None
    if args.command == "select":
        stamp = select(spark, args)
        print(f"run {stamp}")
        return stamp
    if args.command == "cleanup":
        results = f"{args.tables}/results"
        dropped = sinks.drop_runs(spark, results, catalog.runs_to_drop(catalog.run_folders(spark, results), args.keep))
        print(f"dropped {dropped} runs")
        return dropped
    print_rows(listed(spark, args))
    return None


if __name__ == "__main__":
    main(sys.argv[1:])
