"""Discovery, readers, sheets, loaders, schema reports and sinks."""

import json
from datetime import datetime

import pytest
from conftest import local
from layer_files import write_geojson, write_geopackage, write_shapefile
from pyspark.sql import functions as F

from landsieve import Settings, load_all, load_layers, load_parcels, map_data, run_sql_steps, schema_check
from landsieve.functions.geometry import as_wkt, parse_wkt, with_envelope
from landsieve.operators import catalog, lookups as lk, standardize as std
from landsieve.plans.loading import split_statements
from landsieve.schema import PARCEL_COLUMNS
from landsieve.sources import geojson, readers, sheets, sinks
from landsieve.sources.discover import discover_layers

BOX = "POLYGON((0 0,0 2,2 2,2 0,0 0))"
HOLED = "POLYGON((0 0,0 9,9 9,9 0,0 0),(3 3,6 3,6 6,3 6,3 3))"
TWO = "MULTIPOLYGON(((0 0,0 1,1 1,1 0,0 0)),((5 5,5 8,8 8,8 5,5 5),(6 6,7 6,7 7,6 7,6 6)))"


def touch(path, text="x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_discovery(spark, tmp_path):
    root = tmp_path / "raw" / "parcels"
    for name in ("az/pima/a.shp", "az/pima/a.dbf", "az/pima/b.csv", "az/pima/deep/c.csv", "az/loose.gpkg", "az/empty/readme.txt",
                 "ks/all.geojson", "ks/.hidden/x.csv", "ks/.h.csv", ".git/x/y.csv", "co/adams/.x.csv", "top.csv"):
        touch(root / name)
    expected = [("az", "pima", "a.shp"), ("az", "pima", "b.csv"), ("ks", "ks", "all.geojson")]
    for start in (root, root.parent):
        rows = discover_layers(spark, str(start)).collect()
        assert sorted((r["state"], r["county"], r["path"].split("/")[-1]) for r in rows) == expected
    only = discover_layers(spark, str(root), "ks").collect()
    assert [r["ext"] for r in only] == ["geojson"]


ROWS = [({"parcelid": "A", "usedesc": "farm", "acreage": "60.5"}, BOX), ({"parcelid": "B", "usedesc": None, "acreage": "x"}, HOLED), ({"parcelid": "C", "usedesc": "shop", "acreage": "5"}, TWO)]


def read_texts(spark, path, columns):
    headers = readers.file_headers(spark, [str(path)])
    assert headers.first()["error"] is None
    rows = readers.read_layers(spark, headers, columns).withColumn("wkt", as_wkt("geom_wkb")).collect()
    return {r[columns[0]]: r for r in rows}


@pytest.mark.parametrize("form", ["shp", "gpkg", "lines", "collection", "csv"])
def test_every_format_reads_the_same(spark, tmp_path, form, monkeypatch):
    monkeypatch.setattr(readers, "SLICE_RECORDS", 2)  # several slices
    columns = ["parcelid", "usedesc", "acreage"]
    path = tmp_path / f"some layer.{'geojson' if form in ('lines', 'collection') else form}"
    if form == "shp":
        write_shapefile(path.with_suffix(""), [(c, 12) for c in columns], ROWS + [({"parcelid": "gone"}, BOX)], 'GEOGCS["WGS 84"]', deleted={3})
    elif form == "gpkg":
        write_geopackage(path, columns, ROWS)
    elif form == "csv":
        path.write_text("parcelid,usedesc,acreage,wkt\n" + "".join(f'{a["parcelid"]},{a["usedesc"] or ""},{a["acreage"]},"{t}"\n' for a, t in ROWS))
    else:
        write_geojson(path, ROWS, form == "lines")
    got = read_texts(spark, path, columns)
    assert {k: (r["usedesc"], r["acreage"], r["wkt"]) for k, r in got.items()} == {a["parcelid"]: (a["usedesc"], a["acreage"], t) for a, t in ROWS}
    if form != "csv":
        assert {r["srid"] for r in got.values()} == {4326}
    layer = readers.read_layer(spark, str(path))
    assert set(columns) < set(layer.columns) and layer.agg(F.max("maxx")).first()[0] == 9.0


def test_points_lines_and_null_shapes(spark, tmp_path):
    write_shapefile(tmp_path / "p", [("n", 3)], [({"n": "a"}, "POINT(1 2)"), ({"n": "b"}, None)], 'PROJCS["NAD83 / Conus Albers",AUTHORITY["EPSG","5070"]]', kind=1)
    write_shapefile(tmp_path / "l", [("n", 3)], [({"n": "a"}, "LINESTRING(0 0,1 1,2 0)")], kind=3)
    points = read_texts(spark, tmp_path / "p.shp", ["n"])
    assert (points["a"]["wkt"], points["a"]["srid"], points["b"]["wkt"]) == ("POINT(1 2)", 5070, None)
    assert read_texts(spark, tmp_path / "l.shp", ["n"])["a"]["wkt"] == "LINESTRING(0 0,1 1,2 0)"
    write_geopackage(tmp_path / "e.gpkg", ["n"], [({"n": "a"}, "EMPTY"), ({"n": "b"}, "POINT(1 2)")], srid=-1)
    empties = read_texts(spark, tmp_path / "e.gpkg", ["n"])
    assert (empties["a"]["wkt"], empties["b"]["wkt"], empties["b"]["srid"]) == (None, "POINT(1 2)", None)


def parcel_tree(root):
    for place in ("az/pima", "az/pinal", "ks"):
        (root / place).mkdir(parents=True)
    columns = ["parcelid", "usedesc", "acreage", "county", "path"]
    rows = [({**a, "county": "Pima County", "path": "/us/az"}, t) for a, t in ROWS]
    write_geopackage(root / "az/pima/one.gpkg", columns, rows)
    write_shapefile(root / "az/pima/two", [("parcelnumb", 8), ("gisacre", 8)], [({"parcelnumb": "D", "gisacre": "7"}, BOX)])
    (root / "az/pima/plain.csv").write_text("parcelnumb,gisacre\nE,9\n")
    (root / "az/pinal/bad.gpkg").write_text("not a database")
    write_geojson(root / "az/pinal/three.geojson", [({"parcelnumb": "F", "extra": 1, "gisacre": 8.25}, BOX), ({"parcelnumb": "G"}, None)])
    write_geojson(root / "az/pinal/bare.geojson", [({"parcelnumb": "H"}, None)])
    write_geojson(root / "ks/four.geojson", [({"parcelnumb": "I", "gisacre": "12"}, BOX)], one_per_line=False)


def test_parcels_are_standardised_from_all_files(spark, tmp_path, scratch):
    root = tmp_path / "raw"
    parcel_tree(root)
    parcels, problems = load_parcels(spark, str(root), scratch)
    assert parcels.columns[: len(PARCEL_COLUMNS)] == PARCEL_COLUMNS
    rows = {r["parcelnumb"]: r for r in parcels.collect()}
    assert sorted(rows) == ["A", "B", "C", "D", "F", "G", "I"]
    assert (rows["A"]["gisacre"], rows["B"]["gisacre"], rows["F"]["gisacre"], rows["I"]["gisacre"]) == (60.5, None, 8.25, 12.0)
    assert (rows["A"]["county"], rows["A"]["_folder"], rows["A"]["path"], rows["I"]["_folder"]) == ("Pima County", "pima", "/us/az", "ks")
    assert rows["A"]["is_rect"] and not rows["B"]["is_rect"] and rows["G"]["geom_wkb"] is None
    reasons = {r["path"].split("/")[-1]: r["error"] for r in problems.collect()}
    assert set(reasons) == {"bad.gpkg", "bare.geojson", "plain.csv"} and reasons["bare.geojson"] == "no geometry"
    everything, _ = load_parcels(spark, str(root), scratch, require_geometry=False)
    assert sorted(r[0] for r in everything.select("parcelnumb").collect()) == sorted([*rows, "E", "H"])


def test_whole_load(spark, tmp_path, scratch):
    root, out = tmp_path / "raw", tmp_path / "out"
    parcel_tree(root / "parcels")
    (root / "other_gis" / "deep").mkdir(parents=True)
    write_geojson(root / "other_gis" / "deep" / "iso_50.geojson", [({"time": 10}, BOX)])
    (root / "other_gis" / "notes.csv").write_text("a,b,b\n1,2,3\n")
    (root / "other_gis" / "broken.shp").write_bytes(b"123")
    (root / "sql").mkdir()
    (root / "sql" / "02_b.sql").write_text("CREATE OR REPLACE TEMP VIEW big AS SELECT * FROM stepped WHERE n > 1; -- done;\n")
    (root / "sql" / "01_a.sql").write_text("CREATE OR REPLACE TEMP VIEW stepped AS SELECT county, count(*) AS n, ';' AS c FROM parcels GROUP BY county")
    counts = load_all(spark, str(root), str(out), scratch, scripts=str(root / "sql"))
    assert sorted(map(tuple, counts.collect())) == [("az", "pima", 4), ("az", "pinal", 2), ("ks", "ks", 1)]
    assert sorted(r["county"] for r in spark.table("big").collect()) == ["pima", "pinal"]
    iso = spark.read.parquet(str(out / "other_gis" / "iso_50"))
    assert (iso.first()["time"], iso.first()["maxx"]) == ("10", 2.0)
    notes = spark.read.parquet(str(out / "other_gis" / "notes"))
    assert notes.columns == ["a", "b", "b.1"]
    _, problems = load_layers(spark, str(root / "other_gis"))
    assert [r["path"].split("/")[-1] for r in problems.collect()] == ["broken.shp"]
    table = str(out / "parcels")
    assert readers.read_parcels(spark, table, "az").count() == 6 and readers.read_parcels(spark, table, "az", "pima").count() == 4
    assert [r[0] for r in catalog.states(spark.read.parquet(table)).collect()] == ["az", "ks"]
    assert [r[0] for r in catalog.counties(spark.read.parquet(table), "az").collect()] == ["pima", "pinal"]
    # Loading one state again replaces only its counties.
    load_all(spark, str(root), str(out), scratch, state="ks")
    assert spark.read.parquet(table).count() == 7


def test_scripts_stop_at_the_first_failure(spark, tmp_path):
    for name, text in (("1.sql", "SELECT 1"), ("2.sql", "SELECT nothing FROM nowhere"), ("3.sql", "SELECT 3"), ("note.txt", "")):
        (tmp_path / name).write_text(text)
    done = run_sql_steps(spark, str(tmp_path))
    assert [(n, e is None) for n, e in done] == [("1.sql", True), ("2.sql", False)]
    assert split_statements("a ';' b; -- x;y\n c /* ; */ d;;\n -- end;\n") == ["a ';' b", "-- x;y\n c /* ; */ d"]


def test_schema_check(spark, tmp_path):
    root = tmp_path / "raw"
    parcel_tree(root)
    files, states, summary = schema_check(spark, str(root), str(tmp_path / "report"))
    rows = {r["file"]: r for r in files.collect()}
    assert rows["one.gpkg"]["unmapped_columns"] == ["parcelid", "acreage", "geometry"]
    assert rows["one.gpkg"]["columns_added"] == 157
    assert rows["plain.csv"]["unmapped_columns"] == [] and rows["plain.csv"]["columns_added"] == 158
    assert rows["three.geojson"]["unmapped_columns"] == ["extra", "geometry"]
    assert rows["bad.gpkg"]["columns_added"] == 160 and rows["bad.gpkg"]["total_columns_in_file"] == 0
    assert {r["state"]: (r["counties"], r["files"]) for r in states.collect()} == {"az": (2, 6), "ks": (1, 1)}
    total = summary.first()
    assert (total["total_states"], total["total_counties"], total["total_files"]) == (2, 3, 7)
    assert spark.read.json(str(tmp_path / "report" / "states")).count() == 2


def test_schema_report_totals(spark):
    """Seven sources in three states with the validated numbers of missing and extra columns."""
    counts = [
        ("co", "weld", 1, 28, 187), ("co", "adams", 1, 35, 194), ("ks", "shawnee", 55, 12, 117), ("ks", "douglas", 55, 18, 123),
        ("ks", "leavenworth", 55, 6, 111), ("ks", "johnson", 1, 18, 177), ("az", "maricopa", 1, 35, 194),
    ]
    rows = [
        (state, county, county, [*PARCEL_COLUMNS[missing:], *[f"extra_{i}" for i in range(extra)]])
        for state, county, missing, extra, _ in counts
    ]
    files, states, summary = std.schema_report(local(spark, rows, "state string, county string, file string, columns array<string>"))
    assert {r["county"]: (r["columns_added"], r["columns_unmapped"], r["total_columns_in_file"]) for r in files.collect()} == {c[1]: c[2:] for c in counts}
    assert {r["state"]: (r["columns_added"], r["columns_unmapped"]) for r in states.collect()} == {"co": (2, 63), "ks": (166, 54), "az": (1, 35)}
    assert tuple(summary.first()) == (3, 7, 7, 169, 152)


SHEET = """zoning_type,zoning_subtype,Zoning Ranking,Zoning Subtype Ranking,,lbcs_site_desc,Site Descirption Ranking,fema_nri_risk_rating,fema_flood_zone,fema_flood_zone_subtype,Fema NRI Risk Ranking,Fema Flood Zone Ranking,Fema Flood Zone Subtype Ranking
Residential,Single,8,7,,"O'Brien, field",9,Very Low,X,,10,9,8
Commercial,,4,N/A,,yard,,Low,AE,FLOODWAY,5,1,1
,,,,,depot,3,,,,,,
"""


def test_sheets(spark, tmp_path):
    (tmp_path / "ranks.csv").write_text(SHEET)
    (tmp_path / "weights.csv").write_text("criterion,weight,note\n" + "".join(f"{n},0.{i}," + "\n" for i, n in enumerate(lk.WEIGHT_NAMES, 1)))
    (tmp_path / "prefs.csv").write_text("criterion,goal\nsize,Max\ndistance,min\nrisk,MIN\nzoning,max\n")
    sheet = sheets.read_ranking_sheet(spark, str(tmp_path / "ranks.csv"))
    weights = sheets.read_params(spark, str(tmp_path / "weights.csv"))
    assert weights["zoning"] == 0.1 and len(weights) == 7
    assert lk.validate_ranking(sheet, weights) == weights
    prefs = lk.validate_ranking(sheet, sheets.read_params(spark, str(tmp_path / "prefs.csv")), "MCO")
    assert prefs == {"size": "max", "distance": "min", "risk": "min", "zoning": "max"}
    zoning, site, fema = lk.build_lookups(sheet)
    assert [tuple(r) for r in zoning.collect()] == [("Residential", "Single", 8.0, 7.0), ("Commercial", "", 4.0, None)]
    assert [tuple(r) for r in site.collect()] == [("O'Brien, field", 9.0), ("yard", None), ("depot", 3.0)]
    assert [tuple(r) for r in fema.collect()] == [("Very Low", "X", "", 10.0, 9.0, 8.0), ("Low", "AE", "FLOODWAY", 5.0, 1.0, 1.0)]
    (tmp_path / "bad.csv").write_text(SHEET.replace(",8,7,", ",high,7,"))
    with pytest.raises(lk.InvalidRanking, match="Zoning Ranking"):
        lk.validate_ranking(sheets.read_ranking_sheet(spark, str(tmp_path / "bad.csv")), weights)
    with pytest.raises(lk.InvalidRanking, match="lacks columns"):
        lk.validate_ranking(sheet.drop("zoning_type"), weights)


def test_exclusion_sheet(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Land Use ,Unwanted,Ownership,Unwanted\n Military base ,TRUE,Federal,true\nFarm,FALSE,State,0\n,TRUE,City,1\n")
    values = sheets.read_exclusions(spark, str(tmp_path / "x.csv"))
    assert sorted(r[0] for r in values.collect()) == ["City", "Federal", "Military base"]
    (tmp_path / "y.csv").write_text("Something,Else\n1,2\n")
    assert sheets.read_exclusions(spark, str(tmp_path / "y.csv")).count() == 0


@pytest.fixture
def ranked(spark):
    rows = [(i, f"P{i}", float(r), "R", "field", 1.0 + i, 2.0, datetime(2024, 1, i)) for i, r in enumerate([9.5, 6.5, 0.5], 1)]
    df = local(spark, rows, "ogc_fid long, parcelnumb string, parcel_rank_normalized double, zoning_type string, lbcs_site_desc string, mcda_score double, zoning_score double, saledate timestamp")
    text = F.concat(F.lit("POLYGON((-112 33,-112 33.5,-111 33.5,-111 33,-112 33))"))
    return with_envelope(df.withColumn("geom_wkb", parse_wkt(text)["geom_wkb"]).withColumn("srid", F.lit(4326)))


def test_result_runs(spark, tmp_path, ranked):
    path = str(tmp_path / "results")
    keys = [sinks.RunKey("az", "st. john's #1", "City of Mesa - (AZ)"), sinks.RunKey("04", None, None)]
    for key in keys:
        for stamp in ("20240101_000000", "20240102_000000", "20240103_000000"):
            sinks.write_results(ranked.drop("geom_wkb"), path, key, stamp)
    table = spark.read.parquet(path)
    info = {(r["county"], r["provider"]): r["total_runs"] for r in catalog.runs_info(table).collect()}
    assert sorted({r["state"] for r in catalog.runs(table).collect()}) == ["04", "az"]
    assert info == {("st. john's #1", "city_of_mesa__az"): 3, ("all_counties", "all_providers"): 3}
    assert sinks.drop_runs(spark, path, catalog.runs_to_drop(table)) == 2
    left = spark.read.parquet(path)
    assert catalog.runs_to_drop(left).count() == 0 and left.count() == 12
    assert readers.read_results(spark, path, keys[0], "20240103_000000").count() == 3
    assert readers.read_results(spark, path, keys[0], "20240101_000000").count() == 0
    newest = readers.read_results(spark, path, keys[0])
    assert newest.count() == 3 and newest.first()["run_ts"] == "20240103_000000"


def test_export_report_and_features(spark, tmp_path, ranked):
    sinks.export_csv(ranked, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["parcelnumb", "parcel_rank_normalized", "mcda_score", "zoning_type", "lbcs_site_desc", "zoning_score"]
    assert [r[0] for r in back.collect()] == ["P1", "P2", "P3"]
    sinks.run_report(ranked, Settings(state="az", weights={"zoning": 1.0}), str(tmp_path / "report"), "20240101_000000")
    report = json.loads(next((tmp_path / "report").glob("part*.json")).read_text())
    assert report["statistics"]["total_parcels"] == 3 and report["statistics"]["median_score"] == 6.5
    assert [p["parcelnumb"] for p in report["top_parcels"]] == ["P1", "P2", "P3"]
    assert report["summary"]["county"] == "all_counties" and report["parameters"] == {"zoning": "1.0"}
    sinks.export_features(ranked, str(tmp_path / "features"))
    bands = {p.name: json.loads(next(p.glob("part*")).read_text()) for p in (tmp_path / "features").glob("band=*")}
    assert set(bands) == {"band=Rank 8-10", "band=Rank 6-8", "band=Rank 0-2"}
    feature = bands["band=Rank 8-10"]
    assert feature["geometry"]["type"] == "Polygon" and feature["properties"]["parcelnumb"] == "P1"
    assert feature["properties"]["zoning_description"] is None


def test_filtered_snapshot_keeps_other_counties(spark, tmp_path):
    first = local(spark, [("az", "pima", 1), ("az", "pinal", 2)], "state string, county string, n int")
    sinks.write_filtered(first, str(tmp_path))
    sinks.write_filtered(local(spark, [("az", "pima", 3)], "state string, county string, n int"), str(tmp_path))
    rows = spark.read.parquet(str(tmp_path / "filtered")).collect()
    assert sorted((r["county"], r["n"]) for r in rows) == [("pima", 3), ("pinal", 2)]


def test_map_data(spark, ranked):
    stations = local(spark, [("In", "69", -111.5, 33.2), ("Out", "69", -100.0, 33.2), ("Edge", None, -112.0, 33.2)], "NAME string, Voltage string, x double, y double")
    stations = stations.withColumns({"minx": F.col("x"), "miny": F.col("y"), "maxx": F.col("x"), "maxy": F.col("y")})
    iso = local(spark, [(10.0, "POLYGON((0 0,0 1,1 1,0 0))")], "time double, t string").select("time", parse_wkt("t")["geom_wkb"].alias("geom_wkb"))
    poi = local(spark, [("Depot", 1.0)], "name string, v double").withColumns({c: F.col("v") for c in ("minx", "miny", "maxx", "maxy")})
    data = map_data(ranked, "az", iso, stations, {"depots": poi})
    assert data.center == (33.25, -111.5) and data.bounds == (-112.0, 33.0, -111.0, 33.5)
    shown = {r["ogc_fid"]: r for r in data.parcels.collect()}
    assert (shown[1]["band"], shown[1]["visible"], shown[3]["visible"], shown[1]["saledate"]) == ("Rank 8-10", True, False, "2024-01-01 00:00:00")
    assert [(r["name"], r["voltage"], r["operator"]) for r in data.substations.collect()] == [("In", "69", "N/A")]
    assert data.isochrones.first()["label"] == "Isochrone 10.0 minutes"
    assert [(r["name"], r["address"]) for r in data.points["depots"].collect()] == [("Depot", "N/A")]
    nowhere = map_data(ranked.limit(0), "CO")
    assert nowhere.center == (39.0, -105.5) and nowhere.bounds is None


# --- GeoJSON in awkward layouts ------------------------------------------------------------------

def features(n):
    """Features with brackets, quotes, backslashes and line breaks in their texts."""
    texts = ['a "quoted" {', "back\\", "\\\\", "line\nbreak }]", "é{[", "", "}\\\"{", 'x": {"type": "Feature"}']
    return [{"type": "Feature", "properties": {"n": i, "t": texts[i % len(texts)]}, "geometry": {"type": "Point", "coordinates": [i, 2]}} for i in range(n)]


LAYOUTS = {
    "lines": lambda fs: '{"type": "FeatureCollection", "features": [\n' + ",\n".join(map(json.dumps, fs)) + "\n]}",
    "one line": lambda fs: json.dumps({"features": fs, "type": "FeatureCollection"}),
    "indented": lambda fs: json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x", "of": {"a": [{"b": 1}]}}}, "bbox": [0, 0, 1, 1], "features": fs}, indent=1),
    "first on the line of the head": lambda fs: '{"type": "FeatureCollection", "features": [' + ",\n".join(map(json.dumps, fs)) + "]}",
    "two on a line": lambda fs: '{"type":"FeatureCollection","features":[\n' + ",\n".join(", ".join(map(json.dumps, fs[i : i + 2])) for i in range(0, len(fs), 2)) + "\n]}\n",
    "sequence": lambda fs: "\n".join(map(json.dumps, fs)) + "\n",
    "sequence without line breaks": lambda fs: "".join("\x1e" + json.dumps(f, ensure_ascii=False) for f in fs),
}


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("range_bytes", [7, 64, 1 << 20])
def test_no_feature_is_lost(spark, tmp_path, layout, range_bytes):
    fs = features(33)
    (tmp_path / "a.geojson").write_text(LAYOUTS[layout](fs))
    rows = geojson.geojson_records(spark, [str(tmp_path / "a.geojson")], range_bytes).where("text IS NOT NULL").collect()
    read = sorted((x for x in (json.loads(r["text"]) for r in rows) if x.get("type") == "Feature"), key=lambda x: x["properties"]["n"])
    assert read == fs and all(r["error"] is None for r in rows)
    if range_bytes > 1000:
        got = readers.read_geojson(spark, [str(tmp_path / "a.geojson")], ["n", "t"], "report").collect()
        assert sorted((int(r["n"]), r["t"]) for r in got) == [(f["properties"]["n"], f["properties"]["t"]) for f in fs]
        assert all(r["read_error"] is None and r["geom_wkb"] for r in got)


def test_a_single_feature_and_an_empty_file(spark, tmp_path):
    (tmp_path / "one.geojson").write_text(json.dumps(features(1)[0], indent=3))
    (tmp_path / "none.geojson").write_text("")
    (tmp_path / "empty.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    read = lambda name: [r["n"] for r in readers.read_geojson(spark, [str(tmp_path / f"{name}.geojson")], ["n"], "skip").collect()]
    assert (read("one"), read("none"), read("empty")) == (["0"], [], [])


def test_lost_records_are_reported(spark, tmp_path, scratch):
    good = features(4)
    bad = [{**good[0], "geometry": {"type": "Point"}}, {"type": "Thing", "geometry": None, "properties": {"n": 9}}, {**good[1], "geometry": {"type": "Nothing", "coordinates": []}}]
    (tmp_path / "az" / "pima").mkdir(parents=True)
    (tmp_path / "az" / "pima" / "a.geojson").write_text(LAYOUTS["one line"](good + bad))
    text = LAYOUTS["lines"](good).replace('"properties": {"n": 2', '"properties": "n": 2')
    (tmp_path / "az" / "pima" / "torn.geojson").write_text(text)
    cut = LAYOUTS["lines"](good)
    (tmp_path / "az" / "pima" / "cut.geojson").write_text(cut[: cut.index('"n": 3')])
    errors = {n: [r["read_error"] for r in readers.read_geojson(spark, [str(tmp_path / "az" / "pima" / f"{n}.geojson")], ["n"], "report").collect()] for n in ("a", "torn", "cut")}
    assert sorted(e.split(":")[0].split(" at ")[0] for e in errors["a"] if e) == ["geometry", "geometry", "not a feature"] and errors["a"].count(None) == 4
    assert errors["torn"].count(None) == 3 and sum("malformed" in (e or "") for e in errors["torn"]) == 1
    assert errors["cut"].count(None) == 3 and len(errors["cut"]) == 5
    with pytest.raises(Exception, match="geometry"):
        readers.read_geojson(spark, [str(tmp_path / "az" / "pima" / "a.geojson")], ["n"]).collect()
    parcels, problems = load_parcels(spark, str(tmp_path), scratch, keep=("n",))
    assert parcels.count() == 10 and {r["n"] for r in parcels.select("n").collect()} == {"0", "1", "2", "3"}
    assert sorted(r["path"].split("/")[-1] for r in problems.collect()) == ["a.geojson"] * 3 + ["cut.geojson"] * 2 + ["torn.geojson"] * 2


def test_columns_for_screening_survive_the_load(spark, tmp_path, scratch):
    (tmp_path / "az" / "pima").mkdir(parents=True)
    write_geojson(tmp_path / "az/pima/a.geojson", [({"parcelnumb": "A", "et_distance": 12.5, "et_kv": "69", "hwy_distance": "x", "other": 1}, BOX)])
    row = load_parcels(spark, str(tmp_path), scratch)[0].first().asDict()
    assert (row["et_distance"], row["et_kv"], row["hwy_distance"], row["est_operator"]) == (12.5, "69", None, None) and "other" not in row
