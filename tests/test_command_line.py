"""A whole run from the command line over the smallest tables."""

import json

import pytest
from conftest import SMALL
from layer_files import write_geojson

from landsieve import fixtures as fx
from landsieve.__main__ import main

SHEET = "zoning_type,zoning_subtype,Zoning Ranking,Zoning Subtype Ranking,lbcs_site_desc,Site Descirption Ranking,fema_nri_risk_rating,fema_flood_zone,fema_flood_zone_subtype,Fema NRI Risk Ranking,Fema Flood Zone Ranking,Fema Flood Zone Subtype Ranking\n1-URGENT,F,8,7,BUILDING,9,Very Low,X,AREA OF MINIMAL FLOOD HAZARD,10,10,9\n"


def test_runs_from_the_command_line(spark, tmp_path, capsys):
    tables = tmp_path / "tables"
    fx.parcels(spark, SMALL).withColumnRenamed("state2", "state").write.partitionBy("state", "county").parquet(str(tables / "parcels"))
    fx.airports(spark, SMALL).write.parquet(str(tables / "other_gis" / "us_civil_airports"))
    fx.isochrones(spark, SMALL).write.parquet(str(tables / "other_gis" / "iso_50"))
    (tmp_path / "ranks.csv").write_text(SHEET)
    (tmp_path / "weights.csv").write_text("name,weight\n" + "".join(f"{k},{v}\n" for k, v in fx.WEIGHTS.items()))
    (tmp_path / "prefs.csv").write_text("name,goal\n" + "".join(f"{k},{v}\n" for k, v in fx.PREFERENCES.items()))
    (tmp_path / "out.csv").write_text("Land Use,Unwanted,Ownership,Unwanted\nMACHINERY,TRUE,5-LOW,TRUE\n")
    base = ["select", "--tables", str(tables), "--state", "asia", "--ranking-sheet", str(tmp_path / "ranks.csv"), "--exclusions", str(tmp_path / "out.csv")]
    county = fx.parcels(spark, SMALL).where("state2 = 'asia'").first()["county"]
    first = main([*base, "--params", str(tmp_path / "weights.csv"), "--transmission-distance", "200", "--min-kv", "69"], spark)
    report = json.loads(next((tables / "exports" / first / "report").glob("part*.json")).read_text())
    assert report["summary"]["county"] == "all_counties" and report["parameters"]["zoning"] == "0.2"
    exported = spark.read.option("header", True).csv(str(tables / "exports" / first / "ranking"))
    assert exported.count() == report["statistics"]["total_parcels"] > 5
    main([*base, "--params", str(tmp_path / "prefs.csv"), "--ranking-method", "MCO", "--county", county, "--transmission-distance", "400"], spark)
    with pytest.raises(SystemExit, match="no parcels"):
        main([*base, "--params", str(tmp_path / "weights.csv"), "--min-size", "1e9"], spark)
    main(["list", "--tables", str(tables), "providers", "--state", "asia"], spark)
    main(["list", "--tables", str(tables), "runs"], spark)
    shown = capsys.readouterr().out
    assert "City of BUILDING - (ASIA)" in shown
    assert "all_counties" in shown
    assert county in shown
    assert main(["cleanup", "--tables", str(tables)], spark) == 0


def test_from_files_to_export(spark, tmp_path, capsys):
    """Files are loaded, enriched by the layers beside them, screened by what that found, ranked and exported."""
    raw, tables = tmp_path / "raw", tmp_path / "tables"
    for folder in ("parcels/az/pima", "other_gis"):
        (raw / folder).mkdir(parents=True)
    square = lambda lon, lat, d=0.002: f"POLYGON(({lon} {lat},{lon + d} {lat},{lon + d} {lat + d},{lon} {lat + d},{lon} {lat}))"
    rows = [({"ogc_fid": i, "parcelnumb": f"P{i}", "gisacre": 60 + i, "zoning_type": "1-URGENT", "zoning_subtype": "F", "lbcs_site_desc": "BUILDING", "usedesc": "FARM"}, square(-111 + i / 100, 32)) for i in range(8)]
    write_geojson(raw / "parcels/az/pima/a.geojson", rows, one_per_line=False)
    line = "LINESTRING(-111.01 32.003, -110.965 32.003)"  # some 100 m north of parcels 0 to 3
    write_geojson(raw / "other_gis/transmission_lines.geojson", [({"kv": "138", "operator": "East"}, line), ({"kv": "69", "operator": "West"}, "LINESTRING(-110 33, -110 34)")])
    write_geojson(raw / "other_gis/us_civil_airports.geojson", [({"feattype": "Airport ground"}, square(-111 + 0.0205, 32.0005))])
    write_geojson(raw / "other_gis/iso_50.geojson", [({"time": 20}, square(-111.5, 31.5, 1.0))])
    (tmp_path / "ranks.csv").write_text(SHEET)
    (tmp_path / "weights.csv").write_text("name,weight\n" + "".join(f"{k},{v}\n" for k, v in fx.WEIGHTS.items()))
    main(["load", "--raw", str(raw), "--tables", str(tables), "--max-distance", "2000"], spark)
    loaded = {r["parcelnumb"]: r for r in spark.read.parquet(str(tables / "parcels")).collect()}
    assert len(loaded) == 8 and loaded["P0"]["et_kv"] == "138" and loaded["P7"]["et_distance"] is None
    assert 100 < loaded["P1"]["et_distance"] < 125 and loaded["P4"]["et_distance"] > 400
    stamp = main(["select", "--tables", str(tables), "--state", "az", "--ranking-sheet", str(tmp_path / "ranks.csv"), "--params", str(tmp_path / "weights.csv"), "--transmission-distance", "150", "--min-kv", "100"], spark)
    exported = spark.read.option("header", True).csv(str(tables / "exports" / stamp / "ranking")).collect()
    # Parcel 2 touches the airport; parcels 4 to 7 are too far from the line.
    assert sorted(r["parcelnumb"] for r in exported) == ["P0", "P1", "P3"]
    assert {r["drive_time"] for r in spark.read.parquet(str(tables / "results")).collect()} == {20.0}
