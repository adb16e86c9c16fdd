"""Rows that stand at one place: right results, and work that grows with the places, not with the rows."""

import math
import random

import pytest
from conftest import local
from pyspark.sql import functions as F

from landsieve import Scratch
from landsieve.functions.geometry import parse_wkt, with_envelope
from landsieve.operators import spatial as sp
from landsieve.plans import enrichment
from landsieve.plans.enrichment import Enrichment, enrich
from landsieve.plans.loading import load_parcels
from landsieve.schema import PARCEL_COLUMNS
from landsieve.sources.sinks import write_parcels

PLACES, COPIES = 12, 30


def spots(seed, side):
    """Different points, as whole numbers, whose distances are exact."""
    chance = random.Random(seed)
    return chance.sample([(float(x), float(y)) for x in range(side) for y in range(side)], PLACES)


def points(spark, rows, id_col):
    """Rows (id, x, y) as shapes; without coordinates there is no shape."""
    df = local(spark, [(i, None if x is None else f"POINT({x:.0f} {y:.0f})") for i, x, y in rows], f"{id_col} long, wkt string")
    return with_envelope(df.select(id_col, parse_wkt("wkt")["geom_wkb"].alias("geom_wkb")))


def slants(spark, rows, id_col="lid"):
    """Rows (id, x, y) as lines that slant, so that boxes do not decide."""
    df = local(spark, [(i, f"LINESTRING({x:.0f} {y:.0f},{x + 3:.0f} {y + 4:.0f})", f"k{i}") for i, x, y in rows], f"{id_col} long, wkt string, kv string")
    return with_envelope(df.select(id_col, "kv", parse_wkt("wkt")["geom_wkb"].alias("geom_wkb")))


def stacked(at, start=0):
    return [(start + i, *at[i % len(at)]) for i in range(len(at) * COPIES)]


def distance(x, y, a, b):
    share = min(1.0, max(0.0, ((x - a) * 3 + (y - b) * 4) / 25))
    return math.hypot(x - a - 3 * share, y - b - 4 * share)


def brute(rows, lines, most):
    out = {}
    for i, x, y in rows:
        best = min((round(distance(x, y, a, b), 9), k) for k, a, b in lines) if x is not None else (math.inf, 0)
        if best[0] <= most:
            out[i] = best
    return out


@pytest.fixture
def searched(monkeypatch):
    """Numbers of rows that searches, and of candidate pairs that exact tests, were given."""
    seen = []
    place, pairs = sp._search_in_place, sp.candidate_pairs
    monkeypatch.setattr(sp, "_search_in_place", lambda df, layer, *rest: (seen.append((df.count(), layer.count())), place(df, layer, *rest))[1])

    def counted(*args, **more):
        found = pairs(*args, **more)
        seen.append(found[0].count())
        return found

    monkeypatch.setattr(sp, "candidate_pairs", counted)
    return seen


def test_anti_join_tests_each_pair_of_places_once(spark, scratch, searched):
    rows, lines = stacked(spots(1, 20)), stacked(spots(2, 20), 1000)
    lines += [(5000 + i, x, y) for i, (_, x, y) in enumerate(rows[:3])]  # these are hit
    kept = sp.spatial_anti(points(spark, [*rows, (9000, None, None)], "id"), slants(spark, lines), "id", "lid", scratch=scratch)
    hit = {i for i, (d, _) in brute(rows, lines, 0.0).items()}
    assert sorted(r["id"] for r in kept.collect()) == sorted({i for i, *_ in rows} - hit | {9000}) and len(hit) >= 3 * COPIES
    assert max(searched) <= PLACES * (PLACES + 3)  # thirty times thirty times as many before


@pytest.mark.parametrize("max_bytes", [sp.LIST_BYTES, 0])
def test_nearest_shape_is_searched_once_a_place(spark, scratch, searched, max_bytes):
    rows, lines = stacked(spots(3, 30)), stacked(spots(4, 30), 1000)
    found = sp.nearest(points(spark, [*rows, (9000, None, None)], "id"), slants(spark, lines), 6.0, {"kv": "kv"}, "d", "id", "lid", max_bytes=max_bytes, scratch=scratch)
    got = {r["id"]: (round(r["d"], 9), r["lid"], r["kv"]) for r in found.collect()}
    assert got == {i: (d, k, f"k{k}") for i, (d, k) in brute(rows, lines, 6.0).items()} and found.count() == len(got) > 0
    assert found.columns == ["id", "lid", "d", "kv"]
    assert searched[0] == (PLACES, PLACES)


def test_ids_that_repeat_at_other_places_keep_their_nearest(spark, scratch):
    rows, lines = [(i // 2, x, y) for i, x, y in stacked(spots(5, 30))], stacked(spots(6, 30), 1000)
    found = sp.nearest(points(spark, rows, "id"), slants(spark, lines), 50.0, {}, "d", "id", "lid", scratch=scratch)
    want = {}
    for i, x, y in rows:
        want[i] = min(want.get(i, (math.inf, 0)), min((round(distance(x, y, a, b), 9), k) for k, a, b in lines))
    assert {r["id"]: (round(r["d"], 9), r["lid"]) for r in found.collect()} == want and found.count() == len(want)


def test_nearest_box_and_rows_that_share_an_id(spark, scratch, searched):
    at, lines = spots(7, 30), stacked(spots(8, 30), 1000)
    box = lambda rows, key: local(spark, [(i, x, y, x + 1.0, y + 1.0) for i, x, y in rows], f"{key} long, minx double, miny double, maxx double, maxy double")
    rows = stacked(at) + stacked(at)
    found = sp.nearest(box(rows, "id"), box(lines, "lid"), 100.0, {}, "d", "id", "lid", scratch=scratch)
    gap = lambda a, b: math.hypot(max(0.0, abs(a[0] - b[0]) - 1), max(0.0, abs(a[1] - b[1]) - 1))
    want = sorted((i, *min((gap((x, y), b), k) for k, *b in lines)) for i, x, y in rows)
    assert sorted((r["id"], r["d"], r["lid"]) for r in found.collect()) == want
    assert searched == [(PLACES, PLACES)]


def test_parcels_are_enriched_once_a_place(spark, scratch, monkeypatch):
    rows, lines = stacked(spots(9, 30)), stacked(spots(10, 30), 1000)
    given, old = [], enrichment.nearest
    monkeypatch.setattr(enrichment, "nearest", lambda places, *rest, **more: (given.append(places.count()), old(places, *rest, **more))[1])
    parcels = points(spark, [*rows, (9000, None, None), (9000, *rows[0][1:])], "ogc_fid").withColumn("srid", F.lit(4326)).withColumn("et_kv", F.when(F.col("ogc_fid") == 1, "own"))
    layer = slants(spark, lines, "id").withColumn("operator", F.lit("o")).withColumn("srid", F.lit(4326))
    got = enrich(parcels, {"lines": layer, "roads": layer.drop("kv", "operator")}, Enrichment("lines", max_dist=6.0, srid=None), scratch)
    near = brute(rows, lines, 6.0)
    want = [(i, None, None, None) if i not in near else (i, near[i][0], "own" if i == 1 else f"k{near[i][1]}", near[i][0]) for i, *_ in rows]
    want += [(9000, None, None, None), (9000, *(want[0][1], want[0][2], want[0][3]))]
    key = lambda r: (r[0], r[1] is not None)
    rounded = lambda d: None if d is None else round(d, 9)
    assert sorted(((r["ogc_fid"], rounded(r["et_distance"]), r["et_kv"], rounded(r["hwy_distance"])) for r in got.collect()), key=key) == sorted(((i, d, "own" if i == 1 else k, h) for i, d, k, h in want), key=key)
    assert given == [PLACES, PLACES] and "est_operator" not in got.columns


def test_columns_of_no_file_are_not_carried_through_the_load(spark, scratch, tmp_path, monkeypatch):
    """Of the standard columns those that no file has are NULL in the result, and in no table on the way."""
    folder = tmp_path / "parcels" / "az" / "pima"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text('ogc_fid,parcelid,acres,wkt\n1,p1,2.5,"POINT(1 2)"\n2,p2,x,"POINT(1 2)"\n3,p3,,\n')
    (folder / "b.csv").write_text("ogc_fid,usedesc,wkt\n4,,\n")  # without a shape
    written, old = {}, Scratch.materialize
    monkeypatch.setattr(Scratch, "materialize", lambda self, df, name="step": (written.setdefault(name, df.columns), old(self, df, name))[1])
    parcels, problems = load_parcels(spark, str(tmp_path), scratch)
    assert parcels.columns[: len(PARCEL_COLUMNS)] == PARCEL_COLUMNS and "et_kv" in parcels.columns
    got = sorted(tuple(r) for r in parcels.select("ogc_fid", "parcelnumb", "gisacre", "usedesc", "minx", "_state", "_folder", "et_distance").collect())
    assert got == [("1", "p1", 2.5, None, 1.0, "az", "pima", None), ("2", "p2", None, None, 1.0, "az", "pima", None), ("3", "p3", None, None, None, "az", "pima", None)]
    assert [r["error"] for r in problems.collect()] == ["no geometry"]
    assert "geoid" not in written["records"]
    layer = slants(spark, [(1, 0.0, 0.0)], "id").withColumn("operator", F.lit("o"))
    enriched = enrich(parcels, {"lines": layer}, Enrichment("lines", max_dist=6.0, srid=None), scratch)
    assert enriched.columns == parcels.columns and "geoid" not in written["numbered"]
    write_parcels(enriched.drop("county", "state").withColumnsRenamed({"_state": "state", "_folder": "county"}), str(tmp_path / "out"))
    back = {r["ogc_fid"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {i: (r["et_kv"], r["geoid"], r["state"], r["county"]) for i, r in back.items()} == {"1": ("k1", None, "az", "pima"), "2": ("k1", None, "az", "pima"), "3": (None, None, "az", "pima")}
    assert set(PARCEL_COLUMNS) <= set(back["1"].asDict())
