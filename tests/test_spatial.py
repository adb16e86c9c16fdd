"""Geometry helpers, and the grid joins against brute force."""

import math
import random

import numpy as np
import pytest
from conftest import local
from pyspark.sql import functions as F

from landsieve.functions import albers, geometry as g
from landsieve.operators import spatial as sp
from landsieve.operators.skew import salted_join

SQUARE = "POLYGON((0 0,0 1,1 1,1 0,0 0))"
DONUT = "POLYGON((0 0,10 0,10 10,0 10,0 0),(3 3,7 3,7 7,3 7,3 3))"


def shape(text):
    return g.Shape(g.from_wkt(text)[0])


def meets_one(a, b):
    return bool(g.pairs_intersect([a], [b])[0])


def gap_one(a, b):
    return float(g.pairs_distance([a], [b])[0])


@pytest.mark.parametrize(
    "a, b, meets",
    [
        (SQUARE, "POINT(0.5 0.5)", True),
        (SQUARE, "LINESTRING(0 0.5, 1 0.5)", True),
        (SQUARE, "POLYGON((2 2,2 3,3 3,3 2,2 2))", False),
        (SQUARE, "POLYGON((1 0,2 0,2 1,1 1,1 0))", True),  # shared edge
        (SQUARE, "POLYGON((1 1,2 1,2 2,1 2,1 1))", True),  # shared corner
        (SQUARE, "POINT(1 0.25)", True),  # on the border
        (SQUARE, "POINT(1.0001 0.25)", False),
        (SQUARE, "LINESTRING(-1 -1, 2 2)", True),
        (SQUARE, "LINESTRING(2 0, 0 2)", True),  # touches a corner
        (SQUARE, "LINESTRING(2.1 0, 0 2.1)", False),
        (DONUT, "POINT(5 5)", False),  # in the hole
        (DONUT, "POLYGON((4 4,6 4,6 6,4 6,4 4))", False),
        (DONUT, "POLYGON((4 4,8 4,8 6,4 6,4 4))", True),
        (DONUT, "POINT(1 1)", True),
        (DONUT, "POLYGON((-1 -1,11 -1,11 11,-1 11,-1 -1))", True),  # around everything
        ("MULTIPOLYGON(((0 0,1 0,1 1,0 1,0 0)),((5 5,6 5,6 6,5 6,5 5)))", "POINT(5.5 5.5)", True),
        ("MULTIPOLYGON(((0 0,1 0,1 1,0 1,0 0)),((5 5,6 5,6 6,5 6,5 5)))", "POINT(3 3)", False),
        ("MULTIPOINT((0 0),(4 4))", "POINT(4 4)", True),
        ("LINESTRING(0 0, 4 0)", "LINESTRING(2 0, 6 0)", True),  # collinear overlap
        ("LINESTRING(0 0, 4 0)", "LINESTRING(5 0, 6 0)", False),
        ("GEOMETRYCOLLECTION(POINT(9 9),POLYGON((0 0,1 0,1 1,0 1,0 0)))", "POINT(0.5 0.5)", True),
    ],
)
def test_intersects(a, b, meets):
    assert meets_one(shape(a), shape(b)) is meets
    assert meets_one(shape(b), shape(a)) is meets


@pytest.mark.parametrize(
    "a, b, gap",
    [
        (SQUARE, "POINT(4 5)", 5.0),
        (SQUARE, "POINT(0.5 0.5)", 0.0),
        (SQUARE, "LINESTRING(-5 3, 5 3)", 2.0),
        (DONUT, "POINT(5 5)", 2.0),
        ("LINESTRING(0 0, 0 4)", "LINESTRING(3 2, 9 2)", 3.0),
        ("POINT(0 0)", "POINT(3 4)", 5.0),
    ],
)
def test_distance(a, b, gap):
    assert gap_one(shape(a), shape(b)) == pytest.approx(gap)
    assert gap_one(shape(b), shape(a)) == pytest.approx(gap)


def test_batches_equal_single_pairs(monkeypatch):
    texts = [SQUARE, DONUT, "POINT(5 5)", "POINT(0.5 0.5)", "LINESTRING(-5 3, 5 3)", "MULTIPOINT((0 0),(4 4))", "POLYGON((4 4,6 4,6 6,4 6,4 4))"]
    pairs = [(shape(a), shape(b)) for a in texts for b in texts]
    left, right = map(list, zip(*pairs))
    for chunk in (1, 7, 10**6):
        monkeypatch.setattr(g, "CHUNK", chunk)
        assert g.pairs_intersect(left, right).tolist() == [meets_one(a, b) for a, b in pairs]
        assert g.pairs_distance(left, right).tolist() == [gap_one(a, b) for a, b in pairs]


@pytest.mark.parametrize(
    "text",
    [
        "POINT(1.5 -2)", "LINESTRING(0 0,1 1)", SQUARE, DONUT, "MULTIPOINT((1 1),(2 2))", "MULTILINESTRING((0 0,1 1),(2 2,3 3))",
        "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))", "GEOMETRYCOLLECTION(POINT(1 1),LINESTRING(0 0,1 1))",
    ],
)
def test_round_trips(text):
    wkb, _ = g.from_wkt(text)
    assert g.to_wkt(wkb) == text
    assert g.from_geojson(g.to_geojson(wkb)) == wkb


def test_other_binary_forms():
    big = b"\x00" + (1).to_bytes(4, "big") + np.array([3.0, 4.0], ">f8").tobytes()
    assert g.to_wkt(big) == "POINT(3 4)"
    with_z = b"\x01" + (1001).to_bytes(4, "little") + np.array([3.0, 4.0, 9.0], "<f8").tobytes()
    assert g.to_wkt(with_z) == "POINT(3 4)"
    with_srid = b"\x01" + (0xA0000001).to_bytes(4, "little") + (4326).to_bytes(4, "little") + np.array([3.0, 4.0, 9.0], "<f8").tobytes()
    assert g.to_wkt(with_srid) == "POINT(3 4)"
    assert g.from_wkt("SRID=5070;POINT(1 2)")[1] == 5070
    with pytest.raises(ValueError):
        g.from_wkt("CIRCLE(0 0)")


def test_text_columns(spark):
    df = local(spark, [(SQUARE,), ("junk",), (None,), ("POINT EMPTY",), ("SRID=5070;POLYGON((0 0,4 0,0 4,0 0))",)], "t string")
    rows = g.with_envelope(df.select(g.parse_wkt("t").alias("p")).select("p.*")).collect()
    assert [r["is_rect"] for r in rows] == [True, None, None, None, False]
    assert (rows[0]["minx"], rows[0]["maxy"], rows[1]["minx"], rows[4]["srid"]) == (0.0, 1.0, None, 5070)


def test_projection_matches_the_published_example():
    """Snyder's Clarke 1866 example is another ellipsoid; the origin and symmetry are exact here."""
    origin = albers.to_albers(np.array([[-96.0, 23.0]]))
    assert np.abs(origin).max() < 1e-6
    lonlat = np.array([[-112.0, 33.4], [-66.5, 44.9], [-124.7, 48.4], [-96.0, 37.5]])
    assert np.abs(albers.from_albers(albers.to_albers(lonlat)) - lonlat).max() < 1e-9
    left, right = albers.to_albers(np.array([[-100.0, 40.0], [-92.0, 40.0]]))
    assert left[0] == pytest.approx(-right[0]) and left[1] == pytest.approx(right[1])
    # Equal area: a small cell keeps its ellipsoidal area.
    d = 1e-3
    cell = albers.to_albers(np.array([[-100, 40], [-100 + d, 40], [-100 + d, 40 + d], [-100, 40 + d]]))
    x, y = cell.T
    area = abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2
    lat, e2 = math.radians(40 + d / 2), albers.FLATTENING * (2 - albers.FLATTENING)
    w = 1 - e2 * math.sin(lat) ** 2
    expected = math.radians(d) ** 2 * albers.SEMI_MAJOR**2 * (1 - e2) * math.cos(lat) / w**2
    assert area == pytest.approx(expected, rel=1e-6)


def test_transform_defaults_to_longitude_latitude(spark):
    df = local(spark, [("POINT(-96 23)", None), ("POINT(5 5)", 5070)], "t string, srid int")
    shapes = df.select(g.parse_wkt("t")["geom_wkb"].alias("geom_wkb"), "srid")
    rows = g.transform_srid(shapes, 5070).collect()
    assert abs(rows[0]["minx"]) < 1e-6 and abs(rows[0]["miny"]) < 1e-6
    assert (rows[1]["minx"], rows[1]["srid"]) == (5.0, 5070)
    with pytest.raises(ValueError):
        g.transform_srid(shapes, 3857)


def boxes(spark, seed, n, spread, largest, hot=0.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = (1.0, 1.0) if rng.random() < hot else (rng.uniform(-spread, spread), rng.uniform(-spread, spread))
        w, h = (largest * rng.random() ** 6 for _ in range(2))
        rows.append((i, x, y, x + w, y + h, f"p{i}"))
    rows.append((n, None, None, None, None, "nowhere"))
    return local(spark, rows, "id long, minx double, miny double, maxx double, maxy double, tag string"), rows[:-1]


def meet(a, b):
    return a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]


@pytest.mark.parametrize("max_bytes", [1 << 26, 0], ids=["broadcast", "shuffled"])
@pytest.mark.parametrize("hot", [0.0, 0.4], ids=["even", "hot"])
@pytest.mark.parametrize("cell", [0.5, 7.3])
def test_grid_join_equals_nested_loop(spark, max_bytes, hot, cell):
    """Sizes from points to boxes that outgrow every level; with and without a hot cell."""
    left, a = boxes(spark, 1, 300, 100.0, 60.0, hot)
    right, b = boxes(spark, 2, 150, 100.0, 90.0, hot)
    right = right.withColumnRenamed("id", "rid")
    wide = local(spark, [(999, -1e7, -1e7, 1e7, 1e7, "all")], "rid long, minx double, miny double, maxx double, maxy double, tag string")
    expected = sorted([(x[0], y[0]) for x in a for y in b if meet(x, y)] + [(x[0], 999) for x in a])
    got = sp.spatial_join(left, right.union(wide), "id", "rid", ["tag"], cell, max_bytes)
    assert sorted((r["id"], r["_r_rid"]) for r in got.collect()) == expected
    kept = sp.spatial_anti(left, right, "id", "rid", cell, max_bytes)
    outside = [x[0] for x in a if not any(meet(x, y) for y in b)] + [300]
    assert sorted(r["id"] for r in kept.collect()) == sorted(outside)


@pytest.mark.parametrize("max_bytes", [1 << 26, 0], ids=["broadcast", "shuffled"])
def test_nearest_equals_nested_loop(spark, max_bytes):
    left, a = boxes(spark, 3, 200, 50.0, 5.0)
    right, b = boxes(spark, 4, 120, 50.0, 20.0)

    def gap(x, y):
        dx, dy = max(0.0, y[1] - x[3], x[1] - y[3]), max(0.0, y[2] - x[4], x[2] - y[4])
        return math.sqrt(dx**2 + dy**2)

    expected = {}
    for x in a:
        near = min((gap(x, y), y[0]) for y in b)
        if near[0] <= 3.0:
            expected[x[0]] = near
    found = sp.nearest(left, right.withColumnRenamed("id", "rid"), 3.0, {"tag": "name"}, "d", "id", "rid", 2.0, max_bytes)
    assert {r["id"]: (r["d"], r["rid"]) for r in found.collect()} == expected
    assert all(r["name"] == f"p{r['rid']}" for r in found.collect())


def test_widening_rings_find_the_same_as_one_wide_search(spark, scratch):
    left, _ = boxes(spark, 5, 100, 50.0, 5.0)
    right, _ = boxes(spark, 6, 30, 50.0, 5.0)
    right = right.withColumnRenamed("id", "rid")
    wide = sp.nearest(left, right, 40.0, {}, "d", "id", "rid", 2.0)
    rings = sp.nearest_in_rings(left, right, [2.0, 8.0, 40.0], scratch, "id", layer_id="rid", distance="d", cell=2.0)
    assert sorted(map(tuple, rings.collect())) == sorted(map(tuple, wide.collect()))


def polygons(spark, seed, n, name):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, r = rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(0.2, 6)
        kind = rng.choice(["tri", "star", "line", "point", "rect"])
        if kind == "point":
            text = f"POINT({x} {y})"
        elif kind == "line":
            text = f"LINESTRING({x} {y},{x + r} {y - r},{x + 2 * r} {y})"
        elif kind == "rect":
            text = f"POLYGON(({x} {y},{x + r} {y},{x + r} {y + r},{x} {y + r},{x} {y}))"
        else:
            k = 3 if kind == "tri" else 10
            pts = [(x + r * (0.4 + 0.6 * (j % 2 or k == 3)) * math.cos(2 * math.pi * j / k), y + r * (0.4 + 0.6 * (j % 2 or k == 3)) * math.sin(2 * math.pi * j / k)) for j in range(k)]
            text = "POLYGON((" + ",".join(f"{px} {py}" for px, py in [*pts, pts[0]]) + "))"
        rows.append((i, text))
    df = local(spark, rows, f"{name} long, t string")
    return g.with_envelope(df.select(name, g.parse_wkt("t")["geom_wkb"].alias("geom_wkb"))), [(i, shape(t)) for i, t in rows]


@pytest.mark.parametrize("max_bytes", [1 << 26, 0], ids=["broadcast", "shuffled"])
def test_exact_shapes_equal_brute_force(spark, max_bytes):
    left, a = polygons(spark, 7, 120, "id")
    right, b = polygons(spark, 8, 90, "rid")
    hits = {(i, j) for i, x in a for j, y in b if meets_one(x, y)}
    got = sp.spatial_join(left, right, "id", "rid", [], 2.0, max_bytes)
    assert {(r["id"], r["_r_rid"]) for r in got.collect()} == hits
    kept = sp.spatial_anti(left, right, "id", "rid", 2.0, max_bytes)
    assert sorted(r["id"] for r in kept.collect()) == sorted({i for i, _ in a} - {i for i, _ in hits})
    near = sp.nearest(left, right, 1.5, {}, "d", "id", "rid", 2.0, max_bytes)
    expected = {}
    for i, x in a:
        best = min((gap_one(x, y), j) for j, y in b)
        if best[0] <= 1.5:
            expected[i] = best[1]
    assert {r["id"]: r["rid"] for r in near.collect()} == expected


def test_one_sided_shapes_are_refused(spark):
    left, _ = polygons(spark, 7, 3, "id")
    right, _ = boxes(spark, 1, 3, 1.0, 1.0)
    with pytest.raises(ValueError, match="both sides"):
        sp.spatial_join(left, right.withColumnRenamed("id", "rid"), "id", "rid", [])


def test_drive_time_goes_by_parcel_number(spark):
    parcels = local(spark, 
        [(1, "A", 0.0), (2, "A", 100.0), (3, None, 0.0), (4, "B", 100.0)], "ogc_fid long, parcelnumb string, x double"
    ).select("ogc_fid", "parcelnumb", F.col("x").alias("minx"), F.lit(0.0).alias("miny"), F.col("x").alias("maxx"), F.lit(0.0).alias("maxy"))
    iso = local(spark, [(1, 30.0, -1.0, -1.0, 1.0, 1.0), (2, 20.0, 0.0, 0.0, 2.0, 2.0)], "id long, time double, minx double, miny double, maxx double, maxy double")
    timed = sp.attach_drive_time(parcels, iso)
    assert {r["ogc_fid"]: r["drive_time"] for r in timed.collect()} == {1: 20.0, 2: 20.0, 3: 9999.0, 4: 9999.0}
    assert {r["drive_time"] for r in sp.attach_drive_time(parcels, iso.limit(0)).collect()} == {9999.0}
    assert {r["drive_time"] for r in sp.attach_drive_time(parcels, None, 1.0).collect()} == {1.0}


def test_salted_join_keeps_every_row_of_a_hot_key(spark):
    left = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, None).otherwise(F.col("id")).alias("k"))
    right = spark.range(0, 3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_anti", "left_semi"):
        plain = sorted(map(str, left.join(right, "k", how).select("id").collect()))
        assert sorted(map(str, salted_join(left, right, ["k"], how, ["id"]).select("id").collect())) == plain


def test_infrastructure_columns(spark):
    parcels = local(spark, [(1, 0.0, 0.0, 1.0, 1.0), (2, 5000.0, 0.0, 5001.0, 1.0)], "ogc_fid long, minx double, miny double, maxx double, maxy double")
    lines = local(spark, [(1, "138", "East", 0.0, 4.0, 9.0, 4.0)], "id long, kv string, operator string, minx double, miny double, maxx double, maxy double")
    roads = local(spark, [(1, 3.0, 0.0, 3.0, 9.0)], "id long, minx double, miny double, maxx double, maxy double")
    stations = local(spark, [(1, "West", 1.0, 2.0, 1.0, 2.0)], "id long, operator string, minx double, miny double, maxx double, maxy double")
    rows = {r["ogc_fid"]: r for r in sp.enrich_infrastructure(parcels, lines, roads, stations, 100.0).collect()}
    one, two = rows[1], rows[2]
    assert (one["et_distance"], one["et_kv"], one["et_operator"], one["hwy_distance"], one["est_operator"]) == (3.0, "138", "East", 2.0, "West")
    assert (two["et_distance"], two["hwy_distance"], two["est_operator"]) == (None, None, None)
