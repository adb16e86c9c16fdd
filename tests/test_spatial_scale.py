"""Grids from the data, aligned reference systems, and nearest search over layers that are not broadcast."""

import math
import random

import pytest
from conftest import local
from pyspark.sql import functions as F

from landsieve import Scratch
from landsieve.functions.geometry import parse_wkt, transform_srid, with_envelope
from landsieve.operators import best_first, spatial as sp
from landsieve.operators.alignment import align, srids
from landsieve.operators.quadtree import cell_of, histogram

BOXES = "id long, minx double, miny double, maxx double, maxy double"


def boxes(spark, rows, name="id"):
    return local(spark, rows, BOXES.replace("id", name, 1))


def gap(a, b):
    x = max(0.0, b[1] - a[3], a[1] - b[3])
    y = max(0.0, b[2] - a[4], a[2] - b[4])
    return math.sqrt(x * x + y * y)


def made(seed, n, side, spread, start=0):
    """Boxes around a few centres and across the plane, so that some places are dense."""
    chance = random.Random(seed)
    out = []
    for i in range(n):
        x, y = (chance.gauss(c, spread / 200) for c in chance.choice([(0.2, 0.3), (0.7, 0.8)])) if chance.random() < 0.6 else (chance.random(), chance.random())
        w, h = chance.choice([0, 0, side, side / 3, 5 * side]), chance.choice([0, side, side / 2])
        out.append((start + i, x * spread, y * spread, x * spread + w, y * spread + h))
    return out


# --- grid from the data --------------------------------------------------------------------------

def test_histogram_counts_every_node(spark):
    rows = made(1, 400, 0.0, 64.0)
    tree = histogram(boxes(spark, rows), 4)
    low = [min(r[k] for r in rows) for k in (1, 2)]
    side = max(max(r[3] for r in rows) - low[0], max(r[4] for r in rows) - low[1])
    assert tree.rows == 400 and tree.side == side
    for k, most in enumerate(tree.most):
        counts = {}
        for r in rows:
            at = tuple(min(int(((r[1 + a] + r[3 + a]) / 2 - low[a]) / side * 256), 255) >> (8 - 2 * k) for a in (0, 1))
            counts[at] = counts.get(at, 0) + 1
        assert most == max(counts.values())
    assert tree.splits(400) == 0 and tree.most[tree.splits(20)] <= 20 or tree.splits(20) == 4
    assert cell_of(boxes(spark, rows), 400) == side


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, 2.0, 3.0, 2.0, 3.0)] * 50, [(1, -1e9, -1e9, 1e9, 1e9)]])
def test_histogram_of_odd_layers(spark, rows):
    assert cell_of(boxes(spark, rows)) > 0


@pytest.mark.parametrize("scale", [1e-4, 1.0, 1e5])
def test_joins_need_no_cell(spark, scale):
    """Degrees or metres: the same rows as a nested loop, and few candidates for each parcel."""
    left = [(i, *[c * scale for c in r]) for i, *r in made(2, 900, 0.02, 60.0)]
    right = [(i, *[c * scale for c in r]) for i, *r in made(3, 900, 0.02, 60.0)] + [(9000, None, None, None, None)]
    meets = lambda a, b: a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]
    want = sorted((a[0], b[0]) for a in left for b in right if b[1] is not None and meets(a, b))
    for max_bytes in (1 << 26, 0):
        got = sp.spatial_join(boxes(spark, left), boxes(spark, right, "rid"), "id", "rid", [], max_bytes=max_bytes)
        assert sorted((r["id"], r["_r_rid"]) for r in got.collect()) == want
    kept = sp.spatial_anti(boxes(spark, left), boxes(spark, right, "rid"), "id", "rid")
    assert sorted(r["id"] for r in kept.collect()) == sorted(a[0] for a in left if a[0] not in {x for x, _ in want})
    layer, cell = boxes(spark, right, "rid"), cell_of(boxes(spark, right, "rid"))
    size, asked = sp.fit_levels(boxes(spark, left), layer, cell)
    candidates = sp.probes(boxes(spark, left), size.levels, cell).join(sp.layer_cells(layer, cell, asked).drop("minx", "miny", "maxx", "maxy"), sp.KEYS)
    most = candidates.groupBy("id").count().agg(F.max("count")).first()[0]
    assert most <= 200  # of 900, where 540 lie around two points


# --- reference systems ---------------------------------------------------------------------------

def shaped(spark, rows, srid):
    """Diamonds (id, lon, lat, half) in 4326, brought to ``srid``; None states no system."""
    frame = local(spark, rows, "id long, x double, y double, d double")
    at = lambda dx, dy: f"(x + {dx} * d), ' ', (y + {dy} * d)"
    text = f"concat('SRID=4326;POLYGON((', {at(-1, 0)}, ',', {at(0, -1)}, ',', {at(1, 0)}, ',', {at(0, 1)}, ',', {at(-1, 0)}, '))')"
    shapes = frame.select("id", parse_wkt(F.expr(text)).alias("g")).select("id", "g.geom_wkb", "g.srid")
    shapes = with_envelope(shapes) if srid in (4326, None) else transform_srid(shapes, srid)
    return (shapes.withColumn("srid", F.lit(None).cast("int")) if srid is None else shapes).cache()


def lonlat(seed, n, half):
    chance = random.Random(seed)
    return [(i, chance.uniform(-112, -111.5), chance.uniform(33, 33.5), chance.uniform(half / 2, half)) for i in range(n)]


def test_mixed_systems_give_the_rows_of_one(spark):
    left, right = lonlat(4, 120, 0.02), lonlat(5, 80, 0.03)
    pairs = lambda a, b: sorted((r["id"], r["_r_id"]) for r in sp.spatial_join(a, b, "id", "id", []).collect())
    want = pairs(shaped(spark, left, 4326), shaped(spark, right, 4326))
    assert want
    half = shaped(spark, right[:40], 4326).unionByName(shaped(spark, right[40:], 5070))
    assert pairs(shaped(spark, left, 4326), half) == want
    assert pairs(shaped(spark, left, None), shaped(spark, right, 5070)) == want
    kept = sp.spatial_anti(shaped(spark, left, 4326), half, "id", "id")
    assert sorted(r["id"] for r in kept.collect()) == sorted({i for i, *_ in left} - {a for a, _ in want})
    assert {r["srid"] for r in kept.select("srid").collect()} == {4326}
    near = lambda layer: sorted((r["id"], r["lid"], round(r["d"], 6)) for r in sp.nearest(shaped(spark, left, 4326), layer.withColumnRenamed("id", "lid"), 0.1, distance="d", id_col="id", layer_id="lid").collect())
    assert near(half) == near(shaped(spark, right, 4326))


def test_systems_that_cannot_be_aligned(spark):
    left, right = shaped(spark, lonlat(4, 3, 0.02), 4326), shaped(spark, lonlat(5, 3, 0.02), 5070)
    assert srids(left, right, left.drop("srid")) == [[4326], [5070], []]
    with pytest.raises(ValueError, match="without geom_wkb"):
        align(left.drop("geom_wkb"), right.drop("geom_wkb"))
    with pytest.raises(ValueError, match="2868"):
        align(left, right.withColumn("srid", F.lit(2868)))
    assert align(left, right.drop("srid"))[1].columns == right.drop("srid").columns
    one, other = align(left.drop("srid"), right)
    assert one.columns == left.drop("srid").columns and other is right


# --- nearest search without a broadcast ----------------------------------------------------------

def brute_nearest(rows, layer, max_dist):
    out = []
    for r in rows:
        best = min(((gap(r, e), e[0]) for e in layer if e[1] is not None), default=None) if r[1] is not None else None
        if best and best[0] <= max_dist:
            out.append((r[0], best[1], best[0]))
    return sorted(out)


@pytest.mark.parametrize("max_dist, cell", [(5.0, None), (0.4, None), (1000.0, None), (5.0, 0.3), (0.0, None)])
def test_best_first_is_brute_force(spark, max_dist, cell):
    rows = [*made(6, 250, 0.5, 60.0), (900, None, None, None, None), (901, -500.0, -500.0, -500.0, -500.0), (902, -10.0, -10.0, 90.0, 90.0)]
    layer = [*made(7, 250, 0.5, 60.0, 5000), *[(7000 + i, 30.0, 30.0, 30.0, 30.0) for i in range(40)], (8000, None, None, None, None), (8001, 0.0, 55.0, 60.0, 55.0)]
    with Scratch(spark) as scratch:
        got = sp.nearest(boxes(spark, rows), boxes(spark, layer, "lid"), max_dist, distance="d", id_col="id", layer_id="lid", cell=cell, max_bytes=0, scratch=scratch)
        assert sorted(map(tuple, got.collect())) == brute_nearest(rows, layer, max_dist)


def test_best_first_on_shapes(spark):
    """Exact distances between diamonds, whose boxes are nearer than they are."""
    left, right = lonlat(8, 60, 0.01), lonlat(9, 60, 0.05)
    a, b = shaped(spark, left, 4326), shaped(spark, right, 4326).withColumn("kv", F.col("id").cast("string")).withColumnRenamed("id", "lid")
    find = lambda **more: sorted(map(tuple, sp.nearest(a, b, 0.2, {"kv": "et_kv"}, "d", "id", "lid", **more).collect()))
    assert find(max_bytes=0) == find() and len(find()) == 60


def test_empty_sides(spark):
    some, none = made(1, 5, 1.0, 10.0), []
    for rows, layer in ((some, none), (none, some), (none, none)):
        assert sp.nearest(boxes(spark, rows), boxes(spark, layer, "lid"), 5.0, id_col="id", layer_id="lid", max_bytes=0).count() == 0


def test_entries_looked_at_do_not_grow_with_the_layer(spark):
    places = made(10, 300, 0.1, 100.0)
    rows, seen = boxes(spark, places), {}
    for n in (400, 4000):
        entries = made(11, n, 0.1, 100.0)
        layer = boxes(spark, entries, "lid")
        with Scratch(spark) as scratch:
            found = best_first.search(rows, layer, 20.0, "id", "lid", [], cell_of(layer), scratch)
            seen[n] = found.agg(F.avg("_seen"), F.max("_seen")).first()
            assert found.count() == len(brute_nearest(places, entries, 20.0))
    assert seen[4000][0] < 3 * seen[400][0] and seen[4000][1] < 600  # a level more of the tree, not ten times the entries
