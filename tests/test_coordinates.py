"""Batches of geometries against the parsers of single ones."""

import json
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from landsieve.functions import coordinates, geometry as g
from landsieve.functions.coordinates import Coordinates, Segments, wkb_of_text

number = st.one_of(st.integers(-99, 99).map(float), st.floats(-1e9, 1e9).map(lambda x: x + 0.0))
point = st.tuples(number, number).map(list)
ring = st.lists(point, min_size=3, max_size=5).map(lambda r: [*r, r[0]])
polygon = st.lists(ring, min_size=1, max_size=3)
simple = st.one_of(
    st.tuples(st.just("Point"), point), st.tuples(st.just("LineString"), st.lists(point, min_size=2, max_size=4)),
    st.tuples(st.just("Polygon"), polygon), st.tuples(st.just("MultiPoint"), st.lists(point, min_size=1, max_size=3)),
    st.tuples(st.just("MultiLineString"), st.lists(st.lists(point, min_size=2, max_size=3), min_size=1, max_size=3)),
    st.tuples(st.just("MultiPolygon"), st.lists(polygon, min_size=1, max_size=3)),
)
geometry = st.one_of(st.none(), simple, st.tuples(st.just("GeometryCollection"), st.lists(simple, min_size=1, max_size=3)))


def other_form(wkb):
    """The same points and lines in big-endian bytes with Z and an SRID."""
    kind, part, _ = g.decode(wkb)
    points = np.atleast_2d(part)
    body = np.column_stack([points, np.full(len(points), 7.0)]).astype(">f8").tobytes()
    count = struct.pack(">I", len(points)) if kind == "LineString" else b""
    return struct.pack(">BII", 0, 0xA0000000 | g.CODES[kind.lower()], 4326) + count + body


@settings(max_examples=60, deadline=None)
@given(st.lists(geometry, max_size=8), st.sampled_from([3, 50, 10**6]))
def test_batches_equal_single_geometries(shapes, chunk):
    rows = [None if s is None else g.encode(*s) for s in shapes]
    batch = Coordinates(pa.array(rows, pa.binary()))
    assert batch.with_xy(batch.xy).to_pylist() == rows
    for as_json, single in ((False, g.to_wkt), (True, lambda w: json.dumps(g.to_geojson(w)))):
        texts, rest = batch.texts(as_json)
        assert [k for k, s in enumerate(shapes) if s and s[0] == "GeometryCollection"] == rest.tolist()
        assert [t for k, t in enumerate(texts.to_pylist()) if k not in rest] == [w and single(w) for k, w in enumerate(rows) if k not in rest]
    boxes = batch.boxes()
    for k, row in enumerate(rows):
        points = batch.xy[batch.point_row == k]
        ends = (None,) * 4 if row is None else (*points.min(0), *points.max(0))
        assert tuple(boxes[c][k].as_py() for c in ("minx", "miny", "maxx", "maxy")) == ends
    words = [w and g.to_wkt(w) for w in rows]
    coordinates.TEXT_CHUNK, before = chunk, coordinates.TEXT_CHUNK
    try:
        wkb, srid, rest = wkb_of_text(pa.array(words, pa.string()))
    finally:
        coordinates.TEXT_CHUNK = before
    plain = {"Point", "LineString", "Polygon", "MultiPolygon"}
    assert rest.tolist() == [k for k, s in enumerate(shapes) if s and s[0] not in plain]
    assert all(wkb[k].as_py() == rows[k] and srid[k].as_py() is None for k in range(len(rows)) if k not in rest)


@pytest.mark.parametrize(
    "text",
    [
        "POLYGON((1 1,2 2),)", "POLYGON((1 1,,2 2))", "LINESTRING(1 1)(2 2)", "POINT(1 2,3 4)", "POLYGON()", "POLYGON((0 0,1 1,1 0,0 0)", "LINESTRING((1 1))",
        "POINT(1 2 3)", "POINT EMPTY", "CIRCLE(0 0)", "", "POLYGON((0 0,1 1),1 0)", "MULTIPOLYGON((0 0,1 1))", "POINT(1 2-3)", "POINT(1e 2)", "LINESTRING(0 0 1 1)",
    ],
)
def test_texts_out_of_form_are_left_to_the_single_parser(text):
    wkb, _, rest = wkb_of_text(pa.array(["POINT(1 2)", text, None, "SRID=5070;point ( 1e3  -.5 )"]))
    assert 1 in rest and wkb[1].as_py() is None and 2 not in rest
    if len(rest) == 1:  # a malformed number leaves all of its slice
        assert wkb[3].as_py() == g.encode("Point", [1000.0, -0.5])


def test_binary_forms_lie_side_by_side():
    rows = [g.encode("LineString", [[0, 0], [3, 4]]), None, g.encode("Point", [5, 6])]
    mixed = [rows[0], other_form(rows[0]), None, other_form(rows[2]), rows[2]]
    batch = Coordinates(pa.array(mixed, pa.binary()))
    assert batch.plain.tolist() == [True, False, False, False, True]
    assert batch.xy.tolist() == [[0, 0], [3, 4], [0, 0], [3, 4], [5, 6], [5, 6]]
    assert batch.texts()[0].to_pylist() == ["LINESTRING(0 0,3 4)", "LINESTRING(0 0,3 4)", None, "POINT(5 6)", "POINT(5 6)"]
    sliced = Coordinates(pa.array(mixed, pa.binary()).slice(3))
    assert sliced.xy.tolist() == [[5, 6], [5, 6]]


@pytest.mark.parametrize("broken", [b"\x01\x02\x00\x00\x00\x02\x00\x00\x00" + bytes(16), b"\x01", b"\x01\x63\x00\x00\x00", b"\x01\x06\x00\x00\x00\xff\xff\xff\xff"])
def test_broken_bytes_are_an_error_and_read_nothing_of_other_rows(broken):
    with pytest.raises(ValueError):
        Coordinates(pa.array([broken, g.encode("LineString", [[0, 0], [1, 1]]), g.encode("Point", [5, 6])], pa.binary()))


def test_rows_without_coordinates():
    empty = struct.pack("<BII", 1, 3, 0)
    rows = pa.array([empty, g.encode("Point", [1, 2]), None], pa.binary())
    batch = Coordinates(rows)
    assert batch.boxes()["minx"].to_pylist() == [None, 1.0, None]
    assert Segments(batch).count.tolist() == [0, 1, 0]
    meets, unknown = g._on_pairs(g._intersect, rows, rows)
    assert (meets.tolist(), unknown.tolist()) == ([False, True, False], [False, False, True])
    assert np.isnan(g._on_pairs(g._distance, rows, rows)[0][0])


def test_boxes_that_are_the_geometry():
    square = [[0, 0], [0, 1], [1, 1], [1, 0], [0, 0]]
    shapes = {
        "square": ([square], True), "backwards": ([square[::-1]], True), "crossed": ([[[0, 0], [1, 1], [0, 1], [1, 0], [0, 0]]], False),
        "hole": ([square, square], False), "flat": ([[[0, 0], [0, 1], [0, 1], [0, 0], [0, 0]]], False), "skew": ([[[0, 0], [0, 2], [1, 1], [1, 0], [0, 0]]], False),
    }
    batch = Coordinates(pa.array([g.encode("Polygon", c) for c, _ in shapes.values()], pa.binary()))
    assert batch.boxes()["is_rect"].to_pylist() == [rect for _, rect in shapes.values()]
