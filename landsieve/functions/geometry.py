"""Geometry helpers for the Arrow batches of the spatial operators.

Shapes travel as WKB. Tests treat geometries as closed sets, so touching counts as intersecting.
Spark prunes the pairs by grid cell and bounding box first; these helpers only see the rest.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .albers import SRIDS, reproject
from .coordinates import Coordinates, Segments, wkb_of_text

# WKB type codes and their text names.
KINDS = {
    1: "Point", 2: "LineString", 3: "Polygon",
    4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection",
}
CODES = {name.lower(): code for code, name in KINDS.items()}
DEFAULT_SRID = 4326
PARSED = T.StructType([T.StructField("geom_wkb", T.BinaryType()), T.StructField("srid", T.IntegerType())])
BOX = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("minx", "miny", "maxx", "maxy")] + [T.StructField("is_rect", T.BooleanType())]
)


# --- WKB <-> nested coordinates ----------------------------------------------------------------

def encode(kind: str, coordinates) -> bytes | None:
    """Nested coordinates (as in GeoJSON) to little-endian two-dimensional WKB."""
    code = CODES[kind.lower()]
    head = struct.pack("<BI", 1, code)
    if code == 7:
        members = [encode(*m) for m in coordinates]
        return head + struct.pack("<I", len(members)) + b"".join(members)
    if not len(coordinates):
        return None

    def points(rows) -> bytes:
        flat = np.asarray([p[:2] for p in rows], dtype="<f8")
        return struct.pack("<I", len(flat)) + flat.tobytes()

    if code == 1:
        return head + struct.pack("<2d", *coordinates[:2])
    if code == 2:
        return head + points(coordinates)
    if code == 3:
        return head + struct.pack("<I", len(coordinates)) + b"".join(map(points, coordinates))
    members = [encode(KINDS[code - 3], c) for c in coordinates]
    return head + struct.pack("<I", len(members)) + b"".join(members)


def decode(wkb: bytes, offset: int = 0):
    """WKB (ISO or extended, any byte order, Z and M dropped) to ``(kind, coordinates, end)``."""
    order = "<" if wkb[offset] else ">"
    (raw,) = struct.unpack_from(order + "I", wkb, offset + 1)
    offset += 5
    if raw & 0x20000000:  # embedded SRID
        offset += 4
    flags, code = raw >> 28, raw & 0x0FFFFFFF
    width = 2 + bool(flags & 8) + bool(flags & 4) + (0, 1, 1, 2)[code // 1000]
    code %= 1000

    def points(at: int, count: int):
        flat = np.frombuffer(wkb, order + "f8", count * width, at).reshape(count, width)[:, :2]
        return flat, at + 8 * count * width

    def counted(at: int):
        (count,) = struct.unpack_from(order + "I", wkb, at)
        return count, at + 4

    if code == 1:
        flat, offset = points(offset, 1)
        return "Point", flat[0], offset
    count, offset = counted(offset)
    if code == 2:
        flat, offset = points(offset, count)
        return "LineString", flat, offset
    members = []
    for _ in range(count):
        if code == 3:
            size, offset = counted(offset)
            part, offset = points(offset, size)
        else:
            kind, part, offset = decode(wkb, offset)
            part = (kind, part) if code == 7 else part
        members.append(part)
    return KINDS[code], members, offset


def _nested(part):
    if isinstance(part, np.ndarray):
        return part.tolist()
    return [_nested(p) for p in part]


def to_geojson(wkb: bytes) -> dict:
    kind, coordinates, _ = decode(wkb)
    if kind == "GeometryCollection":
        return {"type": kind, "geometries": [to_geojson(encode(*m)) for m in coordinates]}
    return {"type": kind, "coordinates": _nested(coordinates)}


def from_geojson(geometry: dict | None) -> bytes | None:
    if not geometry:
        return None
    if geometry["type"] == "GeometryCollection":
        members = [(g["type"], g["coordinates"]) for g in geometry["geometries"]]
        return encode(geometry["type"], members) if members else None
    return encode(geometry["type"], geometry["coordinates"] or [])


_WKT = re.compile(r"\s*(?:SRID=(\d+);)?\s*([A-Za-z]+)\s*(?:Z|M|ZM)?\s*(\(.*\)|EMPTY)\s*$", re.S | re.I)


def from_wkt(text: str) -> tuple[bytes | None, int | None]:
    """Well-known text to WKB and SRID; malformed text raises ValueError."""
    match = _WKT.match(text)
    if not match or match[2].lower() not in CODES:
        raise ValueError(f"not a geometry text: {text[:60]!r}")
    srid = int(match[1]) if match[1] else None
    kind, body = match[2], match[3]
    if body.upper() == "EMPTY":
        return None, srid
    if kind.lower() == "geometrycollection":
        members = re.findall(r"[A-Za-z]+\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)", body[1:-1])
        parts = [decode(from_wkt(m)[0])[:2] for m in members]
        return encode(kind, parts), srid
    number = r"[-+.\deE]+"
    nested = re.sub(rf"({number}(?:\s+{number})+)", lambda m: "[" + ",".join(m[1].split()) + "]", body)
    coordinates = json.loads(nested.replace("(", "[").replace(")", "]"))
    if kind.lower() == "point":
        coordinates = coordinates[0]
    if kind.lower() == "multipoint":  # both "((1 1),(2 2))" and "(1 1,2 2)" are in use
        coordinates = [p[0] if isinstance(p[0], list) else p for p in coordinates]
    return encode(kind, coordinates), srid


def to_wkt(wkb: bytes) -> str:
    kind, coordinates, _ = decode(wkb)

    def text(part) -> str:
        if isinstance(part, np.ndarray) and part.ndim == 1:
            return " ".join(repr(float(v)).removesuffix(".0") for v in part)
        return "(" + ",".join(text(p) for p in part) + ")"

    if kind == "GeometryCollection":
        return "GEOMETRYCOLLECTION(" + ",".join(to_wkt(encode(*m)) for m in coordinates) + ")"
    if kind == "MultiPoint":
        coordinates = [p.reshape(1, 2) for p in coordinates]
    body = text(coordinates)
    return f"{kind.upper()}({body})" if kind == "Point" else kind.upper() + body


# --- exact tests ---------------------------------------------------------------------------------

class Shape:
    """A single geometry for the pair tests."""

    __slots__ = ("wkb",)

    def __init__(self, wkb: bytes):
        self.wkb = wkb


# Element pairs handled at once; bounds the memory of a batch.
CHUNK = 1_000_000


def _ragged(n: np.ndarray, first_n: np.ndarray, m: np.ndarray, first_m: np.ndarray):
    """All combinations within each pair of rows: places of both elements, and where each pair starts."""
    counts = n * m
    starts = np.cumsum(counts) - counts
    local = np.arange(counts.sum()) - np.repeat(starts, counts)
    width = np.repeat(m, counts)
    return np.repeat(first_n, counts) + local // width, np.repeat(first_m, counts) + local % width, starts


def _side(a, b, p):
    return np.sign((b[:, 0] - a[:, 0]) * (p[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[:, 0] - a[:, 0]))


def _within_box(a, b, p):
    return ((np.minimum(a, b) <= p) & (p <= np.maximum(a, b))).all(1)


def _segments_meet(a: Segments, i: np.ndarray, b: Segments, j: np.ndarray) -> np.ndarray:
    left, right, starts = _ragged(a.count[i], a.first[i], b.count[j], b.first[j])
    p, q, r, s = a.start[left], a.end[left], b.start[right], b.end[right]
    d1, d2, d3, d4 = _side(p, q, r), _side(p, q, s), _side(r, s, p), _side(r, s, q)
    meet = (d1 * d2 < 0) & (d3 * d4 < 0)
    for zero, ends, point in ((d1, (p, q), r), (d2, (p, q), s), (d3, (r, s), p), (d4, (r, s), q)):
        meet |= (zero == 0) & _within_box(*ends, point)
    return np.logical_or.reduceat(meet, starts)


def _covers_anchor(areas: Segments, i: np.ndarray, others: Segments, j: np.ndarray) -> np.ndarray:
    """Whether a part of ``others`` starts inside ``areas``, by the even-odd rule.

    Holes and several parts need no special case. All areas have to have bounding segments.
    """
    anchors, sides = others.anchor_count[j], areas.area_count[i]
    point, side, _ = _ragged(anchors, others.anchor_first[j], sides, areas.area_first[i])
    per_anchor = np.repeat(sides, anchors)
    (px, py), (x1, y1), (x2, y2) = others.anchors[point].T, areas.area_start[side].T, areas.area_end[side].T
    spans = (y1 > py) != (y2 > py)
    height = np.where(spans, y2 - y1, 1.0)
    right_of = spans & (x1 + (py - y1) / height * (x2 - x1) > px)
    inside = np.add.reduceat(right_of.astype(int), np.cumsum(per_anchor) - per_anchor) % 2 == 1
    owner = np.repeat(np.arange(len(i)), anchors)
    return np.bincount(owner[inside], minlength=len(i)) > 0


def _chunks(work: np.ndarray):
    """Consecutive pairs of limited total work."""
    total = np.cumsum(work)
    first = 0
    while first < len(work):
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + CHUNK, "right")))
        yield first, last
        first = last


def _intersect(a: Segments, i: np.ndarray, b: Segments, j: np.ndarray) -> np.ndarray:
    """For each pair of rows of two batches whether they share a point; rows without coordinates share none."""
    result = np.zeros(len(i), bool)
    work = a.count[i] * b.count[j]
    some = np.flatnonzero(work)
    for first, last in _chunks(work[some]):
        pairs = some[first:last]
        result[pairs] = _segments_meet(a, i[pairs], b, j[pairs])
        for outer, inner, x, y in ((a, b, i, j), (b, a, j, i)):
            open_ = pairs[~result[pairs] & (outer.area_count[x[pairs]] > 0)]
            if len(open_):
                result[open_] = _covers_anchor(outer, x[open_], inner, y[open_])
    return result


def _tip_gaps(a: Segments, i: np.ndarray, b: Segments, j: np.ndarray) -> np.ndarray:
    """Per pair the shortest way from a segment end of ``a`` to a segment of ``b``."""
    left, right, starts = _ragged(a.count[i], a.first[i], b.count[j], b.first[j])
    begin, along = b.start[right], b.end[right] - b.start[right]
    length = (along**2).sum(1)
    length[length == 0] = 1.0
    gaps = []
    for tips in (a.start, a.end):
        point = tips[left]
        share = ((point - begin) * along).sum(1) / length
        nearest = begin + np.clip(share, 0.0, 1.0)[:, None] * along
        gaps.append(np.minimum.reduceat(((point - nearest) ** 2).sum(1), starts))
    return np.sqrt(np.minimum(*gaps))


def _distance(a: Segments, i: np.ndarray, b: Segments, j: np.ndarray) -> np.ndarray:
    """For each pair of rows their distance, zero where they share a point, NaN where one has no coordinates."""
    work = a.count[i] * b.count[j]
    result = np.where(work > 0, 0.0, np.nan)
    apart = np.flatnonzero(~_intersect(a, i, b, j) & (work > 0))
    for first, last in _chunks(work[apart]):
        pairs = apart[first:last]
        result[pairs] = np.minimum(_tip_gaps(a, i[pairs], b, j[pairs]), _tip_gaps(b, j[pairs], a, i[pairs]))
    return result


def _of_shapes(test, a: list[Shape], b: list[Shape]) -> np.ndarray:
    sides = [Segments(Coordinates(pa.array([bytes(x.wkb) for x in side], pa.binary()))) for side in (a, b)]
    rows = np.arange(len(a))
    return test(sides[0], rows, sides[1], rows)


def pairs_intersect(a: list[Shape], b: list[Shape]) -> np.ndarray:
    """For each pair of shapes whether they share a point."""
    return _of_shapes(_intersect, a, b)


def pairs_distance(a: list[Shape], b: list[Shape]) -> np.ndarray:
    """For each pair of shapes their distance, zero where they share a point."""
    return _of_shapes(_distance, a, b)


def _on_pairs(test, a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Result for each pair, and which pairs lack a side. Each distinct geometry of the batch is parsed once."""
    known = pc.and_(pc.is_valid(a), pc.is_valid(b))
    rows = np.flatnonzero(known.to_numpy(zero_copy_only=False))
    sides = []
    for values in (a, b):
        coded = values.filter(known).dictionary_encode()
        sides += [Segments(Coordinates(coded.dictionary)), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
    found = test(*sides)
    out = np.zeros(len(a), found.dtype)
    out[rows] = found
    unknown = np.ones(len(a), bool)
    unknown[rows] = False
    return out, unknown


@F.arrow_udf(T.BooleanType())
def st_intersects(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether two WKB geometries share a point; NULL when either is NULL."""
    meet, unknown = _on_pairs(_intersect, a, b)
    return pa.array(meet, mask=unknown)


@F.arrow_udf(T.DoubleType())
def st_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Planar distance between two WKB geometries; NULL when either is NULL or has no coordinates."""
    gaps, unknown = _on_pairs(_distance, a, b)
    return pa.array(gaps, mask=unknown | np.isnan(gaps))


# --- column helpers ------------------------------------------------------------------------------

def _replaced(values: pa.Array, rows: np.ndarray, others: list) -> pa.Array:
    """``values`` with those of ``rows`` taken from ``others``."""
    if not len(rows):
        return values
    mask = np.zeros(len(values), bool)
    mask[rows] = True
    return pc.replace_with_mask(values, pa.array(mask), pa.array(others, values.type))


@F.arrow_udf(PARSED)
def parse_wkt(text: pa.Array) -> pa.Array:
    """Well-known text to WKB and SRID; malformed text yields NULLs.

    Points, lines, polygons and multipolygons are read a batch at once, other types text by text.
    """

    def parse(value):
        try:
            return from_wkt(value)
        except (ValueError, TypeError, IndexError):
            return None, None

    wkb, srid, rest = wkb_of_text(text)
    parsed = [parse(v) for v in text.take(pa.array(rest)).to_pylist()]
    wkb, srid = _replaced(wkb, rest, [w for w, _ in parsed]), _replaced(srid, rest, [s for _, s in parsed])
    return pa.StructArray.from_arrays([wkb, srid], ["geom_wkb", "srid"])


def _texts(wkb: pa.Array, json_text: bool, single) -> pa.Array:
    texts, rest = Coordinates(wkb).texts(json_text)
    return _replaced(texts, rest, [single(v) for v in wkb.take(pa.array(rest)).to_pylist()])


@F.arrow_udf(T.StringType())
def as_wkt(wkb: pa.Array) -> pa.Array:
    return _texts(wkb, False, to_wkt)


@F.arrow_udf(T.StringType())
def as_geojson(wkb: pa.Array) -> pa.Array:
    return _texts(wkb, True, lambda v: json.dumps(to_geojson(v)))


@F.pandas_udf(T.BinaryType())
def parse_geojson(text: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else from_geojson(json.loads(v)) for v in text], dtype="object")


CHECKED = T.StructType([T.StructField("geom_wkb", T.BinaryType()), T.StructField("error", T.StringType())])


@F.pandas_udf(CHECKED)
def checked_geojson(text: pd.Series) -> pd.DataFrame:
    """GeoJSON geometry to WKB, or why it is none."""

    def one(value):
        try:
            return (None if value is None else from_geojson(json.loads(value))), None
        except Exception as problem:  # noqa: BLE001  whatever is in the text
            return None, f"geometry: {type(problem).__name__}: {problem}"

    return pd.DataFrame([one(v) for v in text], columns=["geom_wkb", "error"], dtype="object")


@F.arrow_udf(BOX)
def envelope(wkb: pa.Array) -> pa.Array:
    """Bounding box, and whether the geometry is exactly that box; NULLs without coordinates."""
    boxes = Coordinates(wkb).boxes()
    return pa.StructArray.from_arrays(list(boxes.values()), list(boxes))


@F.arrow_udf(T.BinaryType())
def _transform(wkb: pa.Array, source: pa.Array, target: pa.Array) -> pa.Array:
    """Coordinates replaced in place; other binary forms are first brought to the plain one."""
    a, b = (np.asarray(pc.fill_null(x, 0)).astype(int) for x in (source, target))
    change = pc.is_valid(wkb).to_numpy(zero_copy_only=False) & (a != b)
    wkb = wkb.cast(pa.binary())
    moving = pc.if_else(pa.array(change), wkb, pa.scalar(None, pa.binary()))
    shapes = Coordinates(moving)
    odd = np.flatnonzero(change & ~shapes.plain)
    if len(odd):
        shapes = Coordinates(_replaced(moving, odd, [encode(*decode(v)[:2]) for v in moving.take(pa.array(odd)).to_pylist()]))
    xy = shapes.xy.copy()
    for pair in {(int(x), int(y)) for x, y in np.unique(np.stack([a[change], b[change]], 1), axis=0)}:
        points = ((a == pair[0]) & (b == pair[1]))[shapes.point_row]
        xy[points] = reproject(xy[points], *pair)
    return pc.if_else(pa.array(change), shapes.with_xy(xy), wkb)


def effective_srid(srid: str = "srid") -> Column:
    """The stated SRID, or 4326 where none is stated."""
    return F.coalesce(F.col(srid), F.lit(DEFAULT_SRID))


def with_envelope(df):
    """Add or refresh the bounding box columns of ``geom_wkb``."""
    boxed = df.withColumn("_box", envelope("geom_wkb"))
    names = ["minx", "miny", "maxx", "maxy", "is_rect"]
    return boxed.withColumns({n: F.col(f"_box.{n}") for n in names}).drop("_box")


def transform_srid(df, to: int):
    """Bring every geometry to SRID ``to``; rows already there keep their exact coordinates."""
    if to not in SRIDS:
        raise ValueError(f"unsupported SRID {to}")
    source = effective_srid() if "srid" in df.columns else F.lit(DEFAULT_SRID)
    moved = df.withColumn("geom_wkb", _transform("geom_wkb", source, F.lit(to))).withColumn("srid", F.lit(to))
    return with_envelope(moved)
