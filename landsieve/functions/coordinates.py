"""All geometries of an Arrow batch as one coordinate array with offsets.

A *run* is a point, a line or a ring: coordinates that lie together. Boxes, projections, texts and
intersections work on the runs of a whole batch at once; no loop goes over its rows.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

POINT, LINE, POLYGON, MULTI_POINT, MULTI_LINE, MULTI_POLYGON, COLLECTION = range(1, 8)
PREFIXES = pa.array(["", "POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON"])
JSON_PREFIXES = pa.array(["", "Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon"])


def ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``first[k], first[k] + 1, ...`` for each k, ``counts[k]`` numbers long."""
    before = np.cumsum(counts) - counts
    return np.repeat(first - before, counts) + np.arange(counts.sum())


def binary_parts(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a binary or text array."""
    values = values.cast(pa.large_binary())
    _, places, data = values.buffers()
    offsets = np.frombuffer(places, np.int64, len(values) + 1, 8 * values.offset) if len(values) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def binary_array(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Binary array whose row k is ``data[offsets[k]:offsets[k + 1]]``, or null where not ``valid``."""
    if len(data) >= 2**31 - 1:
        raise ValueError("a batch of geometries of over 2 GB; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    bits = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(valid), [bits, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _doubles(data: np.ndarray, phase: int, order: str) -> np.ndarray:
    """The numbers at bytes phase, phase + 8, ... of ``data``."""
    return data[phase : phase + (len(data) - phase) // 8 * 8].view(order + "f8")


class Coordinates:
    """Parsed WKB of a batch: ISO or extended, any byte order; Z and M are dropped.

    ``kind``: type code of each row, 0 for null. ``xy``: all coordinates; run k has those from
    ``start[k]``, ``count[k]`` of them, belongs to ``row[k]``, is a POINT, LINE or POLYGON (ring) by
    ``run_kind[k]`` and lies in the row's member ``member[k]``. ``plain``: rows that are
    little-endian and two-dimensional without an SRID. Bytes that end too early raise ValueError.
    """

    def __init__(self, wkb: pa.Array):
        self.wkb = wkb
        self.data, self.offsets = binary_parts(wkb)
        self.valid = pc.is_valid(wkb).to_numpy(zero_copy_only=False)
        self.kind = np.zeros(len(wkb), np.int64)
        self.plain = self.valid.copy()
        self._scan()

    def __len__(self) -> int:
        return len(self.wkb)

    def _need(self, ends: np.ndarray, rows: np.ndarray) -> None:
        if (ends > self.offsets[rows + 1]).any():
            raise ValueError("a geometry ends within a number")

    def _number(self, at: np.ndarray, rows: np.ndarray, big: np.ndarray) -> np.ndarray:
        self._need(at + 4, rows)
        raw = self.data[at[:, None] + np.arange(4)].view("<u4")[:, 0]
        return np.where(big, raw.byteswap(), raw).astype(np.int64)

    def _scan(self) -> None:
        """One step reads the next header or ring of every unfinished row."""
        rows = np.flatnonzero(self.valid)
        cursor = self.offsets[:-1].copy()
        n = len(self)
        members, rings, member = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)
        members[rows] = 1
        big, width = np.zeros(n, bool), np.full(n, 2)
        found: list[tuple[np.ndarray, ...]] = []

        def take(some: np.ndarray, counts: np.ndarray, kind: int) -> None:
            begin = cursor[some]
            cursor[some] += 8 * counts * width[some]
            self._need(cursor[some], some)
            found.append((some, begin, counts, width[some], big[some], np.full(len(some), kind), member[some]))

        while len(rows):
            ringed = rows[rings[rows] > 0]
            if len(ringed):
                counts = self._number(cursor[ringed], ringed, big[ringed])
                cursor[ringed] += 4
                rings[ringed] -= 1
                take(ringed, counts, POLYGON)
            heads = np.setdiff1d(rows, ringed, assume_unique=True)
            if len(heads):
                self._need(cursor[heads] + 5, heads)
                big[heads] = self.data[cursor[heads]] == 0
                raw = self._number(cursor[heads] + 1, heads, big[heads])
                flags, code = raw >> 28, raw & 0x0FFFFFFF
                cursor[heads] += 5 + 4 * ((flags & 2) > 0)
                if (code // 1000 > 3).any() or ((code % 1000 < 1) | (code % 1000 > 7)).any():
                    raise ValueError("an unknown type of geometry")
                width[heads] = 2 + ((flags & 8) > 0) + ((flags & 4) > 0) + np.array([0, 1, 1, 2])[code // 1000]
                self.plain[heads] &= (raw < 8) & ~big[heads]
                code %= 1000
                first = self.kind[heads] == 0
                self.kind[heads[first]] = code[first]
                members[heads] -= 1
                member[heads] += 1
                points = heads[code == POINT]
                take(points, np.ones(len(points), np.int64), POINT)
                counted, code = heads[code != POINT], code[code != POINT]
                counts = self._number(cursor[counted], counted, big[counted])
                cursor[counted] += 4
                take(counted[code == LINE], counts[code == LINE], LINE)
                rings[counted[code == POLYGON]] = counts[code == POLYGON]
                nested = code >= MULTI_POINT
                self._need(cursor[counted[nested]] + 5 * counts[nested], counted[nested])
                members[counted[nested]] += counts[nested]
            rows = rows[(members[rows] > 0) | (rings[rows] > 0)]
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 7
        order = np.argsort(columns[0], kind="stable")  # steps of one row come in the order of its bytes
        self.row, self.at, self.count, self.width, big_run, self.run_kind, self.member = (c[order] for c in columns)
        self.big = big_run.astype(bool)
        self.start = np.cumsum(self.count) - self.count

    def _groups(self):
        """Runs of one layout, with places of their numbers in an aligned view of the bytes."""
        layout = self.at % 8 * 16 + self.width * 2 + self.big
        for value in np.unique(layout):
            some = np.flatnonzero(layout == value)
            phase, width, order = int(value) // 16, int(value) % 16 // 2, "<>"[int(value) % 2]
            counts = self.count[some]
            inner = ranges(np.zeros(len(some), np.int64), counts)
            source = np.repeat((self.at[some] - phase) // 8, counts) + inner * width
            yield phase, order, source, np.repeat(self.start[some], counts) + inner

    @cached_property
    def xy(self) -> np.ndarray:
        xy = np.empty((int(self.count.sum()), 2))
        for phase, order, source, target in self._groups():
            numbers = _doubles(self.data, phase, order)
            xy[target, 0], xy[target, 1] = numbers[source], numbers[source + 1]
        return xy

    @cached_property
    def point_row(self) -> np.ndarray:
        return np.repeat(self.row, self.count)

    def with_xy(self, xy: np.ndarray) -> pa.Array:
        """The same geometries with other coordinates; all rows have to be plain or null."""
        data = self.data.copy()
        for phase, order, place, source in self._groups():
            numbers = _doubles(data, phase, order)
            numbers[place], numbers[place + 1] = xy[source, 0], xy[source, 1]
        first, last = self.offsets[0], self.offsets[-1]
        return binary_array(data[first:last], self.offsets - first, self.valid)

    def boxes(self) -> dict[str, np.ndarray | pa.Array]:
        """minx, miny, maxx, maxy, and whether the geometry is exactly that box; null without coordinates."""
        low, high = np.full((len(self), 2), np.nan), np.full((len(self), 2), np.nan)
        size = np.bincount(self.point_row, minlength=len(self))
        known = np.flatnonzero(size)
        if len(known):
            begins = (np.cumsum(size) - size)[known]
            low[known] = np.minimum.reduceat(self.xy, begins)
            high[known] = np.maximum.reduceat(self.xy, begins)
        one = np.bincount(self.row, minlength=len(self))[self.row] == 1
        five = np.flatnonzero(one & (self.run_kind == POLYGON) & (self.count == 5))
        rows = self.row[five]
        corners = self.xy[self.start[five][:, None] + np.arange(5)]
        at_high = corners == high[rows][:, None]
        on_box = (at_high | (corners == low[rows][:, None])).all((1, 2)) & (high[rows] > low[rows]).all(1)
        closed = (corners[:, 0] == corners[:, 4]).all(1)
        turns = ((corners[:, 1:] != corners[:, :-1]).sum(2) == 1).all(1)
        places = np.sort(at_high[:, :4, 0] + 2 * at_high[:, :4, 1], axis=1)
        rect = np.zeros(len(self), bool)
        rect[rows] = on_box & closed & turns & (places == np.arange(4)).all(1)
        names = ("minx", "miny", "maxx", "maxy")
        hidden = size == 0
        columns = dict(zip(names, (low[:, 0], low[:, 1], high[:, 0], high[:, 1])))
        return {n: pa.array(v, mask=hidden) for n, v in columns.items()} | {"is_rect": pa.array(rect, mask=hidden)}

    def _joined(self, parts: pa.Array, counts: np.ndarray, comma: str) -> pa.Array:
        places = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(places, parts), comma)

    def texts(self, json: bool = False) -> tuple[pa.Array, np.ndarray]:
        """Well-known text or GeoJSON of each row, and the rows left out (collections, unusual numbers, no coordinates)."""
        text, comma, (left, right) = pa.string(), ", " if json else ",", "[]" if json else "()"
        wrap = lambda x: pc.binary_join_element_wise(pa.scalar(left, text), x, pa.scalar(right, text), pa.scalar("", text))
        odd = ~self.valid | (self.kind == COLLECTION) | (np.bincount(self.row, self.count, len(self)) == 0)
        odd[self.point_row[~np.isfinite(self.xy).all(1)]] = True
        odd[self.row[self.count == 0]] = True
        numbers = self.xy.tolist()
        if json:
            points = pa.array([f"[{x!r}, {y!r}]" for x, y in numbers], text)
        else:
            points = pa.array([f"{repr(x).removesuffix('.0')} {repr(y).removesuffix('.0')}" for x, y in numbers], text)
        runs = self._joined(points, self.count, comma)
        bare = self.run_kind == POINT if json else (self.run_kind == POINT) & (self.kind[self.row] == POINT)
        runs = pc.if_else(pa.array(bare), runs, wrap(runs))
        # Rings of one polygon, then polygons of one row.
        fresh = np.ones(len(self.row), bool)
        fresh[1:] = (self.row[1:] != self.row[:-1]) | (self.member[1:] != self.member[:-1])
        members = self._joined(runs, np.diff(np.append(np.flatnonzero(fresh), len(fresh))), comma)
        owner = self.row[fresh]
        members = pc.if_else(pa.array(np.isin(self.kind[owner], (POLYGON, MULTI_POLYGON))), wrap(members), members)
        rows = self._joined(members, np.bincount(owner, minlength=len(self)), comma)
        single = pa.array(self.kind <= POLYGON)
        nested = wrap(rows)
        if json:
            body = pc.if_else(single, rows, nested)
            head, tail = pa.scalar('{"type": "', text), pa.scalar("}", text)
            kinds = JSON_PREFIXES.take(pa.array(np.where(odd, 0, self.kind))).cast(text)
            whole = pc.binary_join_element_wise(head, kinds, pa.scalar('", "coordinates": ', text), body, tail, pa.scalar("", text))
        else:
            body = pc.if_else(pa.array(self.kind == POINT), nested, pc.if_else(single, rows, nested))
            kinds = PREFIXES.take(pa.array(np.where(odd, 0, self.kind))).cast(text)
            whole = pc.binary_join_element_wise(kinds, body, pa.scalar("", text))
        return pc.if_else(pa.array(odd), pa.scalar(None, text), whole), np.flatnonzero(odd & self.valid)


class Segments:
    """The line segments of each row of ``Coordinates``; a point is a segment of no length.

    Row k has ``count[k]`` segments from ``first[k]`` and ``anchors`` one vertex for each of its runs;
    ``area_*`` are the segments that bound an area.
    """

    def __init__(self, coordinates: Coordinates):
        c, n = coordinates, len(coordinates)
        long = (c.run_kind != POINT) & ((c.count > 1) | (c.run_kind == POLYGON))
        pieces = np.where(long, np.maximum(c.count - 1, 0), c.count)
        begin = ranges(c.start, pieces)
        self.start, self.end = c.xy[begin], c.xy[begin + np.repeat(long, pieces)]
        owner = np.repeat(c.row, pieces)
        self.count, self.first = self._places(owner, n)
        bounds = np.repeat(c.run_kind == POLYGON, pieces)
        self.area_count, self.area_first = self._places(owner[bounds], n)
        self.area_start, self.area_end = self.start[bounds], self.end[bounds]
        filled = c.count > 0
        self.anchors = c.xy[c.start[filled]]
        self.anchor_count, self.anchor_first = self._places(c.row[filled], n)

    @staticmethod
    def _places(owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        counts = np.bincount(owner, minlength=rows)
        return counts, np.cumsum(counts) - counts


#: Characters of text handled at once; bounds the memory of a batch.
TEXT_CHUNK = 4_000_000
SIMPLE_TEXT = r"^\s*(?:SRID=(?P<srid>\d{1,9});)?\s*(?P<kind>(?i:POINT|LINESTRING|POLYGON|MULTIPOLYGON))\s*(?P<body>\([-+.\deE ,()]*\))\s*$"
# Brackets around the coordinates of each type; types without an entry go to the parser of single texts.
DEPTHS = np.array([0, 1, 1, 2, 0, 0, 3])
OPEN, CLOSE, COMMA, NUMBER = 1, 2, 3, 4
#: What may follow what, blanks left out.
FOLLOWS = np.zeros((5, 5), bool)
for _pair in ((OPEN, OPEN), (OPEN, NUMBER), (NUMBER, NUMBER), (NUMBER, COMMA), (NUMBER, CLOSE), (COMMA, NUMBER), (COMMA, OPEN), (CLOSE, CLOSE), (CLOSE, COMMA)):
    FOLLOWS[_pair] = True


def text_slices(text: pa.Array):
    """Consecutive slices of limited length; a longer text is a slice of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(text):
        done = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, done + TEXT_CHUNK, "right")))
        yield text.slice(first, last - first)
        first = last


def wkb_of_text(text: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """WKB and SRID of points, lines, polygons and multipolygons in well-known text, and the rows left to a parser of single texts.

    All numbers of a slice are read at once. A text counts only if its signs follow each other as its
    type demands; one malformed number leaves its whole slice to the other parser.
    """
    shapes, srids, left, before = [], [], [], 0
    for part in text_slices(text):
        wkb, srid, rest = _wkb_of_slice(part)
        shapes.append(wkb)
        srids.append(srid)
        left.append(rest + before)
        before += len(part)
    if not shapes:
        return pa.array([], pa.binary()), pa.array([], pa.int32()), np.zeros(0, np.int64)
    return pa.concat_arrays(shapes), pa.concat_arrays(srids), np.concatenate(left)


def _wkb_of_slice(text: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    n = len(text)
    parts = pc.extract_regex(text, SIMPLE_TEXT)
    known = pc.is_valid(parts).to_numpy(zero_copy_only=False)
    names = pc.utf8_upper(pc.struct_field(parts, "kind"))
    kind = np.where(known, pc.fill_null(pc.index_in(names, PREFIXES), 0).to_numpy(zero_copy_only=False), 0)
    depth = DEPTHS[kind].astype(np.int32)
    bodies = pc.if_else(pa.array(known), pc.fill_null(pc.struct_field(parts, "body"), ""), "")
    data, offsets = binary_parts(bodies)
    data = data[offsets[0] : offsets[-1]]
    if not len(data):
        return pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), np.flatnonzero(pc.is_valid(text).to_numpy(zero_copy_only=False))
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    opened, closed, comma, blank = (data == ord(c) for c in "(), ")
    sign = opened | closed | comma
    begins = ~sign & ~blank  # bodies begin and end with a bracket, so numbers end within their text
    begins[1:] &= sign[:-1] | blank[:-1]
    step = opened.astype(np.int32) - closed
    height = np.bincount(owner, step, n).astype(np.int32)
    level = np.cumsum(step, dtype=np.int32) - (np.cumsum(height, dtype=np.int32) - height)[owner]
    kept = np.flatnonzero(sign | begins)
    code = np.select([opened[kept], closed[kept], comma[kept]], [OPEN, CLOSE, COMMA], NUMBER).astype(np.int8)
    of, level = owner[kept], level[kept]
    same, number, at_depth = of[1:] == of[:-1], code == NUMBER, level == depth[of]
    last, to_number = np.ones(len(code), bool), np.zeros(len(code), bool)
    last[:-1], to_number[:-1] = ~same, number[1:] & same
    bad = height != 0
    bad[of[1:][same & ~FOLLOWS[code[:-1], code[1:]]]] = True
    bad[of[(number & ~at_depth) | (level < 0) | (level > depth[of]) | ((code == CLOSE) & (level == 0) & ~last)]] = True
    # Two numbers make a point; a comma between points lies at the depth of the coordinates, one between parts above it.
    signs = np.flatnonzero(~number)
    between = np.diff(signs) - 1
    bad[of[signs[:-1]][(between != 0) & (between != 2)]] = True
    bad[of[(code == COMMA) & (to_number != at_depth)]] = True
    points = np.bincount(of[number], minlength=n) // 2
    good = known & ~bad & (points > 0) & ((kind != POINT) | (points == 1))
    try:
        flat = np.fromstring(np.where(sign, np.uint8(32), data).tobytes(), sep=" ")
    except ValueError:  # a malformed number
        good[:] = False
        flat = np.zeros(int(number.sum()))
    chosen = good[of]
    wkb = _assembled(kind, good, code[chosen], of[chosen], level[chosen], depth, flat[chosen[number]])
    srid = pc.struct_field(parts, "srid")
    srid = pc.if_else(pc.and_(pa.array(good), pc.not_equal(srid, "")), srid, pa.scalar(None, srid.type)).cast(pa.int32())
    return wkb, srid, np.flatnonzero(~good & pc.is_valid(text).to_numpy(zero_copy_only=False))


def _assembled(kind, good, code, of, level, depth, numbers) -> pa.Array:
    """WKB of checked texts: each bracket becomes a header or a count, the innermost ones with their coordinates."""
    opened = np.flatnonzero(code == OPEN)
    at, rows = level[opened], of[opened]
    polygon = (kind[rows] == MULTI_POLYGON) & (at == 2)
    header = (at == 1) | polygon
    own = np.where(header, 9, 4) - 4 * (kind[rows] == POINT)
    held = np.bincount(np.searchsorted(opened, np.flatnonzero(code == NUMBER)) - 1, minlength=len(opened))
    amount = held // 2
    for outer in (1, 2):  # brackets in a bracket follow it
        parents = np.flatnonzero((at == outer) & (at < depth[rows]))
        if len(parents):
            inside = np.searchsorted(parents, np.flatnonzero(at == outer + 1)) - 1
            amount[parents] = np.bincount(inside, minlength=len(parents))
    size = own + 8 * held
    place = np.cumsum(size) - size
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, size, len(kind)))]).astype(np.int64)
    data = np.zeros(int(offsets[-1]), np.uint8)
    data[place[header]] = 1
    data[place[header] + 1] = np.where(polygon[header], POLYGON, kind[rows[header]])
    counted = np.flatnonzero(kind[rows] != POINT)
    spot = place[counted] + np.where(header[counted], 5, 0)
    data[spot[:, None] + np.arange(4)] = amount[counted].astype("<u4").view(np.uint8).reshape(-1, 4)
    begin, source = place + own, np.cumsum(held) - held
    for phase in range(8):
        some = np.flatnonzero((begin % 8 == phase) & (held > 0))
        if len(some):
            _doubles(data, phase, "<")[ranges((begin[some] - phase) // 8, held[some])] = numbers[ranges(source[some], held[some])]
    return binary_array(data, offsets, good)
