"""Record access to shapefiles and GeoPackages, for use inside tasks.

Both formats allow reading a range of records without the rest of the file: shapefiles by their
offset index and fixed-width attribute rows, GeoPackages by row id.
"""

from __future__ import annotations

import contextlib
import csv
import io
import os
import re
import shutil
import sqlite3
import struct
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyarrow import fs as pafs

from ..functions.geometry import Shape, encode, pairs_intersect


@dataclass
class Header:
    """What a file holds: attribute columns, record numbers ``first`` to ``last``, SRID."""

    columns: list[str]
    first: int
    last: int
    srid: int | None = None
    has_geometry: bool = True
    extra: dict = field(default_factory=dict)


def _filesystem(path: str):
    if re.match(r"file:/(?!//)", path):
        path = "file://" + path.removeprefix("file:")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def read_range(path: str, start: int = 0, length: int | None = None) -> bytes:
    system, name = _filesystem(path)
    with system.open_input_file(name) as source:
        source.seek(start)
        return source.read() if length is None else source.read(length)


def file_size(path: str) -> int:
    system, name = _filesystem(path)
    info = system.get_file_info(name)
    return info.size if info.is_file else -1


@contextlib.contextmanager
def local_copy(path: str) -> Iterator[str]:
    """A name the local file system can open; remote files are fetched for the task only."""
    system, name = _filesystem(path)
    if isinstance(system, pafs.LocalFileSystem):
        yield name
        return
    with tempfile.TemporaryDirectory() as folder:
        target = os.path.join(folder, "layer")
        with system.open_input_stream(name) as source, open(target, "wb") as out:
            shutil.copyfileobj(source, out)
        yield target


# --- shapefile -----------------------------------------------------------------------------------

def _sibling(path: str, ext: str) -> str:
    return path[: -len("shp")] + ext


def _projection(text: str) -> int | None:
    codes = re.findall(r'AUTHORITY\["EPSG","(\d+)"\]', text)
    if codes:
        return int(codes[-1])
    if text.lstrip().upper().startswith("GEOGCS"):
        return 4326
    return 5070 if "ALBERS" in text.upper() and "CONUS" in text.upper().replace("CONTIGUOUS", "CONUS") else None


def _dbf_fields(head: bytes) -> list[tuple[str, str, int]]:
    fields, at = [], 32
    while at + 32 <= len(head) and head[at] != 0x0D:
        name = head[at : at + 11].split(b"\0")[0].decode("ascii", "replace")
        fields.append((name, chr(head[at + 11]), head[at + 16]))
        at += 32
    return fields


def shp_header(path: str) -> Header:
    shape_type = struct.unpack_from("<i", read_range(path, 32, 4))[0]
    records = (file_size(_sibling(path, "shx")) - 100) // 8
    if records < 0:
        raise ValueError("the .shx index is missing")
    fields, layout = [], (0, 0)
    if file_size(_sibling(path, "dbf")) > 32:
        layout = struct.unpack_from("<HH", read_range(_sibling(path, "dbf"), 8, 4))
        fields = _dbf_fields(read_range(_sibling(path, "dbf"), 0, layout[0]))
    prj = read_range(_sibling(path, "prj")).decode("utf-8", "replace") if file_size(_sibling(path, "prj")) > 0 else ""
    code = read_range(_sibling(path, "cpg")).decode("ascii", "replace").strip() if file_size(_sibling(path, "cpg")) > 0 else ""
    extra = {"fields": fields, "layout": layout, "encoding": code or "latin-1"}
    return Header([f[0] for f in fields], 0, records - 1, _projection(prj), shape_type != 0, extra)


def _rings_to_polygons(rings: list[np.ndarray]):
    """Clockwise rings are shells, the others holes of the shell around them."""
    def area(ring):
        x, y = ring[:, 0], ring[:, 1]
        return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum())

    shells = [[r] for r in rings if area(r) <= 0] or [[r] for r in rings]
    holes = [r for r in rings if area(r) > 0] if any(area(r) <= 0 for r in rings) else []
    outlines = [Shape(encode("Polygon", s)) for s in shells] if len(shells) > 1 else []
    for hole in holes:
        corner = Shape(encode("Point", hole[0]))
        owners = np.flatnonzero(pairs_intersect(outlines, [corner] * len(outlines))) if outlines else []
        shells[owners[0] if len(owners) else 0].append(hole)
    return ("Polygon", shells[0]) if len(shells) == 1 else ("MultiPolygon", shells)


def shp_geometry(content: bytes) -> bytes | None:
    """One shape record to WKB; null shapes yield None."""
    (kind,) = struct.unpack_from("<i", content)
    base = kind % 10
    if kind == 0:
        return None
    if base == 1:
        return encode("Point", struct.unpack_from("<2d", content, 4))
    if base == 8:
        (count,) = struct.unpack_from("<i", content, 36)
        return encode("MultiPoint", np.frombuffer(content, "<f8", count * 2, 40).reshape(-1, 2))
    if base not in (3, 5):
        raise ValueError(f"unsupported shape type {kind}")
    parts, count = struct.unpack_from("<2i", content, 36)
    starts = [*struct.unpack_from(f"<{parts}i", content, 44), count]
    points = np.frombuffer(content, "<f8", count * 2, 44 + 4 * parts).reshape(-1, 2)
    pieces = [points[a:b] for a, b in zip(starts, starts[1:]) if b > a]
    if not pieces:
        return None
    if base == 3:
        return encode("LineString", pieces[0]) if len(pieces) == 1 else encode("MultiLineString", pieces)
    return encode(*_rings_to_polygons(pieces))


def _dbf_value(raw: bytes, kind: str, encoding: str) -> str | None:
    text = raw.decode(encoding, "replace").strip(" \0")
    if not text or set(text) == {"*"}:
        return None
    if kind == "D" and len(text) == 8:
        return None if text == "00000000" else f"{text[:4]}-{text[4:6]}-{text[6:]}"
    if kind == "L":
        return {"T": "true", "Y": "true", "F": "false", "N": "false"}.get(text.upper())
    return text


def shp_rows(path: str, header: Header, first: int, last: int) -> Iterator[tuple[dict, bytes | None]]:
    count = last - first + 1
    index = np.frombuffer(read_range(_sibling(path, "shx"), 100 + 8 * first, 8 * count), ">i4").reshape(-1, 2).astype("i8") * 2
    begin, end = int(index[0, 0]), int(index[-1].sum()) + 8
    in_order = bool((np.diff(index[:, 0]) > 0).all())
    body = read_range(path, begin, end - begin) if in_order else None
    fields, (head, width) = header.extra["fields"], header.extra["layout"]
    rows = read_range(_sibling(path, "dbf"), head + width * first, width * count) if fields else b""
    for i, (offset, length) in enumerate(index):
        row, properties, at = rows[i * width : (i + 1) * width], {}, 1
        if row[:1] == b"*":  # deleted
            continue
        for name, kind, size in fields:
            properties[name] = _dbf_value(row[at : at + size], kind, header.extra["encoding"])
            at += size
        start = int(offset) - begin + 8
        content = body[start : start + int(length)] if in_order else read_range(path, int(offset) + 8, int(length))
        yield properties, shp_geometry(content)


# --- GeoPackage ----------------------------------------------------------------------------------

def _identifier(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open_gpkg(name: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{name}?mode=ro&immutable=1", uri=True)


def gpkg_header(path: str) -> Header:
    with local_copy(path) as name, contextlib.closing(_open_gpkg(name)) as db:
        found = db.execute(
            "SELECT c.table_name, g.column_name, g.srs_id FROM gpkg_contents c JOIN gpkg_geometry_columns g"
            " ON g.table_name = c.table_name WHERE c.data_type = 'features' ORDER BY c.rowid LIMIT 1"
        ).fetchone()
        if found is None:
            raise ValueError("no feature table")
        table, geometry, srid = found
        info = db.execute(f"PRAGMA table_info({_identifier(table)})").fetchall()
        columns = [row[1] for row in info if row[1] != geometry and not row[5]]
        first, last = db.execute(f"SELECT min(rowid), max(rowid) FROM {_identifier(table)}").fetchone()
        filled = db.execute(f"SELECT 1 FROM {_identifier(table)} WHERE {_identifier(geometry)} IS NOT NULL LIMIT 1").fetchone()
    extra = {"table": table, "geometry": geometry}
    return Header(columns, first or 0, -1 if last is None else last, srid if srid > 0 else None, filled is not None, extra)


def gpkg_geometry(blob: bytes | None) -> bytes | None:
    """Strip the GeoPackage header; empty geometries yield None."""
    if blob is None or blob[:2] != b"GP" or blob[3] & 0x10:
        return None
    envelope = (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7]
    return bytes(blob[8 + envelope :])


def gpkg_rows(path: str, header: Header, first: int, last: int) -> Iterator[tuple[dict, bytes | None]]:
    names = ", ".join(map(_identifier, [header.extra["geometry"], *header.columns]))
    with local_copy(path) as name, contextlib.closing(_open_gpkg(name)) as db:
        cursor = db.execute(
            f"SELECT {names} FROM {_identifier(header.extra['table'])} WHERE rowid BETWEEN ? AND ?", (first, last)
        )
        for geometry, *values in cursor:
            texts = [None if v is None or isinstance(v, bytes) else str(v) for v in values]
            yield dict(zip(header.columns, texts)), gpkg_geometry(geometry)


# --- text headers ----------------------------------------------------------------------------------

def unique_names(names: list[str]) -> list[str]:
    """Repeated header names get ``.1``, ``.2``, ... in order of appearance."""
    seen: dict[str, int] = {}
    result = []
    for name in names:
        count = seen.get(name, 0)
        seen[name] = count + 1
        result.append(f"{name}.{count}" if count else name)
    return result


def csv_header(path: str) -> Header:
    size = 1 << 16
    while True:  # a header line may be long
        text = read_range(path, 0, size).decode("utf-8-sig", "replace")
        if "\n" in text or size >= file_size(path):
            break
        size *= 4
    names = next(csv.reader(io.StringIO(text)), [])
    return Header(unique_names(names), 0, -1, None, False)


def geojson_has_geometry(path: str) -> bool:
    """Whether any feature has a geometry; reads until the first one."""
    system, name = _filesystem(path)
    tail = b""
    with system.open_input_stream(name) as source:
        while chunk := source.read(1 << 18):
            if re.search(rb'"geometry"\s*:\s*\{', tail + chunk):
                return True
            tail = chunk[-64:]
    return False


HEADERS = {"shp": shp_header, "gpkg": gpkg_header, "csv": csv_header}
ROWS = {"shp": shp_rows, "gpkg": gpkg_rows}
