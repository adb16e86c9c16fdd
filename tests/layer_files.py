"""Small writers for the layer formats, used to make test inputs."""

import json
import sqlite3
import struct

import numpy as np

from landsieve.functions.geometry import decode, from_wkt


def write_shapefile(stem, fields, rows, prj=None, kind=5, deleted=()):
    """``fields`` are (name, width); ``rows`` are (attribute dict, WKT or None)."""
    shapes, index, at = b"", b"", 50
    for i, (_, text) in enumerate(rows):
        if text is None:
            content = struct.pack("<i", 0)
        else:
            name, coordinates, _ = decode(from_wkt(text)[0])
            if name == "Point":
                content = struct.pack("<i2d", 1, *coordinates)
            else:
                rings = [r for part in (coordinates if name == "MultiPolygon" else [coordinates]) for r in part] if "Polygon" in name else [coordinates]
                points = np.vstack(rings)
                starts = np.cumsum([0, *[len(r) for r in rings[:-1]]])
                box = [*points.min(0), *points.max(0)]
                content = struct.pack("<i4d2i", 5 if "Polygon" in name else 3, *box, len(rings), len(points))
                content += starts.astype("<i4").tobytes() + points.astype("<f8").tobytes()
        words = len(content) // 2
        shapes += struct.pack(">2i", i + 1, words) + content
        index += struct.pack(">2i", at, words)
        at += words + 4
    for name, body in (("shp", shapes), ("shx", index)):
        head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(body) // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)
        (stem.parent / f"{stem.name}.{name}").write_bytes(head + body)
    width = 1 + sum(w for _, w in fields)
    head = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 33 + 32 * len(fields), width)
    for name, size in fields:
        head += struct.pack("<11sc4xBB14x", name.encode(), b"C", size, 0)
    body = b"".join(
        (b"*" if i in deleted else b" ") + b"".join(str(a.get(n) or "").encode("latin-1").ljust(w) for n, w in fields)
        for i, (a, _) in enumerate(rows)
    )
    (stem.parent / f"{stem.name}.dbf").write_bytes(head + b"\r" + body + b"\x1a")
    if prj:
        (stem.parent / f"{stem.name}.prj").write_text(prj)


def write_geopackage(path, columns, rows, srid=4326, table="layer"):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT, srs_id INTEGER)")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INTEGER)")
    db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?)", (table, srid))
    db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?)", (table, srid))
    named = ", ".join(f'"{c}"' for c in columns)
    db.execute(f'CREATE TABLE "{table}" (fid INTEGER PRIMARY KEY, geom BLOB, {named})')
    for attributes, text in rows:
        blob = None
        if text == "EMPTY":
            blob = b"GP\x00\x11" + struct.pack("<i", srid)
        elif text:
            blob = b"GP\x00\x03" + struct.pack("<i4d", srid, 0, 0, 0, 0) + from_wkt(text)[0]
        marks = ", ".join("?" * (len(columns) + 1))
        db.execute(f'INSERT INTO "{table}" (geom, {named}) VALUES ({marks})', (blob, *[attributes.get(c) for c in columns]))
    db.commit()
    db.close()


def write_geojson(path, rows, one_per_line=True):
    from landsieve.functions.geometry import to_geojson

    features = [
        {"type": "Feature", "properties": a, "geometry": to_geojson(from_wkt(t)[0]) if t else None} for a, t in rows
    ]
    if one_per_line:
        body = ",\n".join(json.dumps(f) for f in features)
        path.write_text('{\n"type": "FeatureCollection",\n"features": [\n' + body + "\n]\n}\n")
    else:
        path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=2))
