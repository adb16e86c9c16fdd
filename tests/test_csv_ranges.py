"""CSV files cut at any byte against reading them whole."""

import random

import pytest
from pyspark.sql import functions as F

from landsieve.sources import csv_ranges as cr, geojson, readers

HEADER = ["id", "note", "wkt"]
PIECES = ["a", "é", ",", '""', "\n", "\r\n", " ", "x\r", "'", "5"]


def quoted_cell(rng):
    return '"' + "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 5))) + '"'


def bare_cell(rng):
    first = rng.choice(["", "b", "5"])
    return first and first + rng.choice(["", '"', ' 5" pipe', '"",'[:2], 'q"q"q', "é"])


def written(rng, lines, end):
    cell = lambda: quoted_cell(rng) if rng.random() < 0.5 else bare_cell(rng)
    rows = [f"{i},{cell()},{cell()}" for i in range(lines)]
    if lines > 3:
        rows[2] = ""  # an empty line
    text = end.join(["id,note,wkt", *rows])
    return text + (end if rng.random() < 0.5 else "")


def cut(path, width):
    """All records, by ranges of ``width`` bytes, as the Spark job makes them."""
    size = cr.vf.file_size(path)
    head = cr._head(path, size)
    ranges = [(path, a, min(a + width, size), size, head) for a in range(0, size, width)]
    state, rows = cr.CELL, []
    for r in ranges:
        rows += cr.range_records(*r, state)
        data = cr.vf.read_range(path, r[1], r[2] - r[1])
        state = cr.quoted_cells(data, state)[1]
    return [(place, text) for _, place, text, _ in rows]


def by_sign(text):
    """State by state, one character at a time."""
    state, begin, out = cr.CELL, 0, []
    data = text.encode()
    for at, sign in enumerate(data + b"\n"):
        char = bytes([sign])
        if state == cr.QUOTED:
            state = cr.CLOSING if char == b'"' else cr.QUOTED
        elif char == b'"' and state in (cr.CELL, cr.CLOSING):
            state = cr.QUOTED
        elif char in b"\r\n" and (state != cr.QUOTED):
            if at > begin:
                out.append((begin, data[begin:at].decode()))
            begin, state = at + 1, cr.CELL
        else:
            state = cr.CELL if char == b"," else cr.BARE
    if begin < len(data):
        out.append((begin, data[begin:].decode()))
    return out[1:]


@pytest.mark.parametrize("seed", range(40))
def test_any_cut_gives_the_records_of_the_whole(tmp_path, seed):
    rng = random.Random(seed)
    text = written(rng, rng.randint(0, 9), rng.choice(["\n", "\r\n", "\r"]))
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode())
    want = by_sign(text)
    for width in (1, 2, 3, 5, 16, 64, 10**6):
        assert cut(str(path), width) == want


@pytest.mark.parametrize("text, want", [
    ("", []), ("id", []), ("\n\n\r\nid\n\n7", ["7"]), ("﻿\nid\n7\n", ["7"]), ('id\n"open\n8\n', ['"open\n8\n']), ('"i\nd",x\n1,2', ["1,2"]), ('id\n"a"b"\n"c",\n', ['"a"b"', '"c",']),
])
def test_odd_files(tmp_path, text, want):
    (tmp_path / "a.csv").write_bytes(text.encode())
    for width in (1, 4, 100):
        assert [t for _, t in cut(str(tmp_path / "a.csv"), width)] == want


def test_summaries_hold_for_every_state():
    rng = random.Random(5)
    for _ in range(300):
        data = "".join(rng.choice(['"', ",", "\n", "a"]) for _ in range(rng.randint(1, 12))).encode()
        for state in range(4):
            split = rng.randint(0, len(data))
            ends = quiet = cr.quoted_cells(data, state)[1]
            if 0 < split < len(data):
                quiet = cr.quoted_cells(data[split:], cr.quoted_cells(data[:split], state)[1])[1]
            assert ends == quiet


def test_long_records_are_reported_and_the_rest_is_read(tmp_path, monkeypatch):
    monkeypatch.setattr(cr, "MAX_RECORD", 40)
    monkeypatch.setattr(cr, "MORE_BYTES", 8)
    path = tmp_path / "a.csv"
    path.write_text("id\n1\n2\n\"" + "x" * 100)
    rows = cr.range_records(str(path), 0, 8, path.stat().st_size, 0, cr.CELL)
    assert [(place, text, error is not None) for _, place, text, error in rows] == [(3, "1", False), (5, "2", False), (7, None, True)]


def test_ranges_equal_the_whole_file_reader(spark, tmp_path):
    rng = random.Random(3)
    for n in range(3):
        (tmp_path / f"{n}.csv").write_bytes(written(rng, 30, "\n").replace("\r", "").encode())
    paths = [str(tmp_path / f"{n}.csv") for n in range(3)]
    whole = spark.read.schema("id string, note string, wkt string").options(header=True, escape='"', multiLine=True).csv(paths)
    got = readers.read_csv_layer(spark, paths, HEADER, ["note", "id", "other"], range_bytes=64)
    assert got.columns == ["source_file", "note", "id", "other", "geom_wkb", "srid"]
    key = lambda r: tuple(x or "" for x in r)
    assert sorted(((r["id"], r["note"]) for r in got.collect()), key=key) == sorted(((r["id"], r["note"]) for r in whole.collect()), key=key)
    records = cr.csv_records(spark, paths, 64)
    assert records.where("error IS NOT NULL").isEmpty()
    assert records.select(F.spark_partition_id()).distinct().count() > 8  # ranges are read by many tasks


def test_geojson_ranges_are_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "a.geojson"
    path.write_text('{"type":"FeatureCollection","features":[' + ",".join('{"type":"Feature","geometry":null,"properties":{"n":%d}}' % n for n in range(200)) + "]}")
    records = geojson.geojson_records(spark, [str(path)], 256)
    assert records.count() == 200 and records.select(F.spark_partition_id()).distinct().count() > 8
