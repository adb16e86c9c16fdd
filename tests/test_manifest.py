"""Loads of changed counties only."""

import os

import pytest
from conftest import local
from layer_files import write_geojson

from landsieve.__main__ import main
from landsieve.sources import readers
from landsieve.sources.manifest import CountyTable, Outpaced, folder_digests

BOX = "POLYGON((0 0,0 2,2 2,2 0,0 0))"


def write(root, state, county, rows, stamp):
    folder = root / "parcels" / state / county
    folder.mkdir(parents=True, exist_ok=True)
    write_geojson(folder / "a.geojson", [({"parcelnumb": p, "gisacre": 5, **more}, BOX) for p, more in rows], one_per_line=True)
    os.utime(folder / "a.geojson", (stamp, stamp))


def data_files(table):
    return {p: p.stat().st_mtime_ns for p in (table / "data").rglob("*.parquet")}


def test_only_changed_counties_are_written(spark, tmp_path, capsys):
    raw, tables = tmp_path / "raw", tmp_path / "tables"
    for county in ("pima", "pinal", "07"):
        write(raw, "az", county, [(f"{county}{i}", {}) for i in range(3)], 1000)
    load = lambda: main(["load", "--raw", str(raw), "--tables", str(tables), "--changed-only"], spark)
    load()
    table = CountyTable(spark, str(tables / "parcels"))
    first = data_files(tables / "parcels")
    assert table.version() == 1 and table.read().count() == 9
    load()  # nothing to do
    assert table.version() == 1 and data_files(tables / "parcels") == first
    write(raw, "az", "pima", [("new", {"et_kv": "138"})], 2000)  # one row, and a column that no county had
    (raw / "parcels/az/07/a.geojson").unlink()
    load()
    assert table.version() == 2
    second = data_files(tables / "parcels")
    assert {p: second[p] for p in first} == first  # nothing was touched
    assert all("county=pima" in str(p) for p in set(second) - set(first))
    rows = sorted((r["county"], r["parcelnumb"], r["et_kv"]) for r in readers.read_parcels(spark, str(tables / "parcels"), "az").collect())
    assert rows == [("pima", "new", "138"), *[("pinal", f"pinal{i}", None) for i in range(3)]]
    assert readers.read_parcels(spark, str(tables / "parcels"), "az", "pinal").count() == 3
    plan = readers.read_parcels(spark, str(tables / "parcels"), "az", "pima")
    assert all("county=pima" in f for f in plan.inputFiles())
    capsys.readouterr()
    main(["list", "--tables", str(tables), "counties", "--state", "az"], spark)
    assert capsys.readouterr().out.split() == ["county", "pima", "pinal"]
    assert table.drop_unused() == 2  # the old rows of pima, and the county without files
    assert table.read().count() == 4 and table.version() == 2
    with pytest.raises(ValueError, match="manifest"):
        main(["load", "--raw", str(raw), "--tables", str(tables)], spark)


def frame(spark, rows):
    return local(spark, rows, "state string, county string, x long")


def changes(spark, rows):
    return local(spark, rows, "state string, county string, digest string, change string")


def test_a_load_that_is_cut_off_or_outpaced_leaves_the_table(spark, tmp_path, monkeypatch):
    table = CountyTable(spark, str(tmp_path / "t"))
    assert table.version() == 0 and table.read().isEmpty() and table.entries().isEmpty()
    table.commit(frame(spark, [("az", "a b/c=d", 1), ("az", "b", 2)]), changes(spark, [("az", "a b/c=d", "d", "new"), ("az", "b", "d", "new"), ("az", "none", "d", "new")]))
    state = lambda: sorted(map(tuple, table.read().select("county", "x").collect()))
    assert state() == [("a b/c=d", 1), ("b", 2)]
    assert {r["county"]: r["n"] for r in table.entries().collect()} == {"a b/c=d": 1, "b": 1, "none": 0}
    again, newer = changes(spark, [("az", "b", "e", "changed")]), frame(spark, [("az", "b", 3)])
    with monkeypatch.context() as cut:
        cut.setattr(CountyTable, "_put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.commit(newer, again)
    assert state() == [("a b/c=d", 1), ("b", 2)]
    with monkeypatch.context() as late:  # both have seen version 1
        late.setattr(CountyTable, "version", lambda self: 1)
        assert table.commit(newer, again) == 2
        with pytest.raises(Outpaced):
            table.commit(frame(spark, [("az", "b", 4)]), again)
    assert state() == [("a b/c=d", 1), ("b", 3)]
    table.drop_unused()
    assert state() == [("a b/c=d", 1), ("b", 3)] and not list((tmp_path / "t").glob(".staged*"))
    with pytest.raises(ValueError, match="column x"):
        table.commit(local(spark, [("az", "b", "t")], "state string, county string, x string"), again)
    # Removed counties leave, unnamed ones stay.
    table.commit(frame(spark, []), changes(spark, [("az", "b", None, "removed")]))
    assert state() == [("a b/c=d", 1)]


def test_changes_tell_every_county_of_the_states_in_question(spark, tmp_path):
    for state, county in (("az", "x"), ("az", "y"), ("ks", "z")):
        write(tmp_path, state, county, [("p", {})], 1000)
    digests = folder_digests(spark, str(tmp_path))
    assert digests.count() == 3 and digests.select("digest").distinct().count() == 1  # equal files, equal digests
    table = CountyTable(spark, str(tmp_path / "t"))
    table.commit(frame(spark, [("az", "x", 1)]), table.changes(digests))
    write(tmp_path, "az", "x", [("q", {}), ("r", {})], 1000)
    write(tmp_path, "az", "new", [("p", {})], 1000)
    (tmp_path / "parcels/az/y/a.geojson").unlink()
    told = lambda state=None: {r["county"]: r["change"] for r in table.changes(folder_digests(spark, str(tmp_path), state), state).collect()}
    assert told() == {"x": "changed", "y": "removed", "z": "same", "new": "new"}
    assert told("ks") == {"z": "same"}
    assert {r["change"] for r in table.changes(folder_digests(spark, str(tmp_path), "ks", "other"), "ks").collect()} == {"changed"}
