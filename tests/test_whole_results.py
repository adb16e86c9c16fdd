"""Nothing is lost or doubled on the way in or out."""

from conftest import local
from layer_files import write_shapefile

from landsieve.__main__ import print_rows
from landsieve.sources import readers, sheets, sinks
from landsieve.sources import vector_files as vf

BOX = "POLYGON((0 0,0 2,2 2,2 0,0 0))"


def test_cells_with_line_breaks(spark, tmp_path):
    path = tmp_path / "legal.csv"
    path.write_text('parcelid,legal,acreage\nA,"LOT 1\nBLOCK 2",5\nB,plain,6\n')
    rows = readers.read_layers(spark, readers.file_headers(spark, [str(path)]), ["parcelid", "legal", "acreage"]).collect()
    assert sorted((r["parcelid"], r["legal"], r["acreage"]) for r in rows) == [("A", "LOT 1\nBLOCK 2", "5"), ("B", "plain", "6")]


def test_sheets_with_line_breaks(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text('name,"a\nb"\nx,"1\n2"\n')
    rows = sheets.read_sheet(spark, str(path))
    assert rows.columns == ["name", "a\nb"] and [tuple(r) for r in rows.collect()] == [("x", "1\n2")]


def test_a_bad_record_costs_itself_alone(spark, tmp_path):
    path = tmp_path / "ten.shp"
    write_shapefile(path.with_suffix(""), [("parcelid", 12)], [({"parcelid": f"P{i}"}, BOX) for i in range(10)], 'GEOGCS["WGS 84"]')
    header = vf.HEADERS["shp"](str(path))
    whole = list(vf.ROWS["shp"](str(path), header, header.first, header.last))
    each = [r for i in range(header.first, header.last + 1) for r in vf.ROWS["shp"](str(path), header, i, i)]
    assert [r[0] for r in whole] == [r[0] for r in each] and len(each) == 10
    # Record 4: its ring count no longer fits.
    raw = bytearray(path.read_bytes())
    size = (len(raw) - 100) // 10
    raw[100 + 4 * size + 44 : 100 + 4 * size + 48] = (2**30).to_bytes(4, "little")
    path.write_bytes(raw)
    rows = readers.read_binary_layer(spark, readers.file_headers(spark, [str(path)]), ["parcelid"], "skip").collect()
    assert sorted(r["parcelid"] for r in rows) == [f"P{i}" for i in range(10) if i != 4]


def test_a_run_written_twice_counts_once(spark, tmp_path):
    path, key = str(tmp_path / "results"), sinks.RunKey("az", "pima")
    rows = local(spark, [(i, 0.5 * i) for i in range(3)], "ogc_fid long, mcda_score double")
    for _ in range(2):
        sinks.write_results(rows, path, key, "20240101_000000")
    sinks.write_results(rows, path, key, "20240102_000000")
    assert spark.read.parquet(path).count() == 6


def test_listings_are_whole(spark, capsys):
    print_rows(spark.range(1500))
    assert len(capsys.readouterr().out.splitlines()) == 1501
