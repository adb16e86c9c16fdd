"""Literal rows for each semantic decision."""

import pytest
from conftest import local
from hypothesis import HealthCheck, given, settings as hyp, strategies as st
from pyspark.sql import functions as F

from landsieve.functions.scalar import band_is_visible, building_coverage, is_flagged, rank_band, rank_color, sanitize_name
from landsieve.operators import catalog, filters, lookups as lk, scoring, standardize as std, stats
from landsieve.plans.site_selection import Settings, rank, screen
from landsieve.schema import DEFAULT_EXCLUSIONS, PARCEL_COLUMNS

WEIGHTS = {"zoning": 0.2, "description": 0.15, "fema_nri": 0.1, "flood": 0.1, "size": 0.2, "drive": 0.1, "transmission": 0.15}
PARCEL = (
    "ogc_fid long, parcelnumb string, gisacre double, usedesc string, lbcs_ownership_desc string, et_distance double, "
    "hwy_distance double, drive_time double, et_kv string, et_operator string, est_operator string, zoning_type string, "
    "zoning_subtype string, lbcs_site_desc string, fema_nri_risk_rating string, fema_flood_zone string, fema_flood_zone_subtype string"
)


def parcel(i, **values):
    names = [f.split()[0] for f in PARCEL.split(", ")]
    base = {"ogc_fid": i, "parcelnumb": f"P{i}", "gisacre": 100.0, "et_distance": 10.0, "hwy_distance": 10.0, "drive_time": 10.0}
    return tuple({**base, **values}.get(n) for n in names)


def parcels(spark, *rows):
    return local(spark, list(rows), PARCEL)


def ids(df):
    return sorted(r["ogc_fid"] for r in df.collect())


@pytest.fixture
def sheets(spark):
    zoning = local(spark, [("R", "a", 8.0, 6.0), ("C", "", 2.0, 2.0)], "zoning_type string, zoning_subtype string, zoning_ranking double, zoning_subtype_ranking double")
    site = local(spark, [("field", 9.0), ("yard", None)], "lbcs_site_desc string, site_ranking double")
    fema = local(spark, [("Low", "X", "min", 9.0, 8.0, 7.0)], "fema_nri_risk_rating string, fema_flood_zone string, fema_flood_zone_subtype string, fema_nri_ranking double, flood_zone_ranking double, flood_subtype_ranking double")
    return zoning, site, fema


def test_min_size_is_strict_and_drops_null(spark):
    df = parcels(spark, parcel(1, gisacre=50.0), parcel(2, gisacre=50.1), parcel(3, gisacre=None))
    assert ids(filters.filter_min_size(df)) == [2]
    assert ids(filters.filter_min_size(df, 10)) == [1, 2]


def test_exclusions_keep_null_and_use_one_list_for_both_columns(spark):
    df = parcels(
        spark, parcel(1), parcel(2, usedesc="Military base"), parcel(3, lbcs_ownership_desc="Military base"),
        parcel(4, usedesc="farm", lbcs_ownership_desc="private"),
    )
    as_table = local(spark, [("Military base",), (None,), ("Military base",)], "value string")
    assert ids(filters.filter_exclusions(df, ["Military base", None])) == [1, 4]
    assert ids(filters.filter_exclusions(df, as_table)) == [1, 4]
    assert ids(filters.filter_exclusions(df, [])) == [1, 2, 3, 4]
    assert ids(filters.filter_exclusions(df, as_table.limit(0))) == [1, 2, 3, 4]
    assert ids(filters.filter_exclusions(df, DEFAULT_EXCLUSIONS)) == [1, 4]


def test_voltage_texts(spark):
    df = parcels(spark, *[parcel(i, et_kv=v) for i, v in enumerate([None, "", "68.9", "69", "138.0", "n/a"])])
    assert ids(filters.filter_min_kv(df, 69)) == [3, 4]
    assert ids(filters.filter_min_kv(df)) == [0, 1, 2, 3, 4, 5]


def test_absent_optional_columns_skip_their_filter(spark):
    df = parcels(spark, parcel(1)).drop("et_kv", "hwy_distance")
    assert ids(filters.filter_roadway(filters.filter_min_kv(df, 69), 1)) == [1]


def test_distances_are_inclusive(spark):
    df = parcels(spark, parcel(1, et_distance=100.0, hwy_distance=500.0), parcel(2, et_distance=100.1, hwy_distance=None), parcel(3, et_distance=None, hwy_distance=501.0))
    assert ids(filters.filter_transmission(df)) == [1]
    assert ids(filters.filter_roadway(df, 500)) == [1]


def test_provider_with_an_apostrophe_matches_exactly(spark):
    name = "O'Brien's \"Power\" \\ Co"
    df = parcels(spark, parcel(1, et_operator=name), parcel(2, est_operator=name), parcel(3, et_operator=name + " "), parcel(4))
    assert ids(filters.filter_provider(df, name)) == [1, 2]


def test_minimum_survivors(spark):
    df = parcels(spark, parcel(1), parcel(2, gisacre=10.0))
    with pytest.raises(filters.TooFewParcels, match="min_size"):
        screen(df, None, Settings(min_survivors=1))
    assert ids(screen(df, None, Settings())) == [1]
    assert ids(screen(df, None, Settings(min_survivors=0))) == [1]


def test_min_size_setting_is_honoured(spark):
    df = parcels(spark, parcel(1), parcel(2, gisacre=10.0))
    assert ids(screen(df, None, Settings(min_size=5.0))) == [1, 2]


def test_unknown_and_constant_values_are_neutral(spark):
    df = local(spark, [(1, 1.0, 7.0), (2, 3.0, 7.0), (3, None, 7.0)], "ogc_fid long, gisacre double, et_distance double")
    rows = {r["ogc_fid"]: r for r in scoring.minmax(df, [scoring.SIZE, scoring.TRANSMISSION, scoring.HIGHWAY]).collect()}
    assert [rows[i]["gisacre_norm"] for i in (1, 2, 3)] == [0.0, 10.0, 5.0]
    assert {r["transmission_distance_norm"] for r in rows.values()} == {5.0}
    assert {r["highway_distance_norm"] for r in rows.values()} == {5.0}


def test_scoped_normalisation_has_its_own_null_scope(spark, scratch):
    df = local(spark, [(1, "a", 1.0), (2, "a", 2.0), (3, None, 10.0), (4, None, 30.0)], "ogc_fid long, county string, gisacre double")
    for folder in (None, scratch):
        got = {r["ogc_fid"]: r["gisacre_norm"] for r in scoring.minmax(df, [scoring.SIZE], ["county"], scratch=folder).collect()}
        assert got == {1: 0.0, 2: 10.0, 3: 0.0, 4: 10.0}


def test_building_coverage(spark):
    df = local(spark, [(1, 50.0, 100.0), (2, 200.0, 100.0), (3, None, 100.0), (4, 1.0, 0.0), (5, 1.0, None), (6, -50.0, 100.0)], "ogc_fid long, b double, l double")
    assert [r[0] for r in df.orderBy("ogc_fid").select(building_coverage("b", "l")).collect()] == [5.0, 0.0, 0.0, 5.0, 5.0, 10.0]


def test_rank_defaults_need_the_whole_key(spark, sheets):
    df = parcels(
        spark,
        parcel(1, zoning_type="R", zoning_subtype="a", lbcs_site_desc="field", fema_nri_risk_rating="Low", fema_flood_zone="X", fema_flood_zone_subtype="min"),
        parcel(2, zoning_type="R", zoning_subtype=None, lbcs_site_desc="yard", fema_nri_risk_rating="Low", fema_flood_zone="X", fema_flood_zone_subtype=None),
        parcel(3, zoning_type="C", zoning_subtype=""),
        parcel(4, zoning_type="C", zoning_subtype=None),
    )
    mapped = {r["ogc_fid"]: r for r in lk.map_rankings(df, *sheets).collect()}
    ranks = ["zoning_ranking", "zoning_subtype_ranking", "site_ranking", "fema_nri_ranking", "flood_zone_ranking", "flood_subtype_ranking"]
    assert [mapped[1][r] for r in ranks] == [8.0, 6.0, 9.0, 9.0, 8.0, 7.0]
    assert [mapped[2][r] for r in ranks] == [5.0] * 6
    assert mapped[3]["zoning_ranking"] == 2.0
    assert mapped[4]["zoning_ranking"] == 5.0


def test_duplicate_lookup_keys_repeat_parcels(spark, sheets):
    zoning = sheets[0].union(sheets[0].where("zoning_type = 'R'"))
    df = parcels(spark, parcel(1, zoning_type="R", zoning_subtype="a"))
    assert lk.map_rankings(df, zoning=zoning).count() == 2
    assert [tuple(r) for r in lk.audit_lookup(zoning, lk.ZONING_KEYS).collect()] == [("R", "a", 2)]


@pytest.mark.parametrize("method", ["MCDA", "MCO"])
def test_zero_and_one_row(spark, sheets, method):
    settings = Settings(method=method, weights=WEIGHTS)
    df = parcels(spark, parcel(1))
    score = f"{method.lower()}_score"
    row = rank(df, sheets, settings).first()
    assert (row[score], row["parcel_rank_normalized"]) == (5.0, 5.0)
    assert rank(df.limit(0), sheets, settings).count() == 0
    one = stats.ranking_stats(rank(df, sheets, settings)).first()
    assert (one["total_parcels"], one["median_score"], one["std_dev"]) == (1, 5.0, None)


def test_size_preference_flips_twice_by_default(spark, sheets):
    df = parcels(spark, parcel(1, gisacre=100.0), parcel(2, gisacre=200.0))

    def scores(**options):
        rows = scoring.rank_mco(df, sheets, **options).orderBy("ogc_fid").collect()
        return [(r["size_score"], r["mco_score"]) for r in rows]

    default, flipped = scores(), scores(preferences={"size": "MIN"})
    assert [s for s, _ in flipped] == [10.0, 0.0] and [s for s, _ in default] == [0.0, 10.0]
    assert [t for _, t in flipped] == [t for _, t in default]
    single = scores(preferences={"size": "min"}, single_size_flip=True)
    assert single[0][1] > single[1][1]


def test_flood_is_a_sum_and_zoning_a_mean(spark, sheets):
    df = parcels(spark, parcel(1, zoning_type="R", zoning_subtype="a", fema_nri_risk_rating="Low", fema_flood_zone="X", fema_flood_zone_subtype="min"), parcel(2))
    row = scoring.rank_mcda(df, sheets, WEIGHTS).where("ogc_fid = 1").first()
    assert row["flood_score"] == pytest.approx(0.1 * 15) and row["zoning_score"] == pytest.approx(0.2 * 7)


def test_weights_and_preferences_are_checked():
    with pytest.raises(lk.InvalidRanking, match="missing"):
        lk.validate_weights({"zoning": 1})
    for bad in (-1, float("nan"), "x", True):
        with pytest.raises(lk.InvalidRanking):
            lk.validate_weights({**WEIGHTS, "size": bad})
    assert lk.validate_preferences({"size": "MAX", "distance": "Min", "risk": "min", "zoning": "max"})["distance"] == "min"
    with pytest.raises(lk.InvalidRanking):
        lk.validate_preferences({"size": "most", "distance": "min", "risk": "min", "zoning": "max"})


def test_explanation_adds_up(spark, sheets):
    df = parcels(spark, parcel(1, gisacre=60.0), parcel(2, gisacre=80.0), parcel(3, gisacre=70.0))
    ranked = scoring.rank_mcda(df, sheets, WEIGHTS)
    parts = scoring.explain_parcel(ranked, "P3", WEIGHTS).collect()
    assert len(parts) == 7
    total = ranked.where("ogc_fid = 3").first()["mcda_score"]
    assert sum(p["contribution"] for p in parts) == pytest.approx(total)


def test_top_list_ties_go_by_number_then_id(spark, sheets):
    df = parcels(spark, parcel(3, parcelnumb="B"), parcel(2, parcelnumb="A"), parcel(1, parcelnumb="B"), parcel(4, parcelnumb=None))
    top = stats.top_n(scoring.rank_mcda(df, sheets, WEIGHTS), 3).collect()
    assert [r["ogc_fid"] for r in top] == [2, 1, 3]


NAMES = {
    None: "all_providers", "": "all_providers", "City of Mesa - (AZ)": "city_of_mesa__az", "San Diego Gas & Electric": "san_diego_gas__electric",
    "~unknown~": "unknown", "3 Rivers": "provider_3_rivers", "&&": "unknown_provider", "O'Neil": "oneil",
}


def test_names(spark):
    df = local(spark, [(k,) for k in NAMES], "n string")
    assert [r[0] for r in df.select(sanitize_name("n")).collect()] == list(NAMES.values())


@hyp(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=12), min_size=1, max_size=20))
def test_any_name_becomes_an_identifier(spark, names):
    df = local(spark, [(n,) for n in names], "n string")
    assert df.select(sanitize_name("n").alias("v")).where("NOT v RLIKE '^[a-z_][a-z0-9_]*$'").count() == 0


def test_flags(spark):
    df = local(spark, [(v,) for v in ["TRUE", " true ", "True", "1", "1.0", "0", "yes", None, "FALSE"]], "f string")
    assert [r[0] for r in df.select(is_flagged("f")).collect()] == [True] * 5 + [False] * 4


def test_bands_and_colours(spark):
    df = local(spark, [(v,) for v in [0.0, 1.99, 2.0, 5.5, 6.0, 8.0, 10.0, None]], "r double")
    rows = df.select(rank_band("r"), band_is_visible("r"), rank_color("r")).collect()
    assert [r[0] for r in rows] == ["Rank 0-2", "Rank 0-2", "Rank 2-4", "Rank 4-6", "Rank 6-8", "Rank 8-10", "Rank 8-10", None]
    assert [r[1] for r in rows] == [False] * 4 + [True] * 3 + [False]
    assert (rows[0][2], rows[3][2], rows[6][2], rows[7][2]) == ("#ff0000ff", "#ffff00ff", "#008000ff", None)


def test_aliases_coalesce_and_standard_columns_are_ordered(spark):
    df = local(spark, [("x", None, 3.0, "z"), (None, "y", 4.0, "z")], "parcelid string, parcelnumb string, acreage double, other string")
    renamed = std.apply_aliases(df)
    assert [(r["parcelnumb"], r["gisacre"]) for r in renamed.collect()] == [("x", 3.0), ("y", 4.0)]
    full = std.standardize(renamed)
    assert full.columns == PARCEL_COLUMNS
    assert std.schema_diff(["parcelnumb", "geometry", "GISACRE"])[1] == ["geometry", "GISACRE"]


def test_text_tables_are_typed(spark):
    df = local(spark, [("12.5", "7"), ("n/a", "8")], "gisacre string, usedesc string")
    assert [tuple(r) for r in std.cast_parcels(df).collect()] == [(12.5, "7"), (None, "8")]


def test_files_without_any_shape_are_left_out(spark):
    df = local(spark, [("a", b"1"), ("a", None), ("b", None)], "f string, geometry binary")
    assert sorted((r["f"], r["geom_wkb"] is None) for r in std.normalize_geometry(df, "f").collect()) == [("a", False), ("a", True)]
    assert std.normalize_geometry(df).count() == 1


def test_runs_of_providers_sharing_a_prefix_stay_apart(spark):
    stamps = [f"2024010{d}_120000" for d in range(1, 5)]
    rows = [("az", "pima", p, s) for p in ("srp", "srp_east") for s in stamps] + [("az", "pima", "srp", stamps[0])]
    df = local(spark, rows, "state string, county string, provider string, run_ts string")
    dropped = sorted((r["provider"], r["run_ts"]) for r in catalog.runs_to_drop(df).collect())
    assert dropped == [(p, s) for p in ("srp", "srp_east") for s in stamps[:2]]
    info = catalog.runs_info(df).where("provider = 'srp'").orderBy(F.desc("created")).collect()
    assert [r["run_ts"] for r in info] == stamps[::-1]
    assert {(r["total_runs"], r["newest"].day) for r in info} == {(4, 4)}
    assert catalog.runs_to_drop(df, 4).count() == 0 and catalog.runs_to_drop(df, 9).count() == 0


@hyp(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3).map(float), st.floats(-1e6, 1e6)), max_size=40), st.sampled_from([0.0, 0.25, 0.5, 0.9, 1.0]))
def test_exact_quantile(spark, values, q):
    import numpy as np

    df = local(spark, [(v,) for v in values], "x double")
    got = stats.exact_quantile(df, "x", q).first()["quantile"]
    known = [v for v in values if v is not None]
    assert got is None if not known else got == pytest.approx(np.quantile(known, q), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("accuracy", [100, 1000])
def test_exact_quantile_with_a_narrow_bracket_and_a_hot_value(spark, accuracy):
    """A third of the rows share a value; the bracket is far smaller than the data."""
    import numpy as np

    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.rand(7) * 10).alias("x")).cache()
    values = np.array([r[0] for r in df.collect()])
    for q in (0.1, 0.5, 0.75):
        got = stats.exact_quantile(df, "x", q, accuracy).first()["quantile"]
        assert got == pytest.approx(np.quantile(values, q), rel=1e-12)
    df.unpersist()


def test_adding_a_filter_never_adds_rows(spark):
    df = parcels(spark, *[parcel(i, gisacre=float(i), et_distance=float(i % 7)) for i in range(60)])
    counts = [r["n"] for r in filters.funnel(df, [("a", filters.min_size(10)), ("b", filters.max_transmission(3)), ("c", lambda d: d.where("ogc_fid < 40"))]).orderBy("step").collect()]
    assert counts == sorted(counts, reverse=True) and counts[0] == 60
