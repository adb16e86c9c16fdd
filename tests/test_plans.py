"""Physical plans: pushdown, pruning, and no needless movement of parcels."""

import re

import pytest
from conftest import SMALL, local

from landsieve import Settings, fixtures as fx
from landsieve.operators import filters, scoring, spatial as sp, stats
from landsieve.operators.skew import is_small, lookup_join, measured_bytes, planned_bytes
from landsieve.plans.site_selection import rank, screen
from landsieve.session import spread_small


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("parcels"))
    parcels = fx.parcels(spark, SMALL).withColumnRenamed("state2", "state")
    parcels.repartition(1).write.mode("overwrite").partitionBy("state", "county").parquet(path)
    return spark.read.parquet(path)


def single_partition_inputs(text):
    """The operator right below each exchange into one partition."""
    lines = text.splitlines()
    return [lines[i + 1] for i, line in enumerate(lines) if "Exchange SinglePartition" in line]


def test_predicates_and_partitions_reach_the_scan(spark, table):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    settings = Settings(state="asia", county="china", min_kv=69, roadway_distance=500)
    text = plan(screen(table, None, settings).select("ogc_fid"))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "GreaterThan(gisacre,50.0)" in scan and "LessThanOrEqual(et_distance,100.0)" in scan
    assert "IsNull(usedesc)" in scan
    assert re.search(r"PartitionFilters: \[[^\]]*asia[^\]]*china", scan)
    assert "zoning_type" not in scan and "minx" not in scan
    assert "Exchange" not in text


def test_airport_screening_moves_no_parcel(spark, table):
    text = plan(sp.filter_airports(table, fx.airports(spark, SMALL), cell=fx.CELL))
    assert "LeftAnti" in text and "BroadcastHashJoin" in text
    assert "hashpartitioning" not in text and "CartesianProduct" not in text and "SortMergeJoin" not in text


def test_nearest_search_moves_no_parcel(spark, table):
    found = sp.nearest(table, fx.roads(spark, SMALL), 60.0, {}, "d", cell=fx.CELL)
    text = plan(found)
    assert "SortMergeJoin" not in text and "CartesianProduct" not in text
    # Only the layer is regrouped, into one list per cell.
    assert all("_level" in line for line in text.splitlines() if "hashpartitioning" in line)


def test_ranking_reads_few_columns_and_uses_no_window(spark, table):
    settings = Settings(weights=fx.WEIGHTS)
    ranked = rank(table.withColumn("drive_time", table.hwy_distance), fx.lookups(spark), settings)
    text = plan(ranked.select("ogc_fid", scoring.RANK))
    assert "Window" not in text and "SortMergeJoin" not in text
    assert all("HashAggregate" in below for below in single_partition_inputs(text))
    assert "hashpartitioning" not in text
    assert not re.search(r"ReadSchema: [^\n]*ll_bldg_footprint_sqft", text)


def test_statistics_only_gather_partial_results(spark, table):
    text = plan(stats.ranking_stats(table.withColumnRenamed("gisacre", scoring.RANK)))
    assert all("HashAggregate" in below or "ObjectHashAggregate" in below for below in single_partition_inputs(text))


def test_top_list_is_a_bounded_sort(spark, table):
    ranked = table.withColumnRenamed("gisacre", scoring.RANK)
    assert "TakeOrderedAndProject" in plan(stats.top_n(ranked))


def test_lookup_beyond_the_bound_is_salted(spark, table):
    lookup = local(spark, [("BUILDING", 1.0)], "lbcs_site_desc string, site_ranking double")
    small = plan(lookup_join(table, lookup, ["lbcs_site_desc"], "left", ["ogc_fid"]))
    assert "BroadcastHashJoin" in small and "hashpartitioning" not in small
    salted = lookup_join(table, lookup, ["lbcs_site_desc"], "left", ["ogc_fid"], max_bytes=0)
    assert re.search(r"Join \[lbcs_site_desc#\d+, _salt#\d+\]", plan(salted))


def test_small_scans_are_spread_and_large_ones_left_alone(spark, table):
    assert "REPARTITION_BY_NUM" in plan(spread_small(table))
    assert "Exchange" not in plan(spread_small(table, split_bytes=0))


def test_funnel_counts_attribute_steps_in_one_pass(spark, table):
    stages = [("a", filters.min_size()), ("b", filters.max_transmission()), ("c", filters.max_roadway(500))]
    assert plan(filters.funnel(table, stages)).count("FileScan") == 1


def test_broadcast_needs_a_known_size(spark, tmp_path):
    """A file that is small only because it compresses well is measured, and refused."""
    path = str(tmp_path / "wide")
    spark.range(200_000).selectExpr("id", "repeat('x', 400) AS t").repartition(4).write.parquet(path)
    df = spark.read.parquet(path)
    assert planned_bytes(df) < 8 << 20 and measured_bytes(df) > 80 << 20
    assert not is_small(df) and is_small(df, 1 << 30) and is_small(df.select("id"))
