"""The driver tables reshaped into parcels, layers and lookups.

The frames hold NULLs, blank texts, repeated and NULL parcel numbers, zero lot sizes and unmatched
lookup keys. Geometries are axis-aligned boxes, for which box overlap is exact intersection.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import spread_small

WEIGHTS = {
    "zoning": 0.2, "description": 0.15, "fema_nri": 0.1, "flood": 0.1,
    "size": 0.2, "drive": 0.1, "transmission": 0.15,
}
PREFERENCES = {"size": "max", "distance": "min", "risk": "min", "zoning": "max"}
EXCLUSIONS = ["MACHINERY", "5-LOW"]
PROVIDER = "City of BUILDING - (ASIA)"
CELL = 16.0


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is looked up in the file once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _mod(key: Column, n: int) -> Column:
    return key % F.lit(n)


def _unless(condition: Column, value: Column) -> Column:
    return F.when(condition, F.lit(None)).otherwise(value)


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One parcel per order."""
    t = lambda name: table(spark, sf_dir, name)
    joined = (
        spread_small(t("orders"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.select(*_parcel_columns(spark.sparkContext.applicationId))


@lru_cache(maxsize=4)
def _parcel_columns(application: str) -> list[Column]:
    """Column formulas of the parcels, built once per application."""
    key, price, segment = F.col("o_orderkey"), F.col("o_totalprice"), F.col("c_mktsegment")
    number = lambda factor, n: _mod(key * F.lit(factor), n).cast("double")
    x0 = (_mod(key, 400) * 10).cast("double")
    y0 = (_mod(key * 7, 300) * 10).cast("double")
    kv = F.element_at(F.array(*map(F.lit, ["", "34.5", "69", "138.0", "345"])), F.greatest(_mod(key, 6), F.lit(1)).cast("int"))
    city = F.concat(F.lit("City of "), segment)
    return [
        key.alias("ogc_fid"),
        _unless(_mod(key, 97) == 0, F.concat(F.lit("P"), (key - _mod(key, 2)).cast("string"))).alias("parcelnumb"),
        F.replace(F.lower("r_name"), F.lit(" "), F.lit("_")).alias("state2"),
        F.lower("n_name").alias("county"),
        _unless(_mod(key, 53) == 0, price / F.lit(1000.0)).alias("gisacre"),
        _unless(_mod(key, 11) == 0, segment).alias("usedesc"),
        _unless(_mod(key, 17) == 0, F.col("o_orderpriority")).alias("lbcs_ownership_desc"),
        _unless(_mod(key, 41) == 0, number(37, 401)).alias("et_distance"),
        number(53, 2003).alias("hwy_distance"),
        _unless(_mod(key, 6) == 0, kv).alias("et_kv"),
        F.when(_mod(key, 29) == 0, F.lit(None))
        .when(_mod(key, 31) == 0, F.lit(""))
        .otherwise(F.concat(city, F.lit(" - ("), F.col("r_name"), F.lit(")")))
        .alias("et_operator"),
        F.when(_mod(key, 3) == 0, F.concat(city, F.lit(" - (ASIA)"))).alias("est_operator"),
        F.col("o_orderpriority").alias("zoning_type"),
        _unless(_mod(key, 13) == 0, F.col("o_orderstatus")).alias("zoning_subtype"),
        segment.alias("lbcs_site_desc"),
        F.element_at(
            F.array(*map(F.lit, ["Very Low", "Relatively Low", "Relatively High", "Unlisted", None])),
            (_mod(key, 5) + 1).cast("int"),
        ).alias("fema_nri_risk_rating"),
        F.element_at(F.array(*map(F.lit, ["X", "AE", "A", "X"])), (_mod(key, 4) + 1).cast("int")).alias("fema_flood_zone"),
        F.when(_mod(key, 2) == 0, "AREA OF MINIMAL FLOOD HAZARD").otherwise("FLOODWAY").alias("fema_flood_zone_subtype"),
        F.when(_mod(key, 19) == 0, F.lit(0.0))
        .when(_mod(key, 23) == 0, F.lit(None))
        .otherwise(price * F.lit(43.56))
        .alias("ll_gissqft"),
        _unless(_mod(key, 7) == 0, number(101, 900000)).alias("ll_bldg_footprint_sqft"),
        x0.alias("minx"),
        y0.alias("miny"),
        (x0 + F.lit(6.0)).alias("maxx"),
        (y0 + F.lit(6.0)).alias("maxy"),
    ]


def _box(x: Column, y: Column, width: float, height: float) -> list[Column]:
    x, y = x.cast("double"), y.cast("double")
    return [x.alias("minx"), y.alias("miny"), (x + F.lit(width)).alias("maxx"), (y + F.lit(height)).alias("maxy")]


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One airport zone per supplier."""
    key = F.col("s_suppkey")
    kind = F.when(_mod(key, 3) == 0, "Runway").otherwise("Airport ground")
    return table(spark, sf_dir, "supplier").select(
        key.alias("id"), kind.alias("feattype"), *_box(_mod(key * 131, 4000), _mod(key * 211, 3000), 60.0, 60.0)
    )


def isochrones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ring per nation, five nested rings per region."""
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    ring = key - _mod(key, 5)
    return table(spark, sf_dir, "nation").select(
        key.alias("id"),
        (F.lit(10) + ring * 2).cast("double").alias("time"),
        (region * 700 + 160 - ring * 8).cast("double").alias("minx"),
        (F.lit(600) - ring * 16).cast("double").alias("miny"),
        (region * 700 + 400 + ring * 8).cast("double").alias("maxx"),
        (F.lit(1800) + ring * 16).cast("double").alias("maxy"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One horizontal line per part."""
    key = F.col("p_partkey")
    kv = F.element_at(F.array(*map(F.lit, ["69", "138", "345"])), (_mod(key, 3) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        key.alias("id"), kv.alias("kv"), F.col("p_brand").alias("operator"),
        *_box(_mod(key * 97, 4000), _mod(key * 173, 3000), 50.0, 0.0),
    )


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vertical road per part."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"), *_box(_mod(key * 59, 4000), _mod(key * 83, 3000), 0.0, 30.0)
    )


def substations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for every supplier."""
    key = F.col("s_suppkey")
    x, y = _mod(key * 157, 4000), _mod(key * 181, 3000)
    return table(spark, sf_dir, "supplier").select(
        key.alias("id"), F.col("s_name").alias("operator"), x.cast("double").alias("x"), y.cast("double").alias("y"),
        *_box(x, y, 0.0, 0.0),
    )


def lookups(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Zoning, site and FEMA ranks."""
    minimal = "AREA OF MINIMAL FLOOD HAZARD"
    zoning = pa.table({
        "zoning_type": ["1-URGENT", "2-HIGH", "3-MEDIUM", "3-MEDIUM"],
        "zoning_subtype": ["F", "O", "F", "O"],
        "zoning_ranking": [8.0, 6.0, 4.0, 4.0],
        "zoning_subtype_ranking": [7.0, 5.0, 9.0, 3.0],
    })
    site = pa.table({"lbcs_site_desc": ["BUILDING", "MACHINERY", "FURNITURE"], "site_ranking": [9.0, 3.0, None]})
    fema = pa.table({
        "fema_nri_risk_rating": ["Very Low", "Relatively Low", "Relatively High"],
        "fema_flood_zone": ["X", "AE", "A"],
        "fema_flood_zone_subtype": [minimal, "FLOODWAY", minimal],
        "fema_nri_ranking": [10.0, 8.0, 2.0],
        "flood_zone_ranking": [10.0, 2.0, 4.0],
        "flood_subtype_ranking": [9.0, 1.0, 6.0],
    })
    return tuple(spark.createDataFrame(t) for t in (zoning, site, fema))
