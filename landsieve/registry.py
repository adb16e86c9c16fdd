"""Every operator as a query over the driver tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions.geometry import as_wkt, parse_wkt, transform_srid, with_envelope
from .functions.scalar import band_is_visible, building_coverage, rank_band, rank_color, sanitize_name
from .operators import catalog, filters, lookups as lk, scoring, spatial, standardize as std, stats
from .oracle import BLOCKS, with_blocks
from .plans.enrichment import Enrichment, enrich
from .plans.loading import load_parcels
from .plans.site_selection import Settings, rank, screening_funnel, site_selection, with_drive_times
from .session import Scratch, lasting_scratch, ship_package
from .sources import readers
from .sources.discover import list_files
from .sources.manifest import CountyTable
from .sources.sinks import export_columns, report_row, write_parcels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *blocks: str):
    """Register a query under its function name, with its SQL over the named blocks."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = with_blocks(sql, *blocks) if blocks else sql.strip()
        return fn

    return add


# --- screening -----------------------------------------------------------------------------------

@query("SELECT ogc_fid, parcelnumb, gisacre FROM parcels WHERE gisacre > 50.0", "parcels")
def q_min_size(spark, sf):
    return filters.filter_min_size(fx.parcels(spark, sf)).select("ogc_fid", "parcelnumb", "gisacre")


@query(
    """SELECT ogc_fid, usedesc, lbcs_ownership_desc FROM parcels
    WHERE (usedesc IS NULL OR usedesc NOT IN ('MACHINERY','5-LOW'))
      AND (lbcs_ownership_desc IS NULL OR lbcs_ownership_desc NOT IN ('MACHINERY','5-LOW'))""",
    "parcels",
)
def q_exclusions(spark, sf):
    kept = filters.filter_exclusions(fx.parcels(spark, sf), fx.EXCLUSIONS)
    return kept.select("ogc_fid", "usedesc", "lbcs_ownership_desc")


@query(
    """, unwanted AS (SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment LIKE 'M%'
      UNION SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority LIKE '5%')
    SELECT ogc_fid, usedesc, lbcs_ownership_desc FROM parcels p
    WHERE NOT EXISTS (SELECT 1 FROM unwanted WHERE value = p.usedesc)
      AND NOT EXISTS (SELECT 1 FROM unwanted WHERE value = p.lbcs_ownership_desc)""",
    "parcels",
)
def q_exclusions_table(spark, sf):
    segments = fx.table(spark, sf, "customer").where(F.col("c_mktsegment").startswith("M")).select(F.col("c_mktsegment").alias("value"))
    owners = fx.table(spark, sf, "orders").where(F.col("o_orderpriority").startswith("5")).select(F.col("o_orderpriority").alias("value"))
    kept = filters.filter_exclusions(fx.parcels(spark, sf), segments.union(owners))
    return kept.select("ogc_fid", "usedesc", "lbcs_ownership_desc")


@query("SELECT ogc_fid, et_distance FROM parcels WHERE et_distance <= 100.0", "parcels")
def q_transmission(spark, sf):
    return filters.filter_transmission(fx.parcels(spark, sf)).select("ogc_fid", "et_distance")


@query(
    "SELECT ogc_fid, et_kv FROM parcels WHERE et_kv IS NOT NULL AND et_kv <> '' AND TRY_CAST(et_kv AS DOUBLE) >= 69.0",
    "parcels",
)
def q_min_kv(spark, sf):
    return filters.filter_min_kv(fx.parcels(spark, sf), 69.0).select("ogc_fid", "et_kv")


@query("SELECT ogc_fid, hwy_distance FROM parcels WHERE hwy_distance <= 500.0", "parcels")
def q_roadway(spark, sf):
    return filters.filter_roadway(fx.parcels(spark, sf), 500.0).select("ogc_fid", "hwy_distance")


@query(
    """SELECT ogc_fid, et_operator, est_operator FROM parcels
    WHERE et_operator = 'City of BUILDING - (ASIA)' OR est_operator = 'City of BUILDING - (ASIA)'""",
    "parcels",
)
def q_provider(spark, sf):
    return filters.filter_provider(fx.parcels(spark, sf), fx.PROVIDER).select("ogc_fid", "et_operator", "est_operator")


def selection_settings(**changes) -> Settings:
    base = dict(
        exclusions=fx.EXCLUSIONS, transmission_distance=200.0, min_kv=69.0, roadway_distance=1500.0,
        weights=fx.WEIGHTS, preferences=fx.PREFERENCES, cell=fx.CELL,
    )
    return Settings(**{**base, **changes})


@query(
    """SELECT CAST(0 AS INTEGER) AS step, 'all' AS stage, count(*) AS n FROM parcels
    UNION ALL SELECT 1, 'min_size', count(*) FROM parcels WHERE gisacre > 50.0
    UNION ALL SELECT 2, 'exclusions', count(*) FROM s1 UNION ALL SELECT 3, 'airports', count(*) FROM s2
    UNION ALL SELECT 4, 'transmission', count(*) FROM s3 UNION ALL SELECT 5, 'min_kv', count(*) FROM s4
    UNION ALL SELECT 6, 'roadway', count(*) FROM s5 UNION ALL SELECT 7, 'provider', count(*) FROM s6""",
    "s6",
)
def q_funnel(spark, sf):
    settings = selection_settings(provider=fx.PROVIDER)
    return screening_funnel(fx.parcels(spark, sf), fx.airports(spark, sf), settings)


# --- spatial joins -------------------------------------------------------------------------------

@query(
    """SELECT ogc_fid, parcelnumb FROM parcels p WHERE NOT EXISTS (SELECT 1 FROM airports a
    WHERE a.feattype = 'Airport ground' AND p.x0 <= a.x1 AND a.x0 <= p.x1 AND p.y0 <= a.y1 AND a.y0 <= p.y1)""",
    "parcels", "airports",
)
def q_airport_anti(spark, sf):
    kept = spatial.filter_airports(fx.parcels(spark, sf), fx.airports(spark, sf), cell=fx.CELL)
    return kept.select("ogc_fid", "parcelnumb")


@query(
    """SELECT ogc_fid, i.id AS iso_id, time FROM parcels p
    JOIN isochrones i ON p.x0 <= i.x1 AND i.x0 <= p.x1 AND p.y0 <= i.y1 AND i.y0 <= p.y1""",
    "parcels", "isochrones",
)
def q_iso_join(spark, sf):
    pairs = spatial.spatial_join(fx.parcels(spark, sf), fx.isochrones(spark, sf), "ogc_fid", "id", ["time"], fx.CELL)
    return pairs.select("ogc_fid", F.col("_r_id").alias("iso_id"), F.col("_r_time").alias("time"))


@query(
    """, met AS (SELECT p.parcelnumb AS pn, MIN(i.time) AS t FROM parcels p
      JOIN isochrones i ON p.x0 <= i.x1 AND i.x0 <= p.x1 AND p.y0 <= i.y1 AND i.y0 <= p.y1 GROUP BY p.parcelnumb)
    SELECT ogc_fid, parcelnumb, COALESCE(t, 9999.0) AS drive_time FROM parcels LEFT JOIN met ON parcelnumb = pn""",
    "parcels", "isochrones",
)
def q_drive_time(spark, sf):
    timed = spatial.attach_drive_time(fx.parcels(spark, sf), fx.isochrones(spark, sf), cell=fx.CELL)
    return timed.select("ogc_fid", "parcelnumb", "drive_time")


@query("SELECT ogc_fid, CAST(9999.0 AS DOUBLE) AS drive_time FROM parcels", "parcels")
def q_drive_default(spark, sf):
    return spatial.attach_drive_time(fx.parcels(spark, sf), None).select("ogc_fid", "drive_time")


@query(
    """, zones AS (SELECT s_suppkey AS id, CAST((s_suppkey * 131) % 4000 AS DOUBLE) AS cx, CAST((s_suppkey * 211) % 3000 AS DOUBLE) AS cy FROM supplier)
    SELECT ogc_fid FROM parcels p WHERE NOT EXISTS
      (SELECT 1 FROM zones z WHERE abs(p.x0 - z.cx) + abs(p.y0 - z.cy) <= 40)""",
    "parcels",
)
def q_polygon_anti(spark, sf):
    """Parcel corners outside every diamond-shaped zone, through exact shapes."""
    number = lambda c: F.col(c).cast("long").cast("string")
    points = fx.parcels(spark, sf).select(
        "ogc_fid", parse_wkt(F.concat(F.lit("POINT("), number("minx"), F.lit(" "), number("miny"), F.lit(")"))).alias("g")
    )
    x, y = F.col("s_suppkey") * 131 % 4000, F.col("s_suppkey") * 211 % 3000
    corner = lambda dx, dy: F.concat((x + dx).cast("string"), F.lit(" "), (y + dy).cast("string"))
    ring = F.concat_ws(",", corner(-40, 0), corner(0, -40), corner(40, 0), corner(0, 40), corner(-40, 0))
    zones = fx.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), parse_wkt(F.concat(F.lit("POLYGON(("), ring, F.lit("))"))).alias("g")
    )
    left = with_envelope(points.select("ogc_fid", "g.geom_wkb"))
    right = with_envelope(zones.select("id", "g.geom_wkb"))
    return spatial.spatial_anti(left, right, "ogc_fid", "id", fx.CELL).select("ogc_fid")


def nearest_blocks(layer: str, max_dist: float, parcels: str = "parcels", suffix: str = "") -> str:
    """Blocks of all pairs within reach and of their order for each parcel; ``rn`` is 1 for the nearest."""
    return f"""d{suffix} AS (SELECT ogc_fid, l.*, sqrt(power(greatest(0.0e0, l.x0 - p.x1, p.x0 - l.x1), 2) + power(greatest(0.0e0, l.y0 - p.y1, p.y0 - l.y1), 2)) AS dist
      FROM {parcels} p JOIN {layer} l ON l.x0 - p.x1 <= {max_dist} AND p.x0 - l.x1 <= {max_dist} AND l.y0 - p.y1 <= {max_dist} AND p.y0 - l.y1 <= {max_dist}),
    k{suffix} AS (SELECT *, row_number() OVER (PARTITION BY ogc_fid ORDER BY dist, id) AS rn FROM d{suffix} WHERE dist <= {max_dist})"""


def nearest_sql(layer: str, columns: str, max_dist: float) -> str:
    return f", {nearest_blocks(layer, max_dist)} SELECT {columns} FROM k WHERE rn = 1"


@query(nearest_sql("lines", "ogc_fid, id, dist AS et_distance, kv AS et_kv, operator AS et_operator", 100), "parcels", "lines")
def q_nearest_line(spark, sf):
    payload = {"kv": "et_kv", "operator": "et_operator"}
    return spatial.nearest(fx.parcels(spark, sf), fx.lines(spark, sf), 100.0, payload, "et_distance", cell=fx.CELL)


@query(nearest_sql("roads", "ogc_fid, id, dist AS hwy_distance", 60), "parcels", "roads")
def q_nearest_road(spark, sf):
    return spatial.nearest(fx.parcels(spark, sf), fx.roads(spark, sf), 60.0, {}, "hwy_distance", cell=fx.CELL)


@query(nearest_sql("substations", "ogc_fid, id, dist AS distance, operator AS est_operator", 150), "parcels", "substations")
def q_nearest_substation(spark, sf):
    return spatial.nearest(
        fx.parcels(spark, sf), fx.substations(spark, sf), 150.0, {"operator": "est_operator"}, cell=fx.CELL
    )


@query(nearest_sql("lines", "ogc_fid, id, dist AS et_distance, kv AS et_kv, operator AS et_operator", 100), "parcels", "lines")
def q_nearest_line_shuffled(spark, sf):
    """The same search as for a layer that is too large to broadcast: from coarse cells to fine ones, by shuffled joins."""
    payload = {"kv": "et_kv", "operator": "et_operator"}
    return spatial.nearest(fx.parcels(spark, sf), fx.lines(spark, sf), 100.0, payload, "et_distance", max_bytes=0)


@query(nearest_sql("roads", "ogc_fid, id, dist AS hwy_distance", 60), "parcels", "roads")
def q_nearest_road_shuffled(spark, sf):
    return spatial.nearest(fx.parcels(spark, sf), fx.roads(spark, sf), 60.0, {}, "hwy_distance", max_bytes=0)


@query(nearest_sql("substations", "ogc_fid, id, dist AS distance, operator AS est_operator", 150), "parcels", "substations")
def q_nearest_substation_shuffled(spark, sf):
    return spatial.nearest(fx.parcels(spark, sf), fx.substations(spark, sf), 150.0, {"operator": "est_operator"}, max_bytes=0)


# Degrees: the plane of 4000 by 3000 units laid over 4 by 3 degrees of Arizona.
LONLAT = "-114.0e0 + {0} / 1000.0e0", "32.0e0 + {0} / 1000.0e0"


def in_degrees(df: DataFrame) -> DataFrame:
    x, y = (lambda c: F.lit(-114.0) + F.col(c) / F.lit(1000.0)), (lambda c: F.lit(32.0) + F.col(c) / F.lit(1000.0))
    return df.withColumns({"minx": x("minx"), "maxx": x("maxx"), "miny": y("miny"), "maxy": y("maxy")})


def overlap_in_degrees(a: str, b: str) -> str:
    lon, lat = (lambda c: LONLAT[0].format(c)), (lambda c: LONLAT[1].format(c))
    return " AND ".join([
        f"{lon(f'{a}.x0')} <= {lon(f'{b}.x1')}", f"{lon(f'{b}.x0')} <= {lon(f'{a}.x1')}", f"{lat(f'{a}.y0')} <= {lat(f'{b}.y1')}", f"{lat(f'{b}.y0')} <= {lat(f'{a}.y1')}"])


@query(
    f"""SELECT ogc_fid, parcelnumb FROM parcels p WHERE NOT EXISTS
    (SELECT 1 FROM airports a WHERE a.feattype = 'Airport ground' AND {overlap_in_degrees('p', 'a')})""",
    "parcels", "airports",
)
def q_airport_anti_lonlat(spark, sf):
    """Boxes in degrees, which a grid made for metres would put into one cell; the grid comes from the layer."""
    kept = spatial.filter_airports(in_degrees(fx.parcels(spark, sf)), in_degrees(fx.airports(spark, sf)))
    return kept.select("ogc_fid", "parcelnumb")


@query(
    f"SELECT ogc_fid, i.id AS iso_id, time FROM parcels p JOIN isochrones i ON {overlap_in_degrees('p', 'i')}",
    "parcels", "isochrones",
)
def q_iso_join_lonlat(spark, sf):
    pairs = spatial.spatial_join(in_degrees(fx.parcels(spark, sf)), in_degrees(fx.isochrones(spark, sf)), "ogc_fid", "id", ["time"])
    return pairs.select("ogc_fid", F.col("_r_id").alias("iso_id"), F.col("_r_time").alias("time"))


def wkt_ring(corners: list[tuple]) -> Column:
    """EWKT of a polygon in 4326 by its corners, columns of longitude and latitude; the first closes it."""
    listed = F.concat_ws(",", *[F.concat(x.cast("string"), F.lit(" "), y.cast("string")) for x, y in [*corners, corners[0]]])
    return F.concat(F.lit("SRID=4326;POLYGON(("), listed, F.lit("))"))


MIXED = """, spots AS (SELECT ogc_fid, -114.0e0 + (x0 + 0.37e0) / 1000.0e0 AS lon, 32.0e0 + (y0 + 0.41e0) / 1000.0e0 AS lat FROM parcels),
    areas AS (SELECT id, time, -114.0e0 + x0 / 1000.0e0 AS a, 32.0e0 + y0 / 1000.0e0 AS b, -114.0e0 + x1 / 1000.0e0 AS c, 32.0e0 + y1 / 1000.0e0 AS d FROM isochrones)
    SELECT ogc_fid, id AS iso_id, time FROM spots JOIN areas ON lon BETWEEN a AND c AND lat BETWEEN b AND d"""


@query(MIXED, "parcels", "isochrones")
def q_iso_join_mixed(spark, sf):
    """Parcel corners in 4326 and isochrones in 5070: the join sees the difference and brings both into one system."""
    lon = lambda c, by=0.0: F.lit(-114.0) + (F.col(c) + F.lit(by)) / F.lit(1000.0)
    lat = lambda c, by=0.0: F.lit(32.0) + (F.col(c) + F.lit(by)) / F.lit(1000.0)
    spot = F.concat(F.lit("SRID=4326;POINT("), lon("minx", 0.37).cast("string"), F.lit(" "), lat("miny", 0.41).cast("string"), F.lit(")"))
    spots = with_envelope(fx.parcels(spark, sf).select("ogc_fid", parse_wkt(spot).alias("g")).select("ogc_fid", "g.geom_wkb", "g.srid"))
    ring = wkt_ring([(lon("minx"), lat("miny")), (lon("maxx"), lat("miny")), (lon("maxx"), lat("maxy")), (lon("minx"), lat("maxy"))])
    areas = transform_srid(fx.isochrones(spark, sf).select("id", "time", parse_wkt(ring).alias("g")).select("id", "time", "g.geom_wkb", "g.srid"), 5070)
    pairs = spatial.spatial_join(spots, areas, "ogc_fid", "id", ["time"])
    return pairs.select("ogc_fid", F.col("_r_id").alias("iso_id"), F.col("_r_time").alias("time"))


@query(
    """SELECT min(x0) AS minx, min(y0) AS miny, max(x1) AS maxx, max(y1) AS maxy,
      (min(x0) + max(x1)) / 2 AS center_x, (min(y0) + max(y1)) / 2 AS center_y FROM parcels""",
    "parcels",
)
def q_extent(spark, sf):
    return spatial.extent(fx.parcels(spark, sf))


@query(
    """, e AS (SELECT min(x0) AS ax, min(y0) AS ay, max(x1) AS bx, max(y1) AS b_y FROM airports)
    SELECT id, operator, x0 AS x, y0 AS y FROM substations, e WHERE x0 > ax AND x0 < bx AND y0 > ay AND y0 < b_y""",
    "substations", "airports",
)
def q_crop_points(spark, sf):
    bounds = spatial.extent(fx.airports(spark, sf)).first()
    cropped = filters.crop_points(fx.substations(spark, sf), tuple(bounds)[:4])
    return cropped.select("id", "operator", "x", "y")


@query(
    """, t AS (SELECT ogc_fid, CAST(x0 AS BIGINT) AS a, CAST(y0 AS BIGINT) AS b FROM parcels)
    SELECT ogc_fid, 'POLYGON((' || concat_ws(',', a || ' ' || b, (a + 6) || ' ' || b, (a + 6) || ' ' || (b + 6), a || ' ' || (b + 6), a || ' ' || b) || '))' AS wkt,
      CAST(a AS DOUBLE) AS minx, CAST(b + 6 AS DOUBLE) AS maxy, true AS is_rect FROM t""",
    "parcels",
)
def q_wkt_round_trip(spark, sf):
    """Text to binary shapes and back, with the box and rectangle test in between."""
    number = lambda c: F.col(c).cast("string")
    corner = lambda x, y: F.concat(number(x), F.lit(" "), number(y))
    ring = F.concat_ws(
        ",", corner("minx", "miny"), corner("maxx", "miny"), corner("maxx", "maxy"), corner("minx", "maxy"), corner("minx", "miny")
    )
    shapes = fx.parcels(spark, sf).select(
        "ogc_fid", parse_wkt(F.concat(F.lit("POLYGON(("), ring, F.lit("))"))).alias("g")
    )
    boxed = with_envelope(shapes.select("ogc_fid", "g.geom_wkb"))
    return boxed.select("ogc_fid", as_wkt("geom_wkb").alias("wkt"), "minx", "maxy", "is_rect")


@query(
    """WITH k AS (SELECT 1.0e0 / 298.257222101e0 AS f), e AS (SELECT f * (2.0e0 - f) AS e2, sqrt(f * (2.0e0 - f)) AS ec FROM k),
    pts AS (SELECT c_custkey AS id, radians(-124.0e0 + (c_custkey * 37 % 5700) / 100.0e0) AS lon, radians(25.0e0 + (c_custkey * 53 % 2400) / 100.0e0) AS lat FROM customer),
    ang AS (SELECT 'a' AS nm, radians(29.5e0) AS t UNION ALL SELECT 'b', radians(45.5e0) UNION ALL SELECT 'o', radians(23.0e0)),
    qm AS (SELECT nm, (1 - e2) * (sin(t) / (1 - e2 * sin(t) * sin(t)) - ln((1 - ec * sin(t)) / (1 + ec * sin(t))) / (2 * ec)) AS q,
      cos(t) / sqrt(1 - e2 * sin(t) * sin(t)) AS m FROM ang, e),
    w AS (SELECT max(CASE nm WHEN 'a' THEN q END) AS qa, max(CASE nm WHEN 'b' THEN q END) AS qb, max(CASE nm WHEN 'o' THEN q END) AS qo,
      max(CASE nm WHEN 'a' THEN m END) AS ma, max(CASE nm WHEN 'b' THEN m END) AS mb FROM qm),
    nc AS (SELECT (ma * ma - mb * mb) / (qb - qa) AS n, ma * ma + (ma * ma - mb * mb) / (qb - qa) * qa AS c, qo FROM w),
    z AS (SELECT id, n, 6378137.0e0 * sqrt(c - n * qo) / n AS r0, n * (lon - radians(-96.0e0)) AS th,
      6378137.0e0 * sqrt(c - n * ((1 - e2) * (sin(lat) / (1 - e2 * sin(lat) * sin(lat)) - ln((1 - ec * sin(lat)) / (1 + ec * sin(lat))) / (2 * ec)))) / n AS r FROM pts, nc, e)
    SELECT id, round(r * sin(th), 2) AS x, round(r0 - r * cos(th), 2) AS y FROM z""",
)
def q_project(spark, sf):
    """Longitude and latitude of every customer site to metres."""
    key = F.col("c_custkey")
    lon = F.lit(-124.0) + (key * 37 % 5700) / F.lit(100.0)
    lat = F.lit(25.0) + (key * 53 % 2400) / F.lit(100.0)
    text = F.concat(F.lit("SRID=4326;POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))
    points = fx.table(spark, sf, "customer").select(key.alias("id"), parse_wkt(text).alias("g"))
    moved = transform_srid(points.select("id", "g.geom_wkb", "g.srid"), 5070)
    return moved.select("id", F.round("minx", 2).alias("x"), F.round("miny", 2).alias("y"))


# --- lookups -------------------------------------------------------------------------------------

@query(
    """SELECT ogc_fid, zoning_type, zoning_subtype, COALESCE(zr, 5.0e0) AS zoning_ranking, COALESCE(zsr, 5.0e0) AS zoning_subtype_ranking
    FROM parcels LEFT JOIN zoning_rankings ON zoning_type = zt AND zoning_subtype = zst""",
    "parcels", "zoning_rankings",
)
def q_lookup_zoning(spark, sf):
    mapped = lk.map_rankings(fx.parcels(spark, sf), zoning=fx.lookups(spark)[0])
    return mapped.select("ogc_fid", *lk.ZONING_KEYS, "zoning_ranking", "zoning_subtype_ranking")


@query(
    "SELECT ogc_fid, lbcs_site_desc, COALESCE(sr, 5.0e0) AS site_ranking FROM parcels LEFT JOIN site_rankings ON lbcs_site_desc = sd",
    "parcels", "site_rankings",
)
def q_lookup_site(spark, sf):
    return lk.map_rankings(fx.parcels(spark, sf), site=fx.lookups(spark)[1]).select("ogc_fid", "lbcs_site_desc", "site_ranking")


@query(
    """SELECT ogc_fid, COALESCE(nr, 5.0e0) AS fema_nri_ranking, COALESCE(fr, 5.0e0) AS flood_zone_ranking, COALESCE(fsr, 5.0e0) AS flood_subtype_ranking
    FROM parcels LEFT JOIN fema_rankings ON fema_nri_risk_rating = nri AND fema_flood_zone = fz AND fema_flood_zone_subtype = fst""",
    "parcels", "fema_rankings",
)
def q_lookup_fema(spark, sf):
    mapped = lk.map_rankings(fx.parcels(spark, sf), fema=fx.lookups(spark)[2])
    return mapped.select("ogc_fid", "fema_nri_ranking", "flood_zone_ranking", "flood_subtype_ranking")


@query(
    """SELECT zoning_type, zoning_subtype, count(*) AS n FROM parcels WHERE zoning_type IS NOT NULL
    GROUP BY zoning_type, zoning_subtype HAVING count(*) > 1""",
    "parcels",
)
def q_lookup_audit(spark, sf):
    """Repeated keys of a lookup as large as the parcel table."""
    return lk.audit_lookup(fx.parcels(spark, sf).where(F.col("zoning_type").isNotNull()), lk.ZONING_KEYS)


@query(
    """, big AS (SELECT parcelnumb AS sd, avg(hwy_distance) AS sr FROM parcels WHERE parcelnumb IS NOT NULL GROUP BY parcelnumb)
    SELECT ogc_fid, COALESCE(sr, 5.0e0) AS site_ranking FROM parcels LEFT JOIN big ON parcelnumb = sd""",
    "parcels",
)
def q_lookup_large(spark, sf):
    """A lookup beyond the broadcast bound: the salted join path."""
    parcels = fx.parcels(spark, sf)
    big = parcels.where("parcelnumb IS NOT NULL").groupBy("parcelnumb").agg(F.avg("hwy_distance").alias("site_ranking"))
    joined = lk.lookup_join(parcels, big, ["parcelnumb"], "left", ["ogc_fid"], max_bytes=0)
    return joined.select("ogc_fid", F.coalesce("site_ranking", F.lit(5.0)).alias("site_ranking"))


# --- normalisation and ranking -------------------------------------------------------------------

@query(
    """SELECT ogc_fid, CASE WHEN gisacre IS NULL THEN 5.0e0 WHEN MIN(gisacre) OVER () = MAX(gisacre) OVER () THEN 5.0e0
      ELSE (gisacre - MIN(gisacre) OVER ()) / (MAX(gisacre) OVER () - MIN(gisacre) OVER ()) * 10 END AS gisacre_norm FROM parcels""",
    "parcels",
)
def q_norm(spark, sf):
    return scoring.minmax(fx.parcels(spark, sf), [scoring.SIZE]).select("ogc_fid", "gisacre_norm")


@query(
    """SELECT ogc_fid, CASE WHEN et_distance IS NULL THEN 5.0e0 WHEN MIN(et_distance) OVER () = MAX(et_distance) OVER () THEN 5.0e0
      ELSE 10 - ((et_distance - MIN(et_distance) OVER ()) / (MAX(et_distance) OVER () - MIN(et_distance) OVER ()) * 10) END AS transmission_distance_norm,
      CASE WHEN hwy_distance IS NULL THEN 5.0e0 WHEN MIN(hwy_distance) OVER () = MAX(hwy_distance) OVER () THEN 5.0e0
      ELSE 10 - ((hwy_distance - MIN(hwy_distance) OVER ()) / (MAX(hwy_distance) OVER () - MIN(hwy_distance) OVER ()) * 10) END AS highway_distance_norm
    FROM parcels""",
    "parcels",
)
def q_norm_inv(spark, sf):
    normed = scoring.minmax(fx.parcels(spark, sf), [scoring.TRANSMISSION, scoring.HIGHWAY])
    return normed.select("ogc_fid", "transmission_distance_norm", "highway_distance_norm")


@query(
    """SELECT ogc_fid, state2, county, CASE WHEN gisacre IS NULL THEN 5.0e0 WHEN MIN(gisacre) OVER w = MAX(gisacre) OVER w THEN 5.0e0
      ELSE (gisacre - MIN(gisacre) OVER w) / (MAX(gisacre) OVER w - MIN(gisacre) OVER w) * 10 END AS gisacre_norm
    FROM parcels WINDOW w AS (PARTITION BY state2, county)""",
    "parcels",
)
def q_norm_by_county(spark, sf):
    normed = scoring.minmax(fx.parcels(spark, sf), [scoring.SIZE], ["state2", "county"], scratch=Scratch(spark))
    return normed.select("ogc_fid", "state2", "county", "gisacre_norm")


@query(
    """SELECT ogc_fid, CASE WHEN ll_gissqft = 0 OR ll_gissqft IS NULL THEN 5.0e0
      ELSE LEAST(10.0, GREATEST(0.0, 10 - (ll_bldg_footprint_sqft / ll_gissqft * 10))) END AS building_coverage_norm FROM parcels""",
    "parcels",
)
def q_bldg_cover(spark, sf):
    coverage = building_coverage("ll_bldg_footprint_sqft", "ll_gissqft").alias("building_coverage_norm")
    return fx.parcels(spark, sf).select("ogc_fid", coverage)


def timed_survivors(spark: SparkSession, sf: str, scratch: Scratch, **changes) -> DataFrame:
    return with_drive_times(
        fx.parcels(spark, sf), fx.airports(spark, sf), fx.isochrones(spark, sf), selection_settings(**changes), scratch
    )


def ranked(spark: SparkSession, sf: str, **changes) -> DataFrame:
    settings = selection_settings(**changes)
    return rank(timed_survivors(spark, sf, Scratch(spark)), fx.lookups(spark), settings)


@query(
    """SELECT ogc_fid, parcelnumb, p_zoning AS zoning_score, p_site AS site_score, p_nri AS nri_score, p_flood AS flood_score,
      p_size AS size_score, p_drive AS drive_score, p_transmission AS transmission_score, bn AS building_coverage_norm,
      drive_time, mcda_score, rn AS parcel_rank_normalized FROM r""",
    "r",
)
def q_mcda(spark, sf):
    return ranked(spark, sf).select(
        "ogc_fid", "parcelnumb", "zoning_score", "site_score", "nri_score", "flood_score", "size_score", "drive_score",
        "transmission_score", "building_coverage_norm", "drive_time", "mcda_score", "parcel_rank_normalized",
    )


MCO_COLUMNS = ["ogc_fid", "size_score", "distance_score", "risk_score", "zoning_score", "mco_score", "parcel_rank_normalized"]


def mco_sql(size: str, total: str) -> str:
    return f"""
    , o AS (SELECT *, {size} AS o_size, {total} AS t FROM c)
    SELECT ogc_fid, o_size AS size_score, o_distance AS distance_score, o_risk AS risk_score, o_zoning AS zoning_score, t AS mco_score,
      CASE WHEN MIN(t) OVER () = MAX(t) OVER () THEN 5.0e0 ELSE (t - MIN(t) OVER ()) / (MAX(t) OVER () - MIN(t) OVER ()) * 10 END AS parcel_rank_normalized FROM o"""


@query(mco_sql("gisacre_norm", "gisacre_norm + o_distance + o_risk + o_zoning"), "c")
def q_mco(spark, sf):
    return ranked(spark, sf, method="MCO").select(*MCO_COLUMNS)


@query(mco_sql("10 - gisacre_norm", "(10 - (10 - gisacre_norm)) + o_distance + o_risk + o_zoning"), "c")
def q_mco_size_min(spark, sf):
    return ranked(spark, sf, method="MCO", preferences={"size": "min"}).select(*MCO_COLUMNS)


@query(mco_sql("10 - gisacre_norm", "(10 - gisacre_norm) + o_distance + o_risk + o_zoning"), "c")
def q_mco_single_flip(spark, sf):
    return ranked(spark, sf, method="MCO", preferences={"size": "min"}, single_size_flip=True).select(*MCO_COLUMNS)


@query(mco_sql("gisacre_norm", "gisacre_norm + (10 - o_distance) + (10 - o_risk) + (10 - o_zoning)"), "c")
def q_mco_turned(spark, sf):
    preferences = {"distance": "max", "risk": "max", "zoning": "min"}
    return ranked(spark, sf, method="MCO", preferences=preferences).select(*MCO_COLUMNS)


STATS_SQL = """SELECT count(*) AS total_parcels, round(min({0}), 6) AS min_score, round(max({0}), 6) AS max_score, round(avg({0}), 6) AS mean_score,
    round(percentile_cont(0.5) WITHIN GROUP (ORDER BY {0}), 6) AS median_score, round(stddev_samp({0}), 6) AS std_dev FROM r"""


def rounded_stats(df: DataFrame) -> DataFrame:
    row = stats.ranking_stats(df)
    return row.select(*[c if c == "total_parcels" else F.round(c, 6).alias(c) for c in row.columns])


@query(STATS_SQL.format("rn"), "r")
def q_stats_mcda(spark, sf):
    scratch = Scratch(spark)
    scores = ranked(spark, sf).select("parcel_rank_normalized")
    return rounded_stats(scratch.materialize(scores, "ranks"))


@query(STATS_SQL.format("rm"), "r")
def q_stats_mco(spark, sf):
    scratch = Scratch(spark)
    scores = ranked(spark, sf, method="MCO").select("parcel_rank_normalized")
    return rounded_stats(scratch.materialize(scores, "ranks"))


@query(
    """SELECT round(percentile_cont(0.5) WITHIN GROUP (ORDER BY gisacre), 6) AS acres_median,
      round(percentile_cont(0.5) WITHIN GROUP (ORDER BY hwy_distance), 6) AS hwy_median FROM parcels""",
    "parcels",
)
def q_median(spark, sf):
    """Exact medians of a continuous and of a heavily repeated column."""
    parcels = fx.parcels(spark, sf)
    acres = stats.exact_quantile(parcels, "gisacre").select(F.round("quantile", 6).alias("acres_median"))
    hwy = stats.exact_quantile(parcels, "hwy_distance").select(F.round("quantile", 6).alias("hwy_median"))
    return acres.join(F.broadcast(hwy))  # one row each


@query(
    """SELECT ogc_fid, parcelnumb, rn AS parcel_rank_normalized, zoning_type, lbcs_site_desc FROM r
    ORDER BY rn DESC NULLS LAST, parcelnumb NULLS LAST, ogc_fid LIMIT 5""",
    "r",
)
def q_top5(spark, sf):
    return stats.top_n(ranked(spark, sf))


@query(
    """SELECT band, visible, count(*) AS n FROM (SELECT CASE WHEN rn >= 0 AND rn < 2 THEN 'Rank 0-2' WHEN rn >= 2 AND rn < 4 THEN 'Rank 2-4'
      WHEN rn >= 4 AND rn < 6 THEN 'Rank 4-6' WHEN rn >= 6 AND rn < 8 THEN 'Rank 6-8' WHEN rn >= 8 AND rn < 11 THEN 'Rank 8-10' END AS band,
      rn >= 6 AND rn < 11 AS visible FROM r) GROUP BY band, visible""",
    "r",
)
def q_rank_band(spark, sf):
    banded = ranked(spark, sf).select(
        rank_band("parcel_rank_normalized").alias("band"), band_is_visible("parcel_rank_normalized").alias("visible")
    )
    return banded.groupBy("band", "visible").agg(F.count(F.lit(1)).alias("n"))


@query(
    """, v AS (SELECT ogc_fid, least(greatest(rn, 1.0e0), 10.0e0) AS x FROM r),
    f AS (SELECT ogc_fid, x, (x - 1.0e0) / 4.5e0 AS a, (x - 5.5e0) / 4.5e0 AS b FROM v),
    g AS (SELECT ogc_fid, CASE WHEN x < 5.5 THEN 1.0e0 - a + a * 1.0e0 WHEN x < 10 THEN (1.0e0 - b) * 1.0e0 + b * 0.0e0 ELSE 0.0e0 END AS cr,
      CASE WHEN x < 5.5 THEN (1.0e0 - a) * 0.0e0 + a * 1.0e0 WHEN x < 10 THEN (1.0e0 - b) * 1.0e0 + b * (128 / 255.0e0) ELSE 128 / 255.0e0 END AS cg FROM f)
    SELECT ogc_fid, '#' || lpad(lower(hex(CAST(floor(cr * 255.9999e0) AS BIGINT))), 2, '0') || lpad(lower(hex(CAST(floor(cg * 255.9999e0) AS BIGINT))), 2, '0') || '00ff' AS color FROM g""",
    "r",
)
def q_rank_color(spark, sf):
    return ranked(spark, sf).select("ogc_fid", rank_color("parcel_rank_normalized").alias("color"))


@query(
    """SELECT ogc_fid, parcelnumb, 'zoning' AS criterion, zoning_type AS raw, zr1 + zsr1 AS norm, '0.2' AS weight, p_zoning AS contribution FROM r
    UNION ALL SELECT ogc_fid, parcelnumb, 'site', lbcs_site_desc, sr1, '0.15', p_site FROM r
    UNION ALL SELECT ogc_fid, parcelnumb, 'nri', fema_nri_risk_rating, nr1, '0.1', p_nri FROM r
    UNION ALL SELECT ogc_fid, parcelnumb, 'flood', fema_flood_zone, fr1 + fsr1, '0.1', p_flood FROM r
    UNION ALL SELECT ogc_fid, parcelnumb, 'size', 'n', gisacre_norm, '0.2', p_size FROM r
    UNION ALL SELECT ogc_fid, parcelnumb, 'drive', 'n', dn, '0.1', p_drive FROM r
    UNION ALL SELECT ogc_fid, parcelnumb, 'transmission', 'n', tn, '0.15', p_transmission FROM r""",
    "r",
)
def q_explain(spark, sf):
    """Score breakdown of every ranked parcel; measured raw values print differently, so 'n' stands in."""
    parts = scoring.explain_scores(ranked(spark, sf), fx.WEIGHTS)
    measured = F.col("criterion").isin("size", "drive", "transmission")
    return parts.withColumn("raw", F.when(measured, F.lit("n")).otherwise(F.col("raw")))


# --- names, catalog, counts ----------------------------------------------------------------------

@query(
    """, t AS (SELECT DISTINCT et_operator AS operator FROM parcels UNION SELECT DISTINCT CAST(o_totalprice AS STRING) || ' Co. #' || o_orderpriority FROM orders
      UNION SELECT '(' || '&-' || ')' FROM region UNION SELECT DISTINCT '~' || c_name || '~' FROM customer),
    s AS (SELECT operator, regexp_replace(replace(lower(operator), ' ', '_'), '[^a-z0-9_]', '', 'g') AS v FROM t WHERE operator IS NULL OR operator NOT LIKE '%Co. #%')
    SELECT operator, CASE WHEN operator IS NULL OR operator = '' THEN 'all_providers' WHEN v = '' THEN 'unknown_provider'
      WHEN v >= '0' AND v < ':' THEN 'provider_' || v ELSE v END AS name FROM s
    UNION ALL SELECT 'Co. ' || o_orderpriority, 'co_' || replace(replace(lower(o_orderpriority), ' ', '_'), '-', '') FROM (SELECT DISTINCT o_orderpriority FROM orders)
    UNION ALL SELECT DISTINCT o_orderpriority, 'provider_' || replace(replace(lower(o_orderpriority), ' ', '_'), '-', '') FROM orders""",
    "parcels",
)
def q_sanitize(spark, sf):
    operators = fx.parcels(spark, sf).select(F.col("et_operator").alias("operator")).distinct()
    symbols = fx.table(spark, sf, "region").select(F.lit("(&-)").alias("operator")).distinct()
    names = fx.table(spark, sf, "customer").select(F.concat(F.lit("~"), "c_name", F.lit("~"))).distinct()
    priorities = fx.table(spark, sf, "orders").select("o_orderpriority").distinct()
    everything = operators.union(symbols).union(names)
    everything = everything.union(priorities.select(F.concat(F.lit("Co. "), "o_orderpriority"))).union(priorities)
    return everything.select("operator", sanitize_name("operator").alias("name"))


@query("SELECT DISTINCT trim(et_operator) AS provider FROM parcels WHERE et_operator IS NOT NULL AND et_operator <> ''", "parcels")
def q_providers(spark, sf):
    return catalog.providers(fx.parcels(spark, sf))


@query("SELECT DISTINCT state2 AS state FROM parcels", "parcels")
def q_states(spark, sf):
    return catalog.states(fx.parcels(spark, sf), "state2")


@query("SELECT DISTINCT county FROM parcels WHERE state2 = 'asia'", "parcels")
def q_counties(spark, sf):
    return catalog.counties(fx.parcels(spark, sf), "asia", "state2")


@query("SELECT state2 AS state, county, count(*) AS n FROM parcels GROUP BY state2, county", "parcels")
def q_county_counts(spark, sf):
    return catalog.county_counts(fx.parcels(spark, sf), "state2")


@query(
    """SELECT ogc_fid, county, usedesc, CASE WHEN state2 = 'asia' THEN et_kv END AS et_kv, CASE WHEN state2 IN ('asia', 'africa') THEN et_operator END AS et_operator
    FROM parcels WHERE gisacre > 50.0""",
    "parcels",
)
def q_union_counties(spark, sf):
    """All states, whose files differ in their columns, read as one with the filter pushed into each."""
    parcels = fx.parcels(spark, sf)
    own = {"asia": ["et_kv", "et_operator"], "africa": ["et_operator"], "america": [], "europe": [], "middle_east": []}
    states = [parcels.where(F.col("state2") == state).select("usedesc", "gisacre", *columns, "county", "ogc_fid") for state, columns in own.items()]
    united = std.union_layers(states)
    return filters.filter_min_size(united).select("ogc_fid", "county", "usedesc", "et_kv", "et_operator")


def run_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows keyed by state, county, provider and run: one run per customer segment and day."""
    t = lambda name: fx.table(spark, sf, name)
    joined = (
        t("orders")
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.select(
        F.lower("r_name").alias("state"), F.lower("n_name").alias("county"), sanitize_name("c_mktsegment").alias("provider"),
        F.date_format("o_orderdate", "yyyyMMdd_HHmmss").alias("run_ts"),
    )


RUNS_SQL = """WITH runs AS (SELECT DISTINCT lower(r_name) AS state, lower(n_name) AS county, lower(c_mktsegment) AS provider, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS run_ts
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(
    RUNS_SQL + """ SELECT state, county, provider, run_ts FROM
    (SELECT *, row_number() OVER (PARTITION BY state, county, provider ORDER BY run_ts DESC) AS age FROM runs) WHERE age > 2"""
)
def q_retention(spark, sf):
    return catalog.runs_to_drop(run_rows(spark, sf))


@query(
    RUNS_SQL + """ SELECT state, county, provider, run_ts, count(*) OVER w AS total_runs, max(run_ts) OVER w AS newest
    FROM runs WINDOW w AS (PARTITION BY state, county, provider)"""
)
def q_runs_info(spark, sf):
    info = catalog.runs_info(run_rows(spark, sf))
    return info.select(
        "state", "county", "provider", "run_ts", "total_runs", F.date_format("newest", "yyyyMMdd_HHmmss").alias("newest")
    )


def written_results(spark: SparkSession, sf: str) -> str:
    """A results table with a folder for each run: one run a year of every county, named after all providers."""
    t = lambda name: fx.table(spark, sf, name)
    joined = (
        t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    rows = joined.select(
        F.col("o_orderkey").alias("ogc_fid"), F.lower("r_name").alias("state"), F.lower("n_name").alias("county"), F.lit("all_providers").alias("provider"),
        F.concat(F.year("o_orderdate").cast("string"), F.lit("0101_000000")).alias("run_ts"))
    path = lasting_scratch(spark).new_path("results")
    rows.repartition("state", "county", "run_ts").write.partitionBy(*catalog.RUN_KEYS, "run_ts").parquet(path)
    return path


YEARLY_SQL = """WITH runs AS (SELECT DISTINCT lower(r_name) AS state, lower(n_name) AS county, 'all_providers' AS provider, strftime(o_orderdate, '%Y') || '0101_000000' AS run_ts
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(YEARLY_SQL + """ SELECT state, county, provider, run_ts, count(*) OVER w AS total_runs, max(run_ts) OVER w AS newest
    FROM runs WINDOW w AS (PARTITION BY state, county, provider)""")
def q_runs_listed(spark, sf):
    """Runs of a written table, read from the names of its folders."""
    info = catalog.runs_info(catalog.run_folders(spark, written_results(spark, sf)))
    return info.select(
        "state", "county", "provider", "run_ts", "total_runs", F.date_format("newest", "yyyyMMdd_HHmmss").alias("newest")
    )


@query(YEARLY_SQL + """ SELECT state, county, provider, run_ts FROM
    (SELECT *, row_number() OVER (PARTITION BY state, county, provider ORDER BY run_ts DESC) AS age FROM runs) WHERE age > 2""")
def q_retention_listed(spark, sf):
    return catalog.runs_to_drop(catalog.run_folders(spark, written_results(spark, sf)))


# --- schema --------------------------------------------------------------------------------------

@query(
    """SELECT ogc_fid, CAST(NULL AS STRING) AS geoid, parcelnumb, county, gisacre, CAST(NULL AS STRING) AS legaldesc,
      CAST(NULL AS DOUBLE) AS nothing, x0 AS minx, y1 AS maxy FROM parcels""",
    "parcels",
)
def q_standardize(spark, sf):
    full = std.standardize(fx.parcels(spark, sf))
    nothing = F.lit(None).cast("double").alias("nothing")
    return full.select("ogc_fid", "geoid", "parcelnumb", "county", "gisacre", "legaldesc", nothing, "minx", "maxy")


@query(
    """SELECT ogc_fid, COALESCE(usedesc, lbcs_site_desc) AS usedesc, gisacre, parcelnumb AS parcelnumb FROM parcels""", "parcels"
)
def q_aliases(spark, sf):
    source = fx.parcels(spark, sf).select(
        "ogc_fid", "usedesc", F.col("lbcs_site_desc").alias("land_use"), F.col("gisacre").alias("acreage"),
        F.col("parcelnumb").alias("parcelid"),
    )
    return std.apply_aliases(source).select("ogc_fid", "usedesc", "gisacre", "parcelnumb")


@query(
    """SELECT ogc_fid, TRY_CAST(et_kv AS DOUBLE) AS gisacre, TRY_CAST(zoning_type AS DOUBLE) AS hwy_distance, usedesc FROM parcels""",
    "parcels",
)
def q_cast(spark, sf):
    texts = fx.parcels(spark, sf).select(
        "ogc_fid", F.col("et_kv").alias("gisacre"), F.col("zoning_type").alias("hwy_distance"), "usedesc"
    )
    return std.cast_parcels(texts)


SCHEMA_STANDARD = ["parcelnumb", "usedesc", "county", "gisacre", "et_kv", "legaldesc", "zoning_subtype"]
SCHEMA_EXTRA = ["est_operator", "et_distance", "hwy_distance"]


def source_columns(spark: SparkSession, sf: str) -> DataFrame:
    """One source per state, county and voltage class, holding the columns it fills."""
    parcels = fx.parcels(spark, sf).withColumn("file", F.coalesce("et_kv", F.lit("none"))).withColumnRenamed("state2", "state")
    candidates = [c for c in [*SCHEMA_STANDARD, *SCHEMA_EXTRA] if c in parcels.columns and c != "county"]
    return std.filled_columns(parcels, ["state", "county", "file"], candidates)


def _present(names: list[str], keep: bool) -> str:
    parts = [
        f"CASE WHEN n_{c} {'=' if keep else '>'} 0 THEN '{c}' END" if c not in ("county", "legaldesc")
        else (f"'{c}'" if keep else "NULL")
        for c in names
    ]
    return f"concat_ws(',', {', '.join(parts)})"


SOURCES_SQL = (
    ", src AS (SELECT state2 AS state, county, COALESCE(et_kv, 'none') AS file, "
    + ", ".join(f"count({c}) AS n_{c}" for c in [*SCHEMA_STANDARD, *SCHEMA_EXTRA] if c not in ("county", "legaldesc"))
    + " FROM parcels GROUP BY state2, county, COALESCE(et_kv, 'none')), rep AS (SELECT *, "
    + _present(SCHEMA_STANDARD, True) + " AS missing_columns, " + _present(SCHEMA_EXTRA, False) + " AS unmapped_columns FROM src), "
    + "num AS (SELECT *, CASE WHEN missing_columns = '' THEN 0 ELSE len(string_split(missing_columns, ',')) END AS added, "
    + "CASE WHEN unmapped_columns = '' THEN 0 ELSE len(string_split(unmapped_columns, ',')) END AS unmapped FROM rep)"
)


@query(
    SOURCES_SQL + """ SELECT state, county, file, missing_columns, unmapped_columns, CAST(added AS INTEGER) AS columns_added,
    CAST(unmapped AS INTEGER) AS columns_unmapped FROM num""",
    "parcels",
)
def q_schema_report(spark, sf):
    files, _, _ = std.schema_report(source_columns(spark, sf), SCHEMA_STANDARD)
    return files.select(
        "state", "county", "file", F.array_join("missing_columns", ",").alias("missing_columns"),
        F.array_join("unmapped_columns", ",").alias("unmapped_columns"), "columns_added", "columns_unmapped",
    )


@query(
    SOURCES_SQL + """ SELECT state, count(DISTINCT county) AS counties, count(*) AS files, CAST(sum(added) AS BIGINT) AS columns_added,
    CAST(sum(unmapped) AS BIGINT) AS columns_unmapped FROM num GROUP BY state""",
    "parcels",
)
def q_schema_states(spark, sf):
    _, per_state, _ = std.schema_report(source_columns(spark, sf), SCHEMA_STANDARD)
    return per_state.drop("state_columns")


@query(
    SOURCES_SQL + """ SELECT count(DISTINCT state) AS total_states, count(DISTINCT state || '/' || county) AS total_counties, count(*) AS total_files,
    CAST(sum(added) AS BIGINT) AS total_columns_added, CAST(sum(unmapped) AS BIGINT) AS total_columns_unmapped FROM num""",
    "parcels",
)
def q_schema_summary(spark, sf):
    return std.schema_report(source_columns(spark, sf), SCHEMA_STANDARD)[2]


# --- whole runs ----------------------------------------------------------------------------------

def enriched_sql(body: str, *blocks: str) -> str:
    """``body`` over the blocks, where the parcels have the columns of their nearest line, road and substation."""
    steps = ",\n".join([
        f"bare AS ({BLOCKS['parcels']})",
        *[f"{layer} AS ({BLOCKS[layer]}),\n{nearest_blocks(layer, 100, 'bare', f'_{layer}')}" for layer in ("lines", "roads", "substations")],
        """parcels AS (SELECT p.* REPLACE (l.dist AS et_distance, l.kv AS et_kv, l.operator AS et_operator, r.dist AS hwy_distance, s.operator AS est_operator) FROM bare p
      LEFT JOIN k_lines l ON l.ogc_fid = p.ogc_fid AND l.rn = 1 LEFT JOIN k_roads r ON r.ogc_fid = p.ogc_fid AND r.rn = 1 LEFT JOIN k_substations s ON s.ogc_fid = p.ogc_fid AND s.rn = 1)""",
    ])
    return with_blocks(body, *blocks).replace(f"parcels AS ({BLOCKS['parcels']})", steps)


def raw_parcels(spark: SparkSession, sf: str, scratch: Scratch) -> str:
    """The parcels as CSV files in a tree of state and county folders, without the columns that enrichment adds."""
    number = lambda c: F.col(c).cast("string")
    corner = lambda x, y: F.concat(number(x), F.lit(" "), number(y))
    ring = F.concat_ws(
        ",", corner("minx", "miny"), corner("maxx", "miny"), corner("maxx", "maxy"), corner("minx", "maxy"), corner("minx", "miny")
    )
    rows = fx.parcels(spark, sf).withColumn("wkt", F.concat(F.lit("POLYGON(("), ring, F.lit("))")))
    rows = rows.drop("et_distance", "et_kv", "et_operator", "est_operator", "hwy_distance", *spatial.BOX_COLUMNS)
    path = scratch.new_path("raw")
    rows.withColumnsRenamed({"state2": "state"}).write.partitionBy("state", "county").option("header", True).csv(f"{path}/parcels")
    return path


@query(
    enriched_sql(
        """SELECT ogc_fid, state2 AS state, county, et_distance, et_kv, et_operator, hwy_distance, est_operator, drive_time, mcda_score, rn AS parcel_rank_normalized FROM r""",
        "r"))
def q_load_select(spark, sf):
    """Parcel files into tables, enriched by the nearest line, road and substation on the way, then screened and ranked."""
    scratch = lasting_scratch(spark)
    loaded, _ = load_parcels(spark, raw_parcels(spark, sf, scratch), scratch)
    layers = {name: getattr(fx, name)(spark, sf) for name in ("lines", "roads", "substations")}
    layers = {name: with_box_shapes(layer) for name, layer in layers.items()}
    enriched = enrich(loaded, layers, Enrichment("lines", max_dist=100.0, srid=None), scratch)
    tables = scratch.new_path("tables")
    folder = lambda c: F.regexp_replace(c, "^[a-z]+=", "")
    named = enriched.drop("county", "geom_wkb", "srid", "is_rect").withColumns({"state": folder("_state"), "county": folder("_folder")}).drop("_state", "_folder")
    write_parcels(named.withColumn("ogc_fid", F.col("ogc_fid").cast("long")), tables)
    parcels = spark.read.parquet(tables)
    ranked_rows = site_selection(parcels, fx.lookups(spark), selection_settings(), scratch, fx.airports(spark, sf), fx.isochrones(spark, sf))
    return ranked_rows.select(
        "ogc_fid", "state", "county", "et_distance", "et_kv", "et_operator", "hwy_distance", "est_operator", "drive_time", "mcda_score", "parcel_rank_normalized")


def with_box_shapes(layer: DataFrame) -> DataFrame:
    """Boxes of no width, height or both as exact shapes."""
    text = lambda *cs: F.concat(*[F.lit(c) if c in " ,()" or c.isupper() else F.col(c).cast("string") for c in cs])
    line = text("LINESTRING", "(", "minx", " ", "miny", ",", "maxx", " ", "maxy", ")")
    point = text("POINT", "(", "minx", " ", "miny", ")")
    flat = (F.col("minx") == F.col("maxx")) & (F.col("miny") == F.col("maxy"))
    shaped = layer.withColumn("geom_wkb", parse_wkt(F.when(flat, point).otherwise(line))["geom_wkb"])
    return with_envelope(shaped.drop(*spatial.BOX_COLUMNS))


@query(
    """, pt AS (SELECT p.parcelnumb AS pn, MIN(i.time) AS t FROM s6 p JOIN isochrones i ON p.x0 <= i.x1 AND i.x0 <= p.x1 AND p.y0 <= i.y1 AND i.y0 <= p.y1 GROUP BY p.parcelnumb),
    p7 AS (SELECT s6.*, COALESCE(pt.t, 9999.0) AS drive_time FROM s6 LEFT JOIN pt ON s6.parcelnumb = pt.pn),
    b AS (SELECT min(gisacre) AS g0, max(gisacre) AS g1, min(et_distance) AS e0, max(et_distance) AS e1, min(drive_time) AS d0, max(drive_time) AS d1 FROM p7),
    j AS (SELECT p7.*, 0.2e0*(COALESCE(zr,5.0e0)+COALESCE(zsr,5.0e0))/2 + 0.15e0*COALESCE(sr,5.0e0) + 0.1e0*COALESCE(nr,5.0e0) + 0.1e0*(COALESCE(fr,5.0e0)+COALESCE(fsr,5.0e0))
      + 0.2e0*CASE WHEN gisacre IS NULL OR g0 = g1 THEN 5.0e0 ELSE (gisacre - g0) / (g1 - g0) * 10 END
      + 0.1e0*CASE WHEN drive_time IS NULL OR d0 = d1 THEN 5.0e0 ELSE 10 - (drive_time - d0) / (d1 - d0) * 10 END
      + 0.15e0*CASE WHEN et_distance IS NULL OR e0 = e1 THEN 5.0e0 ELSE 10 - (et_distance - e0) / (e1 - e0) * 10 END AS mcda_score
      FROM p7 CROSS JOIN b LEFT JOIN zoning_rankings z ON zoning_type = zt AND zoning_subtype = zst LEFT JOIN site_rankings s ON lbcs_site_desc = sd
      LEFT JOIN fema_rankings f ON fema_nri_risk_rating = nri AND fema_flood_zone = fz AND fema_flood_zone_subtype = fst)
    SELECT ogc_fid, parcelnumb, drive_time, mcda_score, CASE WHEN min(mcda_score) OVER () = max(mcda_score) OVER () THEN 5.0e0
      ELSE (mcda_score - min(mcda_score) OVER ()) / (max(mcda_score) OVER () - min(mcda_score) OVER ()) * 10 END AS parcel_rank_normalized FROM j""",
    "s6", "isochrones", "zoning_rankings", "site_rankings", "fema_rankings",
)
def q_site_selection(spark, sf):
    """Every step in one go, for one provider."""
    result = site_selection(
        fx.parcels(spark, sf), fx.lookups(spark), selection_settings(provider=fx.PROVIDER), Scratch(spark),
        fx.airports(spark, sf), fx.isochrones(spark, sf),
    )
    return result.select("ogc_fid", "parcelnumb", "drive_time", "mcda_score", "parcel_rank_normalized")


@query(
    """SELECT parcelnumb, rn AS parcel_rank_normalized, mcda_score, zoning_type, zoning_subtype, lbcs_site_desc, fema_nri_risk_rating,
      fema_flood_zone, fema_flood_zone_subtype, gisacre, drive_time, et_distance, hwy_distance, p_zoning AS zoning_score, p_site AS site_score,
      p_nri AS nri_score, p_flood AS flood_score, p_size AS size_score, p_drive AS drive_score, p_transmission AS transmission_score FROM r""",
    "r",
)
def q_export_rows(spark, sf):
    return export_columns(ranked(spark, sf), "MCDA")


@query(
    """, g AS (SELECT count(*) AS n, round(avg(rn), 6) AS a, round(stddev_samp(rn), 6) AS d FROM r),
    top AS (SELECT row_number() OVER (ORDER BY rn DESC, parcelnumb NULLS LAST, ogc_fid) AS k, parcelnumb FROM r)
    SELECT n AS total_parcels, a AS mean_score, d AS std_dev, (SELECT parcelnumb FROM top WHERE k = 1) AS best, '200.0' AS transmission_distance, 'MCDA' AS method FROM g""",
    "r",
)
def q_report(spark, sf):
    """The run report, flattened."""
    scratch = Scratch(spark)
    settings = selection_settings()
    table = scratch.materialize(ranked(spark, sf), "ranked")
    report = report_row(table, settings)
    return report.select(
        "statistics.total_parcels", F.round("statistics.mean_score", 6).alias("mean_score"),
        F.round("statistics.std_dev", 6).alias("std_dev"), F.col("top_parcels")[0]["parcelnumb"].alias("best"),
        F.col("summary")["transmission_distance"].alias("transmission_distance"), F.col("summary")["ranking_method"].alias("method"),
    )


# --- whole results of readers, tables and reports -------------------------------------------------

EXACT = """, d AS (SELECT ogc_fid, p.x0 AS px, p.y0 AS py, l.x0 AS ax, l.y0 AS ay, l.x1 - l.x0 AS dx, l.y1 - l.y0 AS dy FROM parcels p JOIN lines l
      ON p.x0 >= l.x0 - 100 AND p.x0 <= l.x1 + 100 AND p.y0 >= l.y0 - 100 AND p.y0 <= l.y1 + 100),
    t AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0.0e0 ELSE least(1.0e0, greatest(0.0e0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) END AS share FROM d),
    g AS (SELECT ogc_fid, sqrt(power(px - ax - share * dx, 2) + power(py - ay - share * dy, 2)) AS gap FROM t)
    SELECT ogc_fid, round(min(gap), 4) AS distance FROM g WHERE gap <= 100 GROUP BY ogc_fid"""


@query(EXACT, "parcels", "lines")
def q_nearest_exact(spark, sf):
    """Distance from a corner of each parcel to the nearest slanting line, by shapes rather than boxes."""
    spot = F.concat(F.lit("POINT("), F.col("minx").cast("string"), F.lit(" "), F.col("miny").cast("string"), F.lit(")"))
    spots = with_envelope(fx.parcels(spark, sf).select("ogc_fid", parse_wkt(spot)["geom_wkb"].alias("geom_wkb")))
    found = spatial.nearest(spots, with_box_shapes(fx.lines(spark, sf)), 100.0, cell=fx.CELL)
    return found.select("ogc_fid", F.round("distance", 4).alias("distance"))


@query(
    """SELECT CAST(ogc_fid AS VARCHAR) AS ogc_fid, 'lot "' || ogc_fid || '"' || chr(10) || 'of, ' || parcelnumb AS legaldesc, zoning_type,
      'POINT(' || CAST(x0 AS BIGINT) || ' ' || CAST(y0 AS BIGINT) || ')' AS wkt FROM parcels""",
    "parcels",
)
def q_csv_layer(spark, sf):
    """CSV files whose cells hold quotes, separators and line breaks, read in ranges far smaller than the files."""
    scratch = lasting_scratch(spark)
    whole = lambda c: F.col(c).cast("long").cast("string")
    legal = F.concat(F.lit('lot "'), whole("ogc_fid"), F.lit('"\nof, '), F.col("parcelnumb"))
    spot = F.concat(F.lit("POINT("), whole("minx"), F.lit(" "), whole("miny"), F.lit(")"))
    rows = fx.parcels(spark, sf).select(whole("ogc_fid").alias("ogc_fid"), legal.alias("legaldesc"), "zoning_type", spot.alias("wkt"))
    path = scratch.new_path("csv")
    rows.write.options(header=True, escape='"').csv(path)
    files = [r["path"] for r in list_files(spark, path).where("ext = 'csv'").select("path").collect()]  # a row for each file
    read = readers.read_csv_layer(spark, files, rows.columns, ["ogc_fid", "legaldesc", "zoning_type"], range_bytes=65536)
    return read.select("ogc_fid", "legaldesc", "zoning_type", as_wkt("geom_wkb").alias("wkt"))


@query(
    SOURCES_SQL + ", one AS (" + " UNION ALL ".join(
        f"SELECT state, '{c}' AS name FROM src GROUP BY state HAVING max(n_{c}) > 0" for c in [*SCHEMA_STANDARD, *SCHEMA_EXTRA] if c not in ("county", "legaldesc"))
    + ") SELECT state, string_agg(name, ',' ORDER BY name) AS state_columns FROM one GROUP BY state",
    "parcels",
)
def q_schema_state_columns(spark, sf):
    _, per_state, _ = std.schema_report(source_columns(spark, sf), SCHEMA_STANDARD)
    return per_state.select("state", F.array_join("state_columns", ",").alias("state_columns"))


@query(
    """SELECT ogc_fid, 'size' AS criterion, gisacre AS raw FROM r UNION ALL SELECT ogc_fid, 'drive', drive_time FROM r
    UNION ALL SELECT ogc_fid, 'transmission', et_distance FROM r""",
    "r",
)
def q_explain_measures(spark, sf):
    """The measured raw values of every score breakdown, as numbers."""
    parts = scoring.explain_scores(ranked(spark, sf), fx.WEIGHTS)
    return parts.where(F.col("criterion").isin("size", "drive", "transmission")).select("ogc_fid", "criterion", F.col("raw").cast("double").alias("raw"))


@query("""SELECT ogc_fid, state2 AS state, county, CASE WHEN state2 = 'asia' THEN gisacre * 2 ELSE gisacre END AS gisacre FROM parcels""", "parcels")
def q_changed_counties(spark, sf):
    """A table of all counties after those of one state have been loaded again."""
    table = CountyTable(spark, lasting_scratch(spark).new_path("counties"))
    parcels = fx.parcels(spark, sf).select("ogc_fid", F.col("state2").alias("state"), "county", "gisacre")
    again = parcels.where("state = 'asia'").withColumn("gisacre", F.col("gisacre") * 2)
    for rows, digest, change in ((parcels, "1", "new"), (again, "2", "changed")):
        counties = rows.select("state", "county").distinct()
        table.commit(rows, counties.withColumns({"digest": F.lit(digest), "change": F.lit(change)}))
    return table.read()
