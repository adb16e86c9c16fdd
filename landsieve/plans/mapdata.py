"""Map-ready data of a ranked table: features per rank band, extent, and cropped layers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import DEFAULT_SRID, transform_srid, with_envelope
from ..functions.scalar import band_is_visible, rank_band, rank_color
from ..operators.filters import crop_points
from ..operators.scoring import RANK
from ..operators.spatial import extent
from ..operators.standardize import stringify_dates
from ..sources.sinks import POPUP_COLUMNS, features

# Map centres as (latitude, longitude) where a layer has no extent.
STATE_CENTERS = {"co": (39.0, -105.5), "az": (34.0, -112.0)}
DEFAULT_CENTER = (39.0, -105.5)
# Popup columns of the point layers; absent ones show as N/A.
SUBSTATION_COLUMNS = ["name", "voltage", "operator"]
POI_COLUMNS = ["name", "address"]
ABSENT = "N/A"


@dataclass
class MapData:
    """Frames of one map; ``center`` is (latitude, longitude), ``bounds`` (minx, miny, maxx, maxy)."""

    parcels: DataFrame
    center: tuple[float, float]
    bounds: tuple[float, float, float, float] | None
    isochrones: DataFrame | None = None
    substations: DataFrame | None = None
    points: dict[str, DataFrame] | None = None


def with_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Lower-case the column names and fill absent or NULL popup columns with N/A."""
    df = df.toDF(*[c.lower() for c in df.columns])
    return df.withColumns(
        {n: F.coalesce(F.col(n).cast("string"), F.lit(ABSENT)) if n in df.columns else F.lit(ABSENT) for n in names}
    )


def points_in(df: DataFrame, bounds: tuple[float, float, float, float] | None, popup: list[str]) -> DataFrame:
    """Point layer in longitude and latitude with its popup columns, cropped when bounds are given."""
    if "geom_wkb" in df.columns:
        df = transform_srid(df, DEFAULT_SRID)
    named = with_columns(df, popup)
    placed = named.withColumns({"lon": F.col("minx"), "lat": F.col("miny")})
    return placed if bounds is None else crop_points(placed, bounds, "lon", "lat")


def map_data(
    ranked: DataFrame,
    state: str,
    isochrones: DataFrame | None = None,
    substations: DataFrame | None = None,
    points: dict[str, DataFrame] | None = None,
) -> MapData:
    """Prepare a ranked table and its layers for display in longitude and latitude.

    Only the extent, one row, comes to the driver. Substations are cropped to it, other point
    layers are shown whole.
    """
    parcels = stringify_dates(ranked)
    parcels = transform_srid(parcels, DEFAULT_SRID) if "srid" in parcels.columns else with_envelope(parcels)
    box = extent(parcels).first()
    bounds = None if box["minx"] is None else (box["minx"], box["miny"], box["maxx"], box["maxy"])
    center = (box["center_y"], box["center_x"]) if bounds else STATE_CENTERS.get(state.lower(), DEFAULT_CENTER)

    absent = {c: F.lit(None).cast("string") for c in POPUP_COLUMNS if c not in parcels.columns}
    shown = features(parcels.withColumns(absent) if absent else parcels, POPUP_COLUMNS)
    shown = shown.withColumns({
        "band": rank_band(RANK), "visible": band_is_visible(RANK), "color": rank_color(RANK),
    }).where(F.col("band").isNotNull())

    rings = None
    if isochrones is not None:
        rings = features(transform_srid(isochrones, DEFAULT_SRID), ["time"]).withColumn(
            "label", F.concat(F.lit("Isochrone "), F.col("time").cast("string"), F.lit(" minutes"))
        )
    return MapData(
        parcels=shown,
        center=center,
        bounds=bounds,
        isochrones=rings,
        substations=points_in(substations, bounds, SUBSTATION_COLUMNS) if substations is not None and bounds else None,
        points={name: points_in(layer, None, POI_COLUMNS) for name, layer in (points or {}).items()},
    )
