"""Normalisation and the two ranking methods.

Constants are doubles and operands keep a fixed order, so scores are reproducible bit for bit.
Whole-table minima and maxima come from one partially aggregated row that is broadcast back,
never from an unpartitioned window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import building_coverage
from ..session import Scratch
from .lookups import map_rankings, validate_preferences, validate_weights
from .skew import lookup_join

RANK = "parcel_rank_normalized"
NEUTRAL = 5.0
# Preferences that apply where none is given.
DEFAULT_PREFERENCES = {"size": "max", "distance": "min", "risk": "min", "zoning": "max"}


@dataclass(frozen=True)
class Criterion:
    """A column to bring onto 0-10; ``inverted`` means that small values score high."""

    source: str
    output: str
    inverted: bool = False


SIZE = Criterion("gisacre", "gisacre_norm")
TRANSMISSION = Criterion("et_distance", "transmission_distance_norm", inverted=True)
DRIVE = Criterion("drive_time", "drive_time_norm", inverted=True)
HIGHWAY = Criterion("hwy_distance", "highway_distance_norm", inverted=True)


def scaled(value: Column, low: Column, high: Column, inverted: bool) -> Column:
    """Position of ``value`` between ``low`` and ``high`` on 0-10; 5 when undecidable."""
    position = (value - low) / (high - low) * F.lit(10.0)
    if inverted:
        position = F.lit(10.0) - position
    return F.when(value.isNull() | (low == high), F.lit(NEUTRAL)).otherwise(position)


def with_bounds(
    df: DataFrame,
    columns: list[str],
    scope: list[str] | None = None,
    rows: bool = False,
    scratch: Scratch | None = None,
    id_col: str = "ogc_fid",
) -> DataFrame:
    """Attach ``_lo_<c>`` and ``_hi_<c>`` for each column, over all rows or within each scope."""
    bounds = []
    for c in columns:
        bounds += [F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}")]
    if rows:
        bounds.append(F.count(F.lit(1)).alias("_rows"))
    if not scope:
        # A global aggregate is always exactly one row, so this broadcast has a fixed size.
        return df.join(F.broadcast(df.agg(*bounds)))
    # A struct of the scope columns is never NULL, so parcels without a county form a scope too.
    per_scope = df.groupBy(F.struct(*scope).alias("_scope")).agg(*bounds)
    if scratch is not None:
        per_scope = scratch.materialize(per_scope, "bounds")  # its size is then known
    keyed = df.withColumn("_scope", F.struct(*scope))
    return lookup_join(keyed, per_scope, ["_scope"], "left", [id_col]).drop("_scope")


def minmax(
    df: DataFrame,
    criteria: list[Criterion],
    scope: list[str] | None = None,
    rows: bool = False,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Add one 0-10 column per criterion; a column that is absent counts as unknown everywhere."""
    present = [c for c in criteria if c.source in df.columns]
    bounded = with_bounds(df, [c.source for c in present], scope, rows, scratch) if present or rows else df
    outputs = {
        c.output: scaled(F.col(c.source), F.col(f"_lo_{c.source}"), F.col(f"_hi_{c.source}"), c.inverted)
        if c in present
        else F.lit(NEUTRAL)
        for c in criteria
    }
    helpers = [f"_{side}_{c.source}" for c in present for side in ("lo", "hi")]
    return bounded.withColumns(outputs).drop(*helpers)


def score_mcda(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum over normalised criteria and mapped ranks."""
    w = {name: F.lit(value) for name, value in validate_weights(weights).items()}
    parts = {
        "zoning_score": w["zoning"] * (F.col("zoning_ranking") + F.col("zoning_subtype_ranking")) / F.lit(2.0),
        "site_score": w["description"] * F.col("site_ranking"),
        "nri_score": w["fema_nri"] * F.col("fema_nri_ranking"),
        "flood_score": w["flood"] * (F.col("flood_zone_ranking") + F.col("flood_subtype_ranking")),
        "size_score": w["size"] * F.col("gisacre_norm"),
        "drive_score": w["drive"] * F.col("drive_time_norm"),
        "transmission_score": w["transmission"] * F.col("transmission_distance_norm"),
    }
    total = None
    for name in parts:
        total = F.col(name) if total is None else total + F.col(name)
    return df.withColumns(parts).withColumn("mcda_score", total)


def score_mco(df: DataFrame, preferences: dict[str, str] | None = None, single_size_flip: bool = False) -> DataFrame:
    """Sum of four criteria, each turned so that its preferred end is high.

    A ``min`` size preference flips the size criterion and the total flips it again, so the total
    does not depend on it; ``single_size_flip`` counts the criterion as shown instead.
    """
    chosen = validate_preferences({**DEFAULT_PREFERENCES, **(preferences or {})})
    ten = F.lit(10.0)
    size = F.col("gisacre_norm")
    parts = {
        "size_score": size if chosen["size"] == "max" else ten - size,
        "distance_score": (
            F.col("drive_time_norm") + F.col("highway_distance_norm") + F.col("transmission_distance_norm")
        )
        / F.lit(3.0),
        "risk_score": ten
        - (F.col("fema_nri_ranking") + F.col("flood_zone_ranking") + F.col("flood_subtype_ranking")) / F.lit(3.0),
        "zoning_score": (F.col("zoning_ranking") + F.col("zoning_subtype_ranking")) / F.lit(2.0),
    }
    as_is = {"size_score": "max", "distance_score": "min", "risk_score": "min", "zoning_score": "max"}
    total = None
    for name, straight in as_is.items():
        keep = chosen[name.removesuffix("_score")] == straight
        if name == "size_score" and single_size_flip:
            keep = True
        term = F.col(name) if keep else ten - F.col(name)
        total = term if total is None else total + term
    return df.withColumns(parts).withColumn("mco_score", total)


def rank_0_10(df: DataFrame, score: str, output: str = RANK, scope: list[str] | None = None) -> DataFrame:
    """Bring a score onto 0-10 over all rows (or each scope); equal scores all rank 5."""
    return minmax(df, [Criterion(score, output)], scope)


def _single_row_neutral(df: DataFrame, score: str) -> DataFrame:
    return df.withColumn(score, F.when(F.col("_rows") == 1, F.lit(NEUTRAL)).otherwise(F.col(score))).drop("_rows")


def rank_mcda(
    df: DataFrame,
    lookups: tuple[DataFrame, DataFrame, DataFrame],
    weights: dict[str, float],
    id_col: str = "ogc_fid",
) -> DataFrame:
    """Weighted-sum ranking of all rows; a lone parcel scores and ranks 5."""
    normed = minmax(df, [SIZE, TRANSMISSION, DRIVE], rows=True).withColumn(
        "building_coverage_norm", _coverage(df)
    )
    scored = score_mcda(map_rankings(normed, *lookups, id_col=id_col), weights)
    return rank_0_10(_single_row_neutral(scored, "mcda_score"), "mcda_score")


def rank_mco(
    df: DataFrame,
    lookups: tuple[DataFrame, DataFrame, DataFrame],
    preferences: dict[str, str] | None = None,
    single_size_flip: bool = False,
    id_col: str = "ogc_fid",
) -> DataFrame:
    """Preference-sum ranking of all rows; a lone parcel scores and ranks 5."""
    normed = minmax(df, [SIZE, TRANSMISSION, DRIVE, HIGHWAY], rows=True)
    scored = score_mco(map_rankings(normed, *lookups, id_col=id_col), preferences, single_size_flip)
    return rank_0_10(_single_row_neutral(scored, "mco_score"), "mco_score")


def _coverage(df: DataFrame) -> Column:
    if "ll_gissqft" not in df.columns:
        return F.lit(NEUTRAL)
    if "ll_bldg_footprint_sqft" not in df.columns:
        return F.when((F.col("ll_gissqft") == 0) | F.col("ll_gissqft").isNull(), F.lit(NEUTRAL)).otherwise(F.lit(0.0))
    return building_coverage("ll_bldg_footprint_sqft", "ll_gissqft")


# How each scored criterion is made up, as
# (criterion, raw column, normalised or mapped columns, weight name, score column).
MCDA_PARTS = [
    ("zoning", "zoning_type", ["zoning_ranking", "zoning_subtype_ranking"], "zoning", "zoning_score"),
    ("site", "lbcs_site_desc", ["site_ranking"], "description", "site_score"),
    ("nri", "fema_nri_risk_rating", ["fema_nri_ranking"], "fema_nri", "nri_score"),
    ("flood", "fema_flood_zone", ["flood_zone_ranking", "flood_subtype_ranking"], "flood", "flood_score"),
    ("size", "gisacre", ["gisacre_norm"], "size", "size_score"),
    ("drive", "drive_time", ["drive_time_norm"], "drive", "drive_score"),
    ("transmission", "et_distance", ["transmission_distance_norm"], "transmission", "transmission_score"),
]
MCO_PARTS = [
    ("size", "gisacre", ["gisacre_norm"], "size", "size_score"),
    ("distance", "drive_time", ["drive_time_norm", "highway_distance_norm", "transmission_distance_norm"], "distance", "distance_score"),
    ("risk", "fema_nri_risk_rating", ["fema_nri_ranking", "flood_zone_ranking", "flood_subtype_ranking"], "risk", "risk_score"),
    ("zoning", "zoning_type", ["zoning_ranking", "zoning_subtype_ranking"], "zoning", "zoning_score"),
]


def explain_scores(df: DataFrame, params: dict, method: str = "MCDA", keys: list[str] | None = None) -> DataFrame:
    """One row per parcel and criterion: raw value, normalised sum, weight and contribution."""
    mcda = method.upper() == "MCDA"
    entries = []
    for name, raw, norms, param, score in MCDA_PARTS if mcda else MCO_PARTS:
        norm = F.col(norms[0])
        for other in norms[1:]:
            norm = norm + F.col(other)
        weight = F.lit(str(params[param]))
        entries.append(
            F.struct(
                F.lit(name).alias("criterion"),
                F.col(raw).cast("string").alias("raw"),
                norm.alias("norm"),
                weight.alias("weight"),
                F.col(score).alias("contribution"),
            )
        )
    return df.select(*(keys or ["ogc_fid", "parcelnumb"]), F.inline(F.array(*entries)))


def explain_parcel(df: DataFrame, parcelnumb: str, params: dict, method: str = "MCDA") -> DataFrame:
    """Score breakdown of one parcel number in a ranked table."""
    return explain_scores(df.where(F.col("parcelnumb") == F.lit(parcelnumb)), params, method)
