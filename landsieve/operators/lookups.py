"""Ranking sheets: validation, lookup tables and the joins that attach ranks to parcels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import try_double
from .skew import lookup_join

# Header names of the ranking sheet (one is misspelt at the source).
SHEET_KEYS = [
    "zoning_type", "zoning_subtype", "lbcs_site_desc",
    "fema_nri_risk_rating", "fema_flood_zone", "fema_flood_zone_subtype",
]
SHEET_RANKS = {
    "Zoning Ranking": "zoning_ranking",
    "Zoning Subtype Ranking": "zoning_subtype_ranking",
    "Site Descirption Ranking": "site_ranking",
    "Fema NRI Risk Ranking": "fema_nri_ranking",
    "Fema Flood Zone Ranking": "flood_zone_ranking",
    "Fema Flood Zone Subtype Ranking": "flood_subtype_ranking",
}
# Parameter names each ranking method needs.
WEIGHT_NAMES = ["zoning", "description", "fema_nri", "flood", "size", "drive", "transmission"]
PREFERENCE_NAMES = ["size", "distance", "risk", "zoning"]

ZONING_KEYS = ["zoning_type", "zoning_subtype"]
SITE_KEYS = ["lbcs_site_desc"]
FEMA_KEYS = ["fema_nri_risk_rating", "fema_flood_zone", "fema_flood_zone_subtype"]
DEFAULT_RANK = 5.0


class InvalidRanking(ValueError):
    """The ranking sheet, the weights or the preferences cannot be used."""


def validate_weights(weights: dict[str, float]) -> dict[str, float]:
    missing = [n for n in WEIGHT_NAMES if n not in weights]
    if missing:
        raise InvalidRanking(f"weights missing: {missing}")
    for name, value in weights.items():
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        if not number or math.isnan(value) or value < 0:
            raise InvalidRanking(f"weight {name!r} must be a number of at least zero, got {value!r}")
    return {name: float(value) for name, value in weights.items()}


def validate_preferences(preferences: dict[str, str]) -> dict[str, str]:
    missing = [n for n in PREFERENCE_NAMES if n not in preferences]
    if missing:
        raise InvalidRanking(f"preferences missing: {missing}")
    lowered = {name: str(value).lower() for name, value in preferences.items()}
    for name, value in lowered.items():
        if value not in ("min", "max"):
            raise InvalidRanking(f"preference {name!r} must be min or max, got {preferences[name]!r}")
    return lowered


def validate_ranking(sheet: DataFrame, params: dict, method: str = "MCDA") -> dict:
    """Check the sheet header, its rank cells (one aggregate) and the method's parameters."""
    missing = [c for c in [*SHEET_KEYS, *SHEET_RANKS] if c not in sheet.columns]
    if missing:
        raise InvalidRanking(f"ranking sheet lacks columns: {missing}")
    bad = [
        F.count_if(F.col(f"`{c}`").isNotNull() & (F.trim(F.col(f"`{c}`").cast("string")) != "") & try_double(c).isNull())
        .alias(new)
        for c, new in SHEET_RANKS.items()
    ]
    counts = sheet.agg(*bad).first().asDict()
    wrong = {c: counts[new] for c, new in SHEET_RANKS.items() if counts[new]}
    if wrong:
        raise InvalidRanking(f"ranking sheet has cells that are not numbers: {wrong}")
    return validate_weights(params) if method.upper() == "MCDA" else validate_preferences(params)


def build_lookups(sheet: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cut the side-by-side sheet into zoning, site and FEMA lookup tables.

    A row belongs to a table when the table's first key is filled; other blank keys become the
    empty string and so match an empty string, never a NULL. Ranks are doubles, blank is NULL.
    """

    def cut(keys: list[str], ranks: list[str]) -> DataFrame:
        named = {new: old for old, new in SHEET_RANKS.items()}
        columns = [F.col(keys[0]), *[F.coalesce(F.col(k), F.lit("")).alias(k) for k in keys[1:]]]
        values = [try_double(named[r]).alias(r) for r in ranks]
        return sheet.where(F.col(keys[0]).isNotNull()).select(*columns, *values)

    return (
        cut(ZONING_KEYS, ["zoning_ranking", "zoning_subtype_ranking"]),
        cut(SITE_KEYS, ["site_ranking"]),
        cut(FEMA_KEYS, ["fema_nri_ranking", "flood_zone_ranking", "flood_subtype_ranking"]),
    )


def map_rankings(
    df: DataFrame,
    zoning: DataFrame | None = None,
    site: DataFrame | None = None,
    fema: DataFrame | None = None,
    default: float = DEFAULT_RANK,
    id_col: str = "ogc_fid",
) -> DataFrame:
    """Attach the ranks of each given lookup; unmatched or blank ranks become ``default``.

    Duplicate lookup keys repeat parcels, as a left join does; see ``audit_lookup``.
    """
    for lookup, keys in ((zoning, ZONING_KEYS), (site, SITE_KEYS), (fema, FEMA_KEYS)):
        if lookup is None:
            continue
        ranks = [c for c in lookup.columns if c not in keys]
        df = lookup_join(df, lookup, keys, "left", [id_col])
        df = df.withColumns({r: F.coalesce(F.col(r), F.lit(float(default))) for r in ranks})
    return df


def audit_lookup(lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once in a lookup, with their number of rows."""
    return lookup.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
