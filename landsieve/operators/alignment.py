"""Bringing both sides of a spatial join into one reference system."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.albers import SRIDS
from ..functions.geometry import DEFAULT_SRID, effective_srid, transform_srid


def srids(*sides: DataFrame) -> list[list[int]]:
    """The reference systems of each side's rows that have a place, in one job; a side without ``srid`` has none stated.

    Rows that state none count as 4326. The sets are aggregated in tasks and hold the few systems in use.
    """
    stated = None
    for i, side in enumerate(sides):
        if "srid" not in side.columns:
            continue
        has_place = F.col("geom_wkb").isNotNull() if "geom_wkb" in side.columns else F.col("minx").isNotNull()
        found = side.where(has_place).select(effective_srid().cast("int").alias("srid")).agg(F.lit(i).alias("side"), F.collect_set("srid").alias("srids"))
        stated = found if stated is None else stated.unionByName(found)
    rows = {} if stated is None else {r["side"]: sorted(r["srids"]) for r in stated.collect()}  # a row for each side
    return [rows.get(i, []) for i in range(len(sides))]


def align(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides in one reference system, row by row; frames that state no ``srid`` are taken to be in it already.

    The system is the left side's if it has just one, otherwise the first of 5070, 4326 that occurs there. Rows that
    are in it keep their exact coordinates. Rows that would have to be moved need ``geom_wkb``: a box
    alone cannot be brought to another system, so this fails, as it does for unknown systems.
    """
    if "srid" not in left.columns and "srid" not in right.columns:
        return left, right
    ours, theirs = srids(left, right)
    used = sorted({*ours, *theirs})
    if len(used) <= 1:
        return left, right
    unknown = [s for s in used if s not in SRIDS]
    if unknown:
        raise ValueError(f"SRID {unknown} cannot be aligned with {[s for s in used if s not in unknown]}")
    if not ours and "srid" not in left.columns:
        target = DEFAULT_SRID if DEFAULT_SRID in theirs else theirs[0]
    else:
        target = ours[0] if len(ours) == 1 else max(ours or theirs)

    def moved(df: DataFrame, found: list[int]) -> DataFrame:
        if all(s == target for s in found):
            return df
        if "geom_wkb" not in df.columns:
            raise ValueError(f"boxes in SRID {found} cannot be brought to {target} without geom_wkb")
        extra = [c for c in ("minx", "miny", "maxx", "maxy", "is_rect") if c not in df.columns]
        return transform_srid(df, target).drop(*extra)

    return moved(left, ours), moved(right, theirs)
