"""The end-to-end selection: screen parcels, attach drive times, rank, report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import transform_srid
from ..operators import filters
from ..operators.scoring import DEFAULT_PREFERENCES, rank_mcda, rank_mco
from ..operators.spatial import attach_drive_time, filter_airports
from ..schema import DEFAULT_EXCLUSIONS
from ..session import Scratch


@dataclass
class Settings:
    """Choices of one run; ``None`` skips the screening step."""

    state: str | None = None
    county: str | None = None
    provider: str | None = None
    min_size: float = 50.0
    exclusions: list[str] | DataFrame = field(default_factory=lambda: list(DEFAULT_EXCLUSIONS))
    transmission_distance: float = 100.0
    min_kv: float | None = None
    roadway_distance: float | None = None
    method: str = "MCDA"
    weights: dict[str, float] | None = None
    preferences: dict[str, str] | None = None
    single_size_flip: bool = False
    drive_default: float = 9999.0
    min_survivors: int | None = None
    srid: int | None = None
    cell: float | None = None  # side of the finest grid cells; from the layers where unset
    id_col: str = "ogc_fid"

    @property
    def params(self) -> dict:
        if self.method.upper() == "MCDA":
            return dict(self.weights or {})
        return {**DEFAULT_PREFERENCES, **(self.preferences or {})}


def aligned(layer: DataFrame | None, settings: Settings) -> DataFrame | None:
    """The layer in the SRID stated for the run; without one the spatial operators align both sides by their rows."""
    if layer is None or settings.srid is None or "geom_wkb" not in layer.columns:
        return layer
    return transform_srid(layer, settings.srid)


def in_area(parcels: DataFrame, settings: Settings) -> DataFrame:
    """Partition-pruned parcels of the state and county; no county means the whole state."""
    if settings.state is not None:
        parcels = parcels.where(F.col("state") == settings.state)
    if settings.county is not None:
        parcels = parcels.where(F.col("county") == settings.county)
    return parcels


def stages(
    airports: DataFrame | None, settings: Settings, columns: list[str], scratch: Scratch | None = None
) -> list[tuple]:
    """Screening steps in reporting order, for ``funnel``."""
    listed: list[tuple[str, Column | object]] = [("min_size", filters.min_size(settings.min_size))]
    if isinstance(settings.exclusions, DataFrame):
        listed.append(("exclusions", lambda df: filters.filter_exclusions(df, settings.exclusions, settings.id_col)))
    else:
        unwanted = settings.exclusions
        allowed = filters.not_excluded("usedesc", unwanted) & filters.not_excluded("lbcs_ownership_desc", unwanted)
        listed.append(("exclusions", allowed))
    if airports is not None:
        options = {"cell": settings.cell, "scratch": scratch}
        listed.append(("airports", lambda df: filter_airports(df, airports, settings.id_col, **options)))
    listed.append(("transmission", filters.max_transmission(settings.transmission_distance)))
    if settings.min_kv is not None and "et_kv" in columns:
        listed.append(("min_kv", filters.min_kv(settings.min_kv)))
    if settings.roadway_distance is not None and "hwy_distance" in columns:
        listed.append(("roadway", filters.max_roadway(settings.roadway_distance)))
    if settings.provider is not None:
        listed.append(("provider", filters.served_by(settings.provider)))
    return listed


def screening_funnel(
    parcels: DataFrame, airports: DataFrame | None, settings: Settings, scratch: Scratch | None = None
) -> DataFrame:
    """Rows left after each screening step."""
    chosen = in_area(parcels, settings)
    return filters.funnel(chosen, stages(aligned(airports, settings), settings, chosen.columns, scratch))


def screen(
    parcels: DataFrame, airports: DataFrame | None, settings: Settings, scratch: Scratch | None = None
) -> DataFrame:
    """Parcels that pass every step.

    All steps are conjunctive, so the predicates go first and reach the scan; the spatial step
    then sees only the rows they leave. With ``min_survivors`` the steps run in reporting order,
    each followed by a check that reads just enough rows.
    """
    chosen = in_area(parcels, settings)
    steps = stages(aligned(airports, settings), settings, chosen.columns, scratch)
    if settings.min_survivors is not None:
        for name, step in steps:
            chosen = chosen.where(step) if isinstance(step, Column) else step(chosen)
            filters.require_more_than(chosen, settings.min_survivors, name)
        return chosen
    for _, step in steps:
        if isinstance(step, Column):
            chosen = chosen.where(step)
    for _, step in steps:
        if not isinstance(step, Column):
            chosen = step(chosen)
    return chosen


def rank(df: DataFrame, lookups: tuple[DataFrame, DataFrame, DataFrame], settings: Settings) -> DataFrame:
    """Rank by the chosen method."""
    if settings.method.upper() == "MCDA":
        return rank_mcda(df, lookups, settings.params, id_col=settings.id_col)
    return rank_mco(df, lookups, settings.params, settings.single_size_flip, id_col=settings.id_col)


def with_drive_times(
    parcels: DataFrame, airports: DataFrame | None, isochrones: DataFrame | None, settings: Settings, scratch: Scratch
) -> DataFrame:
    """Screened parcels with drive times, as a written table.

    Drive times and both ranking passes read the survivors several times; writing them down once
    keeps the full table to a single scan.
    """
    survivors = scratch.materialize(screen(parcels, airports, settings, scratch), "survivors")
    if isochrones is None:
        return attach_drive_time(survivors, None, settings.drive_default)
    timed = attach_drive_time(
        survivors, aligned(isochrones, settings), settings.drive_default, settings.id_col, scratch=scratch,
        cell=settings.cell,
    )
    return scratch.materialize(timed, "timed")


def site_selection(
    parcels: DataFrame,
    lookups: tuple[DataFrame, DataFrame, DataFrame],
    settings: Settings,
    scratch: Scratch,
    airports: DataFrame | None = None,
    isochrones: DataFrame | None = None,
) -> DataFrame:
    """Screen, attach drive times and rank; empty when nothing survives.

    The result reads tables of ``scratch``; write it out before closing that.
    """
    return rank(with_drive_times(parcels, airports, isochrones, settings, scratch), lookups, settings)
