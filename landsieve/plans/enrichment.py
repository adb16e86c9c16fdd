"""Enriching loaded parcels by the nearest line, road and substation, before or after they are written."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import transform_srid
from ..operators.places import at_place, places_of
from ..operators.spatial import HAS_BOX, nearest
from ..schema import BOX_COLUMNS
from ..session import Scratch
from ..sources.sinks import without_nulls

ROW = "_row"


@dataclass(frozen=True)
class Enrichment:
    """Which loaded layers hold lines, roads and substations; a layer that is not there enriches nothing.

    ``srid``: the system in whose units distances are measured; None measures in the coordinates as they are.
    ``attributes``: the layers' names for voltage and operator.
    """

    lines: str = "transmission_lines"
    roads: str = "roads"
    substations: str = "substations"
    max_dist: float = 10_000.0
    srid: int | None = 5070
    attributes: dict[str, str] = field(default_factory=lambda: {"kv": "kv", "operator": "operator"})

    def searches(self) -> list[tuple[str, dict[str, str], str]]:
        """Per layer its name, what it hands over as which column, and the column for the distance."""
        kv, operator = self.attributes["kv"], self.attributes["operator"]
        return [
            (self.lines, {kv: "et_kv", operator: "et_operator"}, "et_distance"),
            (self.roads, {}, "hwy_distance"),
            (self.substations, {operator: "est_operator"}, "_station_distance"),
        ]


def enrich(parcels: DataFrame, layers: dict[str, DataFrame], enrichment: Enrichment, scratch: Scratch) -> DataFrame:
    """Parcels with the columns of the nearest line, road and substation; values that the parcels already have stay.

    Parcels are written down with a number for each row, since their own ids may repeat or be missing. Only numbers and shapes take part in
    the searches; each result has at most one row for each number and is joined back by it. Parcels without a shape, or with
    nothing in reach, keep what they have.
    """
    present = [(layers[name], payload, distance) for name, payload, distance in enrichment.searches() if name in layers]
    if not present:
        return parcels
    columns = list(parcels.columns)
    filled, whole = without_nulls(parcels)
    numbered = whole(scratch.materialize(filled.withColumn(ROW, F.monotonically_increasing_id()), "numbered"))
    shape = [c for c in ("is_rect", "geom_wkb", "srid") if c in columns]

    def measured(df: DataFrame, keys: list[str]) -> DataFrame:
        kept = df.select(*keys, *BOX_COLUMNS, *[c for c in shape if c in df.columns])
        if enrichment.srid is None:  # all coordinates are taken to be of one system
            return kept.drop("srid")
        return transform_srid(kept, enrichment.srid) if "geom_wkb" in kept.columns else kept

    # Parcels that share their places are searched for once by place.
    stands = [*BOX_COLUMNS, *shape]
    shared = places_of(numbered.where(HAS_BOX), stands, scratch, ROW)
    places = scratch.materialize(measured(numbered.where(HAS_BOX) if shared is None else shared, [ROW]), "places")
    values = []
    for layer, payload, distance in present:
        handed = {c: to for c, to in payload.items() if c in layer.columns}
        entries = layer.withColumn("_id", F.monotonically_increasing_id()) if "id" not in layer.columns else layer.withColumn("_id", F.col("id"))
        entries = scratch.materialize(measured(entries.where(HAS_BOX), ["_id", *handed]), "layer")
        found = nearest(places, entries, enrichment.max_dist, {c: f"_n_{to}" for c, to in handed.items()}, f"_n_{distance}", ROW, "_id", scratch=scratch)
        found = scratch.materialize(found.drop("_id"), "nearest")
        if shared is None:
            numbered = numbered.join(found, ROW, "left")
        else:
            shared = shared.join(found, ROW, "left")
        values += [*handed.values(), distance]
    if shared is not None:
        numbered = at_place(numbered, scratch.materialize(shared.drop(ROW), "shared"), stands, "left", [ROW])
    for to in values:
        value = F.col(f"_n_{to}")
        if to in columns:
            value = F.coalesce(F.col(to), value.cast(parcels.schema[to].dataType))
        numbered = numbered.withColumn(to, value).drop(f"_n_{to}")
    return numbered.drop(ROW, "_station_distance")

