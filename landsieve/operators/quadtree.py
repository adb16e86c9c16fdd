"""Cell sizes from the data: a quadtree histogram of where boxes lie.

Every box counts in the node that holds its centre, on every second depth of a quadtree over the
layer's own extent. Counts of nodes add up, so they are summed in tasks first, and a parent's are its
children's. Nodes are split until none holds more than a bound, which gives the side of the finest
cells; whatever the unit of the coordinates, a cell then holds few boxes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BOX_COLUMNS

#: Boxes that a leaf may hold before it is split.
LEAF = 32
#: Splits into 4 x 4 at most; a leaf of that depth holds more only where boxes are stacked.
DEEPEST = 9


@dataclass(frozen=True)
class Quadtree:
    """``side`` of the root; ``most``: boxes in the fullest node after 0, 1, ... splits into 4 x 4."""

    side: float
    rows: int
    most: tuple[int, ...]

    def splits(self, leaf: int = LEAF) -> int:
        """How often nodes are split until every one holds at most ``leaf`` boxes, or cannot be split further."""
        return next((k for k, n in enumerate(self.most) if n <= leaf), max(len(self.most) - 1, 0))

    def cell(self, leaf: int = LEAF) -> float:
        """Side of the finest cells."""
        return self.side / 4.0 ** self.splits(leaf)


def histogram(layer: DataFrame, deepest: int = DEEPEST) -> Quadtree:
    """The quadtree histogram of a layer's boxes; rows without a box do not count."""
    boxes = layer.where(" AND ".join(f"{c} IS NOT NULL" for c in BOX_COLUMNS)).select(*BOX_COLUMNS)
    ends = boxes.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"), F.count("*").alias("n")).first()
    if not ends["n"]:
        return Quadtree(1.0, 0, (0,))
    side = max(ends["maxx"] - ends["minx"], ends["maxy"] - ends["miny"])
    if not 0.0 < side < float("inf"):  # all in one point
        return Quadtree(1.0, ends["n"], (ends["n"],))
    finest = 4**deepest

    def place(low: str, high: str) -> str:
        return f"least(CAST(floor((({low} + {high}) / 2 - {ends[low]!r}D) / {side!r}D * {finest}) AS BIGINT), {finest - 1}L)"

    finest_cells = boxes.groupBy(F.expr(place("minx", "maxx")).alias("x"), F.expr(place("miny", "maxy")).alias("y")).agg(F.count("*").alias("n"))
    nodes = finest_cells.select(F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("splits"), "x", "y", "n")
    nodes = nodes.groupBy("splits", F.expr(f"shiftright(x, 2 * ({deepest} - splits))").alias("x"), F.expr(f"shiftright(y, 2 * ({deepest} - splits))").alias("y")).agg(F.sum("n").alias("n"))
    most = nodes.groupBy("splits").agg(F.max("n").alias("most")).orderBy("splits").collect()  # a row for each depth
    return Quadtree(side, ends["n"], tuple(r["most"] for r in most))


def cell_of(layer: DataFrame, leaf: int = LEAF) -> float:
    return histogram(layer).cell(leaf)
