"""Nearest search over a layer of any size, as shuffled joins from coarse cells to fine ones.

The layer is a tree of cells, each holding 4 x 4 below it. An entry lies in the cell of its own
centre, on the level of its own size, so it is nowhere twice; a cell knows the box around all that is in it.
A parcel begins with the few coarse cells within its reach. Each round opens its cells: the nearest of
the furthest points of the boxes found bounds how far its nearest entry can be, and what lies beyond that bound is not
opened. The bound is carried from round to round; a parcel without cells to open leaves the search.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BOX_COLUMNS
from ..session import Scratch

HAS_BOX = " AND ".join(f"{c} IS NOT NULL" for c in BOX_COLUMNS)


def gap(entry: str) -> str:
    """Distance between a row's box and another box."""
    axis = "greatest(0.0D, {e}.min{a} - max{a}, min{a} - {e}.max{a})"
    return "sqrt(" + " + ".join(f"power({axis.format(e=entry, a=a)}, 2.0D)" for a in "xy") + ")"


def reach(entry: str) -> str:
    """Distance beyond which nothing of that box lies from the row's box."""
    axis = "greatest({e}.max{a} - min{a}, max{a} - {e}.min{a})"
    return "sqrt(" + " + ".join(f"power({axis.format(e=entry, a=a)}, 2.0D)" for a in "xy") + ")"


def size_level(cell: float, deepest: int) -> str:
    """First level whose cells are at least as large as the box."""
    side = "greatest(maxx - minx, maxy - miny)"
    steps = " ".join(f"WHEN {side} <= {cell * 4.0**k!r}D THEN {k}" for k in range(deepest))
    return f"CASE {steps} ELSE {deepest} END" if steps else "0"


def levels_for(cell: float, side: float) -> int:
    """Levels from cells of side ``cell`` to cells of at least ``side``."""
    level = 0
    while cell * 4.0**level < side and level < 60:
        level += 1
    return level


def least_of_equals(layer: DataFrame, layer_id: str, payload: list[str]) -> DataFrame:
    """Of rows with one and the same geometry the one with the least id: no other can be the nearest row that counts."""
    place = [*BOX_COLUMNS, *[c for c in ("is_rect", "geom_wkb") if c in layer.columns]]
    carried = [c for c in dict.fromkeys([layer_id, *payload]) if c not in place]
    best = layer.where(HAS_BOX).groupBy(*place).agg(F.min(F.struct(*carried)).alias("best"))
    return best.select(*place, "best.*")


def cell_tree(layer: DataFrame, entry: list[str], cell: float, largest: int, top: int) -> DataFrame:
    """level, cx, cy, children, entries: what each cell that is not empty holds, cells below it and entries of its own level.

    ``largest``: the highest level of an entry, ``top``: of a cell. Boxes around cells are minima and maxima, summed up in tasks first.
    """
    def at(value: str, level: str) -> str:
        return f"CAST(floor({value} / ({cell!r}D * power(4.0D, {level}))) AS BIGINT)"

    rows = layer.selectExpr("*", f"{size_level(cell, largest)} AS level")
    rows = rows.selectExpr("*", f"{at('((minx + maxx) / 2)', 'level')} AS cx", f"{at('((miny + maxy) / 2)', 'level')} AS cy")
    own = rows.groupBy("level", "cx", "cy").agg(F.collect_list(F.struct(*entry)).alias("entries"))
    above = rows.select("level", "cx", "cy", *BOX_COLUMNS, F.explode(F.sequence(F.col("level"), F.lit(top - 1))).alias("up"))
    shifted = [F.expr(f"shiftright({c}, 2 * (up - level))").alias(c) for c in ("cx", "cy")]
    boxes = above.select("up", *shifted, *BOX_COLUMNS).groupBy("up", "cx", "cy").agg(
        F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
    parents = boxes.groupBy((F.col("up") + 1).alias("level"), F.expr("shiftright(cx, 2)").alias("px"), F.expr("shiftright(cy, 2)").alias("py")).agg(
        F.collect_list(F.struct("cx", "cy", *BOX_COLUMNS)).alias("children"))
    parents = parents.select("level", F.col("px").alias("cx"), F.col("py").alias("cy"), "children")
    return parents.join(own, ["level", "cx", "cy"], "full_outer")


def search(
    rows: DataFrame, layer: DataFrame, max_dist: float, id_col: str, layer_id: str, payload: list[str], cell: float, scratch: Scratch,
) -> DataFrame:
    """id, box, _bound, _seen, _found for each row with entries in reach: all entries that may be its nearest, and how many were looked at.

    ``rows`` have boxes and unique ids, ``layer`` has no geometry twice (``least_of_equals``); both are read several times. An entry is a struct of ``id``, its box, ``payload`` and, if there, ``is_rect``.
    """
    flags = [c for c in ("is_rect",) if c in layer.columns]
    payload = [c for c in dict.fromkeys(payload) if c != layer_id]
    layer = layer.where(HAS_BOX).drop("geom_wkb").withColumnRenamed(layer_id, "_layer_id")
    side = layer.agg(F.max(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")))).first()[0]
    largest = levels_for(cell, side or 0.0)
    # A level above both the reach and the largest entry: a row then begins with few cells, whatever its place.
    least = max(largest, levels_for(cell, 2.0 * max_dist)) + 1
    span = rows.where(HAS_BOX).agg(F.max(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")))).first()[0]
    top = max(least, levels_for(cell, span or 0.0) + 1)
    entry = [F.col("_layer_id").alias("id"), *map(F.col, [*BOX_COLUMNS, *payload, *flags])]
    tree = scratch.materialize(cell_tree(layer, entry, cell, largest, top), "cells")
    kinds = {f.name: f.dataType for f in tree.schema.fields}
    start = f"greatest({least}, {size_level(cell, top - 1)} + 1)"
    margin = max_dist * 1.000001 + cell * 4.0**largest / 2
    waiting = rows.where(HAS_BOX).select(F.col(id_col).alias("_id"), *BOX_COLUMNS, F.expr(start).alias("_start"))
    none = {"_children": F.lit(None).cast(kinds["children"]), "_entries": F.lit(None).cast(kinds["entries"])}
    state, done = None, []
    for level in range(top, -1, -1):
        side = cell * 4.0**level
        across = [f"sequence(CAST(floor((min{a} - {margin!r}D) / {side!r}D) AS BIGINT), CAST(floor((max{a} + {margin!r}D) / {side!r}D) AS BIGINT))" for a in "xy"]
        opened = None
        if level >= least:
            begun = waiting.where(F.col("_start") == level).select("_id", *BOX_COLUMNS, F.lit(float(max_dist)).alias("_bound"), F.expr(f"explode({across[0]})").alias("cx"), F.expr(across[1]).alias("cy"))
            opened = begun.withColumn("cy", F.explode("cy"))
        if state is not None:
            going = state.select("_id", *BOX_COLUMNS, "_bound", F.explode("_frontier").alias("f")).select("_id", *BOX_COLUMNS, "_bound", F.col("f.cx").alias("cx"), F.col("f.cy").alias("cy"))
            opened = going if opened is None else opened.unionByName(going)
        here = tree.where(F.col("level") == level).drop("level")
        hits = opened.join(here, ["cx", "cy"])
        nearest = " , ".join(f"coalesce(array_min(transform({c}, e -> {reach('e')})), CAST('Infinity' AS DOUBLE))" for c in ("children", "entries"))
        hits = hits.withColumn("_seen", F.expr("CAST(greatest(size(children), 0) + greatest(size(entries), 0) AS BIGINT)")).withColumn("_bound", F.expr(f"least(_bound, {nearest})"))
        hits = hits.select("_id", *BOX_COLUMNS, "_bound", "_seen", F.expr(f"filter(children, e -> {gap('e')} <= _bound)").alias("_children"), F.expr(f"filter(entries, e -> {gap('e')} <= _bound)").alias("_entries"))
        if state is not None:  # what was found before goes along once
            hits = hits.unionByName(state.select("_id", *BOX_COLUMNS, "_bound", "_seen", none["_children"].alias("_children"), F.col("_found").alias("_entries")))
        merged = hits.groupBy("_id").agg(
            *[F.first(c).alias(c) for c in BOX_COLUMNS], F.min("_bound").alias("_bound"), F.sum("_seen").alias("_seen"),
            F.flatten(F.collect_list("_children")).alias("_children"), F.flatten(F.collect_list("_entries")).alias("_entries"))
        merged = merged.select(
            "_id", *BOX_COLUMNS, "_bound", "_seen", F.expr(f"transform(filter(_children, e -> {gap('e')} <= _bound), e -> struct(e.cx, e.cy))").alias("_frontier"),
            F.expr(f"filter(_entries, e -> {gap('e')} <= _bound)").alias("_found"))
        merged = scratch.materialize(merged, "round")
        finished: Column = F.size("_frontier") == 0
        done.append(merged.where(finished & (F.size("_found") > 0)))
        state = merged.where(~finished)
    found = reduce(DataFrame.unionByName, done)
    return found.drop("_frontier").withColumnRenamed("_id", id_col)
