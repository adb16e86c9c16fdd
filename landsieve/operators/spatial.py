"""Spatial joins as equi-joins on grid cells.

Geometries live on a hierarchy of square grids, each four times coarser than the one below. A
left box belongs to the first level whose cells are at least its size, a right box to the first
level on which it spans at most ``SPAN`` cells, so either meets few cells whatever its size, a
street corner or a whole state. A pair is joined on the coarser of its two levels: the left row
asks one cell per level in use on the right (that of its lower left corner), the right rows are
entered into every cell from which such a left row could reach them. Each pair therefore meets
exactly once and no duplicates have to be removed.

The side of the finest cells comes from the layer: a quadtree histogram splits its extent until no
node holds many boxes (``quadtree``). Sides that state reference systems are brought into one first (``alignment``).

The right side is a layer. Its cells are counted first; within bounds they are broadcast and the
left rows never move, beyond that the cells are joined by a salted shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import st_distance, st_intersects
from ..schema import BOX_COLUMNS
from ..session import Scratch, lasting_scratch
from .alignment import align
from .best_first import least_of_equals, search
from .places import at_place, place_columns, places_of, written
from .quadtree import cell_of
from .skew import BROADCAST_BYTES, lookup_join, salted_join

LEVELS = 9  # level LEVELS is a single cell covering the whole plane
SPAN = 4.0  # cells a right box may span; more cells means more layer rows but fewer vain candidates
LIST_BYTES = 256 * 1024 * 1024  # bound of a layer broadcast as lists per cell
WORTH_A_PASS = 16 * 1024 * 1024  # cell rows beyond this are worth looking at the left side first
CELL_ROW_BYTES = 128  # generous size of one broadcast cell row without the texts of its payload
KEYS = ["_for", "_level", "_cx", "_cy"]


@dataclass(frozen=True)
class LayerSize:
    rows: int
    cells: int
    levels: tuple[int, ...]
    geometry_bytes: int
    row_bytes: int  # of the widest cell row


# Column formulas are built as text: one call each instead of dozens to the JVM.
HAS_BOX = " AND ".join(f"{c} IS NOT NULL" for c in BOX_COLUMNS)


def has_box() -> Column:
    return F.expr(HAS_BOX)


def _level(cell: float, span: float) -> str:
    side = "greatest(maxx - minx, maxy - miny)"
    # The margin keeps rounding in the side from hiding a box slightly larger than allowed.
    steps = " ".join(f"WHEN {side} <= {span * cell * 4.0**k * 0.999!r}D THEN {k}" for k in range(LEVELS))
    return f"CASE {steps} ELSE {LEVELS} END"


def _cell(value: str, level: str, cell: float) -> str:
    return f"CAST(floor({value} / ({float(cell)!r}D * power(4.0D, {level}))) AS BIGINT)"


def _first_cell(low: str, level: str, cell: float) -> str:
    """A left box reaching in may have its corner one cell before the box itself."""
    return f"({_cell(low, level, cell)} - 1)"


def levels_in_use(df: DataFrame, cell: float) -> tuple[int, ...]:
    """Grid levels of the left boxes, by one pass over their four coordinates."""
    return tuple(df.where(has_box()).agg(F.sort_array(F.collect_set(F.expr(_level(cell, 1.0)))).alias("levels")).first()["levels"])


def _asked_levels(own: str, asked: tuple[int, ...]) -> str:
    """Levels a layer row is entered on: its own and the coarser ones left rows may ask for."""
    return f"array_union(array({own}), filter(array({', '.join(map(str, asked))}), k -> k > {own}))"


ALL_LEVELS = tuple(range(LEVELS + 1))


def layer_cells(layer: DataFrame, cell: float, asked: tuple[int, ...] = ALL_LEVELS) -> DataFrame:
    """Layer rows repeated for each cell in which a left row may look for them."""

    def span(low: str, high: str) -> str:
        cells = f"sequence({_first_cell(low, '_level', cell)}, {_cell(high, '_level', cell)})"
        return f"explode(CASE WHEN _level = {LEVELS} THEN array(0L) ELSE {cells} END)"

    return (
        layer.where(HAS_BOX)
        .selectExpr("*", f"{_level(cell, SPAN)} AS _for")
        .selectExpr("*", f"explode({_asked_levels('_for', asked)}) AS _level")
        .selectExpr("*", f"{span('minx', 'maxx')} AS _cx")
        .selectExpr("*", f"{span('miny', 'maxy')} AS _cy")
    )


def probes(df: DataFrame, levels: tuple[int, ...] | int, cell: float) -> DataFrame:
    """Left rows with the one cell they ask for each right level; no geometry, no cell."""
    wanted = str(levels) if isinstance(levels, int) else f"explode(array({', '.join(map(str, levels))}))"

    def corner(low: str) -> str:
        return f"CASE WHEN _level = {LEVELS} THEN 0L ELSE {_cell(low, '_level', cell)} END"

    return (
        df.selectExpr("*", f"{wanted} AS _for")
        .selectExpr("*", f"greatest({_level(cell, 1.0)}, _for) AS _level")
        .selectExpr("*", f"{corner('minx')} AS _cx", f"{corner('miny')} AS _cy")
    )


def measure_layers(
    layers: list[DataFrame], cell: float, asked: tuple[int, ...] = ALL_LEVELS, payload: list[str] | None = None
) -> list[LayerSize]:
    """Rows, cell rows, grid levels, geometry volume and row width of each layer, in one job."""
    level = _level(cell, SPAN)
    across = f"{_cell('maxx', 'k', cell)} - {_first_cell('minx', 'k', cell)} + 1"
    up = f"{_cell('maxy', 'k', cell)} - {_first_cell('miny', 'k', cell)} + 1"
    at_level = f"CASE WHEN k = {LEVELS} THEN 1.0D ELSE CAST({across} AS DOUBLE) * ({up}) END"
    cells = F.expr(f"aggregate({_asked_levels(level, asked)}, 0.0D, (total, k) -> total + {at_level})")
    rows = []
    for i, layer in enumerate(layers):
        size = F.length("geom_wkb") if "geom_wkb" in layer.columns else F.lit(0)
        width = F.lit(CELL_ROW_BYTES)
        for c in payload or []:
            width = width + F.lit(16) + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
        rows.append(
            layer.where(HAS_BOX).agg(
                F.lit(i).alias("i"),
                F.count(F.lit(1)).alias("n"),
                F.coalesce(F.sum(cells), F.lit(0.0)).alias("cells"),
                F.sort_array(F.collect_set(F.expr(level))).alias("levels"),
                F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"),
                F.coalesce(F.max(width), F.lit(CELL_ROW_BYTES)).cast("long").alias("width"),
            )
        )
    found = sorted(reduce(DataFrame.unionByName, rows).collect())  # one row per layer
    return [LayerSize(r["n"], int(r["cells"]), tuple(r["levels"]), r["bytes"], r["width"]) for r in found]


def measure_layer(
    layer: DataFrame, cell: float, asked: tuple[int, ...] = ALL_LEVELS, payload: list[str] | None = None
) -> LayerSize:
    return measure_layers([layer], cell, asked, payload)[0]


def fit_levels(
    left: DataFrame, layer: DataFrame, cell: float, payload: list[str] | None = None
) -> tuple[LayerSize, tuple[int, ...]]:
    """Size of a layer and the levels it is entered on.

    A small layer is simply entered on all levels. For a larger one a pass over the left boxes
    pays off: it tells which levels are asked for, usually one or two.
    """
    size = measure_layer(layer, cell, payload=payload)
    if size.cells * size.row_bytes <= WORTH_A_PASS:
        return size, ALL_LEVELS
    asked = levels_in_use(left, cell)
    return measure_layer(layer, cell, asked, payload), asked


def boxes_overlap(prefix: str = "_r_", within: float = 0.0) -> Column:
    """Closed bounding box overlap, or a gap of at most ``within`` on each axis."""
    if within:
        axes = [f"minx - {prefix}maxx", f"{prefix}minx - maxx", f"miny - {prefix}maxy", f"{prefix}miny - maxy"]
        return F.expr(" AND ".join(f"{gap} <= {float(within)!r}D" for gap in axes))
    ends = [("minx", f"{prefix}maxx"), (f"{prefix}minx", "maxx"), ("miny", f"{prefix}maxy"), (f"{prefix}miny", "maxy")]
    return F.expr(" AND ".join(f"{low} <= {high}" for low, high in ends))


def _both_rect(left: DataFrame, right: DataFrame) -> Column:
    """Whether box overlap already decides a pair; frames without ``geom_wkb`` hold boxes only."""

    def rect(df: DataFrame, name: str) -> Column:
        if "geom_wkb" not in df.columns:
            return F.lit(True)
        return F.coalesce(F.col(name), F.lit(False)) if "is_rect" in df.columns else F.lit(False)

    return rect(left, "is_rect") & rect(right, "_r_is_rect")


def _check_shapes(left: DataFrame, right: DataFrame) -> bool:
    """True when both sides carry exact shapes; one-sided shapes cannot be tested."""
    sides = ["geom_wkb" in df.columns for df in (left, right)]
    if any(sides) and not all(sides):
        raise ValueError("both sides need geom_wkb, or neither")
    return all(sides)


def grow(layer: DataFrame, within: float) -> DataFrame:
    """Boxes widened by ``within``, the original ones kept as ``_o_...``; shapes are left out."""
    # Slightly more than asked for, so that rounding cannot lose a pair; an exact test follows.
    reach = {c: F.lit(within * 1.000001) + F.abs(F.col(c)) * F.lit(1e-12) for c in BOX_COLUMNS}
    original = layer.drop("geom_wkb").withColumns({f"_o_{c}": F.col(c) for c in BOX_COLUMNS})
    return original.withColumns(
        {c: F.col(c) - d if c.startswith("min") else F.col(c) + d for c, d in reach.items()}
    )


def candidate_pairs(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    payload: list[str],
    within: float = 0.0,
    cell: float = 1.0,
    max_bytes: int = BROADCAST_BYTES,
) -> tuple[DataFrame, LayerSize]:
    """Pairs whose boxes overlap (or lie within reach): left columns plus ``_r_``-prefixed ones.

    Returned with the size of the layer.

    Layer shapes are left out of the cells; ``with_shapes`` fetches them for surviving pairs.
    """
    carried = list(dict.fromkeys([right_id, *payload, *BOX_COLUMNS, *(["is_rect"] if "is_rect" in right.columns else [])]))
    if within:
        grown = grow(right, within)
        size, asked_levels = fit_levels(left, grown, cell, payload)
        cells = layer_cells(grown, cell, asked_levels)
        sources = [F.col(f"_o_{c}" if c in BOX_COLUMNS else c).alias(f"_r_{c}") for c in carried]
    else:
        size, asked_levels = fit_levels(left, right, cell, payload)
        cells = layer_cells(right, cell, asked_levels)
        sources = [F.col(c).alias(f"_r_{c}") for c in carried]
    cells = cells.select(*KEYS, *sources)
    asked = probes(left.where(has_box()), size.levels, cell) if size.levels else probes(left.limit(0), 0, cell)
    residual = boxes_overlap(within=within)

    if size.cells * size.row_bytes <= max_bytes:
        keyed = cells.withColumnsRenamed({k: f"_k{k}" for k in KEYS})
        match = reduce(Column.__and__, [F.col(k) == F.col(f"_k{k}") for k in KEYS])
        pairs = asked.join(F.broadcast(keyed), match & residual).drop(*[f"_k{k}" for k in KEYS])
    else:
        pairs = salted_join(asked, cells, KEYS, "inner", [left_id], residual)
    return pairs.drop(*KEYS), size


def with_shapes(
    pairs: DataFrame, right: DataFrame, left_id: str, right_id: str, size: LayerSize, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Attach the layer's exact shapes to candidate pairs as ``_r_geom_wkb``."""
    shapes = right.where(has_box()).select(F.col(right_id).alias(f"_r_{right_id}"), F.col("geom_wkb").alias("_r_geom_wkb"))
    if size.geometry_bytes + 64 * size.rows <= max_bytes:
        return pairs.join(F.broadcast(shapes), f"_r_{right_id}")
    return salted_join(pairs, shapes, [f"_r_{right_id}"], "inner", [left_id, f"_r_{right_id}"])


def spatial_join(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    payload: list[str],
    cell: float | None = None,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Inner join on intersection: left columns plus the payload of the layer as ``_r_<name>``.

    Left rows come back in the reference system that both sides were brought into. Without ``cell`` the side of the finest cells comes from the layer.
    """
    exact = _check_shapes(left, right)
    left, right = align(left, right)
    cell = cell or cell_of(right)
    pairs, size = candidate_pairs(left, right, left_id, right_id, payload, cell=cell, max_bytes=max_bytes)
    if exact:
        settled = _both_rect(left, right)
        pairs = with_shapes(pairs, right, left_id, right_id, size, max_bytes)
        # Settled pairs hand NULLs to the Arrow batch, so their shapes are never sent.
        test = st_intersects(F.when(~settled, F.col("geom_wkb")), F.when(~settled, F.col("_r_geom_wkb")))
        pairs = pairs.withColumn("_hit", test).where(settled | F.col("_hit")).drop("_hit", "_r_geom_wkb")
    return pairs.select(*left.columns, *[f"_r_{c}" for c in dict.fromkeys([right_id, *payload])])


def spatial_anti(
    left: DataFrame,
    right: DataFrame,
    left_id: str = "ogc_fid",
    right_id: str = "id",
    cell: float | None = None,
    max_bytes: int = BROADCAST_BYTES,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Left rows that intersect no row of the layer; rows without geometry are kept.

    With ``scratch`` the ids found by exact tests are written down first; as long as they are few
    they are then broadcast and no left row has to move. Kept rows come back in the reference system
    that both sides were brought into. Of equal shapes of the layer one is tested, and where left rows share
    their places, each place is tested once (``places``); these tables go to ``scratch``, or are dropped when the application ends.
    """
    exact = _check_shapes(left, right)
    left, right = align(left, right)
    if exact:
        scratch = scratch or lasting_scratch(left.sparkSession)
        right = scratch.materialize(least_of_equals(right, right_id, []), "layer")
        place = place_columns(left)
        places = places_of(written(left.where(has_box()).select(left_id, *place), scratch, "rows"), place, scratch)
        if places is not None:
            clear = _anti(places, right, "_place", right_id, cell, max_bytes, scratch, exact)
            hit = scratch.materialize(places.join(clear.select("_place"), "_place", "left_anti").drop("_place"), "hits")
            return at_place(left, hit, place, "left_anti", [left_id], max_bytes)
    return _anti(left, right, left_id, right_id, cell, max_bytes, scratch, exact)


def _anti(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, cell: float | None, max_bytes: int, scratch: Scratch | None, exact: bool
) -> DataFrame:
    cell = cell or cell_of(right)
    size, asked = fit_levels(left, right, cell)
    if not size.levels:
        return left
    kept = left
    broadcastable = size.cells * size.row_bytes <= max_bytes
    if broadcastable:
        # One map-side anti join per layer level settles every pair that boxes decide.
        flags = ["is_rect"] if "is_rect" in right.columns else []
        cells = layer_cells(right, cell, asked).select(
            *[F.col(k).alias(f"_k{k}") for k in KEYS], *[F.col(c).alias(f"_r_{c}") for c in [*BOX_COLUMNS, *flags]]
        )
        for level in size.levels:
            match = reduce(Column.__and__, [F.col(k) == F.col(f"_k{k}") for k in KEYS])
            condition = match & boxes_overlap() & _both_rect(left, right)
            step = F.broadcast(cells.where(F.col("_k_for") == level))
            kept = probes(kept, level, cell).join(step, condition, "left_anti").drop(*KEYS)
        if not exact:
            return kept
    narrow = kept.select(left_id, *BOX_COLUMNS, *[c for c in ("is_rect", "geom_wkb") if c in kept.columns])
    hits = spatial_join(narrow, right.drop("srid"), left_id, right_id, [], cell, max_bytes).select(left_id).distinct()
    if scratch is not None:
        hits = scratch.materialize(hits, "hits")
    return lookup_join(kept, hits, [left_id], "left_anti", [left_id], max_bytes)


def filter_airports(parcels: DataFrame, airports: DataFrame, id_col: str = "ogc_fid", **options) -> DataFrame:
    """Parcels that touch no airport ground."""
    ground = airports.where(F.col("feattype") == "Airport ground")
    return spatial_anti(parcels, ground, id_col, **options)


def attach_drive_time(
    parcels: DataFrame,
    isochrones: DataFrame | None,
    default: float = 9999.0,
    id_col: str = "ogc_fid",
    key: str = "parcelnumb",
    iso_id: str = "id",
    scratch: Scratch | None = None,
    **options,
) -> DataFrame:
    """Add ``drive_time``: the least time of any isochrone met by any parcel of the same number.

    Parcels without a number, or whose number meets no isochrone, get ``default``; so does every
    parcel when there is no isochrone layer. With ``scratch`` the times per number are written
    down first; their size is then known, and as long as it is small no parcel has to move.
    """
    parcels = parcels.drop("drive_time")
    if isochrones is None:
        return parcels.withColumn("drive_time", F.lit(float(default)))
    shape = [c for c in ("is_rect", "geom_wkb", "srid") if c in parcels.columns]
    # Layers read from files have texts in all columns; a time that is no number is none.
    isochrones = isochrones.withColumn("time", F.col("time").try_cast("double"))
    narrow = parcels.where(F.col(key).isNotNull()).select(id_col, key, *BOX_COLUMNS, *shape)
    met = spatial_join(narrow, isochrones, id_col, iso_id, ["time"], **options)
    best = met.groupBy(key).agg(F.min("_r_time").alias("drive_time"))
    if scratch is not None:
        best = scratch.materialize(best, "times")
    joined = lookup_join(parcels, best, [key], "left", [id_col])
    return joined.withColumn("drive_time", F.coalesce(F.col("drive_time"), F.lit(float(default))))


def _axis(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    return F.greatest(F.lit(0.0), other_low - high, low - other_high)


def box_gap(entry: Column | None = None) -> Column:
    """Distance between the left box and the layer box; an axis-aligned segment is a flat box."""
    r = (lambda n: F.col(f"_r_{n}")) if entry is None else (lambda n: entry[n])
    x = _axis(F.col("minx"), F.col("maxx"), r("minx"), r("maxx"))
    y = _axis(F.col("miny"), F.col("maxy"), r("miny"), r("maxy"))
    return F.sqrt(F.pow(x, F.lit(2.0)) + F.pow(y, F.lit(2.0)))


def box_reach(entry: Column) -> Column:
    """Largest distance between points of the two boxes; no pair of shapes inside is further apart."""
    x = F.greatest(entry["maxx"] - F.col("minx"), F.col("maxx") - entry["minx"])
    y = F.greatest(entry["maxy"] - F.col("miny"), F.col("maxy") - entry["miny"])
    return F.sqrt(F.pow(x, F.lit(2.0)) + F.pow(y, F.lit(2.0)))


def _rings(max_dist: float) -> list[float]:
    """A near ring settles most rows at little cost; only the others look further."""
    return [max_dist / 8.0, max_dist]


def _search_in_place(
    df: DataFrame, layer: DataFrame, rings: list[float], layer_id: str, payload: list[str], exact: bool, cell: float,
    max_bytes: int,
) -> DataFrame | None:
    """Add ``_found``: layer entries that may be nearest, without moving or repeating a row of ``df``.

    The layer is broadcast as one list of entries per cell, and each ring and level is one
    map-side join that rows already settled by a nearer ring pass by. Of boxes the nearest entry
    itself is kept, of shapes every entry that could still be nearest. None if too large.
    """
    flags = [c for c in ("is_rect",) if c in layer.columns]
    grown = [grow(layer, ring) for ring in rings]
    asked = levels_in_use(df, cell)
    sizes = measure_layers(grown, cell, asked, payload)
    if sum(z.cells * z.row_bytes for z in sizes) > max_bytes:
        return None
    originals = [F.col(f"_o_{c}").alias(c) for c in BOX_COLUMNS]
    entry = F.struct(F.col(layer_id).alias("id"), *originals, *map(F.col, dict.fromkeys([*payload, *flags])))
    ranked_type = F.array(F.struct(F.lit(0.0).alias("gap"), entry.alias("entry")))
    held = F.array().cast(grown[0].select(ranked_type.alias("e")).schema["e"].dataType)
    df = df.withColumn("_found", held)
    for ring, widened, size in zip(rings, grown, sizes):
        lists = layer_cells(widened, cell, asked).groupBy(*KEYS).agg(F.collect_list(entry).alias("_entries"))
        lists = lists.withColumnsRenamed({k: f"_k{k}" for k in KEYS})
        df = df.withColumn("_open", F.size("_found") == 0).withColumn("_ring", held)
        for level in size.levels:
            match = reduce(Column.__and__, [F.col(k) == F.col(f"_k{k}") for k in KEYS])
            step = F.broadcast(lists.where(F.col("_k_for") == level))
            df = probes(df, level, cell).join(step, match & F.col("_open"), "left")
            ranked = F.transform("_entries", lambda e: F.struct(box_gap(e).alias("gap"), e.alias("entry")))
            near = F.filter(ranked, lambda e: e["gap"] <= F.lit(float(ring)))
            if not exact:  # keep the nearest box only
                near = F.filter(F.array(F.array_min(near)), lambda e: e.isNotNull())
            merged = F.when(F.col("_entries").isNotNull(), F.concat("_ring", near)).otherwise(F.col("_ring"))
            df = df.withColumn("_ring", merged).drop("_entries", *KEYS, *[f"_k{k}" for k in KEYS])
        if exact:
            # A shape is no nearer than its box and no further than the far side of its box; a
            # ring settles a row when some shape is sure to lie within it.
            df = df.withColumn("_bound", F.array_min(F.transform("_ring", lambda e: box_reach(e["entry"]))))
            settled = F.lit(ring == rings[-1]) | (F.col("_bound") <= F.lit(float(ring)))
            kept = F.filter("_ring", lambda e: e["gap"] <= F.col("_bound"))
            df = df.withColumn("_ring", F.when(settled, kept).otherwise(held)).drop("_bound")
        else:
            best = F.filter(F.array(F.array_min("_ring")), lambda e: e.isNotNull())
            df = df.withColumn("_ring", best)
        df = df.withColumn("_found", F.when(F.col("_open"), F.col("_ring")).otherwise(F.col("_found"))).drop("_open", "_ring")
    return df


def nearest(
    parcels: DataFrame,
    layer: DataFrame,
    max_dist: float,
    payload: dict[str, str] | None = None,
    distance: str = "distance",
    id_col: str = "ogc_fid",
    layer_id: str = "id",
    cell: float | None = None,
    max_bytes: int = LIST_BYTES,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Nearest layer row within ``max_dist``: ``(id, layer id, distance, payload...)``, ties to the least id.

    ``payload`` maps layer columns to output names. Only parcels with a match are returned. A layer of up to ``max_bytes`` is
    broadcast; a larger one is searched from coarse cells to fine ones by shuffled joins (``best_first``), whose rounds are
    written to ``scratch``, or to tables that are dropped when the application ends. Of layer rows with one geometry the one with
    the least id takes part, and where parcels share their places, each place is searched once (``places``).
    """
    payload = payload or {}
    exact = _check_shapes(parcels, layer)
    parcels, layer = align(parcels, layer)
    scratch = scratch or lasting_scratch(parcels.sparkSession)
    layer = scratch.materialize(least_of_equals(layer, layer_id, list(payload)), "layer")
    place = place_columns(parcels)
    narrow = written(parcels.where(has_box()).select(id_col, *place), scratch, "rows")
    options = (layer, max_dist, payload, distance, layer_id, cell or cell_of(layer), max_bytes, scratch, exact)
    places = places_of(narrow, place, scratch)
    if places is None:
        return _nearest(narrow, id_col, *options)[0]
    found, once = _nearest(places, "_place", *options)
    names = [layer_id, distance, *payload.values()]
    near = found.select("_place", F.struct(distance, *[c for c in names if c != distance]).alias("_near"))
    near = scratch.materialize(places.join(near, "_place").drop("_place"), "near")
    rows = at_place(narrow, near, place, "inner", [id_col]).select(id_col, "_near")
    if once and not narrow.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        rows = rows.groupBy(id_col).agg(F.min("_near").alias("_near"))
    return rows.select(id_col, *[F.col("_near")[c].alias(c) for c in names])


def _nearest(
    narrow: DataFrame, id_col: str, layer: DataFrame, max_dist: float, payload: dict[str, str], distance: str, layer_id: str, cell: float,
    max_bytes: int, scratch: Scratch, exact: bool,
) -> tuple[DataFrame, bool]:
    """``nearest`` for the rows of a written table with boxes, and whether rows that share an id were made one."""
    limit = F.lit(float(max_dist))
    searched = _search_in_place(narrow, layer, _rings(max_dist), layer_id, list(payload), exact, cell, max_bytes)
    if searched is not None and not exact:
        hit = F.col("_found")[0]["entry"]
        chosen = [hit["id"].alias(layer_id), F.col("_found")[0]["gap"].alias(distance), *[hit[c].alias(o) for c, o in payload.items()]]
        return searched.where(F.size("_found") > 0).select(id_col, *chosen), False

    shape = [c for c in ("is_rect", "geom_wkb") if c in narrow.columns]
    if searched is not None:
        entries = searched.withColumn("_e", F.explode("_found")).select(*narrow.columns, F.col("_e.entry").alias("_e"))
    else:
        found = search(narrow, layer, max_dist, id_col, layer_id, list(payload), cell, scratch)
        entries = found.select(id_col, *BOX_COLUMNS, F.explode("_found").alias("_e"))
        if shape:
            entries = entries.join(narrow.select(id_col, *shape), id_col)
    carried = dict.fromkeys([*[c for c in payload if c != layer_id], *BOX_COLUMNS, *(["is_rect"] if "is_rect" in layer.columns else [])])
    pairs = entries.select(*narrow.columns, F.col("_e.id").alias(f"_r_{layer_id}"), *[F.col(f"_e.{c}").alias(f"_r_{c}") for c in carried])
    gap = box_gap()
    if exact:
        pairs = with_shapes(pairs, layer, id_col, layer_id, measure_layer(layer, cell), max_bytes)
        settled = _both_rect(narrow, layer)
        measured = st_distance(F.when(~settled, F.col("geom_wkb")), F.when(~settled, F.col("_r_geom_wkb")))
        pairs = pairs.withColumn("_exact", measured)
        gap = F.when(settled, gap).otherwise(F.col("_exact"))
    near = F.struct(
        gap.alias(distance), F.col(f"_r_{layer_id}").alias(layer_id), *[F.col(f"_r_{c}").alias(o) for c, o in payload.items()]
    )
    best = (
        pairs.withColumn("_near", near)
        .where(F.col(f"_near.{distance}") <= limit)
        .groupBy(id_col)
        .agg(F.min("_near").alias("_near"))
    )
    return best.select(id_col, *[F.col("_near")[c].alias(c) for c in (layer_id, distance, *payload.values())]), True


def nearest_in_rings(
    parcels: DataFrame, layer: DataFrame, rings: list[float], scratch: Scratch, id_col: str = "ogc_fid", **options
) -> DataFrame:
    """Nearest layer row by widening search: each ring only looks for parcels still unmatched."""
    found: DataFrame | None = None
    for ring in sorted(rings):
        open_ = parcels if found is None else parcels.join(found, id_col, "left_anti")
        step = scratch.materialize(nearest(open_, layer, ring, id_col=id_col, **options), "ring")
        found = step if found is None else found.unionByName(step)
    return found


def attach_nearest(parcels: DataFrame, found: DataFrame, drop: list[str] | None = None, id_col: str = "ogc_fid") -> DataFrame:
    """Join a ``nearest`` result back by row id, replacing columns of the same name."""
    found = found.drop(*(drop or []))
    clash = [c for c in found.columns if c in parcels.columns and c != id_col]
    return parcels.drop(*clash).join(found, id_col, "left")


def enrich_infrastructure(
    parcels: DataFrame,
    lines: DataFrame | None = None,
    roads: DataFrame | None = None,
    substations: DataFrame | None = None,
    max_dist: float = 10_000.0,
    id_col: str = "ogc_fid",
    **options,
) -> DataFrame:
    """Attach line distance, voltage and operator, road distance and substation operator."""
    searches = [
        (lines, {"kv": "et_kv", "operator": "et_operator"}, "et_distance", []),
        (roads, {}, "hwy_distance", []),
        (substations, {"operator": "est_operator"}, "_station_distance", ["_station_distance"]),
    ]
    for layer, payload, distance, extra in searches:
        if layer is not None:
            found = nearest(parcels, layer, max_dist, payload, distance, id_col, **options)
            parcels = attach_nearest(parcels, found, ["id", *extra], id_col)
    return parcels


def extent(df: DataFrame) -> DataFrame:
    """One row: the bounding box of a layer and its midpoint; NULLs when it has no geometry."""
    box = df.agg(
        F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy")
    )
    return box.withColumns({
        "center_x": (F.col("minx") + F.col("maxx")) / F.lit(2.0),
        "center_y": (F.col("miny") + F.col("maxy")) / F.lit(2.0),
    })
