"""Rows that share their geometry: spatial work is done once for each place and joined back.

A place is a box with its shape, if there is one. Where many rows stand at one place, pairs with a layer
grow with the rows at both ends; by places they grow with the different geometries alone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BOX_COLUMNS
from ..session import Scratch, spread_small
from .skew import BROADCAST_BYTES, is_small, salted_join

#: Rows that must share a place, on average, before it is worth joining them back.
STACKED = 2


def place_columns(df: DataFrame) -> list[str]:
    return [*BOX_COLUMNS, *[c for c in ("is_rect", "geom_wkb") if c in df.columns]]


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` only reads files, by columns and predicates."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return all(re.match(r"[\s:+-]*(Project|Filter|Relation)\b", line) for line in lines)


def written(df: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``df`` as a written table, as it will be read several times; files that it merely reads are not copied."""
    return df if is_scan(df) else scratch.materialize(df, name)


def places_of(rows: DataFrame, place: list[str], scratch: Scratch, number: str = "_place") -> DataFrame | None:
    """The different places of ``rows`` with a number each, as a written table; None where they are not much fewer than the rows.

    That is told by an estimate of their number, which decides about the work alone. Few places are spread over all cores when they are read.
    """
    seen = rows.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.xxhash64(*place)).alias("places")).first()
    if seen["rows"] < STACKED * seen["places"] or not seen["rows"]:
        return None
    return spread_small(scratch.materialize(rows.select(*place).distinct().withColumn(number, F.monotonically_increasing_id()), "places"))


def at_place(df: DataFrame, found: DataFrame, place: list[str], how: str, salt_by: list[str], max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join ``found``, a written table of one row for each of its places, to the rows that stand there.

    Within ``max_bytes`` it is broadcast. Columns of a struct that are NULL on both sides are equal, as they are for ``distinct``.
    """
    small = is_small(found, max_bytes)
    found = found.select(F.struct(*place).alias("_at"), *[c for c in found.columns if c not in place])
    df = df.withColumn("_at", F.struct(*place))
    joined = df.join(F.broadcast(found), "_at", how) if small else salted_join(df, found, ["_at"], how, salt_by)
    return joined.drop("_at")
