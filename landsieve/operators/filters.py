"""Attribute screening. Every filter is a plain predicate, so it reaches the Parquet scan."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import try_double
from .skew import lookup_join


class TooFewParcels(ValueError):
    """A screening step left no more parcels than the required minimum."""


def min_size(acres: float = 50.0) -> Column:
    return F.col("gisacre") > F.lit(float(acres))


def not_excluded(column: str, values: Iterable[str]) -> Column:
    """True where the column is NULL or not one of ``values``; NULL entries are ignored."""
    known = sorted({v for v in values if v is not None})
    if not known:
        return F.lit(True)
    return F.col(column).isNull() | ~F.col(column).isin(known)


def max_transmission(distance: float = 100.0) -> Column:
    return F.col("et_distance") <= F.lit(float(distance))


def min_kv(kv: float) -> Column:
    """Voltage text at or above ``kv``; blank, NULL and malformed texts fail."""
    return F.coalesce(try_double("et_kv") >= F.lit(float(kv)), F.lit(False))


def max_roadway(distance: float) -> Column:
    return F.col("hwy_distance") <= F.lit(float(distance))


def served_by(provider: str) -> Column:
    return (F.col("et_operator") == F.lit(provider)) | (F.col("est_operator") == F.lit(provider))


def filter_min_size(df: DataFrame, acres: float = 50.0) -> DataFrame:
    return df.where(min_size(acres))


def filter_exclusions(df: DataFrame, values: Iterable[str] | DataFrame, id_col: str = "ogc_fid") -> DataFrame:
    """Drop parcels whose use or ownership is on the merged exclusion list.

    A Python list becomes a pushed-down predicate. A one-column DataFrame becomes two anti joins,
    which keep NULL uses and owners just as the predicate does.
    """
    if not isinstance(values, DataFrame):
        values = list(values)
        return df.where(not_excluded("usedesc", values) & not_excluded("lbcs_ownership_desc", values))
    name = values.columns[0]
    unwanted = values.where(F.col(name).isNotNull()).distinct()
    for column in ("usedesc", "lbcs_ownership_desc"):
        df = lookup_join(df, unwanted.withColumnRenamed(name, column), [column], "left_anti", [id_col])
    return df


def filter_transmission(df: DataFrame, distance: float = 100.0) -> DataFrame:
    return df.where(max_transmission(distance))


def filter_min_kv(df: DataFrame, kv: float | None = None) -> DataFrame:
    """No-op without a limit or without the voltage column."""
    return df if kv is None or "et_kv" not in df.columns else df.where(min_kv(kv))


def filter_roadway(df: DataFrame, distance: float | None = None) -> DataFrame:
    """No-op without a limit or without the roadway column."""
    if distance is None or "hwy_distance" not in df.columns:
        return df
    return df.where(max_roadway(distance))


def filter_provider(df: DataFrame, provider: str | None = None) -> DataFrame:
    return df if provider is None else df.where(served_by(provider))


def crop_points(df: DataFrame, bounds: tuple[float, float, float, float], x: str = "x", y: str = "y") -> DataFrame:
    """Points strictly inside the envelope; the border itself is outside."""
    minx, miny, maxx, maxy = (float(b) for b in bounds)
    return df.where((F.col(x) > minx) & (F.col(x) < maxx) & (F.col(y) > miny) & (F.col(y) < maxy))


def require_more_than(df: DataFrame, minimum: int | None, step: str) -> DataFrame:
    """Raise unless more than ``minimum`` rows survive; reads only as many rows as it needs."""
    if minimum is not None and df.limit(minimum + 1).count() <= minimum:
        raise TooFewParcels(f"{step}: {minimum} or fewer parcels left")
    return df


def funnel(
    df: DataFrame, stages: list[tuple[str, Column | Callable[[DataFrame], DataFrame]]]
) -> DataFrame:
    """Rows left after each stage, as ``(step, stage, n)``; stages apply in the given order.

    Predicate stages that follow one another are counted in a single pass as conditional sums.
    A callable stage (such as a spatial anti join) starts a new pass over the rows left so far.
    """
    passes: list[DataFrame] = []
    step = 0

    def count_pass(source: DataFrame, names: list[str], conditions: list[Column]) -> DataFrame:
        first = step - len(names) + 1
        sums, seen = [], F.lit(True)
        for i, condition in enumerate(conditions):
            seen = seen & F.coalesce(condition, F.lit(False))
            sums.append(F.coalesce(F.sum(F.when(seen, 1).otherwise(0)), F.lit(0)).cast("long").alias(f"n{i}"))
        row = source.agg(*sums)
        entries = F.array(
            *[
                F.struct(F.lit(first + i).alias("step"), F.lit(n).alias("stage"), F.col(f"n{i}").alias("n"))
                for i, n in enumerate(names)
            ]
        )
        return row.select(F.inline(entries))

    names, conditions, current = ["all"], [F.lit(True)], df
    for name, stage in stages:
        if isinstance(stage, Column):
            step += 1
            names.append(name)
            conditions.append(stage)
            continue
        passes.append(count_pass(current, names, conditions))
        current = stage(current.where(reduce(Column.__and__, conditions)))
        step += 1
        names, conditions = [name], [F.lit(True)]
    passes.append(count_pass(current, names, conditions))
    return reduce(DataFrame.unionByName, passes)
