"""Ranking statistics, exact quantiles and top lists."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import RANK

# Sketch accuracy for locating a quantile: the sketch is off by at most rows / accuracy ranks.
SKETCH_ACCURACY = 10_000
# Bins of a histogram, so values that any round gathers.
BINS = 1024


def exact_quantile(df: DataFrame, column: str, q: float = 0.5, accuracy: int = SKETCH_ACCURACY, bins: int = BINS) -> DataFrame:
    """Continuous quantile as one row ``(quantile)``: rounds of mergeable histograms, a pass over ``df`` each.

    A mergeable sketch with a guaranteed rank error brackets the quantile. Each round counts the values of the bracket in bins of one width,
    with the least and the most of each bin; a wanted rank that is the first or the last of its bin, or in a bin of one value, is
    found, otherwise its bin is the next bracket. No task ever gathers more than ``bins`` rows, however many values there
    are; since every round divides the bracket by ``bins``, one or two do unless values crowd together. NULL and NaN do not count.
    Jobs run at once; ``df`` should be a table rather than a long plan.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    margin = 4.0 / accuracy
    ends = [max(0.0, q - margin), min(1.0, q + margin)]
    seen = values.agg(F.percentile_approx("v", ends, accuracy).alias("ends"), F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    schema = "quantile double"
    if not seen["n"]:
        return df.sparkSession.createDataFrame([(None,)], schema)
    position = q * (seen["n"] - 1)
    # An end at the very start or end of the data is that of the data.
    bracket = (seen["ends"][0] if ends[0] > 0.0 else seen["low"], seen["ends"][1] if ends[1] < 1.0 else seen["high"])
    ranks = {math.floor(position), math.ceil(position)}
    found: dict[int, float] = {}
    while ranks - found.keys():
        wanted = min(ranks - found.keys())
        bracket = _narrowed(values, bracket, ranks, wanted, found, bins)
    below, above = found[math.floor(position)], found[math.ceil(position)]
    value = below if below == above else below + (above - below) * (position - math.floor(position))
    return df.sparkSession.createDataFrame([(value,)], schema)


def _narrowed(values: DataFrame, bracket: tuple[float, float], ranks: set[int], wanted: int, found: dict[int, float], bins: int) -> tuple[float, float]:
    """One round: ranks that a histogram of the bracket settles go to ``found``; the bin that holds ``wanted`` is returned."""
    low, high = (F.lit(float(x)) for x in bracket)
    # Halves, since the distance of two doubles may be beyond the largest one.
    share = (F.col("v") / 2 - low / 2) / (high / 2 - low / 2)
    inside = F.least(F.floor(share * bins), F.lit(bins - 1)) if bracket[0] < bracket[1] else F.lit(0)
    place = F.when(F.col("v") < low, -1).when(F.col("v") > high, bins).otherwise(inside).cast("long")
    rows = values.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect()
    before, next_bracket = 0, bracket
    for r in sorted(rows):
        for rank in ranks - found.keys():
            if before <= rank < before + r["n"]:
                if rank == before or r["least"] == r["most"]:
                    found[rank] = r["least"]
                elif rank == before + r["n"] - 1:
                    found[rank] = r["most"]
        if before <= wanted < before + r["n"]:
            next_bracket = (r["least"], r["most"])
        before += r["n"]
    return next_bracket


def ranking_stats(df: DataFrame, rank: str = RANK, approximate: bool = False) -> DataFrame:
    """One row: parcels, minimum, maximum, mean, median and sample standard deviation of the rank.

    The standard deviation of a single row is NULL. ``approximate`` takes the median from a
    sketch and saves the second pass.
    """
    basics = [
        F.count(F.lit(1)).alias("total_parcels"),
        F.min(rank).alias("min_score"),
        F.max(rank).alias("max_score"),
        F.avg(rank).alias("mean_score"),
    ]
    spread = F.stddev_samp(rank).alias("std_dev")
    if approximate:
        return df.agg(*basics, F.percentile_approx(rank, 0.5).alias("median_score"), spread)
    median = exact_quantile(df, rank).withColumnRenamed("quantile", "median_score")
    order = ["total_parcels", "min_score", "max_score", "mean_score", "median_score", "std_dev"]
    return df.agg(*basics, spread).join(F.broadcast(median)).select(*order)  # one row each


def top_n(df: DataFrame, n: int = 5, rank: str = RANK) -> DataFrame:
    """The ``n`` highest ranked parcels; ties go by parcel number, then row id."""
    shown = ["parcelnumb", rank, "zoning_type", "lbcs_site_desc"]
    ties = [c for c in ("parcelnumb", "ogc_fid") if c in df.columns]
    ordered = df.orderBy(F.col(rank).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties])
    return ordered.limit(n).select(*[c for c in ("ogc_fid", *shown) if c in df.columns])


def order_by_rank(df: DataFrame, rank: str = RANK) -> DataFrame:
    """Highest rank first, by a distributed range sort."""
    ties = [c for c in ("parcelnumb", "ogc_fid") if c in df.columns]
    return df.orderBy(F.col(rank).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties])
