"""Joins that hold up when one key carries a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest side that is ever broadcast with a hint.
BROADCAST_BYTES = 64 * 1024 * 1024
# Below this planned size even strong compression cannot hide a large table.
TINY_BYTES = 512 * 1024
# A key is hot when it holds more than this share of all rows, so at most 1 / HOT_SHARE keys
# are hot whatever the data looks like: that is the size bound of the hot-key broadcast.
HOT_SHARE = 0.001
# Items that the frequent-items summary tracks; it misses no key of more than about 3.5 / TRACKED of the rows.
TRACKED = 8192
# A hot key gets so many salts that each holds at most 1 / SLICES of all rows.
SLICES = 400


def planned_bytes(df: DataFrame) -> int:
    """Size the optimizer expects for ``df``; runs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows themselves: fixed slots per column plus the length of texts and binaries."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    lengths = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)).cast("long") for c in texts]
    row = F.lit(32 + 16 * len(df.columns)).cast("long")
    for length in lengths:
        row = row + length
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def is_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is known to fit a broadcast.

    The planned size rules out what is too large without a job. It is a guess for compressed files,
    so anything but a tiny table is then measured.
    """
    planned = planned_bytes(df)
    if planned > max_bytes:
        return False
    return planned <= TINY_BYTES or measured_bytes(df) <= max_bytes


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """``(_hot, _salts)``: hashes of the keys holding more than ``share`` of the keyed rows (at most ``1 / share`` rows).

    One pass: a mergeable frequent-items summary (Misra-Gries) of bounded size per task, merged into one. Nothing is shuffled by key.
    Salts are in proportion to a key's share.
    """
    keyed = df.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])).select(F.xxhash64(*keys).alias("item"))
    summary = keyed.agg(F.expr(f"approx_top_k(item, {int(1 / share)}, {TRACKED})").alias("found"), F.count(F.lit(1)).alias("total"))
    found = summary.select(F.explode("found").alias("f"), "total").where(F.col("f.count") > F.col("total") * F.lit(share))
    return found.select(F.col("f.item").alias("_hot"), F.ceil(F.col("f.count") / F.col("total") * F.lit(SLICES)).cast("int").alias("_salts"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    salt_by: list[str],
    residual: Column | None = None,
    slices: int = SLICES,
) -> DataFrame:
    """Equi-join (inner, left or left_anti) with hot left keys spread over as many reducers as their share asks for.

    Rows with a NULL key match nothing, so they are spread as well. The right rows of a hot key
    are repeated once per salt. ``salt_by`` should identify a left row; a hash of it keeps the
    salt the same when a task is run again. Keys are told hot by a hash on both sides, so keys that share one are salted alike.
    """
    hot = hot_keys(left, on)
    kinds = {k: left.schema[k].dataType for k in on}

    def mark(df: DataFrame) -> DataFrame:
        item = F.xxhash64(*[F.col(k).cast(kinds[k]) for k in on])
        return df.withColumn("_item", item).join(F.broadcast(hot), F.col("_item") == F.col("_hot"), "left").drop("_item", "_hot")

    has_null = reduce(Column.__or__, [F.col(k).isNull() for k in on])
    salts = F.coalesce(F.when(has_null, F.lit(slices)), "_salts", F.lit(1))
    spread = mark(left).withColumn("_salt", F.pmod(F.xxhash64(*salt_by), salts).cast("int")).drop("_salts")

    copies = mark(right).withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - F.lit(1)))).drop("_salts")
    copies = copies.withColumnsRenamed({k: f"_r_{k}" for k in on})

    condition = reduce(
        Column.__and__,
        [F.col(k) == F.col(f"_r_{k}") for k in on] + [F.col("_salt") == F.col("_salt_r")],
    )
    if residual is not None:
        condition = condition & residual
    return spread.join(copies, condition, how).drop("_salt", "_salt_r", *[f"_r_{k}" for k in on])


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    salt_by: list[str],
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join a reference table: broadcast when its size is known to be within bounds, salted otherwise."""
    if is_small(right, max_bytes):
        return left.join(F.broadcast(right), on, how)
    return salted_join(left, right, on, how, salt_by)
