"""Scalar column expressions. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank bands as (lower bound inclusive, upper bound exclusive, label).
RANK_BANDS = [
    (0, 2, "Rank 0-2"),
    (2, 4, "Rank 2-4"),
    (4, 6, "Rank 4-6"),
    (6, 8, "Rank 6-8"),
    (8, 11, "Rank 8-10"),
]
# Fixed value: bands from this lower bound on are shown by default.
VISIBLE_FROM = 6

# Colour stops as (rank, red, green, blue), linear in between.
COLOR_STOPS = [(1.0, 255, 0, 0), (5.5, 255, 255, 0), (10.0, 0, 128, 0)]


def sanitize_name(name: Column | str) -> Column:
    """Provider name as a lower-case identifier usable in paths and partition values."""
    raw = F.col(name) if isinstance(name, str) else name
    cleaned = F.regexp_replace(F.replace(F.lower(raw), F.lit(" "), F.lit("_")), "[^a-z0-9_]", "")
    return (
        F.when(raw.isNull() | (raw == ""), F.lit("all_providers"))
        .when(cleaned == "", F.lit("unknown_provider"))
        .when(cleaned.rlike("^[0-9]"), F.concat(F.lit("provider_"), cleaned))
        .otherwise(cleaned)
    )


def _ref(name: str) -> str:
    return "`%s`" % name.replace("`", "``")


def is_flagged(name: str) -> Column:
    """Spreadsheet flag: TRUE in any case and padding, or the number one."""
    text = F.upper(F.trim(F.col(_ref(name)).cast("string")))
    return F.coalesce((text == "TRUE") | (try_double(name) == 1.0), F.lit(False))


def try_double(name: str) -> Column:
    """Text to double; NULL where the text is not a number."""
    return F.expr(f"try_cast({_ref(name)} AS DOUBLE)")


def building_coverage(building: str, lot: str) -> Column:
    """Open share of the lot on 0-10; unknown or zero lot scores 5, unknown building scores 0."""
    lot_col = F.col(lot)
    open_share = F.lit(10.0) - F.try_divide(F.col(building), lot_col) * F.lit(10.0)
    clamped = F.least(F.lit(10.0), F.greatest(F.lit(0.0), open_share))
    return F.when((lot_col == 0) | lot_col.isNull(), F.lit(5.0)).otherwise(clamped)


def rank_band(rank: str) -> Column:
    """Label of the band holding the rank, NULL outside all bands."""
    value = F.col(rank)
    result = F.lit(None).cast("string")
    for low, high, label in reversed(RANK_BANDS):
        result = F.when((value >= low) & (value < high), F.lit(label)).otherwise(result)
    return result


def band_is_visible(rank: str) -> Column:
    """Whether the band holding the rank is shown by default."""
    top = RANK_BANDS[-1][1]
    return F.coalesce((F.col(rank) >= VISIBLE_FROM) & (F.col(rank) < top), F.lit(False))


def rank_color(rank: str) -> Column:
    """Red-yellow-green colour of the rank as ``#rrggbbaa``, clamped to the outer stops."""
    value = F.least(F.greatest(F.col(rank), F.lit(COLOR_STOPS[0][0])), F.lit(COLOR_STOPS[-1][0]))
    channels = []
    for channel in (1, 2, 3):
        level = F.lit(COLOR_STOPS[-1][channel] / 255.0)
        for low, high in reversed(list(zip(COLOR_STOPS, COLOR_STOPS[1:]))):
            share = (value - F.lit(low[0])) / F.lit(high[0] - low[0])
            mixed = (F.lit(1.0) - share) * F.lit(low[channel] / 255.0) + share * F.lit(high[channel] / 255.0)
            level = F.when(value < high[0], mixed).otherwise(level)
        byte = F.floor(level * F.lit(255.9999)).cast("long")
        channels.append(F.lpad(F.lower(F.hex(byte)), 2, "0"))
    return F.when(F.col(rank).isNotNull(), F.concat(F.lit("#"), *channels, F.lit("ff")))
