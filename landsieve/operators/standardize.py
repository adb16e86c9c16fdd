"""Bringing source columns onto the standard parcel schema, and reporting the differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import COLUMN_ALIASES, DOUBLE_COLUMNS, GEOMETRY_COLUMNS, PARCEL_COLUMNS, column_type


def quoted(name: str) -> Column:
    return F.col("`%s`" % name.replace("`", "``"))


def apply_aliases(df: DataFrame, aliases: dict[str, str] = COLUMN_ALIASES) -> DataFrame:
    """Rename known spellings; several spellings of one attribute are coalesced, the standard first."""
    spellings: dict[str, list[str]] = {}
    for old, new in aliases.items():
        if old in df.columns:
            spellings.setdefault(new, []).append(old)
    replaced = {old for olds in spellings.values() for old in olds}
    columns = []
    for name in df.columns:
        if name in replaced:
            continue
        sources = [name, *spellings.pop(name, [])]
        columns.append(F.coalesce(*map(quoted, sources)).alias(name) if len(sources) > 1 else quoted(name))
    for new, olds in spellings.items():
        columns.append(F.coalesce(*map(quoted, olds)).alias(new))
    return df.select(*columns)


def standardize(df: DataFrame, columns: list[str] = PARCEL_COLUMNS, keep: list[str] | None = None) -> DataFrame:
    """Standard columns in standard order, missing ones as NULL, extras dropped.

    The geometry columns, and any named in ``keep``, follow the standard ones.
    """
    typed = [
        quoted(c) if c in df.columns else F.lit(None).cast(column_type(c)).alias(c) for c in columns
    ]
    extra = [c for c in [*(keep or []), *GEOMETRY_COLUMNS] if c in df.columns and c not in columns]
    return df.select(*typed, *map(quoted, extra))


def cast_parcels(df: DataFrame) -> DataFrame:
    """Measured columns as doubles, malformed text as NULL; every other column as it is."""
    numeric = [f.name for f in df.schema.fields if f.name in DOUBLE_COLUMNS and not isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in numeric}) if numeric else df


def normalize_geometry(df: DataFrame, file_col: str | None = None) -> DataFrame:
    """The shape column under the name ``geom_wkb``, without files that hold no shape at all.

    With ``file_col`` a file counts as a whole, so its rows without a shape stay when others have
    one; without it every row has to have a shape.
    """
    if "geom_wkb" not in df.columns:
        shapes = [f.name for f in df.schema.fields if f.name.lower() in ("geom", "geometry", "shape") and isinstance(f.dataType, T.BinaryType)]
        if not shapes:
            raise ValueError("no geometry column")
        df = df.withColumnRenamed(shapes[0], "geom_wkb")
    filled = df.where(F.col("geom_wkb").isNotNull())
    if file_col is None:
        return filled
    return df.join(filled.select(file_col).distinct(), file_col, "left_semi")  # few files: broadcast, or split by adaptive joins


def stringify_dates(df: DataFrame) -> DataFrame:
    """Date and timestamp columns as text, for text-based exports."""
    dated = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    return df.withColumns({c: quoted(c).cast("string") for c in dated}) if dated else df


def schema_diff(columns: list[str], standard: list[str] = PARCEL_COLUMNS) -> tuple[list[str], list[str]]:
    """Standard columns the source lacks, and source columns the standard lacks, in list order."""
    return [c for c in standard if c not in columns], [c for c in columns if c not in standard]


def schema_diff_df(files: DataFrame, standard: list[str] = PARCEL_COLUMNS) -> DataFrame:
    """``schema_diff`` for a frame with one row per file and its ``columns`` as an array."""
    expected = F.array(*map(F.lit, standard))
    missing = F.array_except(expected, F.col("columns"))
    extra = F.filter("columns", lambda c: ~F.array_contains(expected, c))
    return (
        files.withColumns({"missing_columns": missing, "unmapped_columns": extra})
        .withColumn("columns_added", F.size("missing_columns"))
        .withColumn("columns_unmapped", F.size("unmapped_columns"))
        .withColumn("total_columns_in_file", F.size("columns"))
    )


def schema_report(files: DataFrame, standard: list[str] = PARCEL_COLUMNS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compliance per file, per state and in total, from ``(state, county, file, columns)`` rows."""
    detail = schema_diff_df(files, standard)
    sums = [
        F.count_distinct("county").cast("long").alias("counties"),
        F.count(F.lit(1)).alias("files"),
        F.sum("columns_added").alias("columns_added"),
        F.sum("columns_unmapped").alias("columns_unmapped"),
    ]
    names = (
        detail.select("state", F.explode_outer("columns").alias("column"))
        .distinct()
        .groupBy("state")
        .agg(F.array_sort(F.collect_list("column")).alias("state_columns"))
    )
    per_state = detail.groupBy("state").agg(*sums).join(names, "state", "left")
    summary = per_state.agg(
        F.count(F.lit(1)).alias("total_states"),
        F.sum("counties").alias("total_counties"),
        F.sum("files").alias("total_files"),
        F.sum("columns_added").alias("total_columns_added"),
        F.sum("columns_unmapped").alias("total_columns_unmapped"),
    )
    return detail.drop("columns"), per_state, summary


def filled_columns(df: DataFrame, keys: list[str], candidates: list[str] | None = None) -> DataFrame:
    """Columns holding at least one value, per group: ``(keys..., columns)`` in a single pass."""
    names = candidates or [c for c in df.columns if c not in keys]
    counted = df.groupBy(*keys).agg(*[F.count(quoted(c)).alias(f"_n{i}") for i, c in enumerate(names)])
    present = [F.when(F.col(f"_n{i}") > 0, F.lit(c)) for i, c in enumerate(names)]
    return counted.select(*keys, F.filter(F.array(*present), lambda c: c.isNotNull()).alias("columns"))


def union_layers(frames: list[DataFrame]) -> DataFrame:
    """All rows of layers whose columns may differ; absent columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
