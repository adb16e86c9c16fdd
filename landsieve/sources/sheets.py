"""Ranking, weight, preference and exclusion sheets, as CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import is_flagged
from ..operators.standardize import quoted
from .vector_files import unique_names

# Cell texts that count as blank.
BLANK_MARKS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet as text columns; repeated header names are numbered, blank marks become NULL."""
    first = spark.read.options(header=False, escape='"', multiLine=True).csv(path).head()
    if first is None:
        raise ValueError(f"{path}: empty sheet")
    names = unique_names([v if v is not None else f"Unnamed: {i}" for i, v in enumerate(first)])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).options(header=True, enforceSchema=True, escape='"', multiLine=True).csv(path)
    return rows.select(*[F.when(~quoted(n).isin(BLANK_MARKS), quoted(n)).alias(n) for n in names])


def read_ranking_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The side-by-side ranking sheet; ``build_lookups`` cuts and types it."""
    return read_sheet(spark, path)


def read_params(spark: SparkSession, path: str) -> dict:
    """Weights or preferences: names and values from the first two columns, numbers where they are numbers."""
    sheet = read_sheet(spark, path)
    params = {}
    for name, value in sheet.select(*map(quoted, sheet.columns[:2])).collect():  # a handful of rows
        if name is None:
            continue
        try:
            params[name] = float(value)
        except (TypeError, ValueError):
            params[name] = value
    return params


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Flagged land uses and owners, merged into one column ``value``."""
    sheet = read_sheet(spark, path)
    sheet = sheet.toDF(*[c.strip() for c in sheet.columns])
    lists = []
    for names, flag in (("Land Use", "Unwanted"), ("Ownership", "Unwanted.1")):
        if names in sheet.columns and flag in sheet.columns:
            lists.append(sheet.where(is_flagged(flag)).select(F.trim(quoted(names)).alias("value")))
    if not lists:
        return spark.createDataFrame([], "value string")
    merged = lists[0]
    for other in lists[1:]:
        merged = merged.unionByName(other)
    return merged.where(F.col("value").isNotNull())
