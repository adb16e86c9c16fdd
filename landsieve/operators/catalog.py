"""Lists of states, counties, providers and result runs, and run retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RUN_KEYS = ["state", "county", "provider"]
RUN_FORMAT = "yyyyMMdd_HHmmss"


def providers(df: DataFrame) -> DataFrame:
    """Distinct trimmed line operators, sorted; blank and NULL ones are left out."""
    operator = F.col("et_operator")
    return (
        df.where(operator.isNotNull() & (operator != ""))
        .select(F.trim(operator).alias("provider"))
        .distinct()
        .orderBy("provider")
    )


def states(df: DataFrame, state: str = "state") -> DataFrame:
    """Distinct states, sorted. On a partitioned table this touches no data column."""
    return df.select(F.col(state).alias("state")).distinct().orderBy("state")


def counties(df: DataFrame, state_code: str, state: str = "state", county: str = "county") -> DataFrame:
    """Distinct counties of one state, sorted; the state test prunes partitions."""
    return df.where(F.col(state) == F.lit(state_code)).select(F.col(county).alias("county")).distinct().orderBy("county")


def county_counts(df: DataFrame, state: str = "state", county: str = "county") -> DataFrame:
    """Loaded rows per county."""
    return df.groupBy(F.col(state).alias("state"), F.col(county).alias("county")).agg(F.count(F.lit(1)).alias("n"))


def runs(df: DataFrame) -> DataFrame:
    """Distinct result runs with their parsed time."""
    return (
        df.select(*RUN_KEYS, F.col("run_ts").cast("string").alias("run_ts"))
        .distinct()
        .withColumn("created", F.try_to_timestamp(F.col("run_ts"), F.lit(RUN_FORMAT)))
    )


def folders(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Distinct partition keys of a written table, from the names of its folders alone: no data file is opened.

    Spark lists the folders, many at a time; the files it lists hand out nothing but where they lie.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return listed.select(*[F.col(k).cast("string").alias(k) for k in keys]).distinct()


def run_folders(spark: SparkSession, path: str) -> DataFrame:
    """The keys of all runs of a written results table, for ``runs``, ``runs_info`` and ``runs_to_drop``."""
    return folders(spark, path, [*RUN_KEYS, "run_ts"])


def runs_info(df: DataFrame) -> DataFrame:
    """One row per run with its parsed time, the number of runs of its key and their newest time."""
    of_key = Window.partitionBy(*RUN_KEYS)  # runs, not rows
    return runs(df).withColumn("total_runs", F.count(F.lit(1)).over(of_key)).withColumn("newest", F.max("created").over(of_key))


def runs_to_drop(df: DataFrame, keep: int = 2) -> DataFrame:
    """Runs older than the newest ``keep`` (at least one) of their state, county and provider."""
    if keep < 1:
        raise ValueError("at least one run has to be kept")
    listed = df.select(*RUN_KEYS, F.col("run_ts").cast("string").alias("run_ts")).distinct()
    newest_first = Window.partitionBy(*RUN_KEYS).orderBy(F.col("run_ts").desc())
    return listed.withColumn("age", F.row_number().over(newest_first)).where(F.col("age") > F.lit(keep)).drop("age")
