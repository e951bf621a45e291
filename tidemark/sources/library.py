"""Stores of routes, episodes and observations, one folder per series, so a reader touches only what it asks for."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import SERIES
from tidemark.sources.candles import ContractError

TABLES = {"paths": ("episode_id", "offset_bars"), "episodes": ("episode_id",), "observations": ("signal_open_time", "observation_id")}


def write(rows: DataFrame, root: str, table: str) -> None:
    """Replaces the table's series that `rows` has and leaves the others; a long series is several files, each sorted by key.

    The schema is kept beside the table, so that a table without rows can be read too.
    """
    keys = TABLES[table]
    rows.sparkSession.createDataFrame([(rows.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").text(f"{root}/{table}-schema")
    dealt = rows.repartitionByRange(*SERIES, *keys).sortWithinPartitions(*SERIES, *keys)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*SERIES).parquet(f"{root}/{table}")


def read(spark: SparkSession, root: str, table: str, timeframe: str | None = None, assets: list[str] | None = None) -> DataFrame:
    """The table, cut to a timeframe and to assets; both prune folders."""
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{root}/{table}-schema").first().value))
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    rows = spark.read.schema(schema).parquet(f"{root}/{table}") if there else spark.createDataFrame([], schema)
    if timeframe is not None:
        rows = rows.where(F.col("timeframe") == timeframe)
    return rows if assets is None else rows.where(F.col("asset").isin(*assets))


def read_paths(spark: SparkSession, root: str, found: DataFrame, timeframe: str | None = None, assets: list[str] | None = None) -> DataFrame:
    """Routes of the episodes in `found` only."""
    return read(spark, root, "paths", timeframe, assets).join(found.select("episode_id"), "episode_id", "left_semi")


def require_unique(rows: DataFrame, *keys: str) -> DataFrame:
    """rows, after a check that no key stands twice: stores of several assets must not overlap."""
    if not rows.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ContractError(f"{', '.join(keys)} not unique")
    return rows


def require_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    if missing := sorted(set(names) - set(rows.columns)):
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return rows
