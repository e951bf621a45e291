"""What a stored table or model is made of: its files with their digests, taken on the executors, and the version in use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.candles import ContractError


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, sha256) of all files below a folder of the shared file system; file is relative to it. One task reads one file at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    at = F.regexp_replace(F.lit(folder), "^[a-z0-9]+:/*", "/")
    name = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^/+", "/")
    return files.select(F.substring(name, F.length(F.regexp_replace(at, "/+$", "")) + 2, F.length(name)).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write(spark: SparkSession, folder: str, manifest: str, version: str) -> DataFrame:
    """Writes the manifest of a folder beside it; a version that has one already is frozen, and writing it again is an error."""
    digests(spark, folder).withColumn("version", F.lit(version)).coalesce(1).write.mode("error").parquet(f"{manifest}/{version}")
    return spark.read.parquet(f"{manifest}/{version}")


def verify(spark: SparkSession, folder: str, manifest: str, version: str) -> None:
    """An error if a file of the manifest is missing or changed, or one has come."""
    want = spark.read.parquet(f"{manifest}/{version}").select("file", F.col("sha256").alias("want"))
    wrong = want.join(digests(spark, folder), "file", "full").where(~F.col("want").eqNullSafe(F.col("sha256"))).select("file").limit(5).collect()
    if wrong:
        raise ContractError(f"changed, missing or new: {', '.join(sorted(r.file for r in wrong))}")


def promote(spark: SparkSession, log: str, version: str) -> None:
    """Makes a version the one in use: one row more in a log, so what was in use before is known."""
    spark.createDataFrame([(version,)], "version string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(log)


def in_use(spark: SparkSession, log: str, steps_back: int = 0) -> str:
    """The version promoted last, or `steps_back` promotions before it: what to promote again to roll back."""
    rows = spark.read.parquet(log).orderBy(F.desc("at")).limit(steps_back + 1).collect()
    if len(rows) <= steps_back:
        raise ContractError("no such promotion")
    return rows[steps_back].version
