"""Fitted tables tied to the source that they were fitted to: a changed source is refused, or they are built anew."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import manifest
from tidemark.sources.candles import ContractError


def fingerprint(spark: SparkSession, *folders: str) -> str:
    """One digest of the names, sizes and contents of all files below some folders. The files are read where the tasks run."""
    parts = []
    for folder in folders:
        files = manifest.digests(spark, folder).select(F.concat_ws("|", "file", "bytes", "sha256").alias("line"))
        # order-free: files are many, their digests are summed by halves of 64 bits
        halves = [F.conv(F.substring(F.sha2("line", 256), 15 * k + 1, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
        row = files.agg(F.count("*").alias("n"), *(F.sum(h).alias(f"h{k}") for k, h in enumerate(halves))).first()
        parts.append("/".join(str(v or 0) for v in row))
    return spark.range(1).select(F.sha2(F.lit(";".join(parts)).cast("binary"), 256)).first()[0]


def save(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], source: str) -> None:
    """Writes the tables below the source's fingerprint, and then the note that they are whole."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/{source}/{name}")
    spark.createDataFrame([(source, name) for name in tables], "source string, name string").coalesce(1).write.mode("overwrite").parquet(f"{root}/{source}/_whole")


def load(spark: SparkSession, root: str, source: str) -> dict[str, DataFrame]:
    """The tables of this source; an error if there are none, or only those of another source."""
    try:
        names = [r.name for r in spark.read.parquet(f"{root}/{source}/_whole").collect()]
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        raise ContractError(f"nothing below {root} was built from the source {source[:12]}") from None
    return {name: spark.read.parquet(f"{root}/{source}/{name}") for name in names}


def load_or_build(spark: SparkSession, root: str, source: str, build: Callable[[], Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables of this source, built and saved first if it has changed or they are not there."""
    try:
        return load(spark, root, source)
    except ContractError:
        save(spark, root, build(), source)
        return load(spark, root, source)
