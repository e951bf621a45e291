"""An append-only ledger of forecasts: a row is written once, whoever tries again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.storage import stored

KEY = ("asset", "timeframe", "signal_id", "snapshot_ms", "model_version")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The ledger, or an empty one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return spark.createDataFrame([], schema)
        raise


def append_once(rows: DataFrame, path: str, key: Sequence[str] = KEY, order: str = "recorded_ms") -> int:
    """Adds rows whose key the ledger does not have; of several new rows with one key the first. Gives the number added.

    For one writer at a time: two at once may both add a key, of which `once` shows the first.
    """
    spark = rows.sparkSession
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    first = once(rows, key, order)
    # written before the append, since the append changes what it reads
    new = stored(first.join(read(spark, path, schema).select(*key), list(key), "left_anti"), "ledger")
    new.write.mode("append").parquet(path)
    return new.count()


def once(ledger: DataFrame, key: Sequence[str] = KEY, order: str = "recorded_ms") -> DataFrame:
    """The first row of each key."""
    first = Window.partitionBy(*key).orderBy(order)
    return ledger.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def with_backfill(ledger: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """The ledger with empty fields filled where the condition holds; fields that hold something stay."""
    return ledger.withColumns({c: F.when(where & F.col(c).isNull(), v).otherwise(F.col(c)) for c, v in values.items()})


def latest(ledger: DataFrame, key: Sequence[str] = ("asset", "timeframe", "signal_id"), order: str = "snapshot_ms") -> DataFrame:
    newest = Window.partitionBy(*key).orderBy(F.desc(order))
    return ledger.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
