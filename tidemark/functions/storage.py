"""Written intermediate tables: cut lineage, and survive the loss of any executor."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_RUNS: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a local master; on a cluster executors would not see it, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's tables; it is deleted when the driver ends, or by `clear`."""
    path = f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"
    if path not in _RUNS:
        if not _RUNS:
            atexit.register(_clear_all)
        _RUNS[path] = spark
    return path


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written to the shared folder and read again. For tables that several later steps read, and before plans grow.

    by: its last columns, of few values; a step that asks for one value reads only the files of that.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=list(by) or None)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each table written inside are deleted once it is written, not when the driver's JVM collects garbage.

    Rows go to Python in batches of a few megabytes, as those of lots are large.
    """
    inside = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
    before = {name: spark.conf.get(name) for name in inside}
    try:
        for name, value in inside.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def discard(*tables: DataFrame) -> None:
    """Deletes what `stored` wrote, once nothing that is still to be computed reads it."""
    for df in tables:
        _delete(df.sparkSession, df.__dict__["_stored_at"])


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clear(spark: SparkSession) -> None:
    """Deletes this application's tables. DataFrames that read them can no longer be used."""
    path = run_dir(spark)
    _delete(spark, path)
    _RUNS.pop(path, None)


def _clear_all() -> None:
    for spark in list(_RUNS.values()):
        # a session that has been stopped can delete nothing any more
        if spark.sparkContext._jsc is not None:
            clear(spark)
