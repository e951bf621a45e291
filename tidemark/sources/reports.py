"""Results for other programs: compressed CSV, and JSON in which what is not finite is null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(rows: DataFrame) -> DataFrame:
    """rows with NULL for NaN and infinities in columns of floats."""
    one = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return rows.select(*((one(F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`")) for c, t in rows.dtypes))


def write_json(rows: DataFrame, path: str) -> None:
    """One object a line, with nulls written out; replaces what is there once it is whole."""
    finite(rows).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str, compression: str = "gzip") -> None:
    """CSV files with a header; replaces what is there once it is whole."""
    rows.write.mode("overwrite").option("header", True).option("compression", compression).csv(path)
