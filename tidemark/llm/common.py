"""What the training-data operators share: tables, shared storage, splits and byte tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.storage import shared_dir, stored

__all__ = ["WORD", "Shipped", "byte_texts", "few", "map_batches", "remainder", "shared_dir", "slices", "smallest_by_hash", "stored", "table", "tokens"]

#: rows of a table that is broadcast once its size is known
MOST_BROADCAST = 100_000

#: Java/SQL form of "one or more non-blank bytes"; bytes.split() in Python cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; NULL for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(modulus))


def few(df: DataFrame, name: str, most: int = MOST_BROADCAST) -> DataFrame:
    """df, stored; with a broadcast hint if it has at most `most` rows. For tables of a few columns by label, language or source."""
    held = stored(df, name)
    return F.broadcast(held) if held.limit(most + 1).count() <= most else held


def smallest_by_hash(rows: DataFrame, group: str, per_group: int, id_col: str, salt: str = "") -> DataFrame:
    """At most `per_group` rows of each group, those with the smallest hash of the id: a bounded sample that reruns repeat.

    Counts per group come first, and only rows whose hash is among about the first 2 * per_group of their group are
    ranked, so a hot group is not gathered. Equal hashes (repeated ids) fall in the order of the id; groups that are
    NULL are left out. The counts are broadcast only where they are few.
    """
    from pyspark.sql import Window

    counts = few(rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_all")), "group-counts")
    spot = F.pmod(F.xxhash64(F.lit(salt), F.col(id_col)), F.lit(1 << 40)) / float(1 << 40)
    near = rows.withColumn("_spot", spot).join(counts, group).where(F.col("_spot") * F.col("_all") <= 2 * per_group + 100)
    by = Window.partitionBy(group).orderBy("_spot", F.col(id_col))
    return near.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= per_group).drop("_rank", "_spot", "_all")


def byte_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased: bytes.lower touches ASCII only, bytes.split cuts at \\x20 and \\x09-\\x0D."""
    return text.lower().split() if text else []


def slices(batches: Iterable[pa.RecordBatch], text_col: str, limit_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `limit_bytes` of text (a longer single text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(text_col))).to_pylist()
        begin, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + (n or 0) > limit_bytes:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n or 0
        yield batch.slice(begin)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text_col: str, limit_bytes: int = 8 << 20) -> DataFrame:
    """mapInArrow over slices of bounded text size."""

    def run(batches):
        import pyarrow.compute  # noqa: F401  (slices uses pa.compute)

        for piece in slices(batches, text_col, limit_bytes):
            yield work(piece)

    return df.mapInArrow(run, schema)


class Shipped:
    """A bounded value that every task reads: broadcast once, with its classes inside, so executors need no package."""

    def __init__(self, spark: SparkSession, value: object):
        from pyspark import cloudpickle

        self._held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = None

    def __getstate__(self):
        return {"_held": self._held, "_value": None}

    @property
    def value(self):
        if self._value is None:
            import pickle

            self._value = pickle.loads(self._held.value)
        return self._value
