"""Exact deduplication against a persistent index of digests.

The index is a table of one row per known text, bucketed and sorted by the SHA-256 of the text, in a folder that
outlives the session. A batch is grouped by digest, which is summed up before it is shuffled, so copies of one text
never meet in one place; the groups meet the index in a sort-merge anti-join that reads the index bucket by bucket and
moves nothing of it; what the index lacks is appended. Texts themselves never move, only their digests.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.storage import run_dir
from tidemark.llm.common import stored

#: a text is hot if it makes up more than one in HOT of all rows, so there are fewer than HOT hot texts
HOT = 10_000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, row, digest), written: SHA-256 of the text in UTF-8, after `normalise` where one is given; NULL counts as empty.

    row tells rows apart that share their id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    return stored(docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")), "digests")


class Index:
    """Digests that are known already, with the id that stays for each and the batch that brought it."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, id_type: str = "bigint"):
        """Opens the index in `folder`, or begins one. A folder is always opened with the number of buckets that it began with."""
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id {id_type}, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}'")

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame, batch: str) -> DataFrame:
        """(digest, n, keep_id, keep_row, fresh), written: the batch's texts, how many of its rows have them, and which stays.

        rows as from `digests`. Of a batch's equal texts the largest id stays, NULL being the smallest; of rows that
        share it, one. fresh: no other batch had brought the text before; a text that is not keeps the id in the index.
        A batch that is added again, after a driver was lost, gets the same answer and leaves no second entry.
        """
        first = F.max("id")
        at = rows.groupBy("digest").agg(F.count("*").alias("n"), first.alias("keep_id"), F.coalesce(F.max_by("row", "id"), F.max("row")).alias("keep_row"))
        at = stored(at, "dedup-batch")
        known = self.entries()
        missing = at.join(known.select("digest").hint("merge"), "digest", "left_anti")
        missing.select("digest", "keep_id", F.lit(batch).alias("batch")).repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        held = self.entries().where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("held_id"), F.lit(True).alias("held"))
        seen = at.join(held.hint("merge"), "digest", "left")
        old = F.col("held").isNotNull()
        return stored(seen.select("digest", "n", F.when(old, F.col("held_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(~old, F.col("keep_row")).alias("keep_row"), (~old).alias("fresh")), "dedup-judged")

    def close(self) -> None:
        """Forgets the table's name; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def members(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, digest, keep_id, n, kept), one per row. verdicts: one per digest, as from `Index.add`.

    Rows of hot texts, of which there are fewer than HOT, are answered where they are read; only the rest is shuffled.
    """
    all_rows = rows.count()
    named = verdicts.select("digest", "n", "keep_id", "keep_row")
    hot = F.broadcast(named.where(F.col("n") * HOT > all_rows))
    near = rows.join(hot, "digest")
    far = rows.join(hot.select("digest"), "digest", "left_anti").join(named.where(F.col("n") * HOT <= all_rows), "digest")
    return near.unionByName(far).select("id", "digest", "keep_id", "n", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"))


def run(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row: of equal texts the row with the largest id stays.

    The rows come to a new index in two batches, larger ids first, so the second meets what the first has left there.
    NULL texts are empty ones, NULL ids the smallest; of rows that share id and text one stays. Any type of id that has
    an order will do. Without rows there are none. Other columns are not looked at.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = digests(docs, id_col, text_col)
    index = Index(spark, folder or f"{run_dir(spark)}/digest-index-{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions")), kind)
    # any id will do as the edge of the batches: the answer does not depend on it
    cut = rows.agg(F.min_by("id", F.xxhash64("id")).alias("cut")).first().cut
    upper = F.coalesce(F.col("id") >= F.lit(cut), F.lit(False)) if cut is not None else F.lit(True)
    batches = [index.add(rows.where(upper), "1"), index.add(rows.where(~upper), "2")]
    index.close()
    fresh = lambda c: F.max(F.when(F.col("fresh"), F.col(c))).alias(c)
    verdicts = batches[0].unionByName(batches[1]).groupBy("digest").agg(F.sum("n").alias("n"), fresh("keep_id"), fresh("keep_row"))
    out = members(rows, stored(verdicts, "dedup-verdicts"))
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))
