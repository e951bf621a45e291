"""Mixing sources to target weights by hash thresholds.

Every source gets a target number of words. Documents have a fixed place on the hash line; a source whose target is
q times its size plus a rest takes every document q times and, once more, those whose hash is below a threshold.
Thresholds are nested: a larger target takes a superset. They are found from histograms: words by source and hash
bucket give the boundary bucket, and only that bucket is cut again, until its documents share one hash. Nothing is
sorted and no document moves; what is shuffled is one row per source, bucket and task.

A document's place has three parts: the hash of its id, that of its text, and its row number. The second is looked at
only where several rows share the first (NULL and repeated ids), the third where they share both: such rows are the
same document many times, and a number of them is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, few, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
#: no source repeats more often than this
MOST_REPEATS = 2.0
#: bits of a document's place on the hash line, and how many of them a round looks at
PLACE_BITS, ROUND_BITS = 60, 12
#: the parts of a document's place
PARTS = ("place", "tie", "n")


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_of(id_col: str) -> Column:
    """Where an id falls on the hash line, 0 to 2**PLACE_BITS - 1; a NULL id has a place too."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(key, 1, PLACE_BITS // 4), 16, 10).cast("long")


def tie_of(text_col: str) -> Column:
    """A second place for rows that share an id, from the text; a NULL text is like an empty one."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 64 - PLACE_BITS)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, place, tie, n): place of the id, of the text, and the row's number. To be stored at once."""
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"),
        place_of(id_col).alias("place"), tie_of(text_col).alias("tie"), F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - PLACE_BITS).alias("n"),
    )


def targets(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target): share * all words, dealt by weight in the order of the sources (NULL last), none above most * its size.

    Filling by weight with ceilings has a closed form: with sources by ceiling over weight, a source is at its ceiling
    as long as the ceilings before it and its own level times the weights from it on are within the whole. Three small
    windows over one row per source; no iteration.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    everyone = Window.partitionBy(F.lit(0))
    # UTF-8 order is code point order, which is how Spark compares strings
    order = everyone.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    dealt = sizes.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * most)
    dealt = dealt.withColumn("level", F.col("ceiling") / F.col("weight")).withColumn("whole", F.sum("source_size").over(everyone) * share)
    dealt = dealt.withColumn("turn", F.row_number().over(everyone.orderBy("level", F.col("source").asc_nulls_last())))
    by_level = everyone.orderBy("turn")
    dealt = dealt.withColumn("filled", F.coalesce(F.sum("ceiling").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    dealt = dealt.withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    # the water level as it stands once the sources before this one are full; the first that stays open has the right one
    dealt = dealt.withColumn("water", (F.col("whole") - F.col("filled")) / F.col("open")).withColumn("is_full", F.col("water") >= F.col("level"))
    water = F.coalesce(F.min(F.when(~F.col("is_full"), F.struct("turn", "water"))).over(everyone)["water"], F.lit(float("inf")))
    return dealt.select("source", "source_size", F.least(F.col("ceiling"), F.col("weight") * water).alias("target"))


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, repeats, below_place, below_tie, below_n): documents are taken `repeats` times, and once more if their place is below.

    wanted: (source, source_size, target). Each round splits the boundary bucket of each source by the next bits of
    the place and finds the first bucket that reaches beyond the rest of the target. A source that stays within the
    rest is taken whole. At the last bit the boundary's documents share one part of the place; where they are several,
    the search goes on within them by the next part. A last one is taken if that brings the source nearer to its target.
    """
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("repeats") * F.col("source_size")
    none = F.lit(None).cast("long")
    state = wanted.withColumn("repeats", repeats).select("source", "repeats", rest.alias("rest"), F.lit(0).cast("long").alias("prefix"), F.lit(False).alias("done"), *(none.alias(f"below_{p}") for p in PARTS))
    for depth, part in enumerate(PARTS):
        for left in range(PLACE_BITS - ROUND_BITS, -1, -ROUND_BITS):
            state = stored(state, "mix-state")
            boundary = state.where("NOT done").select(F.col("source").alias("of"), "rest", "prefix", *(F.col(f"below_{p}").alias(f"at_{p}") for p in PARTS[:depth]))
            inside = rows.source.eqNullSafe(F.col("of")) & (F.shiftright(part, left + ROUND_BITS) == F.col("prefix"))
            for p in PARTS[:depth]:
                inside &= F.col(p) == F.col(f"at_{p}")
            # a few numbers per source, joined to a few numbers per document
            buckets = rows.join(boundary, inside).groupBy("of", "rest", F.shiftright(part, left).alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
            upto = F.sum("size").over(Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
            first = buckets.withColumn("upto", upto).where("upto > rest").groupBy("of").agg(F.min(F.struct("bucket", "upto", "size", "rows")).alias("b"))
            joined = state.join(first, F.col("source").eqNullSafe(F.col("of")), "left")
            now, found, short = ~F.col("done"), F.col("b").isNotNull(), F.col("rest") - (F.col("b.upto") - F.col("b.size"))
            below, done = F.when(now & ~found, F.shiftleft(F.col("prefix") + 1, left + ROUND_BITS)), F.col("done") | ~found
            if left == 0:
                # one document, or several that the next part tells apart
                single = F.lit(True) if part == PARTS[-1] else F.col("b.rows") == 1
                nearer = single & (F.col("b.upto") - F.col("rest") < short)
                below, done = F.when(now & found, F.col("b.bucket") + nearer.cast("long")).otherwise(below), done | single
            prefix = F.when(now & found, F.lit(0).cast("long") if left == 0 else F.col("b.bucket")).otherwise(F.col("prefix"))
            state = joined.select(
                "source", "repeats", F.when(now & found, short).otherwise(F.col("rest")).alias("rest"), prefix.alias("prefix"), done.alias("done"),
                *((F.coalesce(below, f"below_{p}") if p == part else F.col(f"below_{p}")).alias(f"below_{p}") for p in PARTS),
            )
        state = stored(state, "mix-state")
        if state.where("NOT done").isEmpty():
            break
    return state.select("source", "repeats", *(f"below_{p}" for p in PARTS))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> tuple[DataFrame, DataFrame]:
    """What `sized` gives, and per source (source, source_size, target, repeats, below_place, below_tie, below_n).

    Without rows both are empty. A source without words has the target 0. Other columns of docs are not looked at.
    """
    rows = stored(sized(docs, id_col, text_col, source_col), "mix-sizes")
    wanted = stored(targets(rows, weights, share, most), "mix-targets")
    limits = thresholds(rows, wanted).withColumnRenamed("source", "of")
    return rows, few(wanted.join(limits, wanted.source.eqNullSafe(F.col("of"))).drop("of"), "mix-plan")


def copies(most: float = MOST_REPEATS) -> Column:
    """How often a document is taken, from its place, repeats and below. Where below_tie is NULL, the first part decides."""
    below = [F.col(f"below_{p}") for p in PARTS]
    under = F.coalesce(F.col(PARTS[2]) < below[2], F.lit(False))
    under = F.coalesce((F.col(PARTS[1]) < below[1]) | (F.col(PARTS[1]) == below[1]) & under, F.lit(False))
    under = (F.col(PARTS[0]) < below[0]) | (F.col(PARTS[0]) == below[0]) & under
    return F.least(F.col("repeats") + under.cast("long"), F.lit(int(most)))


def run(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per input row.

    NULL and empty texts have size 0; a NULL source is a source of its own; NULL and repeated ids are told apart by
    their texts and then by row. Rows equal in id, text and source are taken in a number that reruns repeat.
    """
    rows, dealt = plan(docs)
    joined = rows.join(dealt.withColumnRenamed("source", "of"), rows.source.eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs, all columns kept, each row as often as the mix takes it (0, 1 or 2 times). NULLs, ties and repeated rows as in `run`."""
    # the row travels as one value, so no column of it can be taken for one of ours
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(source_col).alias("from"), place_of(id_col).alias("place"), tie_of(text_col).alias("tie"))
    _, dealt = plan(docs, id_col, text_col, source_col)
    if dealt.where("below_n IS NOT NULL").isEmpty():
        rows = rows.withColumn("n", F.lit(0).cast("long"))
    else:
        # repeated rows are told apart by numbers: the table is written once, so that both passes see the same
        rows = stored(rows.withColumn("n", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - PLACE_BITS)), "mix-rows")
        named = rows.select(F.col("row")[id_col].alias("id"), F.col("from").alias("source"), words_in(F.col("row")[text_col]).alias("size"), "place", "tie", "n")
        wanted = stored(targets(named), "mix-targets")
        limits = thresholds(named, wanted).withColumnRenamed("source", "of")
        dealt = wanted.join(limits, wanted.source.eqNullSafe(F.col("of"))).drop("of")
    joined = rows.join(dealt.select("source", "repeats", *(f"below_{p}" for p in PARTS)), F.col("from").eqNullSafe(F.col("source")))
    taken = joined.select("row", F.explode(F.array_repeat(F.lit(0), copies().cast("int"))).alias("turn"))
    return taken.select(*(F.col("row")[c].alias(c) for c in docs.columns))
