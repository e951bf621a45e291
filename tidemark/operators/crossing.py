"""Queries against candidates in blocks, without a row for any pair.

Every block of queries meets every block of candidates in one task. What a median over all pairs of a query needs from
a block are counts by bins of the values; the bin that holds the median is known once the counts are summed up, and
only its values leave the tasks. Where one block holds all candidates, a task has the median at once. Both are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.storage import stored

QUERY_BLOCK, CANDIDATE_BLOCK = 4_096, 16_384
#: numbers held at once in a task
CELLS = 4 << 20
#: bits of a number that a bin leaves open: 128 bins from a power of two to the next
_OPEN_BITS = 45

Values = Callable[[pd.DataFrame, pd.DataFrame], dict[str, np.ndarray]]


def block_counts(queries: DataFrame, candidates: DataFrame, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> tuple[int, int]:
    """How many blocks of each: as many as fill the tasks if rows allow, and none larger than these."""
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked, held = queries.count(), candidates.count()
    return max(1, -(-asked // query_block), min(tasks, asked // 64)), max(1, -(-held // candidate_block))


def meet(queries: DataFrame, candidates: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, blocks: tuple[int, int], query_id: str = "query_id", candidate_id: str = "episode_id") -> DataFrame:
    """What `work` makes of each block of queries and each block of candidates."""
    def dealt(rows: DataFrame, id_col: str, own: str, n: int, other: str, copies: int) -> DataFrame:
        out = rows.withColumn(own, F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        # named anew: both sides can come from one table
        return out.select(*(F.col(c).alias(c) for c in out.columns))

    names = [part.split()[0] for part in schema.split(", ")]

    def both(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({n: [] for n in names})
        return work(asked.reset_index(drop=True), held.sort_values(candidate_id).reset_index(drop=True))[names]

    nq, nc = blocks
    left, right = dealt(queries, query_id, "_q", nq, "_c", nc).groupBy("_q", "_c"), dealt(candidates, candidate_id, "_c", nc, "_q", nq).groupBy("_q", "_c")
    return left.cogroup(right).applyInPandas(both, schema)


def chunks(asked: pd.DataFrame, width: int):
    """The queries of a block in pieces whose matrices of `width` columns stay small."""
    step = max(1, CELLS // max(1, width))
    for begin in range(0, len(asked), step):
        yield asked.iloc[begin : begin + step]


def _bins(values: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(values + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))) >> _OPEN_BITS


def medians(queries: DataFrame, candidates: DataFrame, values: Values, names: Sequence[str], blocks: tuple[int, int], query_id: str = "query_id", candidate_id: str = "episode_id") -> DataFrame:
    """(query_id, name, n, median) over all pairs that have a value.

    values(asked, held) gives a matrix for each name, NaN where a pair has none. A name of a query without any value has no row.
    """
    kind = queries.schema[query_id].dataType.simpleString()
    names = list(names)
    if blocks[1] == 1:

        def whole(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            parts = []
            for piece in chunks(asked, len(held)):
                got = values(piece, held)
                for name in names:
                    n = (~np.isnan(got[name])).sum(axis=1)
                    some = n > 0
                    parts.append(pd.DataFrame({query_id: piece[query_id].to_numpy()[some], "name": name, "n": n[some], "median": np.nanmedian(got[name][some], axis=1) if some.any() else []}))
            return pd.concat(parts)

        return meet(queries, candidates, whole, f"{query_id} {kind}, name string, n long, median double", blocks, query_id, candidate_id)

    def counted(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for piece in chunks(asked, len(held)):
            got = values(piece, held)
            for name in names:
                for i, q in enumerate(piece[query_id]):
                    own = got[name][i]
                    bins, n = np.unique(_bins(own[~np.isnan(own)]), return_counts=True)
                    rows.append((q, name, bins, n))
        return pd.DataFrame(rows, columns=[query_id, "name", "bins", "counts"])

    seen = meet(queries, candidates, counted, f"{query_id} {kind}, name string, bins array<long>, counts array<long>", blocks, query_id, candidate_id)
    pairs = seen.select(query_id, "name", F.explode(F.arrays_zip("bins", "counts")).alias("b")).groupBy(query_id, "name", F.col("b.bins").alias("bin")).agg(F.sum("b.counts").alias("n"))
    own = Window.partitionBy(query_id, "name")
    placed = pairs.withColumn("before", F.coalesce(F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(own))
    middle = placed.where("before <= all DIV 2 AND (all - 1) DIV 2 < before + n")
    wanted = stored(middle.groupBy(query_id, "name").agg(F.collect_list("bin").alias("bins"), F.min("before").alias("before"), F.max("all").alias("all")), "medians")
    asked_for = wanted.groupBy(query_id).agg(F.map_from_entries(F.collect_list(F.struct("name", "bins"))).alias("_bins"))

    def picked(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for piece in chunks(asked, len(held)):
            got = values(piece, held)
            for i, (q, bins) in enumerate(zip(piece[query_id], piece["_bins"])):
                for name, inside in dict(bins).items():
                    own = got[name][i]
                    own = own[~np.isnan(own)]
                    found, n = np.unique(own[np.isin(_bins(own), inside)], return_counts=True)
                    rows += zip([q] * len(found), [name] * len(found), found, n)
        return pd.DataFrame(rows, columns=[query_id, "name", "value", "n"])

    found = meet(queries.join(asked_for, query_id), candidates, picked, f"{query_id} {kind}, name string, value double, n long", blocks, query_id, candidate_id).groupBy(query_id, "name", "value").agg(F.sum("n").alias("n"))
    along = found.join(wanted.drop("bins"), [query_id, "name"])
    upto = F.col("before") + F.sum("n").over(own.orderBy("value"))
    at = lambda place: F.max(F.when((F.col("upto") - F.col("n") <= F.expr(place)) & (F.expr(place) < F.col("upto")), F.col("value")))
    return along.withColumn("upto", upto).groupBy(query_id, "name", F.col("all").alias("n_all")).agg(at("(all - 1) DIV 2").alias("low"), at("all DIV 2").alias("high")).select(query_id, "name", F.col("n_all").alias("n"), ((F.col("low") + F.col("high")) / 2).alias("median"))


def best_of(ids: np.ndarray, asked: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k smallest finite scores of each row, ties by id; asked: the rows' ids. ids are in order."""
    width = min(k, scores.shape[1])
    scores = np.where(np.isfinite(scores), scores, np.inf)
    edge = np.partition(scores, width - 1, axis=1)[:, width - 1 : width]
    rows, cols = np.nonzero((scores <= edge) & np.isfinite(scores))
    order = np.lexsort((cols, scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(len(asked)))
    place = np.arange(len(rows)) - starts[rows]
    return rows[place < k], cols[place < k]
