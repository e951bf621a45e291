"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints link when at most RADIUS bits differ. Each bit position gets a nonzero vector of RADIUS+1 bits, and
each nonzero vector v of that length gives one table, keyed by the bits whose vector has an odd product with v.
Any RADIUS positions span less than the whole space, so some v is even on all of them: two fingerprints within
the radius agree on that whole key. No such pair is missed, whatever the data are.

Work is on distinct fingerprints, so exact copies cost one row each. A bucket of up to PAIRED fingerprints is
compared pair by pair. A larger one is never: there each fingerprint is sent to the points within half the radius
of it (in the bits that the key leaves free), and those that meet at a point are within the radius of each other,
and every pair within the radius meets at one. That takes a fixed number of rows per fingerprint.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import components
from tidemark.llm.common import byte_texts, map_batches, stored, tokens

BITS = 64
RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42
PAIRED = 64


def _bits_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Majority fingerprints (uint64) of runs of hashes; counts: the positive lengths of the runs."""
    planes = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ends = np.cumsum(counts)
    out = np.empty((len(counts), BITS), np.uint8)
    for k, (begin, end) in enumerate(zip(ends - counts, ends)):
        out[k] = planes[begin:end].sum(axis=0, dtype=np.uint32) * 2 > end - begin
    return np.packbits(out, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def fingerprint_bytes(texts: list[bytes | None], words: int = SHINGLE_WORDS) -> np.ndarray:
    """uint64 fingerprints; a text without words has zero."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        found = tokens(text)
        if not found:
            continue
        joined = b" ".join(found)
        if len(found) <= words:
            hashes.append(digest(joined, SEED))
            counts[k] = 1
            continue
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(sizes + 1) - 1
        begins = ends - sizes
        hashes += [digest(joined[a:b], SEED) for a, b in zip(begins[: 1 - words].tolist(), ends[words - 1 :].tolist())]
        counts[k] = len(found) - words + 1
    out = np.zeros(len(texts), np.uint64)
    full = counts > 0
    if full.any():
        out[full] = _bits_of(np.array(hashes, np.uint64), counts[full])
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp): one row per input row, fp the fingerprint as a signed 64-bit value. NULL and blank texts have 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = fingerprint_bytes(byte_texts(batch.column(1)), words).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["id", "fp"])

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), work, f"id {kind}, fp long", "text", 4 << 20)


def masks(radius: int = RADIUS) -> list[int]:
    """The bits that each table's key keeps; 2**(radius+1) - 1 tables."""
    vectors = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(BITS) if ((i % vectors + 1) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, radius: int = RADIUS, paired: int = PAIRED) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp, unique) that give the same components as all pairs within `radius` (even)."""
    if radius % 2:
        raise ValueError("the radius must be even")
    tables = masks(radius)
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(tables)))).alias("_e")).select("fp", "_e.t", "_e.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(keyed.join(sizes, ["t", "key"]), "buckets")

    small = met.where(F.col("n") <= paired).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    near = lambda a: F.filter("fps", lambda b: (b > a) & (_differ(a, b) <= radius))
    pairs = small.select(F.explode(F.transform("fps", lambda a: F.struct(a.alias("u"), near(a).alias("vs")))).alias("e")).select("e.u", F.explode("e.vs").alias("v"))

    # the points within half the radius, moving only bits that the table's key leaves free
    flips = []
    for m in tables:
        free = [i for i in range(BITS) if not m >> i & 1]
        flips.append([_signed(sum(1 << i for i in c)) for k in range(radius // 2 + 1) for c in combinations(free, k)])
    moved = F.element_at(F.array(*(F.array(*map(F.lit, f)) for f in flips)), F.col("t") + 1)
    points = met.where(F.col("n") > paired).select("fp", F.explode(moved).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).distinct()
    meet = points.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = meet.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")
    return pairs.union(stars).distinct()


def components_of(found: DataFrame, radius: int = RADIUS, paired: int = PAIRED) -> DataFrame:
    """(id, fp, component_id) for the rows of `fingerprints`: the smallest id reachable over links, itself included.

    A NULL id is a member without a name: it takes the smallest other id of its component, or NULL.
    """
    held = stored(found, "fingerprints")
    classes = stored(held.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    joined = components.roots(links(classes.select("fp"), radius, paired))
    rooted = classes.join(joined, classes.fp == joined.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    mapped = stored(rooted.join(named, "root").select("fp", "component_id"), "components")
    # a fingerprint with very many copies is one hot key of this join alone; AQE splits it
    return held.join(mapped, "fp").select("id", "fp", "component_id")


def run(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id), one row per input row."""
    out = components_of(fingerprints(docs, id_col, text_col))
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, the one with the smallest id; all columns kept.

    Of several rows with that same id one stays; rows whose component has no id at all (NULL ids only) stay as one.
    """
    # the row travels as one value, so no column of it can be taken for one of ours
    tagged = stored(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("n")), "rows")
    named = tagged.select(F.struct(F.col("row")[id_col].isNull().alias("unnamed"), F.col("row")[id_col].alias("name"), "n").alias("id"), F.col("row")[text_col].alias("text"))
    found = components_of(fingerprints(named, "id", "text"))
    winners = found.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id.n").alias("n"))
    return tagged.join(winners, "n", "left_semi").select(*(F.col("row")[c].alias(c) for c in docs.columns))
