"""Document fingerprints: a threshold-scaled sketch of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, of every text. It also keeps its LEAST
smallest hashes, so short texts are known as exactly as long ones. `below` says how far up a sketch is complete: all
of a text's hashes under it are there. Two sketches are compared under the smaller of their bounds, where both are
complete, so likeness and containment of texts of any sizes are read off without bias, and the union of two sketches
under that bound is the sketch of the union. A containment of which nothing is left under the common bound is unknown
(NULL), never 0.

A shingle is a word together with the up to four words before it, A-Z lower-cased, so a text of n words has n
shingles and the shortest texts still have some. Hashes are 32 bits wide.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

SHINGLE_WORDS = 5
#: one hash in SCALE is kept, and the smallest LEAST in any case
SCALE = 8
LEAST = 256
_ALL = 1 << 32
#: ids looked at for each range that documents are dealt to
_SPOTS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(29)


def _word_hashes(words: list[bytes], cache: dict[bytes, int]) -> np.ndarray:
    digest, get = xxhash.xxh3_64_intdigest, cache.get
    out = []
    for w in words:
        h = get(w)
        if h is None:
            h = digest(w)
            if len(cache) < 200_000:
                cache[w] = h
        out.append(h)
    return np.array(out, np.uint64)


def _shingles(word_hashes: np.ndarray, words: int = SHINGLE_WORDS) -> np.ndarray:
    """uint32 hashes of the shingles that end at each word."""
    total = word_hashes * _MIX
    for k in range(1, words):
        before = np.zeros_like(word_hashes)
        before[k:] = word_hashes[:-k] if k < len(word_hashes) else word_hashes[:0]
        total = (total ^ (total >> _TURN)) * _MIX + before
    total = (total ^ (total >> np.uint64(32))) * _MIX
    return (total >> np.uint64(32)).astype(np.uint32)


class Sketch:
    """hashes: all distinct shingle hashes of a text under `below`, sorted uint32."""

    __slots__ = ("hashes", "below")

    def __init__(self, hashes: np.ndarray, below: int):
        self.hashes, self.below = hashes, below

    @classmethod
    def of(cls, shingles: np.ndarray, scale: int = SCALE, least: int = LEAST) -> Sketch:
        every = np.unique(shingles)
        below = _ALL if len(every) <= least else max(_ALL // scale, int(every[least]))
        return cls(every, below).under(below)

    def under(self, below: int) -> Sketch:
        return Sketch(self.hashes[: np.searchsorted(self.hashes, below)] if below < _ALL else self.hashes, below)

    def merged(self, other: Sketch) -> Sketch:
        below = min(self.below, other.below)
        return Sketch(np.union1d(self.under(below).hashes, other.under(below).hashes), below)

    def _shared(self, other: Sketch) -> tuple[int, int, int]:
        below = min(self.below, other.below)
        a, b = self.under(below).hashes, other.under(below).hashes
        return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))

    def likeness(self, other: Sketch) -> float:
        """Estimate of the Jaccard likeness; 1 for two texts without words. Where one text has words, hashes are left to tell."""
        a, b, both = self._shared(other)
        return both / (a + b - both) if a or b else 1.0

    def contained(self, other: Sketch) -> float | None:
        """Estimate of the share of this text's shingles that the other has; None where none is left to tell."""
        a, _, both = self._shared(other)
        return both / a if a else None

    def text(self) -> str:
        return f"{self.below}:" + base64.b64encode(self.hashes.astype("<u4").tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Sketch:
        below, _, body = text.partition(":")
        return cls(np.frombuffer(base64.b64decode(body), "<u4"), int(below))


def sketch(text: str | None, cache: dict[bytes, int] | None = None) -> Sketch:
    words = text.encode().lower().split() if text else []
    return Sketch.of(_shingles(_word_hashes(words, {} if cache is None else cache)) if words else np.zeros(0, np.uint32))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint): one row per input row; NULL is the empty text, whose sketch is empty."""

    def run(batches):
        cache: dict[bytes, int] = {}
        for batch in batches:
            found = [sketch(t, cache).text() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], [id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, fingerprint string")


_SCHEMA = "doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double"



def _place(key: Column, cuts: list[Column]) -> Column:
    """How many of the sorted cuts are below key, by halving."""
    held, steps = F.array(*cuts), []
    size = 1 << (len(cuts).bit_length() - 1)
    while size:
        steps.append(F.lit(size))
        size //= 2

    def step(at, size):
        return at + F.when((at + size <= len(cuts)) & (F.try_element_at(held, F.least(at + size, F.lit(len(cuts)))) < key), size).otherwise(0)

    return F.aggregate(F.array(*steps), F.lit(0), step)


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Each document against its edited text and against the next document by ascending id, one row per input row.

    The edited text has its last n/4 code points replaced by the first as many of the next document (all of them,
    where it is shorter); after the last document comes the first. NULL ids come first, repeated ids follow each
    other in the order of a hash of their texts, a NULL text is empty. A single row is its own next; without rows
    there are none. Ids may be of any type that can be ordered. contained_edited: the share of the shorter of text and
    edited text that the longer has, NULL where that is unknown. Other columns of docs are not looked at.

    Rows are dealt by ranges of (id, hash of the text, row number), so also rows that share an id are spread; the text
    moves once, to its range. The first row of each range also goes to the range before, as that range's last "next":
    one more row per range, so no task needs another's.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    spot = F.xxhash64(F.monotonically_increasing_id())
    named = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"), spot.alias("s"))
    ordered = F.struct(F.col("id").isNotNull().alias("named"), "id", "h", "s")
    keys = stored(named.select(ordered.alias("key")), "sketch-keys")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 4 * parts
    n = keys.count()
    # about _SPOTS keys for each range, whatever the table's size: ranges differ a little in size, results don't
    chosen = keys.where(F.pmod(F.xxhash64(F.lit("cut"), "key.id", "key.s"), F.lit(1 << 30)) * F.lit(float(n)) <= float(ranges * _SPOTS << 30)).orderBy("key").collect()
    cuts = [chosen[len(chosen) * k // ranges].key for k in range(1, ranges)] if chosen else []
    literal = lambda r: F.struct(F.lit(r.named).alias("named"), F.lit(r.id).cast(kind).alias("id"), F.lit(r.h).alias("h"), F.lit(r.s).alias("s"))
    place = _place(F.col("key"), [literal(r) for r in cuts]) if cuts else F.lit(0)
    heads = {r.place: r.head for r in keys.select("key", place.alias("place")).groupBy("place").agg(F.min("key").alias("head")).collect()}
    if not heads:
        return spark.createDataFrame([], _SCHEMA.format(kind=kind)).withColumnRenamed("doc_id", id_col)
    full = sorted(heads)
    before = {full[k]: full[k - 1] for k in range(len(full))}
    held = spark.createDataFrame([(p, heads[p], before[p]) for p in full], f"place int, head struct<named:boolean,id:{kind},h:long,s:long>, before int")
    # one row per range: as many as the parameter says
    marked = named.withColumn("key", ordered).withColumn("place", place).join(F.broadcast(held), "place")
    own = F.struct(F.col("place"), F.lit(0).alias("turn"))
    other = F.struct(F.col("before").alias("place"), F.lit(1).alias("turn"))
    to = F.when(F.col("key").eqNullSafe(F.col("head")), F.array(own, other)).otherwise(F.array(own))
    dealt = marked.select("id", "text", "h", "s", F.explode(to).alias("to")).select(F.col("to.place").alias("place"), F.col("to.turn").alias("turn"), "id", "text", "h", "s")
    sorted_rows = dealt.repartition(parts, "place").sortWithinPartitions("place", "turn", "id", "h", "s")

    def run(batches):
        cache: dict[bytes, int] = {}
        columns: list[list] = [[] for _ in range(8)]
        held = None
        ended = False

        def done(row, after) -> None:
            (doc, text, mine), (_, next_text, theirs) = row, after
            n = len(text)
            cut = n // 4
            edited = text[: n - cut] + next_text[:cut] if cut else text
            changed = sketch(edited, cache) if cut else mine
            inside = mine.contained(changed) if n <= len(edited) else changed.contained(mine)
            values = (doc, n, hashlib.sha256(edited.encode()).hexdigest(), mine.text(), changed.text(), mine.likeness(changed), mine.likeness(theirs), inside)
            for column, v in zip(columns, values):
                column.append(v)

        def whole() -> None:
            if held is not None and not ended:
                raise RuntimeError("the rows of docs came in another order when they were read again")

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.string()) for c in columns[2:5]), *(pa.array(c, pa.float64()) for c in columns[5:])], names)
            for c in columns:
                c.clear()
            return rows

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited"]
        id_type, at = None, None
        for batch in batches:
            id_type = batch.column(2).type
            for p, turn, doc, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if p != at:
                    whole()
                    at, held, ended = p, None, False
                if ended:
                    continue
                now = (doc, text, sketch(text, cache))
                if held is not None:
                    done(held, now)
                held = now
                ended = bool(turn)
                if len(columns[0]) >= 500:
                    yield flush()
        whole()
        if columns[0]:
            yield flush()

    out = sorted_rows.mapInArrow(run, _SCHEMA.format(kind=kind))
    return out.withColumnRenamed("doc_id", id_col)
