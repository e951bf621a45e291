"""A hidden Markov language model: Baum-Welch over all training documents, exact likelihoods by scaled forward recursion.

Every word has one class. A word that makes up at least 1 / MOST_FREQUENT of the training tokens is a class of its own
(there cannot be more than MOST_FREQUENT of these); any other falls into one of SPELLINGS classes by its last letters.
A state emits a class, and the class a word with probability (c + 1) / (N_class + V_class + 1), so a word never seen
has a probability too and each text's likelihood is that of a proper model. States and classes are a few megabytes
at any size of the corpus; the word counts are a distributed table, joined where they are needed.

Steps:
1. Blocks. Each task cuts its documents into blocks of bounded size, and writes for each block its distinct words
   with their counts and its documents as numbers of those words.
2. Counts. Words are summed by word, partially in each task first; every (block, word) gets the corpus count and the
   class back, frequent words from a table of at most MOST_FREQUENT rows, so no word has many rows in one task.
3. Each block becomes its documents as classes, with the counted part of every document's score.
4. Baum-Welch: each round, every task turns its blocks into expected counts, which are summed over tasks. Where EM
   begins decides which optimum it finds, and that takes many small steps: the training documents are dealt by a hash
   of id and text to at most PARTS parts, and each early round runs over the next part, in whole sweeps of at least
   EARLY_ROUNDS rounds, so every document is learnt from in every sweep. The last ROUNDS rounds run over all of them.
5. Forward recursion over every document.

Blocks only say what is worked on together: results do not depend on how the documents are laid out.

Long documents cost no more than short ones: recursion runs over chunks of CHUNK tokens side by side. For each chunk
the product of its K x K matrices is formed first; with these the state at each chunk's beginning (and the backward
weight at its end) follows exactly, and then all chunks run at once from their true boundaries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.storage import discard
from tidemark.llm.common import Shipped, byte_texts, remainder, slices, stored, tokens

STATES = 4
ROUNDS = 3
MOST_FREQUENT = 20_000
SPELLINGS = 2_048
CHUNK = 128
#: steps between two scalings: probabilities of so many tokens are far from the least double
SCALED = 8
BLOCK_BYTES = 6 << 20
#: how much the corpus's class shares weigh in each state's emissions, in tokens
EMISSION_PRIOR = 50.0
#: the least number of rounds over one part after the other; a part has EARLY_TOKENS tokens or more
EARLY_ROUNDS, PARTS, EARLY_TOKENS = 20, 32, 150_000
_SPOTS = 1 << 16

_BLOCK = "block long, ids array<{kind}>, train array<boolean>, spots array<int>, sizes array<int>, codes binary, words array<binary>, counts array<int>"


def _packed(numbers: np.ndarray) -> bytes:
    """Word numbers, frequent ones small, as two compressed planes."""
    n = numbers.astype(np.uint32)
    planes = (n & 0xFFFF).astype("<u2").tobytes() + (n >> 16).astype("<u2").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpacked(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // 4
    return np.frombuffer(raw, "<u2", n).astype(np.int64) | np.frombuffer(raw, "<u2", n, 2 * n).astype(np.int64) << 16


def _blocks(docs: DataFrame, kind: str) -> DataFrame:
    """(id, text, train, spot) to one row per block; a block's number is its task's and its own within the task. To be stored at once."""

    def run(batches):
        import pyarrow.compute  # noqa: F401
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", BLOCK_BYTES):
            found = [tokens(t) for t in byte_texts(batch.column(1))]
            train = batch.column(2).to_pylist()
            every = [w for d in found for w in d]
            place = dict.fromkeys(every)
            for j, w in enumerate(place):
                place[w] = j
            numbers = np.fromiter(map(place.__getitem__, every), np.int64, len(every))
            sizes = np.array([len(d) for d in found], np.int64)
            in_train = np.repeat(np.array(train, bool), sizes)
            order = np.argsort(-np.bincount(numbers, minlength=len(place)), kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            words = list(place)
            counts = np.bincount(numbers[in_train], minlength=len(place)) if len(place) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([part << 32 | k], pa.int64()),
                    "ids": pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), batch.column(0)),
                    "train": pa.array([train], pa.list_(pa.bool_())),
                    "spots": pa.array([batch.column(3).to_pylist()], pa.list_(pa.int32())),
                    "sizes": pa.array([sizes.tolist()], pa.list_(pa.int32())),
                    "codes": pa.array([_packed(rank[numbers] if len(numbers) else numbers)], pa.binary()),
                    "words": pa.array([[words[j] for j in order]], pa.list_(pa.binary())),
                    "counts": pa.array([counts[order].tolist()], pa.list_(pa.int32())),
                }
            )
            k += 1

    return docs.mapInArrow(run, _BLOCK.format(kind=kind))


@dataclass
class Model:
    """Class 0 is the end of a text, 1 .. F the frequent words, the rest spellings."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x classes

    @classmethod
    def begun(cls, shares: np.ndarray, states: int, seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        move = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        emit = shares * rng.uniform(0.5, 1.5, (states, len(shares)))
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))

    def updated(self, counts: Counts, shares: np.ndarray) -> Model:
        start = counts.start + 1.0
        move = counts.move + 1.0
        emit = counts.emit + EMISSION_PRIOR * shares
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


@dataclass
class Counts:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


class Chunks:
    """Documents (runs of classes) laid out as columns of at most CHUNK tokens, longest first: the live ones of a step are the first."""

    def __init__(self, classes: np.ndarray, sizes: np.ndarray):
        self.docs = len(sizes)
        per = -(-sizes // CHUNK)
        first = np.cumsum(per) - per
        owner = np.repeat(np.arange(self.docs), per)
        place = np.arange(len(owner)) - first[owner]
        length = np.minimum(sizes[owner] - place * CHUNK, CHUNK)
        order = np.argsort(-length, kind="stable")
        self.owner, self.place, self.length = owner[order], place[order], length[order]
        begin = (np.cumsum(sizes) - sizes)[self.owner] + self.place * CHUNK
        self.live = np.searchsorted(-self.length, -np.arange(CHUNK), side="left")
        at = np.minimum(begin + np.arange(CHUNK)[:, None], len(classes) - 1)
        self.classes = classes[at]
        # columns by how far into their document they are: the boundary recursion takes one step over all documents
        order = np.argsort(self.place, kind="stable")
        edges = np.searchsorted(self.place[order], np.arange(self.place.max() + 2)) if len(order) else np.zeros(1, int)
        self.steps = [order[a:b] for a, b in zip(edges, edges[1:])]

    def products(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """For every chunk the product of its steps (start x end states), scaled, and the log10 of the scale.

        The first step of a document begins with the start distribution, which the boundary supplies: a step is
        `state @ move * emission`, and a document's boundary state is one whose move gives the start distribution.
        """
        n, k = len(self.owner), len(model.start)
        emit = model.emit.T.copy()
        product = np.broadcast_to(np.eye(k), (n, k, k)).copy()
        scale = np.zeros(n)
        for t, m in enumerate(self.live):
            if not m:
                break
            moved = (product[:m].reshape(-1, k) @ model.move).reshape(m, k, k)
            if t == 0:
                # a document's first chunk: rows all hold the start distribution
                moved[self.place[:m] == 0] = model.start
            np.multiply(moved, emit[self.classes[t, :m]][:, None, :], out=product[:m])
            if t % SCALED == SCALED - 1 or t == CHUNK - 1:
                self._scale(product[:m], scale[:m])
        self._scale(product, scale)
        return product, scale

    @staticmethod
    def _scale(product: np.ndarray, scale: np.ndarray) -> None:
        size = product.max(axis=(1, 2))
        product /= size[:, None, None]
        scale += np.log10(size)

    def forward_bounds(self, product: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State distribution before every chunk, and the log10 likelihood of every document."""
        n, k = product.shape[:2]
        before = np.full((n, k), 1.0 / k)
        total = np.zeros(self.docs)
        state = np.full((self.docs, k), 1.0 / k)
        for rows in self.steps:
            owner = self.owner[rows]
            before[rows] = state[owner]
            after = np.einsum("ni,nij->nj", state[owner], product[rows])
            size = after.sum(axis=1)
            state[owner] = after / size[:, None]
            total[owner] += np.log10(size) + scale[rows]
        return before, total

    def backward_bounds(self, product: np.ndarray) -> np.ndarray:
        """Backward weights after every chunk, each scaled to a sum of one."""
        n, k = product.shape[:2]
        after = np.full((n, k), 1.0 / k)
        weight = np.full((self.docs, k), 1.0 / k)
        for rows in reversed(self.steps):
            owner = self.owner[rows]
            after[rows] = weight[owner]
            before = np.einsum("nij,nj->ni", product[rows], weight[owner])
            weight[owner] = before / before.sum(axis=1, keepdims=True)
        return after


def log_likelihoods(model: Model, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 P(classes of each document); sizes are positive (every document has its end)."""
    if not len(sizes):
        return np.zeros(0)
    chunks = Chunks(classes, sizes)
    return chunks.forward_bounds(*chunks.products(model))[1]


def expected_counts(model: Model, classes: np.ndarray, sizes: np.ndarray) -> tuple[Counts, float]:
    """What Baum-Welch counts in these documents, and their log10 likelihood."""
    k, c = model.emit.shape
    out = Counts(np.zeros(k), np.zeros((k, k)), np.zeros((k, c)))
    if not len(sizes):
        return out, 0.0
    emit = model.emit.T.copy()
    chunks = Chunks(classes, sizes)
    product, scale = chunks.products(model)
    entry, total = chunks.forward_bounds(product, scale)
    weight = chunks.backward_bounds(product)
    begins = chunks.place == 0
    alpha = np.empty((CHUNK, len(begins), k))
    state = entry
    for t, m in enumerate(chunks.live):
        moved = state[:m] @ model.move
        if t == 0:
            moved[begins] = model.start
        moved *= emit[chunks.classes[t, :m]]
        if t % SCALED == 0:
            moved /= moved.sum(axis=1, keepdims=True)
        state = alpha[t, :m] = moved
    for t in range(CHUNK - 1, -1, -1):
        m = chunks.live[t]
        if not m:
            continue
        told = emit[chunks.classes[t, :m]] * weight[:m]
        before, inner = (alpha[t - 1, :m], slice(None)) if t else (entry, ~begins)
        a, b = before[inner], told[inner]
        out.move += model.move * ((a / ((a @ model.move) * b).sum(axis=1, keepdims=True)).T @ b)
        # from here on alpha holds each step's posterior
        gamma = alpha[t, :m]
        gamma *= weight[:m]
        gamma /= gamma.sum(axis=1, keepdims=True)
        back = told @ model.move.T
        if t % SCALED == 0:
            back /= back.sum(axis=1, keepdims=True)
        weight[:m] = back
    out.start += alpha[0, begins].sum(axis=0)
    inside = np.arange(len(begins)) < chunks.live[:, None]
    seen, posterior = chunks.classes[inside], alpha[inside]
    for j in range(k):
        out.emit[j] = np.bincount(seen, weights=posterior[:, j], minlength=c)
    return out, float(total.sum())


@dataclass(frozen=True)
class Corpus:
    """What training counts: tokens (ends included), distinct tokens, documents, and by class tokens and distinct words."""

    n: int
    v: int
    documents: int
    frequent: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    @property
    def shares(self) -> np.ndarray:
        return (self.class_tokens + 1) / (self.class_tokens.sum() + len(self.class_tokens))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None) -> tuple[DataFrame, Corpus]:
    """Blocks of documents as classes, with the counted parts of their scores, and the corpus's counts.

    train: a boolean column of docs; rows where it is true are learnt from (all rows by default).
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    asked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.lit(True) if train is None else train, F.lit(False)).alias("train"), F.pmod(F.xxhash64(id_col, text_col), F.lit(_SPOTS)).cast("int").alias("spot"))
    blocks = stored(_blocks(asked, kind), "hmm-blocks")
    add = lambda a, x: a + x
    sums = blocks.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), add)).alias("words"), F.sum(F.size(F.filter("train", lambda x: x))).alias("ends")).first()
    words, ends = sums.words or 0, sums.ends or 0
    n = words + ends

    pairs = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("idx", "w")).select("block", "idx", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    counts = stored(pairs.groupBy("word").agg(F.sum("n").alias("c")), "hmm-counts")
    # at most MOST_FREQUENT words
    frequent = counts.where((F.col("c") > 0) & (F.col("c") * MOST_FREQUENT >= n)).orderBy(F.desc("c"), "word").collect()
    table = spark.createDataFrame([(bytes(r.word), k, r.c) for k, r in enumerate(frequent, 1)], "word binary, frequent int, often long")
    spelling = F.pmod(F.xxhash64(F.substring("word", -3, 3)), F.lit(SPELLINGS)).cast("int") + 1 + len(frequent)
    tokens_of, words_of = np.zeros(1 + len(frequent) + SPELLINGS), np.zeros(1 + len(frequent) + SPELLINGS)
    for k, r in enumerate(frequent, 1):
        tokens_of[k], words_of[k] = r.c, 1
    rare = counts.join(F.broadcast(table), "word", "left_anti")
    for r in rare.groupBy(spelling.alias("class")).agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).collect():
        tokens_of[r["class"]], words_of[r["class"]] = r.n, r.v
    tokens_of[0], words_of[0] = ends, float(ends > 0)
    corpus = Corpus(n, int(words_of.sum()), ends, len(frequent), tokens_of, words_of)
    held = Shipped(spark, corpus)
    # a word that is not frequent has at most one row per block, of which frequent words have most of the tokens
    often = pairs.join(F.broadcast(table), "word").select("block", "idx", F.col("often").alias("c"), F.col("frequent").alias("class"))
    seldom = pairs.join(F.broadcast(table), "word", "left_anti").join(rare, "word").select("block", "idx", "c", spelling.alias("class"))
    classed = often.union(seldom)
    schema = f"block long, ids array<{kind}>, train array<boolean>, spots array<int>, sizes array<int>, classes binary, known array<int>, plain array<double>, within array<double>"

    def score(counts: pa.Table, block: pa.Table) -> pa.Table:
        c = held.value
        idx = counts.column("idx").to_numpy()
        count, cls = np.zeros(len(idx)), np.zeros(len(idx), np.int64)
        count[idx], cls[idx] = counts.column("c").to_numpy(), counts.column("class").to_numpy()
        sizes = np.array(block.column("sizes")[0].as_py(), np.int64)
        numbers = _unpacked(block.column("codes")[0].as_py())
        # the end of each document goes behind its words
        ends_at = np.cumsum(sizes)
        with_end = lambda values, end: np.insert(values, ends_at, end)
        classes = with_end(cls[numbers], 0)
        log_count = with_end(np.log10(count[numbers] + 1), np.log10(c.documents + 1))
        room = np.log10(c.class_tokens + c.class_words + 1)
        room[: 1 + c.frequent] = 0
        inside = np.where(classes > c.frequent, log_count - room[classes], 0.0)
        known = with_end(count[numbers] > 0, c.documents > 0)
        begins = ends_at - sizes + np.arange(len(sizes))
        total = lambda values, kind: np.add.reduceat(values.astype(kind), begins) if len(sizes) else np.zeros(0, kind)
        return pa.Table.from_pydict(
            {
                "block": block.column("of"), "ids": block.column("ids"), "train": block.column("train"), "spots": block.column("spots"),
                "sizes": pa.array([(sizes + 1).tolist()], pa.list_(pa.int32())),
                "classes": pa.array([zstandard.ZstdCompressor(level=1).compress(classes.astype("<u2").tobytes())], pa.binary()),
                "known": pa.array([total(known, np.int64).tolist()], pa.list_(pa.int32())),
                "plain": pa.array([total(log_count, float).tolist()], pa.list_(pa.float64())),
                "within": pa.array([total(inside, float).tolist()], pa.list_(pa.float64())),
            }
        )

    left = classed.groupBy("block")
    right = blocks.select(F.col("block").alias("of"), "ids", "train", "spots", "sizes", "codes").groupBy("of")
    out = stored(left.cogroup(right).applyInArrow(score, schema), "hmm-classes")
    discard(blocks, counts)
    return out, corpus


def _rows(batch: pa.RecordBatch):
    """Of every block its number in the batch, its classes and its sizes."""
    for k in range(batch.num_rows):
        held = zstandard.ZstdDecompressor().decompress(batch.column("classes")[k].as_py())
        yield k, np.frombuffer(held, "<u2").astype(np.int64), _list(batch, "sizes", k).astype(np.int64)


def _list(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return batch.column(name)[k].values.to_numpy(zero_copy_only=False)


def _together(batch: pa.RecordBatch, most: int = 1 << 20):
    """(classes, sizes) of rows one after the other, as many at once as have about `most` tokens: a step over few chunks costs as much as one over many."""
    held, n = [], 0
    for _, classes, sizes in _rows(batch):
        if held and n + len(classes) > most:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
        held.append((classes, sizes))
        n += len(classes)
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _taught(batch: pa.RecordBatch):
    """(classes, sizes, spots) of the training documents of each block."""
    for k, classes, sizes in _rows(batch):
        kept = _list(batch, "train", k).astype(bool)
        if kept.any():
            yield classes[np.repeat(kept, sizes)], sizes[kept], _list(batch, "spots", k)[kept]


def _dealt(blocks: DataFrame, parts: int) -> DataFrame:
    """The training documents of every block as one row (classes, sizes, part) for each part that it has documents of."""

    def deal(batches):
        for batch in batches:
            for classes, sizes, spots in _taught(batch):
                for part in np.unique(spots % parts):
                    own = spots % parts == part
                    packed = zstandard.ZstdCompressor(level=1).compress(classes[np.repeat(own, sizes)].astype("<u2").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary()), pa.array([sizes[own].tolist()], pa.list_(pa.int32())), pa.array([part], pa.int32())], ["classes", "sizes", "part"])

    return blocks.select("classes", "sizes", "train", "spots").mapInArrow(deal, "classes binary, sizes array<int>, part int")


def trained(blocks: DataFrame, corpus: Corpus, states: int = STATES, rounds: int = ROUNDS, early_rounds: int = EARLY_ROUNDS) -> Model:
    """Baum-Welch over the training documents of all blocks: early_rounds or more, in whole sweeps over their parts, then `rounds` over all."""
    spark = blocks.sparkSession
    shares = corpus.shares
    model = Model.begun(shares, states)
    if not corpus.documents:
        return model
    parts = min(PARTS, max(1, corpus.n // EARLY_TOKENS))
    held_parts = stored(_dealt(blocks, parts), "hmm-parts", "part")
    sweep = [held_parts.where(F.col("part") == k) for k in range(parts)]

    # sums travel as rows: class numbers for emissions, negative numbers for the start and the moves
    values = [f"v{j}" for j in range(states)]
    schema = ", ".join(["key int", *(f"{v} double" for v in values)])
    for learnt in sweep * -(-early_rounds // parts) + [held_parts] * rounds:
        held = Shipped(spark, model)

        def count(batches, held=held):
            total = None
            for batch in batches:
                for classes, sizes in _together(batch):
                    found, _ = expected_counts(held.value, classes, sizes)
                    total = found if total is None else Counts(total.start + found.start, total.move + found.move, total.emit + found.emit)
            if total is not None:
                full = np.flatnonzero(total.emit.any(axis=0))
                keys = np.concatenate([full, [-1], -2 - np.arange(states)])
                rows = np.vstack([total.emit[:, full].T, total.start[None], total.move])
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), *(pa.array(rows[:, j]) for j in range(states))], ["key", *values])

        sums = learnt.select("classes", "sizes").mapInArrow(count, schema).groupBy("key").agg(*(F.sum(v).alias(v) for v in values)).toArrow()
        keys, rows = sums.column("key").to_numpy(), np.column_stack([sums.column(v).to_numpy() for v in values])
        if not len(keys):
            # a part without documents: with few of them the hash can leave one empty
            continue
        counts = Counts(np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit))
        counts.emit[:, keys[keys >= 0]] = rows[keys >= 0].T
        counts.start = rows[keys == -1].sum(axis=0)
        for j in range(states):
            counts.move[j] = rows[keys == -2 - j].sum(axis=0)
        model = model.updated(counts, shares)
    discard(held_parts)
    return model


def scored(blocks: DataFrame, corpus: Corpus, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score), one row per document."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    held = Shipped(blocks.sparkSession, (corpus, model))

    def run(batches):
        c, m = held.value
        for batch in batches:
            for k, classes, sizes in _rows(batch):
                hidden = log_likelihoods(m, classes, sizes)
                plain, within = _list(batch, "plain", k), _list(batch, "within", k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids")[k].values, batch.column("train")[k].values, pa.array(sizes), batch.column("known")[k].values.cast(pa.int64()),
                        pa.array(np.full(len(sizes), c.n)), pa.array(plain - sizes * np.log10(c.n + c.v + 1)), pa.array(hidden + within),
                    ],
                    [id_col, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return blocks.mapInArrow(run, f"{id_col} {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(remainder(id_col, 7) == 2, F.lit(False))


def run(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    Learns from rows that are not held out; a NULL id is not held out, a NULL text is empty (one end, no words).
    Repeated rows count as often as they stand and get equal scores. A text of any length is scored whole; one longer
    than BLOCK_BYTES is a block of its own. Other columns are not looked at. Without training rows the model is as it
    was begun, and every word is unknown.
    """
    blocks, corpus = counted(docs, train=~held_out())
    out = scored(blocks, corpus, trained(blocks, corpus))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
