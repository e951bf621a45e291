"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fitting takes a bounded sample: at most `per_label` labelled rows of each label, those with the smallest hash of the
id. Terms are all words of the sample (lower-cased, outer punctuation cut off). A term's weight in a text is
(1 + ln n) * idf * gain, where gain = chi2 / (chi2 + HALF_GAIN) says how well the term tells the labels apart: with
idf alone a few telling words drown in a long text. Examples are unit vectors, kept in blocks of BLOCK alike ones. For
each term the index has the largest weight in each block; a block whose bound does not reach the k-th best cosine so
far is not opened, so the k nearest are exact. Neighbours vote with the inverse of their distance and their label's
share of all labelled rows to the sample's; votes become probabilities by a monotone fit to the sample's own
leave-one-out votes.

A text without any word of the sample has no direction: it gets the share of label 1 among examples without words,
or among all labelled rows where there are none.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Shipped, map_batches, remainder, smallest_by_hash, stored

PER_LABEL = 1500
#: the chi-square at which a term has half of the weight that idf gives it
HALF_GAIN = 20.0
BLOCK = 64
#: blocks opened before any is left out
FIRST_BLOCKS = 4
NEIGHBOURS = 15
CLOSENESS = 0.05
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def term_counts(text: str | None) -> Counter[str]:
    """How often each word stands in a text."""
    found = Counter((text or "").lower().split())
    for word in [w for w in found if not w.isalnum()]:
        n = found.pop(word)
        if term := _EDGE.sub("", word):
            found[term] += n
    return found


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, .. for size[0] numbers, then the same of the next."""
    if not len(size):
        return np.zeros(0, np.int64)
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Index:
    """Examples by term and block, with the largest weight of every term in every block."""

    def __init__(self, terms: dict[str, int], worth: np.ndarray, examples: list[Counter[str]], ids: list, labels: np.ndarray, weights: np.ndarray):
        self.terms, self.worth = terms, worth
        vectors = [self.unit(c) for c in examples]
        # alike vectors stand together: by their heaviest terms
        order = sorted(range(len(vectors)), key=lambda k: (vectors[k][0][np.argsort(-vectors[k][1], kind="stable")[:3]].tolist(), k))
        self.ids, self.labels, self.weights = [ids[k] for k in order], labels[order], weights[order]
        self.vectors = [vectors[k] for k in order]
        self.blocks = -(-len(order) // BLOCK)
        sizes = np.array([len(t) for t, _ in self.vectors], np.int64)
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in self.vectors)])
        weight = np.concatenate([np.zeros(0), *(w for _, w in self.vectors)])
        place = np.repeat(np.arange(len(order)), sizes)
        by_term = np.lexsort((place, term))
        self.place, self.weight = place[by_term], weight[by_term]
        # one cell for each term and block where the term stands
        cell = term[by_term] * max(self.blocks, 1) + self.place // BLOCK
        begins = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cell_block = cell[begins] % max(self.blocks, 1)
        self.cell_most = np.maximum.reduceat(self.weight, begins) if len(begins) else np.zeros(0)
        self.cell_begin = np.append(begins, len(cell))
        self.term_begin = np.searchsorted(cell[begins] // max(self.blocks, 1), np.arange(len(terms) + 1))

    def unit(self, counts: Counter[str]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights of a text's unit vector; words that the sample lacks have no part in it."""
        get = self.terms.get
        at = np.array([get(word, -1) for word in counts], np.int64)
        n = np.array(list(counts.values()), float)
        known = at >= 0
        at = at[known]
        raw = (1 + np.log(n[known])) * self.worth[at]
        # numbered by term, so that a text's words can come in any order
        order = np.argsort(at)
        at, raw = at[order], raw[order]
        norm = float(np.sqrt(raw @ raw))
        return (at[raw > 0], raw[raw > 0] / norm) if norm else (at[:0], raw[:0])

    def nearest(self, vector: tuple[np.ndarray, np.ndarray], k: int = NEIGHBOURS, but: int = -1) -> list[tuple[float, int]]:
        """The k examples of the largest positive cosine, (cosine, place); of equal ones those that the index has first."""
        at, w = vector
        n = self.term_begin[at + 1] - self.term_begin[at]
        cells, held = _ranges(self.term_begin[at], n), np.repeat(w, n)
        block = self.cell_block[cells]
        bound = np.bincount(block, held * self.cell_most[cells], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best: list[tuple[float, int]] = []
        for opened in (order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]):
            if len(best) == k:
                opened = opened[bound[opened] >= best[-1][0] - 1e-9]
            if not len(opened):
                break
            chosen = np.zeros(self.blocks, bool)
            chosen[opened] = True
            inside = chosen[block]
            begin = self.cell_begin[cells[inside]]
            sizes = self.cell_begin[cells[inside] + 1] - begin
            posts = _ranges(begin, sizes)
            score = np.round(np.bincount(self.place[posts], np.repeat(held[inside], sizes) * self.weight[posts], len(self.ids)), 12)
            if but >= 0:
                score[but] = 0.0
            found = np.flatnonzero(score > 0)
            if len(found) > k:
                # ties at the edge stay
                found = found[score[found] >= np.partition(score[found], -k)[-k]]
            best = sorted([*best, *zip(score[found].tolist(), found.tolist())], key=lambda x: (-x[0], x[1]))[:k]
        return best

    def vote(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return 0.0
        weight = np.array([self.weights[p] / (1 - min(c, 1.0) + CLOSENESS) for c, p in near])
        return float(weight @ self.labels[[p for _, p in near]] / weight.sum())


def _monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit by pooling neighbours that go down: places and values."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for k in order:
        pools.append([x[k], x[k], y[k] * w[k], w[k]])
        while len(pools) > 1 and (pools[-2][1] == pools[-1][0] or pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]):
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    at = np.array([v for p in pools for v in (p[0], p[1])])
    value = np.array([p[2] / p[3] for p in pools for _ in range(2)])
    return at, value


class Model:
    def __init__(self, index: Index | None, blank: float):
        self.index, self.blank = index, blank
        self.at, self.value = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        self.seen: dict[bytes, tuple[float, list]] = {}
        full = [k for k, (t, _) in enumerate(index.vectors) if len(t)] if index is not None else []
        if full:
            votes = np.array([index.vote(index.nearest(index.vectors[k], but=k)) for k in full])
            self.at, self.value = _monotone(np.append(votes, [0.0, 1.0]), np.append(index.labels[full], [0.0, 1.0]), np.append(index.weights[full], [1.0, 1.0]))

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        if self.index is None or not text:
            return self.blank, []
        # copies are common
        key = xxhash.xxh3_128_digest(text)
        if key not in self.seen:
            near = self.index.nearest(self.index.unit(term_counts(text)))
            found = self.blank if not near else float(np.interp(self.index.vote(near), self.at, self.value)), [{"example": self.index.ids[p], "cosine": c, "label": int(self.index.labels[p])} for c, p in near[:3]]
            if len(self.seen) > 50_000:
                self.seen.clear()
            self.seen[key] = found
        return self.seen[key]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> Model:
    """A model of the labelled documents.

    Rows with a NULL id or label and labels without a document are left out. Repeated rows of either table count once;
    an id with several texts gives one example, the text with the smallest hash, so the bound holds for rows too; an id
    with both labels gives one of each label. Equal hashes fall in
    the order of ids. Without any example the model scores everything 0. Other columns are not looked at.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) != 0).cast("int").alias("label")).distinct()
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = smallest_by_hash(known, "label", per_label, "id")
    # at most per_label rows of each of two labels, also where an id has many texts
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    sample = texts.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")).select("id", "label", "first.h", "first.text")

    def words(batches):
        for pdf in batches:
            counts = [term_counts(t) for t in pdf.text]
            yield pd.DataFrame({"id": pdf.id, "label": pdf.label, "h": pdf.h, "terms": [list(c) for c in counts], "ns": [list(c.values()) for c in counts]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = stored(sample.mapInPandas(words, f"id {kind}, label int, h long, terms array<string>, ns array<int>"), "toxic-examples")
    # the bounded sample
    held = rows.orderBy("id", "label", "h").collect()
    if not held:
        return Model(None, 0.0)
    examples = [Counter(dict(zip(r.terms, r.ns))) for r in held]
    labels_of = np.array([r.label for r in held], float)
    size = Counter(r.label for r in held)
    weights = np.array([totals[r.label] / size[r.label] for r in held])
    seen = {c: Counter() for c in (0, 1)}
    for r in held:
        seen[r.label].update(r.terms)
    terms = {t: k for k, t in enumerate(sorted(seen[0].keys() | seen[1].keys()))}
    a, b = (np.array([seen[c][t] for t in terms], float) for c in (1, 0))
    n1, n0 = size.get(1, 0), size.get(0, 0)
    n = n1 + n0
    chi2 = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum((a + b) * (n - a - b) * max(n1 * n0, 1), 1.0)
    worth = (1 + np.log(n / np.maximum(a + b, 1))) * chi2 / (chi2 + HALF_GAIN)
    index = Index(terms, worth, examples, [r.id for r in held], labels_of, weights)
    mass = np.array([weights[[k for k, r in enumerate(held) if r.label == c and not r.terms]].sum() for c in (0, 1)])
    return Model(index, float((mass[1] + totals.get(1, 0) / sum(totals.values())) / (mass.sum() + 1)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, evidence), one row per input row; evidence: the three nearest examples.

    NULL and empty texts and those without a known word have no evidence and the model's score for blank texts. Of
    equally near examples those that stand first in the index count; repeated rows get equal scores.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = Shipped(docs.sparkSession, model)
    evidence = f"array<struct<example:{kind},cosine:double,label:int>>"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [held.value.score(t) for t in batch.column(1).to_pylist()]
        near = pa.array([e for _, e in found], pa.list_(pa.struct([("example", batch.column(0).type), ("cosine", pa.float64()), ("label", pa.int32())])))
        scores = np.array([s for s, _ in found])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), near], [id_col, "score", "predicted", "evidence"])

    return map_batches(docs.select(F.col(id_col), F.col(text_col).alias("_text")), work, f"{id_col} {kind}, score double, predicted int, evidence {evidence}", "_text")


def held_out(id_col: str | Column = "doc_id") -> Column:
    return F.coalesce(remainder(id_col, 5) == 0, F.lit(False))


def run(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence), one row per row of docs; learns labels of rows that are not held out.

    A NULL id is not held out and has no label. Repeated rows change no score. Nothing but the text is looked at to score.
    """
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted", "evidence")
