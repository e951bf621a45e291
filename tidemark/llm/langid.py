"""Language identification by the nearest of several centroids per language.

A text becomes a unit vector of hashed letter trigrams (non-letters of ASCII are blanks, runs of blanks one), with
weights (1 + ln count) * idf. The rows of each language in a bounded sample are clustered by spherical k-means; a
text gets the language of the centroid with the largest cosine. It is rejected where that cosine is further from
the centroids than nearly all of the language's sample: below its REJECT_QUANTILE times REJECT_SLACK.

The sample: at most `per_language` labelled rows of each language, those with the smallest hash of the id. Its text
is the only text that moves between tasks. The model has languages * CLUSTERS * DIMENSIONS numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Shipped, map_batches, remainder, smallest_by_hash, stored

DIMENSIONS = 8192
CLUSTERS = 4
PER_LANGUAGE = 600
REJECT_QUANTILE, REJECT_SLACK = 0.05, 0.25
#: a cluster with a smaller share of its language's sample is a few wrongly labelled rows, not a way to write it
LEAST_SHARE = 0.02
TEMPERATURE = 0.03
UNKNOWN = "und"

_SHIFT = np.uint32(32 - DIMENSIONS.bit_length() + 1)
_LUT = np.array([c | 0x20 if chr(c).isalpha() and c < 128 else c if c >= 128 else 0x20 for c in range(256)], np.uint32)


def trigram_counts(text: str) -> np.ndarray:
    """Counts of the hashed trigrams of a text, in DIMENSIONS places."""
    codes = _LUT[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0x20) | (codes[:-1] != 0x20)
    codes = codes[keep]
    if len(codes) < 3:
        return np.zeros(DIMENSIONS, np.int64)
    grams = codes[:-2] << np.uint32(16) | codes[1:-1] << np.uint32(8) | codes[2:]
    return np.bincount((grams * np.uint32(2654435761)) >> _SHIFT, minlength=DIMENSIONS)


def _vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for k, text in enumerate(texts):
        counts = trigram_counts(text)
        at = np.flatnonzero(counts)
        out[k, at] = (1 + np.log(counts[at])) * idf[at]
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=out, where=norms > 0)


def _clustered(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids by spherical k-means, begun near the mean and then at the rows furthest from what there is; tiny clusters are dropped."""
    mean = x.mean(axis=0)
    first = x[np.argmax(x @ mean)]
    centroids = [first]
    while len(centroids) < min(k, len(x)):
        centroids.append(x[np.argmin((x @ np.array(centroids).T).max(axis=1))])
    c = np.array(centroids)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    members = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c))
    return c[(members >= LEAST_SHARE * len(x)) | (members == members.max())]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: the language of each centroid, as its place in `languages`
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores (0 to 1), cosines and rejections."""
        n = len(texts)
        names, score, cosine, rejected = [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        lettered = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not self.languages or not lettered:
            return names, score, cosine, rejected
        for begin in range(0, len(lettered), 256):
            at = lettered[begin : begin + 256]
            similar = _vectors([texts[k] for k in at], self.idf) @ self.centroids.T
            best = np.full((len(at), len(self.languages)), -1.0)
            for j, lang in enumerate(self.owner):
                best[:, lang] = np.maximum(best[:, lang], similar[:, j])
            top = best.argmax(axis=1)
            cosine[at] = np.clip(best.max(axis=1), 0, 1)
            score[at] = 1 / np.exp((best - best.max(axis=1, keepdims=True)) / TEMPERATURE).sum(axis=1)
            rejected[at] = cosine[at] < self.floors[top]
            for k, lang in zip(at, top):
                names[k] = self.languages[lang]
        return names, score, cosine, rejected


def sampled(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """(id, lang, text), written: at most per_language rows of each language."""
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # ids are chosen first, so that no text but the sample's is moved; the choice has at most per_language rows a language
    chosen = smallest_by_hash(known.select("id", "lang"), "lang", per_language, "id").distinct()
    first = known.join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"))
    return stored(first.select("id", "lang", "first.text"), "langid-sample")


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS) -> Model:
    """A model of the rows with a language and a text. Without any, the model knows no language and rejects all.

    An id gives one row of each of its languages, the text with the smallest hash, so the bound holds for rows too and
    repeated rows count once. Equal hashes fall in the order of ids. Rows with a NULL id are not in the sample. Very long
    texts are read whole; other columns are not looked at.
    """
    sample = sampled(labelled, id_col, text_col, lang_col, per_language)

    def frequency(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(DIMENSIONS, np.int64)
        for t in pdf.text:
            seen += trigram_counts(t) > 0
        return pd.DataFrame({"n": [len(pdf)], "seen": [seen.tolist()]})

    parts = sample.groupBy("lang").applyInPandas(frequency, "n long, seen array<long>").collect()
    if not parts:
        return Model((), np.zeros(0, int), np.zeros((0, DIMENSIONS), np.float32), np.zeros(DIMENSIONS, np.float32), np.zeros(0))
    total, seen = sum(p.n for p in parts), np.sum([p.seen for p in parts], axis=0)
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _vectors(pdf.sort_values("id").text.tolist(), idf)
        x = x[np.linalg.norm(x, axis=1) > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "floor": [], "c": []})
        c = _clustered(x, clusters)
        floor = np.quantile((x @ c.T).max(axis=1), REJECT_QUANTILE) * REJECT_SLACK
        return pd.DataFrame({"lang": [pdf.lang.iloc[0]] * len(c), "floor": [float(floor)] * len(c), "c": [v.astype("<f4").tobytes() for v in c]})

    rows = sorted(sample.groupBy("lang").applyInPandas(centroids, "lang string, floor double, c binary").collect(), key=lambda r: r.lang)
    languages = tuple(sorted({r.lang for r in rows}))
    place = {lang: k for k, lang in enumerate(languages)}
    floors = {r.lang: r.floor for r in rows}
    return Model(languages, np.array([place[r.lang] for r in rows], int), np.array([np.frombuffer(r.c, "<f4") for r in rows], np.float32).reshape(-1, DIMENSIONS), idf, np.array([floors[x] for x in languages]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, cosine, rejected), one row per input row; texts that are NULL or have no letter are `und` and rejected.

    Of languages equally near the one that comes first by name is taken. Repeated rows get equal results.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = Shipped(docs.sparkSession, model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, score, cosine, rejected = held.value.predict(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(cosine), pa.array(rejected)], [id_col, "lang_pred", "score", "cosine", "rejected"])

    return map_batches(docs.select(F.col(id_col), F.col(text_col).alias("_text")), work, f"{id_col} {kind}, lang_pred string, score double, cosine double, rejected boolean", "_text")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs, all columns kept, without the rows that the model rejects: NULL texts, those without a letter, and those far from all languages.

    Repeated rows stay or go together; an empty table stays empty.
    """
    held = Shipped(docs.sparkSession, model)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            *_, rejected = held.value.predict(batch.column(place).to_pylist())
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str | Column = "doc_id") -> Column:
    return F.coalesce(remainder(id_col, 4) == 2, F.lit(False))


def run(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cosine, rejected), one row per input row; learns from rows that are not held out.

    A NULL id is not held out and teaches nothing. Only the text is looked at to predict.
    """
    model = fit(docs.where(~held_out()))
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "cosine", "rejected")
