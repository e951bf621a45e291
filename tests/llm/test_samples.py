"""Bounded samples are bound by rows, whatever stands under one id; limits are plain quantiles."""

import math
import os
import random
import threading
import time

from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, PlainKneserNey, made
from tidemark.llm import langid, quality, toxicity


def crowded(spark):
    """Two ids that hold hundreds of texts each, among ordinary rows."""
    rows = made(60) + [(7, f"word {k} of many words that differ", "en", "s", 30) for k in range(300)] + [(8, f"wort {k} und noch eins", "de", "s", 30) for k in range(300)]
    return spark.createDataFrame(rows, SCHEMA)


def test_toxicity_sample(spark):
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(60)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(crowded(spark), labels, per_label=5)
    assert len(model.index.ids) == 10 and len(set(model.index.ids)) == 10
    everyone = toxicity.fit(crowded(spark), labels, per_label=1_000)
    assert sorted(everyone.index.ids) == list(range(60))


def test_language_sample(spark):
    sample = langid.sampled(crowded(spark), "doc_id", "text", "lang", 6).collect()
    assert all(sum(r.lang == lang for r in sample) <= 6 for lang in ("en", "de")) and len({(r.id, r.lang) for r in sample}) == len(sample)
    # the choice does not depend on how the rows are dealt
    again = langid.sampled(crowded(spark).repartition(7), "doc_id", "text", "lang", 6).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, sample))


def test_quality_sample(spark):
    docs = crowded(spark)
    ids = docs.select(F.col("doc_id").alias("id")).distinct()
    bound = quality.trusted_sample(docs, ids, "doc_id", "text", "lang", most_documents=10).collect()
    assert all(sum(r.lang == lang for r in bound) <= 10 for lang in ("en", "de"))
    whole = quality.trusted_sample(docs, ids, "doc_id", "text", "lang", None, None)
    left = ids.where(F.pmod(F.xxhash64(F.lit("limits"), "id"), F.lit(quality.LEFT_ONE_IN)) != 0)
    assert {(r.id, r.lang) for r in whole.collect()} == {(r.doc_id, r.lang) for r in docs.join(left.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").collect()}


def test_quality_limits_are_quantiles(spark):
    docs = spark.createDataFrame(made(420), SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 != 3), 0) for i in range(420)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.run(docs, labels).collect()}
    trusted = labels.where("quality = 1").select(F.col("doc_id").alias("id"))
    taught = {r.id for r in quality.trusted_sample(docs, trusted, "doc_id", "text", "lang").collect()}
    mean = {i: (math.log10(r.perplexity), r.n_tokens, r.lang) for i, r in found.items() if i < 420 and i % 4 != 3 and i not in taught}
    every = sum(m for m, _, _ in mean.values()) / len(mean)
    usual = {lang: sum(m for m, _, x in mean.values() if x == lang) / max(1, sum(x == lang for _, _, x in mean.values())) for lang in ("en", "de")}
    bins = sorted((math.ceil(((m * (n + 1) + quality.PULL * usual.get(lang, every)) / (n + 1 + quality.PULL)) / quality.STEP), lang) for m, n, lang in mean.values())
    assert sum(lang == "en" for _, lang in bins) >= quality.LEAST_TRUSTED > sum(lang == "de" for _, lang in bins)

    def limit(own):
        return next(b for k, b in enumerate(own, 1) if k >= quality.KEPT_SHARE * len(own)) * quality.STEP

    want = {"en": limit([b for b, lang in bins if lang == "en"]), "de": limit([b for b, _ in bins])}
    # a mean at the edge of a bin can fall to either side
    assert all(abs(math.log10(r.limit) - want[r.lang]) <= 1.001 * quality.STEP for r in found.values())
    kept = [r for r in found.values() if r.keep]
    assert 0 < len(kept) and all((math.log10(r.perplexity) * (r.n_tokens + 1) + quality.PULL * usual[r.lang]) / (r.n_tokens + 1 + quality.PULL) <= math.log10(r.limit) + 1e-9 for r in kept)


def test_quality_learns_from_all_trusted_rows(spark):
    """Long texts among many languages, and all the texts of an id: counts are those of every trusted row that is not left for the limits."""
    rows = [(k, f"alpha beta w{k} gamma alpha", f"l{k}", "s", 1) for k in range(150)] + [(500 + k, " ".join(f"r{k}x{j % 700}" for j in range(1800)), "l1", "s", 1) for k in range(8)]
    rows += [(i, f"beta gamma v{k}", "l1", "s", 1) for i in range(8) for k in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = docs.select("doc_id", F.lit(1).alias("quality")).distinct()
    taught = [r.text for r in docs.where(F.pmod(F.xxhash64(F.lit("limits"), "doc_id"), F.lit(quality.LEFT_ONE_IN)) != 0).collect()]
    assert any(len(t) > 5_000 for t in taught)
    plain = PlainKneserNey(taught)
    got = sorted((r.doc_id, r.n_tokens, round(math.log10(r.perplexity), 9)) for r in quality.run(docs, labels).collect())
    assert got == sorted((i, len(t.split()), round(plain.mean(t), 9)) for i, t, *_ in rows)


def test_quality_deals_hot_words_in_turns(spark, monkeypatch):
    """Many parts in three turns, words dealt to several parts, words and long words that no task knows by number, and rows as often as they stand."""
    monkeypatch.setattr(quality, "PART_WORDS", 60)
    monkeypatch.setattr(quality, "LOT_BYTES", 2_000)
    rng = random.Random(5)
    words = ["the"] * 12 + ["of"] * 6 + [f"w{k}" for k in range(40)] + ["x" * 64, "x" * 65, "y" * 300, "\u00c9t\u00e9"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), "en", "s", 1) for i in range(150)] + [(3, "the of the of", "en", "s", 1)] * 3 + [(7, None, "de", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(150)], "doc_id long, quality int")
    taught = {r.doc_id for r in labels.where("quality = 1").where(F.pmod(F.xxhash64(F.lit("limits"), "doc_id"), F.lit(quality.LEFT_ONE_IN)) != 0).collect()}
    plain = PlainKneserNey([t or "" for i, t, *_ in rows if i in taught])
    lower = lambda t: "".join(c.lower() if c < "\x80" else c for c in t)
    for known in (quality.FREQUENT_GRAMS, 5):
        words = quality._frequent(docs.select("text"), known)
        assert words.turns == quality.TURNS and (words.dealt > 1).sum() > 1
    plain = PlainKneserNey([lower(t or "").replace("\u00c9", "\u0178\u0178") for i, t, *_ in rows if i in taught])
    want = sorted((i, len((t or "").split()), round(plain.mean(lower(t or "").replace("\u00c9", "\u0178\u0178")), 8)) for i, t, *_ in rows if (t or "").split())
    got = sorted((r.doc_id, r.n_tokens, round(math.log10(r.perplexity), 8)) for r in quality.run(docs, labels).collect() if r.n_tokens)
    assert got == want


def test_quality_stays_within_its_disk(spark):
    """Shuffle files and written tables at any moment are less than three times the text; a row for each trigram took twelve times."""
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{int(4_000 * rng.random() ** 3)}" for _ in range(600)), "en", "s", 1) for i in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2).cache()
    text = docs.agg(F.sum(F.length("text"))).first()[0]
    dirs = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()] + [quality.stored(docs.limit(1), "probe").__dict__["_stored_at"].removeprefix("file:").rsplit("/", 1)[0]]
    most, ended = [], threading.Event()

    def used():
        total = 0
        for top in dirs:
            for d, _, names in os.walk(top):
                for x in names:
                    try:
                        total += os.lstat(os.path.join(d, x)).st_size
                    except FileNotFoundError:
                        pass
        return total

    def watch():
        while not ended.is_set():
            most.append(used())
            time.sleep(0.1)

    before = used()
    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        assert quality.run(docs, docs.select("doc_id", F.lit(1).alias("quality"))).count() == len(rows)
    finally:
        ended.set()
        watcher.join()
        docs.unpersist()
    assert max(most) - before < 3 * text, (max(most) - before) / text
