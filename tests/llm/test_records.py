"""Manifest, exact dedup and fill-in-the-middle against plain versions, and on odd rows."""

import hashlib
import random
import re
import zlib

import pytest

from tidemark.llm import dedup, fim, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, fim string, digest string, key string"


def made(n, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = "".join(rng.choice(["Word", "word", "x", " ", "\n", "é", "😀", "1", "<", "-"]) for _ in range(rng.randint(0, 300)))
        out.append((i * 3, text, rng.choice(["en", "de", "fr", None]), rng.choice(["a", "b", None]), len(text)))
    return out


ODD = [
    (None, None, None, None, None), (None, None, None, None, None), (None, "", "en", "s", 0), (7001, "", "en", "", 0), (7002, None, "en", "s", None), (7003, " \t\n", "de", "s", 3), (7004, "Tail <P> mark", "en", "s", 13),
    (7005, "A b. " * 20_000, "fr", "s", 100_000), (7006, "Ab", "zz", "s", 2), (7007, "same", "en", "s", 4), (7007, "same", "en", "s", 4), (7007, "other", "en", "s", 5), (None, "same", "en", "s", 4), (7008, "Z" * 5_000, "en", "s", 5_000),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "r", "f", "d", "k") for r in rows], SCHEMA)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Manifest

def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(field(r[0]), field(r[3]), field(r[2]), field(r[4]), field(text))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
        return out

    def steps(tree, i):
        out = []
        for nodes in tree[:-1]:
            begin = i // 8 * 8
            out.append((nodes[begin:i], nodes[i + 1 : begin + 8]))
            i //= 8
        return out

    first = lambda v: (v is not None, v)
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (first(r[0]) if r[0] is not None else (False, 0), leaf(r, r[1]))) for g in langs}
    trees = {g: levels([leaf(r, r[1]) for r in groups[g]]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            path = steps(trees[g], i) + steps(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = re.sub("[A-Z]", lambda m: m[0].lower(), r[1]) if hit and r[1] is not None else r[1]
            now = leaf(r, text)
            for left, right in path:
                now = h(*left, now, *right)
            out.append((r[0], leaf(r, r[1]), trees[g][-1][0], top[-1][0], h(*(x for left, right in path for x in [*left, *right])), now, now == top[-1][0]))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", (0, 1, 9, 600))
def test_manifest(spark, n):
    rows = made(n) + (ODD if n > 60 else [])
    got = merkle.run(table(spark, rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rows_of(got) == sorted(plain_manifest(rows), key=str)


def test_manifest_does_not_depend_on_partitions(spark):
    rows = [(*r[:2], "en" if i % 3 else "de", *r[3:]) for i, r in enumerate(made(700))]
    want = {r[0]: r for r in plain_manifest(rows)}
    for parts in (1, 5, 40):
        trees, roots = merkle.manifest(table(spark, rows), parts=parts)
        assert roots.roots.first().digest.hex() == want[0][3]
        # every level above the leaves is there once
        sizes = {r.of: r.n for r in trees.roots.collect()}
        got = {(r.of, r.level): r["count"] for r in trees.nodes.groupBy("of", "level").count().collect()}
        for of, n in sizes.items():
            level = 0
            while n > 1:
                n, level = -(-n // 8), level + 1
                assert got[of, level] == n
        paths = {r.id: r for r in trees.paths().collect()}
        assert all(merkle.fold(bytes(p.digest), [s.asDict() for s in p.steps]).hex() == want[i][2] for i, p in paths.items())


def test_stack_and_climb_agree_with_a_plain_tree():
    leaves = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(1_000)]
    whole = [leaves]
    while len(whole[-1]) > 1:
        whole.append([merkle.digest_of(whole[-1][k : k + 8]) for k in range(0, len(whole[-1]), 8)])
    for begin, end in ((0, 1_000), (0, 3), (5, 7), (5, 600), (64, 512), (999, 1_000), (7, 993)):
        stack = merkle.Stack(begin, 1_000)
        found = [x for d in leaves[begin:end] for x in stack.push(d)] + list(stack.rest())
        assert len(found) == len({(level, i) for level, i, _, _ in found}) and all(whole[level][i] == d for level, i, d, _ in found)
        cut = {(level, run): whole[level][8 * run : 8 * run + 8] for level in range(len(whole) - 1) for run in {begin // 8 ** (level + 1), (end - 1) // 8 ** (level + 1)}}
        levels = merkle.climb(begin, 1_000, leaves[begin:end], cut)
        assert len(levels) == len(whole) and all(nodes == whole[k][first : first + len(nodes)] for k, (first, nodes) in enumerate(levels))


# Exact dedup

def plain_dedup(rows):
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(r[1] or "", []).append((r[0] is not None, r[0] or 0, i))
    out = []
    for text, members in groups.items():
        named, keep, row = max(members)
        out += [(rows[i][0], keep if named else None, len(members), i == row, sha(text)) for _, _, i in members]
    return out


@pytest.mark.parametrize("n", (0, 1, 400))
def test_dedup(spark, n):
    rows = made(n) + (ODD if n else [])
    # copies of two texts, so that both are hot
    rows += [(9_000 + k, rows[0][1], "en", "s", 1) for k in range(n // 2)] + [(8_000 - k, "copy", "en", "s", 4) for k in range(n // 3)]
    got = dedup.run(table(spark, rows).repartition(5))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert rows_of(got) == sorted(plain_dedup(rows), key=str)


def test_index_outlives_its_session(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    rows = lambda pairs: dedup.digests(spark.createDataFrame(pairs, "doc_id long, text string"))
    index = dedup.Index(spark, folder, 4)
    index.add(rows([(1, "a"), (5, "a"), (2, "b")]), "monday")
    index.close()
    again = dedup.Index(spark, folder, 4)
    tuesday = rows([(9, "a"), (3, "c"), (4, "c"), (None, "d")])
    told = {bytes(r.digest): r for r in again.add(tuesday, "tuesday").collect()}
    of = lambda t: told[hashlib.sha256(t.encode()).digest()]
    assert not of("a").fresh and of("a").keep_id == 5 and of("c").fresh and of("c").keep_id == 4 and of("d").fresh and of("d").keep_id is None
    # a batch that is tried again gets the same answer and leaves nothing twice
    repeated = {bytes(r.digest): (r.fresh, r.keep_id) for r in again.add(tuesday, "tuesday").collect()}
    assert repeated == {d: (r.fresh, r.keep_id) for d, r in told.items()} and again.entries().count() == 4
    again.close()


def test_index_is_read_bucket_by_bucket(spark, tmp_path):
    index = dedup.Index(spark, f"file://{tmp_path}/index", 3)
    rows = dedup.digests(spark.createDataFrame([(i, str(i)) for i in range(50)], "doc_id long, text string"))
    index.add(rows, "1")
    groups = rows.groupBy("digest").count()
    plan = groups.join(index.entries().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    # one exchange for the batch, none for the index
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    index.close()


def test_dedup_after_a_change(spark):
    from pyspark.sql import functions as F

    rows = dedup.digests(spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, None)], "doc_id long, text string"), normalise=lambda t: F.lower(F.regexp_replace(t, r"\s+", " ")))
    assert rows.select("digest").distinct().count() == 2


# Fill in the middle

def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    key = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(key[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text)), text
    form = "spm" if h4 % 100 < 20 else "psm"
    output = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(output), sha(text)), output


@pytest.mark.parametrize("n", (0, 1, 300))
def test_fim(spark, n):
    rows = made(n, 9) + (ODD if n else [])
    got = fim.run(table(spark, rows))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert rows_of(got) == sorted((plain_fim(r[0], r[1])[0] for r in rows), key=str)


def test_fim_keeps_the_rows(spark):
    rows = made(60, 4)
    out = fim.transform(table(spark, rows))
    assert sorted(out.columns) == sorted(table(spark, rows).columns)
    assert {r.doc_id: r.fim.output for r in out.collect()} == {r[0]: plain_fim(r[0], r[1])[1] for r in rows}
    assert {r.doc_id: r.digest for r in out.collect()} == {r[0]: "d" for r in rows}


def test_fim_restores_what_ends_like_a_mark(spark):
    rows = [(i, text, "en", "s", 1) for i, text in enumerate(["<", "a<", "<S", "S>", ">M>P", "<<<<P", "M>" * 9] * 9)]
    for r in fim.run(table(spark, rows)).collect():
        assert r.restored_sha256 == sha(rows[r.doc_id][1])
