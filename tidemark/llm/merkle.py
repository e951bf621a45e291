"""A Merkle manifest of a dataset: mountain ranges per partition, merged at their edges.

Leaves are sorted into partitions by (group, order) and numbered within them; a count per partition gives every leaf
its place in its group. A task then walks its leaves with a stack: as soon as a run of FANOUT nodes is complete it is
hashed and carried one level up, like a digit. Runs that lie across the edge of a partition are incomplete there, so
their nodes are emitted as edges; these, a few for each partition and level, are joined run by run and level by level.
The last run of a level may be short and is hashed as it is, without padding.

For proofs a task computes its own part of the tree again and takes the runs across its edges from the merged ones.
No task holds more than its partition's leaves, PART_ROWS or so, and no group is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import remainder, stored

FANOUT = 8
#: leaves of a partition, about
PART_ROWS = 100_000
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<position:int,siblings:array<binary>>>"


def digest_of(children: Sequence[bytes]) -> bytes:
    """H of some nodes: SHA-256 over their digests as hexadecimal text."""
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


def leaf_of(values: Sequence[Column]) -> Column:
    """H of a row's values: each is `-` if NULL, else the number of its bytes in UTF-8, a colon, and itself."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


class Stack:
    """The open runs of one section of one group's leaves, by level."""

    def __init__(self, start: int, n: int):
        self.at, self.levels, self.n = start, [], n

    def push(self, digest: bytes) -> Iterator[tuple[int, int, bytes, bool]]:
        """Takes the next leaf; gives (level, index, digest, edge) of the nodes that are settled by it."""
        level, index, size = 0, self.at, self.n
        self.at += 1
        while size > 1:
            if level == len(self.levels):
                self.levels.append([])
            run = self.levels[level]
            run.append((index, digest))
            if index % FANOUT != FANOUT - 1 and index != size - 1:
                return
            self.levels[level] = []
            whole = run[0][0] % FANOUT == 0
            for i, d in run:
                if level or not whole:
                    yield level, i, d, not whole
            if not whole:
                return
            level, index, size, digest = level + 1, index // FANOUT, -(-size // FANOUT), digest_of([d for _, d in run])
        yield level, index, digest, False

    def rest(self) -> Iterator[tuple[int, int, bytes, bool]]:
        """The nodes of the runs that end in another partition."""
        for level, run in enumerate(self.levels):
            for i, d in run:
                yield level, i, d, True


def climb(start: int, n: int, leaves: list[bytes], cut: dict[tuple[int, int], list[bytes]]) -> list[tuple[int, list[bytes]]]:
    """By level, the index of the first node that the leaves lie under, and these nodes; cut: the runs across the edges, by (level, run)."""
    levels, first, nodes, level = [], start, leaves, 0
    while n > 1:
        levels.append((first, nodes))
        above = []
        for run in range(first // FANOUT, (first + len(nodes) - 1) // FANOUT + 1):
            above.append(digest_of(cut.get((level, run)) or nodes[max(0, FANOUT * run - first) : FANOUT * (run + 1) - first]))
        first, nodes, n, level = first // FANOUT, above, -(-n // FANOUT), level + 1
    levels.append((first, nodes))
    return levels


class Tree:
    """One tree for each group of leaves.

    leaves: (id, of, order.., digest), written; `of` is the group, NULL being one. sections: (part, of, start, n, rows),
    one for each partition and group in it. nodes: (of, level, index, digest) of all levels above the leaves. cut: the
    merged runs (of, level, run, members). roots: (of, n, digest).
    """

    def __init__(self, leaves: DataFrame, order: Sequence[str], parts: int | None = None, part_rows: int = PART_ROWS):
        self.spark = leaves.sparkSession
        self.parts = parts or max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // part_rows))
        self.kind = leaves.schema["of"].dataType.simpleString()
        by = [F.col("of").asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
        self.leaves = stored(_numbered(leaves.repartitionByRange(self.parts, *by).sortWithinPartitions(*by)), "merkle-leaves")
        counts = self.leaves.groupBy("part", "of").agg(F.count("*").alias("rows"))
        group = Window.partitionBy("of")
        before = F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        n = F.sum("rows").over(group)
        height = sum(((F.col("n") > FANOUT**k).cast("int") for k in range(1, 21)), (F.col("n") > 1).cast("int"))
        self.sections = stored(counts.withColumns({"start": F.coalesce(before, F.lit(0)).cast("long"), "n": n}).withColumn("height", height), "merkle-sections")
        self.height = self.sections.agg(F.max("height")).first()[0] or 0
        self._merge(stored(self._walk(), "merkle-nodes"))

    def _dealt(self, headers: DataFrame) -> DataFrame:
        """The leaves of each partition in order, each section behind its header (place -1)."""
        own = [c for c in self.leaves.columns if c not in ("part", "of", "place")]
        more = [f for f in headers.schema if f.name not in ("part", "of")]
        rows = self.leaves.select("part", "of", "place", *own, *(F.lit(None).cast(f.dataType).alias(f.name) for f in more))
        heads = headers.select("part", "of", F.lit(-1).cast("long").alias("place"), *(F.lit(None).cast(self.leaves.schema[c].dataType).alias(c) for c in own), *(f.name for f in more))
        return rows.unionByName(heads).repartition(self.parts, "part").sortWithinPartitions("part", F.col("of").asc_nulls_first(), "place")

    def _walk(self) -> DataFrame:
        rows = self._dealt(self.sections.select("part", "of", "start", "n")).select("of", "place", "digest", "start", "n")

        def run(batches):
            stack, of, out = None, None, []

            def flush(types):
                columns = list(zip(*out)) or [()] * 5
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["of", "level", "index", "digest", "edge"])

            types = None
            for batch in batches:
                types = [batch.column(0).type, pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
                for o, place, digest, start, n in zip(*(c.to_pylist() for c in batch.columns)):
                    if place < 0:
                        out += [(of, *x) for x in stack.rest()] if stack else []
                        stack, of = Stack(start, n), o
                    else:
                        out += [(of, *x) for x in stack.push(digest)]
                if len(out) > 5_000:
                    yield flush(types)
            if stack:
                out += [(of, *x) for x in stack.rest()]
                yield flush(types)

        return rows.mapInArrow(run, f"of {self.kind}, level int, index long, digest binary, edge boolean")

    def _merge(self, found: DataFrame) -> None:
        """Joins the nodes at the edges run by run, one level after the other: a few rows for each partition."""
        groups = stored(self.sections.select(F.col("of").alias("_of"), "n", "height").distinct(), "merkle-groups")
        nodes = found.where("NOT edge OR level > 0").select("of", "level", "index", "digest")
        cut = self.spark.createDataFrame([], f"of {self.kind}, level int, run long, members array<binary>")
        made = None
        for level in range(self.height):
            pool = found.where(f"edge AND level = {level}").select("of", "level", "index", "digest")
            if made is not None:
                # a node across an edge lies in a run across that edge, up to the top of its group
                joined = made.join(groups, F.col("of").eqNullSafe(F.col("_of"))).where(F.col("level") < F.col("height"))
                pool = pool.unionByName(joined.select(*pool.columns))
            run = pool.groupBy("of", "level", F.expr(f"index DIV {FANOUT}").alias("run")).agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "digest"))), lambda x: x["digest"]).alias("members"))
            run = stored(run, f"merkle-run-{level}")
            cut = cut.unionByName(run)
            text = F.array_join(F.transform("members", lambda x: F.lower(F.hex(x))), "")
            made = run.select("of", (F.col("level") + 1).alias("level"), F.col("run").alias("index"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
            nodes = nodes.unionByName(made)
        self.cut = cut
        self.nodes = stored(nodes, "merkle-tree")
        top = self.nodes.join(groups, F.col("of").eqNullSafe(F.col("_of")) & (F.col("level") == F.col("height")))
        self.roots = stored(top.select("of", "n", "digest"), "merkle-roots")

    def paths(self, above: DataFrame | None = None) -> DataFrame:
        """The leaves with `top`, the root of their group, and `steps`, each a position in a run and the digests beside it, from the leaf up.

        above: (of, steps) with the steps that lead on from a group's root, one row for each group.
        """
        ask = self.sections.where("height > 0").select("part", "of", "start", "rows", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("level"))
        width = f"CAST(power({FANOUT}, level + 1) AS BIGINT)"
        ends = F.array_distinct(F.array(F.expr(f"start DIV {width}"), F.expr(f"(start + rows - 1) DIV {width}")))
        ask = ask.select("part", F.col("of").alias("_of"), F.col("level").alias("_level"), F.explode(ends).alias("_run"))
        got = ask.join(self.cut, F.col("_of").eqNullSafe(F.col("of")) & (F.col("_level") == F.col("level")) & (F.col("_run") == F.col("run")))
        # two runs for each level at most
        got = got.groupBy(F.col("part").alias("_part"), "_of").agg(F.collect_list(F.struct("level", "run", "members")).alias("cut"))
        heads = self.sections.select("part", "of", "start", "n").join(got, (F.col("part") == F.col("_part")) & F.col("of").eqNullSafe(F.col("_of")), "left").drop("_part", "_of")
        if above is None:
            heads = heads.withColumn("above", F.lit(None).cast(STEPS))
        else:
            heads = heads.join(above.select(F.col("of").alias("_of"), F.col("steps").alias("above")), F.col("of").eqNullSafe(F.col("_of")), "left").drop("_of")
        rows = self._dealt(heads)
        kept = [c for c in self.leaves.columns if c not in ("part", "place")]
        names = rows.columns
        schema = ", ".join(f"`{c}` {self.leaves.schema[c].dataType.simpleString()}" for c in kept) + f", top binary, steps {STEPS}"

        def run(batches):
            held, head, types = [], None, None

            def done():
                if not held:
                    return
                cut = {(c["level"], c["run"]): c["members"] for c in head["cut"] or ()}
                levels = climb(head["start"], head["n"], [r["digest"] for r in held], cut)
                above, memo = head["above"] or [], [None] * (len(levels) + 1)

                def steps(level, i):
                    """Those of the node i of a level; the ones above it are shared with the nodes beside it."""
                    if level == len(levels) - 1:
                        return above
                    run = i // FANOUT
                    if memo[level] is None or memo[level][0] != run:
                        first, nodes = levels[level]
                        memo[level] = run, cut.get((level, run)) or nodes[FANOUT * run - first : FANOUT * (run + 1) - first], steps(level + 1, run)
                    _, members, more = memo[level]
                    at = i % FANOUT
                    return [{"position": at, "siblings": members[:at] + members[at + 1 :]}, *more]

                for begin in range(0, len(held), 2_000):
                    part = held[begin : begin + 2_000]
                    columns = [[r[c] for r in part] for c in kept] + [levels[-1][1] * len(part), [steps(0, head["start"] + begin + k) for k in range(len(part))]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*kept, "top", "steps"])

            for batch in batches:
                types = [batch.column(names.index(c)).type for c in [*kept, "digest", "above"]]
                for row in batch.to_pylist():
                    if row["place"] < 0:
                        yield from done()
                        held, head = [], row
                    else:
                        held.append(row)
            yield from done()

        return rows.mapInArrow(run, schema)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with the partition they are in and their place among the rows of their group there."""
    fields = rows.schema

    def run(batches):
        part, of, place = TaskContext.get().partitionId(), (), 0
        for batch in batches:
            places = []
            for o in batch.column(batch.schema.get_field_index("of")).to_pylist():
                of, place = (o, 0) if of == () or o != of else (of, place + 1)
                places.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], [*batch.schema.names, "part", "place"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", part int, place long")


def fold(digest: bytes, steps: Sequence[dict]) -> bytes:
    """The root that a leaf leads to."""
    for s in steps:
        at = s["position"]
        digest = digest_of([*s["siblings"][:at], digest, *s["siblings"][at:]])
    return digest


def manifest(docs: DataFrame, columns: Sequence[str] = LEAF_COLUMNS, id_col: str = "doc_id", group_col: str = "lang", changed: Column | None = None, parts: int | None = None) -> tuple[Tree, Tree]:
    """The trees of the groups, and the tree of their roots in the order of the groups; its one root is the dataset's.

    The leaves of a group ascend by id (NULL first), of equal ids by digest, and rows equal in all columns have equal
    leaves, told apart by row. changed: another digest that each leaf carries along. Without rows there is no root.
    """
    of, ident = F.col(f"`{group_col}`").alias("of"), F.col(f"`{id_col}`").alias("id")
    digest = leaf_of([F.col(f"`{c}`") for c in columns]).alias("digest")
    leaves = docs.select(of, ident, digest, (F.lit(None).cast("binary") if changed is None else changed).alias("changed"), F.monotonically_increasing_id().alias("row"))
    trees = Tree(stored(leaves, "merkle-rows"), ["id", "digest", "row"], parts)
    roots = Tree(trees.roots.select(F.lit(0).alias("of"), F.col("of").alias("id"), "digest"), ["id"])
    return trees, roots


def tampered(columns: Sequence[str] = LEAF_COLUMNS, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The leaf of a row whose text lost its capitals A-Z, for every third row by hash; NULL for the others."""
    low = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = leaf_of([low if c == text_col else F.col(f"`{c}`") for c in columns])
    return F.when(remainder(id_col, 3) == 0, leaf)


def run(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one per row: the proof of each row, tried on rows of which every third is changed.

    NULLs count as values of their own, a NULL lang is a group, NULL ids are not changed; ties and repeated rows as in
    `manifest`. Texts never move, only digests. Without rows there are none. Columns that are not leaf columns are not
    looked at.
    """
    trees, roots = manifest(docs, changed=tampered())
    top = roots.roots.first()
    if top is None:
        return docs.select("doc_id", *(F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), F.lit(False).alias("verified")).limit(0)
    root = bytes(top.digest)
    over = roots.paths().select(F.col("id").alias("of"), "steps")
    rows = trees.paths(over).select(F.col("id").alias("doc_id"), "digest", "changed", "top", "steps")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def tried(batches):
        for batch in batches:
            leaves, changes, tops, paths = (c.to_pylist() for c in batch.columns[1:])
            proofs = [digest_of([x for s in steps for x in s["siblings"]]).hex() for steps in paths]
            folded = [fold(c or d, steps) for d, c, steps in zip(leaves, changes, paths)]
            text = lambda values: pa.array([v.hex() for v in values], pa.string())
            columns = [batch.column(0), text(leaves), text(tops), text([root] * len(leaves)), pa.array(proofs, pa.string()), text(folded), pa.array([f == root for f in folded], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return rows.mapInArrow(tried, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
