"""Benchmark passages inside documents, with edits, by pigeonhole pieces and Myers distance.

An item with an error budget of k is cut into k + 1 pieces: an occurrence with at most k edits leaves one piece
whole. All pieces of all items are looked for at once. A hit is verified upwards through a tree over the pieces: a
node of p pieces may have p - 1 edits, because if every child exceeded its own allowance the node would exceed its.
The root is the whole item with budget k, so nothing within the budget is missed, and chance hits end at the first
node, of two pieces. Distances are computed by Myers' bit-parallel recurrence.

Texts and items are compared lower-cased with runs of blanks as one. The budget is ERROR_RATE of an item's length, rounded
down. An item too short to have one must stand there exactly and as whole words: "no" is not found in "nothing". Every
item that has a character is looked for; items equal in id and normalised text count once.

Items are shipped to the tasks in lots of at most LOT_CHARS; a larger benchmark takes more passes, never more memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import Shipped, map_batches

ERROR_RATE = 0.1
LOT_CHARS = 2_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


class Pattern:
    """A string to be found with edits, by Myers' recurrence on one integer of as many bits."""

    __slots__ = ("size", "places")

    def __init__(self, text: str):
        self.size = len(text)
        self.places: dict[str, int] = {}
        for k, c in enumerate(text):
            self.places[c] = self.places.get(c, 0) | 1 << k

    def best(self, text: str) -> tuple[int, int]:
        """The least distance of the pattern to any substring of text, and where the first such substring ends."""
        size = self.size
        every, top = (1 << size) - 1, 1 << (size - 1)
        up, down, score = every, 0, size
        least, end = size, 0
        get = self.places.get
        for j, c in enumerate(text, 1):
            x = get(c, 0) | down
            d = ((x & up) + up ^ up) | x
            right, left = down | ~(up | d) & every, up & d
            if right & top:
                score += 1
            elif left & top:
                score -= 1
                if score < least:
                    least, end = score, j
            x = right << 1 & every
            down = x & d
            up = left << 1 & every | ~(x | d) & every
        return least, end


class Node:
    """Some pieces of an item in a row: its text from begin to end, with as many edits as pieces but one."""

    __slots__ = ("begin", "end", "edits", "pattern", "parent")

    def __init__(self, text: str, begin: int, end: int, edits: int, parent: Node | None):
        self.begin, self.end, self.edits, self.parent = begin, end, edits, parent
        self.pattern = Pattern(text[begin:end])


def _tree(text: str, cuts: list[int], first: int, last: int, parent: Node | None, out: list[tuple[int, int, Node | None]]) -> None:
    """Adds (begin, end, parent node) of every piece between cuts first and last."""
    if last - first == 1:
        out.append((cuts[first], cuts[last], parent))
        return
    node = Node(text, cuts[first], cuts[last], last - first - 1, parent)
    # the left part takes the largest power of two below the number of pieces, so most pieces have a sibling
    half = 1 << (last - first - 1).bit_length() - 1
    _tree(text, cuts, first, first + half, node, out)
    _tree(text, cuts, first + half, last, node, out)


class Finder:
    """All items of a lot, ready to be looked for."""

    def __init__(self, items: list[tuple[object, str]], error_rate: float = ERROR_RATE):
        import ahocorasick

        pieces: dict[str, list[tuple[int, int, Node | None]]] = {}
        self.items = []
        for number, (key, text) in enumerate(items):
            budget = int(len(text) * error_rate)
            cuts = [len(text) * j // (budget + 1) for j in range(budget + 2)]
            leaves: list[tuple[int, int, Node | None]] = []
            _tree(text, cuts, 0, budget + 1, None, leaves)
            for begin, end, node in leaves:
                pieces.setdefault(text[begin:end], []).append((number, begin, node))
            self.items.append((key, len(text), budget))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def found(self, text: str | None) -> dict[int, tuple[int, int]]:
        """Number of each item within its budget to its least distance and where that occurrence ends in the normal text."""
        found: dict[int, tuple[int, int]] = {}
        if self.empty:
            return found
        text = normal(text)
        tried: set[tuple[int, int]] = set()
        for stop, (size, uses) in self.automaton.iter(text):
            at = stop + 1 - size
            for number, begin, node in uses:
                if number in found and found[number][0] == 0:
                    continue
                if node is None and not _whole(text, at, stop + 1):
                    continue
                distance, end = 0, stop + 1
                # where the item would begin if nothing before the piece was edited, perhaps before the text does
                start = at - begin
                while node is not None:
                    # the piece stands where it was hit, so the node's text begins and ends within its edits of this
                    low = max(0, start + node.begin - node.edits)
                    high = start + node.end + node.edits
                    if node.parent is None:
                        if (number, start) in tried:
                            break
                        tried.add((number, start))
                    distance, end = node.pattern.best(text[low:high])
                    end += low
                    if distance > node.edits:
                        break
                    node = node.parent
                else:
                    if number not in found or (distance, end) < found[number]:
                        found[number] = distance, end
        return found

    def hits(self, text: str | None) -> Iterator[tuple[object, int, int]]:
        """(item, least distance, end in the normal text), once for each item found within its budget."""
        for number, (distance, end) in sorted(self.found(text).items()):
            yield self.items[number][0], distance, end


def _whole(text: str, begin: int, end: int) -> bool:
    """Whether text[begin:end] neither begins nor ends inside a word."""
    before = begin > 0 and text[begin - 1].isalnum() and text[begin].isalnum()
    return not before and not (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


def lots(items: DataFrame, item_col: str = "item_id", text_col: str = "text", lot_chars: int = LOT_CHARS) -> Iterator[list[tuple[object, str]]]:
    """The items by lots of bounded size: each is one collect of rows whose total length is bounded."""
    rows = items.select(F.col(item_col).alias("key"), F.col(text_col).alias("text")).where(F.length("text") > 0).distinct()
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    # a lot's expected size is half the bound
    n = max(1, -(-2 * total // lot_chars)) if total > lot_chars else 1
    # texts that are one when normalised fall into one lot
    alike = F.lower(F.regexp_replace("text", r"\s+", ""))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("key", alike), F.lit(n)) == k)
        lot = {(r.key, normal(r.text)) for r in part.collect()}
        yield sorted(((key, t) for key, t in lot if t), key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0, x[1]))


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", error_rate: float = ERROR_RATE) -> DataFrame:
    """(id, item, distance, item_chars, end): one row per document and item that it holds within the item's budget.

    end: where the best occurrence ends in the normalised text, the first of equally good ones. Documents without a hit,
    NULL and empty ones have no row; repeated documents have repeated hits. Items of NULL or empty text are nowhere;
    several items of one id are each found, with their own length. Without items or documents there are no rows. Other
    columns of either table are not looked at.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    item_arrow = to_arrow_type(items.schema[item_col].dataType)
    asked = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    out = None
    for lot in lots(items, item_col, "text"):
        held = Shipped(spark, lot)
        made: list[Finder] = []

        def work(batch: pa.RecordBatch, held=held, made=made) -> pa.RecordBatch:
            if not made:
                made.append(Finder(held.value, error_rate))
            finder = made[0]
            rows = [(k, *finder.items[number][:2], *hit) for k, text in enumerate(batch.column(1).to_pylist()) for number, hit in sorted(finder.found(text).items())]
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            return pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], item_arrow), *(pa.array([r[k] for r in rows], pa.int32()) for k in (3, 2, 4))], [id_col, item_col, "distance", "item_chars", "end"])

        one = map_batches(asked, work, f"{id_col} {kind}, {item_col} {item_kind}, distance int, item_chars int, end int", "_text")
        out = one if out is None else out.unionByName(one)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """docs, all columns kept, without the rows that hold an item within its budget.

    NULL and empty texts hold none and stay, as do all rows where there are no items. Repeated rows stay or go together.
    """
    place = docs.columns.index(text_col)
    out = docs
    for lot in lots(items):
        held = Shipped(docs.sparkSession, lot)

        def run(batches, held=held):
            finder = Finder(held.value, error_rate)
            for batch in batches:
                clean = [not finder.found(t) for t in batch.column(place).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
