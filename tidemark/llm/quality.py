"""Quality by an interpolated modified Kneser-Ney trigram model of trusted text.

The model is fitted to all trusted rows but every third, by a hash of the id, which is left for the limits (see
`trusted_sample`). Counts are sharded by a trigram's middle word: all that share it lie in one part, and so do its
continuation counts, its contexts' totals and what the order below needs but the last word's own count. A part is
shuffled in lots (the n-grams that one batch of texts has for it, as numbers of frequent words or else hashes), so
a trigram costs a few bytes on disk and is never a row.

`fit` reads the sample: each part gives counts of counts, and how many words stand before its middle words. The first
make the discounts, the second one table of words. `surprise` deals the documents' n-grams to the same parts, in
TURNS turns of a share of the parts each, whose shuffle files are deleted one after the other; a part counts the sample's
n-grams again, meets them with the documents' and gives sums by document, a row for each lot. With p1 of words, a token adds
    log p(last) - log p1(last) + log p1(middle)
to its document, as each word but the first is the middle of the next token; so no word has to be looked up anywhere
but in its own part. What parts need of others is written as the table `given`: last words that are not among the
FREQUENT_GRAMS known to every task, with their counts, and the pairs of hot middle words, which are dealt to several
parts by the word before them. Nothing is cut: rare, hot and new words all count as they stand.

A document's perplexity includes one end token. It is kept if its mean surprise, pulled towards its language's mean by
PULL tokens' worth (a few words prove little), is within the language's limit: the KEPT_SHARE quantile of the same
figure over trusted documents that the model has not seen. A language with fewer than LEAST_TRUSTED of these has the
limit of all languages together.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.storage import discard, swept
from tidemark.llm.common import Shipped, few, slices, smallest_by_hash, stored

#: where the sample is bound: a trusted text with more than this share of its language's words would be the sample alone, and is not taken
LARGEST_SHARE = 1 / 8
FREQUENT_GRAMS = 1_250_000
#: turns in which documents are scored, where the sample has more than PART_WORDS words; parts of a turn, at least; the sample's words of a part, about
TURNS, PARTS, PART_WORDS = 3, 64, 250_000
#: a word that is more than this share of the sample, and more than PART_WORDS, is dealt to several parts
HOT_SHARE = 1 / 1024
#: bytes of text of which a task has the n-grams at once
LOT_BYTES = 2 << 20
#: ids that are broadcast to mark trusted rows; beyond it texts are moved to them
MOST_TAUGHT = 4_000_000
KEPT_SHARE = 0.99
PULL = 20.0
LEAST_TRUSTED = 50
#: one trusted row in so many is never in the model's sample
LEFT_ONE_IN = 3
UNKNOWN_LANGUAGE = "und"
#: quantiles are read from a histogram of this step in log10
STEP = 0.001
_BEGIN, _END = np.uint64(1), np.uint64(2)
#: the number of a word that tasks do not know by number
_OTHER = np.uint32(0xFFFFFF)
#: A-Z lower-cased; blanks; and the table of words' hashes
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_PLACES = 64
_M1, _M2, _S = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(31)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from that of its first words and its last word's."""
    x = (left ^ (left >> _S)) * _M1 + right * _M2
    return x ^ (x >> _S)


def _random(n: int) -> np.ndarray:
    """n numbers of SplitMix64."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_RANDOM = _random(_PLACES << 8)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _find(table: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places in a sorted table, -1 where it lacks one."""
    if not len(table):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(table, asked), len(table) - 1)
    return np.where(table[at] == asked, at, -1)


class Words:
    """What every task has of a model: its most frequent words in the order of their hashes, into how many parts each is dealt as a middle word, and the number of parts and turns."""

    def __init__(self, hashes: np.ndarray, dealt: np.ndarray, parts: int, turns: int):
        # the last one is for words that are not in the table
        self.hashes, self.dealt, self.parts, self.turns = hashes, np.append(dealt, 1).astype(np.uint16), parts, turns

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the table, _OTHER for a word that it lacks."""
        at = _find(self.hashes, hashes)
        return np.where(at >= 0, at, _OTHER).astype(np.uint32)

    def spread(self, codes: np.ndarray) -> np.ndarray:
        return self.dealt[np.minimum(codes, len(self.hashes))]

    def hot(self, hashes: np.ndarray) -> np.ndarray:
        return self.spread(self.codes(hashes)) > 1

    def part(self, middle: np.ndarray, which: np.ndarray) -> np.ndarray:
        return (_joined(middle, which.astype(np.uint64)) % np.uint64(self.parts)).astype(np.int64)


def _read(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts: hashes of the distinct ones after those of begin and end; the place of each word in these, an end after each text; how many each text has, ends included.

    A word's hash is the sum of a random number for each byte at its place; of longer words than the table it is XXH3.
    """
    column = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets, data = offsets - offsets[0], _LOWER[data]
    word = ~_BLANK[data]
    # a text's first byte stands after a blank
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | np.append(True, ~word[:-1])[: len(word)]))
    ends = np.flatnonzero(word & (edge[1:] | np.append(~word[1:], True)[: len(word)])) + 1
    lengths = ends - starts
    at = np.flatnonzero(word).astype(np.int32)
    place = at - np.repeat(starts.astype(np.int32), lengths)
    spots = (np.minimum(place, _PLACES - 1) << 8) | data[at]
    found = np.add.reduceat(_RANDOM[spots], np.cumsum(lengths) - lengths) if len(starts) else np.zeros(0, np.uint64)
    for k in np.flatnonzero(lengths > _PLACES):
        found[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    distinct, number = np.unique(found, return_inverse=True)
    sizes = np.diff(np.searchsorted(starts, offsets)) + 1
    out = np.ones(sizes.sum(), np.int64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(sizes) - 1] = False
    out[inner] = number + 2
    return np.append([_BEGIN, _END], distinct), out, sizes


def _packed(codes: list[np.ndarray], hashes: list[np.ndarray], doc: np.ndarray) -> bytes:
    """Three words of each n-gram and its document: bytes of one place together, as most repeat; other words as hashes."""
    step = np.diff(doc, prepend=0).astype(np.uint32)
    planes = [np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T) for x in (*codes, step)]
    rare = [h[c == _OTHER] for c, h in zip(codes, hashes)]
    return pa.compress(b"".join(x.tobytes() for x in (*(p[:3] for p in planes[:3]), planes[3], *rare)), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, size: int, raw: int, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashes of the first, middle and last words, documents, and codes of the middle words."""
    data = np.frombuffer(pa.decompress(blob, decompressed_size=raw, codec="zstd", asbytes=True), np.uint8)
    rare, used, out = data[13 * size :].view(np.uint64) if raw > 13 * size else np.zeros(0, np.uint64), 0, []
    for k in range(3):
        a, b, c = data[3 * k * size : 3 * (k + 1) * size].reshape(3, size).astype(np.uint32)
        code = a | (b << np.uint32(8)) | (c << np.uint32(16))
        other = code == _OTHER
        n = int(other.sum())
        h = np.empty(size, np.uint64)
        h[~other] = table[code[~other]]
        h[other] = rare[used : used + n]
        used += n
        out.append(h)
        if k == 1:
            middle = code
    a, b, c, d = data[9 * size : 13 * size].reshape(4, size).astype(np.int64)
    return (*out, np.cumsum(a | (b << 8) | (c << 16) | (d << 24)), middle)


_ROWS = "part int, role int, first long, size long, raw long, blob binary"
#: in the order in which a part reads them
_GIVEN, _TAUGHT, _ASKED, _KEYS = range(4)
#: what a part tells of its counts
_RARE, _ONE, _TWO, _THREE, _PAIRS = range(5)


def _dealt(rows: DataFrame, shipped: Shipped, turn: int, turns: int) -> DataFrame:
    """The n-grams of rows (key, text, taught, asked) whose part falls to this turn: lots of one part, sized by the batches they come from."""

    def work(batches):
        import pyarrow.compute  # noqa: F401  (slices uses pa.compute)
        from pyspark import TaskContext

        words = shipped.value
        base = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", LOT_BYTES):
            hashes, number, sizes = _read(batch.column(1))
            codes = words.codes(hashes)
            begins = np.cumsum(sizes) - sizes
            v = np.append(0, number[:-1])
            v[begins] = 0
            u = np.append(0, v[:-1])
            u[begins] = 0
            part = words.part(hashes[v], (hashes[u] >> np.uint64(7)) % words.spread(codes[v]).astype(np.uint64))
            taught, asked = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            mine = np.flatnonzero(part % turns == turn)
            group = part[mine] // turns * 4 + taught[doc[mine]] + 2 * asked[doc[mine]]
            mine = mine[group % 4 > 0]
            group = group[group % 4 > 0]
            # few groups are sorted by counting
            order = np.argsort(group.astype(np.uint16) if len(group) and group.max() < 1 << 16 else group, kind="stable")
            mine, group = mine[order], group[order]
            three, owner = [x[mine] for x in (u, v, number)], doc[mine]
            three_codes, three_hashes = [codes[x] for x in three], [hashes[x] for x in three]
            edges = np.append(np.flatnonzero(np.diff(group.astype(np.int64), prepend=-1)), len(group))
            out = []
            for a, b in zip(edges[:-1], edges[1:]):
                lot = [c[a:b] for c in three_codes]
                blob = _packed(lot, [h[a:b] for h in three_hashes], owner[a:b])
                raw = 13 * (b - a) + 8 * sum(int((c == _OTHER).sum()) for c in lot)
                g = int(group[a])
                # what is taught and asked goes once, marked by the sign of its size
                out.append((g // 4 * turns + turn, _TAUGHT if g % 2 else _ASKED, base, int(b - a) * (-1 if g % 4 == 3 else 1), raw, blob))
            if asked.any():
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                raw = np.where(asked, keys, 0).tobytes() + asked.tobytes()
                spot = base // 7 % max(words.parts // turns, 1)
                out.append((int(spot) * turns + turn, _KEYS, base, len(keys), len(raw), pa.compress(raw, codec="zstd", asbytes=True)))
            base += len(sizes)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["part", "role", "first", "size", "raw", "blob"])

    return rows.select("key", "text", "taught", "asked").mapInArrow(work, _ROWS)


_SUMS = "first long, keys boolean, size long, blob binary"


def _lot(first: int, keys: bool, size: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((first, keys, size, blob), (pa.int64(), pa.bool_(), pa.int64(), pa.binary()))], ["first", "keys", "size", "blob"])


def _sums(doc: np.ndarray, value: np.ndarray) -> tuple[int, bytes]:
    """Sums of values by document, and how many each has; documents ascend."""
    at = np.flatnonzero(np.diff(doc, prepend=-1))
    parts = np.add.reduceat(value, at), doc[at].astype(np.int32), np.diff(np.append(at, len(doc))).astype(np.int32)
    return len(at), pa.compress(b"".join(x.tobytes() for x in parts), codec="zstd", asbytes=True)


def _added(batches):
    """(key, value, entries, copies) of documents from all lots of their batch; rows come sorted by `first`, keys ahead."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for _, lots in itertools.groupby(rows, key=lambda r: r[0]):
        _, _, size, blob = next(lots)
        data = pa.decompress(blob, decompressed_size=9 * size, codec="zstd", asbytes=True)
        keys, there = np.frombuffer(data, np.int64, size), np.frombuffer(data, bool, offset=8 * size)
        value, entries = np.zeros(size), np.zeros(size, np.int64)
        for _, _, n, blob in lots:
            data = pa.decompress(blob, decompressed_size=16 * n, codec="zstd", asbytes=True)
            doc = np.frombuffer(data, np.int32, n, 8 * n)
            value[doc] += np.frombuffer(data, np.float64, n)
            entries[doc] += np.frombuffer(data, np.int32, n, 12 * n)
        yield pa.RecordBatch.from_arrays([pa.array(x[there]) for x in (keys, value, entries, np.ones(size, np.int64))], ["key", "value", "entries", "copies"])


class Grams:
    """Counts of the trigrams of one part: each distinct one with its words' hashes."""

    def __init__(self):
        self.held, self.lots, self.waiting = None, [], 0

    def add(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        self.lots.append((_joined(_joined(u, v), w), u, v, w, np.ones(len(u), np.int64)))
        self.waiting += len(u)
        # repeated ones are merged before they are many
        if self.waiting > max(1 << 19, len(self.held[0]) if self.held else 0):
            self.merge()

    def merge(self) -> tuple[np.ndarray, ...]:
        if self.lots:
            triple, u, v, w, n = (np.concatenate(x) for x in zip(*([self.held] if self.held else []), *self.lots))
            triple, first, at = np.unique(triple, return_index=True, return_inverse=True)
            self.held, self.lots, self.waiting = (triple, u[first], v[first], w[first], np.bincount(at, n, len(triple)).astype(np.int64)), [], 0
        return self.held or tuple(np.zeros(0, t) for t in (np.uint64,) * 4 + (np.int64,))


def _parts(batches) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Rows of _ROWS as tuples, part by part; batches come sorted by part and role."""
    rows = (r for b in batches for k in range(0, b.num_rows, 64) for r in zip(*(c.to_pylist() for c in b.slice(k, 64).columns)))
    return itertools.groupby(rows, key=lambda r: r[0])


def _padded(x: np.ndarray) -> np.ndarray:
    """x with a 0 at the end, where -1 leads."""
    return np.append(x, np.zeros(1, x.dtype))


def _off(c: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.array((0.0, *discounts))[np.minimum(c, 3)]


class Smoothed:
    """The probabilities of one part's n-grams. given: (hot middle word, last word, count, 0) of pairs over all parts, and (0, word, its count as last word)."""

    def __init__(self, grams: Grams, given: np.ndarray, words: Words, numbers: Totals):
        triple, u, v, w, c = grams.merge()
        context, pair = _joined(u, v), _joined(v, w)
        self.context, first, at3 = np.unique(context, return_index=True, return_inverse=True)
        off = _off(c, numbers.d3)
        total = np.bincount(at3, c, len(self.context))
        weight3 = np.bincount(at3, off, len(self.context)) / total
        # a word that is not hot has all its predecessors here
        self.word, n = np.unique(v[first], return_counts=True)
        self.own = _padded(np.log10(numbers.p1(n)))
        hot = words.hot(v)
        self.pair, first, n = np.unique(pair[~hot], return_index=True, return_counts=True)
        pv, pw = v[~hot][first], w[~hot][first]
        whole = given[given[:, 0] != 0]
        gv, gw = whole[:, 0].view(np.uint64), whole[:, 1].view(np.uint64)
        pv, pw, n = np.append(pv, gv), np.append(pw, gw), np.append(n, whole[:, 2])
        order = np.argsort(_joined(pv, pw))
        pv, pw, n = pv[order], pw[order], n[order]
        self.pair = _joined(pv, pw)
        self.middle, at2 = np.unique(pv, return_inverse=True)
        off2 = _off(n, numbers.d2)
        total2 = np.bincount(at2, n, len(self.middle))
        weight2 = np.bincount(at2, off2, len(self.middle)) / total2
        # what is known of the last words: the frequent ones' counts are everywhere, the others' were given
        known = np.ascontiguousarray(given[:, 1]).view(np.uint64)
        known, first = np.unique(known, return_index=True)
        code = words.codes(pw)
        count = numbers.count(code)
        if len(known):
            count = np.where(code == _OTHER, given[first, 3][np.maximum(_find(known, pw), 0)], count)
        p1 = numbers.p1(count)
        p2 = (n - off2) / total2[at2] + weight2[at2] * p1
        p3 = (c - off) / total[at3] + weight3[at3] * p2[_find(self.pair, pair)]
        self.triple, self.weight3, self.weight2 = triple, _padded(np.log10(weight3)), _padded(np.log10(weight2))
        self.p2, self.p3 = np.log10(p2) - np.log10(p1), np.log10(p3) - np.log10(p1[_find(self.pair, pair)])

    def score(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, middle: np.ndarray, numbers: Totals) -> np.ndarray:
        """log10 p of each last word without its own p1; with that of the middle word (middle: its code), and of an end."""
        context, pair = _joined(u, v), _joined(v, w)
        at_context, at_pair = _find(self.context, context), _find(self.pair, pair)
        value = self.weight3[at_context]
        seen = at_pair >= 0
        value[seen] += self.p2[at_pair[seen]]
        value[~seen] += self.weight2[_find(self.middle, v[~seen])]
        both = np.flatnonzero(seen & (at_context >= 0))
        at = _find(self.triple, _joined(context[both], w[both]))
        value[both[at >= 0]] = self.p3[at[at >= 0]]
        own = numbers.logs[np.minimum(middle, len(numbers.logs) - 1)]
        other = np.flatnonzero(middle == _OTHER)
        at = _find(self.word, v[other])
        own[other] = np.where(at >= 0, self.own[at], numbers.unknown)
        return value + np.where(v == _BEGIN, 0.0, own) + np.where(w == _END, numbers.end, 0.0)


class Totals:
    """What a model has besides its parts: discounts, the sum of the counts of last words and their floor, the frequent words' counts, and that of ends."""

    def __init__(self, d1: tuple, d2: tuple, d3: tuple, total: int, floor: float, counts: np.ndarray, ends: int):
        self.d1, self.d2, self.d3, self.total, self.floor, self.counts, self._logs = d1, d2, d3, total, floor, _padded(counts), None
        self.unknown, self.end = float(np.log10(floor)), float(np.log10(self.p1(np.array([ends]))[0]))

    @property
    def logs(self) -> np.ndarray:
        """log10 p1 of the frequent words; made in each task, as it is larger than the counts."""
        if self._logs is None:
            self._logs = np.log10(self.p1(self.counts))
        return self._logs

    def count(self, codes: np.ndarray) -> np.ndarray:
        return self.counts[np.minimum(codes, len(self.counts) - 1)]

    def p1(self, counts: np.ndarray) -> np.ndarray:
        return (counts - _off(counts, self.d1)) / self.total + self.floor


class Model:
    """sample: rows (text) to learn from; given: rows that parts need of others, written."""

    def __init__(self, sample: DataFrame, words: Words, shipped: Shipped, numbers: Totals, given: DataFrame):
        self.sample, self.words, self.shipped, self.numbers, self.given = sample, words, shipped, numbers, given


def _discounts(rest: dict[int, int]) -> tuple[float, float, float]:
    """What a count of 1, of 2 and of more gives up, from the counts of counts."""
    n1, n2, n3, n4 = (rest.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    # small samples can lack a count: then the discount of the ideal case, half a step down
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3)))


def _frequent(sample: DataFrame, most: int) -> Words:
    """The most frequent words, by their counts in lots of text where they stand more than once. They decide how rows are written and dealt, not the results."""

    def count(batches):
        import pyarrow.compute  # noqa: F401  (slices uses pa.compute)

        for batch in slices(batches, "text", LOT_BYTES):
            hashes, number, _ = _read(batch.column(0))
            n = np.bincount(number, minlength=len(hashes))
            # hash 0 stands for all words
            hashes, n = np.append(np.uint64(0), hashes[n > 1]), np.append(len(number), n[n > 1])
            yield pa.RecordBatch.from_arrays([_signed(hashes), pa.array(n)], ["w", "n"])

    with swept(sample.sparkSession):
        counted = stored(sample.select("text").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "kn-words")
    total = counted.where("w = 0").agg(F.sum("n")).first()[0] or 0
    top = counted.where("w > 2 OR w < 0").orderBy(F.desc("n"), "w").limit(min(most, int(_OTHER) - 2)).toArrow()
    discard(counted)
    hashes, n = top.column("w").to_numpy().view(np.uint64), top.column("n").to_numpy()
    if most:
        hashes, n = np.append(hashes, [_BEGIN, _END]), np.append(n, [0, 0])
    order = np.argsort(hashes)
    dealt = np.maximum(1, np.ceil(n[order] / max(PART_WORDS, total * HOT_SHARE))).astype(np.int64)
    turns = TURNS if total > PART_WORDS else 1
    return Words(hashes[order], dealt, turns * max(PARTS, -(-total // (turns * PART_WORDS))), turns)


def fit(sample: DataFrame, frequent_grams: int = FREQUENT_GRAMS, filter_bits: int | None = None) -> Model | None:
    """A model of the texts of `sample` (column text); None without any row. Repeated rows count as often as they stand.

    frequent_grams: most words that tasks know by number. filter_bits is not used any more.
    """
    words = _frequent(sample, frequent_grams)
    shipped = Shipped(sample.sparkSession, words)

    def count(batches):
        words = shipped.value
        for part, rows in _parts(batches):
            grams = Grams()
            for _, _, _, size, raw, blob in rows:
                grams.add(*_unpacked(blob, abs(size), raw, words.hashes)[:3])
            _, u, v, w, c = grams.merge()
            hot = words.hot(v)
            _, first, n2 = np.unique(_joined(v, w), return_index=True, return_counts=True)
            pv, pw, phot = v[first], w[first], hot[first]
            _, first = np.unique(_joined(u, v), return_index=True)
            before, n1 = np.unique(v[first], return_counts=True)
            n1, before = n1[before != _BEGIN], before[before != _BEGIN]
            rare = np.unique(pw[(words.codes(pw) == _OTHER) & ~phot])
            three, two = np.bincount(np.minimum(c, 5), minlength=6), np.bincount(np.minimum(n2[~phot], 5), minlength=6)
            # nothing stands before an end's successor, so an end's count comes from the pairs
            ends = int((pw[~phot] == _END).sum())
            before, n1 = np.append(before, _END), np.append(n1, ends)
            for kind, a, b, n in ((_THREE, np.arange(6), None, three), (_TWO, np.arange(6), None, two), (_ONE, before, None, n1), (_RARE, rare, None, None), (_PAIRS, pv[phot], pw[phot], n2[phot])):
                whole = [np.zeros(len(a), np.int64) if x is None else x.astype(np.int64) if x.dtype != np.uint64 else x.view(np.int64) for x in (a, b, n)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), part, np.int32)), *map(pa.array, whole), pa.array(np.full(len(a), kind, np.int32))], ["part", "a", "b", "n", "kind"])

    rows = sample.select(F.lit(0).cast("long").alias("key"), "text", F.lit(True).alias("taught"), F.lit(False).alias("asked"))
    spark = sample.sparkSession
    with swept(spark):
        lots = _dealt(rows, shipped, 0, 1).repartition("part").sortWithinPartitions("part", "role")
        counted = stored(lots.mapInArrow(count, "part int, a long, b long, n long, kind int"), "kn-counts", "kind")
        of = lambda kind: counted.where(F.col("kind") == kind)
        pairs = stored(of(_PAIRS).groupBy("a", "b").agg(F.sum("n").alias("n")), "kn-pairs")
        ends = pairs.where(F.col("b") == int(_END)).select("b", F.lit(1).cast("long").alias("n"))
        one = stored(of(_ONE).select("a", "n").union(ends).groupBy("a").agg(F.sum("n").alias("c")).where("c > 0"), "kn-one")
    ranked = lambda df, c: {r.c: r.n for r in df.groupBy(F.least(F.col(c), F.lit(5)).alias("c")).agg(F.count("*").alias("n")).collect()}
    rest1, rest2 = ranked(one, "c"), ranked(pairs, "n")
    if not rest1:
        return None
    rest3 = {}
    for r in counted.where(F.col("kind").isin(_TWO, _THREE)).groupBy("kind", "a").agg(F.sum("n").alias("n")).collect():
        rest = rest2 if r.kind == _TWO else rest3
        rest[r.a] = rest.get(r.a, 0) + r.n
    d1 = _discounts(rest1)
    size, total = one.agg(F.count("*"), F.sum("c")).first()
    # what the discounts free is spread evenly over the words and the unknown one
    floor = sum(n * d1[min(c, 3) - 1] for c, n in rest1.items()) / total / (size + 1)

    def frequent(batches):
        for batch in batches:
            at = shipped.value.codes(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), batch.column(1)], ["at", "c"]).filter(pa.array(at != _OTHER))

    # at most frequent_grams rows
    held = one.select("a", "c").mapInArrow(frequent, "at long, c long").toArrow()
    counts = np.zeros(len(words.hashes), np.int64)
    counts[held.column("at").to_numpy()] = held.column("c").to_numpy()
    ends = one.where(F.col("a") == int(_END)).first().c
    numbers = Totals(d1, _discounts(rest2), _discounts(rest3), total, floor, counts, ends)

    # all pairs of a hot middle word go to each of its parts
    hot = np.flatnonzero(words.dealt > 1)
    places = sorted({(int(words.hashes[k].view(np.int64)), int(words.part(words.hashes[k : k + 1], np.array([j]))[0])) for k in hot for j in range(words.dealt[k])})
    places = F.broadcast(spark.createDataFrame(places, "v long, part int"))
    given = of(_RARE).select("part", F.lit(0).cast("long").alias("v"), F.col("a").alias("w"), F.lit(0).cast("long").alias("n"))
    given = given.union(pairs.select(F.col("a").alias("v"), F.col("b").alias("w"), "n").join(places, "v").select("part", "v", "w", "n"))
    with swept(spark):
        given = stored(given.join(one.select(F.col("a").alias("w"), "c"), "w").select("part", "v", "w", "n", "c"), "kn-given")
    discard(counted, pairs, one)
    return Model(sample, words, shipped, numbers, given)


def surprise(docs: DataFrame, model: Model | None, id_col: str, text_col: str, lang_col: str, taught_col: str | None = None) -> DataFrame:
    """(id, lang, n_tokens, mean), one row per input row: mean is the mean of -log10 p over a document's words and its end.

    taught_col: true in those rows of docs, which must be all, that the model was fitted to; they are read once instead of twice.
    """
    # a row's results follow from its text; equal rows share a key
    key = F.xxhash64(F.col(id_col), F.col(text_col)).alias("key")
    asked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit(UNKNOWN_LANGUAGE)).alias("lang"), key)
    if model is None:
        words = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
        return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit(UNKNOWN_LANGUAGE)).alias("lang"), words.cast("long").alias("n_tokens"), F.lit(0.0).alias("mean"))
    spark = docs.sparkSession
    rows = docs.select(key, F.col(text_col).alias("text"), (F.col(taught_col) if taught_col else F.lit(False)).alias("taught"), F.lit(True).alias("asked"))
    if not taught_col:
        rows = rows.union(model.sample.select(F.lit(0).cast("long"), "text", F.lit(True), F.lit(False)))
    shipped, totals = model.shipped, Shipped(spark, model.numbers)
    turns = model.words.turns

    def packed(batches):
        for batch in batches:
            part, v, w, n, c = (batch.column(k).to_numpy() for k in range(5))
            order = np.argsort(part, kind="stable")
            edges = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(part))
            for a, b in zip(edges[:-1], edges[1:]):
                blob = np.column_stack([x[order[a:b]] for x in (v, w, n, c)]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((int(part[order[a]]), _GIVEN, 0, int(b - a), len(blob), blob), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["part", "role", "first", "size", "raw", "blob"])

    def score(batches):
        words, numbers = shipped.value, totals.value
        for _, rows in _parts(batches):
            grams, given, taught, smoothed = Grams(), [np.zeros((0, 4), np.int64)], [], None
            for _, role, first, size, raw, blob in itertools.chain(rows, [(0, _KEYS, 0, 0, 0, b"")]):
                if role == _GIVEN:
                    given.append(np.frombuffer(blob, np.int64).reshape(-1, 4))
                    continue
                if role == _TAUGHT:
                    grams.add(*_unpacked(blob, abs(size), raw, words.hashes)[:3])
                    if size < 0:
                        taught.append((first, -size, raw, blob))
                    continue
                if smoothed is None:
                    smoothed = Smoothed(grams, np.concatenate(given), words, numbers)
                    grams = None
                todo = [*taught, *([(first, size, raw, blob)] if role == _ASKED else [])]
                taught = []
                for first_, size_, raw_, blob_ in todo:
                    u, v, w, doc, middle = _unpacked(blob_, size_, raw_, words.hashes)
                    yield _lot(first_, False, *_sums(doc, smoothed.score(u, v, w, middle, numbers)))
                if role == _KEYS and size:
                    yield _lot(first, True, size, blob)

    done = None
    for turn in range(turns):
        lots = _dealt(rows, shipped, turn, turns).union(model.given.where(F.pmod("part", F.lit(turns)) == turn).mapInArrow(packed, _ROWS))
        lots = lots.repartition("part").sortWithinPartitions("part", "role")
        found = lots.mapInArrow(score, _SUMS).repartition("first").sortWithinPartitions("first", F.desc("keys"))
        with swept(spark):
            found = stored(found.mapInArrow(_added, "key long, value double, entries long, copies long"), "kn-sums")
        done = found if done is None else done.union(found)
    sums = done.groupBy("key").agg(F.sum("value").alias("value"), F.sum("entries").alias("entries"), F.sum("copies").alias("copies"))
    # a copy has its key in each turn
    words = (F.col("entries") * turns / F.col("copies")).cast("long") - 1
    return asked.join(sums, "key").select("id", "lang", words.alias("n_tokens"), (-F.col("value") / F.col("entries")).alias("mean"))


def _not_left(trusted: DataFrame) -> DataFrame:
    """The trusted ids but those left for the limits."""
    return trusted.where(F.pmod(F.xxhash64(F.lit("limits"), "id"), F.lit(LEFT_ONE_IN)) != 0)


def trusted_sample(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, lang_col: str, model_tokens: int | None = None, most_documents: int | None = None) -> DataFrame:
    """(id, lang, text) of the sample that the model is fitted to; trusted: ids (column id).

    Without bounds the sample is all trusted rows but those left for the limits, each row as often as it stands. With a
    bound an id gives one row, the text with the smallest hash, so that it holds for rows too.

    With model_tokens, languages have equal shares of model_tokens words. A language's trusted rows come in the order of a hash of their
    id, at most most_documents of them, as long as the words of all together are within its share. A text with more
    than LARGEST_SHARE of a share is passed over, so no long text ends the sample for those after it; if all are that
    long, the shortest alone is taken, the one case in which a language goes beyond its share.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit(UNKNOWN_LANGUAGE)).alias("lang"), F.col(text_col).alias("text"))
    trusted = _not_left(trusted)
    if model_tokens is None and most_documents is None:
        return texts.join(few(trusted, "kn-taught", MOST_TAUGHT), "id", "left_semi")
    known = texts.select("id", "lang").join(trusted, "id", "left_semi")
    if most_documents is not None:
        known = smallest_by_hash(known, "lang", most_documents, "id", "quality")
    chosen = stored(known.distinct(), "kn-chosen")
    met = texts.join(F.broadcast(chosen) if most_documents is not None else chosen, ["id", "lang"])
    first = met.groupBy("id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")).select("id", "lang", "first.text")
    if model_tokens is None:
        return stored(first, "kn-sample")
    share = model_tokens // max(chosen.select("lang").distinct().count(), 1)
    sized = first.withColumn("words", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    sized = stored(sized.withColumn("long", F.col("words") > share * LARGEST_SHARE), "kn-sized")
    order = Window.partitionBy("lang").orderBy("long", F.when(F.col("long"), F.col("words")), F.xxhash64(F.lit("quality"), "id"), "id", "text")
    ranked = sized.withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(order))
    return stored(ranked.where((~F.col("long") & (F.col("upto") <= share)) | (F.col("rank") == 1)).select("id", "lang", "text"), "kn-sample")


def run(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", model_tokens: int | None = None, most_documents: int | None = None) -> DataFrame:
    """(id, lang, n_tokens, perplexity, limit, keep), one row per input row.

    model_tokens, most_documents: bounds of the model's sample as in `trusted_sample`; by default there are none.

    Texts without words and NULL ones have no perplexity and are not kept. Without trusted rows beyond the model's
    sample there is no limit and all others are kept. NULL labels trust nothing; a NULL language is `und`. Repeated
    rows get equal results; each counts for the limits. Other columns are not looked at.
    """
    trusted = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    if model_tokens is None and most_documents is None:
        # the sample is marked among the documents, so its texts are read and dealt once
        taught = few(_not_left(trusted), "kn-taught", MOST_TAUGHT)
        names = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        marked = names.join(taught.withColumn("taught", F.lit(True)), "id", "left").withColumn("taught", F.coalesce("taught", F.lit(False)))
        found = surprise(marked, fit(marked.where("taught").select("text")), "id", "text", "lang", "taught")
    else:
        sample = trusted_sample(docs, trusted, id_col, text_col, lang_col, model_tokens, most_documents)
        found = surprise(docs, fit(sample), id_col, text_col, lang_col)
        taught = sample.select("id").distinct()
    found = stored(found, "kn-surprise")
    unseen = found.where("n_tokens > 0").join(trusted, "id", "left_semi").join(F.broadcast(taught) if most_documents is not None else taught, "id", "left_anti")
    unseen = stored(unseen, "kn-unseen")
    means = unseen.groupBy("lang").agg(F.avg("mean").alias("usual"), F.count("*").alias("trusted"))
    usual = unseen.agg(F.avg("mean").alias("usual")).first().usual
    languages = few(found.select("lang").distinct().join(means, "lang", "left").select("lang", F.coalesce("usual", F.lit(usual).cast("double")).alias("usual"), F.coalesce("trusted", F.lit(0)).alias("trusted")), "kn-languages")
    pulled = (F.col("mean") * (F.col("n_tokens") + 1) + PULL * F.col("usual")) / (F.col("n_tokens") + 1 + PULL)
    histogram = unseen.join(languages, "lang").groupBy("lang", F.ceil(pulled / STEP).alias("bin")).agg(F.count("*").alias("n"))

    def limits(counts: DataFrame, *by: str) -> DataFrame:
        one = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        cut = counts.withColumn("upto", F.sum("n").over(one.orderBy("bin"))).withColumn("all", F.sum("n").over(one)).where(F.col("upto") >= KEPT_SHARE * F.col("all"))
        return cut.groupBy(*by).agg((F.min("bin") * STEP).alias("limit"))

    own = limits(histogram, "lang")
    every = limits(histogram.groupBy("bin").agg(F.sum("n").alias("n"))).first().limit
    ruled = languages.join(own, "lang", "left").select("lang", "usual", F.when(F.col("trusted") >= LEAST_TRUSTED, F.col("limit")).otherwise(F.lit(every).cast("double")).alias("limit"))
    judged = found.join(few(ruled, "kn-limits"), "lang")
    blank = F.col("n_tokens") == 0
    return judged.select(
        F.col("id").alias(id_col), F.col("lang").alias(lang_col), "n_tokens",
        F.when(~blank, F.pow(F.lit(10.0), F.col("mean"))).alias("perplexity"),
        F.pow(F.lit(10.0), F.col("limit")).alias("limit"),
        (~blank & F.coalesce(pulled <= F.col("limit"), F.lit(True))).alias("keep"),
    )
