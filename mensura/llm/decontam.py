"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import short_batches

WORDS = 5
SIMILARITY = 0.8
#: Fingerprints of windows at the similarity differ in 10 of 64 bits on average (standard deviation 3).
RADIUS = 19
BLOCKS = 4
#: Items that go through the documents in one pass, and shingles: what a worker holds has this bound.
PASS_ITEMS = 4096
PASS_SHINGLES = 1 << 19
#: Items under one multi-index table.
TABLE_ITEMS = 256
#: Window starts that are fingerprinted at once.
STARTS = 4096
#: Words whose hashes a worker remembers, over all blocks and passes.
REMEMBERED = 1 << 18

_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„…–—·¿¡"
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word to 64-bit hash; 0 for what is punctuation only."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bare = word.strip(_EDGES)
        h = self[word] = (xxhash.xxh64_intdigest(bare.encode("utf-8", "surrogatepass")) | 1) if bare else 0
        return h


_known = _Words()


def word_hashes(text: str | None, known: _Words) -> np.ndarray:
    """Hashes of the lower-cased words without outer punctuation, in order."""
    words = (text or "").lower().split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return h[h != 0] if len(h) and not h.all() else h


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of `width` words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, width):
        out *= _PRIME
        out ^= out >> np.uint64(29)
        out += h[j : j + n]
    out *= _PRIME
    out ^= out >> np.uint64(32)
    return out


def _signs(s: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle, as rows of 64."""
    bits = np.unpackbits(np.ascontiguousarray(s, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


def _packed(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 0, axis=1, bitorder="little").view("<u8")[:, 0]


def simhash(s: np.ndarray) -> int:
    return int(_packed(_signs(s).sum(0, dtype=np.int64)[None, :])[0])


def window_prints(s: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows of `size` shingles at the given starts (in order), by running sums."""
    low = starts[0]
    part = _signs(s[low : starts[-1] + size])
    sums = np.zeros((len(part) + 1, 64), np.int32)
    np.cumsum(part, axis=0, out=sums[1:])
    return _packed(sums[starts - low + size] - sums[starts - low])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two shingle lists, a shingle's weight being how often it occurs."""
    both = np.concatenate([a, b])
    _, inverse = np.unique(both, return_inverse=True)
    k = inverse.max() + 1
    x, y = np.bincount(inverse[: len(a)], minlength=k), np.bincount(inverse[len(a) :], minlength=k)
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def _near_values() -> np.ndarray:
    """All 16-bit patterns of up to RADIUS // BLOCKS bits."""
    values = np.arange(1 << 16, dtype=np.uint32)
    return values[np.bitwise_count(values) <= RADIUS // BLOCKS]


class HammingTable:
    """Multi-index: for each 16-bit block and value, the fingerprints whose block is near enough.

    Two fingerprints within 19 bits have one of four blocks within 4 bits, so a look-up in each block finds
    every fingerprint within the radius.
    """

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        near = _near_values()
        self.starts, self.ids = [], []
        for b in range(BLOCKS):
            own = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint32)
            values = (own[:, None] ^ near[None, :]).ravel()
            ids = np.repeat(np.arange(len(prints), dtype=np.int32), len(near))
            order = np.argsort(values, kind="stable")
            self.starts.append(np.searchsorted(values[order], np.arange((1 << 16) + 1)).astype(np.int32))
            self.ids.append(ids[order])

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, own) pairs within the radius, each once."""
        found = []
        for b in range(BLOCKS):
            v = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            low, n = self.starts[b][v], self.starts[b][v + 1] - self.starts[b][v]
            q = np.repeat(np.arange(len(v)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            i = self.ids[b][at]
            kept = np.bitwise_count(prints[q] ^ self.prints[i]) <= RADIUS
            found.append(q[kept] * len(self.prints) + i[kept])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is among the known ones, which are in order."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Items:
    """A bounded block of benchmark items, ready to be looked for in documents."""

    def __init__(self, rows: list[tuple[object, np.ndarray]]):
        """rows: (item id, hashes of its words), each with a word at least."""
        rows = sorted(rows, key=lambda r: len(r[1]))
        self.ids = [r[0] for r in rows]
        self.words = np.array([len(r[1]) for r in rows])
        self.width = np.minimum(self.words, WORDS)
        self.own = [shingles(h, w) for (_, h), w in zip(rows, self.width.tolist())]
        self.prints = np.array([simhash(s) for s in self.own], np.uint64)
        self.tables: dict[int, HammingTable] = {}
        self.by_width = {}
        for w in np.unique(self.width).tolist():
            lengths = np.unique(self.words[self.width == w]).tolist()
            of = {n: np.unique(np.concatenate([self.own[i] for i in np.flatnonzero(self.words == n)])) for n in lengths}
            self.by_width[w] = (self._seen(of), np.unique(np.concatenate(list(of.values()))), of)

    @staticmethod
    def _seen(of: dict[int, np.ndarray]) -> np.ndarray:
        """A bit for each value of a hash's end; most shingles of a document have none."""
        seen = np.zeros(1 << 22, bool)
        for h in of.values():
            seen[(h & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        return seen

    def __getstate__(self):
        return self.__dict__ | {"tables": {}, "by_width": {w: (None, h, of) for w, (_, h, of) in self.by_width.items()}}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.by_width = {w: (self._seen(of), h, of) for w, (_, h, of) in self.by_width.items()}

    def table(self, k: int) -> HammingTable:
        if k not in self.tables:
            self.tables[k] = HammingTable(self.prints[k * TABLE_ITEMS : (k + 1) * TABLE_ITEMS])
        return self.tables[k]

    def find(self, text: str | None) -> list[tuple[object, float, int, int, int]]:
        """(item id, similarity, first word, words, distance) of the best window for each item found, by item order."""
        h = word_hashes(text, _known)
        best: dict[int, tuple[float, int, int]] = {}
        for w, (seen, hashes, of) in self.by_width.items():
            s = shingles(h, w)
            at = np.flatnonzero(seen[(s & np.uint64((1 << 22) - 1)).astype(np.int64)]) if len(s) else np.empty(0, np.int64)
            at = at[_among(s[at], hashes)]
            if len(at):
                for length, own in of.items():
                    self._windows(s, w, at[_among(s[at], own)], length, best)
        return [(self.ids[i], best[i][0], best[i][1], int(self.words[i]), best[i][2]) for i in sorted(best)]

    def _windows(self, s, w, hit, length, best) -> None:
        """Windows that share no shingle with an item of their length have similarity zero; all others are fingerprinted."""
        if not len(hit):
            return
        size = min(length - w + 1, len(s))
        mark = np.zeros(len(s) + 2, np.int32)
        np.add.at(mark, np.maximum(hit - size + 1, 0), 1)
        np.add.at(mark, np.minimum(hit, len(s) - size) + 1, -1)
        starts = np.flatnonzero(np.cumsum(mark)[: len(s) - size + 1] > 0)
        first, last = np.searchsorted(self.words, length), np.searchsorted(self.words, length, "right")
        for k in range(0, len(starts), STARTS):
            for part in np.split(starts[k : k + STARTS], np.flatnonzero(np.diff(starts[k : k + STARTS]) > size) + 1):
                self._verify(s, part, size, int(first), int(last), w, best)

    def _verify(self, s, starts, size, first, last, w, best) -> None:
        prints = window_prints(s, starts, size)
        for k in range(first // TABLE_ITEMS, (last - 1) // TABLE_ITEMS + 1):
            q, i = self.table(k).within(prints)
            i = i + k * TABLE_ITEMS
            kept = (i >= first) & (i < last)
            for a, b in zip(q[kept].tolist(), i[kept].tolist()):
                start = int(starts[a])
                got = similarity(s[start : start + size], self.own[b])
                if got >= SIMILARITY and (b not in best or (-got, start) < (-best[b][0], best[b][1])):
                    best[b] = (got, start, int(np.bitwise_count(prints[a] ^ self.prints[b])))


def blocks_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The benchmark in blocks of bounded size. Items without words can't be found and are left out."""
    rows, held = [], 0
    for r in benchmark.select(id_col, text_col).toLocalIterator():
        h = word_hashes(r[1], _known)
        if len(h):
            rows.append((r[0], h))
            held += len(h)
        if len(rows) >= PASS_ITEMS or held >= PASS_SHINGLES:
            yield Items(rows)
            rows, held = [], 0
    if rows:
        yield Items(rows)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per (document, item) found: id, item id, similarity, first_word, n_words, distance.

    A window has as many words as the item (all the document's, if it has fewer); it matches at a weighted
    Jaccard of five-word shingles of 0.8 or more (an item of fewer words is one shingle), shingles being told by 64-bit hashes. Words are
    lower-cased and lose outer punctuation. Null and empty texts, of documents or items, match nothing; repeated
    documents or items give rows each; null ids are kept. Empty tables give no rows. The benchmark
    goes through the documents block by block, a pass a block, so that a worker's share is bounded.
    """
    spark = docs.sparkSession
    short_batches(spark)
    kinds = [docs.schema[id_col].dataType, benchmark.schema[item_col].dataType]
    item_kind = to_arrow_type(kinds[1])
    names = [id_col, item_col, "similarity", "first_word", "n_words", "distance"]
    schema = f"{id_col} {kinds[0].simpleString()}, {item_col} {kinds[1].simpleString()}, similarity double, first_word long, n_words long, distance int"
    found = spark.createDataFrame([], schema)
    for items in blocks_of(benchmark, item_col, text_col):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for b in batches:
                rows = [(i, *f) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for f in shared.value.find(t)]
                columns = zip(*rows) if rows else ((),) * 6
                types = (b.schema.field(0).type, item_kind, pa.float64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        found = found.unionByName(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The documents in which no item is found, with all their columns; nulls and empties as in leaks. No shuffle."""
    short_batches(docs.sparkSession)
    kept, at = docs, docs.columns.index(text_col)
    for items in blocks_of(benchmark, item_col, text_col):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for b in batches:
                yield b.filter(pa.array([not shared.value.find(t) for t in b.column(at).to_pylist()], pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
