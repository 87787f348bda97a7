"""Prediction by partial matching over bytes: a context trie with escapes (method C) and symbol exclusion."""

from __future__ import annotations

import numpy as np

#: Bytes of context.
ORDER = 5
#: Never part of UTF-8: what stands before a text, and its end (a symbol of its own).
PAD, END = 0xFE, 0xFF
#: Symbols that can be coded: all bytes but PAD.
ALPHABET = 255
#: Bytes coded at once.
CHUNK = 1 << 20
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << (8 * k)) - 1)


def codes(data: bytes, order: int = ORDER) -> np.ndarray:
    """For each byte but PADs, it and the `order` bytes before it as one number. data starts with `order` PADs."""
    b = np.frombuffer(data, np.uint8)
    n = len(b) - order
    if n <= 0:
        return np.empty(0, np.uint64)
    out = b[:n].astype(np.uint64)
    for j in range(1, order + 1):
        out <<= np.uint64(8)
        out |= b[j : j + n]
    return out


def framed(text: bytes, order: int = ORDER) -> bytes:
    return bytes([PAD]) * order + text + bytes([END])


def count(grams: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order and how often they occur; PADs aren't coded."""
    if n is None:
        keys, n = np.unique(grams, return_counts=True)
    else:
        order = np.argsort(grams, kind="stable")
        grams, n = grams[order], n[order]
        first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.empty(0, np.int64)
        keys, n = grams[first], np.add.reduceat(n, first) if len(first) else n
    kept = (keys & np.uint64(0xFF)) != PAD
    return keys[kept], n[kept]


class _Hash:
    """Open addressing: gram to log probability."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 1.6))))
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.values = np.zeros(1 << self.bits, np.float32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == _EMPTY
            slot, first = np.unique(at[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[slot] = keys[left[placed]]
            self.values[slot] = values[left[placed]]
            rest = np.ones(len(left), bool)
            rest[placed] = False
            left, at = left[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, index of those not found)."""
        at = self._slot(keys)
        held = self.keys[at]
        out = self.values[at].astype(np.float64)
        left = np.flatnonzero(held != keys)
        missing = [left[held[left] == _EMPTY]]
        left = left[held[left] != _EMPTY]
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            held = self.keys[at]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[hit]]
            missing.append(left[held == _EMPTY])
            on = ~hit & (held != _EMPTY)
            left, at = left[on], at[on]
        return out, np.concatenate(missing)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, whether there) in a table in order."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class _Level:
    """Contexts of k bytes: how often each was followed by what."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        self.grams, self.n = grams, n
        context = grams >> np.uint64(8)
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(grams) else np.empty(0, np.int64)
        self.contexts, self.first = context[first], first
        self.total = np.add.reduceat(n, first) if len(first) else np.empty(0, n.dtype)
        self.distinct = np.diff(np.r_[first, len(grams)])

    def nodes(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.contexts)), self.distinct)


class Block:
    """Part of a trie: the contexts whose last `back` bytes, as a number, are in [start, stop). Their suffixes of `back`
    bytes and more are in the same part; shorter contexts aren't, so the part has the counts of all grams of `back` bytes."""

    def __init__(self, back: int, start: int, stop: int, grams: np.ndarray, n: np.ndarray):
        self.back, self.start, self.stop = back, np.uint64(start), np.uint64(stop)
        self.grams, self.n = grams, n

    def own(self, grams: np.ndarray) -> np.ndarray:
        key = (grams >> np.uint64(8)) & _mask(self.back)
        return grams[(key >= self.start) & (key < self.stop)]


class Trie:
    """A pretrained model: for any bytes, their log10 probability. Counts of grams in, nothing else."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, order: int = ORDER, block: Block | None = None):
        """grams: distinct codes in order, with their counts; with a block, those of its contexts only."""
        self.order, self.block = order, block
        self.levels: list[_Level] = [None] * (order + 1)
        for k in range(order, -1, -1):
            if block and k == block.back - 1:
                grams, n = block.grams, block.n
            self.levels[k] = _Level(grams, n)
            if k:
                grams, n = count(grams & _mask(k), n)
        #: For each context of a level, what its suffix has left once the context's own symbols are excluded.
        self.left_total, self.left_distinct = [None] * (order + 1), [None] * (order + 1)
        for k in range(1, order + 1):
            upper, lower = self.levels[k], self.levels[k - 1]
            at, _ = _find(lower.grams, upper.grams & _mask(k))
            suffix, _ = _find(lower.contexts, upper.contexts & _mask(k - 1))
            taken = np.add.reduceat(lower.n[at], upper.first) if len(upper.first) else np.empty(0, np.int64)
            self.left_total[k] = lower.total[suffix] - taken if len(upper.first) else taken
            self.left_distinct[k] = lower.distinct[suffix] - upper.distinct if len(upper.first) else taken
        self.top = self._hash()

    def _hash(self) -> _Hash:
        top = self.levels[self.order]
        node = top.nodes()
        return _Hash(top.grams, np.log10(top.n / (top.total[node] + top.distinct[node])).astype(np.float32))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "top"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.top = self._hash()

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """The log10 probability of each coded byte.

        The longest context that was seen codes its symbol, or an escape; after an escape the next shorter
        context codes, without the symbols that the longer one had. Contexts never seen cost nothing.
        """
        out, rest = self.top.get(grams)
        if not len(rest):
            return out
        out[rest] = 0.0
        g = grams[rest]
        low = np.zeros(len(g))
        pending = np.arange(len(g))
        total, distinct = np.full(len(g), -1, np.int64), np.zeros(len(g), np.int64)
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            own = g[pending] & _mask(k + 1)
            node, known = _find(level.contexts, own >> np.uint64(8))
            fresh = (total[pending] < 0) & known
            total[pending[fresh]], distinct[pending[fresh]] = level.total[node[fresh]], level.distinct[node[fresh]]
            at, hit = _find(level.grams, own)
            whole = (total[pending] + distinct[pending]).astype(float)
            hit &= known
            low[pending[hit]] += np.log10(level.n[at[hit]] / whole[hit])
            escaped = ~hit & known & (whole > 0)
            low[pending[escaped]] += np.log10(distinct[pending[escaped]] / whole[escaped])
            below = ~hit & known
            if k:
                total[pending[below]], distinct[pending[below]] = self.left_total[k][node[below]], self.left_distinct[k][node[below]]
            pending = pending[~hit]
        seen = int(self.levels[0].distinct[0]) if len(self.levels[0].distinct) else 0
        low[pending] -= np.log10(ALPHABET - seen)
        out[rest] = low
        return out

    def score(self, text: bytes) -> float:
        """log10 probability of the text and its end; of a part of a trie, that of the bytes after its contexts."""
        data = framed(text, self.order)
        total = 0.0
        for i in range(0, len(data) - self.order, CHUNK):
            grams = codes(data[i : i + CHUNK + self.order], self.order)
            total += float(self.log10(self.block.own(grams) if self.block else grams).sum())
        return total


class Adaptive:
    """The same code, learning as it goes: starts from nothing and counts each byte after coding it."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.counts: dict[bytes, dict[int, int]] = {}

    def score(self, text: bytes) -> float:
        data = framed(text, self.order)
        total = 0.0
        for i in range(self.order, len(data)):
            excluded: set[int] = set()
            symbol, p = data[i], 1.0
            for k in range(self.order, -1, -1):
                held = self.counts.get(data[i - k : i])
                if not held:
                    continue
                left = {s: c for s, c in held.items() if s not in excluded}
                whole = sum(left.values()) + len(left)
                if symbol in left:
                    p *= left[symbol] / whole
                    break
                if whole:
                    p *= len(left) / whole
                excluded |= held.keys()
            else:
                p /= ALPHABET - len(excluded)
            total += float(np.log10(p))
            for k in range(self.order + 1):
                held = self.counts.setdefault(data[i - k : i], {})
                held[symbol] = held.get(symbol, 0) + 1
        return total
