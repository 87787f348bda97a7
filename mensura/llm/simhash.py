"""SimHash near-dedup: fingerprints, pigeonring candidates, exact Hamming links, components."""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, own_name, short_batches, spread_join
from .graph import components

WORDS = 4
RADIUS = 4
SEED = 42
#: The ring of consecutive segments that a fingerprint's 64 bits are cut into, as (first bit, bits).
SEGMENTS = ((0, 10), (10, 9), (19, 9), (28, 9), (37, 9), (46, 9), (55, 9))
#: Buckets up to this size are compared pair by pair, larger ones by pivots.
SMALL = 48
#: Keys that a pass over sorted keys holds at once, besides the last bucket.
HELD = 1 << 18

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def hashes(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence if it has fewer words; none for no words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    whole = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[: -words]]
    cuts = map(slice, starts, (e - 1 for e in ends[words - 1 :]))
    return np.fromiter(map(xxhash.xxh64_intdigest, map(whole.__getitem__, cuts), repeat(SEED)), np.uint64, len(starts))


def majority(h: np.ndarray) -> int:
    """Each bit is 1 if over half of the hashes have it; 0 for no hashes."""
    if not len(h):
        return 0
    columns = np.ascontiguousarray(h, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None) -> int:
    return majority(hashes(text or ""))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for each document, fp the fingerprint as a signed long; a null text counts as empty."""
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_signed(fingerprint(t)) for t in b.column(1).to_pylist()], pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind.simpleString()}, fp long")


#: The further segments, counted from a chain's start, that one of its keys holds besides the start.
CHAINS = ((1, 2), (1, 3), (1, 4), (2, 3), (2, 4))


def ring_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): the keys under which two fingerprints that can be linked must meet.

    Pigeonring: if the 7 segments differ in 4 bits together, some segment starts a chain whose first l
    segments differ in at most 4 l / 7 bits for every l. So the first is equal (0.57); of the first three
    at most one bit differs (1.71), so the second or the third is equal; of the first five at most two bits
    differ (2.86). If the second is equal, one of the next three is, too; if it isn't, its bit is one of the two, and one of the fourth and the
    fifth is equal beside the third. Each start gives five keys of three segments, 27 bits or 28.
    """
    def segment(i):
        first, bits = SEGMENTS[i % len(SEGMENTS)]
        return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))

    keys = []
    for i in range(len(SEGMENTS)):
        for c, (j, k) in enumerate(CHAINS):
            keys.append(F.shiftleft(segment(i), 20) + F.shiftleft(segment(i + j), 10) + segment(i + k) + F.lit((len(CHAINS) * i + c) << 30))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def start_of(key: np.ndarray) -> np.ndarray:
    """The segment that starts a key's chain."""
    return (key >> 30) // len(CHAINS)


def chained(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the chain from segment `start` keeps within its budget at every length, for differences x."""
    parts = np.stack([np.bitwise_count((x >> np.uint64(f)) & np.uint64((1 << b) - 1)) for f, b in SEGMENTS], 1)
    m, ok, total = len(SEGMENTS), np.ones(len(x), bool), np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    for length in range(1, m):
        total += parts[rows, (start + length - 1) % m]
        ok &= total * m <= length * RADIUS
    return ok


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least index of each node's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            return root


def _large_bucket(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to join what belongs together in a bucket, in less than all pairs.

    A pivot takes the open members within the radius; groups whose pivots are over three radii apart
    can't be linked (triangle inequality), the others are compared unless they are joined already.
    """
    open_, groups, pivots = np.arange(len(f)), [], []
    u, v = [], []
    while len(open_):
        near = np.bitwise_count(f[open_] ^ f[open_[0]]) <= RADIUS
        groups.append(open_[near])
        pivots.append(open_[0])
        u.append(np.full(near.sum(), open_[0]))
        v.append(open_[near])
        open_ = open_[~near]
    top = np.arange(len(groups))
    centres = f[np.array(pivots)]

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i in range(len(groups)):
        close = np.flatnonzero(np.bitwise_count(centres[i + 1 :] ^ centres[i]) <= 3 * RADIUS) + i + 1
        for j in close:
            if find(i) == find(j):
                continue
            a, b = (groups[i], groups[j]) if len(groups[i]) < len(groups[j]) else (groups[j], groups[i])
            for k in a:
                hit = np.flatnonzero(np.bitwise_count(f[b] ^ f[k]) <= RADIUS)
                if len(hit):
                    u.append(np.array([k]))
                    v.append(b[hit[:1]])
                    top[find(j)] = find(i)
                    break
    return np.concatenate(u), np.concatenate(v)


def bucket_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints that link, from keys in order; each bucket's links connect what its pairs connect."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[first, len(key)])
    us, vs = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    for d in range(1, min(SMALL, int(sizes.max(initial=1)))):
        at = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
        if not len(at):
            break
        x = fp[at] ^ fp[at + d]
        kept = chained(x, start_of(key[at]))
        at, x = at[kept], x[kept]
        near = np.bitwise_count(x) <= RADIUS
        us.append(fp[at[near]])
        vs.append(fp[at[near] + d])
    for b in np.flatnonzero(sizes > SMALL):
        own = fp[first[b] : first[b] + sizes[b]]
        u, v = _large_bucket(own)
        us.append(own[u])
        vs.append(own[v])
    if not us:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    u, v = np.concatenate(us), np.concatenate(vs)
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = _roots(len(nodes), inverse[: len(u)], inverse[len(u) :])
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def links(fps: DataFrame) -> DataFrame:
    """(u, v) over distinct fingerprints: edges whose components are those of all links within the radius."""
    short_batches(fps.sparkSession, 1 << 16)

    def run(batches):
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        held: list = []
        count = 0

        def flush(last):
            nonlocal key, fp, held, count
            key = np.concatenate([key, *(b.column(0).to_numpy() for b in held)])
            fp = np.concatenate([fp, *(b.column(1).to_numpy().view(np.uint64) for b in held)])
            held, count = [], 0
            stop = len(key) if last or not len(key) else int(np.searchsorted(key, key[-1]))
            u, v = bucket_links(key[:stop], fp[:stop])
            key, fp = key[stop:], fp[stop:]
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= HELD:
                yield flush(False)
        yield flush(True)

    sorted_keys = ring_keys(fps).repartition("key").sortWithinPartitions("key", "fp")
    return sorted_keys.mapInArrow(run, "u long, v long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (least id reachable over links).

    Fingerprints link at 4 or fewer differing bits. Equal fingerprints are one node, however many documents
    share it; only distinct fingerprints are keyed and compared. Null and empty texts have fingerprint zero,
    linked like any other; a null id never names a component unless all its ids are null. Repeated rows
    each give a row. No rows in, no rows out; other columns are not read.
    """
    marked = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    joined = components(links(nodes.select("fp")))
    rooted = cut(nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps")))
    answer = spread_join(rooted, named, ["root"], hot_keys(named, "root", "fps")).select("fp", "component_id")
    found = spread_join(marked, answer, ["fp"], hot_keys(nodes, "fp"))
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each component the one with the least doc_id. Columns as in docs.

    Rows that repeat a doc_id stay or go together; a null doc_id stays only if its component has no other. Null and empty texts are
    one component; no rows in, no rows out.
    """
    kid = own_name("_kid", docs)
    kept = near_dedup(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kid)).distinct()
    short_batches(docs.sparkSession)
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(kid)), "left_semi").select(*docs.columns)
