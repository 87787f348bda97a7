"""Exact dedup, SimHash near-dedup and fuzzy lines against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from mensura.llm import exact_dedup, graph, line_dedup, simhash


class Groups:
    def __init__(self, n):
        self.top = list(range(n))

    def find(self, i):
        while self.top[i] != i:
            self.top[i] = self.top[self.top[i]]
            i = self.top[i]
        return i

    def join(self, i, j):
        self.top[self.find(i)] = self.find(j)


def test_exact_dedup_brute_force(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    best = {k: min(v, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0] for k, v in by.items()}
    want = Counter()
    for i, t in rows:
        k = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        want[(i, best[k], len(by[k]), i == best[k], hashlib.sha256(k.encode()).hexdigest())] += 1
    got = Counter(tuple(r) for r in exact_dedup.exact_dedup(odd).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want


def test_exact_dedup_many_runs(spark, odd):
    a = sorted(map(tuple, exact_dedup.exact_dedup(odd.repartition(13)).collect()), key=str)
    b = sorted(map(tuple, exact_dedup.exact_dedup(odd.coalesce(1)).collect()), key=str)
    assert a == b


def reference_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    pieces = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", None, "a", "A b C", "a b c d", "É é a b a b a b a b", "x " * 50, " \t\r\n\x0b\x0c"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == reference_print(text)


def test_bucket_links_join_what_pairs_join():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(400)], np.uint64)
    f = np.unique(base[rng.integers(0, 40, 400)] ^ flips)
    want = Groups(len(f))
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 4) + i + 1:
            want.join(i, j)
    u, v = simhash._large_bucket(f)
    got = Groups(len(f))
    for i, j in zip(u, v):
        got.join(i, j)
    assert len({(got.find(i), want.find(i)) for i in range(len(f))}) == len({got.find(i) for i in range(len(f))}) == len({want.find(i) for i in range(len(f))})


def test_near_dedup_brute_force(spark, odd):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for k in range(40):
        base = [rng.choice(words) for _ in range(120)]
        for m in range(5):
            t = list(base)
            for _ in range(m):
                t[rng.randrange(120)] = "edit"
            rows.append((100 + 10 * k + m, " ".join(t)))
    prints = np.array([reference_print(t) for _, t in rows], np.uint64)
    g = Groups(len(rows))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 4) + i + 1:
            g.join(i, j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[g.find(i)].append(d)
    want = Counter((d, f"{prints[i]:016x}", min((x for x in least[g.find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == want


def test_one_of_each_keeps_columns(odd):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 4, 7, 9}
    assert 2 not in {r.doc_id for r in kept.collect()}


def test_components(spark):
    rng = random.Random(5)
    e = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3)]
    g = Groups(2000)
    for a, b in e:
        if a is not None:
            g.join(a, b)
    least = {}
    for i in range(2000):
        least.setdefault(g.find(i), i)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {i: least[g.find(i)] for a, b in e if a is not None and a != b for i in (a, b)}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_lines(rows):
    occ = [(i, k, raw.strip(" \t\r\x0b\x0c").lower()) for i, t in rows if t is not None for k, raw in enumerate(t.split("\n"))]
    occ = [o for o in occ if o[2]]
    lines = sorted({o[2] for o in occ})
    at, sets = {x: i for i, x in enumerate(lines)}, [{x[i : i + 10] for i in range(max(1, len(x) - 9))} for x in lines]
    g = Groups(len(lines))
    for i in range(len(lines)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                g.join(i, j)
    by = defaultdict(list)
    for i, k, x in occ:
        by[g.find(at[x])].append((i is not None, i or 0, k))
    return {(i, k): (min(by[g.find(at[x])])[1:], len(by[g.find(at[x])])) for i, k, x in occ}


def test_fuzzy_lines_brute_force(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(400)]
    rows, stock = [], [[rng.choice(words) for _ in range(25)] for _ in range(12)]
    for d in range(30):
        text = []
        for _ in range(4):
            t = list(rng.choice(stock))
            for _ in range(rng.randrange(3)):
                t[rng.randrange(25)] = rng.choice(words)
            text.append("  " + " ".join(t).upper() if rng.random() < 0.2 else " ".join(t))
        rows.append((d, "\n".join([*text, "", "short"])))
    rows += [(90, None), (91, ""), (92, "\n\n")]
    want = brute_lines(rows)
    got = {(r[0], r[1]): ((r[2] or 0, r[3]), r[4]) for r in line_dedup.fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_fuzzy_lines_odd(odd):
    got = line_dedup.fuzzy_lines(odd).collect()
    twelve = {r.line_no: r.kept for r in got if r.doc_id == 12}
    assert twelve == {0: True, 1: True, 3: False}
    left = {r.doc_id: r.text for r in line_dedup.without_copies(odd).collect()}
    assert left[12] == "line one is here and it is long enough\nline two\n"
    assert left[5] is None and left[4] == ""


def test_minima_and_bands():
    assert len(line_dedup.BANDS) == 12
    pairs = Counter((a, b) for band in line_dedup.BANDS for a in band for b in band if a < b)
    assert set(pairs.values()) == {1} and len(pairs) == 36


@pytest.mark.parametrize("f", [exact_dedup.exact_dedup, simhash.near_dedup, line_dedup.fuzzy_lines, simhash.one_of_each])
def test_empty(empty, f):
    assert f(empty).count() == 0
