"""Sharding, mixing and the pipeline."""

import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from mensura.llm import decontam, mixing, queries, sharding


def test_place_and_rebalance():
    rng = random.Random(1)
    sizes = [rng.randint(1, 1000) for _ in range(4096)]
    first = sharding.place(sizes, 40)
    heap = [0] * 40
    for s in sorted(sizes, reverse=True):
        heapq.heapreplace(heap, heap[0] + s)
    held = [sum(b for b, s in zip(sizes, first.shard_of) if s == k) for k in range(40)]
    assert sorted(held) == sorted(heap) and max(held) - min(held) < 1000
    for n in (41, 39):
        nxt = sharding.rebalance(first, sizes, n)
        held = [sum(b for b, s in zip(sizes, nxt.shard_of) if s == k) for k in range(n)]
        moved = sum(b for b, s, t in zip(sizes, first.shard_of, nxt.shard_of) if s != t)
        assert nxt.version == 2 and max(held) - min(held) < 1000 and set(nxt.shard_of) == set(range(n))
        assert moved < 0.1 * sum(sizes)


def test_map_versions(spark, tmp_path):
    m = sharding.place([5, 4, 3, 2, 1, 0, 0, 0], 3)
    m.save(spark, str(tmp_path))
    n = sharding.rebalance(m, [5, 4, 3, 2, 1, 0, 0, 0], 4)
    n.save(spark, str(tmp_path))
    assert sharding.SlotMap.load(spark, str(tmp_path), 1) == m and sharding.SlotMap.load(spark, str(tmp_path), 2) == n


def test_shards_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = sharding.shard_documents(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(text.keys())
    by, bytes_ = defaultdict(list), Counter()
    for r in got:
        assert r.size == len((text[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) and r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r.slot)
        bytes_[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert set(by) <= set(range(40)) and max(bytes_.values()) - min(bytes_.values()) <= max(r.size for r in got)
    assert sorted(map(tuple, sharding.shard_documents(docs.repartition(7)).collect())) == sorted(map(tuple, got))


def test_shards_odd(spark, odd, empty):
    got = sharding.shard_documents(odd, shards=3).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard_documents(empty).count() == 0
    assert sharding.add_shards(odd, 3).columns == [*odd.columns, "vslot", "shard"] and sharding.add_shards(odd, 3).count() == odd.count()


def test_heavy_text_is_spread(spark):
    rows = [(i, "same text for a third of all rows") for i in range(400)] + [(1000 + i, f"text {i} of its own") for i in range(800)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    b = Counter()
    for r in got:
        b[r.shard] += r.size
    assert max(b.values()) < 1.02 * min(b.values())


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out, open_ = share * sum(sizes.values()), {}, set(names)
    while True:
        left, weight = total - sum(out.values()), sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / weight > most * sizes[s]]
        if not over:
            return out | {s: left * w[s] / weight for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            open_.remove(s)


@pytest.mark.parametrize("table", ["odd", "sf"])
def test_mix_brute_force(spark, odd, sf, table):
    docs = odd if table == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text", "source").collect()
    size = lambda t: len((t or "").split())
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += size(r.text)
    want = brute_targets(sizes)
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r.doc_id, r.source, size(r.text)) for r in rows)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s], s
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_rates_meet_the_dual(spark, sf):
    """Rates are exp(lam x), at most 2: in a source, log rate over size is one constant wherever the limit isn't reached."""
    got = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).where("size > 50 and rate < 1.99 and rate > 0.01").collect()
    import math

    by = defaultdict(list)
    for r in got:
        by[r.source].append(math.log(r.rate) / r.size)
    for v in by.values():
        assert max(v) - min(v) <= 0.02 * abs(max(v, key=abs)) + 1e-6


def test_mix_empty(empty, odd):
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        seen = stage(spark, seen, sf).cache()
        if k < 4:
            assert seen.columns == docs.columns, name
        if name == "benchmark decontamination":
            assert decontam.leaks(seen, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    got = corpus_pipeline.run(spark, sf)
    assert Counter(map(tuple, got.select("doc_id", "shard").collect())) == Counter(map(tuple, seen.select("doc_id", "shard").collect()))


def test_pipeline_stages_take_odd_rows(spark, odd, empty, sf):
    base = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd.select(*base), empty.select(*base)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf).count() >= 0


def test_one_query_each():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
