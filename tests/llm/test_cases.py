"""Cases that broke once: types, repeated rows, clashing names, hot keys, clashes of hashes; and recalls that docstrings state."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mensura.llm import chat, common, decontam, graph, html_text, langid, line_dedup, mixing, sharding, simhash

WORDS = [f"word{i}" for i in range(500)]


def some_text(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_leaks_take_types_from_the_schema(spark):
    item = some_text(1, 12)
    docs = spark.createDataFrame([(1, some_text(2) + " " + item + " " + some_text(3)), (2, some_text(4))], "doc_id int, text string")
    bench = spark.createDataFrame([(5, item), (None, item)], "item_id int, text string")
    got = decontam.leaks(docs, bench)
    assert [f.dataType.simpleString() for f in got.schema][:2] == ["int", "int"]
    assert Counter((r.doc_id, r.item_id, r.n_words, r.similarity) for r in got.collect()) == Counter({(1, 5, 12, 1.0): 1, (1, None, 12, 1.0): 1})


def test_items_that_share_an_id_have_their_own_words(spark):
    a, b = some_text(5, 8), some_text(6, 6)
    docs = spark.createDataFrame([(1, f"{some_text(7)} {a} {some_text(8)} {b}")], "doc_id long, text string")
    got = decontam.leaks(docs, spark.createDataFrame([(9, a), (9, b)], "item_id long, text string")).collect()
    assert sorted(r.n_words for r in got) == [6, 8]


@pytest.mark.parametrize("n", [9, 20, 60, 300])
def test_radius_holds_windows_at_the_similarity(n):
    """Of pairs whose weighted Jaccard is 0.80 to 0.82, fingerprints within the radius find 0.99 or more."""
    rng = np.random.default_rng(n)
    near = []
    for _ in range(2000):
        own = max(1, int(np.floor(n / 9)))
        if not 0.8 <= (n - own) / (n + own) <= 0.83:
            own = max(k for k in range(n) if (n - k) / (n + k) >= 0.8)
        s = rng.integers(0, 2**64, n + own, dtype=np.uint64)
        near.append(bin(decontam.simhash(s[:n]) ^ decontam.simhash(s[own:])).count("1") <= decontam.RADIUS)
    assert np.mean(near) >= 0.99


@pytest.mark.parametrize("ids", ["same", "null"])
def test_rows_that_repeat_spread_over_shards(spark, ids):
    rows = [(7 if ids == "same" else None, "the same text") for _ in range(400)] + [(1000 + i, f"text {i} of its own") for i in range(400)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    held, places = Counter(), defaultdict(list)
    for r in got:
        held[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert len(got) == 800 and max(held.values()) < 1.05 * min(held.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert max(r["count"] for r in sharding.add_shards(docs, 10).groupBy("shard").count().collect()) < 120


def test_the_map_is_stored_and_edited(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} of its own") for i in range(300)], "doc_id long, text string")
    got = sharding.shard_documents(docs, shards=5, slots=64, store=str(tmp_path)).collect()
    first, second = (sharding.SlotMap.load(spark, str(tmp_path), k) for k in (1, 2))
    assert first.shard_of == sharding.place([1] * 64, 5).shard_of and first != second
    assert all(r.shard == second.shard_of[r.vslot] and r.map_version == 2 for r in got)


def test_columns_with_the_names_used_inside(spark, odd):
    names = ("_h", "_same", "_id", "_start", "_n", "_vslot", "_mh", "_kid", "_mid", "_mk", "_mc", "_lid", "_gone", "_LID", "node", "root", "fp", "part")
    names = [n for n in names if n.lower() not in {c.lower() for c in odd.columns}]
    names = list({n.lower(): n for n in names}.values())
    docs = odd.withColumns({n: F.lit("theirs") for n in names})
    for f in (lambda d: sharding.add_shards(d, 3), simhash.one_of_each, mixing.mixed_documents, line_dedup.without_copies):
        got = f(docs)
        assert got.columns[: len(docs.columns)] == docs.columns
        assert {r[n] for r in got.collect() for n in names} <= {"theirs"}


@pytest.mark.parametrize("role", ["user: x", "a:", r"b\: c", ":", r"\c", "### </turn>\\", "", "assistant"])
def test_roles_come_back(role):
    codec = chat.Codec.of(chat.TOKENIZER)
    (ids, mask), = chat.assemble(codec, [(role, " t: ### x")])
    assert chat.read_turn(codec, ids, mask)[:2] == (role, " t: ### x")
    assert chat.parse(codec.render(ids)) == [(role, " t: ### x")]


def test_lines_whose_hashes_clash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "_hash", lambda line: F.pmod(F.xxhash64(line), F.lit(3)))
    rows = [(i, some_text(i, 15)) for i in range(40)] + [(100, some_text(3, 15))]
    got = {r.doc_id: r.keep_doc_id for r in line_dedup.fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(40)} | {100: 3}


def test_line_pairs_at_the_similarity_meet(spark):
    """Lines of a similarity of 0.80 to 0.83: 0.98 of the pairs or more are found."""
    rng = random.Random(4)
    rows = []
    for i in range(300):
        line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=200)).strip().replace("  ", "xy")
        n = len(line) - 9
        cut = max(k for k in range(n) if (n - k) / (n + k) >= 0.8)
        rows += [(2 * i, line), (2 * i + 1, line[cut:] + "".join(rng.choices("abcdefghijklm", k=cut)))]
    got = {r.doc_id: r.keep_doc_id for r in line_dedup.fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(300)) >= 294 and all(got[2 * i] == 2 * i for i in range(300))


def test_lines_are_trimmed_only_where_their_ends_ask_for_it(spark):
    """The same lines as by plain trimming; Spark's trim, which goes through all characters, is asked for only behind a look at the ends."""
    blanks = [" ", "\t", "\r", "\x0b", "\x0c"]
    raw = ["", "A b", "\xa0Ä ß\u2003", *blanks, *(f"{a}X {b} y{a}{b}" for a in blanks for b in blanks), *(f"{a}Ünde" for a in blanks), *(f"ende{a}" for a in blanks), "\x00 z", " \t "]
    found = line_dedup.lines(spark.createDataFrame([(1, "\n".join(raw)), (2, None)], "doc_id long, text string"))
    want = {k: t.strip(" \t\r\x0b\x0c").lower() for k, t in enumerate(raw)}
    assert {r.line_no: r.line for r in found.collect()} == {k: t for k, t in want.items() if t}
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.index("CASE WHEN") < plan.index("trim(")


def test_buckets_are_counted_in_one_map(spark, monkeypatch):
    """The small hash map, which nearly all different keys overflow, is off for the buckets only, and comes back."""
    name, seen = "spark.sql.codegen.aggregate.map.twolevel.enabled", {}
    monkeypatch.setattr(line_dedup, "written", lambda df, of: seen.setdefault(of, spark.conf.get(name)) and common.written(df, of))
    rows = [(i, f"{some_text(99, 30)} {some_text(i, 2)}") for i in range(12)]
    before = spark.conf.get(name)
    line_dedup.fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert before == "true" and spark.conf.get(name) == before
    assert {of for of, on in seen.items() if on == "false"} == {"line-buckets"}


def test_signatures_tell_counts_clashes_and_minima(spark):
    """One pass counts the lines of a hash, sees whether second hashes differ, and finds the least hash under each mask; tables have no dictionaries."""
    rows = [(1, 0, "a line of some length", 7), (2, 0, "a line of some length", 7), (3, 0, "short", 8), (4, 0, "other", 8), (5, 0, "0123456789ab", 9)]
    got = {r.h: r for r in line_dedup.signatures(spark.createDataFrame(rows, "id long, line_no int, line string, h long")).collect()}
    assert {h: (r.n, r.clash) for h, r in got.items()} == {7: (2, False), 8: (2, True), 9: (1, False)}
    shingles = spark.createDataFrame([("0123456789",), ("123456789a",), ("23456789ab",)], "t string").select(F.xxhash64(line_dedup._wide(F.col("t")))).collect()
    assert all(got[9][f"m{k}"] == min(r[0] ^ line_dedup._mask(k) for r in shingles) for k in range(line_dedup.MINIMA))
    kept = line_dedup.written(spark.range(1000).selectExpr("id % 3 as x"), "plain")
    footer = [pq.ParquetFile(f).metadata.row_group(0).column(0).encodings for f in kept.inputFiles() for f in [f.removeprefix("file://").removeprefix("file:")] if pq.ParquetFile(f).metadata.num_row_groups]
    assert footer and not any("DICTIONARY" in str(e) for e in footer)


def test_rows_that_a_bit_map_passes_over(spark):
    """likely, with the other rows, parts a table; none of the wanted keys is among the others."""
    rows, wanted = spark.range(500).selectExpr("xxhash64(id) as h"), spark.range(0, 500, 25).selectExpr("xxhash64(id) as h")
    near, far = ({r.h for r in common.likely(rows, wanted, "h", others).collect()} for others in (False, True))
    assert near | far == {r.h for r in rows.collect()} and not near & far and {r.h for r in wanted.collect()} <= near and len(near) < 100


def test_a_bucket_of_many_unlike_lines(spark, monkeypatch):
    """Lines that quote one passage: small buckets, larger ones by pivots and by their rarest shingles give the same groups."""
    rng = random.Random(6)
    passage = some_text(99, 30)
    rows = [(i, f"{' '.join(rng.choice(WORDS) for _ in range(3 + i % 5))} {passage} {rng.choice(WORDS)} {i % 7}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    read = lambda: Counter((r.doc_id, r.keep_doc_id, r.group_size) for r in line_dedup.fuzzy_lines(docs).collect())
    whole = read()
    monkeypatch.setattr(line_dedup, "SMALL", 2)
    assert read() == whole


def test_pairs_of_a_bucket_have_an_end_beside_its_main_label(spark):
    """Pairs of lines of different labels, each once, and none of them between two lines of the bucket's main label."""
    rng = random.Random(8)
    texts = [f"{some_text(99, 30)} {some_text(i, 3)}" for i in range(12)]
    found = line_dedup.lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    h = {r.id: r.h for r in found.collect()}
    label = {i: h[0] if i < 8 else h[i] for i in h}
    members = [(k, h[i]) for k in (1, 2) for i in sorted(rng.sample(range(1, 12), 10)) + [0]]
    labels = spark.createDataFrame([(h[i], label[i]) for i in h], "node long, root long")
    opened = line_dedup.open_lines(common.written(spark.createDataFrame(members, "key long, h long"), "members"), labels)
    main = {k: label[{x: i for i, x in h.items()}[min(x for key, x in members if key == k)]] for k in (1, 2)}
    assert {r.key: r.main for r in opened.collect()} == main
    sized = line_dedup._shingled(found, a="line").select("h", "line", F.size("a").alias("size"))
    sketches = line_dedup._labelled(line_dedup.sketched(opened, sized), opened)
    got = [(r.u_h, r.v_h) for r in line_dedup.small_pairs(opened, sketches).collect()]
    held = [{x for key, x in members if key == k} for k in (1, 2)]
    shingles = {h[i]: {t[j : j + 10] for j in range(len(t) - 9)} for i, t in enumerate(texts)}
    of = {h[i]: label[i] for i in h}
    alike = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    want = {(a, b) for s in held for a in s for b in s if a < b and of[a] != of[b] and alike(a, b)}
    assert want and want <= {(min(p), max(p)) for p in got} and len(got) == len({(min(p), max(p)) for p in got})
    assert all(of[a] != of[b] for a, b in got)


def test_linked_fingerprints_share_a_key(spark):
    rng = np.random.default_rng(8)
    f = rng.integers(0, 2**64, 300, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in f], np.uint64)
    pairs = spark.createDataFrame([(i, int(x.view(np.int64)) if hasattr(x, "view") else int(x)) for i, x in enumerate(np.concatenate([f, f ^ flips]))], "i long, fp long")
    keys = defaultdict(set)
    for r in pairs.join(simhash.ring_keys(pairs), "fp").collect():
        keys[r.i].add(r.key)
    assert all(keys[i] & keys[i + 300] for i in range(300)) and all(len(k) == 35 for k in keys.values())


def test_hubs_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    monkeypatch.setattr(graph, "HOT_SHARE", 4)
    e = [(1, i) for i in range(2, 200)] + [(300, i) for i in range(301, 320)] + [(199, 200), (319, 1000)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 201)} | {i: 300 for i in (*range(300, 320), 1000)}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_a_join(spark, how):
    left = common.written(spark.createDataFrame([(1, i) for i in range(50)] + [(2, 7), (3, 8), (None, 9)], "k long, x long"), "left")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k long, y string")
    want = Counter(map(tuple, left.join(right, ["k"], how).select("k", "x", "y").collect()))
    assert Counter(map(tuple, common.spread_join(left, right, ["k"], [1], how).select("k", "x", "y").collect())) == want


def test_tables_of_a_job_are_deleted(spark):
    t = common.written(spark.range(3), "t")
    assert t.count() == 3
    common.discard(t)
    path = spark._jvm.org.apache.hadoop.fs.Path(t.written_at)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def plain_predict(profiles, text):
    """A text's language by loops over its grams, from the letter vectors alone."""
    space = langid.space()
    words = "".join(c if c.isalpha() else " " for c in text or "").split()
    slots = [0] + [s for w in words for s in [*(int(space.slots[ord(c)]) for c in w), 0]]
    v = np.zeros(langid.DIMENSIONS)
    for a, b, c in zip(slots, slots[1:], slots[2:]):
        v += space.placed[2][a] * space.placed[1][b] * space.placed[0][c]
    cos = profiles.unit @ v / np.linalg.norm(v)
    return profiles.langs[int(np.argmax(cos))], float(cos.max())


def test_predictions_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    profiles = langid.train_fold(docs)
    rows = [r for r in docs.where("length(text) between 30 and 900").select("text").limit(25).collect()]
    for r in rows:
        got, want = profiles.predict(r.text), plain_predict(profiles, r.text)
        assert got[0] == want[0] and got[1] == pytest.approx(max(0.0, want[1]), abs=1e-4)


def test_long_texts_of_no_learned_language_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(2)
    odd = [(10**9 + i, " ".join("".join(rng.choices("абвгдежзийклмнопрст", k=6)) for _ in range(200)), None) for i in range(10)]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    kept = {r.doc_id for r in langid.identified(both).select("doc_id").collect()}
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert kept == lettered


def test_labeller_brute_force():
    """The recurrent labeller against a plain loop over blocks, cell by cell."""
    model = html_text.labeller()
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>A title here</h1><p>Some words of the story, and more.</p></article><footer>All rights reserved</footer></body></html>"
    found = html_text.blocks(page)
    x = model.inputs(html_text.features(found))
    sig = lambda z: 1 / (1 + np.exp(-z))
    size, outs = html_text.HIDDEN, {}
    for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        h, c, out = np.zeros(size), np.zeros(size), [None] * len(x)
        for t in order:
            gates = x[t] @ model.w[f"x{d}"] + h @ model.w[f"h{d}"] + model.w[f"c{d}"]
            i, f, o, g = (gates[k * size : (k + 1) * size] for k in range(4))
            c = sig(f) * c + sig(i) * np.tanh(g)
            h = sig(o) * np.tanh(c)
            out[t] = h
        outs[d] = np.array(out)
    score = np.concatenate([outs["f"], outs["b"], x], 1) @ model.w["out"] + model.w["bias"]
    assert list(model.label([found])[0]) == list(score > 0)
    assert html_text.main_text(found, model.label([found])[0]) == "A title here\n\nSome words of the story, and more."


def test_kept_weights_are_those_of_the_fitting():
    kept, model = html_text.labeller().w, html_text.Labeller(html_text.SEED)
    assert {k: v.shape for k, v in kept.items()} == {k: v.shape for k, v in model.w.items()}


def test_formulas_and_fallbacks_are_text():
    page = "<article><p>The area is <math><mi>a</mi><mo>=</mo><mn>2</mn></math> squared.</p><object>Seen without it.</object></article>"
    assert [b.text for b in html_text.blocks(page)] == ["The area is a=2 squared.", "Seen without it."]
