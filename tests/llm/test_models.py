"""Language ID, HTML extraction, PPM, decontamination, chat: brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mensura.llm import chat, decontam, html_blocks, html_text, langid, lm_scoring, ppm

# ---- language ID -------------------------------------------------------------------------------


def test_langid_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.predict_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_langid_bundle_is_the_sum_of_bound_vectors():
    s = langid.space()
    grams = s.grams("Ab, bé ab")
    letters = s.placed[0]
    order = np.array([int(np.flatnonzero((s.placed[0] == s.placed[1][:, [k]]).all(0))[0]) for k in range(langid.DIMENSIONS)])
    want = np.zeros(langid.DIMENSIONS)
    for g in grams:
        a, b, c = g // 4096, g // 64 % 64, g % 64
        want += letters[a][order][order] * letters[b][order] * letters[c]
    assert np.allclose(s.bundle(grams), want)


def test_langid_odd(odd, empty):
    got = {r.doc_id: r for r in langid.predict_documents(odd).collect()}
    for i in (4, 5, 6, 10):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[7].lang_pred == "en"
    assert langid.predict_documents(odd).count() == odd.count()
    assert langid.predict_documents(empty).count() == 0
    kept = langid.identified(odd)
    assert kept.columns == odd.columns and {4, 5, 6, 10}.isdisjoint({r.doc_id for r in kept.collect()})


# ---- HTML --------------------------------------------------------------------------------------


def test_blocks():
    page = """<html><head><title>T</title><style>p{}</style></head><body><!-- x < y --><script>var t="</p>";</script>
      <div class="postBody main-text" id=x1><p>A &amp; b<br>c  <b>d</b><p>Second <a href="/q">link</a></div><li>one<li>two &lt;x&gt; &eacute; 3 < 4</body>"""
    found = html_blocks.blocks(page)
    assert [b.text for b in found] == ["A & b c d", "Second link", "one", "two <x> é 3 < 4"]
    assert found[0].path == ("html", "body", "div", ".post", ".body", ".main", ".text", ".x", "p")
    assert found[1].linked == 4


@pytest.mark.parametrize("page", [None, "", "plain", "<", "<p", "<!-- never closed", "<script>x", "a<b c='\"><p>d", "</p></div>x", "<p>" * 500 + "deep", "&#xD800; &bogus; &#0;"])
def test_blocks_never_fail(page):
    for b in html_blocks.blocks(page):
        assert b.text == " ".join(b.text.split())


def test_gradient():
    model = html_text.Labeller(1)
    data = html_text.made_pages(3, 2)
    feats = [html_text.features(f) for f, _ in data]
    joined = ([p for f in feats for p in f[0]], [w for f in feats for w in f[1]])

    def loss(grad=False):
        x, mask, place = html_text._stack([model.inputs(f).astype(np.float64) for f in feats])
        y = np.zeros_like(mask)
        y[place] = np.concatenate([v for _, v in data])
        out = model.gradients(joined, x.astype(np.float64), mask, y, place)
        return out if grad else out[0]

    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    _, grad = loss(True)
    rng = np.random.default_rng(0)
    for name in ("path", "word", "xf", "hf", "cb", "hb", "out", "bias"):
        flat = np.abs(grad[name]).ravel()
        k = int(rng.choice(np.flatnonzero(flat > np.quantile(flat, 0.7)))) if flat.size > 1 else 0
        at = np.unravel_index(k, grad[name].shape)
        step = 1e-3
        model.w[name][at] += step
        up = loss()
        model.w[name][at] -= 2 * step
        down = loss()
        model.w[name][at] += step
        assert (up - down) / (2 * step) == pytest.approx(grad[name][at], rel=0.05, abs=1e-5), name


def test_html_held_out(spark, sf):
    model = html_text.labeller()
    data = html_text.made_pages(200, 77)
    got = model.label([f for f, _ in data])
    assert np.mean(np.concatenate(got) == np.concatenate([y > 0 for _, y in data])) > 0.985
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in html_text.extract(pages, model).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)
        assert r.text == "\n\n".join(b.text for b in html_blocks.blocks(article[0])), r.page_id
        assert r.n_chars == len(r.text)


def test_html_odd(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<nav><ul><li><a href=/>x</a></ul></nav>"), (2, "u", "<nav><ul><li><a href=/>x</a></ul></nav>"), (3, "u", "<article><h1>Head line</h1><p>" + "Word here. " * 50_000 + "</p></article>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS id")).collect()
    assert len(got) == 5 and {r.page_id: r.text for r in got}[1] == ""
    assert {r.page_id: r.n_chars for r in got}[3] == len("Head line\n\n") + 50_000 * 11 - 1
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- PPM ---------------------------------------------------------------------------------------


class Plain:
    """The same model with dictionaries, a byte at a time."""

    def __init__(self, texts, order):
        self.order, self.counts = order, {}
        for t in texts:
            d = ppm.framed(t, order)
            for i in range(order, len(d)):
                for k in range(order + 1):
                    held = self.counts.setdefault(d[i - k : i], Counter())
                    held[d[i]] += 1

    def score(self, text):
        d, total = ppm.framed(text, self.order), 0.0
        for i in range(self.order, len(d)):
            out: set = set()
            for k in range(self.order, -1, -1):
                held = self.counts.get(d[i - k : i])
                if not held:
                    continue
                left = {s: n for s, n in held.items() if s not in out}
                whole = sum(left.values()) + len(left)
                if d[i] in left:
                    total += math.log10(left[d[i]] / whole)
                    break
                if whole:
                    total += math.log10(len(left) / whole)
                out |= held.keys()
            else:
                total -= math.log10(ppm.ALPHABET - len(out))
        return total


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("abc é", max_size=30), max_size=6), st.text("abcdé ü", max_size=40), st.integers(1, 5))
def test_ppm_brute_force(texts, text, order):
    texts, text = [t.encode() for t in texts], text.encode()
    grams = [ppm.codes(ppm.framed(t, order), order) for t in texts]
    trie = ppm.Trie(*ppm.count(np.concatenate(grams) if grams else np.empty(0, np.uint64)), order)
    assert trie.score(text) == pytest.approx(Plain(texts, order).score(text), abs=1e-4)


def test_ppm_is_a_distribution():
    trie = ppm.Trie(*ppm.count(np.concatenate([ppm.codes(ppm.framed(t, 3), 3) for t in (b"abracadabra", b"abba", b"cab")])), 3)
    for context in (b"abr", b"zzz", b"zab", b"\xfe\xfe\xfe"):
        codes = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256) if s != ppm.PAD], np.uint64)
        assert 10 ** trie.log10(codes) @ np.ones(255) == pytest.approx(1.0, abs=1e-5)


def test_ppm_chunks(monkeypatch):
    text = b"some words and some more words " * 40
    trie = ppm.Trie(*ppm.count(ppm.codes(ppm.framed(text[:200]))))
    whole = trie.score(text)
    monkeypatch.setattr(ppm, "CHUNK", 17)
    assert trie.score(text) == pytest.approx(whole, abs=1e-6)


def test_adaptive_learns():
    model = ppm.Adaptive(3)
    first = model.score(b"the same text again")
    assert model.score(b"the same text again") > 0.3 * first


@pytest.mark.parametrize("head", [lm_scoring.HEAD_WORDS, 3])
def test_lm_base_brute_force(spark, odd, head):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    words = lambda t: [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [lm_scoring.END]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i or 0, held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), 4)) for i, t in rows)
    plain = Plain([ppm_text(t) for i, t in rows if not held(i)], ppm.ORDER)
    scores = sorted((i is None, i or 0, round(plain.score(ppm_text(t)), 1)) for i, t in rows if t is None or len(t) < 1000)
    got = lm_scoring.score_documents(odd, head=head).collect()
    assert sorted((r[0] is None, r[0] or 0, *r[1:5], round(r[5], 4)) for r in got) == want
    small = {r.doc_id for r in odd.collect() if r.text is None or len(r.text) < 1000}
    assert [x for s in sorted((r[0] is None, r[0] or 0, r[6]) for r in got if r[0] in small) for x in s] == pytest.approx([x for s in scores for x in s], abs=0.11)


def ppm_text(t):
    return lm_scoring.coded(lm_scoring.words_of(t))


def test_lm_lower_order_where_the_trie_is_too_large(spark, odd):
    learned = lm_scoring.counts(odd.select("text")).cache()
    texts = [ppm_text(r.text) for r in odd.select("text").collect()]
    want = {k: ppm.count(np.concatenate([ppm.codes(ppm.framed(t, k), k) for t in texts])) for k in range(1, ppm.ORDER + 1)}
    for k in (2, 3, ppm.ORDER):
        order, grams, n = lm_scoring.bounded_grams(learned, most=len(want[k][0]))
        assert order == k
        assert all(np.array_equal(x, y) for x, y in zip(ppm.count(grams, n), want[k]))


@pytest.mark.parametrize("most", [60, 4000])
def test_lm_scores_do_not_depend_on_the_blocks_of_the_trie(spark, odd, most):
    learned = lm_scoring.counts(odd.select("text")).where("gram is not null").select("gram", "n").cache()
    back, starts = lm_scoring.blocks_of(learned, ppm.ORDER, most)
    assert back and len(starts) > 1
    few = odd.where("doc_id is null or doc_id not in (7, 8)") if most == 60 else odd
    rows = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in df.collect())
    whole, blocks = rows(lm_scoring.score_documents(few)), rows(lm_scoring.score_documents(few, most=most))
    assert [r[:5] for r in blocks] == [r[:5] for r in whole]
    assert [x for r in blocks for x in r[5:]] == pytest.approx([x for r in whole for x in r[5:]], rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("back", [1, 2, 3, 5])
def test_ppm_blocks_brute_force(back):
    texts, text = [b"the cat sat on the mat", b"a cat and the dog sat", b""], b"the dog and that mat \xc3\xa9"
    grams, n = ppm.count(np.concatenate([ppm.codes(ppm.framed(t)) for t in texts]))
    shorter = ppm.count(grams & ppm._mask(back), n)
    key = (grams >> np.uint64(8)) & ppm._mask(back)
    cuts = [0, *np.unique(key)[2::3].tolist(), 1 << 8 * back]
    got = 0.0
    for start, stop in zip(cuts, cuts[1:]):
        own = (key >= np.uint64(start)) & (key < np.uint64(stop))
        got += ppm.Trie(grams[own], n[own], block=ppm.Block(back, start, stop, *shorter)).score(text)
    assert got == pytest.approx(Plain(texts, ppm.ORDER).score(text), abs=1e-4)


def test_lm_empty(spark, empty):
    assert lm_scoring.score_documents(empty).count() == 0
    nothing = lm_scoring.score_documents(spark.createDataFrame([(3, "a b")], "doc_id long, text string").where("doc_id = 3"), fold=5, held=zlib.crc32(b"3") % 5).collect()
    assert nothing[0].train_tokens == 0 and nothing[0].score == pytest.approx(-4 * math.log10(255), abs=1e-6)


# ---- decontamination ---------------------------------------------------------------------------


def brute_leaks(docs, items):
    known, out = decontam._Words(), {}
    for d, t in docs:
        h = decontam.word_hashes(t, known)
        for k, x in items:
            own = decontam.word_hashes(x, known)
            if not len(own) or not len(h):
                continue
            w = min(5, len(own))
            s, o = decontam.shingles(h, w), decontam.shingles(own, w)
            size = min(len(o), len(s))
            best = max((decontam.similarity(s[i : i + size], o) for i in range(len(s) - size + 1)), default=0) if size else 0
            if best >= 0.8:
                out[(d, k)] = round(best, 6)
    return out


def test_leaks_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(make(rng.randint(15, 60)))) for k in range(30)] + [(50, "only three words"), (51, ""), (52, None), (53, "rep rep rep rep rep rep rep rep")]
    docs = []
    for d in range(80):
        t = make(rng.randint(0, 200))
        if d % 2 == 0:
            x = rng.choice(items[:30])[1].split()
            for _ in range(rng.randint(0, 2)):
                x[rng.choice([0, 1, len(x) - 1, len(x) // 2])] = "changed"
            at = rng.randint(0, len(t))
            t = t[:at] + x + t[at:]
        docs.append((d, " ".join(t)))
    docs += [(200, "He said: Only three words."), (201, None), (202, ""), (203, "rep " * 40), (204, items[0][1].upper()), (204, items[0][1].upper()), (205, " ".join(items[1][1].split()[1:]))]
    want = brute_leaks(docs, items)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id_", "2 AS similarity"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 6) for r in got} == want
    assert len(got) == len(want) + 1  # the repeated document
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_leaks_in_blocks(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontam.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontam, "PASS_ITEMS", 7)
    assert sorted(map(tuple, decontam.leaks(docs, bench).collect())) == whole and whole
    none = bench.where("item_id < 0")
    assert decontam.leaks(docs, none).count() == 0 and decontam.clean(docs, none).count() == docs.count()


def test_hamming_table_finds_all():
    rng = np.random.default_rng(2)
    own = rng.integers(0, 2**63, 60, dtype=np.uint64)
    asked = np.concatenate([own[:30] ^ np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 20, 30)], np.uint64), rng.integers(0, 2**63, 30, dtype=np.uint64)])
    want = {(q, i) for q in range(len(asked)) for i in range(len(own)) if bin(int(asked[q] ^ own[i])).count("1") <= decontam.RADIUS}
    assert set(zip(*(x.tolist() for x in decontam.HammingTable(own).within(asked)))) == want


# ---- chat --------------------------------------------------------------------------------------

_texts = st.text(st.sampled_from(list("\\#</turn> ok:aé\n한\x00")), max_size=40) | st.sampled_from(["###", "</turn>", "\\### Assistant: </turn> ok", "\\", "\n</turn>\n", "######", "\\\\</turn>"])


@settings(max_examples=150, deadline=None)
@given(_texts)
def test_escape_round_trip(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text
    assert not re.search(rf"(?<!\\)({chat.MARKS})", e)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool"]), _texts), max_size=5))
def test_chat_round_trip(turns):
    codec = chat.Codec.of(chat.TOKENIZER)
    made = chat.assemble(codec, turns) if turns else []
    assert [chat.read_turn(codec, i, m)[:2] for i, m in made] == turns
    assert [chat.read_turn(codec, i, m)[2] or "" for i, m in made] == [t if r == "assistant" else "" for r, t in turns]
    assert chat.parse("".join(codec.render(i) for i, _ in made)) == turns


def test_chat_digests(spark):
    odd = r"\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", odd), (2, 0, None, None), (None, 3, "assistant", odd), (1, 2, "assistant", None), (3, None, "user", "x" * 200_000), (3, 5, "assistant", "y"), (3, 5, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS ids", "2 AS conv")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1][1:5] == (3, sha(f"user\n{odd}\nassistant\nb\nassistant\n\n"), 1, sha("b"))
    assert got[2][1:5] == (1, sha("\n\n"), 0, sha(""))
    assert got[None][1:5] == (1, sha(f"assistant\n{odd}\n"), len(odd), sha(odd))
    assert got[3][1:5] == (3, sha("user\n" + "x" * 200_000 + "\nassistant\ny\nassistant\ny\n"), 2, sha("yy"))
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0
