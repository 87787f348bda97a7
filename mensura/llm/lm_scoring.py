"""Language-model scoring: byte PPM against a smoothed unigram base, both learned from all training documents."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ppm
from .common import cut, short_batches, text_remainder, written

#: Words whose counts every worker holds; all others are looked up by a join. And a bound on the grams of the trie
#: that a worker holds: a larger trie is gone through in blocks, a pass over the documents each.
HEAD_WORDS = 1 << 18
MAX_GRAMS = 1 << 24
#: What a task gathers before it hands it on.
HELD_WORDS = 1 << 19
HELD_GRAMS = 1 << 22
OUT_ROWS = 1 << 16
END = bytes([ppm.END])


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; a null text has none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def coded(words: list[bytes]) -> bytes:
    """What the model codes: the words, a space between two. The end follows as a symbol."""
    return b" ".join(words)


def counts(texts: DataFrame, order: int = ppm.ORDER) -> DataFrame:
    """(word, gram, n) over all texts: a row for each word, the end (counted as a word), and each gram of bytes."""
    short_batches(texts.sparkSession)

    def run(batches):
        words: Counter = Counter()
        pending: list = []
        size = 0
        grams, n = np.empty(0, np.uint64), np.empty(0, np.int64)

        def rows(keys, grams, n):
            for i in range(0, len(n), OUT_ROWS):
                k = len(n[i : i + OUT_ROWS])
                none = pa.nulls(k, pa.binary() if keys is None else pa.int64())
                own = none if keys is None else pa.array(keys[i : i + k], pa.binary())
                yield pa.RecordBatch.from_arrays([own, pa.array(grams[i : i + k].astype(np.int64)) if keys is None else none, pa.array(n[i : i + k], pa.int64())], ["word", "gram", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                found = words_of(t)
                words.update(found)
                words[END] += 1
                data = ppm.framed(coded(found), order)
                for i in range(0, len(data) - order, ppm.CHUNK):
                    pending.append(ppm.codes(data[i : i + ppm.CHUNK + order], order))
                    size += len(pending[-1])
                if size >= HELD_GRAMS:
                    own = ppm.count(np.concatenate(pending))
                    grams, n = ppm.count(np.concatenate([grams, own[0]]), np.concatenate([n, own[1]]))
                    pending, size = [], 0
                    if len(grams) >= HELD_GRAMS:
                        yield from rows(None, grams, n)
                        grams, n = grams[:0], n[:0]
            if len(words) >= HELD_WORDS:
                yield from rows(list(words), None, np.fromiter(words.values(), np.int64, len(words)))
                words = Counter()
        if pending:
            own = ppm.count(np.concatenate(pending))
            grams, n = ppm.count(np.concatenate([grams, own[0]]), np.concatenate([n, own[1]]))
        yield from rows(None, grams, n)
        yield from rows(list(words), None, np.fromiter(words.values(), np.int64, len(words)))

    return texts.mapInArrow(run, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


class Model:
    """What is broadcast: plain arrays. A worker builds the trie and the words' table once, when it first needs them."""

    def __init__(self, order: int, grams: np.ndarray, n: np.ndarray, words: pa.Table, bottom: float, block: ppm.Block | None = None):
        self.order, self.grams, self.n, self.words, self.bottom, self.block = order, grams, n, words, bottom, block
        self.built = None

    def __getstate__(self):
        return self.__dict__ | {"built": None}

    def ready(self) -> tuple[ppm.Trie, dict[bytes, float]]:
        if self.built is None:
            p = np.log10((self.words.column(1).to_numpy() + 0.5) / self.bottom).tolist()
            self.built = (ppm.Trie(*ppm.count(self.grams, self.n), self.order, self.block), dict(zip(self.words.column(0).to_pylist(), p)))
            self.grams = self.n = self.words = self.block = None
        return self.built


def _arrays(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = grams.toArrow()
    return got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()


def bounded_grams(learned: DataFrame, order: int = ppm.ORDER, most: int = MAX_GRAMS) -> tuple[int, np.ndarray, np.ndarray]:
    """(order, grams, counts) of the highest order whose grams number at most `most`: a smaller model, for callers that
    want one they can hold whole. Scoring doesn't use it; it goes through blocks of the trie instead."""
    grams = learned.where(F.col("gram").isNotNull()).select("gram", "n")
    while order > 1 and grams.count() > most:
        order -= 1
        grams = cut(grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)).alias("gram")).agg(F.sum("n").alias("n")))
    return order, *_arrays(grams)


def _last(back: int):
    """The last `back` bytes of a gram's context."""
    return F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << 8 * back) - 1))


def blocks_of(grams: DataFrame, order: int, most: int) -> tuple[int, list[int]]:
    """(back, starts): the blocks into which the trie is cut, by the last `back` bytes of its contexts; each has at most
    `most` grams, unless one context of full length has more. (0, [0]) if the trie is a single block."""
    if grams.count() <= most:
        return 0, [0]
    for back in range(min(2, order), order + 1):
        sizes = cut(grams.groupBy(_last(back).alias("key")).count())
        if back == order or sizes.agg(F.max("count")).first()[0] <= most:
            break
    got = sizes.orderBy("key").toArrow()
    starts, held = [0], 0
    for key, n in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        if held and held + n > most:
            starts.append(key)
            held = 0
        held += n
    return back, starts


def models(learned: DataFrame, order: int, most: int, top: pa.Table, bottom: float):
    """The models of the passes over the documents, made one at a time; the words are in the first."""
    grams = learned.where(F.col("gram").isNotNull()).select("gram", "n")
    back, starts = blocks_of(grams, order, most)
    if not back:
        yield Model(order, *_arrays(grams), top, bottom)
        return
    shorter = _arrays(grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * back) - 1)).alias("gram")).agg(F.sum("n").alias("n")))
    shorter = ppm.count(*shorter)
    for start, stop in zip(starts, [*starts[1:], 1 << 8 * back]):
        own = grams.where((_last(back) >= start) & (_last(back) < stop))
        yield Model(order, *_arrays(own), top if not start else top.slice(0, 0), bottom, ppm.Block(back, start, stop, *shorter))


def head_threshold(words: DataFrame, most: int = HEAD_WORDS) -> int:
    """The least power of two, as a count, that at most `most` words reach."""
    steps = {r[0]: r[1] for r in words.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()}
    held, least = 0, 1 << 62
    for k in sorted(steps, reverse=True):
        held += steps[k]
        if held > most:
            break
        least = 1 << k
    return least


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 5, held: int = 1,
                    order: int = ppm.ORDER, head: int = HEAD_WORDS, most: int = MAX_GRAMS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Both models learn from all documents whose fold isn't the held-out one. score is the PPM's log10
    probability of the words, joined by single spaces, and their end. A null or empty text has one token,
    its end. If nothing can be learned from, base_score uses counts of zero and the PPM is uniform.
    Repeated rows each give a row and count each; a null id is never held out; other columns aren't read.
    A trie of more than `most` grams is gone through in blocks, a pass over the documents each; a score is the sum over them.
    """
    spark = docs.sparkSession
    remainder = text_remainder(id_col, fold)
    learned = written(counts(docs.where(remainder != held).select(text_col), order), "lm-counts")
    words = learned.where(F.col("word").isNotNull()).select("word", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bottom = total + 0.5 * (distinct + 1)
    least = head_threshold(words, head)
    top = words.where(F.col("n") >= least).toArrow()
    kind = docs.schema[id_col].dataType.simpleString()
    short_batches(spark)

    def scored_by(model):
        def run(batches):
            trie, known = model.value.ready()
            get = known.get
            for b in batches:
                out: list[list] = [[] for _ in range(5)]
                for t in b.column(1).to_pylist():
                    found = words_of(t)
                    tail, base, n_known = [], 0.0, 0
                    for w in [*found, END]:
                        p = get(w)
                        if p is None:
                            tail.append(w)
                        else:
                            base += p
                            n_known += 1
                    for column, x in zip(out, (len(found) + 1, n_known, base, trie.score(coded(found)), tail)):
                        column.append(x)
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *(pa.array(c, k) for c, k in zip(out, types))], ["id", "held_out", "row", "n_tokens", "known", "base", "score", "tail"])

        return run

    def more_by(model):
        def run(batches):
            trie, _ = model.value.ready()
            for b in batches:
                out = [trie.score(coded(words_of(t))) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["row", "part"])

        return run

    schema = f"id {kind}, held_out boolean, row long, n_tokens long, known long, base double, score double, tail array<binary>"
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), (remainder == held).alias("held_out"), F.monotonically_increasing_id().alias("row"))
    scored, parts = None, []
    for made in models(learned, order, most, top, bottom):
        if scored is None and made.block:
            texts = written(texts, "lm-texts")
        model = spark.sparkContext.broadcast(made)
        del made
        if scored is None:
            scored = written(texts.mapInArrow(scored_by(model), schema), "lm-scored")
        else:
            parts.append(written(texts.select("row", "t").mapInArrow(more_by(model), "row long, part double"), "lm-part"))
        model.destroy()
    if parts:
        rest = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.sum("part").alias("part"))
        scored = scored.join(rest, "row", "left").withColumn("score", F.col("score") + F.coalesce("part", F.lit(0.0))).drop("part")
    rare = words.where(F.col("n") < least)
    tails = scored.select("row", F.explode("tail").alias("word")).join(rare, "word", "left")
    c = F.coalesce("n", F.lit(0))
    more = tails.groupBy("row").agg(F.sum(F.log10((c + 0.5) / F.lit(bottom))).alias("more"), F.sum((c > 0).cast("long")).alias("also"))
    return scored.drop("tail").join(more, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
