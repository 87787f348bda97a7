"""Language ID with hyperdimensional profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, text_remainder

#: Length of the vectors.
DIMENSIONS = 1024
GRAM = 3
#: Slots of letter vectors: 0 ends a word, 1 to 26 are a to z, the others are shared by all other letters.
SLOTS = 64
SEED = 7
#: Gram vectors that a worker keeps; others are bound anew each time.
KEPT = 1 << 14
UNKNOWN = "und"
#: Languages whose grams a task counts at once.
HELD_LANGS = 32
#: A filter asks for a cosine of ROOT_COSINE times the root of a text's number of grams, up to LEAST_COSINE: vectors of grams that no
#: language has come out at 0.03, seldom at 0.1, random Latin letters at 0.16 where a text is long; clean texts of forty grams or
#: more have 0.25 at least, shorter ones can have less.
ROOT_COSINE, LEAST_COSINE = 0.01, 0.16


def _slots() -> np.ndarray:
    """Code point to slot; letters by their lower case, everything else ends a word."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[cp] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 % (SLOTS - 27)
    return table


class Space:
    """Random letter vectors, bound into gram vectors: the letter j places from the end is permuted j times."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        letters = rng.choice(np.array([-1, 1], np.float32), (SLOTS, DIMENSIONS))
        order = rng.permutation(DIMENSIONS)
        self.placed = [letters]
        for _ in range(GRAM - 1):
            self.placed.append(self.placed[-1][:, order])
        self.slots = _slots()
        self.row = np.full(SLOTS**GRAM, -1, np.int32)
        self.rows = np.empty((0, DIMENSIONS), np.float32)
        self.used = 0

    def bind(self, grams: np.ndarray) -> np.ndarray:
        out = self.placed[0][grams % SLOTS].copy()
        for j in range(1, GRAM):
            out *= self.placed[j][grams // SLOTS**j % SLOTS]
        return out

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """A row for each gram, from those kept where possible."""
        missing = grams[self.row[grams] < 0]
        if len(missing) and self.used + len(missing) > KEPT:
            return self.bind(grams)
        if len(missing):
            while self.used + len(missing) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty((max(1024, len(self.rows)), DIMENSIONS), np.float32)])
            self.rows[self.used : self.used + len(missing)] = self.bind(missing)
            self.row[missing] = np.arange(self.used, self.used + len(missing))
            self.used += len(missing)
        return self.rows[self.row[grams]]

    def grams(self, text: str | None) -> np.ndarray:
        """The grams of the letters, with a mark before, between and after words; none if there is no letter."""
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        s = np.concatenate([[0], self.slots[points], [0]]).astype(np.int32)
        s = s[(s != 0) | np.r_[True, s[:-1] != 0]]
        if len(s) < GRAM:
            return np.empty(0, np.int32)
        n = len(s) - GRAM + 1
        out = s[:n].copy()
        for j in range(1, GRAM):
            out = out * SLOTS + s[j : j + n]
        return out

    def bundle(self, grams: np.ndarray) -> np.ndarray:
        """The sum of the vectors of all grams, repeats counted."""
        found, n = np.unique(grams, return_counts=True)
        return n.astype(np.float32) @ self.vectors(found)


_space: list[Space] = []


def space() -> Space:
    if not _space:
        _space.append(Space())
    return _space[0]


class Profiles:
    """A prototype per language: the bundle of all grams of its documents, at unit length."""

    def __init__(self, langs: list[str], bundles: np.ndarray):
        self.langs = langs
        unit = bundles / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-9)
        self.unit = unit.astype(np.float32)

    def best(self, grams: np.ndarray) -> tuple[int, float]:
        """The nearest prototype and its cosine."""
        v = space().bundle(grams)
        cos = self.unit @ v / max(float(np.linalg.norm(v)), 1e-9)
        k = int(np.argmax(cos))
        return k, float(cos[k])

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = space().grams(text)
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        k, cos = self.best(grams)
        return self.langs[k], min(1.0, max(0.0, cos))

    def told(self, text: str | None, least: float) -> bool:
        """Whether the text is near enough to a language, for its length."""
        grams = space().grams(text)
        return bool(len(grams) and self.langs and self.best(grams)[1] > min(least, ROOT_COSINE * len(grams) ** 0.5))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from all rows with a language. Bundling is addition, so tasks count grams and Spark adds the counts.

    The driver gets a count per (language, gram): grams have 64**3 values, whatever the corpus. Null texts
    add nothing; ties between languages go to the first in order.
    """
    short_batches(docs.sparkSession)

    def rows(counts):
        for lang, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(held[at])], ["lang", "gram", "n"])

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang not in counts and len(counts) >= HELD_LANGS:
                    yield from rows(counts)
                    counts = {}
                held = counts.setdefault(lang, np.zeros(SLOTS**GRAM, np.int64))
                grams = space().grams(text)
                if len(grams) * 16 > len(held):
                    held += np.bincount(grams, minlength=len(held))
                else:
                    np.add.at(held, grams, 1)
        yield from rows(counts)

    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sums = labelled.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique().tolist())
    bundles = np.zeros((len(langs), DIMENSIONS))
    for k, lang in enumerate(langs):
        own = sums[sums["lang"] == lang].sort_values("gram")
        grams, n = own["gram"].to_numpy(), own["n"].to_numpy().astype(float)
        for i in range(0, len(grams), KEPT):
            bundles[k] += n[i : i + KEPT] @ space().bind(grams[i : i + KEPT])
    return Profiles(langs, bundles)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (the best cosine, 0 to 1) of each document.

    A null text, or one without a letter, is `und` with score 0, as is everything if nothing was learned.
    Repeated rows each give a row; other columns are not read; no rows in, no rows out.
    """
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [profiles.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "lang_pred", "score"])

    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return got.withColumnRenamed("id", id_col)


def train_fold(docs: DataFrame) -> Profiles:
    """Profiles from the documents that the contract lets us learn from."""
    return train(docs.where(text_remainder("doc_id", 3) != 1))


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all documents; lang, source and doc_id don't enter a prediction."""
    got = identify(docs, train_fold(docs))
    return got.select("doc_id", (text_remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """The documents whose language can be told, with all their columns: some letter, and a cosine over `least`, or less for short texts.

    Null and empty texts go, as does everything if no row has a language to learn from. Repeated rows stay or go alike, whatever else
    they hold; no rows in, no rows out.
    """
    profiles = train_fold(docs)
    at = docs.columns.index("text")
    short_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([profiles.told(t, least) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
