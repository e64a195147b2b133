"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is a character n-gram of 4 to 6 in the words of a text (lower case, a blank at each end of the
word); its value is the number of different words that hold it. A word of one letter has none. N-grams are hashed
into 2**20 places, and none is left out. Over the training rows a place's log-count ratio r compares how many toxic and how many
other texts have it, smoothed towards no difference; logistic regression with a ridge is fitted on the
features scaled by r. A text's score is the regression's probability. It is a sum over the text's
different words, so that each word is worth one number, worked out once.

Training is bounded: at most ``max_rows`` labelled rows, those with the smallest hash of their doc_id, and of these
the first that hold at most ``max_chars`` characters together; nothing else is sampled. N-grams are cut and counted on the executors; the driver fits the bounded sample.
Scores come from texts only.

Null and empty texts have no features and get the intercept's score; very long texts are scored whole. Rows
without a label or with an unknown id take no part in training; repeated labels of a document count once
(the largest), and of rows that repeat a labelled id the smallest text is learned. With labels of one class
only, or none, every score is the share of that class (0 without labels). A score of exactly 0.5, a tie, is
toxic. Repeated rows are scored alike, null ids stay null and count as not held out; an empty table gives an
empty result; other columns are ignored by ``score`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import durable, map_rows, once, quoted, ship, texts

SIZES, PLACES = (4, 5, 6), 1 << 20
MAX_ROWS, MAX_CHARS = 8000, 50_000_000
SMOOTH, RIDGE, STEPS = 1.0, 3e-3, 60
#: Words whose n-grams are gone through at a time in training.
BLOCK = 10_000
#: Words whose worth a Python worker remembers; the table is emptied when it is full.
REMEMBERED = 250_000
#: Two letters at least: with its two blanks a single one is shorter than an n-gram, and so has no feature.
_WORD = re.compile(r"[^\W\d_]{2,}")
Model = tuple[np.ndarray, float]


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def grams(word: str) -> list[int]:
    """The places of a word's different n-grams."""
    w = f" {word} ".encode("utf-32-le", "surrogatepass")
    n = len(w) // 4
    return list({crc32(w[4 * i : 4 * (i + k)]) % PLACES for k in SIZES for i in range(n - k + 1)})


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


class Scorer:
    """The log odds of a text; words met before are looked up."""

    def __init__(self, model: Model):
        (self.weights, self.intercept), self.known = model, {}

    def __call__(self, text: str) -> float:
        found, known = words(text), self.known
        worth = list(map(known.get, found))
        if None in worth:
            if len(known) > REMEMBERED:
                known.clear()
            for w in found.difference(known):
                known[w] = float(self.weights[grams(w)].sum())
            worth = map(known.__getitem__, found)
        # Exact, so that it doesn't depend on the order of a set.
        return self.intercept + math.fsum(worth)


def log_count_ratios(pos: np.ndarray, neg: np.ndarray, toxic: int, other: int, smooth: float = SMOOTH) -> np.ndarray:
    """ln of the share of toxic over the share of other texts; 0 where nothing is known."""
    prior = toxic / (toxic + other)
    up = np.log(pos + smooth * prior) - np.log(smooth * prior)
    down = np.log(neg + smooth * (1 - prior)) - np.log(smooth * (1 - prior))
    return up - down


def fit(rows: list[np.ndarray], y: np.ndarray, sizes: np.ndarray, used: np.ndarray, gram: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> Model:
    """Weights of all places, and the intercept, by Adam on the whole (bounded) sample from zero: deterministic.

    rows: the words of each text, as numbers; sizes, gram: how many places each word's n-grams have (one at least),
    and these, as numbers of ``used`` ones.
    """
    n, v = len(rows), len(sizes)
    of, word = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows]), np.concatenate([np.zeros(0, np.int32), *rows])
    k, ends = len(used), np.cumsum(sizes)
    starts = ends - sizes
    count = np.zeros((2, k))
    for own, toxic in zip(rows, y.astype(int).tolist(), strict=True):
        if len(own):
            count[toxic, np.unique(np.concatenate([gram[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]))] += 1
    r = log_count_ratios(count[1], count[0], int(y.sum()), int(n - y.sum()))
    w, m, s = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    w[k] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    # So many words at a time that what is worked out for their n-grams stays small.
    blocks = [(i, min(i + BLOCK, v)) for i in range(0, v, BLOCK)]
    worth, g = np.zeros(v), np.zeros(k + 1)
    for t in range(1, steps + 1):
        scaled = w[:k] * r
        for i, j in blocks:
            worth[i:j] = np.add.reduceat(scaled[gram[starts[i] : ends[j - 1]]], starts[i:j] - starts[i])
        z = np.bincount(of, worth[word], n) + w[k]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        pull = np.bincount(word, error[of], v)
        g[:] = 0.0
        for i, j in blocks:
            g[:k] += np.bincount(gram[starts[i] : ends[j - 1]], np.repeat(pull[i:j], sizes[i:j]), k)
        g[:k] = g[:k] * r + ridge * w[:k]
        g[k] = error.sum()
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    out = np.zeros(PLACES, np.float32)
    out[used] = w[:k] * r
    return out, float(w[k])


def _bounded(sample: DataFrame, max_chars: int) -> DataFrame:
    """The rows, by the hash of their doc_id, that hold at most so many characters; a row too long for what is left is passed over.

    sample: durable, at most MAX_ROWS rows or so; only their lengths are looked at, one after the other.
    """
    rows = sample.select("doc_id", F.length("text").alias("n"), F.xxhash64("doc_id").alias("h"))
    if (rows.agg(F.sum("n")).first()[0] or 0) <= max_chars:
        return sample
    left, chosen = max_chars, []
    for r in sorted(rows.collect(), key=lambda r: (r.h, r.doc_id)):
        if r.n <= left:
            left -= r.n
            chosen.append((r.doc_id,))
    return sample.join(F.broadcast(sample.sparkSession.createDataFrame(chosen, "doc_id long")), "doc_id", "left_semi")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """(weight of each place, intercept), from labelled rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows pairs of numbers: a proven bound. Each id counts once, however often rows repeat it.
    found = texts(docs, id_col, text_col).join(F.broadcast(known), "doc_id")
    sample = _bounded(durable(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))), max_chars)

    def of_words() -> Callable[[Iterator[tuple]], Iterable[tuple]]:
        def rows(source: Iterator[tuple]) -> Iterator[tuple]:
            seen: set[str] = set()
            for (text,) in source:
                new = words(text) - seen
                if len(seen) > 500_000:
                    seen.clear()
                seen |= new
                yield from ((_key(w), np.sort(np.array(grams(w), "<i4")).tobytes()) for w in new)

        return rows

    def together() -> Callable[[Iterator[tuple]], Iterable[tuple]]:
        """Many words in one row, so that the driver gets few."""

        def rows(source: Iterator[tuple]) -> Iterator[tuple]:
            while part := list(islice(source, 10_000)):
                yield np.array([k for k, _ in part], "<i8").tobytes(), np.array([len(x) // 4 for _, x in part], "<i4").tobytes(), b"".join(x for _, x in part)

        return rows

    def of_texts() -> Callable[[Iterator[tuple]], Iterable[tuple]]:
        return lambda source: ((toxic, np.sort(np.array([_key(w) for w in words(text)], "<i8")).tobytes()) for toxic, text in source)

    known = map_rows(sample.select("text"), of_words, "key bigint, at binary").dropDuplicates(["key"])
    parts = map_rows(known, together, "keys binary, sizes binary, at binary").collect()
    join = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[c], kind) for r in parts)])
    keys, sizes, found = join("keys", "<i8"), join("sizes", "<i4").astype(np.int64), join("at", "<i4")
    del parts
    # Sorted, so that the sums, and with them the model, don't depend on the order of tasks.
    order, first = np.argsort(keys), np.cumsum(sizes) - sizes
    keys, sizes, first = keys[order], sizes[order], first[order]
    seen = np.zeros(PLACES, bool)
    seen[found] = True
    used, number = np.flatnonzero(seen), np.cumsum(seen, dtype=np.int32) - 1
    gram, done = np.zeros(len(found), np.int32), 0
    for a, n in zip(first.tolist(), sizes.tolist(), strict=True):
        gram[done : done + n] = number[found[a : a + n]]
        done += n
    del found, first, order, number, seen
    rows = sorted((r.toxic, bytes(r.words)) for r in map_rows(sample.select("toxic", "text"), of_texts, "toxic int, words binary").collect())
    y = np.array([r[0] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return np.zeros(PLACES, np.float32), 30.0 if y.sum() else -30.0
    return fit([np.searchsorted(keys, np.frombuffer(x, "<i8")).astype(np.int32) for _, x in rows], y, sizes, used, gram)


def _key(word: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    key = f"toxicity {uuid.uuid4()}"

    def make() -> Callable[[Iterator[tuple]], Iterable[tuple]]:
        odds = once(key, lambda: Scorer(model))

        def rows(source: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, out, text in source:
                p = 1 / (1 + math.exp(-min(30.0, max(-30.0, odds(text)))))
                yield doc_id, out, p, int(p >= 0.5)

        return rows

    rows = texts(docs, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_rows(rows, make, "doc_id bigint, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` scored under 0.5, with all their columns; one pass, no join."""
    model = train(docs, labels, id_col=quoted(id_col), text_col=quoted(text_col))
    ship(docs.sparkSession)
    key = f"toxicity {uuid.uuid4()}"

    @F.pandas_udf("double")
    def scored(text):
        import pandas as pd

        odds = once(key, lambda: Scorer(model))
        return pd.Series([odds(t or "") for t in text], dtype="float64")

    return docs.filter(scored(F.col(quoted(text_col))) < 0)
