"""Language identification: script ranges, then Viterbi over the words of a text.

Every word gets a log-likelihood under each learned language, from its character n-grams of 1 to 4
characters. Languages that don't write the word's script aren't candidates for it. Viterbi with a
penalty for each switch labels spans of the text; the text's language is the one whose spans hold
most letters, and the score is their share of all letters.

Most texts are in one language, and that is proven without Viterbi: if no words, or no stretch of them,
gain more than the penalty by leaving the best single language, no path with a switch can win. The
others are decoded; ``identify`` returns their spans too.

Training is bounded: at most ``max_rows`` different documents, dealt out evenly over languages by a hash of
doc_id and text, and 65,536 hashed n-grams for each language. Counting runs on the executors.

A null text, or one without a letter, is ``und`` with score 0. Letters of scripts that no learned
language writes give the language with most training rows, as ties do. Repeated rows are labelled
alike, null ids stay null and count as not held out; an empty table gives an empty result; without
training rows every text is ``und``. Very long texts are labelled whole. Other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import durable, map_rows, once, texts
from .toxicity import held_out

BUCKETS, GRAMS = 1 << 16, (1, 2, 3, 4)
MAX_ROWS, SWITCH, SMOOTH = 6000, 12.0, 0.5
#: A script belongs to a language that has at least this share of its letters in it.
SCRIPT_SHARE = 0.01
REMEMBERED = 500_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")

#: First and last code point of each script's main blocks, as Unicode has them.
SCRIPTS = [
    (0x0041, 0x024F, "Latin"), (0x1E00, 0x1EFF, "Latin"), (0xFF21, 0xFF5A, "Latin"),
    (0x0370, 0x03FF, "Greek"), (0x1F00, 0x1FFF, "Greek"), (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"),
    (0x0A80, 0x0AFF, "Gujarati"), (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"),
    (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"), (0x0E00, 0x0E7F, "Thai"),
    (0x0E80, 0x0EFF, "Lao"), (0x1000, 0x109F, "Myanmar"), (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"), (0xAC00, 0xD7AF, "Hangul"), (0x1200, 0x139F, "Ethiopic"),
    (0x1780, 0x17FF, "Khmer"), (0x3040, 0x30FF, "Kana"), (0x3400, 0x9FFF, "Han"), (0x20000, 0x3134F, "Han"),
]


def script(letter: str) -> str:
    x = ord(letter)
    return next((name for low, high, name in SCRIPTS if low <= x <= high), "other")


#: Fixed values of the n-gram hash: odd multipliers of 64 bits.
_STEP, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: the buckets of the n-grams of all words in a row, where they are whole, and each word's start.

    A word has a blank at each end. An n-gram that runs on into the next word isn't whole.
    """
    lengths = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(lengths)
    x = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    left = np.repeat(ends, lengths) - np.arange(len(x))  # letters from here to the word's end
    h = np.zeros(len(x), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(x) - n + 1] * _STEP + x[n - 1 :]
        if n in GRAMS:
            mixed = (h ^ (h >> np.uint64(29))) * _LAST
            yield ((mixed >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64), left[: len(h)] >= n, ends - lengths


@dataclass
class Model:
    languages: list[str]  # most training rows first
    weights: np.ndarray  # n-gram bucket, language: log-likelihood
    scripts: dict[str, np.ndarray]  # languages that write it

    def score(self, words: list[str]) -> np.ndarray:
        """A row for each word: log-likelihoods by language; equal ones for unknown scripts."""
        out = np.zeros((len(words), self.weights.shape[1]))
        for bucket, whole, starts in _grams(words):
            # Only whole n-grams count; the last ones of all words may be missing behind the end.
            part = self.weights[bucket] * whole[:, None]
            out += np.add.reduceat(np.concatenate([part, np.zeros((max(GRAMS), part.shape[1]))]), starts)
        for i, w in enumerate(words):
            allowed = self.scripts.get(script(w[0]))
            if allowed is None:
                out[i] = 0.0
            elif not allowed.all():
                out[i, ~allowed] = out[i].min() - 2 * SWITCH
        return out - out.max(1, keepdims=True)


def _sample(rows: DataFrame, max_rows: int) -> DataFrame:
    """lang, text of at most ``max_rows`` different rows, each language its even share; durable.

    A row's place is a hash between 0 and 1; of a language with n rows those below its share / n are taken.
    Neither a language nor an id that many rows have meets in one task.
    """
    spark = rows.sparkSession
    keys = durable(rows.select("lang", "doc_id", F.xxhash64("text").alias("t")).distinct())
    # A language without one of the max_rows largest counts gets no row: a proven bound.
    sizes = keys.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows).collect()
    low, high = 0.0, float(max_rows)
    for _ in range(60):  # the share that uses max_rows up
        share = (low + high) / 2
        low, high = (share, high) if sum(min(share, r.n) for r in sizes) <= max_rows else (low, share)
    least = spark.createDataFrame([(r.lang, min(1.0, 1.05 * low / r.n)) for r in sizes], "lang string, least double")
    place = F.pmod(F.xxhash64("doc_id", "t"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    taken = keys.join(F.broadcast(least), "lang").withColumn("place", place / F.col("least")).filter("place <= 1")
    taken = taken.orderBy("place", "lang", "doc_id", "t").limit(max_rows).select("lang", "doc_id", "t")
    # At most max_rows keys: a proven bound.
    found = rows.withColumn("t", F.xxhash64("text")).join(F.broadcast(taken), ["lang", "doc_id", "t"])
    return durable(found.groupBy("lang", "doc_id", "t").agg(F.min("text").alias("text")).select("lang", "text"))


def train(docs: DataFrame, max_rows: int = MAX_ROWS, folds: int = 3, fold: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    sample = _sample(rows, max_rows)

    def make() -> Callable[[Iterator[tuple]], Iterable[tuple]]:
        def counted(source: Iterator[tuple]) -> Iterator[tuple]:
            words: dict[str, Counter] = defaultdict(Counter)
            docs: Counter = Counter()
            for lang, text in source:
                docs[lang] += 1
                words[lang].update(w for w in _WORD.findall(text.lower()))
            for lang, count in words.items():
                grams, scripts, own = np.zeros(BUCKETS, np.int64), Counter(), list(count)
                times = np.repeat(np.fromiter(count.values(), np.int64), [len(w) + 2 for w in own])
                for bucket, whole, _ in _grams(own):
                    np.add.at(grams, bucket[whole], times[: len(whole)][whole])
                for w, n in count.items():
                    scripts[script(w[0])] += n * len(w)
                yield from ((lang, "gram", str(b), int(grams[b])) for b in np.flatnonzero(grams).tolist())
                yield from ((lang, "script", s, n) for s, n in scripts.items())
            yield from ((lang, "rows", "", n) for lang, n in docs.items())

        return counted

    found = map_rows(sample, make, "lang string, kind string, name string, n bigint").groupBy("lang", "kind", "name").agg(F.sum("n").alias("n")).collect()
    size = {r.lang: r.n for r in found if r.kind == "rows"}
    languages = sorted(size, key=lambda x: (-size[x], x))
    at = {x: i for i, x in enumerate(languages)}
    counts, written = np.zeros((BUCKETS, len(languages))), defaultdict(lambda: np.zeros(len(languages)))
    for r in found:
        if r.kind == "gram":
            counts[int(r.name), at[r.lang]] = r.n
        elif r.kind == "script":
            written[r.name][at[r.lang]] = r.n
    weights = np.log(counts + SMOOTH) - np.log(counts.sum(0) + SMOOTH * BUCKETS) if languages else counts
    letters = sum(written.values()) if written else np.ones(len(languages))
    scripts = {s: n >= SCRIPT_SHARE * np.maximum(letters, 1) for s, n in written.items()}
    return Model(languages, weights, {s: x for s, x in scripts.items() if x.any()})


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best path of each text, by word. scores: the words of all texts, a column a language.

    A step needs few languages' sums only, for which plain numbers are faster than arrays.
    """
    out, start = np.zeros(len(scores), np.int16), 0
    for n in lengths.tolist():
        if not n:
            continue
        rows = scores[start : start + n].tolist()
        best, back = rows[0], []
        for row in rows[1:]:
            top = max(best)
            jump = top - switch
            if min(best) < jump:
                back.append((best.index(top), [x < jump for x in best]))
                best = [(x if x >= jump else jump) + y for x, y in zip(best, row, strict=True)]
            else:
                back.append(None)
                best = [x + y for x, y in zip(best, row, strict=True)]
        state = best.index(max(best))
        path = [state] * n
        for t in range(n - 2, -1, -1):
            step = back[t]
            if step is not None and step[1][state]:
                state = step[0]
            path[t] = state
        out[start : start + n] = path
        start += n
    return out


def label(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """As ``viterbi``, but texts proven to be in one language aren't decoded."""
    n, k = scores.shape
    if not n or k == 1:
        return np.zeros(n, np.int16)
    full = np.flatnonzero(lengths > 0)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)[full]
    single = np.add.reduceat(scores, starts).argmax(1)
    of = np.repeat(np.arange(len(full)), lengths[full])
    mine = single[of]
    rest = scores.copy()
    rest[np.arange(n), mine] = -np.inf
    gain = np.minimum(rest.max(1) - scores[np.arange(n), mine], 2 * switch)
    # The best sum over stretches that end here; texts are set so far apart that none runs on.
    low = 4.0 * switch * int(lengths.max(initial=1)) + np.abs(gain).sum()
    run = np.cumsum(gain) - low * of
    before = np.concatenate([[0.0], run[:-1]])
    before[starts] = (np.concatenate([[0.0], np.cumsum(gain)])[starts]) - low * np.arange(len(full))
    most = np.maximum.reduceat(run - np.minimum.accumulate(before), starts)
    out = mine.astype(np.int16)
    mixed = np.flatnonzero(most > switch - 1e-3)
    if len(mixed):
        at = np.isin(of, mixed)
        out[at] = viterbi(scores[at], lengths[full][mixed], switch)
    return out


def spans(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (first word, end, language)."""
    path, out, at = label(scores, lengths, switch), [], 0
    for n in lengths.tolist():
        own = path[at : at + n]
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), n] if n else [0]
        out.append([(a, b, int(own[a])) for a, b in zip(cuts, cuts[1:], strict=False)])
        at += n
    return out


class Labeller:
    """Words met before are looked up; a row of the tables is a word's scores, and what it gains by leaving each language."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.languages)), np.float32)
        self.gains = np.zeros_like(self.scores)
        self.letters = np.zeros(1024, np.int64)

    def rows_of(self, words: list[str]) -> list[int]:
        rows = list(map(self.known.get, words))
        if None in rows:
            new = list({w for w, r in zip(words, rows, strict=True) if r is None})
            if len(self.known) + len(new) > REMEMBERED:
                self.clear()
                new = list(set(words))
            self._learn(new)
            rows = list(map(self.known.__getitem__, words))
        return rows

    def _learn(self, new: list[str]) -> None:
        at = len(self.known)
        while at + len(new) > len(self.letters):
            self.scores, self.gains, self.letters = (np.concatenate([x, np.zeros_like(x)]) for x in (self.scores, self.gains, self.letters))
        scores = self.model.score(new).astype(np.float32)
        # Signs that only count as numbers, such as superscripts, aren't letters.
        self.letters[at : at + len(new)] = [sum(map(str.isalpha, w)) for w in new]
        self.scores[at : at + len(new)] = scores
        for k in range(scores.shape[1]):
            others = np.delete(scores, k, axis=1)
            self.gains[at : at + len(new), k] = others.max(1) - scores[:, k] if others.shape[1] else 0.0
        self.known.update(zip(new, range(at, at + len(new)), strict=True))

    def __call__(self, texts: list[str]) -> list[tuple[str, float, str]]:
        """The language of each text, its share of the letters, and the text's spans as ``language:start:end``.

        A span starts with its first word (the first one with the text) and ends where the next one starts.
        """
        languages = self.model.languages
        if not languages:
            return [(UNKNOWN, 0.0, "")] * len(texts)
        found = [_WORD.findall(t.lower()) for t in texts]
        at = np.array(self.rows_of([w for f in found for w in f]), np.int64)
        of = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        keep = self.letters[at] > 0
        at, of = at[keep], of[keep]
        letters = self.letters[at]
        total = np.bincount(of, letters, len(texts))
        out: list[tuple[str, float, str]] = [(UNKNOWN, 0.0, "")] * len(texts)
        if not len(at):
            return out
        lengths = np.bincount(of, minlength=len(texts))
        full = np.flatnonzero(lengths)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[full]
        mine = np.add.reduceat(self.scores[at], starts, dtype=np.float64).argmax(1)
        # No path with a switch can win where all that words gain by leaving the best language is no more than the penalty.
        gain = np.maximum(self.gains[at, np.repeat(mine, lengths[full])], 0)
        mixed = np.flatnonzero(np.add.reduceat(gain, starts, dtype=np.float64) > SWITCH - 1e-3)
        for i, k in zip(full.tolist(), mine.tolist(), strict=True):
            out[i] = (languages[k], 1.0, f"{languages[k]}:0:{len(texts[i])}")
        taken = np.isin(np.repeat(np.arange(len(full)), lengths[full]), mixed)
        paths = label(self.scores[at[taken]].astype(np.float64), lengths[full[mixed]])
        done = 0
        for i, a in zip(full[mixed].tolist(), starts[mixed].tolist(), strict=True):
            own = slice(a, a + int(lengths[i]))
            path = paths[done : done + int(lengths[i])]
            done += len(path)
            share = np.bincount(path, letters[own], len(languages))
            best = int(share.argmax())
            cuts = np.flatnonzero(np.diff(path)) + 1
            if not len(cuts):
                continue
            first = self._places(texts[i])
            ends = [0, *(first[c] for c in cuts.tolist()), len(texts[i])]
            parts = zip(path[[0, *cuts]].tolist(), ends, ends[1:], strict=False)
            out[i] = (languages[best], float(share[best] / total[i]), ",".join(f"{languages[x]}:{b}:{e}" for x, b, e in parts))
        return out

    def _places(self, text: str) -> list[int]:
        """Where the words with letters start, in the text itself."""
        low = text.lower()
        if len(low) == len(text):
            return [m.start() for m in _WORD.finditer(low) if self.letters[self.known[m[0]]] > 0]
        # Some letters are longer in lower case: each is counted back.
        back = [i for i, c in enumerate(text) for _ in c.lower()]
        return [back[m.start()] for m in _WORD.finditer(low) if self.letters[self.known[m[0]]] > 0]


def identify(docs: DataFrame, model: Model, folds: int = 3, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_spans for every row."""
    key = f"language {uuid.uuid4()}"

    def make() -> Callable[[Iterator[tuple]], Iterable[tuple]]:
        labeller = once(key, lambda: Labeller(model))

        def rows(source: Iterator[tuple]) -> Iterator[tuple]:
            batch: list[tuple] = []
            held = 0
            for row in source:
                batch.append(row)
                held += len(row[2])
                if held >= 500_000:
                    yield from ((i, out, *found) for (i, out, _), found in zip(batch, labeller([t for *_, t in batch]), strict=True))
                    batch, held = [], 0
            if batch:
                yield from ((i, out, *found) for (i, out, _), found in zip(batch, labeller([t for *_, t in batch]), strict=True))

        return rows

    rows = texts(docs, id_col, text_col).select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "text")
    return map_rows(rows, make, "doc_id bigint, held_out boolean, lang_pred string, score double, lang_spans string")
