"""Words of unspaced text by a dictionary, and sentence ends that know abbreviations; both learned from the corpus without labels."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.io import kept

# Dictionary segmentation --------------------------------------------------------------------

#: Words of a dictionary at most: the most frequent ones of the corpus (a bound of the model, like its longest word).
WORDS, LONGEST = 200_000, 24


def dictionary(docs: DataFrame, text: str, words: int = WORDS, longest: int = LONGEST) -> DataFrame:
    """term, n: how often each word occurs in spaced texts, the ``words`` most frequent of ``longest`` characters at most.

    All words are counted into a table of their own, and how many occur so often is counted first: only words that may
    be among the most frequent are put in order.
    """
    terms = docs.select(F.explode(tx.unicode_tokens(F.col(text))).alias("term")).filter(F.length("term") <= longest)
    counts, left, least = kept(terms.groupBy("term").agg(F.count("*").alias("n")), "words"), words, 0
    # Numbers of occurrences are few: each adds its own number to the number of all tokens.
    for level in counts.groupBy("n").agg(F.count("*").alias("many")).orderBy(F.desc("n")).collect():
        if left <= 0:
            break
        left, least = left - level.many, level.n
    return counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(words)


#: Characters that are cut at a time, so that tables of them stay near the processor; steps of fewer words are taken one by one.
CHARS, STEP = 1 << 17, 24
#: Pairs of letters whose beginnings have a table of their own, without gaps.
PAIRS = 1 << 20


class BestPath:
    """Cuts a text along the path of words that costs least: a word costs -ln of its share.

    A character that no word covers is a token of its own and costs ``unknown`` times the rarest word. Of equally cheap
    paths the one with the longer last word is taken. Words are walked through a table of their beginnings, from all
    places of many texts at once, so that a look-up ends where no word goes on. Every path goes through a place that no
    word goes across: paths are found in the pieces between such places, all pieces side by side.
    """

    def __init__(self, counts: Iterable[tuple[str, int]], unknown: float = 2.0):
        rows = [(w, n) for w, n in counts if w and n > 0]
        total = sum(n for _, n in rows)
        self.cost = {w: math.log(total) - math.log(n) for w, n in rows}
        self.alone = unknown * max(self.cost.values(), default=1.0) + 1.0
        words = list(self.cost)
        flat, size = _points("".join(words)), np.array([len(w) for w in words], np.int64)
        # Letters have numbers from 1; 0 is in no word.
        points, letter = np.unique(flat, return_inverse=True)
        self.letters, at = len(points) + 1, np.cumsum(size) - size
        self.number = np.zeros(0x110000, np.int32)
        self.number[points] = np.arange(1, self.letters)
        # A beginning is known by the beginning without its last letter, and that letter.
        node, keys, n, live = np.zeros(len(words), np.int64), [np.zeros(0, np.int64)], 1, np.arange(len(words))
        for d in range(int(size.max(initial=0))):
            live = live[size[live] > d]
            own, which = np.unique(node[live] * self.letters + letter[at[live] + d] + 1, return_inverse=True)
            node[live], n = n + which, n + len(own)
            keys.append(own)
        self.price = np.full(n, np.inf)
        self.price[node] = list(self.cost.values())
        self.word = self.price < np.inf
        self._place(np.concatenate(keys))
        every = np.arange(self.letters)
        first = self._next(np.zeros(self.letters, np.int32), every)
        self.single = np.where(first > 0, np.minimum(self.price[first], self.alone), self.alone)
        self.first, self.pairs = first, None
        if self.letters**2 <= PAIRS:
            self.pairs = np.where(np.repeat(first, self.letters) > 0, self._next(np.repeat(first, self.letters), np.tile(every, self.letters)), 0)

    def _place(self, keys: np.ndarray) -> None:
        """The table of beginnings: a key lies at the first free place from its hash on."""
        self.bits = int(4 * len(keys) + 4).bit_length()
        self.keys, self.nodes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        at, todo = self._hash(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            self.keys[at[free]] = keys[free]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        self.nodes[at] = np.arange(1, len(keys) + 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def _next(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The beginnings that go on by a letter; 0 for none."""
        key = node.astype(np.int64) * self.letters + letter
        place = self._hash(key)
        found = self.keys[place]
        lost = np.flatnonzero((found != key) & (found >= 0))
        while len(lost):
            place[lost] = (place[lost] + 1) & ((1 << self.bits) - 1)
            found[lost] = self.keys[place[lost]]
            lost = lost[(found[lost] != key[lost]) & (found[lost] >= 0)]
        return np.where(found == key, self.nodes[place], 0)

    def _words(self, letter: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """length, start, cost of all words of two letters or more in a row of letters that ends with a 0, by length."""
        at, length = np.flatnonzero(letter[:-1] * letter[1:]), 2
        if self.pairs is None:
            node = self._next(self.first[letter[at]], letter[at + 1])
        else:
            node = self.pairs[letter[at] * self.letters + letter[at + 1]]
        while True:
            some = np.flatnonzero(node)
            if not len(some):
                return
            at, node = at[some], node[some]
            word = np.flatnonzero(self.word[node])
            yield length, at[word], self.price[node[word]]
            # A word that reaches the 0 goes no further.
            then = letter[at + length]
            some = np.flatnonzero(then)
            at, length = at[some], length + 1
            node = self._next(node[some], then[some])

    def _cuts(self, letter: np.ndarray) -> np.ndarray:
        """Whether the best path of a row of letters, with a 0 behind it, goes through a place."""
        n = len(letter) - 1
        far, edges = np.arange(1, n + 1), []
        for length, at, price in self._words(letter):
            far[at] = at + length
            edges.append((at, at + length, price))
        cut = np.ones(n + 1, bool)
        cut[1:] = np.maximum.accumulate(far) == np.arange(1, n + 1)
        first = np.flatnonzero(cut)
        # Pieces of one character need no path.
        at = np.flatnonzero(~(cut[:-1] & cut[1:]))
        edges.append((at, at + 1, self.single[letter[at]]))
        start, stop, price = (np.concatenate(x) for x in zip(*edges, strict=True))
        step = (np.arange(n) - np.repeat(first[:-1], np.diff(first)))[start]
        order = np.argsort(step.astype(np.uint16) if step.max(initial=0) < 1 << 16 else step, kind="stable")
        start, stop, price = start[order], stop[order], price[order]
        best, back, done = np.full(n + 1, np.inf), np.arange(-1, n), 0
        # Words of one step end at places of their own: they start in pieces of their own, or differ in length.
        for k, many in enumerate(np.bincount(step).tolist()):
            if many < STEP:
                break
            a, b, c = start[done : done + many], stop[done : done + many], price[done : done + many]
            # The end of a piece is the start of the next one, which costs nothing.
            c = best[a] + c if k else c
            less = c < best[b]
            a, b = a[less], b[less]
            best[b], back[b], done = c[less], a, done + many
        self._last(start[done:], stop[done:], price[done:], cut, best, back)
        at = first[1:]
        while len(at):
            at = back[at]
            at = at[~cut[at]]
            cut[at] = True
        return cut

    @staticmethod
    def _last(start: np.ndarray, stop: np.ndarray, price: np.ndarray, cut: np.ndarray, best: np.ndarray, back: np.ndarray) -> None:
        """The steps of few words, which lie by rising step."""
        used = np.unique(np.concatenate([start, stop]))
        costs, backs = dict(zip(used.tolist(), best[used].tolist(), strict=True)), {}
        for a, b, c, fresh in zip(start.tolist(), stop.tolist(), price.tolist(), cut[start].tolist(), strict=True):
            c = c if fresh else costs[a] + c
            if c < costs[b]:
                costs[b], backs[b] = c, a
        back[list(backs)] = list(backs.values())

    def many(self, texts: list[str]) -> Iterator[list[str]]:
        """Each text's tokens."""
        i = 0
        while i < len(texts):
            size, j = len(texts[i]), i + 1
            while j < len(texts) and size + len(texts[j]) < CHARS:
                size, j = size + len(texts[j]), j + 1
            part = texts[i:j]
            letter = self.number[_points("\0".join(part) + "\0")]
            ends = np.cumsum([len(t) + 1 for t in part]) - 1
            letter[ends] = 0
            at = np.flatnonzero(self._cuts(letter))
            own = np.searchsorted(at, [ends - [len(t) for t in part], ends + 1])
            for t, end, a, b in zip(part, ends.tolist(), *own.tolist(), strict=True):
                yield [t[x:y] for x, y in pairwise((at[a:b] - (end - len(t))).tolist())]
            i = j

    def __call__(self, text: str) -> list[str]:
        return next(self.many([text]))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


# Abbreviations --------------------------------------------------------------------------------

#: Fixed values of the published method: how likely a full stop is behind an abbreviation, and the least score of one.
CLOSED, LEAST = 0.99, 0.3
#: A word with its inner and final full stops.
WORD = r"[\p{L}\p{N}][\p{L}\p{N}_.'’-]*"
#: Stands for a full stop that ends no sentence.
MARK = "\ue000"
#: Abbreviations that a plan may hold.
MOST = 100_000


def word_stops(docs: DataFrame, text: str) -> DataFrame:
    """type, n, k: how often each lower-cased word occurs, and how often one full stop is behind it."""
    token = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"))).alias("w"))
    stop = F.col("w").endswith(".") & ~F.col("w").endswith("..")
    rows = token.select(F.when(stop, F.expr("substr(w, 1, length(w) - 1)")).otherwise(F.col("w")).alias("type"), stop.cast("int").alias("k"))
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


def abbreviations(docs: DataFrame, text: str, least: float = LEAST) -> DataFrame:
    """type, n, k, score: words whose full stop belongs to them, by a log-likelihood ratio, scaled for length, inner stops and use without one.

    The ratio compares a full stop that is nearly always there with one at the corpus's rate. Two passes over the texts: the
    words' counts, of which a row each is left, and the corpus's own sums of these.
    """
    types = word_stops(docs, text)
    total = types.agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"))  # one row
    rows = types.filter((F.col("k") > 0) & F.col("type").rlike(r"\p{L}")).crossJoin(F.broadcast(total))
    n, k, p = F.col("n").cast("double"), F.col("k").cast("double"), F.col("all_k") / F.col("all_n")
    # A word that never stands without one adds nothing for the others, whatever the rate.
    others = lambda q: F.when(n == k, 0.0).otherwise((n - k) * F.ln(1 - q))
    ratio = 2 * ((k * math.log(CLOSED) + others(F.lit(CLOSED))) - (k * F.ln(p) + others(p)))
    stops = F.length(F.regexp_replace("type", r"[^.]", ""))
    size = (F.length("type") - stops).cast("double")
    score = ratio * F.exp(-size) * (stops + 1) * F.pow(size, -(n - k))
    return rows.select("type", "n", "k", score.alias("score")).filter(F.col("score") >= least)


def whole_sentences(text: Column, known: list[str]) -> Column:
    """As ``functions.text.sentences``, but a full stop behind one of the ``known`` words, lower-cased, ends no sentence."""
    words = frozenset(known)
    if len(words) > MOST:
        raise ValueError(f"over {MOST} abbreviations")
    stop = re.compile(r"([^\W_][\w.'’-]*)\.(?=\s)")

    def hold(texts: pd.Series) -> pd.Series:
        keep = lambda m: m[1] + MARK if m[1].lower() in words else m[0]
        return texts.map(lambda t: None if t is None else stop.sub(keep, t))

    held = F.pandas_udf(hold, "string")(text) if words else text
    back = lambda s: F.struct(F.replace(s["text"], F.lit(MARK), F.lit(".")).alias("text"), s["starts_paragraph"].alias("starts_paragraph"))
    return F.transform(tx.sentences(held), back)
