"""Benchmark decontamination by greedy string tiling.

Texts are compared as lower-case tokens (runs of letters and digits). A document and an item that
share a seed, four tokens in a row, are joined. For a pair whose seeds could cover enough of the
item, tiles are laid: again and again the longest matches between tokens not yet marked,
found by Karp-Rabin hashes of running length, are marked, until none has four tokens. An item
leaked if its tiles cover at least half of its tokens, in whatever order they come.

The benchmark is a stated query set and is taken in blocks of bounded size, each broadcast and
held against every row; hashes find candidates, tokens decide. An item of under four tokens has no seed: it
leaked where all its tokens follow each other. Null counts as empty; texts and items without tokens match
nothing. Very long texts are compared whole. Of equally long matches, ties, the first in the document is
marked, then the first in the item. Repeated rows and items are reported each; null ids stay null. Empty
tables give an empty result; other columns are ignored by ``leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import map_rows, once, quoted, ship, texts

LEAST, COVERAGE = 4, 0.5
#: Tokens of benchmark items in one block.
BLOCK_TOKENS = 2_000_000
SCHEMA = "doc_id bigint, item_id bigint, item_tokens int, tiled_tokens int, n_tiles int, coverage double"
_TOKEN = re.compile(r"[^\W_]+")
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n, modulo 2**64, from prefix sums."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(ids), _BASE, np.uint64), dtype=np.uint64)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers, dtype=np.uint64)])
        # Each sum is brought to the power of the last run, as division isn't possible.
        return (sums[n:] - sums[:-n]) * powers[::-1][: len(ids) - n + 1]


def _short(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of short runs that don't depend on the length of ``ids``."""
    count = len(ids) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        h = np.zeros(count, np.uint64)
        for i in range(n):
            h = h * _BASE + mixed[i : i + count]
        return h


def tile(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two arrays of token ids (>= 0): (place in doc, place in item, length).

    Longest first; of equally long ones the first in the document, then in the item.
    """
    d, t = doc.astype(np.int64), item.astype(np.int64)
    tiles, longest = [], min(len(d), len(t))

    def shared(n: int) -> tuple[np.ndarray, np.ndarray]:
        both = _hashes(np.concatenate([d, t]), n)
        return both[: max(0, len(d) - n + 1)], both[len(d) :]

    while longest >= least:
        low, high = least - 1, longest
        while low < high:  # the longest length at which some run is shared
            mid = (low + high + 1) // 2
            a, b = shared(mid)
            low, high = (mid, high) if np.isin(b, a).any() else (low, mid - 1)
        if low < least:
            break
        a, b = shared(low)
        places: dict[int, list[int]] = {}
        for j, h in enumerate(b.tolist()):
            places.setdefault(h, []).append(j)
        left = len(b)
        found = False
        for i in np.flatnonzero(np.isin(a, b)).tolist():
            if not left:
                break
            for j in places[int(a[i])]:
                if (d[i : i + low] == t[j : j + low]).all() and d[i] >= 0:
                    tiles.append((i, j, low))
                    # Marked tokens become unlike all others.
                    d[i : i + low] = -1 - 2 * np.arange(i, i + low)
                    t[j : j + low] = -2 - 2 * np.arange(j, j + low)
                    left = int((np.convolve(t >= 0, np.ones(low, int), "valid") == low).sum())
                    found = True
                    break
        longest = low if found else low - 1
    return tiles


class Items:
    """A block of the benchmark, ready to be held against documents."""

    def __init__(self, block: list[tuple[int, str]], least: int, coverage: float):
        self.least, self.coverage = least, coverage
        self.ids: dict[str, int] = {}
        self.items = []
        self.few: dict[tuple, list[int]] = {}  # items without a seed, by their tokens
        hashes, owners, places = [], [], []
        for item_id, text in block:
            own = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in tokens(text)], np.int64)
            if len(own) < least:
                if len(own):
                    self.few.setdefault(tuple(own.tolist()), []).append(item_id)
                continue
            h = _short(own, least)
            hashes.append(h)
            owners.append(np.full(len(h), len(self.items)))
            places.append(np.arange(len(h)))
            self.items.append((item_id, own))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hash = flat[order]
        self.owner = np.concatenate(owners)[order] if owners else flat
        self.place = np.concatenate(places)[order] if places else flat

    def leaks(self, text: str) -> Iterator[tuple]:
        """item_id, its tokens, tiled tokens, tiles, coverage of each item that leaked."""
        n = self.least
        ids = np.fromiter(map(self.ids.get, tokens(text), repeat(0)), np.int64)
        for size in {len(t) for t in self.few}:
            known = ids.tolist()
            for run in self.few.keys() & set(zip(*(known[i:] for i in range(size)), strict=False)):
                yield from ((item_id, size, size, 1, 1.0) for item_id in self.few[run])
        if len(ids) < n or not len(self.hash):
            return
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        at = np.flatnonzero(known[n:] - known[:-n] == n)  # runs of tokens that items have
        if not len(at):
            return
        h = _short(ids, n)[at]
        low, high = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        hit = high > low
        at, low, high = at[hit], low[hit], high[hit]
        if not len(at):
            return
        seeds, first = np.unique(low, return_index=True)
        slots = np.concatenate([np.arange(a, b) for a, b in zip(seeds, high[first], strict=True)])
        cover: dict[int, set[int]] = {}
        for owner, place in zip(self.owner[slots].tolist(), self.place[slots].tolist(), strict=True):
            cover.setdefault(owner, set()).update(range(place, place + n))
        for owner, covered in sorted(cover.items()):
            item_id, own = self.items[owner]
            if len(covered) < self.coverage * len(own):
                continue
            mine = np.isin(h[hit], self.hash[self.owner == owner])
            keep = np.zeros(len(ids) + 1, np.int64)
            np.add.at(keep, at[mine], 1)
            np.add.at(keep, at[mine] + n, -1)
            inside = np.cumsum(keep[:-1]) > 0
            # Between the stretches with seeds one strange token is left, so that none runs on.
            edge = inside | np.concatenate([[False], inside[:-1]])
            short = np.where(inside, ids, 0)[edge]
            tiles = tile(short, own, n)
            tiled = sum(x[2] for x in tiles)
            if tiled >= self.coverage * len(own):
                yield item_id, len(own), tiled, len(tiles), tiled / len(own)


def blocks(benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's rows, so many at a time as have about ``block_tokens`` tokens."""
    block, held = [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit(""))).toLocalIterator():
        block.append((item_id, text))
        held += 1 + len(text) // 5
        if held >= block_tokens:
            yield block
            block, held = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each document and item that leaked into it, with the tiles' coverage."""
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    out = spark.createDataFrame([], SCHEMA)
    for block in blocks(benchmark, block_tokens):
        sent, key = spark.sparkContext.broadcast(block), f"items {uuid.uuid4()}"

        def make(sent=sent, key=key) -> Callable[[Iterator[tuple]], Iterable[tuple]]:
            items = once(key, lambda: Items(sent.value, least, coverage))
            return lambda source: ((doc_id, *leak) for doc_id, text in source for leak in items.leaks(text))

        out = out.unionByName(map_rows(rows, make, SCHEMA))
    return out


def _leaked(sent: Broadcast, least: int, coverage: float) -> Callable:
    key = f"items {uuid.uuid4()}"

    def leaked(text):
        import pandas as pd

        items = once(key, lambda: Items(sent.value, least, coverage))
        return pd.Series([next(items.leaks(t or ""), None) is not None for t in text], dtype="bool")

    return F.pandas_udf(leaked, "boolean")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of ``docs`` into which no item leaked, with all their columns; no join."""
    spark = docs.sparkSession
    ship(spark)
    for block in blocks(benchmark, block_tokens):
        sent = spark.sparkContext.broadcast(block)
        docs = docs.filter(~_leaked(sent, least, coverage)(F.col(quoted(text_col))))
    return docs
