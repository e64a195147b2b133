"""Sum-of-squares online packing into sequences of fixed capacity.

A task reads its documents in order. Windows that are partly filled are counted by fill level in
one array N; a piece of s tokens goes to the level h, empty windows included, that makes the sum
of N[h]**2 smallest afterwards; of equal sums the lowest level, and in a level the window filled last. A
document longer than a window, however long, fills whole windows first and places its rest. At most OPEN
windows are open: when one more is, the emptiest is emptied into the gaps of the fullest, cutting
pieces where a gap ends (in practice some 300 are open, however many documents a task has). When a task
ends, open windows that are 15/16 full stay as they are; the others, which there is nothing left to fill,
are emptied into each other in the same way, so that one of them at most stays padded.

Tasks are independent: nothing is shuffled, and a task that is run again gives the same pieces.
A null or empty text is the end id alone, a piece of one token. Repeated rows are packed each for
itself, null ids stay null, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import map_rows, once, texts

CAPACITY = 4096
END_ID = 2
#: Open windows of a task (16 KB each); fill from which an open window is left as it is at a task's end.
OPEN, LEFT = 1024, 15 / 16
#: Pre-tokens that a Python worker remembers (some 200 bytes each); the table is emptied when it is full.
REMEMBERED = 1_000_000
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

#: Texts of these characters only are cut into pre-tokens here, as the tokenizer's own rule cuts
#: them; any other text goes to the tokenizer whole.
_OTHER = re.compile(r"[^\t-\r\x20-\x7e\xa0-\u012f\u0131-\u017f]")
_LETTER, _DIGIT = "a-zªµºß-öø-ÿ\u0100-\u017f", "0-9²³¹¼½¾"
_PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\t-\r\x20\xa0{_LETTER}{_DIGIT}]+")
_WORD_END = "</w>"


class Encoder:
    """Text to ids, as little-endian unsigned 32-bit bytes; pre-tokens met before are looked up."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.ends = np.zeros(max(self.lib.get_vocab(with_added_tokens=True).values()) + 1, bool)
        self.ends[[i for t, i in self.lib.get_vocab().items() if t.endswith(_WORD_END)]] = True
        probe = "it's A1b, don't 'Re x.y ÀÉ12 '' 's ½ü-_"
        self.by_word = self.whole(probe) == b"".join(self._new(_PRETOKEN.findall(probe.lower())))

    def _ids(self, text: str) -> np.ndarray:
        """By the library's call that keeps no offsets."""
        return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _new(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token; the last id of a pre-token, and no other, has a word end."""
        ids = self._ids(" ".join(words))
        stops = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else np.zeros(0, np.int64)
        if len(stops) != len(words):
            return [self.whole(w) for w in words]
        data, stops = ids.tobytes(), (stops * 4).tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def __call__(self, text: str) -> bytes:
        if not self.by_word or _OTHER.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        words, known = _PRETOKEN.findall(text.lower()), self.known
        found = list(map(known.get, words))
        if None in found:
            new = list({w for w, b in zip(words, found, strict=True) if b is None})
            if len(known) + len(new) > self.remembered:
                known.clear()
                new = list(set(words))
            known.update(zip(new, self._new(new), strict=True))
            found = map(known.__getitem__, words)
        return b"".join(found)


class Levels:
    """The level array and the open windows behind it."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.windows: dict[int, list[list]] = defaultdict(list)  # level: windows, each a list of pieces
        self.open = 0

    def place(self, size: int, piece: tuple) -> list | None:
        """Put a piece of fewer tokens than a window; the window, if that fills it."""
        count, cap = self.count, self.capacity
        # N[h] falls by one and N[h + size] grows by one; neither empty nor full windows count.
        here, there = count[: cap + 1 - size], count[size:]
        change = np.where(here > 0, 2 * (there - here + 1), np.iinfo(np.int64).max)
        if here[-1]:
            change[-1] = 1 - 2 * here[-1]
        change[0] = 2 * count[size] + 1
        level = int(change.argmin())
        window = self._pop(level) if level else []
        window.append(piece)
        if level + size == cap:
            return window
        self._put(level + size, window)
        return None

    def _pop(self, level: int) -> list:
        self.count[level] -= 1
        self.open -= 1
        return self.windows[level].pop()

    def _put(self, level: int, window: list) -> None:
        self.count[level] += 1
        self.open += 1
        self.windows[level].append(window)

    def relieve(self) -> Iterator[list]:
        """The windows that are full once the emptiest one is emptied into the fullest."""
        levels = np.flatnonzero(self.count).tolist()
        room = levels[0]
        donor, targets = self._pop(levels[0]), []
        while room > 0 and self.open:
            level = int(np.flatnonzero(self.count)[-1])
            targets.append(self._pop(level))
            room -= self.capacity - level
        for window in self._poured([*targets, donor]):
            size = sum(len(p[2]) // 4 for p in window)
            if size == self.capacity:
                yield window
            else:
                self._put(size, window)

    def drain(self) -> Iterator[list]:
        """All open windows at the end; those less than LEFT full, the emptiest cut up to fill the fullest."""
        full_first = [(level, w) for level in sorted(self.windows, reverse=True) for w in self.windows[level]]
        yield from (w for level, w in full_first if level >= LEFT * self.capacity)
        yield from self._poured([w for level, w in full_first if level < LEFT * self.capacity])
        self.__init__(self.capacity)

    def _poured(self, full_first: list[list]) -> Iterator[list]:
        """Windows, the last of them cut up to fill the first; all but one full."""
        front, back = 0, len(full_first) - 1
        room = lambda w: self.capacity - sum(len(p[2]) // 4 for p in w)
        gap = room(full_first[0]) if full_first else 0
        while front < back:
            if not gap:
                yield full_first[front]
                front += 1
                gap = room(full_first[front])
                continue
            donor = full_first[back]
            if not donor:
                back -= 1
                continue
            doc, start, ids, total = donor.pop()
            take = min(gap, len(ids) // 4)
            full_first[front].append((doc, start, ids[: 4 * take], total))
            if 4 * take < len(ids):
                donor.append((doc, start + take, ids[4 * take :], total))
            gap -= take
        if full_first and full_first[front]:
            yield full_first[front]


def pack_rows(source: Iterable[tuple], encode: Callable[[str], bytes], capacity: int, end_id: int, first_id: int) -> Iterator[tuple]:
    """Rows of SCHEMA for (doc_id, text) rows; sequence ids count up from ``first_id``."""
    levels, end, sequence = Levels(capacity), int(end_id).to_bytes(4, "little"), first_id

    def written(window: list) -> Iterator[tuple]:
        nonlocal sequence
        offset = 0
        for doc, start, ids, total in window:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), total, sequence, offset
            offset += n
        sequence += 1

    for doc, text in source:
        ids = encode(text) + end
        total = len(ids) // 4
        whole = total // capacity * capacity
        for at in range(0, whole, capacity):
            yield from written([(doc, at, ids[4 * at : 4 * (at + capacity)], total)])
        if total > whole:
            done = levels.place(total - whole, (doc, whole, ids[4 * whole :], total))
            if done:
                yield from written(done)
        while levels.open > OPEN:
            for window in levels.relieve():
                yield from written(window)
    for window in levels.drain():
        yield from written(window)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    sequence_id: the task's number in the upper bits, so that ids are unique without a shuffle.
    ``tokenizer``: the file's place; ``remembered``: pre-tokens that a Python worker remembers, which
    changes memory and time only.
    """

    def make() -> Callable[[Iterator[tuple]], Iterable[tuple]]:
        encode = once(f"encode {tokenizer} {remembered}", lambda: Encoder(tokenizer, remembered))

        def rows(source: Iterator[tuple]) -> Iterator[tuple]:
            for first in source:
                head = first[2] << 33

                def both(first: tuple = first) -> Iterator[tuple]:
                    yield first[:2]
                    yield from (r[:2] for r in source)

                yield from pack_rows(both(), encode, capacity, end_id, head)

        return rows

    return map_rows(texts(docs, id_col, text_col).withColumn("task", F.spark_partition_id()), make, SCHEMA)
