"""Personal data: fixed patterns, and a linear-chain conditional random field.

Base kinds, leftmost and non-overlapping for each kind: ``email``, ``ip``, ``card``, ``phone``. The
field adds what patterns miss, where it doesn't touch a base span: ``crf_phone`` (numbers without a
plus sign), ``crf_id`` (national ids) and ``crf_name`` (names behind a title or cue).

The field's features are the word shapes of a token and of two neighbours on each side, and its
transitions. It is trained from a small labelled table (sentences of ``pii_table``, and templates of short
contexts), by gradient ascent on the likelihood, once, in numpy. Texts are decoded by Viterbi in numpy batches. Tokens are first
bounded: where no stretch around a token can gain by leaving label O, whatever its labels and
transitions, the best path has O there, so only the other stretches are decoded.

Null counts as empty; such texts have no spans. A very long text is scanned whole. Of equally good labels, ties, the
first in the order of labels is taken. Repeated rows are scanned each, null ids stay
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .pii_table import SENTENCES
from .runtime import map_rows, once, texts

BASE = ("email", "ip", "card", "phone")
ENTITIES = ("crf_phone", "crf_id", "crf_name")
SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_crf bigint"
Span = tuple[int, int, str]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number is taken from its first digit: what fails there fails from any later digit too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the leftmost matches of the pattern, in time that grows with the text's length only."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        # Letters before a sign that isn't part of an address can't belong to a later one.
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """(start, end, kind), by kind as listed, then start."""
    out: list[Span] = [(a, b, "email") for a, b in emails(text)]
    if "." in text:
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# The field --------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\w+|[^\w\s]")
LABELS = ("O", *(f"{p}-{e}" for e in ENTITIES for p in "BI"))
REACH = 2
#: Sentences of the labelled table. 0 stands for any digit, {} marks an entity, N for a name.
TEMPLATES = {
    "crf_phone": ["call {000-000-0000} today", "phone : {(000) 000-0000}", "tel . {000 000 0000} or", "tel : {0000 000000} .", "mobile {000.000.0000} ,", "fax : {000-0000}", "my number is {000-000-0000} .", "reach me at {(000) 000-0000} now", "telefon : {0000/0000000}", "phone {000-000-0000} fax {000-000-0000}", "ring {00 00 00 00 00} please", "call us ( {000-000-0000} )"],
    "crf_id": ["ssn {000-00-0000} on file", "ssn : {000-00-0000}", "social security number {000-00-0000} .", "her id {000-00-0000} was", "tax id : {00-0000000}", "the number {000-00-0000} and"],
    "crf_name": ["Mr . {N N} said", "Mrs . {N} came", "dear Ms . {N N} ,", "Dr . {N N} of", "name : {N N}", "name : {N N} , age 00", "my name is {N N} .", "signed , Mr {N}", "contact : {N N} or"],
    "": ["in 0000 there were 000 of 0000 cases", "from 0000-00-00 to 0000-00-00", "version 0.00.000 and 0.0", "page 00-00 of 000", "it costs $ 00.00 or 00,000", "The Big Red and Old", "At 00:00 on 00/00/0000", "ip 00.000.00.0 port 0000", "card 0000000000000000 and 0000000000", "token = 0a00b0c00d", "The N . And the N was . Of N is", "N and N are here . The N", "a b c of the d in e", "phone and name of the id", "N . N . N", "call the N of N", "is 000 000 and 000 | 0000 | 00", "### 0000000000000000 $$$ 000", "the 000-000 or 00-0000 part", "( 000 ) of 0000", "number of 00 is 000", "N , N ; N : N", "ISBN 000-0-00-000000-0", "0000 0000 0000 0000 0000", "the ABC N N N version 0", "under the N N N .", "by N N N", "x : N N x", "N : N x", "N . A , A . N", "x , A x", ", A N x", "N - A , x", "N N . N N . N N . N N .", "N N . N N .", "x . N N x", ". N N of x", "N N", "N N N N", "x x . % % % N x x . & & & N x", "x * * * x . # # # N x x", "x $ $ $ N x", "x | x | N x | x", "| N | x |", "A A ! ! A A . ! ! A A A", "A A A A A A", "A A , A ! !", "| 0 | 0000 | 00", "N - N x", "# N x . N x", "Licensed under the N License , Version 0.0", "under the N N N License , version 0 .", "x N x . N x x , N x", "the 0000000000 x 00", "x 000000 x 0000000000 x", "! ! 0000 ! ! 00", "0a0b x 00c0", "under the ABC N N License , version 0 .", "N N N N N N N N x .", "x N N N N N N N x x"],
}
#: How often each sentence of the table, and each template, is learned, with new digits and names.
TABLE_COPIES, COPIES = 4, 12


def marked(sentence: str) -> tuple[list[str], list[str]]:
    """(tokens, labels) of a sentence of the table."""
    tokens, labels, at = [], [], 0
    for m in re.finditer(r"\[(phone|id|name) ([^\]]+)\]", sentence):
        for part, kind in ((sentence[at : m.start()], ""), (m[2], m[1])):
            own = _TOKEN.findall(part)
            tokens += own
            labels += ([f"B-crf_{kind}"] + [f"I-crf_{kind}"] * (len(own) - 1))[: len(own)] if kind else ["O"] * len(own)
        at = m.end()
    rest = _TOKEN.findall(sentence[at:])
    return tokens + rest, labels + ["O"] * len(rest)


def training_table(seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """(tokens, labels) of each sentence of the labelled table and of the templates, copies with other digits and names."""
    rng = random.Random(seed)
    name = lambda: rng.choice("BCDFGKLMNPRST") + "".join(rng.choice("aeiou") + rng.choice("bdlmnrst") for _ in range(rng.randint(1, 3)))
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("bdlmnrst") for _ in range(rng.randint(1, 3)))
    rows = []
    for sentence in SENTENCES * TABLE_COPIES:
        rows.append(marked(re.sub("[0-9]", lambda _: rng.choice("0123456789"), sentence)))
    for entity, sentences in TEMPLATES.items():
        for sentence in sentences * COPIES:
            text = re.sub("0", lambda _: rng.choice("0123456789"), re.sub(r"\bN\b", lambda _: name(), sentence))
            text = re.sub(r"\{(.*?)\}", rf"[{entity.removeprefix('crf_')} \1]", text)
            rows.append(marked(" ".join([*(word() for _ in range(rng.randint(0, 3))), text, *(word() for _ in range(rng.randint(0, 3)))])))
    return rows


def _cues() -> set[str]:
    """The table's words in lower case that stand before an entity at least twice, but for the most common words."""
    plain = set("or on is at my me us her his of and was the said came today now please file age in to for a an le la el de y et und ist un une der die das am i am this we".split())
    before: Counter = Counter()
    for sentence in [*SENTENCES, *(x for e, rows in TEMPLATES.items() if e for x in rows)]:
        tokens, labels = marked(sentence) if "[" in sentence else (_TOKEN.findall(re.sub(r"\{.*?\}", "0", sentence)), None)
        at = [i for i, x in enumerate(labels) if x[0] == "B"] if labels else [i for i, t in enumerate(tokens) if t == "0"]
        before.update({t.lower() for i in at for t in tokens[max(0, i - REACH) : i] if t.isalpha() and len(t) > 1})
    return {w for w, n in before.items() if n > 1} - plain


CUES = _cues()


def shape(token: str) -> str:
    """Digits with their number, cue words as such, other words by their capitals, signs as such."""
    if token.isdigit():
        return f"d{min(len(token), 12)}"
    if token.isalpha():
        low = token.lower()
        return f"w {low}" if low in CUES else "x" if token == low else "Xx" if token[1:] == low[1:] and len(token) > 1 else "X"
    return "mixed" if token[0].isalnum() or token[0] == "_" else token if token in "().-/:,+#=$|;" else "sign"


@lru_cache(1)
def field() -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """(shape to number, weights by offset, shape and label, transitions); shape 0: outside, or new."""
    rows = training_table()
    shapes = {s: i + 1 for i, s in enumerate(sorted({shape(t) for tokens, _ in rows for t in tokens}))}
    k, n, longest = len(LABELS), len(rows), max(len(t) for t, _ in rows)
    x = np.zeros((n, longest + 2 * REACH), np.int64)
    y = np.zeros((n, longest), np.int64)
    for i, (tokens, labels) in enumerate(rows):
        x[i, REACH : REACH + len(tokens)] = [shapes[shape(t)] for t in tokens]
        y[i, : len(tokens)] = [LABELS.index(label) for label in labels]
    offsets = range(2 * REACH + 1)
    w, a = np.zeros((len(offsets), len(shapes) + 1, k)), np.zeros((k, k))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)]
    windows = [x[:, o : o + longest] for o in offsets]
    gold = np.eye(k)[y]
    gold_pairs = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    for step in range(1, 121):
        e = sum(w[o][windows[o]] for o in offsets)
        ahead, back = np.zeros_like(e), np.zeros_like(e)
        soft = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        ahead[:, 0] = e[:, 0]
        for t in range(1, longest):
            ahead[:, t] = e[:, t] + soft(ahead[:, t - 1, :, None] + a, 1)
        for t in range(longest - 2, -1, -1):
            back[:, t] = soft(a + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        total = soft(ahead[:, -1], 1)
        share = np.exp(ahead + back - total[:, None, None])
        pairs = np.exp(ahead[:, :-1, :, None] + a + (e[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]).sum((0, 1))
        error = (gold - share).reshape(-1, k)
        gw = np.stack([np.stack([np.bincount(windows[o].ravel(), error[:, c], len(shapes) + 1) for c in range(k)], 1) for o in offsets]) / n - 2e-4 * w
        ga = (gold_pairs - pairs) / n - 2e-4 * a
        for v, g, m, s in ((w, gw, state[0], state[1]), (a, ga, state[2], state[3])):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    w[:, 0] -= w[:, 0].mean(1, keepdims=True)
    return shapes, w, a


def decode(e: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The best labels of one long row of tokens, between two tokens O at its ends."""
    n = len(e)
    out = np.zeros(n, np.int16)
    rise = float(max((a - a[0, 0]).ravel()[1:].max(), 0.0))  # the most that a transition gains
    gain = e[:, 1:].max(1) - e[:, 0] + rise
    run = np.concatenate([[0.0], np.cumsum(gain)])
    ending = run[1:] - np.minimum.accumulate(run[:-1])
    opening = np.maximum.accumulate(run[:0:-1])[::-1] - run[:-1]
    live = ending + opening - gain > -rise - 1e-6
    edge = np.flatnonzero(np.diff(np.concatenate([[0], live.astype(np.int8), [0]])))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    order = np.argsort(-lengths, kind="stable")
    k = e.shape[1]
    while len(order):
        steps = int(lengths[order[0]])
        group, order = np.split(order, [max(1, 4_000_000 // (steps * k))])
        own, size = starts[group], lengths[group]
        best = a[0] + e[own]
        back = np.zeros((steps, len(group), k), np.int8)
        for t in range(1, steps):
            m = int(np.searchsorted(-size, -t, "left"))
            paths = best[:m, :, None] + a
            back[t, :m] = paths.argmax(1)
            best[:m] = paths.max(1) + e[own[:m] + t]
        state = (best + a[:, 0]).argmax(1)
        for t in range(steps - 1, -1, -1):
            m = int(np.searchsorted(-size, -t, "left"))
            out[own[:m] + t] = state[:m]
            state[:m] = back[t, np.arange(m), state[:m]]
    return out


class Finder:
    """Spans of the field's entities in texts; tokens met before are looked up."""

    def __init__(self, model: tuple[dict[str, int], np.ndarray, np.ndarray] | None = None):
        self.shapes, self.weights, self.moves = model or field()
        self.known: dict[str, int] = {}

    def numbers(self, tokens: list[str]) -> list[int]:
        found = list(map(self.known.get, tokens))
        if None in found:
            new = {t for t, i in zip(tokens, found, strict=True) if i is None}
            if len(self.known) + len(new) > 500_000:
                self.known.clear()
                new = set(tokens)
            self.known.update((t, self.shapes.get(shape(t), 0)) for t in new)
            found = list(map(self.known.__getitem__, tokens))
        return found

    def __call__(self, texts: list[str]) -> list[list[Span]]:
        out: list[list[Span]] = [[] for _ in texts]
        found = [_TOKEN.findall(t) for t in texts]
        # REACH tokens of shape 0 and label O stand between texts.
        gap, row, begin = [0] * REACH, [0] * REACH, []
        for tokens in found:
            begin.append(len(row))
            row += self.numbers(tokens)
            row += gap
        x = np.array(row, np.int64)
        n = len(x) - 2 * REACH
        if n <= 0:
            return out
        e = np.zeros((len(x), len(LABELS)))
        for o in range(2 * REACH + 1):
            e[REACH : REACH + n] += self.weights[o][x[o : o + n]]
        outside = np.ones(len(x), bool)
        for b, tokens in zip(begin, found, strict=True):
            outside[b : b + len(tokens)] = False
        e[outside] = [0.0] + [-1e4] * (len(LABELS) - 1)
        path = decode(e, self.moves)
        hits = np.flatnonzero(path)
        owners = np.unique(np.searchsorted(np.array(begin), hits, "right") - 1)
        for i in owners.tolist():
            labels = path[begin[i] : begin[i] + len(found[i])].tolist()
            entity, start, end = 0, 0, 0
            for m, label in zip(_TOKEN.finditer(texts[i]), labels, strict=True):
                kind = (label + 1) // 2
                if entity and (kind != entity or label % 2):
                    out[i].append((start, end, ENTITIES[entity - 1]))
                    entity = 0
                if kind:
                    start = start if entity else m.start()
                    entity, end = kind, m.end()
            if entity:
                out[i].append((start, end, ENTITIES[entity - 1]))
        return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def added(base: list[Span], more: list[Span]) -> list[Span]:
    """The field's spans that don't touch a base span, by kind as listed, then start."""
    base = sorted(base)
    ends, reach = [], 0
    for _, b, _ in base:
        reach = max(reach, b)
        ends.append(reach)
    starts = [s[0] for s in base]
    from bisect import bisect_left

    free = [s for s in more if not (i := bisect_left(starts, s[1])) or ends[i - 1] <= s[0]]
    return sorted(free, key=lambda s: (ENTITIES.index(s[2]), s[0]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest of the base spans and all spans, for every row."""
    model = field()

    def make() -> Callable[[Iterator[tuple]], Iterable[tuple]]:
        finder = once("personal data", lambda: Finder(model))

        def done(batch: list[tuple]) -> Iterator[tuple]:
            for (doc_id, text), more in zip(batch, finder([t for _, t in batch]), strict=True):
                base = base_spans(text)
                more = added(base, more)
                counts = [sum(k == x for *_, k in base) for x in BASE]
                yield doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)

        def rows(source: Iterator[tuple]) -> Iterator[tuple]:
            batch: list[tuple] = []
            held = 0
            for row in source:
                batch.append(row)
                held += len(row[1])
                if held >= 500_000:
                    yield from done(batch)
                    batch, held = [], 0
            yield from done(batch)

        return rows

    return map_rows(texts(docs, id_col, text_col), make, SCHEMA)
