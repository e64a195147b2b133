"""Secret scans: fixed patterns, and guess costs of values in credential contexts.

Base kinds, leftmost and non-overlapping for each kind: ``assign``, ``access``, ``hex``. The method
adds ``guess``: a value that stands behind a credential word and an equals sign or colon, and that costs
at least 10**8 guesses, however long it is. The cost of a value is the least product, over all ways to
cut it up, of the costs of words, dates, repeats, keyboard walks and stretches of brute force, found by
dynamic programming in one pass.

A word costs its place in a ranked list. There are three: frequent words of passwords, the whole words of a
public tokenizer's vocabulary (``vocabulary_words``; merged first, ranked first), and the corpus's own frequent
words (``learned_words``), counted over all texts, without what stands in credential contexts.

Null counts as empty; such texts have no spans; very long texts and values are scanned whole. Ties between
segmentations cost the same; spans of one start are ordered by kind. Repeated rows are scanned each, null ids
stay null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import durable, map_rows, once, texts

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "guess")
LEAST_GUESSES = 8.0
#: Words learned from the corpus at most, their letters, and how often they occur at least: a share of all words, and
#: in small corpora, where that is less, a number that a leaked value doesn't reach.
LEARNED, LETTERS, SHARE, OCCURRENCES = 65_536, (3, 24), 2.5e-6, 10
SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guess bigint"

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: What a credential context is: a word that ends so, then a sign, then the value up to a blank or quote.
_CONTEXT = re.compile(r"""(?ai:pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private)[_-]?key|credentials?|auth)["']?[\x20\t]{0,4}(?:=>|:=|[:=])[\x20\t]{0,4}["'`]?(?P<value>[^\s"'`,;<>]+)""")
#: The same for the JVM, as a whole.
_CONTEXT_JVM = _CONTEXT.pattern.replace("(?ai:", "(?i:").replace("(?P<value>", "(?:")
_CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "auth")

#: Frequent words of passwords, most frequent first; a word's place is its cost.
WORDS = """password admin welcome login letmein monkey dragon master sunshine princess shadow football baseball
superman qwerty iloveyou trustno hello freedom whatever secret summer winter spring autumn love money
angel flower ninja hunter tiger computer internet server root user guest test example sample default change
changeme your token key value here none null true false string placeholder insert enter todo demo temp""".split()
#: The rows of a keyboard, each shifted to the right against the one above, and what shift gives.
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
SHIFTED = str.maketrans("!@#$%^&*()", "1234567890")
#: Keys next to a key on average.
TURNS = 4
_AT = {c: (r, i) for r, row in enumerate(KEYBOARD) for i, c in enumerate(row)}
#: Two neighbouring keys to the direction from the first to the second: along a row, or along a slant.
_NEXT = {a + b: (q - r, j - i) for a, (r, i) in _AT.items() for b, (q, j) in _AT.items() if (q - r, j - i) in {(0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)}}
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
_FOLD = str.maketrans("@4310$5!7", "aaeiossit")


def _charset(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 1000


def walk_cost(n: int, turns: int) -> float:
    return math.log10(len(_AT) * n) + turns * math.log10(TURNS)


class Guesser:
    """The base-10 logarithm of the least number of guesses over all segmentations; 0 for ``''``."""

    def __init__(self, lists: Iterable[Iterable[str]] = (WORDS,)):
        self.rank: dict[str, int] = {}
        for words in lists:
            for place, w in enumerate(words, 2):
                self.rank[w] = min(place, self.rank.get(w, place))
        self.longest = max(map(len, self.rank), default=0)

    def __call__(self, value: str) -> float:
        n, low, rank_of = len(value), value.lower(), self.rank
        plain, keys = low.translate(_FOLD), low.translate(SHIFTED)
        cost = [0.0] + [math.inf] * n
        dates: dict[int, list[int]] = {}
        for i in range(n):
            if m := _DATE.match(value, i):
                dates.setdefault(m.end(), []).append(i)
        same = walk = turns = 0  # first characters of the running repeat and of the running walk, and its turns
        # Repeats and walks are taken from their first character on.
        same_cost = walked = 0.0
        for j in range(1, n + 1):
            c = value[j - 1]
            best = cost[j - 1] + math.log10(_charset(c))
            for i in range(max(0, j - self.longest), j - 2):
                rank = rank_of.get(low[i:j])
                folded = rank_of.get(plain[i:j])
                if rank or folded:
                    upper = 0.3 if value[i:j] != low[i:j] else 0.0
                    best = min(best, cost[i] + (math.log10(rank) if rank else math.log10(folded) + 0.6) + upper)
            for i in dates.get(j, ()):
                best = min(best, cost[i] + math.log10(365 * 120 if j - i > 4 else 120))
            if j == 1 or low[j - 1] != low[j - 2]:
                same, same_cost = j - 1, cost[j - 1]
            if j - same >= 3:
                best = min(best, same_cost + math.log10(_charset(c)) + math.log10(j - same))
            if j == 1 or keys[j - 2 : j] not in _NEXT:
                walk, walked, turns = j - 1, cost[j - 1], 0
            elif j - walk > 2:
                turns += _NEXT[keys[j - 2 : j]] != _NEXT[keys[j - 3 : j - 1]]
            if j - walk >= 3:
                best = min(best, walked + walk_cost(j - walk, turns))
            cost[j] = best
        return cost[n]


def vocabulary_words(path: str) -> list[str]:
    """The words of three letters and more that are tokens of a vocabulary with word ends, by their ids."""
    from tokenizers import Tokenizer

    ended = [(i, t[: -len("</w>")]) for t, i in Tokenizer.from_file(path).get_vocab().items() if t.endswith("</w>")]
    return [w for _, w in sorted(ended) if len(w) >= LETTERS[0] and w.isascii() and w.isalpha()]


def learned_words(docs: DataFrame, most: int = LEARNED, text_col: str = "text") -> list[str]:
    """The corpus's frequent words, the most frequent first: all that occur at least 2**k times, k as small as ``most`` allows.

    Words have at least SHARE of all occurrences, so that over four million words what is learned doesn't depend on how
    large the corpus is, and at least OCCURRENCES. Counted over all rows, in partial sums; only words of the result come to
    the driver, at most ``most``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.when(text.rlike("[=:]"), F.regexp_replace(text, _CONTEXT_JVM, " ")).otherwise(text)
    low, high = LETTERS
    word = F.regexp_extract_all(F.lower(plain), F.lit(rf"(?<![\p{{L}}\p{{N}}])\p{{L}}{{{low},{high}}}(?![\p{{L}}\p{{N}}])"), F.lit(0))
    every = durable(docs.select(F.explode(word).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    total = every.agg(F.sum("n")).first()[0] or 0
    counts = every.filter(F.col("n") >= max(OCCURRENCES, math.ceil(SHARE * total)))
    sizes = {r.k: r.n for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}  # a row for each k
    held, least = 0, None
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > most:
            break
        least = k
    if least is None:
        return []
    return [r.word for r in sorted(counts.filter(F.floor(F.log2("n")) >= least).collect(), key=lambda r: (-r.n, r.word))]


#: Costs by the fixed list alone.
guess_cost = Guesser()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start, then kind as listed."""
    found: list[tuple[int, int, int]] = []
    if ("=" in text or ":" in text) and any(w in (low := text.lower()) for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m["value"]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(a, b, BASE[k]) for a, k, b in sorted(found)]


def guessed_spans(text: str, guess: Callable[[str], float] = guess_cost) -> list[tuple[int, int, str]]:
    """Values in credential contexts that are costly to guess."""
    if not ("=" in text or ":" in text) or not any(w in (low := text.lower()) for w in _CONTEXT_WORDS):
        return []
    return [(*m.span("value"), "guess") for m in _CONTEXT.finditer(text) if guess(m["value"]) >= LEAST_GUESSES]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, lists: Iterable[list[str]] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest of the base spans and all spans, for every row. ``lists``: ranked words beside the fixed ones."""
    key, ranked = f"guesses {uuid.uuid4()}", (WORDS, *lists)

    def make() -> Callable[[Iterator[tuple]], Iterable[tuple]]:
        guess = once(key, lambda: Guesser(ranked))

        def rows(source: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, text in source:
                base, more = base_spans(text), guessed_spans(text, guess)
                counts = [sum(k == x for *_, k in base) for x in BASE]
                every = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))
                yield doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(more)

        return rows

    return map_rows(texts(docs, id_col, text_col), make, SCHEMA)
