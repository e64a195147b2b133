"""Normalisers, tokenisers and text predicates as columns.

NFKC and case folding have no built-in form; they are optional pandas UDFs in front of a chain.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def nfkc(c: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(run, StringType())(c)


def casefold(c: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else t.casefold())

    return F.pandas_udf(run, StringType())(c)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def latin(c: Column) -> Column:
    """N1: lower case, everything but a-z and 0-9 to single blanks."""
    return squeeze(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "))


def lowered(c: Column) -> Column:
    """N2 and, behind ``nfkc``, N3."""
    return squeeze(F.lower(c))


def spaced(c: Column) -> Column:
    """N4: blanks squeezed, case kept."""
    return squeeze(c)


def letters_only(c: Column) -> Column:
    """N5 behind ``nfkc`` and ``casefold``: letters and digits without blanks."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def clean(c: Column) -> Column:
    """N6: line ends unified, blanks and long runs of line ends squeezed."""
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def latin_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"))


def unicode_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"))


def bigram_tokens(c: Column) -> Column:
    """What stands in for dictionary segmenters: pairs of neighbouring letters of each run."""
    pairs = lambda w: F.when(F.length(w) < 2, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: w.substr(i, F.lit(2))))
    return F.flatten(F.transform(unicode_tokens(c), pairs))


def drops_script(c: Column) -> Column:
    """Whether the Latin tokeniser would drop a letter or digit."""
    return c.rlike(r"[\p{L}\p{N}&&[^\x00-\x7F]]")


def capital_ratio(c: Column) -> Column:
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))) / F.greatest(F.size(words), F.lit(1))


def sentences(c: Column) -> Column:
    """Struct array (text, starts_paragraph): paragraphs at blank lines, cut behind . ! ? or a line end."""
    parts = lambda p: F.filter(F.transform(F.split(p, r"(?<=[.!?])\s+|\n"), lambda s: F.trim(s)), lambda s: s != "")
    one = lambda p: F.transform(parts(p), lambda s, i: F.struct(s.alias("text"), (i == 0).alias("starts_paragraph")))
    return F.flatten(F.transform(F.split(c, "\n\n"), one))


def contains_any(text: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: (g != "") & text.contains(g))


def occurrences(text: Column, part: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def ablated(prompt: Column, sentence: str) -> Column:
    """The prompt without a sentence; a prompt that doesn't hold it fails the query."""
    gone = F.replace(prompt, F.lit(sentence), F.lit(""))
    return F.when(prompt.contains(sentence), gone).otherwise(F.raise_error(F.lit(f"not in the prompt: {sentence}")))


def answer_scores(answer: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Exact match, token F1 (tokens with their counts) and set F1 (each token once) of normalised answers; 1 where both are empty."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    a, g = words(answer), words(gold)
    times = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(times(a, w), times(g, w)))
    kinds = F.size(F.array_distinct(a)) + F.size(F.array_distinct(g))
    share = lambda part, whole: F.when(whole == 0, 1.0).otherwise(2 * part / whole)
    return answer == gold, share(both, F.size(a) + F.size(g)), share(F.size(F.array_intersect(a, g)), kinds)
