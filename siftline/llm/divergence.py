"""Source divergence audit: how far each source's term shares lie from every other source's of its language.

Terms are counted for each (lang, source); a language keeps those in at least LEAST of its documents. Most terms of a
corpus are rare and share their column of counts with many others, so terms are grouped by their sparse vector of
(source, count): a divergence is worked out once for each distinct vector and multiplied by the number of its terms.

A term's share is p = 1 + floor(10^9 (count + 1) / (N + V)), its divergence f = floor((p - q)^2 / q). Summed over all
kept terms, a pair of sources (a, b) falls into four kinds of vectors, and none is gone through for pairs of sources
that it lacks: where both counts are over zero, f is taken pair by pair inside the vector; where one is zero, f
depends on the other's count and on the zero's share only, and is taken once for each distinct count of a source;
where both are, f is one number. The first kind is stated as what it adds to the others, so that their sums run over
all of a source's counts.

Terms over their language's share are ranked as terms: f is taken once for each (source, count, count in the language),
the RANKS best of these hold the RANKS best terms, and their terms are ranked.

Null text, lang and source count as ''. Very long texts are cut into words whole. A group without terms still gets its
rows of part ``pair`` (0 where its language keeps no term). Ties go by item in the order of UTF-8. Repeated rows are
documents of their own; ids aren't looked at. An empty table gives an empty result; other columns are ignored. Sums and
products are exact: shares are worked out as decimals, the rest fits 64 bits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import durable, quoted, ship

#: Documents of a language that a kept term is in, at least; ranks of part ``term``; the share of a whole.
LEAST, RANKS, WHOLE = 3, 200, 1_000_000_000
#: Counts that a task gathers before it hands them on; pairs of a vector's sources taken at a time.
GATHERED, PAIRS = 400_000, 1 << 20
#: A task's occurrences of a term stay under 2**BITS between two shuffles, its documents under 2**(63 - BITS).
BITS = 40
ONE = 1 << BITS
#: Cells that the sources of one language are dealt to where all of them meet.
SALTS = 64
#: Letters, and every byte of a character beyond ASCII.
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")


def terms(text: str) -> list[bytes]:
    """The terms of a text, in UTF-8, A-Z lower-cased."""
    return _TERM.findall(text.encode("utf-8", "surrogatepass").lower())


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); all rows of a language's term lie in one partition.

    Counts are added up in tasks, GATHERED at a time, before they are shuffled by language and term, once for all that follows.
    """
    ship(docs.sparkSession)
    table = docs.select(*(F.coalesce(F.col(quoted(c)), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        room = GATHERED
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for lang, source, text in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    own = held.setdefault((lang, source), {})
                    before, get = len(own), own.get
                    # One number holds both: documents above, occurrences in the lower BITS.
                    for t, n in Counter(terms(text)).items():
                        own[t] = get(t, 0) + n + ONE
                    room -= len(own) - before
                    if room < 0:
                        yield from _columns(held)
                        held, room = {}, GATHERED
        yield from _columns(held)

    found = table.mapInArrow(run, "lang string, source string, term binary, n bigint, docs bigint")
    found = found.withColumn("term", F.col("term").cast("string")).repartition("lang", "term")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _columns(held: dict[tuple[str, str], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), own in held.items():
        both, words = np.fromiter(own.values(), np.int64, len(own)), list(own)
        for i in range(0, len(words), 1 << 15):
            part, some = both[i : i + (1 << 15)], pa.array(words[i : i + (1 << 15)], pa.binary())
            columns = [pa.repeat(lang, len(part)), pa.repeat(source, len(part)), some, pa.array(part & (ONE - 1)), pa.array(part >> BITS)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def kept_terms(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, vector: for each kept term the sorted (source, n) of the sources that hold it."""
    met = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return met.filter(F.col("docs") >= least).select("lang", "term", "vector")


def vectors(kept: DataFrame) -> DataFrame:
    """vid, lang, vector, many (its terms): each distinct vector of a language once."""
    return kept.groupBy("lang", "vector").agg(F.count("*").alias("many")).withColumn("vid", F.monotonically_increasing_id())


def _share(n: Column, of: Column) -> Column:
    """1 + floor(WHOLE * (n + 1) / of), exactly, for any counts."""
    big = lambda c: c.cast("decimal(20,0)")
    return 1 + F.call_function("div", (big(n) + 1) * F.lit(WHOLE).cast("decimal(10,0)"), big(of))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def totals(docs: DataFrame, distinct: DataFrame, lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(lang, source, of, zero, n, held) for each occurring group and (lang, of, v) for each language.

    of: N + V; zero: the share of a term that the group lacks; held: its kept terms; v: kept terms of the language.
    """
    group = docs.select(*(F.coalesce(F.col(quoted(c)), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source")))).distinct()
    entries = distinct.select("lang", "many", F.explode("vector").alias("x"))
    own = entries.groupBy("lang", F.col("x.source").alias("source")).agg(F.sum(F.col("x.n") * F.col("many")).alias("n"), F.sum("many").alias("held"))
    size = distinct.groupBy("lang").agg(F.sum("many").alias("v"))
    langs = group.select("lang").distinct().join(size, "lang", "left").join(own.groupBy("lang").agg(F.sum("n").alias("n")), "lang", "left")
    langs = langs.select("lang", (F.coalesce("n", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("of"), F.coalesce("v", F.lit(0)).alias("v"))
    rows = group.join(own, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang")
    rows = rows.withColumns({"n": F.coalesce("n", F.lit(0)), "held": F.coalesce("held", F.lit(0))}).withColumn("of", F.col("n") + F.col("v"))
    return rows.withColumn("zero", F.when(F.col("v") > 0, _share(F.lit(0), F.col("of"))).otherwise(1)), langs


def met_pairs(placed: DataFrame) -> DataFrame:
    """lang, a, b, both, more: for pairs of sources that share a term the number of these and what their f adds to the zeros'.

    placed: lang, many, xs array<struct<source, p, zero>>, a row for each distinct vector. A task takes PAIRS pairs of
    its vectors at a time and hands on a sum for each (lang, a, b) among them.
    """
    ship(placed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch["lang"].dictionary_encode()
            of, many = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), batch["many"].to_numpy()
            xs = batch["xs"]
            flat = xs.flatten()
            names = flat.field("source").dictionary_encode()
            source, p, zero = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.field("p").to_numpy(), flat.field("zero").to_numpy()
            ends = np.cumsum(xs.value_lengths().to_numpy())
            size, k = np.diff(np.r_[0, ends]), len(names.dictionary)
            row = np.repeat(np.arange(len(size)), size)
            width = size[row]  # each entry meets all entries of its vector
            cut = np.cumsum(width)
            i = 0
            while i < len(row):
                j = max(i + 1, int(np.searchsorted(cut, (cut[i - 1] if i else 0) + PAIRS, side="right")))
                a = np.repeat(np.arange(i, j), width[i:j])
                b = np.arange(len(a)) - np.repeat(np.cumsum(width[i:j]) - width[i:j], width[i:j]) + (ends - size)[row[a]]
                i = j
                a, b = a[a != b], b[a != b]
                f = lambda x, y: (x - y) * (x - y) // y
                more = (f(p[a], p[b]) - f(p[a], zero[b]) - f(zero[a], p[b]) + f(zero[a], zero[b])) * many[row[a]]
                key, at = np.unique((of[row[a]] * k + source[a]) * k + source[b], return_inverse=True)
                sums, both = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
                np.add.at(sums, at, more)
                np.add.at(both, at, many[row[a]])
                take = lambda d, x: d.dictionary.take(pa.array(x))
                yield pa.RecordBatch.from_arrays([take(lang, key // (k * k)), take(names, key // k % k), take(names, key % k), pa.array(both), pa.array(sums)], names=["lang", "a", "b", "both", "more"])

    found = placed.mapInArrow(run, "lang string, a string, b string, both bigint, more bigint")
    return found.groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))


def pair_sums(groups: DataFrame, placed: DataFrame) -> DataFrame:
    """lang, source, item, value: f of each group against each other source of its language, summed over all kept terms."""
    met = met_pairs(placed)
    # Where the other source's count is zero: once for each distinct share of a source, and each share of a zero.
    hist = placed.select("lang", "many", F.explode("xs").alias("x")).groupBy("lang", F.col("x.source").alias("source"), F.col("x.p").alias("p"), F.col("x.zero").alias("zero")).agg(F.sum("many").alias("many"))
    salt = F.pmod(F.hash("source"), F.lit(SALTS))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    other = groups.select("lang", F.col("zero").alias("t")).distinct().select("lang", "t", salts.alias("salt"))
    cells = hist.withColumn("salt", salt).join(other, ["lang", "salt"])
    against = lambda p, q: F.sum(F.col("many") * (_apart(p, q)))
    shifts = F.col("zero"), F.col("t")
    one = cells.groupBy("lang", "source", "t").agg(
        (against(F.col("p"), F.col("t")) - F.sum(F.col("many") * _apart(*shifts))).alias("as_group"),
        (against(F.col("t"), F.col("p")) - F.sum(F.col("many") * _apart(*reversed(shifts)))).alias("as_item"),
    )
    left = groups.select("lang", F.col("source").alias("a"), F.col("zero").alias("za"), "v", F.pmod(F.hash("source"), F.lit(SALTS)).alias("salt"))
    right = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zb"), salts.alias("salt"))
    # Every pair of a language's sources is asked for; each has a row of the result.
    pairs = left.join(right, ["lang", "salt"]).filter("a != b").drop("salt")
    pairs = pairs.join(met, ["lang", "a", "b"], "left")
    pairs = pairs.join(one.select("lang", F.col("source").alias("a"), F.col("t").alias("zb"), "as_group"), ["lang", "a", "zb"], "left")
    pairs = pairs.join(one.select("lang", F.col("source").alias("b"), F.col("t").alias("za"), "as_item"), ["lang", "b", "za"], "left")
    none = F.col("v") * _apart(F.col("za"), F.col("zb"))
    value = none + sum((F.coalesce(c, F.lit(0)) for c in ("more", "as_group", "as_item")), F.lit(0))
    return pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), value.cast("long").alias("value"))


def top_terms(kept: DataFrame, distinct: DataFrame, groups: DataFrame, langs: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, source, item, value, rank: each group's terms over its language's share, the ``ranks`` best."""
    whole = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    opened = lambda rows, *keep: rows.select("lang", *keep, whole.alias("all"), F.explode("vector").alias("x")).select("lang", *keep, "all", "x.source", "x.n")
    classes = opened(distinct).distinct()
    classes = classes.join(groups.select("lang", "source", "of"), ["lang", "source"]).join(langs.select("lang", F.col("of").alias("lang_of")), "lang")
    classes = classes.withColumns({"p": _share(F.col("n"), F.col("of")), "q": _share(F.col("all"), F.col("lang_of"))}).filter("p > q")
    classes = classes.select("lang", "source", "n", "all", _apart(F.col("p"), F.col("q")).cast("long").alias("value"))
    # Each class has a term, so no term of a class below the best ``ranks`` of them and their ties can be asked for.
    best = classes.withColumn("r", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc()))).filter(F.col("r") <= ranks).drop("r")
    rows = opened(kept, "term").join(best, ["lang", "source", "n", "all"])
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def audit(docs: DataFrame, least: int = LEAST, ranks: int = RANKS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    kept = durable(kept_terms(term_counts(docs, text_col, lang_col, source_col), least))
    distinct = durable(vectors(kept))
    groups, langs = totals(docs, distinct, lang_col, source_col)
    groups, langs = durable(groups), durable(langs)
    entries = distinct.select("vid", "lang", "many", F.explode("vector").alias("x")).select("vid", "lang", "many", "x.source", "x.n")
    placed = entries.join(groups.select("lang", "source", "of", "zero"), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("of")))
    placed = durable(placed.groupBy("vid", "lang", "many").agg(F.collect_list(F.struct("source", "p", "zero")).alias("xs")))
    pairs = pair_sums(groups, placed)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    columns = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(top_terms(kept, distinct, groups, langs, ranks), "term"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 3),
l AS (SELECT lang, coalesce(sum(n), 0) AS n, count(n) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN (SELECT lang, term FROM k) USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 * (coalesce(c.n, 0) + 1) AS HUGEINT) // (g.n + l.v) AS p
      FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
q AS (SELECT k.lang, term, 1 + CAST(1000000000 * (k.n + 1) AS HUGEINT) // (l.n + l.v) AS q FROM k JOIN l USING (lang)),
t AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pr UNION ALL FROM t))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
