"""Near-dedup by similarity of word shingles: MinHash bands, then the exact Jaccard similarity.

A text's set of shingles has 256 smallest hashes (MinHash); two texts agree in each with a
probability that is their Jaccard similarity. 32 bands of six hashes are join keys: texts at
similarity 0.8 share one with probability 1 - (1 - 0.8^6)^32 = 0.9999, however many texts there
are, since a key's width doesn't depend on their number, and texts without common shingles
practically never meet. Only texts that share a band with another go on.

Texts are one node of the graph if a 128-bit hash of their whole set of shingles is the same, and so
not for a sketch that looks alike. One bit of each smallest hash sifts candidates: of 256 bits 26
differ at 0.8 on average, and pairs go on up to five deviations more. The Jaccard similarity of the
two sets (of 64-bit hashes) decides each that is left; sets are made only for texts that share a band.

No step pairs up a group. First every text is compared with the centre of each of its blocks, and what is
linked becomes one component. Then, in blocks that still hold more than one component, texts of
different components are compared: all pairs in blocks of at most eight texts. Last, the texts of larger
blocks that still hold more than one component are compared where they share one of their rarest shingles,
which all pairs do that are similar enough (prefix filtering, exact). What is linked already is never paired.

Null counts as empty; texts without words are one group, texts of fewer words than a shingle are one
shingle; a very long text is taken whole. Of equally good names, ties, the smallest id names a component. A null doc_id never names a component unless it holds no other id. Repeated rows
share a component; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import HOT, durable, map_rows, one_of_each, quoted, texts, whole, with_groups

SHINGLE, SIMILARITY = 5, 0.8
#: Smallest hashes of a text; bands, and hashes in each.
HASHES, BANDS, ROWS = 256, 32, 6
#: Texts of a block up to which all its pairs are compared.
PAIRWISE = 8
#: Texts that share a rare shingle and meet in one task, about.
CELL = 2048
WORDS = HASHES // 64
#: Whether two structs with size and bits may be that similar.
Sift = Callable[[str, str, float], Column]
#: A frozen stream: the same functions in every worker.
_TIMES, _PLUS = np.frombuffer(np.random.RandomState(8).bytes(16 * HASHES), "<u8").reshape(2, HASHES) | np.uint64(1)


def shingles(text: str, shingle: int) -> np.ndarray:
    """A 64-bit hash of each distinct shingle."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    return np.fromiter(set(map(xxh64_intdigest, map(b" ".join, runs), repeat(1))), np.uint64)


def set_key(h: np.ndarray) -> bytes:
    """128 bits of the whole set."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(np.sort(h).tobytes())


def minima(h: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the shingles."""
    out = np.full(HASHES, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 128):
        x = h[at : at + 128, None] * _TIMES
        x += _PLUS
        np.minimum(out, x.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def bands(least: np.ndarray) -> list[int]:
    """The join keys of a text."""
    from xxhash import xxh64_intdigest

    raw = least.tobytes()
    return np.array([xxh64_intdigest(raw[4 * ROWS * k : 4 * ROWS * (k + 1)], k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row doc_id, hash (of the text), set (128-bit hash of the shingles), size, bits, bands."""

    def make() -> Callable[[Iterator[tuple]], Iterable[tuple]]:
        def rows(source: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, text, digest in source:
                h = shingles(text, shingle)
                least = minima(h)
                bits = np.packbits((least & 1).astype(np.uint8), bitorder="little").view("<i8").tolist()
                yield doc_id, digest, set_key(h), len(h), bits, bands(least)

        return rows

    source = texts(docs, id_col, text_col).withColumn("hash", text_hash("text"))
    return map_rows(source, make, "doc_id bigint, hash binary, set binary, size int, bits array<bigint>, bands array<bigint>")


def text_hash(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """node, items array<long> for each of ``wanted`` (node, hash)."""

    def make() -> Callable[[Iterator[tuple]], Iterable[tuple]]:
        return lambda source: ((node, shingles(text, shingle).view(np.int64).tolist()) for node, text in source)

    found = texts(docs, id_col, text_col).withColumn("hash", text_hash("text")).join(wanted, "hash").select("node", "text")
    return map_rows(found.dropDuplicates(["node"]), make, "node bigint, items array<bigint>")


def most_bits(similarity: float) -> int:
    """Differing bits up to which a pair may be that similar: the expected number and five deviations."""
    p = (1 - similarity) / 2
    return int(HASHES * p + 5 * math.sqrt(HASHES * p * (1 - p)))


def _sifted(a: str, b: str, similarity: float) -> Column:
    """Sizes and bits allow the similarity. a, b: structs with size, bits."""
    apart = sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(WORDS)), F.lit(0))
    return _least(F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size"), similarity) & (apart <= most_bits(similarity))


def _least(common: Column, union: Column, similarity: float) -> Column:
    """common / union is at least the similarity, without rounding."""
    x = Fraction(str(similarity))
    return common.cast("long") * x.denominator >= union.cast("long") * x.numerator


def crowded(distinct: DataFrame) -> DataFrame:
    """block, node, n, first: the blocks that hold more than one text, with their size and centre; durable.

    A block's centre is the text that meets most others in all its blocks: of a group made from one text by
    edits that is mostly this one, to which the others are most similar.
    """
    rows = distinct.select(F.explode("bands").alias("block"), "node")
    more = rows.groupBy("block").agg(F.count("*").alias("n")).filter("n > 1")
    crowd = durable(rows.join(more, "block"))
    met = crowd.groupBy("node").agg(F.sum("n").alias("met"))
    first = crowd.join(met, "node").groupBy("block").agg(F.max(F.struct("met", "node")).alias("top")).select("block", F.col("top.node").alias("first"))
    return durable(crowd.join(first, "block"))


def _joined(found: DataFrame) -> DataFrame:
    """The links of a star for each component of ``found``: as few as connect the same nodes."""
    return components(found, "a", "b").filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def _placed(rows: DataFrame, stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _verified(pairs: DataFrame, kin: DataFrame, sets: DataFrame, similarity: float, sifted: Sift) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are similar."""
    end = lambda c: kin.select(F.col("node").alias(c), F.struct("size", "bits").alias(f"k{c}"))
    items = lambda c: sets.select(F.col("node").alias(c), F.col("items").alias(f"s{c}"))
    near = pairs.distinct().join(end("a"), "a").join(end("b"), "b").filter(sifted("ka", "kb", similarity)).select("a", "b", (F.col("ka.size") + F.col("kb.size")).alias("both"))
    common = F.size(F.array_intersect("sa", "sb"))
    return near.join(items("a"), "a").join(items("b"), "b").filter(_least(common, F.col("both") - common, similarity)).select("a", "b")


def links(distinct: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, pairwise: int = PAIRWISE) -> DataFrame:
    """a, b: links that connect what the blocks connect.

    distinct: node, hash, size, bits, bands, each set once; durable. sets_of: (node, hash) to (node, items).
    """
    return linked_inside(crowded(distinct), distinct, sets_of, similarity, pairwise, _sifted)


def linked_inside(crowd: DataFrame, distinct: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, pairwise: int, sifted: Sift) -> DataFrame:
    """a, b: links that connect all similar texts of each block of ``crowd`` (as ``crowded`` gives it).

    sifted: what sizes and bits of two texts rule out before their sets are compared.
    """
    kin = durable(distinct.join(crowd.select("node").distinct(), "node").select("node", "hash", "size", "bits"))
    sets = durable(sets_of(kin.select("node", "hash")))
    found = _joined(_verified(crowd.filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")), kin, sets, similarity, sifted))

    # Every text has been held against its block's centre.
    few = _placed(crowd.filter((F.col("n") > 2) & (F.col("n") <= pairwise) & (F.col("node") != F.col("first"))).select("block", "node"), found)
    ordered = (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root"))
    pairs = few.alias("a").join(few.alias("b"), "block").filter(ordered).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    found = _joined(found.unionByName(_verified(pairs, kin, sets, similarity, sifted)))

    large = durable(_placed(crowd.filter((F.col("n") > pairwise) & (F.col("node") != F.col("first"))).select("block", "node", "n"), found))
    mixed = durable(large.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("n").alias("n")).filter("low != high").select("block", "n"))
    member = durable(with_groups(large.drop("n"), mixed, "block", "n", large.count()).select("node", "root").distinct())
    if member.isEmpty():
        return found
    return found.unionByName(_verified(_sharing_rare(member, sets, similarity), kin, sets, similarity, sifted))


def _up(c: Column, num: int, den: int) -> Column:
    """c * num / den, rounded up."""
    return F.floor((c * num + (den - 1)) / den).cast("int")


def _prefixes(member: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """t, node, root, size, place, short, largest, cells: the shingles that ``_sharing_rare`` joins on."""
    x = Fraction(str(similarity))
    own = durable(member.join(sets, "node").select("node", "root", "items", F.size("items").alias("size")))
    total = own.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    often = durable(own.select(F.explode("items").alias("t")).groupBy("t").agg(F.count("*").alias("often")))
    # Shingles of a large group, fewer than HOT, come last in the order: they are taken from the texts' own lists, and only others are joined.
    is_hot = F.col("often") > max(1, total // HOT)
    hot = F.array(*(F.lit(r.t) for r in sorted(often.filter(is_hot).collect(), key=lambda r: (r.often, r.t)))).cast("array<bigint>")
    cold = own.select("node", F.explode(F.array_except("items", hot)).alias("t")).join(often.filter(~is_hot), "t")
    again = F.array_sort(F.collect_list(F.when(F.col("often") > 1, F.struct("often", "t"))))
    cold = cold.groupBy("node").agg(F.count_if(F.col("often") == 1).cast("int").alias("alone"), again["t"].alias("again"))
    size, alone = F.col("size"), F.coalesce("alone", F.lit(0))
    shared = F.concat(F.coalesce("again", F.array().cast("array<bigint>")), F.array_intersect(hot, F.col("items")))
    first = F.slice(shared, F.lit(1), F.greatest(F.lit(0), size - _up(size, x.numerator, x.denominator) + 1 - alone))
    prefix = own.join(cold, "node", "left").select("node", "root", "size", alone.alias("alone"), F.posexplode(first).alias("place", "t"))
    prefix = prefix.withColumn("place", F.col("place") + F.col("alone")).drop("alone")
    short = F.col("place") <= size - _up(size, 2 * x.numerator, x.numerator + x.denominator)
    prefix = durable(prefix.withColumn("short", short))
    # Under one shingle, those outside its largest component are held against the others.
    tops = prefix.groupBy("t", "root").agg(F.count("*").alias("n"), F.max("short").alias("short"))
    tops = tops.groupBy("t").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots"), F.sum("n").alias("n"), F.max("short").alias("short"))
    tops = tops.filter("roots > 1 AND short").select("t", "n", F.col("top.root").alias("largest"), (F.floor(F.col("n") / CELL) + 1).cast("int").alias("cells"))
    return durable(with_groups(prefix, durable(tops), "t", "n", prefix.count()).drop("n"))


def _sharing_rare(member: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: pairs of ``member`` (node, root) with different roots, among them all that are similar.

    Prefix filtering: with the shingles of all sets in one order, the rarest first, two sets that have o in
    common share one among the first n - o + 1 of each. The smaller set of a pair has at least 2s / (1 + s) of its
    shingles in common, the larger one at least s of its own: so the smaller ones are looked up by a short prefix
    (a ninth at 0.8) among the longer prefixes (a fifth) of larger ones. Texts that differ from the rest of a large block
    by shingles of their own, form letters too as long as no two are similar, have these in their short prefix and
    meet nobody. A shingle of many texts is dealt to cells of about CELL of them.
    """
    known, x = _prefixes(member, sets, similarity), Fraction(str(similarity))
    smaller = known.filter("short").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).alias("a")
    larger = known.withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")).alias("b")
    a, b = F.col("a.size"), F.col("b.size")
    need = _up(a + b, x.numerator, x.numerator + x.denominator)
    near = _least(a, b, similarity) & (F.col("a.place") <= a - need) & (F.col("b.place") <= b - need)
    once = (a < b) | ((a == b) & (F.col("a.node") < F.col("b.node")))
    outside = lambda side: F.col(f"{side}.root") != F.col(f"{side}.largest")
    ends = F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")
    met = lambda a, b: a.join(b, ["t", "cell"]).filter((F.col("a.root") != F.col("b.root")) & once & near).select(*ends)
    pairs = met(smaller.filter(outside("a")), larger).unionByName(met(smaller.filter(~outside("a")), larger.filter(outside("b"))))
    return pairs.distinct()


def rooted(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hash (of the text), root (the group), component_id (its smallest doc_id) for every row."""
    wide = durable(sketches(docs, shingle, id_col, text_col))
    sets_of = lambda wanted: shingle_sets(docs, wanted, shingle, id_col, text_col)
    return grouped(wide, lambda distinct: links(distinct, sets_of, similarity))


def grouped(wide: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, hash, root, component_id for every row of ``wide`` (doc_id, hash, set and what is the same for a set).

    links_of: from the distinct sets, durable and with a node each, to links a, b.
    """
    own = [c for c in wide.columns if c not in ("doc_id", "hash")]
    distinct = durable(wide.groupBy(*own).agg(F.min("doc_id").alias("least"), F.min("hash").alias("hash"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    roots = components(links_of(distinct), "a", "b")
    placed = durable(distinct.join(roots, "node", "left").select("set", "least", "n", F.coalesce("root", "node").alias("root")))
    named = durable(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    named = durable(with_groups(placed.drop("least"), named, "root", "members", placed.count()).select("set", "n", "root", "component_id"))
    return with_groups(wide.select("doc_id", "hash", "set"), named, "set", "n", wide.count()).select("doc_id", "hash", "root", "component_id")


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (the smallest doc_id of its group) for every row.

    Groups without an id, or that repeat another group's id, share a name; ``rooted`` tells them apart.
    """
    return rooted(docs, shingle, similarity, id_col, text_col).select("doc_id", "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with all columns of whatever names and types: the one whose doc_id names it.

    Of rows that repeat that id in the group, or of a group without ids, the largest by text, then by all
    columns as JSON, stays.
    """
    return survivors(docs, rooted(docs, shingle, similarity, id_col, text_col), id_col, text_col)


def survivors(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row that ``keep_first`` keeps of each of ``groups`` (as ``rooted`` gives them)."""
    named = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    rows = named.groupBy("root", "doc_id", "hash").agg(F.count("*").alias("n"))
    total = rows.groupBy("root").agg(F.sum("n").alias("n"))
    keys = durable(rows.drop("n").join(total, "root"))
    own = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), text_hash(quoted(text_col)).alias("h"), whole(docs).alias("doc"))
    found = own.join(keys, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("hash")))
    if keys.filter("n > 1").isEmpty():
        return found.select("doc.*")
    return one_of_each(found, ["root"], text_col)
