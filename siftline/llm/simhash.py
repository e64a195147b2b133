"""SimHash near-dedup with pigeonhole blocks.

A fingerprint of 64 bits is cut into four blocks of 16. Two that differ in at most two bits agree
on at least two blocks, so they share one of six keys of 32 bits. Distinct fingerprints (copies
meet before) are joined on these keys, and the Hamming distance of each candidate is verified.

A key that many fingerprints share is not joined with itself. There each fingerprint is put
under itself and under its 32 neighbours that differ in one bit outside the key: two within two
bits always share such a place, all in one place are within two bits, and a place holds at
most 33, so a link from each to the smallest one in its place keeps all groups whole.

Null counts as empty; texts without words have fingerprint zero, linked like any other. Very long texts are hashed
whole, in steps of bounded memory. A bit that is set in exactly half of the hashes, a tie, is 0. Repeated
rows get the same fingerprint and component. A null doc_id never names a component unless it holds
no other id. An empty table gives an empty result; other columns are ignored. A fingerprint or a component of a
large share of all rows (empty texts, copies) is broadcast to its rows, not brought to one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import durable, map_rows, texts, with_groups

SHINGLE, SEED, DISTANCE, BLOCK = 3, 42, 2, 16
#: Fingerprints under one key above which they are not compared pair by pair.
PAIRWISE = 256
#: Shingles hashed at a time.
STEP = 1 << 15
KEYS = [sum(((1 << BLOCK) - 1) << (BLOCK * i) for i in pair) for pair in combinations(range(64 // BLOCK), 64 // BLOCK - DISTANCE)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of a text as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        part = words[at : min(at + STEP, n) + shingle - 1]
        runs = zip(*(part[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [part]
        h = np.fromiter(map(xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed long) for every row."""

    def make() -> Callable[[Iterator[tuple]], Iterable[tuple]]:
        return lambda source: ((doc_id, _signed(fingerprint(text, shingle))) for doc_id, text in source)

    return map_rows(texts(docs, id_col, text_col), make, "doc_id bigint, fp bigint")


def links(distinct: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """a, b: links that connect all of ``distinct`` (fp, each once) within DISTANCE bits."""
    masks = F.array(*(F.lit(_signed(m)) for m in KEYS))
    keyed = distinct.select("fp", F.posexplode(masks).alias("k", "mask")).select("fp", "k", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "mask")
    shared = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = keyed.join(shared, ["k", "key"])
    few = keyed.filter(F.col("n") <= pairwise).select("k", "key", "fp")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["k", "key"])
    pairs = pairs.filter((F.col("a") < F.col("b")) & near).select("a", "b")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(64)))
    place = keyed.filter(F.col("n") > pairwise).select("k", "fp", "mask", F.explode(flips).alias("flip"))
    place = place.filter(F.col("flip").bitwiseAND(F.col("mask")) == 0).select("k", F.col("fp").bitwiseXOR(F.col("flip")).alias("place"), "fp")
    first = place.groupBy("k", "place").agg(F.min("fp").alias("b"))
    stars = place.join(first, ["k", "place"]).filter("fp != b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (its smallest doc_id) for every row."""
    signed = durable(fingerprints(docs, id_col, text_col, shingle))
    distinct = durable(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(distinct.select("fp")), "a", "b")
    placed = durable(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = durable(with_groups(placed.drop("least"), durable(named), "root", "members", placed.count()).select("fp", "n", "component_id"))
    rows = with_groups(signed, named, "fp", "n", signed.count())
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
