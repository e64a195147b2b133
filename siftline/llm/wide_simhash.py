"""Near-dedup by similarity of word shingles: SimHash blocks, then the exact Jaccard similarity.

A fingerprint has a bit for each of many hashes of a shingle: it is 1 if set in over half of a text's distinct
shingles. Two texts differ in each bit with a probability that their sets give: the angle between them over pi, 0.1515 at
a Jaccard similarity of 0.8 and equal sizes. Sets of few shingles stray from that; FLIP is the most of all from six
shingles up, and four shingles against five reach FLIP_FEW. Of 64 bits that is 5 to 14, more than blocks
can leave out. So fingerprints are as long as the number of texts asks for: blocks are so wide that about BLOCK
unrelated texts share one, and there are so many of them that a pair shares none with a probability of MISSED at most,
at any number of texts (41 blocks of 9 bits at 212,000 texts, 124 of 15 at 12.7 million).

Texts in a block are linked if the first WORDS words of their fingerprints differ by no more than the expected
number and five deviations. What is linked, over all blocks, is a loose group; the exact similarity decides
inside it (see ``similar``: the group's centre first, small groups pair by pair, larger ones by their rarest shingles).

A block of over CROWD texts is dealt to cells. Its texts are held against one of them, and only those that are far from it
are sent to all cells, to be held against every text there: a large group of near copies costs one comparison each.

Null counts as empty; texts without words are one group, texts of fewer words than a shingle are one shingle; a very
long text is taken whole. A bit that is set in exactly half of the shingles, a tie, is 0. Repeated rows and null ids as in
``similar``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import durable, map_rows, ship, texts, with_groups
from .similar import PAIRWISE, SHINGLE, SIMILARITY, _least, grouped, linked_inside, set_key, shingle_sets, shingles, survivors, text_hash

#: How often a bit differs at most at a similarity of 0.8; of sets of up to FEW shingles.
FLIP, FLIP_FEW, FEW = 0.1612, 0.1875, 5
MISSED = 1e-4
#: Unrelated texts of a block, about; texts above which it is dealt.
BLOCK, CROWD = 512, 2048
#: Words compared inside a block.
WORDS = 4
#: Rows compared at a time.
STEP = 256


def width(texts: int) -> int:
    """Bits of a block, for that many texts."""
    return max(4, math.ceil(math.log2(max(1, texts) / BLOCK)))


def blocks(bits: int, flip: float = FLIP) -> int:
    """Blocks of that many bits so that a pair shares none with a probability of MISSED at most."""
    return math.ceil(math.log(MISSED) / math.log1p(-((1 - flip) ** bits)))


def words(bits: int, flip: float = FLIP) -> int:
    """64-bit words of a fingerprint that has these blocks; none lies in two words."""
    return max(WORDS, math.ceil(blocks(bits, flip) / (64 // bits)))


def most_bits(flip: float, words: int = WORDS) -> int:
    """Differing bits of that many words: the expected number and five deviations."""
    return int(64 * words * flip + 5 * math.sqrt(64 * words * flip * (1 - flip)))


def fingerprint(h: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of a set of 64-bit hashes, as unsigned words."""
    streams = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), 255):  # sums of up to 255 bits fit into a byte
        x = h[at : at + 255, None] + streams
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8")


def sketches(docs: DataFrame, bits: int, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row doc_id, hash (of the text), set (128-bit hash of the shingles), size, bits (the fingerprint)."""
    usual, few = words(bits), words(bits, FLIP_FEW)

    def make() -> Callable[[Iterator[tuple]], Iterable[tuple]]:
        def rows(source: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, text, digest in source:
                h = shingles(text, shingle)
                yield doc_id, digest, set_key(h), len(h), fingerprint(h, usual if len(h) > FEW else few).view(np.int64).tolist()

        return rows

    source = texts(docs, id_col, text_col).withColumn("hash", text_hash("text"))
    return map_rows(source, make, "doc_id bigint, hash binary, set binary, size int, bits array<bigint>")


def keyed(distinct: DataFrame, bits: int) -> DataFrame:
    """block, node, w0 to w3: a row for each block of a fingerprint. A block is its number, then its bits.

    A column ``without`` of ``distinct``, if there is one, names numbers of blocks that a text leaves out (null: none).
    """
    a_word, n = 64 // bits, F.when(F.col("size") > FEW, blocks(bits)).otherwise(blocks(bits, FLIP_FEW))
    numbers = F.sequence(F.lit(0), n - 1)
    if "without" in distinct.columns:
        numbers = F.array_except(numbers, F.coalesce("without", F.array().cast("array<int>")))
    value = f"shiftrightunsigned(bits[k div {a_word}], cast(k % {a_word} * {bits} as int)) & {(1 << bits) - 1}L"
    rows = distinct.filter("size > 0").select("node", "bits", F.explode(numbers).alias("k"))
    return rows.select(F.expr(f"shiftleft(cast(k as bigint), {bits}) | ({value})").alias("block"), "node", *(F.col("bits")[i].alias(f"w{i}") for i in range(WORDS)))


def _merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Each place's group (its smallest place) after those of ``i`` and ``j`` are joined."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        label = label.copy()
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label != (then := label[label])).any():
            label = then


def near(node: np.ndarray, words: np.ndarray, probe: np.ndarray, own: np.ndarray, flip: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, met: for each text that is near another its group's first one, and how many it is near to.

    Those of ``probe`` are held against those of ``own``; the first word alone, by its own bound, rules out most pairs.
    """
    p, o = np.flatnonzero(probe), np.flatnonzero(own)
    both, first, label, met = probe.all() and own.all(), words[:, 0].copy(), np.arange(len(node)), np.zeros(len(node), np.int64)
    for at in range(0, len(p), STEP):
        rows, columns = p[at : at + STEP], o[at:] if both else o  # with itself: each pair once
        found = np.flatnonzero((np.bitwise_count(first[rows, None] ^ first[columns]) <= most_bits(flip, 1)).ravel())
        i, j = rows[found // len(columns)], columns[found % len(columns)]
        other = i < j if both else node[i] != node[j]
        i, j = i[other], j[other]
        close = np.bitwise_count(words[i] ^ words[j]).sum(1, dtype=np.int64) <= most_bits(flip)
        i, j = i[close], j[close]
        if len(i):
            met += np.bincount(i, minlength=len(node)) + np.bincount(j, minlength=len(node))
            label = _merged(label, i, j)
    of = np.flatnonzero(met)
    return node[of], node[label[of]], met[of]


def _near_in_cells(rows: DataFrame, bits: int) -> DataFrame:
    """a, b, met of every block and cell of ``rows`` (block, cell, node, words, probe, own)."""
    first_few = blocks(bits) << bits
    names = ["node", *(f"w{i}" for i in range(WORDS)), "probe", "own"]
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("met", pa.int64())])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
        """A block's cell at a time; the rows are sorted by them."""
        open_, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, cell = (batch.column(c).to_numpy() for c in ("block", "cell"))
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            starts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(cell) != 0)) + 1).tolist(), len(block)]
            for at, end in zip(starts, starts[1:], strict=False):
                if key != (block[at], cell[at]):
                    if open_:
                        yield int(key[0]), [np.concatenate(c) for c in zip(*open_, strict=True)]
                    open_, key = [], (block[at], cell[at])
                open_.append([c[at:end].copy() for c in columns])
        if open_:
            yield int(key[0]), [np.concatenate(c) for c in zip(*open_, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (node, *columns, probe, own) in groups(batches):
            if len(node) > 1 and probe.any() and own.any():
                found = near(node, np.stack(columns, axis=1).view(np.uint64), probe, own, FLIP if block < first_few else FLIP_FEW)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], schema=fields)

    ship(rows.sparkSession)
    dealt = rows.repartition("block", "cell").sortWithinPartitions("block", "cell")
    return dealt.select("block", "cell", *names).mapInArrow(run, "a bigint, b bigint, met bigint")


def _far(words: list[Column], others: list[Column], most: Column) -> Column:
    return sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(words, others, strict=True)), F.lit(0)) > most


def close(distinct: DataFrame, bits: int) -> DataFrame:
    """a, b, met: links between texts whose fingerprints are close, as few as keep each block's groups whole; durable.

    distinct: node, size, bits, each set once; durable. met: how many others a has met, in this block's cell.
    """
    rows = keyed(distinct, bits)
    counts = durable(rows.groupBy("block").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node"), "node", *(f"w{i}" for i in range(WORDS)))).alias("c")).filter(F.col("n") > CROWD))
    yes, no = F.lit(True), F.lit(False)
    if counts.isEmpty():
        return durable(_near_in_cells(rows.withColumns({"cell": F.lit(0), "probe": yes, "own": yes}), bits))
    large = counts.select("block", "n", "c", (F.floor(F.col("n") / CROWD) + 1).cast("int").alias("cells"))
    most = F.when(F.col("block") < blocks(bits) << bits, most_bits(FLIP)).otherwise(most_bits(FLIP_FEW))
    crowd = durable(rows.join(counts.select("block"), "block", "left_semi"))
    # Only rows of large blocks come out of a join on blocks: each text leaves those blocks out of its own list, for the others.
    left_out = crowd.groupBy("node").agg(F.collect_list(F.shiftright("block", bits).cast("int")).alias("without"))
    small = keyed(distinct.join(left_out, "node", "left"), bits).withColumns({"cell": F.lit(0), "probe": yes, "own": yes})
    crowd = durable(with_groups(crowd, durable(large), "block", "n", distinct.count()))
    crowd = crowd.withColumn("far", _far([F.col(f"w{i}") for i in range(WORDS)], [F.col(f"c.w{i}") for i in range(WORDS)], most))
    columns = ["block", "node", *(f"w{i}" for i in range(WORDS))]
    own = crowd.select(*columns, F.pmod(F.xxhash64("node"), F.col("cells")).cast("int").alias("cell"), no.alias("probe"), yes.alias("own"))
    probes = crowd.filter("far").select(*columns, F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), yes.alias("probe"), no.alias("own"))
    stars = crowd.filter("NOT far AND node != c.node").select(F.col("node").alias("a"), F.col("c.node").alias("b"), F.lit(1).cast("long").alias("met"))
    centres = large.select(F.col("c.node").alias("a"), F.col("c.node").alias("b"), F.col("n").alias("met"))
    met = _near_in_cells(small.unionByName(own).unionByName(probes), bits)
    return durable(met.unionByName(stars).unionByName(centres))


def loose_groups(distinct: DataFrame, bits: int) -> DataFrame:
    """block (a loose group), node, n, first: the groups of over one text, with their size and centre; durable.

    A group's centre is the text that meets most others: of a group made from one text by edits that is mostly this one.
    """
    found = close(distinct, bits)
    roots = durable(components(found, "a", "b"))
    met = found.groupBy("a").agg(F.sum("met").alias("met")).withColumnRenamed("a", "node")
    rows = durable(roots.join(met, "node", "left").select(F.col("root").alias("block"), "node", F.coalesce("met", F.lit(0)).alias("met")))
    groups = durable(rows.groupBy("block").agg(F.count("*").alias("n"), F.max(F.struct("met", "node")).alias("top")))
    return durable(with_groups(rows.drop("met"), groups.select("block", "n", F.col("top.node").alias("first")), "block", "n", rows.count()))


def _sifted(a: str, b: str, similarity: float) -> Column:
    """Sizes and bits allow the similarity. a, b: structs with size, bits."""
    low, high = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
    most = F.when(high > FEW, most_bits(FLIP)).otherwise(most_bits(FLIP_FEW))
    return _least(low, high, similarity) & ~_far([F.col(f"{a}.bits")[i] for i in range(WORDS)], [F.col(f"{b}.bits")[i] for i in range(WORDS)], most)


def rooted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hash (of the text), root (the group), component_id (its smallest doc_id) for every row."""
    bits = width(docs.count())
    wide = durable(sketches(docs, bits, SHINGLE, id_col, text_col))
    sets_of = lambda wanted: shingle_sets(docs, wanted, SHINGLE, id_col, text_col)
    return grouped(wide, lambda distinct: linked_inside(loose_groups(distinct, bits), distinct, sets_of, SIMILARITY, PAIRWISE, _sifted))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (the smallest doc_id of its group) for every row; ``rooted`` tells apart groups that share a name."""
    return rooted(docs, id_col, text_col).select("doc_id", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with all columns of whatever names and types: the one whose doc_id names it.

    Of rows that repeat that id in the group, or of a group without ids, the largest by text, then by all
    columns as JSON, stays.
    """
    return survivors(docs, rooted(docs, id_col, text_col), id_col, text_col)
