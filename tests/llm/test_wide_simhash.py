import random
from math import comb

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import similar
from siftline.llm import wide_simhash as op
from tests.llm import test_similar as told

MASK = 2**64 - 1


def slow_bit(hashes, k):
    """Bit k: set in over half of the SplitMix64 values of the hashes, each word's from its own stream."""
    ones = 0
    for x in hashes:
        x = (x + (k // 64 + 1) * 0x9E3779B97F4A7C15) & MASK
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
        x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
        ones += (x ^ x >> 31) >> k % 64 & 1
    return int(2 * ones > len(hashes))


@pytest.mark.parametrize("n", [0, 1, 2, 255, 700])
def test_fingerprint_as_told(n):
    h = np.random.default_rng(n).integers(0, 2**64, n, np.uint64)
    got = np.unpackbits(op.fingerprint(h, 4).view(np.uint8), bitorder="little").tolist()
    assert got == [slow_bit(h.tolist(), k) for k in range(256)]


def test_a_bit_differs_no_oftener_than_blocks_are_counted_for():
    """All pairs of sets at 0.8 or more with up to 40 shingles, by counting."""
    sums = lambda n: [(2 * k - n, comb(n, k) / 2**n) for k in range(n + 1)]
    over = {(n, s): sum(p for x, p in sums(n) if x > s) for n in range(12) for s in range(-41, 42)}
    for b in range(1, 41):
        for a in range(1, b + 1):
            for c in range(1, a + 1 if a < b else a):
                if 5 * c >= 4 * (a + b - c):
                    flip = sum(p * (x * (1 - y) + y * (1 - x)) for s, p in sums(c) for x, y in [(over[a - c, -s], over[b - c, -s])])
                    assert flip <= (op.FLIP if b > op.FEW else op.FLIP_FEW), (a, b, c)


@pytest.mark.parametrize("texts", [1_000, 200_000, 12_000_000])
def test_pairs_at_the_similarity_share_a_block_at_any_number_of_texts(texts):
    bits = op.width(texts)
    rng, hit, chance = np.random.default_rng(2), 0, 0

    def keys(h):
        f = op.fingerprint(h, op.words(bits))
        return [int(f[k // (64 // bits)]) >> k % (64 // bits) * bits & (1 << bits) - 1 for k in range(op.blocks(bits))]

    for _ in range(300):
        h = rng.integers(0, 2**64, 450, np.uint64)  # 360 in both, 45 in each alone
        hit += any(a == b for a, b in zip(keys(h[:405]), keys(h[45:]), strict=True))
    assert hit >= 298


def test_blocks_are_cut_from_the_fingerprint(spark):
    bits, h = 9, np.random.default_rng(3).integers(0, 2**64, (20, 30), np.uint64)
    prints = {i: op.fingerprint(x if i else x[:4], op.words(bits, op.FLIP_FEW)) for i, x in enumerate(h)}
    table = spark.createDataFrame([(i, 30 if i else 4, f.view(np.int64).tolist()) for i, f in prints.items()], "node long, size int, bits array<bigint>")
    want = {(k << bits | int(f[k // 7]) >> k % 7 * bits & 511, i) for i, f in prints.items() for k in range(op.blocks(bits, op.FLIP if i else op.FLIP_FEW))}
    rows = op.keyed(table, bits).collect()
    assert {(r.block, r.node) for r in rows} == want and len(rows) == len(want)
    assert all(r[f"w{i}"] == int(prints[r.node].view(np.int64)[i]) for r in rows for i in range(op.WORDS))


def test_the_stage_gets_its_candidates_from_fingerprints(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "more"]))], "doc_id long, text string")
    ids = lambda: [r.doc_id for r in corpus_pipeline.remove_near_copies(spark, docs, "").collect()]

    def other(*a):
        raise AssertionError("other blocks than those of the fingerprints")

    monkeypatch.setattr(similar, "crowded", other)
    assert ids() == [1]
    monkeypatch.setattr(op, "close", lambda distinct, bits: distinct.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1).cast("long").alias("met")).limit(0))
    assert sorted(ids()) == [1, 2]


SAME = ["test_short_texts_are_told_apart", "test_the_exact_similarity_decides", "test_null_and_repeated_ids_lose_no_group", "test_columns_of_any_name_and_type", "test_whole_table_as_true_jaccard", "test_a_large_group_just_under_and_over_the_similarity"]


@pytest.mark.parametrize(("name", "crowd"), [*((name, op.CROWD) for name in SAME), (SAME[-1], 30), (SAME[-2], 30)])
def test_what_holds_for_the_similarity(spark, name, crowd, monkeypatch):
    """The same groups as by any other way; with blocks dealt to cells, too."""
    monkeypatch.setattr(told, "op", op)
    monkeypatch.setattr(op, "CROWD", crowd)
    getattr(told, name)(spark)


def test_keep_first_and_odd_rows(odd, none, monkeypatch):
    monkeypatch.setattr(told, "op", op)
    told.test_keep_first_and_odd_rows(odd, none)


def _edited(rng, base, n):
    for i in range(n):
        words = list(base)
        words[rng.randrange(len(words))] = f"new{i}"
        yield " ".join(words)


def test_a_crowded_block_is_dealt_and_stays_whole(spark, monkeypatch):
    """Two large groups, of which one block's centre can be near to one only, and others beside them."""
    monkeypatch.setattr(op, "CROWD", 50)
    rng, texts = random.Random(4), []
    for _ in range(2):
        texts += _edited(rng, [f"w{rng.randrange(10**6)}" for _ in range(100)], 200)
    texts += [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(100)]
    dealt = []
    cells = op._near_in_cells

    def seen(rows, bits):
        dealt.append(rows.groupBy("block", "cell").agg(F.count_if("own").alias("n")).agg(F.max("n"), F.max("cell")).first())
        return cells(rows, bits)

    monkeypatch.setattr(op, "_near_in_cells", seen)
    of = dict(op.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert of == {i: i // 200 * 200 if i < 400 else i for i in range(500)}
    assert dealt[0][0] < 100 and dealt[0][1] > 2


def test_near_finds_whole_groups():
    """Chains too, whose ends are far apart, in one piece and by cells."""
    rng = np.random.default_rng(5)
    words = rng.integers(0, 2**64, (40, op.WORDS), np.uint64)
    for i in range(1, 20):  # each 32 bits from the one before
        words[i] = words[i - 1]
        words[i, i % op.WORDS] ^= np.uint64(0xFFFF << 16 * (i // op.WORDS % 4))
        words[i, (i + 1) % op.WORDS] ^= np.uint64(0xFFFF << 16 * ((i + 1) // op.WORDS % 4))
    order, yes = rng.permutation(40), np.ones(40, bool)
    for own in (yes, np.arange(40) < 25):
        a, b, met = op.near(order, words, yes if own is yes else np.arange(40) >= 0, own, op.FLIP)
        assert sorted(a.tolist()) == sorted(order[:20].tolist()) and len(set(b.tolist())) == 1 and (met > 0).all()


def _joined(plan):
    """Rows that came out of each join of an executed plan."""
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in plan.nodeName() else []
    return own + [n for i in range(plan.children().size()) for n in _joined(plan.children().apply(i))]


def test_joins_give_no_more_rows_than_texts_or_large_blocks_have(spark, monkeypatch):
    """Blocks of one large group are dealt; the rows of all other blocks go through no join."""
    rng = random.Random(6)
    texts = [*_edited(rng, [f"w{rng.randrange(10**6)}" for _ in range(100)], 150), *(" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(450))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bits = op.width(len(texts))
    distinct = op.durable(op.sketches(docs, bits).withColumnRenamed("doc_id", "node"))
    sizes = [r["count"] for r in op.keyed(distinct, bits).groupBy("block").count().collect()]
    crowd = sorted(sizes)[-10]
    monkeypatch.setattr(op, "CROWD", crowd)
    large, joined, dealt, cells = sum(n for n in sizes if n > crowd), [], [], op._near_in_cells
    assert 0 < large < sum(sizes) / 5

    def seen(rows, bits):
        own = rows.filter("own").select("block", "node")
        dealt.extend(map(tuple, own.collect()))
        joined.extend(_joined(own._jdf.queryExecution().executedPlan()))
        return cells(rows, bits)

    monkeypatch.setattr(op, "_near_in_cells", seen)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else counts hide in the stages of the plan
    try:
        found = op.close(distinct, bits)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sorted(dealt) == sorted((r.block, r.node) for r in op.keyed(distinct, bits).collect())
    assert joined and max(joined) <= max(len(texts), large)
    assert {r.node for r in op.components(found, "a", "b").collect() if r.root == 0} == set(range(150))
