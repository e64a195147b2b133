import random

import numpy as np
import pytest

from siftline.llm import decontaminate as op


def brute(d, t, least):
    d, t, md, mt, out = list(d), list(t), [0] * len(d), [0] * len(t), []
    while True:
        best, found = 0, []
        for i in range(len(d)):
            for j in range(len(t)):
                k = 0
                while i + k < len(d) and j + k < len(t) and d[i + k] == t[j + k] and not md[i + k] and not mt[j + k]:
                    k += 1
                if k > best:
                    best, found = k, []
                if k == best:
                    found.append((i, j))
        if best < least:
            return sorted(out)
        for i, j in found:
            if not any(md[i : i + best]) and not any(mt[j : j + best]):
                md[i : i + best] = mt[j : j + best] = [1] * best
                out.append((i, j, best))


def test_tiles_as_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        k = rng.choice([1, 2, 3, 6])
        d, t = ([rng.randrange(k) for _ in range(rng.randrange(n))] for n in (25, 15))
        assert sorted(op.tile(np.array(d, int), np.array(t, int), 2)) == brute(d, t, 2)


def test_whole_table_as_brute_force(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "benchmark"))
    items = [(r.item_id, op.tokens(r.text)) for r in bench.collect()]
    want = set()
    for r in docs.select("doc_id", "text").collect():
        words = op.tokens(r.text)
        runs = {tuple(words[i : i + 4]) for i in range(len(words))}
        for item, own in items:
            if any(tuple(own[i : i + 4]) in runs for i in range(len(own) - 3)):
                near = sorted({x for i in range(len(words)) if tuple(words[i : i + 4]) in {tuple(own[j : j + 4]) for j in range(len(own))} for x in range(i, i + 4)})
                tiled, last, piece = 0, None, []
                tiled = sum(x[2] for x in brute([y for a, b in zip([-9, *near], near) for y in ([words[b]] if b == a + 1 else ["|", words[b]])], own, 4))
                if 2 * tiled >= len(own):
                    want.add((r.doc_id, item, tiled))
    got = {(r.doc_id, r.item_id, r.tiled_tokens) for r in op.leaks(docs, bench).collect()}
    assert got == want and want
    assert got == {(r.doc_id, r.item_id, r.tiled_tokens) for r in op.leaks(docs, bench, block_tokens=60).collect()}


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(20))), (2, None), (3, ""), (4, "too short")], "item_id long, text string")


def test_reordered_passages_are_found(spark, bench):
    q = [f"Q{i}," for i in range(20)]
    rows = [(1, " ".join(["x"] + q[10:] + ["y"] + q[:10])), (2, " ".join(q[15:] + ["z"] + q[5:10])), (3, " ".join(q[:8])), (4, " ".join(q[::-1])), (5, None), (None, " ".join(q * 300)), (6, "too short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.item_id, r.n_tiles, r.coverage) for r in op.leaks(docs, bench).collect()}
    assert got == {1: (1, 2, 1.0), 2: (1, 2, 0.5), None: (1, 1, 1.0), 6: (4, 1, 1.0)}
    assert sorted(r.doc_id for r in op.drop_leaks(docs, bench).collect()) == [3, 4, 5]


def test_odd_rows_and_empty_tables(spark, odd, odd_rows, none, bench):
    assert op.leaks(odd, bench).count() == 0 and op.leaks(none, bench).count() == 0
    assert op.drop_leaks(odd, bench).count() == len(odd_rows) and op.drop_leaks(odd, bench).columns == odd.columns
    assert op.leaks(odd, bench.limit(0)).count() == 0 and op.drop_leaks(odd, bench.limit(0)).count() == len(odd_rows)
    assert op.drop_leaks(none, bench).count() == 0 and op.drop_leaks(none, bench).columns == none.columns


def test_items_without_a_seed_match_whole(spark):
    bench = spark.createDataFrame([(1, "Alpha beta gamma"), (2, "delta"), (2, "delta"), (3, "beta alpha")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha, Beta GAMMA"), (2, "alpha beta"), (3, "deltas"), (4, "a delta"), (5, "gamma beta alpha beta")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.item_tokens, r.tiled_tokens) for r in op.leaks(docs, bench).collect())
    assert got == [(1, 1, 3, 3), (4, 2, 1, 1), (4, 2, 1, 1), (5, 3, 2, 2)]
    assert sorted(r.doc_id for r in op.drop_leaks(docs, bench).collect()) == [2, 3]
