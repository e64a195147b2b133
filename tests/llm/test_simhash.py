import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from siftline.llm import simhash as op
from siftline.llm.components import components


def slow_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprint_as_told():
    rng = random.Random(1)
    for t in ["", " \n", "A", "a B", "É é\x0bX\xa0Y", *(" ".join(rng.choice("abc") for _ in range(n)) for n in (3, 4, 50))]:
        assert op.fingerprint(t) == slow_fingerprint(t), t


def test_fingerprint_in_steps(monkeypatch):
    t = " ".join(map(str, range(100)))
    want = op.fingerprint(t)
    monkeypatch.setattr(op, "STEP", 7)
    assert op.fingerprint(t) == want == slow_fingerprint(t)


def test_links_keep_all_groups_whole_by_either_way(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {0}
    for c in centres:
        for _ in range(60):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    near = lambda a, b: (a ^ b).bit_count() <= 2
    want = sorted(Counter(groups(sorted(fps), near).values()).values())
    table = spark.createDataFrame([(op._signed(x),) for x in fps], "fp long")
    for pairwise in (10**6, 3):
        got = op.links(table, pairwise)
        assert got.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count() == 0
        sizes = [r["count"] for r in components(got, "a", "b").groupBy("root").count().collect()]
        assert sorted(sizes + [1] * (len(fps) - sum(sizes))) == want


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 150)] + [(rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(60)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    nodes = sorted({x for a, b in pairs if a != b for x in (a, b)})
    both = set(pairs) | {(b, a) for a, b in pairs}
    assert got == groups(nodes, lambda a, b: (a, b) in both)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_whole_table_as_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: slow_fingerprint(r.text) for r in docs.select("doc_id", "text").collect()}
    want = groups(sorted(rows), lambda a, b: (rows[a] ^ rows[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op.near_duplicates(docs).collect()}
    assert got == {i: (f"{rows[i]:016x}", want[i]) for i in rows}


def test_odd_rows(odd, odd_rows, none):
    got = op.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    of = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert of[1] == of[2] == 1 and of[3] == of[4] == of[11] == 3 and of[6] == 5
    assert op.near_duplicates(none).count() == 0
