"""run() against decisions taken by hand, without the stages' own code."""

import math
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from siftline.llm import packing
from tests.llm import toxicity_by_hand as by_hand

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _toxic(text, model):
    weights, z = model
    z += sum(n * weights.get(g, 0.0) for g, n in by_hand.places(text).items())
    return 1 / (1 + math.exp(-max(-30, min(30, z)))) >= 0.5


def _near(texts):
    """The smallest id of each id's group of texts at a similarity of 0.8, all pairs compared."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0d]+", t.translate(str.maketrans(UPPER, LOWER)))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    of, ids = {i: i for i in texts}, sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if of[a] != of[b] and (sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)):
                low, high = sorted((of[a], of[b]))
                of = {i: low if r == high else r for i, r in of.items()}
    return of


def _tiled(d, t, least=4):
    """Tokens of t under greedy string tiles, the longest first."""
    d, t, done = list(d), list(t), 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(d)):
            for j in range(len(t)):
                n = 0
                while i + n < len(d) and j + n < len(t) and d[i + n] == t[j + n] and d[i + n] is not None:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return done
        d[i : i + n], t[j : j + n] = [None] * n, [0] * n
        done += n


def _leaked(text, items):
    words = re.findall(r"[^\W_]+", text.lower())
    runs = {tuple(words[i : i + 4]) for i in range(len(words) - 3)}
    for own in items:
        seeds = {tuple(own[i : i + 4]) for i in range(len(own) - 3)} & runs
        if not seeds:
            continue
        near = {x for i in range(len(words) - 3) if tuple(words[i : i + 4]) in seeds for x in range(i, i + 4)}
        short = [words[i] if i in near else "|" for i in range(len(words)) if i in near or i - 1 in near]
        if 2 * _tiled(short, own) >= len(own):
            return True
    return False


def _kept(rows, labels, bench, model):
    """Ids that come through, of (doc_id, text) rows with different ids."""
    left = {i: t or "" for i, t in rows if not _toxic(t or "", model)}
    last = {}
    for i, t in left.items():
        folded = t.translate(str.maketrans(UPPER, LOWER))
        last[folded] = max(i, last.get(folded, i))
    left = {i: left[i] for i in last.values()}
    of = _near(left)
    items = [re.findall(r"[^\W_]+", (t or "").lower()) for t in bench]
    return {i for i in left if of[i] == i and not _leaked(left[i], items)}


def test_run_as_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, labels, bench = (spark.read.parquet(f"{d}/{x}.parquet") for x in ("documents", "labels", "benchmark"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    names, weights, z = by_hand.fit([(t or "", marks[i]) for i, t in rows if i in marks and not by_hand.is_held_out(i)])
    want = _kept(rows, labels, [r.text for r in bench.collect()], (dict(zip(names, weights.tolist(), strict=True)), z))
    got = corpus_pipeline.run(spark, d)
    assert got.columns == [f.split()[0] for f in packing.SCHEMA.split(", ")]
    assert {r.doc_id for r in got.select("doc_id").collect()} == want and 100 < len(want) < len(rows)


@pytest.fixture
def tables(spark, odd, tmp_path):
    def write(docs):
        labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
        bench = spark.createDataFrame([(1, "one two three four five six"), (2, None)], "item_id long, text string")
        for name, table in (("documents", docs), ("labels", labels), ("benchmark", bench)):
            table.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_odd_rows_come_through(spark, odd, tables):
    """Of each group of equal or similar texts one row, of nulls and empty texts one; extra columns with clashing names."""
    got = corpus_pipeline.run(spark, tables(odd)).collect()
    # 2 stays of the equal texts 1, 2, 2 and null; 3, 4, null and 11 have no words; 6 stays of 5 and 6.
    assert sorted({r.doc_id for r in got}) == [2, 4, 6, 7, 8, 9, 10]
    assert all(r.length > 0 for r in got)


def test_an_empty_table(spark, none, tables):
    assert corpus_pipeline.run(spark, tables(none)).count() == 0


def test_stages_keep_the_columns(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("meta.url", F.lit("u")).withColumn("root", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns
