import math
import zlib

import numpy as np
import pytest

from siftline.llm import toxicity as op
from tests.llm import toxicity_by_hand as by_hand


@pytest.fixture(scope="module")
def parts(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_accuracy(parts):
    docs, labels = parts
    rows = op.score(docs, op.train(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    clean = [r for r in rows if not r.toxic]
    assert sum(r.predicted == r.toxic for r in rows) > 0.93 * len(rows) and sum(r.predicted for r in clean) < 0.04 * len(clean)


def test_held_out_labels_and_other_columns_have_no_part(parts):
    from pyspark.sql import functions as F

    docs, labels = parts
    other = labels.withColumn("toxic", F.when(op.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    blank = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    a, b = op.train(docs, labels), op.train(blank.repartition(3), other)
    assert (a[0] == b[0]).all() and a[1] == pytest.approx(b[1])


def test_odd_rows(spark, odd, odd_rows, none, parts):
    model = op.train(*parts)
    got = op.score(odd, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in odd_rows)
    empty = [r.score for r in got if r.doc_id in (3, 4, 11)]
    assert len(set(empty)) == 1 and 0 <= empty[0] <= 1
    assert op.score(none, model).count() == 0


def test_no_labels_or_one_class(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in op.score(odd, op.train(odd, none)).collect()} == {0}
    ones = spark.createDataFrame([(1, 1), (7, 1), (8, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    assert {r.predicted for r in op.score(odd, op.train(odd, ones)).collect()} == {1}


def test_toxic_rows_go(spark):
    docs = spark.createDataFrame([(i, f"you {'idiot' if i % 4 == 0 else 'friend'} number w{i}") for i in range(200)] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    left = op.drop_toxic(docs, labels)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted([*(str(i) for i in range(200) if i % 4), "None"])


@pytest.mark.parametrize("block", [op.BLOCK, 1, 3])
def test_training_and_scores_by_hand(spark, monkeypatch, block):
    """Against a dense design matrix and plain sums; words of one letter are no features, wherever a block of words ends."""
    monkeypatch.setattr(op, "BLOCK", block)
    texts = [f"a you {'idiot' if i % 3 == 0 else 'friend'} w{'abc'[i % 3]}{'xyz'[i % 2]} and {'stupid' if i % 6 == 0 else 'kind'} Friend I {'qrs'[i % 3]}" for i in range(60)] + [""]
    rows = [(i, t) for i, t in enumerate(texts)]
    weights, intercept = op.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    names, want, at = by_hand.fit([(t, int(i % 3 == 0)) for i, t in rows if not by_hand.is_held_out(i)])
    assert intercept == pytest.approx(at, abs=1e-6) and np.abs(weights[names] - want).max() < 1e-4 and np.count_nonzero(weights) <= len(names)
    for row in op.score(spark.createDataFrame(rows, "doc_id long, text string"), (weights, intercept)).collect():
        z = intercept + sum(n * float(weights[g]) for g, n in by_hand.places(texts[row.doc_id]).items())
        assert row.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


@pytest.mark.parametrize("texts", [("a", "b"), ("good day friend a", "bad rude person"), ("a b c", "bad"), ("x", ""), ("good day friend", "bad rude person")])
def test_tiny_vocabularies(spark, texts):
    ids = [i for i in range(40) if not by_hand.is_held_out(i)]
    docs = spark.createDataFrame([(i, texts[i % 2]) for i in ids], "doc_id long, text string")
    weights, intercept = op.train(docs, spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int"))
    names, want, at = by_hand.fit([(texts[i % 2], i % 2) for i in ids])
    assert intercept == pytest.approx(at, abs=1e-6) and np.allclose(weights[names], want, atol=1e-4)


def test_training_is_bounded_in_characters(spark):
    """A text that alone is over the bound isn't learned from, others are; without any, nothing is known."""
    ids = [i for i in range(60) if not by_hand.is_held_out(i)]
    short = {i: f"you {'idiot' if i % 2 else 'friend'} of ours" for i in ids}
    docs = spark.createDataFrame([(i, t if i != ids[3] else "idiot friend " * 5000) for i, t in short.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    weights, at = op.train(docs, labels, max_chars=10_000)
    names, want, z = by_hand.fit([(t, i % 2) for i, t in short.items() if i != ids[3]])
    assert at == pytest.approx(z, abs=1e-6) and np.allclose(weights[names], want, atol=1e-4)
    assert op.train(docs, labels, max_chars=5)[1] == -30.0
