"""Leader clusters, the cache, search with rights, segmenters and abbreviations against plain loops."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.operators import cells, leaders, retrieval, segmenting


def _vectors(n, dim=6, seed=0):
    rng = np.random.RandomState(seed)
    return rng.randn(4, dim)[rng.randint(4, size=n)] + rng.randn(n, dim) * rng.choice([0.2, 1.0], (n, 1))


def _fold(rows, radius):
    """One vector after the other: id to (leader, similarity)."""
    lead, out = [], {}
    for i, _, v in sorted(rows, key=lambda r: r[1]):
        v = np.array(v) / np.linalg.norm(v)
        best = max(((round(float(v @ u), 9), -k, j) for k, (j, u) in enumerate(lead)), default=(-2, 0, None))
        if best[0] >= radius:
            out[i] = (best[2], best[0])
        else:
            lead.append((i, v))
            out[i] = (i, 1.0)
    return out


@pytest.mark.parametrize("parts,step", [(1, 1024), (4, 16), (32, 1)])
def test_leaders_as_a_fold(spark, parts, step):
    rng = random.Random(2)
    rows = [(i, p, v.tolist()) for i, p, v in zip(range(160), rng.sample(range(9999), 160), _vectors(160), strict=True)]
    df = spark.createDataFrame([*rows, (900, 5, None), (901, 6, [0.0] * 6), (902, None, [1.0] * 6)], "vec_id long, at long, e array<double>").repartition(parts)
    got = {r.id: (r.leader, round(r.similarity, 6)) for r in leaders.clusters(leaders.stream(df, "vec_id", "at", "e"), 0.8, step).collect()}
    want = {i: (j, round(s, 6)) for i, (j, s) in _fold(rows, 0.8).items()}
    assert got == want and 5 < len({j for j, _ in want.values()}) < 120
    hits = leaders.cache(leaders.stream(df, "vec_id", "at", "e"), 0.8, step).collect()
    assert {r.id: r.served for r in hits} == {i: None if i == j else j for i, (j, _) in want.items()}


def test_leaders_of_nothing_and_too_many(spark):
    none = leaders.stream(spark.createDataFrame([], "vec_id long, at long, e array<double>"), "vec_id", "at", "e")
    assert leaders.clusters(none, 0.5).count() == 0
    some = leaders.stream(spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(_vectors(30))], "vec_id long, at long, e array<double>"), "vec_id", "at", "e")
    with pytest.raises(ValueError, match="leaders"):
        leaders.leaders(some, 0.999, most=5)


def test_credit_by_cluster(spark):
    shown = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (3, 7)], "qid long, doc long")
    gold = spark.createDataFrame([(1, 7), (1, 7), (3, 9)], "qid long, doc long")
    cluster = spark.createDataFrame([(1, 0), (2, 0), (3, 5), (4, 0)], "qid long, cluster long")
    credit = leaders.credit_by_cluster(shown, gold, cluster)
    assert {(r.cluster, r.doc): (r.credited, r.surfaced) for r in credit.collect()} == {(0, 7): (1, 2), (0, 8): (0, 1), (5, 7): (0, 1)}
    pool = spark.createDataFrame([(4, 8, 1), (4, 9, 2), (6, 7, 1)], "qid long, doc long, rank int")
    got = {(r.qid, r.doc): (r.score, r.rank) for r in leaders.reranked(pool, cluster, credit, beta=1.0).collect()}
    assert got == {(4, 8): (1 - math.log(2), 2), (4, 9): (0.5, 1), (6, 7): (1.0, 1)}


@pytest.mark.parametrize("block", [20_000, 7])
def test_search_with_rights(spark, monkeypatch, block):
    """Against a look at everything; narrow rights, none at all, and fewer products than rows times queries."""
    monkeypatch.setattr(cells, "BLOCK", block)
    monkeypatch.setattr(cells, "FIRST", 2)
    rng = random.Random(5)
    v = _vectors(300, 8, 3)
    rows = [(i, x.tolist(), 1 << rng.choice([0, 0, 0, 1, 2])) for i, x in enumerate(v)] + [(777, [0.0] * 8, 1), (778, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, access long")
    asked = spark.createDataFrame([(q, v[q].tolist(), c) for q, c in ((0, 1), (1, 2), (2, 4), (3, 7), (4, 8), (5, 1), (6, 1))], "qid long, v array<double>, clearance long")
    centres = cells.fit(df, "vec_id", "embedding", centres=20)
    found, work = cells.permitted(cells.index(df, centres), centres, asked, 10)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.qid, r.rank)):
        got.setdefault(r.qid, []).append((r.doc, round(r.score, 6)))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q, c in ((0, 1), (1, 2), (2, 4), (3, 7), (4, 8), (5, 1), (6, 1)):
        want = sorted(((-round(float(unit[q] @ unit[i]), 9), i) for i, _, a in rows[:300] if a & c))[:10]
        assert got.get(q, []) == [(i, round(-s, 6)) for s, i in want]
    assert sum(r.multiplied for r in work.collect()) < 0.8 * sum(sum(bool(a & c) for _, _, a in rows[:300]) for c in (1, 2, 4, 7, 1, 1))


def _cuts(text):
    for marks in itertools.product((0, 1), repeat=max(0, len(text) - 1)):
        out = [0, *(i + 1 for i, m in enumerate(marks) if m), len(text)]
        yield [text[a:b] for a, b in itertools.pairwise(out)]


def test_best_path_over_all_cuts():
    rng = random.Random(6)
    counts = {"".join(rng.choice("abไ語") for _ in range(rng.randrange(1, 4))): rng.randrange(1, 50) for _ in range(14)}
    cut = segmenting.BestPath(counts.items())
    price = lambda ws: sum(cut.cost.get(w, cut.alone if len(w) == 1 else math.inf) for w in ws)
    for _ in range(60):
        text = "".join(rng.choice("abไ語x") for _ in range(rng.randrange(0, 11)))
        found = cut(text)
        assert "".join(found) == text and (not text or price(found) == pytest.approx(min(map(price, _cuts(text)))))
    assert segmenting.BestPath([])("ab") == ["a", "b"]


@pytest.mark.parametrize("chars,step,pairs", [(1 << 17, 24, 1 << 20), (50, 2, 0), (1 << 17, 10**9, 0)])
def test_best_paths_of_many_texts(monkeypatch, chars, step, pairs):
    """Against a plain loop over each text: short and long pieces, letters of no word, nothing at all."""
    monkeypatch.setattr(segmenting, "CHARS", chars)
    monkeypatch.setattr(segmenting, "STEP", step)
    monkeypatch.setattr(segmenting, "PAIRS", pairs)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeไ語") for _ in range(rng.randrange(1, 6)))
    cut = segmenting.BestPath({word(): rng.randrange(1, 90) for _ in range(300)}.items())
    texts = ["", "x", "\0", "\0a\0", *("".join(rng.choice("abcde語xy_\ud800"[: rng.choice([5, 10])]) for _ in range(rng.randrange(90))) for _ in range(80)), "".join(word() for _ in range(900)), ""]
    found = list(cut.many(texts))
    assert [*map("".join, found)] == texts and list(cut.many([])) == [] and found[-2] == cut(texts[-2])
    price = lambda ws: sum(min(cut.cost.get(w, math.inf), cut.alone if len(w) == 1 else math.inf) for w in ws)
    for text, ws in zip(texts, found, strict=True):
        best = [0.0]
        for j in range(1, len(text) + 1):
            best.append(min(best[i] + price([text[i:j]]) for i in range(max(0, j - 5), j)))
        assert price(ws) == pytest.approx(best[-1])
    even = segmenting.BestPath([(w, 1) for w in ("a", "b", "c", "d", "ab", "bc", "cd", "bcd", "z")])
    assert list(even.many(["abc", "abcd", "dabc"])) == [["a", "bc"], ["a", "bcd"], ["d", "a", "bc"]]


def test_best_path_finds_spaced_words_again(spark):
    docs = spark.createDataFrame([("the cat sat on the mat",), ("a cat and the dog",), (None,)], "text string")
    counts = [(r.term, r.n) for r in segmenting.dictionary(docs, "text").collect()]
    assert dict(counts)["the"] == 3
    assert segmenting.BestPath(counts)("thecatandthedogsat") == ["the", "cat", "and", "the", "dog", "sat"]


@pytest.mark.parametrize("words", [1, 3, 4, 5, 6, 99])
def test_dictionary_sorts_what_is_frequent(spark, words):
    docs = spark.createDataFrame([("d c b a a b b",), ("e e c, longword",), (None,)], "text string")
    found = segmenting.dictionary(docs, "text", words, 7)
    want = [("b", 3), ("a", 2), ("c", 2), ("e", 2), ("d", 1)]
    assert [(r.term, r.n) for r in found.collect()] == want[:words]
    # Words that are too rare are dropped before the order.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert f">= {want[: words][-1][1]})" in plan


def test_abbreviations_and_sentences(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "house", "river", "e", "and"]
    say = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(4, 9)))
    texts = [f"Dr. {rng.choice('SJM')}mith said {say()}. The {say()}, e.g. {say()}. And {say()}! Is {say()}?\n\nNew {say()}." for _ in range(80)] + [None, "", "Dr. Smith stays whole. It does."]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    known = {r.type for r in segmenting.abbreviations(docs, "text").collect()}
    assert {"dr", "e.g"} <= known and not known & {"alpha", "house", "river", "does"}
    rows = docs.select("doc_id", segmenting.whole_sentences(F.col("text"), sorted(known)).alias("s"), tx.sentences(F.col("text")).alias("plain")).collect()
    last = next(r for r in rows if r.doc_id == 82)
    assert [x.text for x in last.s] == ["Dr. Smith stays whole.", "It does."] and [x.starts_paragraph for x in last.s] == [True, False]
    for r in rows[:80]:
        assert len(r.s) == 5 and [x.text for x in r.s if x.starts_paragraph] == [r.s[0].text, r.s[4].text]
        assert "".join(x.text for x in r.s).replace(" ", "") == "".join(x.text for x in r.plain).replace(" ", "")
    assert next(r for r in rows if r.doc_id == 80).s is None


def test_counts_behind_the_ratio(spark):
    docs = spark.createDataFrame([("U.S. a.b. end... end. End, (etc.) etc. x_y",)], "text string")
    got = {r.type: (r.n, r.k) for r in segmenting.word_stops(docs, "text").collect()}
    assert got == {"u.s": (1, 1), "a.b": (1, 1), "end...": (1, 0), "end": (2, 1), "etc": (2, 2), "x_y": (1, 0)}
    assert all(re.search("[a-z]", t) for t in got)


@pytest.mark.parametrize("k", [3, 50])
def test_top_in_rows_is_the_ranking_of_all_scores(spark, monkeypatch, k):
    rng = random.Random(k)
    word = lambda: "w" + str(int(rng.expovariate(0.1)))
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randrange(25)))) for i in range(150)] + [(900, None), (901, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(q, " ".join(word() for _ in range(rng.randrange(6)))) for q in range(20)] + [(50, None), (51, "nowhere")], "item_id long, text string")
    tokens = tx.latin_tokens(F.col("text"))
    every = retrieval.top(retrieval.bm25(retrieval.index(docs, "doc_id", tokens)[0], asked, "item_id", tokens), k)
    monkeypatch.setattr(retrieval, "SCORES", 400)
    told = lambda df: sorted((r.qid, r.rank, r.doc, round(r.score, 8)) for r in df.collect())
    assert told(retrieval.bm25_top(docs, "doc_id", tokens, asked, "item_id", k)) == told(every)
    assert retrieval.bm25_top(docs, "doc_id", tokens, asked.limit(0), "item_id", k).count() == 0
    assert retrieval.bm25_top(docs.limit(0), "doc_id", tokens, asked, "item_id", k).count() == 0
    monkeypatch.setattr(retrieval, "ASKED", 3)
    assert told(retrieval.bm25_top(docs, "doc_id", tokens, asked, "item_id", k)) == told(every)
