import random

import numpy as np
import pytest

from siftline.llm import graph_search as op
from siftline.llm import queries

SCHEMA = "vec_id long, embedding array<double>, id long, v string, h long, ids string, dim string, shard string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "v", 2, "i", "d", "s", "x") for i, v in rows], SCHEMA)


def brute(rows, every=20, k=20):
    good = [(i, v) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v))]
    out = {}
    for i in {i for i, _ in good if i % every == 0}:
        best = {}
        for q in (v for j, v in good if j == i):
            for j, v in good:
                if j != i and len(v) == len(q):
                    s = float((np.array(q) * np.array(v)).sum())
                    best[j] = max(best.get(j, s), s)
        out[i] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def answers(spark, rows, **how):
    got = op.nearest(table(spark, rows), **how)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    out = {}
    for r in sorted(got.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({a for a, _ in got.get(q, [])} & {a for a, _ in best}) / len(best) for q, best in want.items() if best])


def test_pruning_by_hand():
    assert op.norms(np.array([[3e200, 4e200], [3e-200, 4e-200]])).ravel() == pytest.approx([5e200, 5e-200])
    data, sq = op.padded(np.array([[0, 0], [1, 0], [1.2, 0], [0, 3], [-9, 0]], np.float32))
    # 2 is nearer to 1 than to 0 by far; 3 and 4 lie elsewhere; 5 and the point itself are none.
    assert op.prune(data, sq, np.array([0]), np.array([[0, 1, 2, 2, 3, 4, 5]], np.int32), 4).tolist() == [[1, 3, 4, 5]]
    assert op.prune(data, sq, np.array([0]), np.array([[4, 3, 2, 1]], np.int32), 1).tolist() == [[1]]


def test_graph_reaches_and_repeats():
    v = np.random.RandomState(1).randn(900, 12).astype(np.float32)
    edges, entry = op.build(v, degree=12, beam=24)
    again, _ = op.build(v, degree=12, beam=24)
    assert (edges == again).all() and edges.shape == (900, 12)
    assert all(p not in e for p, e in enumerate(edges.tolist()))
    data, sq = op.padded(v)
    edges = np.concatenate([edges, np.full((1, 12), 900, np.int32)])
    near = op.search(data, sq, edges, entry, v, 24)[0]
    assert (near[:, 0] == np.arange(900)).mean() > 0.98
    assert all(len(set(r)) == len(r) for r in near.tolist())


@pytest.mark.parametrize("kind", ["clusters", "hot", "long"])
def test_recall_and_scores(spark, kind):
    """Small shards and blocks; norms differ; groups of equal and of nearly equal vectors."""
    rng = np.random.RandomState(4)
    centres = rng.randn(8, 10) * 3
    v = centres[rng.randint(8, size=1500)] + rng.randn(1500, 10)
    v *= rng.uniform(0.2, 3, size=(1500, 1))
    if kind == "hot":
        v[::3] = v[0]
        v[1::3] = v[1] + rng.randn(500, 10) * 1e-3
    if kind == "long":  # a few so long, and so short, that others look alike beside them
        v[::100] *= 1e9
        v[1::100] *= 1e-9
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got, want = answers(spark, rows, shard=400, block=30), brute(rows)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    for q, best in got.items():
        assert all(s == pytest.approx(float(v[q] @ v[i]), rel=1e-9, abs=1e-12) for i, s in best)
        assert best == sorted(best, key=lambda x: (-x[1], x[0]))
    if kind != "hot":
        assert recall(got, want) > 0.95
    else:  # ties: by what the score is worth
        assert np.mean([a[1] >= b[1] - 1e-9 for q in want for a, b in zip(got[q], want[q], strict=True)]) > 0.95


def test_few_candidates_are_all_given(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(0, 45, 5)]
    got, want = answers(spark, rows), brute(rows)
    assert {q: [i for i, _ in b] for q, b in got.items()} == {q: [i for i, _ in b] for q, b in want.items()}
    assert answers(spark, [(20, [1.0, 2.0])]) == {}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [2.0, 4.0]), (9, [-1.0, 0.5]), (20, [1.0, 2.0]), (40, [1.0, 2.0, 3.0]), (60, None), (80, [3.0, 1.0, 1.0]), (100, [5.0]), (-20, [0.5, -0.25]), (11, [1e200, 1e200]), (12, [1e-200, 0.0])]
    got, want = answers(spark, rows), brute(rows)
    assert {q: [i for i, _ in b] for q, b in got.items()} == {q: [i for i, _ in b] for q, b in want.items() if b}
    assert answers(spark, []) == {}


def test_whole_table_recall(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = {}
    for r in queries.QUERIES["op12_neighbours"](spark, sf_dir).collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows)
    assert set(out) == set(want) and recall(out, want) >= 0.95
