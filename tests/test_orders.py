"""Running sums, ranks, inversions and the tests on them against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import stats as st
from siftline.operators import ordered


def _ranks(values):
    return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]


@pytest.mark.parametrize("cells", [1, 3, 40])
@pytest.mark.parametrize("falling", [False, True])
def test_running_sums(spark, cells, falling):
    rng = random.Random(cells)
    rows = {(g, v): rng.randrange(9) for g in ("a", "b", None) for v in rng.sample(range(-50, 50), 30)}
    df = spark.createDataFrame([(g, float(v), n) for (g, v), n in rows.items()], "g string, v double, n long").repartition(5)
    for r in ordered.running(df, ["g"], "v", ["n"], falling=falling, cells=cells).collect():
        own = {v: n for (g, v), n in rows.items() if g == r.g}
        assert r.before_n == sum(n for v, n in own.items() if (v > r.v if falling else v < r.v)) and r.all_n == sum(own.values())


def test_running_sums_without_keys_and_in_one_cell(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(20)], "v double, n long")
    assert {(r.v, r.before_n) for r in ordered.running(df, [], "v", ["n"], cells=4).collect()} == {(float(i), i) for i in range(20)}
    assert ordered.running(df.limit(0), [], "v", ["n"]).count() == 0


def test_no_window_over_a_whole_table(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    plan = ordered.running(df, [], "v", ["n"], cells=50)._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window " in x and "_cell" not in x and "_t_n" not in x]
    assert not windows


def _inverted(rows):
    return sum(n * m for (a, b, n), (c, d, m) in itertools.permutations(rows, 2) if a < c and b > d)


@pytest.mark.parametrize("cells", [1, 2, 7, 100])
@pytest.mark.parametrize("shape", ["spread", "tied", "hot", "falling"])
def test_inversions(spark, cells, shape):
    rng = random.Random(shape)
    points = {}
    for i in range(150):
        x, y = {"spread": (rng.random(), rng.random()), "tied": (rng.randrange(9), rng.randrange(9)), "hot": (3 if i % 2 else rng.randrange(60), 5 if i % 3 else rng.randrange(60)), "falling": (i, -i)}[shape]
        points[rng.choice("pq"), float(x), float(y)] = rng.randrange(1, 4)
    df = spark.createDataFrame([(*k, n) for k, n in points.items()], "g string, x double, y double, n long")
    want = {g: _inverted([(x, y, n) for (h, x, y), n in points.items() if h == g]) for g in "pq"}
    assert {r.g: int(r.inversions) for r in ordered.inversions(df, ["g"], cells).collect()} == want


def test_inversions_of_large_counts():
    import numpy as np

    big = np.array([2**40, 2**40])
    assert ordered.inverted(np.array([1.0, 2.0]), np.array([2.0, 1.0]), big) == 2**80
    assert ordered.inverted(np.zeros(0), np.zeros(0), np.zeros(0, int)) == 0


def test_signed_rank_against_all_sign_patterns(spark):
    rng = random.Random(1)
    rows = [(g, float(rng.choice([-3, -2, -1, 0, 0, 1, 1, 2, 4, 5]))) for g in ("a", "b", "c") for _ in range(11)] + [("zero", 0.0), ("none", None), ("a", float("nan"))]
    got = {r.grp: r for r in st.signed_rank(spark.createDataFrame(rows, "grp string, d double"), "grp", "d").collect()}
    for g in ("a", "b", "c"):
        d = [v for h, v in rows if h == g and v == v and v]
        ranks = _ranks([abs(v) for v in d])
        w = sum(r for r, v in zip(ranks, d, strict=True) if v > 0)
        sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(d))]
        p = min(1, 2 * min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / len(sums))
        assert got[g].n == len(d) and got[g].w_plus == w and got[g].w_minus == sum(ranks) - w and got[g].p == pytest.approx(p, abs=1e-12)
    assert (got["zero"].n, got["zero"].p, got["none"].p) == (0, 1.0, 1.0)


def test_signed_rank_of_many_pairs_is_near_the_exact_one(spark):
    rng = random.Random(4)
    rows = [("g", rng.gauss(0.3, 1)) for _ in range(60)]
    df = spark.createDataFrame(rows, "grp string, d double")
    far, near = st.signed_rank(df, "grp", "d").first(), st.signed_rank(df, "grp", "d", exact=60).first()
    assert far.w_plus == near.w_plus and far.p == pytest.approx(near.p, abs=2e-3)


def test_risk_by_coverage(spark):
    rows = [("m", 0.9, False), ("m", 0.9, True), ("m", 0.5, False), ("m", 0.1, True), ("m", None, True)]
    curve = st.risk_coverage(spark.createDataFrame(rows, "k string, s double, wrong boolean"), ["k"], "s", "wrong")
    assert sorted((r.s, r.covered, r.errors, r.coverage, r.risk) for r in curve.collect()) == [(0.1, 4, 2, 1.0, 0.5), (0.5, 3, 1, 0.75, 1 / 3), (0.9, 2, 1, 0.5, 0.5)]
    area = st.risk_area(curve, ["k"]).first()
    assert area.area == pytest.approx((0.5 + 0.5 + 1 / 3 + 0.5) / 4) and area.risk == 0.5


def test_kendall_against_pairs(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(12), rng.randrange(9)) for _ in range(120)] + [(None, 1), (1, None)]
    some = [r for r in rows if None not in r]
    c = sum((a - x) * (b - y) > 0 for (a, b), (x, y) in itertools.combinations(some, 2))
    d = sum((a - x) * (b - y) < 0 for (a, b), (x, y) in itertools.combinations(some, 2))
    xs, ys = sum(a != x for (a, _), (x, _) in itertools.combinations(some, 2)), sum(b != y for (_, b), (_, y) in itertools.combinations(some, 2))
    for keys in ([], ["g"]):
        r = st.kendall(spark.createDataFrame([("k", *r) for r in rows], "g string, a int, b int"), keys, "a", "b").first()
        assert (r.n, r.concordant, r.discordant) == (len(some), c, d) and r.tau_b == pytest.approx((c - d) / (xs * ys) ** 0.5)
    flat = st.kendall(spark.createDataFrame([(1, 2), (1, 3)], "a int, b int"), [], "a", "b").first()
    assert flat.tau_b is None and flat.n == 2


def test_mid_p_and_equivalence(spark):
    p = spark.createDataFrame([(0, 0), (3, 3), (1, 4), (10, 2)], "b int, c int").select(st.mid_p(F.col("b"), F.col("c")).alias("p")).collect()
    assert [r.p for r in p] == pytest.approx([1.0, 1 - 20 / 64, (2 * (1 + 5) - 5) / 32, (2 * (1 + 12 + 66) - 66) / 4096])
    rows = [("near", float(i % 3 - 1)) for i in range(90)] + [("far", float(10 + i % 3)) for i in range(90)] + [("one", 0.0), ("none", None)]
    got = {r.g: r.equivalent for r in st.equivalence(spark.createDataFrame(rows, "g string, d double"), "g", "d", 7.0).collect()}
    assert got == {"near": True, "far": False, "one": False, "none": False}


def test_medians(spark):
    import statistics

    rng = random.Random(3)
    rows = [(g, float(rng.randrange(30))) for g in ("a", "b", None) for _ in range(rng.randrange(20, 40))] + [("a", None), ("none", None)]
    got = {r.g: r.median for r in ordered.medians(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert got == {g: statistics.median(v for h, v in rows if h == g and v is not None) for g in ("a", "b", None)}
    assert ordered.medians(spark.createDataFrame([], "v double"), [], "v").first().median is None
