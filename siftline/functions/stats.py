"""Intervals and tests over counts and paired outcomes."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % interval in percent, two digits; 0 for no trials."""
    k, z = k.cast("double"), F.lit(Z95)
    safe = F.greatest(n.cast("double"), F.lit(1.0))
    p, d = k / safe, 1 + z * z / safe
    mid, half = (p + z * z / (2 * safe)) / d, z / d * F.sqrt(p * (1 - p) / safe + z * z / (4 * safe * safe))
    bound = lambda x: F.when(n == 0, 0.0).otherwise(F.round(100 * x, 2))
    return bound(mid - half), bound(mid + half)


def two_sided(b: int, c: int) -> float:
    """min(1, 2 P(X <= min(b, c))) for a fair binomial of b + c.

    The tail is summed from its largest term down, each term from the one before, until terms no longer count:
    some multiples of the square root of the number of pairs.
    """
    import numpy as np

    n, k = b + c, min(b, c)
    if n == 0 or 2 * k >= n:
        return 1.0
    largest = math.comb(n, k) / 2**n if n <= 1000 else math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
    total, last = 1.0, 1.0
    for at in range(0, k, 65_536):
        m = np.arange(at + 1, min(at + 65_536, k) + 1, dtype=float)
        terms = last * np.cumprod((k - m + 1) / (n - k + m))
        total, last = total + float(terms.sum()), float(terms[-1])
        if last < 1e-18 * total:
            break
    return min(1.0, 2 * largest * total)


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of discordant counts; 1 for none."""

    def run(b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([two_sided(int(x), int(y)) for x, y in zip(b, c, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(b, c)


def holm(df: DataFrame, p: str, alpha: float = 0.05, order: str = "id") -> DataFrame:
    """Adds ``significant``: Holm-Bonferroni step-down over all rows of a (small) family."""
    by = Window.orderBy(p, order)
    steps = df.withColumn("_i", F.row_number().over(by)).withColumn("_m", F.count("*").over(Window.partitionBy()))
    ok = F.col(p) <= alpha / (F.col("_m") - F.col("_i") + 1)
    return steps.withColumn("_ok", ok).withColumn("significant", F.every("_ok").over(Window.orderBy("_i"))).drop("_i", "_m", "_ok")


def bootstrap(df: DataFrame, group: str, diff: str, draws: int = 10_000, seed: int = 0, scale: float = 1.0) -> DataFrame:
    """group, n, mean, low, high, p of paired differences, times ``scale``; 0, 0, 0 and 1 for none.

    Differences are counted before they meet: a task gets a group's distinct values and their counts,
    and a resample is a multinomial draw of counts. Differences of 0/1 outcomes have three values.
    """
    columns = ["g", "n", "mean", "low", "high", "p"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.dropna(subset=["d"]).sort_values("d")
        d, counts = rows["d"].to_numpy(float), rows["n"].to_numpy(np.int64)
        n = int(counts.sum())
        if not n:
            return pd.DataFrame([(*key, 0, 0.0, 0.0, 0.0, 1.0)], columns=columns)
        rng = np.random.default_rng(random.Random(seed).getrandbits(64))
        step = max(1, 4_000_000 // len(d))
        parts = [rng.multinomial(n, counts / n, min(step, draws - i)) @ d / n for i in range(0, draws, step)]
        means = np.sort(np.concatenate(parts))
        p = max(min(2 * min((means >= 0).mean(), (means <= 0).mean()), 1.0), 1 / draws)
        return pd.DataFrame([(*key, n, scale * (counts @ d) / n, scale * means[int(0.025 * draws)], scale * means[int(0.975 * draws)], p)], columns=columns)

    rows = df.select(F.col(group).cast("string").alias("g"), F.col(diff).cast("double").alias("d")).groupBy("g", "d").agg(F.count("d").alias("n"))
    return rows.groupBy("g").applyInPandas(run, "g string, n long, mean double, low double, high double, p double").withColumnRenamed("g", group)


#: Multiplier, increment and modulus of the linear congruential generator.
LCG = (1_103_515_245, 12_345, 2**31)
#: Draws that a row of work makes, and places drawn at a time.
DRAWS, PLACES = 250, 4096


def bootstrap_lcg(df: DataFrame, group: str, diff: str, draws: int = 10_000, seed: int = 0, scale: float = 1.0) -> DataFrame:
    """As ``bootstrap``, by place: each draw steps a generator once for each difference and takes the one there.

    Draw d starts at the first 28 bits of md5(seed:d); a step's place is floor(state * n / modulus) in the order of
    differences, so that any engine gets the same resamples. Work grows with draws times differences: for sets of
    queries, spread over tasks by groups of draws. Null differences are left out; a group's distinct values travel as one array.
    """
    a, c, m = LCG

    def means(first: pd.Series, n: pd.Series, values: pd.Series, counts: pd.Series) -> pd.Series:
        import hashlib

        import numpy as np

        out = []
        for f, size, v, k in zip(first, n, values, counts, strict=True):
            v, edge = np.asarray(v, float), np.cumsum(np.asarray(k, np.int64))
            at = range(f, min(f + DRAWS, draws))
            start = np.array([int(hashlib.md5(f"{seed}:{d}".encode()).hexdigest()[:7], 16) for d in at], np.int64)
            mul, add = np.empty(PLACES, np.int64), np.empty(PLACES, np.int64)
            x, y = 1, 0
            for i in range(PLACES):
                x, y = x * a % m, (y * a + c) % m
                mul[i], add[i] = x, y
            total = np.zeros(len(start))
            for done in range(0, size, PLACES):
                width = min(PLACES, size - done)
                state = (start[:, None] * mul[None, :width] + add[None, :width]) % m
                total += v[np.searchsorted(edge, state * size // m, side="right")].sum(axis=1)
                start = state[:, -1]
            out.append((total / size).tolist())
        return pd.Series(out)

    resample = F.pandas_udf(means, "array<double>")
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(diff).cast("double").alias("d")).groupBy("g", "d").agg(F.count("d").alias("k"))
    some = F.col("d").isNotNull()
    held = F.array_sort(F.collect_list(F.when(some, F.struct("d", "k"))))
    sizes = rows.groupBy("g").agg(held.alias("v"), F.sum("k").alias("n"), F.try_divide(F.sum(F.col("d") * F.col("k")), F.sum("k")).alias("mean"))
    work = sizes.filter("n > 0").select("g", "n", "v", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(DRAWS))).alias("first"))
    work = work.repartition("g", "first")
    got = work.select("g", F.explode(resample("first", "n", F.col("v.d"), F.col("v.k"))).alias("x"))
    part = lambda c: F.count_if(c) / F.lit(draws)
    tests = got.groupBy("g").agg(F.sort_array(F.collect_list("x")).alias("xs"), F.greatest(F.least(2 * F.least(part(F.col("x") >= 0), part(F.col("x") <= 0)), F.lit(1.0)), F.lit(1.0 / draws)).alias("p"))
    cut = lambda q: F.coalesce(scale * F.get("xs", int(q * draws)), F.lit(0.0))
    out = sizes.join(tests, "g", "left")
    return out.select(F.col("g").alias(group), "n", F.coalesce(scale * F.col("mean"), F.lit(0.0)).alias("mean"), cut(0.025).alias("low"), cut(0.975).alias("high"), F.coalesce("p", F.lit(1.0)).alias("p"))


def contrast_family(outcomes: DataFrame, contrasts: list[tuple[str, str, str]], metric: str) -> DataFrame:
    """family, diff: a row for each query, arm and (name, config, other config): one configuration against another.

    outcomes: as for ``delta_family``. Queries that lack a configuration are left out of its contrasts.
    """
    sides = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(of).alias("of"), F.lit(sign).alias("sign")) for name, a, b in contrasts for of, sign in ((a, 1), (b, -1))))
    rows = outcomes.select("config", "qid", "type", "arm", F.col(metric).cast("double").alias("v"), F.explode(sides).alias("s")).filter("config = s.of")
    both = rows.groupBy("s.name", "qid", "type", "arm").agg(F.sum(F.col("s.sign") * F.col("v")).alias("diff"), F.count_distinct("s.sign").alias("sides")).filter("sides = 2")
    return both.select(F.concat_ws("/", "name", "arm", F.lit(metric)).alias("family"), "diff")


def delta_family(outcomes: DataFrame, pairs: list[tuple[str, str]], metrics: list[str]) -> DataFrame:
    """family, diff: a row for each query, pair of arms and metric, overall and by type.

    outcomes: config, qid, type, arm and the metrics as 0/1 or doubles. Queries that lack an arm are
    left out of that arm's pairs. ``bootstrap`` and ``holm`` over family give the family of tests.
    """
    arms = sorted({a for p in pairs for a in p})
    firsts = [F.first(m).cast("double").alias(m) for m in metrics]
    return wide_family(outcomes.groupBy("config", "qid", "type").pivot("arm", arms).agg(*firsts), pairs, metrics)


def wide_family(wide: DataFrame, pairs: list[tuple[str, str]], metrics: list[str]) -> DataFrame:
    """As ``delta_family`` for outcomes with a row for each query: config, type and a column for each arm, named arm_metric if metrics are several."""
    at = lambda arm, m: F.col(f"{arm}_{m}" if len(metrics) > 1 else arm)
    rows = F.array(*(F.struct(F.lit(f"{a}-{b}").alias("pair"), F.lit(m).alias("metric"), (at(a, m) - at(b, m)).alias("diff")) for a, b in pairs for m in metrics))
    long = wide.select("config", "type", F.explode(rows).alias("x"))
    long = long.select("config", F.explode(F.array(F.lit("all"), F.col("type"))).alias("stratum"), "x.pair", "x.metric", "x.diff").filter("diff IS NOT NULL")
    return long.select(F.concat_ws("/", "config", "stratum", "pair", "metric").alias("family"), "diff")


def geometric_mean(ratio: Column) -> Column:
    return F.exp(F.avg(F.ln(ratio)))


# Tests and measures over orders ----------------------------------------------------------------


def null_tail(doubled: list[int], total: int) -> float:
    """min(1, 2 min(P(W <= total), P(W >= total))) where each of the doubled ranks has its sign by a fair coin.

    Exact: the number of sign patterns for each sum, by dynamic programming.
    """
    ways = [1] + [0] * sum(doubled)
    for r in doubled:
        ways = [w + (ways[s - r] if s >= r else 0) for s, w in enumerate(ways)]
    return min(1.0, 2 * min(sum(ways[: total + 1]), sum(ways[total:])) / 2 ** len(doubled))


def signed_rank(df: DataFrame, group: str, diff: str, exact: int = 50) -> DataFrame:
    """group, n, w_plus, w_minus, z, p: Wilcoxon's signed-rank test of paired differences.

    Null and zero differences are left out; equal absolute differences share their average rank. Up to ``exact`` pairs p
    comes from the null distribution given the ties, above from the normal one with the variance corrected for ties.
    Groups without differences get p = 1. Ranks are running sums over counted values, so a group may have any size.
    """
    from ..operators.ordered import running

    d = F.col(diff).cast("double")
    counts = df.filter(d.isNotNull() & ~F.isnan(d) & (d != 0)).groupBy(group, F.abs(d).alias("a")).agg(F.count("*").alias("n"), F.count_if(d > 0).alias("up"))
    ranked = running(counts, [group], "a", ["n"]).withColumn("r2", 2 * F.col("before_n") + F.col("n") + 1)
    n, big = F.col("n").cast("double"), "decimal(38,0)"
    # At most ``exact`` entries, for groups that are tested exactly.
    few = F.collect_list(F.when(F.col("all_n") <= exact, F.struct("r2", "n")))
    sums = ranked.groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.col("up").cast(big) * F.col("r2")).cast(big).alias("w2"), F.sum(n * n * n - n).alias("ties"), few.alias("ranks"))

    def tail(n: pd.Series, w2: pd.Series, z: pd.Series, ranks: pd.Series) -> pd.Series:
        exactly = lambda w, of: null_tail([int(r["r2"]) for r in of for _ in range(r["n"])], int(w))
        return pd.Series([exactly(w, of) if m <= exact else math.erfc(abs(z) / math.sqrt(2)) for m, w, z, of in zip(n, w2, z, ranks, strict=True)], dtype="float64")

    m = F.col("n").cast("double")
    plus = F.col("w2").cast("double") / 2
    z = (plus - m * (m + 1) / 4) / F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48)
    tested = sums.withColumn("z", z).withColumn("p", F.pandas_udf(tail, "double")("n", F.col("w2").cast("string"), "z", "ranks"))
    tested = tested.select(F.col(group).alias("_g"), "n", plus.alias("w_plus"), (m * (m + 1) / 2 - plus).alias("w_minus"), "z", "p")
    out = df.select(group).distinct().join(tested, F.col(group).eqNullSafe(F.col("_g")), "left")
    rest = {"n": 0, "w_plus": 0.0, "w_minus": 0.0, "z": 0.0, "p": 1.0}
    return out.select(group, *(F.coalesce(c, F.lit(v)).alias(c) for c, v in rest.items()))


def risk_coverage(df: DataFrame, keys: list[str], score: str, wrong: str) -> DataFrame:
    """keys, score, taken, covered, errors, coverage, risk: answers are taken by falling score, those of one score together.

    covered, errors: answers taken so far and the wrong ones among them; taken: those of this score. Rows without a score are never taken.
    """
    from ..operators.ordered import running

    rows = df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count("*").alias("n"), F.count_if(F.col(wrong)).alias("e"))
    rows = running(rows, keys, score, ["n", "e"], falling=True)
    covered, errors = F.col("before_n") + F.col("n"), F.col("before_e") + F.col("e")
    return rows.select(*keys, score, F.col("n").alias("taken"), covered.alias("covered"), errors.alias("errors"), (covered / F.col("all_n")).alias("coverage"), (errors / covered).alias("risk"))


def risk_area(curve: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, risk, area, excess: the mean risk over all coverages, and how much it exceeds that of a perfect order.

    A perfect order takes all right answers first; with a share r of errors its area tends to r + (1 - r) ln(1 - r).
    """
    n, r = F.sum("taken"), F.max_by("risk", "covered")
    best = F.when(r >= 1, 1.0).otherwise(r + (1 - r) * F.ln(1 - r))
    area = F.sum(F.col("risk") * F.col("taken")) / n
    return curve.groupBy(*keys).agg(n.alias("n"), r.alias("risk"), area.alias("area"), (area - best).alias("excess"))


def kendall(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, concordant, discordant, tau_b of two numbers; null where either order has one value only. Rows that lack a number are left out."""
    from ..operators.ordered import inversions

    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("n"))
    whole = lambda c: c.cast("decimal(20,0)")
    pairs = lambda c: (whole(c) * (whole(c) - 1)).cast("decimal(38,0)")  # noqa: E731  twice the pairs
    tied = lambda by, name: points.groupBy(*keys, *by).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias(name), *([F.sum("n").alias("n")] if name == "joint" else []))
    on = lambda a, b: a.join(b, keys, "left") if keys else a.crossJoin(b)  # noqa: E731  one row each without keys
    out = on(on(tied(["x", "y"], "joint"), tied(["x"], "tx")), tied(["y"], "ty"))
    out = on(out, inversions(points, keys))
    d, all2 = F.coalesce("inversions", F.lit(0)).cast("decimal(38,0)"), pairs(F.col("n"))
    c2 = all2 - F.col("tx") - F.col("ty") + F.col("joint") - 2 * d
    real = lambda c: c.cast("double")
    tau = F.try_divide(real(c2 - 2 * d), F.sqrt(real(all2 - F.col("tx"))) * F.sqrt(real(all2 - F.col("ty"))))
    return out.select(*keys, "n", F.floor(c2 / 2).cast("long").alias("concordant"), d.cast("long").alias("discordant"), tau.alias("tau_b"))


def mid_p(b: Column, c: Column) -> Column:
    """McNemar's mid-p of discordant counts: the exact p less the probability of the counts found; 1 for none."""

    def run(b: pd.Series, c: pd.Series) -> pd.Series:
        def one(b: int, c: int) -> float:
            n, k = b + c, min(b, c)
            if not n:
                return 1.0
            own = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
            return 1 - own if b == c else two_sided(b, c) - own

        return pd.Series([one(int(x), int(y)) for x, y in zip(b, c, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(b, c)


def equivalence(df: DataFrame, group: str, diff: str, margin: float, alpha: float = 0.05) -> DataFrame:
    """group, n, mean, low, high, equivalent: two one-sided tests of paired differences against +-``margin``.

    Both reject where the 1 - 2 alpha interval of the mean (normal) lies inside the margins. Under two differences nothing is shown.
    """
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - alpha)
    rows = df.groupBy(group).agg(F.count(diff).alias("n"), F.avg(diff).alias("mean"), (z * F.stddev_samp(diff) / F.sqrt(F.count(diff))).alias("half"))
    low, high = F.col("mean") - F.col("half"), F.col("mean") + F.col("half")
    inside = F.coalesce((low > -margin) & (high < margin), F.lit(False))
    return rows.select(group, "n", "mean", low.alias("low"), high.alias("high"), inside.alias("equivalent"))
