"""Statistics to call from SQL, over the engine's own aggregates: counts and sums merge at any partitioning.

``register`` makes temporary functions of the session:

    SELECT lang, wilson(count_if(hit), count(*)).low FROM t GROUP BY lang
    SELECT lang, mcnemar(count_if(a AND NOT b), count_if(b AND NOT a)) FROM t GROUP BY lang
    SELECT lang, draw, sum(poisson_weight(id, draw) * d) / sum(poisson_weight(id, draw)) AS mean
    FROM t LATERAL VIEW explode(sequence(0, 999)) AS draw GROUP BY lang, draw

The last one is a bootstrap whose resamples are Poisson weights: each row draws its own number of copies for each resample
from its key alone, so partial sums add up, whichever task holds a row. ``poisson_bootstrap`` ends it with interval and p.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stats import Z95

#: Shares of copies up to 0, 1, ... that a Poisson number of mean 1 has; over 12 copies come once in 10^10 draws and count as 13.
SHARES = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(13)]


def uniform(key: str, draw: str) -> str:
    """SQL of a number from 0 to 1 that key and draw alone decide: eight of the 32 digits of an md5 for four draws."""
    digits = f"substr(md5(concat(CAST({key} AS STRING), ':', CAST({draw} DIV 4 AS STRING))), CAST(1 + 8 * ({draw} % 4) AS INT), 8)"
    return f"CAST(conv({digits}, 16, 10) AS DOUBLE) / 4294967296"


def register(spark: SparkSession) -> None:
    safe = "greatest(CAST(n AS DOUBLE), 1D)"
    p, z = f"(CAST(k AS DOUBLE) / {safe})", f"{Z95}D"
    mid, scale = f"({p} + {z} * {z} / (2 * {safe}))", f"(1 + {z} * {z} / {safe})"
    half = f"({z} * sqrt({p} * (1 - {p}) / {safe} + {z} * {z} / (4 * {safe} * {safe})))"
    bound = lambda sign: f"IF(n = 0, 0D, round(100 * ({mid} {sign} {half}) / {scale}, 2))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION wilson(k BIGINT, n BIGINT) RETURNS STRUCT<low: DOUBLE, high: DOUBLE> RETURN named_struct('low', {bound('-')}, 'high', {bound('+')})")
    k, n = "least(b, c)", "(b + c)"
    # The tail's largest term, and the others from it downwards.
    top = f"exp(aggregate(sequence(0L, {k}), 0D, (s, i) -> s + IF(i = 0, 0D, ln(({n} - {k} + i) / i))) - {n} * ln(2D))"
    tail = f"aggregate(sequence(0L, {k}), named_struct('term', 1D, 'sum', 0D), (s, i) -> named_struct('term', s.term * ({k} - i) / ({n} - {k} + i + 1), 'sum', s.sum + s.term), s -> s.sum)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION mcnemar(b BIGINT, c BIGINT) RETURNS DOUBLE RETURN IF(b = c, 1D, least(1D, 2 * {top} * {tail}))")
    copies = " + ".join(f"CAST(u >= {s!r}D AS INT)" for s in SHARES)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION poisson_copies(u DOUBLE) RETURNS INT RETURN {copies}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION poisson_weight(key BIGINT, draw BIGINT) RETURNS INT RETURN poisson_copies({uniform('key', 'draw')})")


def copies(u: Column) -> Column:
    return sum(((u >= s).cast("int") for s in SHARES), F.lit(0))


def poisson_bootstrap(df: DataFrame, group: str, diff: str, key: str, draws: int = 1000, scale: float = 1.0) -> DataFrame:
    """group, n, mean, low, high, p of paired differences, as ``stats.bootstrap`` has them, by Poisson weights.

    A row, named by its ``key``, goes into ``draws`` sums; partial sums are what is shuffled, ``draws`` rows a group and
    task. Null differences are left out. A resample without any row counts as the mean of none, 0.
    """
    rows = df.select(F.col(group).alias("g"), F.col(diff).cast("double").alias("d"), F.col(key).alias("key")).filter("d IS NOT NULL")
    quads = rows.select("g", "d", "key", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 4))).alias("quad"))
    digest = quads.withColumn("h", F.md5(F.concat_ws(":", F.col("key").cast("string"), F.col("quad").cast("string")).cast("binary")))
    at = lambda i: copies(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("double") / 2**32)
    sums = digest.groupBy("g", "quad").agg(*(F.sum(at(i)).alias(f"w{i}") for i in range(4)), *(F.sum(at(i) * F.col("d")).alias(f"s{i}") for i in range(4)))
    each = F.explode(F.array(*(F.struct((4 * F.col("quad") + i).alias("draw"), F.coalesce(F.try_divide(f"s{i}", f"w{i}"), F.lit(0.0)).alias("x")) for i in range(4))))
    means = sums.select("g", each.alias("m")).filter(F.col("m.draw") < draws)
    part = lambda c: F.count_if(c) / F.lit(draws)
    x = F.col("m.x")
    p = F.greatest(F.least(2 * F.least(part(x >= 0), part(x <= 0)), F.lit(1.0)), F.lit(1.0 / draws))
    tests = means.groupBy("g").agg(F.sort_array(F.collect_list(x)).alias("xs"), p.alias("p"))  # ``draws`` numbers
    known = rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("d").alias("mean"))
    out = df.select(F.col(group).alias("g0")).distinct().join(known.join(tests, "g"), F.col("g0").eqNullSafe(F.col("g")), "left")
    cut = lambda q: F.coalesce(scale * F.get("xs", F.lit(int(q * draws))), F.lit(0.0))
    return out.select(F.col("g0").alias(group), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(scale * F.col("mean"), F.lit(0.0)).alias("mean"), cut(0.025).alias("low"), cut(0.975).alias("high"), F.coalesce("p", F.lit(1.0)).alias("p"))
