"""Append-only run logs: latest rows, resume, identity guard, summaries, paired outcomes, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR = "error"


def latest(log: DataFrame, keys: list[str], seq: str, drop_errors: bool = True) -> DataFrame:
    """The last row of each key; errors don't count unless asked for."""
    rows = log.filter(~F.coalesce(F.col("done_reason").startswith(ERROR), F.lit(False))) if drop_errors else log
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))).filter("_i = 1").drop("_i")


def unrecovered(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Keys whose last row, errors included, is an error."""
    last = log.groupBy(*keys).agg(F.max_by("done_reason", seq).alias("done_reason"))
    return last.filter(F.col("done_reason").startswith(ERROR))


def to_do(tasks: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a row that isn't an error."""
    return tasks.join(log.filter(~F.col("done_reason").startswith(ERROR)).select(*keys).distinct(), keys, "left_anti")


def disagreeing(log: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose stored value isn't the current one: must be none before a resume."""
    now = current.select(key, F.col(value).alias("_now"))
    return log.join(now, key).filter(~F.col(value).eqNullSafe(F.col("_now"))).drop("_now")


#: Cells that an order is cut into for ranking.
CELLS = 1000


def _cells(rows: DataFrame, by: str, cells: int = CELLS) -> Column:
    """A number's cell: cells follow the order of numbers and hold about equally many rows each. Null comes first."""
    cuts = rows.agg(F.percentile_approx(F.col(by).cast("double"), [i / cells for i in range(1, cells)], 10 * cells)).first()[0] or []
    marks = F.lit([float(x) for x in sorted(set(cuts))]).cast("array<double>")
    return F.coalesce(F.size(F.filter(marks, lambda m: m < F.col(by).cast("double"))), F.lit(0))


def ranked(rows: DataFrame, strata: list[str], by: list[str], cells: list[str]) -> DataFrame:
    """Adds _p, the row's place in its stratum from 0, and _n, the stratum's rows.

    Rows are ranked inside cells (columns that follow the order) and cells are added up: no task gets a whole stratum.
    """
    key = [*strata, *cells]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_k"))
    of = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))  # a row for each cell
    before = of.orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_b", F.coalesce(F.sum("_k").over(before), F.lit(0))).withColumn("_n", F.sum("_k").over(of))
    names = {k: f"_{i}_key" for i, k in enumerate(key)}
    sizes = sizes.select(*(F.col(k).alias(n) for k, n in names.items()), "_b", "_n")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*by)) - 1
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    joined = rows.withColumn("_i", place).join(sizes, same).withColumn("_p", F.col("_b") + F.col("_i"))
    return joined.drop("_i", "_b", *names.values())


def _every(at: DataFrame, want: Column, columns: list[str]) -> DataFrame:
    step = F.greatest(F.floor(F.col("_n") / want), F.lit(1))
    return at.filter((F.col("_p") % step == 0) & (F.floor(F.col("_p") / step) < want)).select(*columns)


def systematic(rows: DataFrame, want: int, strata: list[str], order: str) -> DataFrame:
    """Every step-th row of each stratum, ``want`` at most. ``order``: a number."""
    at = ranked(rows.withColumn("_c", _cells(rows, order)), strata, [order], ["_c"])
    return _every(at, F.lit(want), rows.columns)


def proportional(rows: DataFrame, want: int, stratum: str, order: str) -> DataFrame:
    """About ``want`` rows, each stratum's share of them, one at least, evenly spaced; the first ``want`` in order (a number)."""
    at = ranked(rows.withColumn("_c", _cells(rows, order)), [stratum], [order], ["_c"])
    total = rows.agg(F.count("*").alias("_all"))  # one row
    share = F.greatest(F.bround(want * F.col("_n") / F.col("_all")), F.lit(1)).cast("long")
    return _every(at.crossJoin(F.broadcast(total)), share, rows.columns).orderBy(order).limit(want)


def strided(rows: DataFrame, score: str, order: str, want: int, cells: int = 10_000) -> DataFrame:
    """Every step-th row in the order of a score between 0 and 1, ``want`` at most; ties go by ``order`` (a number).

    A cell of the score whose rows all tie is cut into cells of ``order``.
    """
    own = rows.withColumn("_c", F.coalesce(F.least(F.floor(F.col(score) * cells), F.lit(cells - 1)), F.lit(-1)))
    tied = own.groupBy(F.col("_c").alias("_t")).agg((F.min(score) == F.max(score)).alias("_one"))  # a row for each cell
    own = own.join(tied, F.col("_c") == F.col("_t")).withColumn("_d", F.when(F.col("_one"), _cells(rows, order)).otherwise(0))
    return _every(ranked(own, [], [score, order], ["_c", "_d"]), F.lit(want), rows.columns)


def fates(base_abstained: Column, abstained: Column, contained: Column) -> list[Column]:
    """recovered, exposed, still_abstains: what became of the base arm's abstentions."""
    n = lambda c: F.sum((base_abstained & c).cast("long"))
    return [n(~abstained & contained).alias("recovered"), n(~abstained & ~contained).alias("exposed"), n(abstained).alias("still_abstains")]


def completeness(log: DataFrame, expected: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``by``, expected, found, missing: expected keys with and without a row."""
    have = log.select(*keys).distinct().withColumn("_f", F.lit(1))
    rows = expected.select(*keys).distinct().join(have, keys, "left")
    return rows.groupBy(by).agg(F.count("*").alias("expected"), F.count("_f").alias("found"), (F.count("*") - F.count("_f")).alias("missing"))


def discordance(a: Column, b: Column) -> list[Column]:
    """n, b, c, delta_pp of paired outcomes."""
    only = lambda x, y: F.sum((x & ~y).cast("long"))
    return [F.count("*").alias("n"), only(a, b).alias("b"), only(b, a).alias("c"), F.round(100 * (only(a, b) - only(b, a)) / F.count("*"), 4).alias("delta_pp")]
