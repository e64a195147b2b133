"""Orders over whole tables without a window in one task: running sums, average ranks, inversions.

Values are counted first, so that ties are one row. An order is cut into cells at approximate percentiles, which are
collected (so an action runs when the plan is made); a cell is summed by itself, and the cells' own sums, a row for
each, are added in front. A value at a cut has a cell of its own, so a value that many rows share crowds no other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a cell gets, about, and the most cells.
CELL_ROWS, CELLS = 200_000, 10_000


def cell_of(rows: DataFrame, by: str, cells: int) -> Column:
    """The cell of a number: cells follow the order of numbers; every second one holds a single value. Null comes first."""
    cuts = rows.agg(F.percentile_approx(F.col(by).cast("double"), [i / cells for i in range(1, cells)] or [0.5], 10 * cells)).first()[0] or []
    marks = F.lit([float(x) for x in sorted(set(cuts))]).cast("array<double>")
    value = F.col(by).cast("double")
    below = F.size(F.filter(marks, lambda m: m < value)) + F.size(F.filter(marks, lambda m: m <= value))
    return F.coalesce(below, F.lit(0))


def how_many_cells(rows: DataFrame) -> int:
    return min(CELLS, rows.count() // CELL_ROWS + 2)


def running(rows: DataFrame, keys: list[str], order: str, sums: list[str], falling: bool = False, cells: int | None = None) -> DataFrame:
    """Adds before_<c> (the sum of c over rows of the same keys that come earlier) and all_<c> (over all of them).

    ``order``, a number, is different in each row of the same keys. No window holds more than a cell or the cells of one key.
    """
    rows = rows.withColumn("_cell", cell_of(rows, order, cells or how_many_cells(rows)))
    way = lambda c: F.col(c).desc() if falling else F.col(c).asc()
    own = Window.partitionBy(*keys, "_cell").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_cell").agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    key = keys or [F.lit(0)]  # without keys: a row for each cell
    front = Window.partitionBy(*key).orderBy(way("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*key)
    names = {k: f"_{i}_key" for i, k in enumerate([*keys, "_cell"])}
    totals = totals.select(
        *(F.col(k).alias(n) for k, n in names.items()),
        *(F.coalesce(F.sum(f"_t_{c}").over(front), F.lit(0)).alias(f"_f_{c}") for c in sums),
        *(F.sum(f"_t_{c}").over(every).alias(f"all_{c}") for c in sums),
    )
    rows = rows.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(own), F.lit(0)) for c in sums})
    joined = rows.join(totals, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return joined.withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"_f_{c}") for c in sums}).drop("_cell", *names.values(), *(f"_f_{c}" for c in sums))


def inverted(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> int:
    """The sum of n[i] * n[j] over pairs with x[i] < x[j] and y[i] > y[j], by merge sort in n log n."""
    first = np.lexsort((y, x))
    place = np.empty(len(first), np.int64)
    place[first] = np.arange(len(first))
    # By falling y; of equal ones by falling x: whoever comes earlier at a smaller place is inverted with the later one.
    order = np.lexsort((x, y))[::-1]
    place, n, total = place[order], n[order].astype(np.int64), 0
    for bit in range(max(1, len(place) - 1).bit_length()):
        group = place >> (bit + 1)
        by = np.argsort(group, kind="stable")
        upper, own, weight = (place[by] >> bit) & 1 == 1, group[by], n[by]
        lower = np.where(upper, 0, weight)
        sums = np.cumsum(lower) - lower
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
        sums -= np.repeat(sums[starts], np.diff(np.r_[starts, len(own)]))
        some, weight = sums[upper], weight[upper]
        # Whole numbers of any size where 64 bits might not do.
        wide = len(some) and int(some.max()) * int(weight.max()) * len(some) >= 1 << 62
        total += int((some.astype(object) * weight if wide else some * weight).sum())
    return total


#: The most cells of an order in counting inversions: those of two orders are at most (2 * GRID)**2 rows.
GRID = 1000


def inversions(points: DataFrame, keys: list[str], cells: int | None = None) -> DataFrame:
    """keys and inversions: the number of pairs of rows with x rising and y falling.

    points: keys, x, y (numbers without nulls) and n, each (keys, x, y) once. Both orders are cut into cells. Pairs in
    different cells of both orders are inverted as their cells are: these, a table of bounded size, are merge-counted as
    points. Pairs in one cell of x, or of y, are merge-counted inside it, and those in one cell of both taken off once;
    a cell of a single value has none. A task gets a cell, about a GRID-th of the rows, or one key's table of cells.
    """
    many = min(GRID, cells or how_many_cells(points))
    rows = points.withColumns({"_a": cell_of(points, "x", many).cast("double"), "_b": cell_of(points, "y", many).cast("double")})
    schema = ", ".join([*(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys), "low long, high long"])

    def counted(part: pd.DataFrame) -> pd.DataFrame:
        found = inverted(part["x"].to_numpy(), part["y"].to_numpy(), part["n"].to_numpy())
        return pd.DataFrame({**{k: part[k].iloc[:1] for k in keys}, "low": [found & 0xFFFFFFFF], "high": [found >> 32]})

    def of(part: DataFrame, group: list[str], sign: int) -> DataFrame:
        got = part.groupBy(*group).applyInPandas(counted, schema)
        whole = F.col("high").cast("decimal(28,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("low")
        return got.select(*keys, (sign * whole).cast("decimal(38,0)").alias("inversions"))

    def inside(*cell: str) -> DataFrame:
        # Odd cells hold one value: nothing in them is inverted.
        return rows.filter(F.greatest(*(F.col(c) % 2 for c in (*cell, cell[0]))) == 0).select(*keys, *cell, "x", "y", "n")

    table = rows.groupBy(*keys, F.col("_a").alias("x"), F.col("_b").alias("y")).agg(F.sum("n").alias("n"))
    both = ["_a", "_b"]
    parts = of(table, keys, 1).unionByName(of(inside("_a"), [*keys, "_a"], 1)).unionByName(of(inside("_b"), [*keys, "_b"], 1)).unionByName(of(inside(*both), [*keys, *both], -1))
    return parts.groupBy(*keys).agg(F.sum("inversions").alias("inversions"))


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and median, exact: values are counted, and running counts find the middle one, or the two whose mean it is.

    No task holds the values of a key. Nulls are left out; a key without values has no row (without keys: one row, null).
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    at = running(counts, keys, "_v", ["_n"])
    low, high = F.floor((F.col("all__n") + 1) / 2), F.floor(F.col("all__n") / 2) + 1
    middle = at.filter((F.col("before__n") < high) & (F.col("before__n") + F.col("_n") >= low))
    return middle.groupBy(*keys).agg(((F.min("_v") + F.max("_v")) / 2).alias("median"))
