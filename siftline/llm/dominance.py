"""Dominance counting: weighted inversions by an external multiway merge sort.

A row is above another if its slot is smaller and its level strictly larger. Rows of one slot and level have one
answer, so they meet first as a point with their number and their weight. Points in slot order are cut into runs of
RUN; a run's own inversions are counted by a merge sort in memory. Then FAN neighbouring runs at a time are merged by
falling level: a point is credited with what the earlier runs of its merge have handed out already, which is all
that is higher there. After log(runs) / log(FAN) rounds each point has met all that is above it.

A merge is no task: its points are dealt by ranges of the level, and a task goes through a range in blocks of
bounded size, with a sum for each run. What higher ranges of the same merge hold of each run is added from a table of
(merge, run, range) sums; its running sums are taken in steps of STEP ranges, so that no window has more rows.

Ties: inside a slot group points lie by rising level, so a slot that is cut into several runs never credits
itself; in a merge, points of equal level come by falling slot, so they credit nobody either. A slot, or a level, may
thus hold any share of all rows and still be cut anywhere. The answers meet the rows again by slot and level; points
of over a HOT-th of all rows are broadcast for that (HOT at most), whatever the number of rows.

Rows with a null slot or level are above none, and their own counts are null. Empty texts have no meaning here; a
total that is not finite counts as null. Ids are never looked at: null and repeated ones get their own rows. An
empty table gives an empty result; other columns are ignored. Tables between rounds lie in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import durable, quoted, ship

#: Points of a run; bits of the number of runs that are merged at a time.
RUN_BITS, FAN_BITS = 16, 8
RUN, FAN = 1 << RUN_BITS, 1 << FAN_BITS
#: Points that a task gets, unless that were more than TASKS tasks.
TASK_POINTS, TASKS = 1 << 18, 20_000
#: Ranges whose sums one step of a running sum adds up.
STEP_BITS = 8
#: At most so many points are joined by broadcast.
HOT = 1000
_POINT = "slot bigint, level bigint, n bigint, w bigint, above_n bigint, above_w bigint, run bigint"


def credits(place: np.ndarray, amounts: np.ndarray, bits: int) -> np.ndarray:
    """For each entry the sums of ``amounts`` over entries before it with a smaller place (under 2**bits).

    A merge sort by halves of the places: where two halves are merged, entries of the upper one are credited with
    what came before from the lower one.
    """
    out = np.zeros_like(amounts)
    place = place.astype(np.uint16)
    for b in range(bits):
        group = place >> b
        order = np.argsort(group >> 1, kind="stable")
        upper = (group[order] & 1).astype(bool)
        given = amounts[order]
        given[upper] = 0
        sums = np.cumsum(given, axis=0) - given
        merge = group[order] >> 1
        starts = np.flatnonzero(np.r_[True, merge[1:] != merge[:-1]]) if len(merge) else np.zeros(0, int)
        sums -= np.repeat(sums[starts], np.diff(np.r_[starts, len(merge)]), axis=0)
        out[order[upper]] += sums[upper]
    return out


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[dict[str, np.ndarray]]:
    """The batches' columns, without nulls, as arrays of ``rows`` rows each."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == rows:
                yield _arrays(held)
                held, n = [], 0
    if held:
        yield _arrays(held)


def _arrays(held: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(held)
    return {c: table[c].to_numpy() for c in table.column_names}


def _sorted_runs(points: DataFrame, tasks: int, rows: int = RUN) -> DataFrame:
    """The points in slot order, cut into runs, with what a run has above each of its points; run is task * 2**32 + number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for k, x in enumerate(blocks(batches, rows)):
            falling = np.lexsort((x["slot"], x["level"]))[::-1]
            above = np.empty((len(falling), 2), np.int64)
            above[falling] = credits(falling, np.stack([x["n"], x["w"]], 1)[falling], RUN_BITS)
            columns = [x["slot"], x["level"], x["n"], x["w"], above[:, 0], above[:, 1], np.full(len(falling), first + k)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["slot", "level", "n", "w", "above_n", "above_w", "run"])

    return points.repartitionByRange(tasks, "slot", "level").sortWithinPartitions("slot", "level").mapInArrow(run, _POINT)


def _merged(runs: DataFrame, tasks: int, done: int, rows: int = RUN) -> DataFrame:
    """One round: FAN neighbours of the runs (numbers without their last ``done`` bits) are merged; each range of a merge by itself.

    Adds part (the range), node (the merge) and child (the run in it); above_n, above_w lack the other ranges.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, given = TaskContext.get().partitionId(), None, np.zeros((FAN, 2), np.int64)
        for x in blocks(batches, rows):
            amounts, above = np.stack([x["n"], x["w"]], 1), np.stack([x["above_n"], x["above_w"]], 1)
            starts = np.flatnonzero(np.r_[True, x["node"][1:] != x["node"][:-1]])
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(amounts)], strict=True):
                if x["node"][i] != last:
                    last, given = x["node"][i], np.zeros((FAN, 2), np.int64)
                child = x["child"][i:j]
                above[i:j] += (np.cumsum(given, axis=0) - given)[child] + credits(child, amounts[i:j], FAN_BITS)
                np.add.at(given, child, amounts[i:j])
            columns = [x["slot"], x["level"], x["n"], x["w"], above[:, 0], above[:, 1], x["run"], np.full(len(above), part), x["node"], x["child"]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["slot", "level", "n", "w", "above_n", "above_w", "run", "part", "node", "child"])

    own = F.shiftright("run", done)
    placed = runs.withColumns({"node": F.shiftright(own, FAN_BITS), "child": own.bitwiseAND(F.lit(FAN - 1))})
    order = ["node", F.col("level").desc(), F.col("slot").desc()]
    return placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(merge, f"{_POINT}, part bigint, node bigint, child bigint")


def _before(sums: DataFrame, parts: int) -> DataFrame:
    """node, child, part and the sums n, w over the node's earlier parts, by steps of 2**STEP_BITS parts."""
    out, low = sums.select("node", "child", "part", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("w")), 0
    while low == 0 or parts >> low:
        level = sums.groupBy("node", "child", F.shiftright("part", low).alias("at")).agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
        step = Window.partitionBy("node", "child", F.shiftright("at", STEP_BITS)).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        level = level.select("node", "child", "at", F.coalesce(F.sum("n").over(step), F.lit(0)).alias("n2"), F.coalesce(F.sum("w").over(step), F.lit(0)).alias("w2"))
        out = out.withColumn("at", F.shiftright("part", low)).join(level.hint("merge"), ["node", "child", "at"])
        out = out.select("node", "child", "part", (F.col("n") + F.col("n2")).alias("n"), (F.col("w") + F.col("w2")).alias("w"))
        low += STEP_BITS
    return out


def _with_higher_ranges(merged: DataFrame) -> DataFrame:
    """The points after a round, with the higher ranges' part of the earlier runs added. merged: durable."""
    cells = merged.groupBy("node", "part", "child").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    # Each range of a merge gets a row for each of its FAN runs: what earlier runs hold there.
    every = cells.select("node", "part").distinct().select("node", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FAN - 1).cast("long"))).alias("child"))
    earlier = Window.partitionBy("node", "part").orderBy("child").rowsBetween(Window.unboundedPreceding, -1)
    sums = every.join(cells.hint("merge"), ["node", "part", "child"], "left")
    sums = sums.select("node", "part", "child", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("n", "w")))
    parts = merged.agg(F.max("part")).first()[0]
    higher = _before(durable(sums), parts).select("node", "part", "child", F.col("n").alias("hn"), F.col("w").alias("hw"))
    joined = merged.join(higher.hint("merge"), ["node", "part", "child"])
    return joined.select("slot", "level", "n", "w", (F.col("above_n") + F.col("hn")).alias("above_n"), (F.col("above_w") + F.col("hw")).alias("above_w"), "run")


def points_above(points: DataFrame, run: int = RUN, task_points: int = TASK_POINTS) -> DataFrame:
    """The points (slot, level, n, w: each slot and level once, no nulls) with above_n, above_w, the sums over points above them; durable."""
    points = durable(points)
    tasks = min(max(1, -(-points.count() // task_points)), TASKS)
    runs = durable(_sorted_runs(points, tasks, run))
    # Numbers without gaps between the bits: one row of two maxima.
    most = runs.agg(F.max(F.shiftright("run", 32)), F.max(F.col("run").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
    if most[0] is None:
        return runs
    low = int(most[1]).bit_length()
    bits, done = low + int(most[0]).bit_length(), 0
    runs = runs.withColumn("run", F.shiftleft(F.shiftright("run", 32), low).bitwiseOR(F.col("run").bitwiseAND(F.lit(0xFFFFFFFF))))
    while done < bits:
        runs = durable(_with_higher_ranges(durable(_merged(runs, tasks, done, run))))
        done += FAN_BITS
    return runs


def rows_above(rows: DataFrame, id_col: str, slot: Column, level: Column, weight: Column, run: int = RUN, task_points: int = TASK_POINTS) -> DataFrame:
    """id, slot, level, n_sales (rows above it), n_rows (the sum of their weights) for every row."""
    ship(rows.sparkSession)
    table = rows.select(F.col(quoted(id_col)).alias("id"), slot.cast("long").alias("slot"), level.cast("long").alias("level"), weight.cast("long").alias("weight"))
    known = F.col("slot").isNotNull() & F.col("level").isNotNull()
    points = table.filter(known).groupBy("slot", "level").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    found = points_above(points, run, task_points).select("slot", "level", "n", F.col("above_n").alias("n_sales"), F.col("above_w").alias("n_rows"))
    many = (found.agg(F.sum("n")).first()[0] or 0) // HOT
    # Less than HOT points have over a HOT-th of all rows.
    hot = F.broadcast(found.filter(F.col("n") > many).drop("n")) if many > RUN else None
    rest = table.filter(known)
    out = table.filter(~known).select("id", "slot", "level", F.lit(None).cast("long").alias("n_sales"), F.lit(None).cast("long").alias("n_rows"))
    if hot is not None:
        rest = rest.join(hot, ["slot", "level"], "left")
        out = out.unionByName(rest.filter("n_sales IS NOT NULL").drop("weight"))
        rest, found = rest.filter("n_sales IS NULL").drop("n_sales", "n_rows"), found.filter(F.col("n") <= many)
    return out.unionByName(rest.drop("weight").join(found.drop("n").hint("merge"), ["slot", "level"]))


def minute_of(at: str, kind: str, width: int = 60) -> Column:
    """floor(whole seconds since 1970 / width), times taken as UTC whatever the session's zone."""
    c = F.col(quoted(at))
    if kind == "timestamp":
        return F.floor(F.unix_seconds(c) / width)
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return F.floor((days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.floor(F.second(c))) / width)


def sales_above(sales: DataFrame, width: int = 60, step: int = 1, repeats: int = 5) -> DataFrame:
    """sale_id, slot, level, n_sales, n_rows: sales sold in an earlier slot of ``width`` seconds at a higher level.

    A level is the total in cents over ``step``, rounded down; a sale stands for 1 + crc32(sale_id) mod ``repeats`` rows.
    """
    total = F.col("total").cast("double")
    finite = total.isNotNull() & ~F.isnan(total) & (F.abs(total) != float("inf"))
    level = F.when(finite, F.floor(F.floor(100.0 * total + 0.5).cast("double") / step))
    weight = 1 + F.pmod(F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary")), F.lit(repeats))
    slot = minute_of("sold_at", dict(sales.dtypes)["sold_at"], width)
    return rows_above(sales, "sale_id", slot, level, weight).withColumnRenamed("id", "sale_id")


#: The unsigned crc32 of a number's digits, and then all pairs of sales: for small tables.
ORACLE = """
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
s AS (
  SELECT sale_id, CAST(floor(floor(epoch(sold_at)) / 60) AS BIGINT) AS slot, CAST(floor(100 * total + 0.5) AS BIGINT) AS level,
         1 + xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(sale_id AS VARCHAR), ''), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t.t[(xor(c, b) & 255) + 1])), 4294967295) % 5 AS w
  FROM sales, t),
p AS (SELECT slot, level, count(*) AS n, sum(w) AS w FROM s WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY ALL),
a AS (SELECT p.slot, p.level, sum(q.n) AS n, sum(q.w) AS w FROM p JOIN p q ON q.slot < p.slot AND q.level > p.level GROUP BY ALL)
SELECT sale_id, s.slot, s.level,
       CASE WHEN s.slot IS NOT NULL AND s.level IS NOT NULL THEN CAST(coalesce(a.n, 0) AS BIGINT) END AS n_sales,
       CASE WHEN s.slot IS NOT NULL AND s.level IS NOT NULL THEN CAST(coalesce(a.w, 0) AS BIGINT) END AS n_rows
FROM s LEFT JOIN a ON s.slot = a.slot AND s.level = a.level
"""
