"""Connected components of a table of links, by alternating large and small stars.

Each round gives every node's larger neighbours, then every node's smaller ones, to its smallest
neighbour; a link without one of its ends is none. Links never multiply, and the number of rounds is about the logarithm of the longest
path. Rounds are written to the shared folder. No link leaves the executors: a round ends with
one row of counts. A hub's links meet only in partial aggregates and in a broadcast join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import durable

ROUNDS = 60
#: Links for each task: rounds over few links don't need many tasks and files.
TASK_LINKS = 50_000
#: A node with over about a HUBS-th of all links is a hub: its links aren't brought to one task.
HUBS = 1000


def _star(links: DataFrame, large: bool, tasks: int, hub: int | None) -> DataFrame:
    """links: u, v with u > v, each once. ``hub``: links above which a node's smallest one is broadcast; None: all are."""
    ends = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = ends.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    rows = ends.filter("v > u") if large else ends
    if hub is None:
        out = rows.join(F.broadcast(least.drop("n")), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        rows = rows.join(F.broadcast(least.filter(F.col("n") > hub).select("u", F.col("m").alias("h"))), "u", "left")
        done = rows.filter("h IS NOT NULL").select(F.col("v").alias("a"), F.col("h").alias("b"))
        out = rows.filter("h IS NULL").select("u", "v").join(least.filter(F.col("n") <= hub), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(done)
    if not large:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = out.filter("a != b").coalesce(tasks)
    return out.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().coalesce(tasks)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for every node that has a link, the smallest node itself included."""
    links = durable(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct())
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(links)
    for _ in range(ROUNDS if before[0] else 0):
        tasks = before[0] // TASK_LINKS + 1
        # Links are few, or else each hub has over a HUBS-th of them (of all, rounded up to a power of two):
        # in both cases what is broadcast has a proven bound, 2 * TASK_LINKS or 4 * HUBS rows.
        hub = None if before[0] <= TASK_LINKS else (1 << before[0].bit_length()) // (2 * HUBS)
        links = durable(_star(_star(links.coalesce(tasks), True, tasks, hub), False, tasks, hub))
        now = mark(links)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"links still change after {ROUNDS} rounds")
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
