"""Exact nearest neighbours among the rows that a query may see: an index of cells, with access tested before products.

Every row lies in the cell of its nearest centre; centres are fitted on a bounded sample, so that the index is whole and
exact whatever they are. A cell knows its radius (an angle), its rows and the union of their access bits. Queries meet
the nearest cells first; then only cells that can hold something better than the k-th best so far, by the triangle
inequality of angles. Access is a bitmap of groups, taken from a table at query time: a change of rights changes no index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import io
from .leaders import _matrix
from .retrieval import top, unit

#: Rows that centres are fitted on: those with the smallest hash of their id. Centres at most; rounds of fitting.
SAMPLE, CENTRES, ROUNDS = 20_000, 1024, 8
#: Rows of a cell and queries that meet in one task at most, about.
BLOCK, QUERIES = 20_000, 2048
#: Cells that a query meets first. Slack for rounding, in radians.
FIRST, SLACK = 4, 1e-6


def _some(vec: str) -> Column:
    """Neither null nor zero."""
    return F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))


def fit(vectors: DataFrame, vid: str, vec: str, sample: int = SAMPLE, centres: int | None = None) -> np.ndarray:
    """Unit centres from a bounded sample, by rounds of nearest centre and mean; about the root of the sample's size unless told."""
    rows = vectors.filter(_some(vec)).orderBy(F.xxhash64(vid), vid).limit(sample).select(unit(F.col(vec)).alias("v")).toPandas()
    if rows.empty:
        return np.zeros((0, 0))
    x = _matrix(rows["v"])
    k = min(centres or max(1, int(math.sqrt(len(x)))), CENTRES, len(x))
    c = x[:: max(1, len(x) // k)][:k].copy()
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        c[size > 0] = sums[size > 0] / size[size > 0, None]
    return c


def index(vectors: DataFrame, centres: np.ndarray, vid: str = "vec_id", vec: str = "embedding", access: str = "access") -> DataFrame:
    """doc, v (unit), access, cell, angle (from the cell's centre) for every row. Null and zero vectors are left out."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)
    rows = vectors.filter(_some(vec)).select(F.col(vid).cast("long").alias("doc"), unit(F.col(vec)).alias("v"), F.col(access).cast("long").alias("access"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                near = _matrix(part["v"]) @ sent.value.T
                own = near.argmax(axis=1)
                yield part.assign(cell=own.astype(np.int32), angle=np.arccos(np.clip(near[np.arange(len(part)), own], -1, 1)))

    return rows.mapInPandas(run, "doc long, v array<double>, access long, cell int, angle double")


def permitted(table: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, qid: str = "qid", vec: str = "v", clearance: str = "clearance") -> tuple[DataFrame, DataFrame]:
    """(qid, doc, score, rank: the exact k nearest that the query may see; qid, multiplied: products that it took).

    table: ``index``'s. queries: qid, a vector and the bits of its groups; a row is seen if they share one.
    Ties go to the smaller doc. Queries, a stated set, meet cells in blocks.
    """
    spark = table.sparkSession
    # A row for each centre, of which there are CENTRES at most.
    stats = table.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"), F.bit_or("access").alias("access")).toPandas().sort_values("cell")
    sent = spark.sparkContext.broadcast((centres, stats["cell"].to_numpy(), stats["radius"].to_numpy(), stats["access"].to_numpy(np.int64), (stats["n"].to_numpy() // BLOCK + 1).astype(np.int32)))
    asked = queries.select(F.col(qid).alias("qid"), unit(F.col(vec)).alias("q"), F.col(clearance).cast("long").alias("clearance"))

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each query the cells with rows it may see: the best score that they can hold, and their place by it."""
        c, cell, radius, bits, blocks = sent.value
        for part in batches:
            for q, v, own in zip(part["qid"], part["q"], part["clearance"], strict=True):
                may = (bits & own) != 0
                angle = np.arccos(np.clip(c[cell[may]] @ np.asarray(v, float), -1, 1))
                bound = np.cos(np.maximum(0, angle - radius[may] - SLACK))
                order = np.argsort(angle, kind="stable")
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order))
                yield pd.DataFrame({"qid": q, "cell": cell[may].astype(np.int32), "bound": bound, "place": place, "blocks": blocks[may]})

    pairs = asked.select("qid", "q", "clearance").mapInPandas(reach, f"qid {asked.schema['qid'].dataType.simpleString()}, cell int, bound double, place int, blocks int")
    dealt = F.pmod(F.xxhash64("doc"), F.floor(F.col("n") / BLOCK) + 1).cast("int")
    sizes = spark.createDataFrame(stats[["cell", "n"]].astype({"cell": "int32"}), "cell int, n long")  # a row for each cell
    rows = table.join(F.broadcast(sizes), "cell").withColumn("block", dealt).select("cell", "block", "doc", "v", "access")

    def meet(pairs: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("qid"), F.lit(max(1, queries.count() // QUERIES + 1))).cast("int")
        met = pairs.join(asked, "qid").withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        parts = met.select("cell", "block", F.col("part").alias("p")).distinct()
        own = rows.join(parts, ["cell", "block"]).withColumnRenamed("p", "part")

        def look(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(docs) and len(asked):
                v, ids, bits = _matrix(docs["v"]), docs["doc"].to_numpy(), docs["access"].to_numpy()
                for q, vector, clear in zip(asked["qid"], asked["q"], asked["clearance"], strict=True):
                    may = np.flatnonzero(bits & clear)
                    score = np.round(v[may] @ np.asarray(vector, float), 12)
                    best = np.lexsort((ids[may], -np.round(score, 9)))[:k]
                    out.append(pd.DataFrame({"qid": q, "doc": pd.array(ids[may][best], dtype="Int64"), "score": score[best]}))
                    out.append(pd.DataFrame({"qid": [q], "doc": pd.array([None], dtype="Int64"), "score": [float(len(may))]}))
            return pd.concat(out) if out else pd.DataFrame({"qid": [], "doc": [], "score": []})

        keys = ["cell", "block", "part"]
        schema = f"qid {asked.schema['qid'].dataType.simpleString()}, doc long, score double"
        return own.groupBy(*keys).cogroup(met.select(*keys, "qid", "q", "clearance").groupBy(*keys)).applyInPandas(look, schema)

    first = io.kept(meet(pairs.filter(F.col("place") < FIRST)), "cells")  # k rows for each of a query's first cells
    found = top(first.filter("doc IS NOT NULL"), k).groupBy("qid").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    # A cell that can't hold what is as good as the k-th best isn't gone into.
    rest = pairs.filter(F.col("place") >= FIRST).join(found, "qid", "left")
    rest = rest.filter(F.col("n").isNull() | (F.col("n") < k) | (F.col("bound") >= F.col("least") - SLACK)).drop("least", "n")
    every = first.unionAll(meet(rest))
    return top(every.filter("doc IS NOT NULL"), k), every.filter("doc IS NULL").groupBy("qid").agg(F.sum("score").cast("long").alias("multiplied"))
