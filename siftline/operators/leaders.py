"""Leader clusters of a stream of vectors, credit by cluster, and a semantic cache.

In stream order a vector that no leader comes close to becomes a leader, and the others belong to their nearest leader
among those before them. That is a fold, but only over vectors that no leader covers: a round finds, in parallel, the
first STEP of these in stream order, and folds them alone. The result is the sequential one at any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import top, unit

#: Uncovered vectors that a round brings to the driver; leaders that it may hold.
STEP, MOST = 1024, 100_000
SCHEMA = "id long, pos long, leader long, similarity double"


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in vectors])


def stream(rows: DataFrame, vid: str, order: str, vec: str) -> DataFrame:
    """id, pos, v: unit vectors in stream order, a whole number that is different in each row. Nulls and zero vectors are left out."""
    some = F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False)) & F.col(order).isNotNull()
    return rows.filter(some).select(F.col(vid).cast("long").alias("id"), F.col(order).cast("long").alias("pos"), unit(F.col(vec)).alias("v"))


def leaders(rows: DataFrame, radius: float, step: int = STEP, most: int = MOST) -> pd.DataFrame:
    """id, pos, v of the leaders, in stream order; rows: as ``stream`` gives them.

    ``radius``: the least cosine that a leader covers. Each round is a job (so plans that use this run jobs when they are made);
    there are about as many as leaders over ``step``. Over ``most`` leaders it gives up: the radius is too small for clusters.
    """
    spark, done = rows.sparkSession, None
    found, vectors = [], np.zeros((0, 0))
    while True:
        rest = rows if done is None else rows.filter(F.col("pos") > done)
        if len(found):
            sent = spark.sparkContext.broadcast(vectors)

            def uncovered(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
                for part in batches:
                    if len(part):
                        yield part[np.round(_matrix(part["v"]) @ sent.value.T, 9).max(axis=1) < radius]

            rest = rest.mapInPandas(uncovered, rest.schema)
        new = rest.orderBy("pos").limit(step).toPandas()
        if new.empty:
            break
        own = _matrix(new["v"])
        near, chosen = np.round(own @ own.T, 9) >= radius, []
        for i in range(len(new)):
            if not near[i, chosen].any():
                chosen.append(i)
        found.append(new.iloc[chosen])
        vectors = own[chosen] if len(found) == 1 else np.concatenate([vectors, own[chosen]])
        if len(vectors) > most:
            raise ValueError(f"over {most} leaders at a radius of {radius}")
        done = int(new["pos"].iloc[-1])
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"id": [], "pos": [], "v": []})


def nearest_leader(rows: DataFrame, lead: pd.DataFrame, radius: float, earlier: bool = True) -> DataFrame:
    """id, pos, leader, similarity: the nearest leader within the radius (of equally near ones the first); null where there is none.

    ``earlier``: only leaders that came before or with the row count, as in the stream.
    """
    spark = rows.sparkSession
    if lead.empty:
        return rows.select("id", "pos", F.lit(None).cast("long").alias("leader"), F.lit(None).cast("double").alias("similarity"))
    sent = spark.sparkContext.broadcast((lead["id"].to_numpy(np.int64), lead["pos"].to_numpy(np.int64), _matrix(lead["v"])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, at, vectors = sent.value
        for part in batches:
            if not len(part):
                continue
            near = np.round(_matrix(part["v"]) @ vectors.T, 9)
            if earlier:
                near[at[None, :] > part["pos"].to_numpy()[:, None]] = -2
            best = near.argmax(axis=1)
            score = near[np.arange(len(part)), best]
            own = pd.Series(ids[best], dtype="Int64").mask(score < radius)
            yield pd.DataFrame({"id": part["id"].to_numpy(), "pos": part["pos"].to_numpy(), "leader": own, "similarity": pd.Series(score).mask(score < radius)})

    return rows.mapInPandas(run, SCHEMA)


def clusters(rows: DataFrame, radius: float, step: int = STEP) -> DataFrame:
    """id, pos, leader, similarity for every row of the stream; a leader is its own."""
    return nearest_leader(rows, leaders(rows, radius, step), radius)


def cache(rows: DataFrame, radius: float, step: int = STEP) -> DataFrame:
    """id, pos, served (the row whose answer is given, null on a miss), similarity.

    An as-of similarity join: each row is served by the nearest earlier row in the cache within the radius. Misses take
    a place in the cache, hits take none: the cache holds the leaders.
    """
    found = clusters(rows, radius, step)
    hit = F.col("leader") != F.col("id")
    return found.select("id", "pos", F.when(hit, F.col("leader")).alias("served"), F.when(hit, F.col("similarity")).alias("similarity"))


def credit_by_cluster(shown: DataFrame, gold: DataFrame, cluster: DataFrame) -> DataFrame:
    """cluster, doc, credited, surfaced: how often a doc was shown to queries of a cluster, and how often as their gold.

    shown: qid, doc; gold: qid, doc; cluster: qid, cluster. With one cluster for all it is the global prior.
    """
    hit = gold.select("qid", "doc").distinct().withColumn("hit", F.lit(1))
    rows = shown.join(cluster, "qid").join(hit, ["qid", "doc"], "left")
    return rows.groupBy("cluster", "doc").agg(F.count("hit").alias("credited"), F.count("*").alias("surfaced"))


def boost(score: Column, credited: Column, surfaced: Column, alpha: float = 1.0, beta: float = 0.3) -> Column:
    """alpha * score + beta * ln((1 + credited) / (1 + surfaced)); nothing known counts as 0."""
    n = lambda c: 1 + F.coalesce(c, F.lit(0)).cast("double")
    return alpha * score + beta * F.ln(n(credited) / n(surfaced))


def reranked(pool: DataFrame, cluster: DataFrame, credit: DataFrame, alpha: float = 1.0, beta: float = 0.3) -> DataFrame:
    """qid, doc, score, rank: pool (qid, doc, rank) by its own order, 1 at the top, boosted by the credit of the query's cluster."""
    rows = pool.join(cluster, "qid", "left").join(credit, ["cluster", "doc"], "left")
    size = pool.groupBy("qid").agg(F.count("*").alias("_m"))
    rows = rows.join(size, "qid").withColumn("score", boost((F.col("_m") - F.col("rank") + 1) / F.col("_m"), F.col("credited"), F.col("surfaced"), alpha, beta))
    return top(rows.select("qid", "doc", "score"), 1 << 30)
