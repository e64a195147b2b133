"""Entity graphs: assembly from extractions, statistics, one-hop expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lowered
from .ordered import medians


def normalised(mentions: DataFrame) -> DataFrame:
    """Mentions under their normalised names; blank names are none."""
    return mentions.withColumn("name", lowered(F.col("name"))).filter("name != ''")


def vertices(mentions: DataFrame) -> DataFrame:
    """name, type, chunks, mentions, descriptions from (chunk, seq, name, type, description).

    Names are normalised; the type is the most frequent one, of ties the first seen; descriptions
    are the first five that aren't blank (at the same place the lesser first).
    """
    rows = normalised(mentions).withColumn("type", F.coalesce(F.expr("nullif(type, '')"), F.lit("OTHER")))
    base = rows.groupBy("name").agg(F.count_distinct("chunk").alias("chunks"), F.count("*").alias("mentions"))
    kinds = rows.groupBy("name", "type").agg(F.count("*").alias("n"), F.min(F.struct("chunk", "seq")).alias("seen"))
    best = kinds.withColumn("i", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "seen"))).filter("i = 1").select("name", "type")
    # Ranked and cut before they are gathered, so that a name holds five texts at most.
    told = rows.filter("coalesce(description, '') != ''").withColumn("i", F.row_number().over(Window.partitionBy("name").orderBy("chunk", "seq", "description"))).filter("i <= 5")
    told = told.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "description"))), lambda x: x["description"]).alias("descriptions"))
    return base.join(best, "name").join(told, "name", "left").withColumn("descriptions", F.coalesce("descriptions", F.array().cast("array<string>")))


def edges(relations: DataFrame) -> DataFrame:
    """a, b, weight, count: undirected; blanks and self-loops dropped, no or zero strength counts 1."""
    s, t = lowered(F.col("source")), lowered(F.col("target"))
    rows = relations.select(s.alias("s"), t.alias("t"), F.coalesce(F.expr("nullif(strength, 0)"), F.lit(1)).cast("long").alias("w"))
    rows = rows.filter("s != '' AND t != '' AND s != t")
    return rows.groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(F.sum("w").alias("weight"), F.count("*").alias("count"))


def real_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are vertices."""
    names = nodes.select("name")
    return links.join(names.withColumnRenamed("name", "a"), "a", "left_semi").join(names.withColumnRenamed("name", "b"), "b", "left_semi")


def both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionAll(links.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def stats(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: nodes, edges, phantom, degree_mean, degree_median, isolated."""
    kept = real_edges(links, nodes)
    degree = both_ways(kept).groupBy("src").agg(F.count("*").alias("d"))
    return (
        nodes.agg(F.count("*").alias("nodes"))
        .crossJoin(kept.agg(F.count("*").alias("edges")))
        .crossJoin(links.agg(F.count("*").alias("all_edges")))
        .crossJoin(degree.agg(F.coalesce(F.round(F.avg("d"), 6), F.lit(0.0)).alias("degree_mean"), F.count("*").alias("linked")))
        .crossJoin(medians(degree, [], "d").select(F.coalesce("median", F.lit(0.0)).alias("degree_median")))
        .select("nodes", "edges", (F.col("all_edges") - F.col("edges")).alias("phantom"), "degree_mean", "degree_median", (F.col("nodes") - F.col("linked")).alias("isolated"))
    )


def coverage(mentions: DataFrame, units: DataFrame) -> DataFrame:
    """One row: total, excluded, covered chunks. units: chunk, ok (whether its extraction was read); blank names cover nothing."""
    held = normalised(mentions).select("chunk").distinct()
    covered = units.filter("ok").join(held, "chunk", "left_semi").agg(F.count("*").alias("covered"))
    return units.agg(F.count("*").alias("total"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("excluded")).crossJoin(covered)  # one row each


def expand(seeds: DataFrame, links: DataFrame, damping: float = 0.5) -> DataFrame:
    """qid, name, score: seeds (qid, name, rank) at 1/rank, neighbours at a share of it; the best counts."""
    start = seeds.select("qid", "name", (1 / F.col("rank").cast("double")).alias("score"))
    out = both_ways(links)
    total = out.groupBy("src").agg(F.sum("weight").alias("total"))
    out = out.join(total, "src").select(F.col("src").alias("name"), "dst", (F.col("weight") / F.col("total")).alias("share"))
    near = start.join(out, "name").select("qid", F.col("dst").alias("name"), (damping * F.col("score") * F.col("share")).alias("score"))
    return start.unionAll(near).groupBy("qid", "name").agg(F.max("score").alias("score"))


def chunk_scores(scored: DataFrame, provenance: DataFrame) -> DataFrame:
    """qid, doc, score: the sum of a chunk's entities. provenance: name, chunk, each once."""
    return scored.join(provenance, "name").groupBy("qid", F.col("chunk").alias("doc")).agg(F.sum("score").alias("score"))
