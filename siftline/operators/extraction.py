"""Entities and relations from text, and what a finer chunking loses of them.

``cooccurring`` is a rule that stands in for a model: capitalised words are entities, neighbours among
them are related. All of it is row-local but for the joins on the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lowered

#: What a model is asked to answer, as a Spark schema.
PAYLOAD = "entities array<struct<name string, type string, description string>>, relationships array<struct<source string, target string, strength int>>"
_BETWEEN = "||"


def status(done_reason: Column, response: Column) -> Column:
    """ok, truncated or unparseable."""
    read = F.from_json(response, PAYLOAD + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    bad = read.isNull() | read["_corrupt_record"].isNotNull()
    return F.when(done_reason == "length", "truncated").when(F.coalesce(bad, F.lit(True)), "unparseable").otherwise("ok")


def valid(response: Column) -> Column:
    """Whether a payload holds both lists; what can't be read doesn't."""
    read = F.from_json(response, PAYLOAD)
    return F.coalesce(read["entities"].isNotNull() & read["relationships"].isNotNull(), F.lit(False))


def names(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("([A-Z][a-z]+)")), F.lower)


def cooccurring(text: Column) -> Column:
    """Distinct undirected relations ``a||b`` of capitalised words next to each other in their order."""
    n = names(text)
    pairs = F.zip_with(F.slice(n, 1, F.greatest(F.size(n) - 1, F.lit(0))), F.slice(n, 2, F.greatest(F.size(n) - 1, F.lit(0))), lambda a, b: F.when(a != b, F.concat_ws(_BETWEEN, F.least(a, b), F.greatest(a, b))))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def ends(relation: Column) -> tuple[Column, Column]:
    parts = F.split(relation, r"\|\|")
    return parts[0], parts[1]


def relations(chunks: DataFrame) -> DataFrame:
    """doc, relation, each once, from (doc, chunk)."""
    return chunks.select("doc", F.explode(cooccurring(F.col("chunk"))).alias("relation")).distinct()


def homes(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc, name, start: chunks of the entity's own document whose normalised text holds its name."""
    body = chunks.select("doc", "start", lowered(F.col("chunk")).alias("body"))
    return entities.join(body, "doc").filter((F.col("name") != "") & F.col("body").contains(F.col("name"))).select("doc", "name", "start")


def compare(big: DataFrame, small: DataFrame, coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """doc, at_big, at_small, lost, gained, severed, unemitted, unclassified, by document.

    big, small: doc, relation, each once; coarse: doc, which names the documents; fine: doc, chunk.
    A lost relation is severed if both ends occur in small chunks but in none together, unemitted if
    some small chunk holds both. Only chunks of documents that lost a relation are compared.
    """
    lost = big.join(small, ["doc", "relation"], "left_anti")
    a, b = ends(F.col("relation"))
    body = fine.select("doc", lowered(F.col("chunk")).alias("body"))
    seen = lost.withColumn("a", a).withColumn("b", b).join(body, "doc")
    has = lambda c: F.col("body").contains(F.col(c))
    seen = seen.groupBy("doc", "relation").agg(F.bool_or(has("a")).alias("a"), F.bool_or(has("b")).alias("b"), F.bool_or(has("a") & has("b")).alias("both"))
    n = lambda c: F.sum(c.cast("long"))
    split = seen.groupBy("doc").agg(n(F.col("a") & F.col("b") & ~F.col("both")).alias("severed"), n(F.col("both")).alias("unemitted"))
    sides = big.withColumn("side", F.lit(1)).unionAll(small.withColumn("side", F.lit(2))).groupBy("doc", "relation").agg(F.sum("side").alias("side"))
    count = lambda *of: n(F.col("side").isin(*of))
    totals = sides.groupBy("doc").agg(count(1, 3).alias("at_big"), count(2, 3).alias("at_small"), count(1).alias("lost"), count(2).alias("gained"))
    out = coarse.select("doc").distinct().join(totals, "doc", "left").join(split, "doc", "left").fillna(0)
    return out.withColumn("unclassified", F.col("lost") - F.col("severed") - F.col("unemitted"))


def half_split(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, whole, halves, lost, gained, severed: relations of a text against those of its two halves.

    Severed ones have each end in one half only, and not in the same. Row by row, without a shuffle.
    """
    rows = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.floor(F.length("t") / 2).cast("int"))
    rows = rows.withColumn("x", F.col("t").substr(F.lit(1), F.col("h"))).withColumn("y", F.col("t").substr(F.col("h") + 1, F.length("t")))
    rows = rows.select("doc", cooccurring(F.col("t")).alias("whole"), F.array_union(cooccurring(F.col("x")), cooccurring(F.col("y"))).alias("halves"), lowered(F.col("x")).alias("x"), lowered(F.col("y")).alias("y"))
    rows = rows.withColumn("lost", F.array_except("whole", "halves"))
    only = lambda w, here, there: F.col(here).contains(w) & ~F.col(there).contains(w)

    def cut(relation: Column) -> Column:
        a, b = ends(relation)
        return (only(a, "x", "y") & only(b, "y", "x")) | (only(a, "y", "x") & only(b, "x", "y"))

    size = lambda c: F.size(c).cast("long")
    return rows.select("doc", size("whole").alias("whole"), size("halves").alias("halves"), size("lost").alias("lost"), size(F.array_except("halves", "whole")).alias("gained"), size(F.filter("lost", cut)).alias("severed"))
