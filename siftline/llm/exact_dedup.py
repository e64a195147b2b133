"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

Each text, with A-Z lower-cased, is cut where its own content says so: a sentence end before a
letter a-f, at least 64 characters after the last cut and at most 4,096. A document becomes the
ordered list of its chunks' identifiers. An identifier is verified: the chunk texts meet once,
without their repeats, and those that share a hash get ordinals that tell them apart. Equal
lists then mean equal texts, and only the lists are compared and moved. A very long text is a longer list.

Nulls count as empty texts; empty texts form one group. Of equal texts the row with the largest
doc_id stays (null ids come last); of rows that repeat both, exactly one. An empty table gives an
empty result. Other columns are ignored by ``verdicts`` and kept by ``keep_first``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import HOT, durable, fold_ascii, one_of_each, quoted, texts, whole

CHUNK = r"(?s).{63,4094}?[.!?\n](?=\s?[a-fA-F])|.{1,4095}"


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def _hash(chunk: Column, bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if bits >= 64 else h.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """doc_id, row (an id of the row), recipe array<long>, ords array<int>, text_sha256: durable.

    ``ords`` is empty unless a chunk's hash is shared by another chunk text. Row ids are taken once, for
    the written table; texts are met again by their digest.
    """
    folded = texts(docs, id_col, text_col).select("doc_id", fold_ascii(F.col("text")).alias("text"))
    plain = durable(
        folded.select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            F.transform(_chunks(F.col("text")), lambda c: _hash(c, hash_bits)).alias("recipe"),
            F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        )
    )
    chunk = folded.select(F.explode(_chunks(F.col("text"))).alias("chunk")).select(_hash(F.col("chunk"), hash_bits).alias("h"), "chunk")
    distinct = chunk.groupBy("h", "chunk").agg(F.lit(1).alias("one"))
    shared = durable(distinct.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    none = F.array().cast("array<int>")
    if shared.isEmpty():
        return plain.select("doc_id", "row", "recipe", none.alias("ords"), "text_sha256")

    # Chunk texts under a shared hash: few, but they are told apart by their texts.
    told = distinct.join(shared, "h", "left_semi").select("h", "chunk")
    ranked = told.alias("a").join(told.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("b.chunk") < F.col("a.chunk")), "left")
    ranked = ranked.groupBy(F.col("a.h").alias("h"), F.col("a.chunk").alias("chunk")).agg(F.count("b.chunk").cast("int").alias("ord"))
    # The texts that hold such chunks are known by their hash list and their digest.
    hit = plain.select("recipe", "text_sha256").distinct().select("text_sha256", F.explode("recipe").alias("h")).join(shared, "h", "left_semi").select("text_sha256").distinct()
    held = folded.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).join(hit, "text_sha256", "left_semi")
    held = held.groupBy("text_sha256").agg(F.min("text").alias("text"))
    pieces = held.select("text_sha256", F.posexplode(_chunks(F.col("text"))).alias("pos", "chunk"))
    pieces = pieces.withColumn("h", _hash(F.col("chunk"), hash_bits)).join(ranked, ["h", "chunk"], "left")
    ords = pieces.groupBy("text_sha256").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("ord", F.lit(0)).alias("ord")))).alias("o"))
    ords = ords.select("text_sha256", F.transform("o", lambda x: x["ord"]).alias("ords"))
    return durable(plain.join(ords, "text_sha256", "left").select("doc_id", "row", "recipe", F.coalesce("ords", none).alias("ords"), "text_sha256"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """One row for each row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    listed = recipes(docs, id_col, text_col, hash_bits).withColumn("key", F.xxhash64("recipe", "ords"))
    keys = ["key", "recipe", "ords"]
    stays = F.max(F.struct("doc_id", "row")).alias("stays"), F.count("*").alias("group_size")
    # Keys of over a HOT-th of all rows, fewer than HOT: their groups go to their rows, not all rows to one task.
    hot = F.broadcast(listed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > listed.count() // HOT).select("key"))
    if hot.isEmpty():
        joined = listed.join(listed.groupBy(*keys).agg(*stays), keys)
    else:
        rest, many = listed.join(hot, "key", "left_anti"), listed.join(hot, "key", "left_semi")
        # Lists that are equal have one digest, and it is short where a list may be long.
        groups = many.groupBy(*keys).agg(*stays, F.min("text_sha256").alias("text_sha256")).drop("recipe", "ords")
        joined = rest.join(rest.groupBy(*keys).agg(*stays), keys).unionByName(many.join(F.broadcast(groups), ["key", "text_sha256"]))
    return joined.select(
        "doc_id",
        F.col("stays.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("stays.row")).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, of whatever names and types."""
    told = verdicts(docs, id_col, text_col).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    stay = durable(told.filter("kept").select("doc_id", "text_sha256", "n"))
    sha = F.sha2(fold_ascii(F.coalesce(F.col(quoted(text_col)), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), sha.alias("sha"), whole(docs).alias("doc"))
    rows = rows.join(stay, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("text_sha256")))
    if stay.filter("n > 1").isEmpty():
        return rows.select("doc.*")
    return one_of_each(rows, ["id", "sha"], text_col)


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
