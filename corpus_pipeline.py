"""From raw documents to packed sequences, in five stages, each written as Parquet and read again.

``run`` applies STAGES to the ``documents`` of a folder. Stage tables lie in the shared folder that
``spark.checkpoint.dir`` names, so that a lost executor costs its tasks only.

Null and empty texts are equal texts: one of them comes through, and becomes a piece of one token. Very long
texts are taken whole and cut into windows at the end only. Of ties, repeated rows and rows that repeat an id
each stage's docstring names the one that stays; an id that is null counts as unknown and names no group.
Extra columns are carried along to the last stage, whatever their names and types; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import decontaminate, exact_dedup, packing, toxicity, wide_simhash
from siftline.llm.runtime import new_folder, remove, scratch

TOKENIZER = "word_bpe_49k.json"
#: Words that a Python worker of the last stage remembers: half as many as elsewhere, since workers
#: still hold memory of the stages before.
REMEMBERED = 500_000


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 stay."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_first(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose sets of five-word shingles are 0.8 similar, the smallest doc_id stays.

    Blocks of SimHash fingerprints find candidates and the exact similarity decides. Fingerprints are longer than
    64 bits, as these can't tell 0.8 (see the module).
    """
    return wide_simhash.keep_first(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item, in any order, go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER), remembered=REMEMBERED)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("simhash", remove_near_copies),
    ("decontamination", remove_leaks),
    ("packing", pack),
]

#: Classifier, near-copy links, tilings and packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces. Of the stage tables only the last is left, until the application ends."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
