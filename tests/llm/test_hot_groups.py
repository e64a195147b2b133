"""Half of the rows are one text: no task of the last joins gets them all."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from siftline.llm import exact_dedup, similar, simhash


@pytest.fixture
def shuffled(spark):
    """Joins as over large tables: nothing small enough for the optimiser to broadcast, no splitting afterwards."""
    names = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions"
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("-1", "false", "16"), strict=True):
        spark.conf.set(n, v)
    yield spark
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


@pytest.mark.parametrize("of", [exact_dedup.verdicts, simhash.near_duplicates, similar.similar_groups])
def test_rows_stay_spread(shuffled, of):
    n = 12_000
    text = F.when(F.col("id") % 2 == 0, "One text, many times over. And again.").otherwise(F.concat_ws(" ", *(F.hash("id", F.lit(k)).cast("string") for k in range(12))))
    docs = shuffled.range(0, n, 1, 8).select(F.col("id").alias("doc_id"), text.alias("text"))
    got = of(docs).withColumn("task", F.spark_partition_id()).cache()
    sizes = [r["count"] for r in got.groupBy("task").count().collect()]
    # The half lies where it was read, in 8 files at most; the other half in 16 tasks.
    assert sum(sizes) == n and max(sizes) < 3 * median(sizes)
    name = "keep_id" if "keep_id" in got.columns else "component_id"
    groups = got.groupBy(name).count().filter("count > 1").collect()
    assert [tuple(r) for r in groups] == [(n - 2 if name == "keep_id" else 0, n // 2)]
    got.unpersist()


def test_odd_rows_among_hot_ones(spark, monkeypatch):
    """With groups of two rows counted as hot already, results are the same."""
    from siftline.llm import runtime

    rows = [(i % 40, ["", None, "a b c d e f g", "A b c d e f g", f"other text {i} of its own words"][i % 5]) for i in range(100)] + [(None, "a b c d e f g"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = lambda f: sorted((str(tuple(r)) for r in f(docs).drop("n_chunks").collect()))
    plain = [told(f) for f in (exact_dedup.verdicts, simhash.near_duplicates, similar.similar_groups)]
    monkeypatch.setattr(runtime, "HOT", 50)
    monkeypatch.setattr(exact_dedup, "HOT", 50)
    assert [told(f) for f in (exact_dedup.verdicts, simhash.near_duplicates, similar.similar_groups)] == plain
