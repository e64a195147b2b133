"""Streaming forms of the stateful stages: a resumable run log and additive credit.

There is no event-time logic to keep: a checkpointed file source with ``foreachBatch`` gives what
a log needs, and credit is a sum that nothing reads during the pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import runlog


def run_tasks(spark: SparkSession, tasks: str, schema: str, log: str, checkpoint: str, generate: Callable[[DataFrame], DataFrame], keys: list[str]) -> StreamingQuery:
    """Answer tasks that arrive as JSON lines, each key once; error rows are tried again.

    ``generate`` adds done_reason and whatever else the log holds. A batch that is run again
    finds its rows in the log and adds none. Each batch reads the log's keys; ``answers.run_tasks`` keeps them as state.
    """
    known = StructType([f for f in StructType.fromDDL(schema) if f.name in keys]).add("done_reason", "string")
    there = spark._jvm.org.apache.hadoop.fs.Path(log)

    def batch(rows: DataFrame, number: int) -> None:
        if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
            rows = runlog.to_do(rows, spark.read.schema(known).json(log), keys)
        generate(rows.dropDuplicates(keys)).withColumn("batch", F.lit(number)).write.mode("append").json(log)

    source = spark.readStream.schema(schema).json(tasks)
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def credit(clicks: DataFrame, doc: str, propensity: str, epsilon: float = 0.1, cap: float = 50.0) -> DataFrame:
    """doc, credit: clipped inverse propensities of explored clicks, 1/(1 - epsilon) of the others.

    Works on a stream (complete output mode) as on a table.
    """
    weight = F.when(F.col(propensity).isNull(), 1 / (1 - epsilon)).otherwise(F.least(1 / F.greatest(F.col(propensity), F.lit(1e-6)), F.lit(cap)))
    return clicks.groupBy(F.col(doc).alias("doc")).agg(F.sum(weight).alias("credit"))
