"""A run log kept by state: every task is answered once, across batches and restarts, without reading the log.

A key's state says whether it is done. A key whose answer was an error stays open: when its task comes again it is tried
again. State lies in the checkpoint with the stream's offsets, so a batch that is run again gives the same rows once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..operators.runlog import ERROR

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Answerer(StatefulProcessor):
    """Keeps (done_reason, attempts) of each key."""

    def __init__(self, answer: Callable[[pd.DataFrame], pd.DataFrame]):
        self.answer = answer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("done_reason", StringType()), StructField("attempts", IntegerType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # A key's task counts once in a batch, however often it is there.
        task = next((part.iloc[:1] for part in rows if len(part)), None)
        reason, tries = self.last.get() or (ERROR, 0)
        if task is None or not (reason or "").startswith(ERROR):
            return
        out = self.answer(task.reset_index(drop=True))
        self.last.update((str(out["done_reason"].iloc[0]), int(tries) + 1))
        yield out.assign(attempt=int(tries) + 1)

    def close(self) -> None:
        pass


def answered(tasks: DataFrame, keys: list[str], answer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A stream of answers to a stream of tasks: ``answer`` turns one row into one that holds ``schema`` but for attempt.

    Needs the RocksDB state store, which it sets for the session.
    """
    tasks.sparkSession.conf.set(STORE, ROCKS)
    return tasks.groupBy(*keys).transformWithStateInPandas(Answerer(answer), schema, "append", "None")


def run_tasks(spark: SparkSession, tasks: str, task_schema: str, log: str, checkpoint: str, answer: Callable[[pd.DataFrame], pd.DataFrame], keys: list[str], log_schema: str, files: int = 1000) -> StreamingQuery:
    """Answers tasks that arrive as JSON lines and appends the answers to a log of JSON lines; ``files`` a batch at most."""
    source = spark.readStream.schema(task_schema).option("maxFilesPerTrigger", files).json(tasks)
    rows = answered(source, keys, answer, log_schema)
    return rows.writeStream.format("json").outputMode("append").option("path", log).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
