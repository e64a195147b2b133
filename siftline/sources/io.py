"""Sources and sinks: strict and tolerant JSON lines, nested documents, merged and appended outputs."""

from __future__ import annotations

import html
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path that all executors reach, deleted with the application: under ``spark.checkpoint.dir``.

    Only a session on one machine may do without that setting; it gets a temporary one.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="siftline-")
    folder = f"{base.rstrip('/')}/siftline-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` made once, as a table in a scratch folder: for small results that a plan uses more than once."""
    path = scratch_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def strict_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a bad line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without the bad ones."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def whole_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines in place of what was there, a file for each partition."""
    rows.write.mode("overwrite").json(path)


def write_document(summary: DataFrame, path: str) -> None:
    """A (small) summary as one file of JSON, a line for each row."""
    summary.coalesce(1).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def append_log(rows: DataFrame, path: str, batch: str) -> None:
    """One more batch of a run log; earlier ones stay."""
    rows.withColumn("batch", F.lit(batch)).write.mode("append").json(path)


def merge_block(rows: DataFrame, path: str, key: str) -> None:
    """Replace the blocks whose keys occur in ``rows``, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def manifest(docs: DataFrame, text: str) -> DataFrame:
    """One row: rows, characters, an order-free digest of all texts (the sum of hash prefixes)."""
    part = F.conv(F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return docs.agg(F.count("*").alias("n_rows"), F.sum(F.length(text)).alias("n_chars"), F.sum(part).cast("string").alias("digest"))


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, n_bytes, file_sha256 (16 hex digits) of every file at the paths. A file is hashed in one row: 2 GB at most. Empty files give no row."""
    files = spark.read.format("binaryFile").load(paths)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file"), F.col("length").alias("n_bytes"), F.substring(F.sha2("content", 256), 1, 16).alias("file_sha256"))


def html_report(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A page with a small result table, its rows inlined as JSON too; a table of more than ``most`` rows is refused, not cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows: a report shows a whole table")
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in found)
    data = json.dumps([r.asDict(recursive=True) for r in found], default=str, ensure_ascii=False).replace("<", "\\u003c")
    return f'<!doctype html><title>{html.escape(title)}</title><table><tr>{head}</tr>{body}</table><script type="application/json" id="rows">{data}</script>'
