"""Sinks read again: what a query writes to a scratch folder is its result."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..sources import io, matrix
from ..streaming import answers
from .queries import query


@query("s2_strict_file", "SELECT doc_id, lang, n_chars FROM documents")
def _(t):
    docs = t("documents").select("doc_id", "lang", "n_chars")
    path = io.scratch_folder(docs.sparkSession, "lines")
    io.write_lines(docs, path)
    return io.strict_lines(docs.sparkSession, path, "doc_id long, lang string, n_chars long")


@query("s7_matrix_round_trip", "SELECT row, CAST(place AS BIGINT) AS place, round(CAST(x AS DOUBLE), 6) AS x FROM (SELECT vec_id AS row, unnest(embedding) AS x, unnest(range(len(embedding))) AS place FROM embeddings)")
def _(t):
    """Needs ids from 0 without a gap, as a matrix's rows have."""
    vectors = t("embeddings")
    path = io.scratch_folder(vectors.sparkSession, "matrix")
    matrix.save(vectors, path, 8, "vec_id", "embedding")
    rows = matrix.load(vectors.sparkSession, path).select("row", F.posexplode("vec").alias("place", "x"))
    return rows.select("row", F.col("place").cast("long").alias("place"), F.round(F.col("x").cast("double"), 6).alias("x"))


@query("s8_overwritten_lines", "SELECT doc_id, source FROM documents WHERE n_chars % 2 = 0")
def _(t):
    docs = t("documents")
    path = io.scratch_folder(docs.sparkSession, "lines")
    for rows in (docs, docs.filter("n_chars % 2 = 0")):
        io.write_lines(rows.select("doc_id", "source"), path)
    return io.strict_lines(docs.sparkSession, path, "doc_id long, source string")


@query("s9_appended_log", "SELECT event_id, user_id, CASE WHEN event_type = 'click' THEN '1' ELSE '2' END AS batch FROM events")
def _(t):
    events = t("events")
    path = io.scratch_folder(events.sparkSession, "log")
    io.append_log(events.filter("event_type = 'click'").select("event_id", "user_id"), path, "1")
    io.append_log(events.filter("event_type <> 'click'").select("event_id", "user_id"), path, "2")
    return io.strict_lines(events.sparkSession, path, "event_id long, user_id long, batch string")


_BY_LANG = "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY lang"


def _by_lang(t):
    return t("documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("s10_summary_document", _BY_LANG)
def _(t):
    rows = _by_lang(t)
    path = io.scratch_folder(rows.sparkSession, "summary")
    io.write_document(rows, path)
    return io.strict_lines(rows.sparkSession, path, "lang string, n long, n_chars long")


@query("s11_merged_block", f"SELECT lang, n, CASE WHEN lang IN ('de', 'fr') THEN -n_chars ELSE n_chars END AS n_chars FROM ({_BY_LANG})")
def _(t):
    """Two blocks are replaced, their siblings stay."""
    rows = _by_lang(t)
    path = io.scratch_folder(rows.sparkSession, "blocks")
    io.merge_block(rows, path, "lang")
    io.merge_block(rows.filter("lang IN ('de', 'fr')").withColumn("n_chars", -F.col("n_chars")), path, "lang")
    return rows.sparkSession.read.schema("n long, n_chars long, lang string").parquet(path)


@query("s12_report_rows", _BY_LANG)
def _(t):
    """The rows that the page has inlined, read from the page."""
    rows = _by_lang(t)
    page = io.html_report(rows, "Documents <by> language")
    inlined = F.regexp_extract(F.lit(page), r'(?s)id="rows">(.*?)</script>', 1)
    return rows.sparkSession.range(1).select(F.inline(F.from_json(inlined, "array<struct<lang string, n long, n_chars long>>")))


_ANSWERED = "WITH p AS (SELECT DISTINCT user_id, event_id % 3 AS n FROM events), q AS (SELECT user_id, n, user_id % 3 <= n AS ok, row_number() OVER (PARTITION BY user_id ORDER BY n) AS attempt, min(CASE WHEN user_id % 3 <= n THEN n END) OVER (PARTITION BY user_id) AS first_ok FROM p) SELECT user_id, n, CAST(attempt AS INT) AS attempt, CASE WHEN ok THEN 'stop' ELSE 'error: early' END AS done_reason FROM q WHERE first_ok IS NULL OR n <= first_ok"


def _answer(task: pd.DataFrame) -> pd.DataFrame:
    """Users are answered from the pass of their number on; before, it is an error."""
    return task.assign(done_reason=["stop" if u % 3 <= n else "error: early" for u, n in zip(task["user_id"], task["n"], strict=True)])[["user_id", "n", "done_reason"]]


@query("st1_answered_once", _ANSWERED)
def _(t):
    """Three passes over users as tasks, the stream stopped and started between them: errors are tried again, what is done isn't."""
    tasks = t("events").select("user_id", (F.col("event_id") % 3).alias("n")).distinct()
    spark = tasks.sparkSession
    place = io.scratch_folder(spark, "tasks")
    for n in range(3):
        io.append_log(tasks.filter(F.col("n") == n), f"{place}/in", str(n))
        answers.run_tasks(spark, f"{place}/in", "user_id long, n long", f"{place}/log", f"{place}/state", _answer, ["user_id"], "user_id long, n long, done_reason string, attempt int").awaitTermination()
    return io.strict_lines(spark, f"{place}/log", "user_id long, n long, done_reason string, attempt int")
