"""The matrix source and the run log by state."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftline.sources import matrix
from siftline.streaming import answers


@pytest.fixture
def vectors(spark):
    return spark.range(500).select(F.col("id").alias("row"), F.array(*(F.sin(F.col("id") + k).cast("float") for k in range(5))).alias("vec")).repartition(7)


def test_matrix_round_trip(spark, vectors, tmp_path):
    path = str(tmp_path / "m")
    matrix.save(vectors, path, 4)
    again = matrix.load(spark, path, 64)
    assert again.schema.simpleString() == "struct<row:bigint,vec:array<float>>" and again.rdd.getNumPartitions() >= 8
    want = {r.row: r.vec for r in vectors.collect()}
    assert {r.row: r.vec for r in again.collect()} == want
    index = json.loads((tmp_path / "m" / "index.json").read_text())
    assert len(index["parts"]) == 4 and [p["first"] for p in index["parts"]] == list(np.cumsum([0, *(p["rows"] for p in index["parts"])])[:-1])
    # Header and parts, one behind the other, are a .npy file; it is read as it is.
    (tmp_path / "one.npy").write_bytes(b"".join((tmp_path / "m" / f).read_bytes() for f in ["header", *(p["file"] for p in index["parts"])]))
    assert np.load(tmp_path / "one.npy").tolist() == [want[i] for i in range(500)]
    assert {r.row: r.vec for r in matrix.load(spark, str(tmp_path / "one.npy"), 100).collect()} == want


def test_writing_again_leaves_one_matrix(spark, vectors, tmp_path):
    path = str(tmp_path / "m")
    matrix.save(vectors, path, 4)
    matrix.save(vectors.filter("row < 9"), path, 2)
    assert matrix.load(spark, path).count() == 9 and len(list((tmp_path / "m").glob("part-*"))) == 2
    matrix.save(vectors.limit(0), path, 2)
    assert matrix.load(spark, path).count() == 0


def test_a_failed_write_leaves_nothing(spark, vectors, tmp_path):
    path = str(tmp_path / "m")
    matrix.save(vectors.filter("row < 9"), path, 2)
    bad = F.when(F.col("row") == 400, F.array(F.lit(1.0))).otherwise(F.col("vec")).alias("vec")
    for rows in (vectors.select("row", bad), vectors.filter("row <> 77"), vectors.unionAll(vectors.filter("row = 3"))):
        with pytest.raises(Exception, match="length|order|gap"):
            matrix.save(rows, path, 4)
        assert matrix.load(spark, path).count() == 9 and len(list((tmp_path / "m").glob("part-*"))) == 2


def _answer(task: pd.DataFrame) -> pd.DataFrame:
    bad = (task["arm"] == "slow") & (task["n"] < 2)
    return pd.DataFrame({"arm": task["arm"], "qi": task["qi"], "answer": "a" + task["qi"].astype(str), "done_reason": bad.map({True: "error: late", False: "stop"})})


def test_tasks_are_answered_once_across_restarts(spark, tmp_path):
    tasks, log, state = (str(tmp_path / x) for x in ("tasks", "log", "state"))
    (tmp_path / "tasks").mkdir()

    def come(name, rows):
        (tmp_path / "tasks" / f"{name}.json").write_text("".join(json.dumps(dict(zip(("arm", "qi", "n"), r, strict=True))) + "\n" for r in rows))

    def run():
        answers.run_tasks(spark, tasks, "arm string, qi long, n int", log, state, _answer, ["arm", "qi"], "arm string, qi long, answer string, done_reason string, attempt int", files=1).awaitTermination()
        return sorted((r.arm, r.qi, r.done_reason, r.attempt) for r in spark.read.json(log).collect())

    come("a", [("plain", i, 1) for i in range(8)] * 2 + [("slow", 1, 1)])
    come("b", [("plain", i, 2) for i in range(4, 12)])
    first = run()
    assert first == sorted([("plain", i, "stop", 1) for i in range(12)] + [("slow", 1, "error: late", 1)])
    assert run() == first
    # After the restart: an error is tried again, what is done isn't; then it is done too.
    come("c", [("plain", 3, 3), ("slow", 1, 2), ("slow", 2, 5)])
    come("d", [("slow", 1, 9)])
    assert run() == sorted([*first, ("slow", 1, "stop", 2), ("slow", 2, "stop", 1)])
