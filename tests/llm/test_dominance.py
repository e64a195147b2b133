import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import dominance as op
from siftline.llm import queries
from tests.oracle import connect, difference

SCHEMA = "sale_id long, slot long, level long, weight long, n string, w string, id long, run string"


def brute(rows):
    """What lies above each row, by looking at all."""
    known = [(s, v, w) for _, s, v, w in rows if s is not None and v is not None]
    out = []
    for i, s, v, _ in rows:
        up = None if s is None or v is None else [w for t, x, w in known if t < s and x > v]
        out.append((i, s, v, None if up is None else len(up), None if up is None else sum(up)))
    return sorted(out, key=str)


def answers(spark, rows, **small):
    df = spark.createDataFrame([(*r, "n", "w", 9, "r") for r in rows], SCHEMA)
    got = op.rows_above(df, "sale_id", F.col("slot"), F.col("level"), F.col("weight"), **small)
    assert got.columns == ["id", "slot", "level", "n_sales", "n_rows"]
    return sorted(map(tuple, got.collect()), key=str)


def test_credits_by_hand():
    rng = random.Random(1)
    place = np.array([rng.randrange(16) for _ in range(200)])
    amounts = np.array([[1, rng.randrange(9)] for _ in place])
    want = [[sum(amounts[j, c] for j in range(i) if place[j] < place[i]) for c in (0, 1)] for i in range(len(place))]
    assert op.credits(place, amounts, 4).tolist() == want
    assert op.credits(place[:0], amounts[:0], 4).shape == (0, 2)


@pytest.mark.parametrize("shape", ["spread", "hot slot", "hot level"])
def test_several_rounds_against_brute_force(spark, monkeypatch, shape):
    """Runs of eight points, four at a time: three rounds and more; running sums in steps of two ranges."""
    for name, value in (("FAN_BITS", 2), ("FAN", 4), ("STEP_BITS", 1), ("RUN", 8)):
        monkeypatch.setattr(op, name, value)
    rng = random.Random(shape)
    rows = []
    for i in range(400):
        slot, level = rng.randrange(300), rng.randrange(300)
        slot, level = {"spread": (slot, level), "hot slot": (slot if i % 3 else 7, level), "hot level": (slot, level if i % 3 else 7)}[shape]
        rows.append((i, slot, level, rng.randrange(1, 6)))
    assert answers(spark, rows, run=8, task_points=60) == brute(rows)


@pytest.mark.parametrize("slope", [1, -1, 0])
def test_in_order(spark, slope):
    rows = [(i, i if slope else 5, slope * i, 1 + i % 5) for i in range(300)]
    assert answers(spark, rows) == brute(rows)


def test_blocks_are_bounded():
    import pyarrow as pa

    batches = [pa.record_batch({"a": list(range(i, i + n))}) for i, n in ((0, 5), (5, 0), (5, 1), (6, 14))]
    got = [x["a"].tolist() for x in op.blocks(iter(batches), 8)]
    assert [len(x) for x in got] == [8, 8, 4] and sum(got, []) == list(range(20))


def test_odd_rows(spark):
    rows = [(1, 5, 10, 1), (1, 5, 10, 1), (None, 6, 9, 2), (None, None, 9, 2), (2, 7, None, 3), (3, None, None, 1), (4, -3, 100, 4), (5, 6, 10, 5), (5, 7, -10, 5), (6, 2**40, 0, 1), (7, 5, 2**52, 1)]
    assert answers(spark, rows) == brute(rows)
    assert answers(spark, [(1, None, 2, 1)]) == brute([(1, None, 2, 1)])
    assert answers(spark, []) == []


def test_hot_points_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(op, "RUN", 8)
    monkeypatch.setattr(op, "HOT", 10)
    rows = [(i, 3, 3, 1) for i in range(200)] + [(1000 + i, i % 9, i % 7, 2) for i in range(100)]
    assert answers(spark, rows, run=8) == brute(rows)


def test_sales(spark):
    """Levels, slots and repeats as the contract has them; times are UTC in any session zone; odd totals are null."""
    sales = spark.sql("SELECT * FROM VALUES (1, 74.19D, TIMESTAMP_NTZ'2024-03-10 02:30:59.9'), (2, 80D, TIMESTAMP_NTZ'1969-12-31 23:59:59'), (3, double('NaN'), TIMESTAMP_NTZ'2024-01-01 00:00:00'), (4, double('Infinity'), TIMESTAMP_NTZ'2024-01-01 00:00:00'), (null, null, null) AS t(sale_id, total, sold_at)")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", z)
            got = {r.sale_id: tuple(r)[1:] for r in op.sales_above(sales).collect()}
            assert got == {1: (28500630 + 0, 7419, 1, 1 + crc32(b"2") % 5), 2: (-1, 8000, 0, 0), 3: (28401120, None, None, None), 4: (28401120, None, None, None), None: (None, None, None, None)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    late = sales.withColumn("sold_at", F.expr("timestamp_seconds(61)"))
    assert {r.slot for r in op.sales_above(late).collect()} == {1}


def test_whole_table_against_sql(spark, sf_dir):
    c = connect(sf_dir)
    c.execute(f"CREATE VIEW sales AS SELECT * FROM '{sf_dir}/sales.parquet'")
    assert difference(queries.QUERIES["op13_dominance"](spark, sf_dir), c, queries.ORACLE_SQL["op13_dominance"]) == ""
