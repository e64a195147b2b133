import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import stats as st
from siftline.functions import text as tx
from siftline.operators import chunking, graph, retrieval, runlog
from siftline.sources import io
from siftline.streaming import runlog as stream


def test_bm25_as_brute_force(spark):
    import math
    from collections import Counter

    rng = random.Random(1)
    words = [f"w{i}" for i in range(10)]
    docs = {i: [rng.choice(words) for _ in range(rng.randint(0, 40))] for i in range(60)}
    asks = {i: [rng.choice(words) for _ in range(rng.randint(1, 4))] for i in range(40)} | {99: ["none"]}
    d, q = (spark.createDataFrame([(i, " ".join(w)) for i, w in x.items()], "id long, text string") for x in (docs, asks))
    tokens = tx.latin_tokens(F.col("text"))
    got = {(r.qid, r.doc): r.score for r in retrieval.bm25(retrieval.index(d, "id", tokens)[0], q, "id", tokens).collect()}
    df, avg = Counter(w for x in docs.values() for w in set(x)), sum(map(len, docs.values())) / 60
    for a, ws in asks.items():
        for i, x in docs.items():
            tf = Counter(x)
            s = sum(math.log(1 + (60 - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(x) / avg)) for w in ws if tf[w])
            assert got.get((a, i), 0.0) == pytest.approx(s)


def test_items_found_verbatim(spark):
    docs = spark.createDataFrame([(1, "One two three four"), (2, "xone two three"), (3, None), (4, "")], "id long, text string")
    items = spark.createDataFrame([(1, "ne two thr"), (2, "two"), (3, ""), (4, None), (5, "two four five"), (6, "ne two")], "item long, part string")
    got = {tuple(r) for r in retrieval.containing(docs, "id", "text", items, "item", "part", tx.unicode_tokens).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2), (6, 1), (6, 2)}


def test_metrics_of_empty_and_partial_lists(spark):
    gold = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "qid long, doc long")
    ranked = spark.createDataFrame([(1, 11, 2), (1, 10, 1), (1, 5, 3)], "qid long, doc long, rank int")
    got = {r.qid: (r.hits1, r.hitsk, r.strict, r.rr) for r in retrieval.metrics(gold.select("qid").distinct(), gold, ranked, 10).collect()}
    assert got == {1: (True, True, True, 1.0), 2: (False, False, False, 0.0)}


def test_packing_keeps_every_sentence_under_the_budget(spark):
    rng = random.Random(2)
    rows = []
    for i in range(30):
        paragraphs = ["\n".join(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(1, 30))) + "." for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 3))]
        rows.append((i, "a title", "\n\n".join(paragraphs)))
    rows += [(100, "t " * 30, "dropped."), (101, None, None), (102, "x", "")]
    docs = spark.createDataFrame(rows, "id long, title string, body string")
    got = chunking.pack(docs, "id", "title", "body", 20).orderBy("doc", "chunk_index").collect()
    assert all(r.n_tokens <= 20 for r in got) and {r.doc for r in got} == set(range(30))
    for i, title, body in rows[:30]:
        own = [r for r in got if r.doc == i]
        assert [r.chunk_index for r in own] == list(range(len(own)))
        assert " ".join(r.text.removeprefix(f"{title}\n\n") for r in own).split() == body.split()


def test_vertices_and_edges(spark):
    m = spark.createDataFrame([(1, 1, " Big  Co ", "A", "d1"), (1, 2, "big co", "B", ""), (2, 1, "BIG CO", "B", None), (3, 1, "x", None, "e"), (4, 1, " ", "A", "z")] + [(9, i, "many", "A", f"t{i}") for i in range(7)], "chunk long, seq long, name string, type string, description string")
    got = {r.name: (r.type, r.chunks, r.mentions, r.descriptions) for r in graph.vertices(m).collect()}
    assert got == {"big co": ("B", 2, 3, ["d1"]), "x": ("OTHER", 1, 1, ["e"]), "many": ("A", 1, 7, [f"t{i}" for i in range(5)])}
    r = spark.createDataFrame([("a", "b", 2), ("B", "a", 0), ("a", "A", 5), ("", "a", 1), ("a", "ghost", None)], "source string, target string, strength int")
    e = graph.edges(r)
    assert sorted(map(tuple, e.collect())) == [("a", "b", 3, 2), ("a", "ghost", 1, 1)]
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert tuple(graph.stats(nodes, e).first()) == (3, 1, 1, 1.0, 1.0, 1)


def test_statistics(spark):
    got = spark.createDataFrame([(0, 0), (5, 0), (95, 0), (3, 4)], "b long, c long").select(st.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([1.0, 0.0625, 2 / 2**95, 1.0])
    low, high = st.wilson(F.col("k"), F.col("n"))
    assert [tuple(r) for r in spark.createDataFrame([(0, 0), (5, 10)], "k long, n long").select(low, high).collect()] == [(0.0, 0.0), (23.66, 76.34)]
    p = spark.createDataFrame([(1, 0.001), (2, 0.04), (3, 0.012), (4, 0.02), (5, 0.9)], "id long, p double")
    assert {r.id for r in st.holm(p, "p").filter("significant").collect()} == {1, 3}
    d = spark.createDataFrame([("x", 1.0)] * 20 + [("y", 0.0)] * 5, "g string, d double")
    got = {r.g: r for r in st.bootstrap(d, "g", "d", 500).collect()}
    assert got["x"].low == got["x"].high == 1.0 and got["x"].p == 1 / 500 and got["y"].p == 1.0


def test_run_log(spark):
    log = spark.createDataFrame([(1, 1, "error:x"), (2, 1, "stop"), (3, 2, "stop"), (4, 2, "error:y"), (5, 3, "error:z")], "seq long, qi long, done_reason string")
    assert sorted((r.qi, r.seq) for r in runlog.latest(log, ["qi"], "seq").collect()) == [(1, 2), (2, 3)]
    assert sorted(r.qi for r in runlog.unrecovered(log, ["qi"], "seq").collect()) == [2, 3]
    tasks = spark.createDataFrame([(i,) for i in range(1, 5)], "qi long")
    assert sorted(r.qi for r in runlog.to_do(tasks, log, ["qi"]).collect()) == [3, 4]
    a = spark.createDataFrame([(1, "g"), (2, "h")], "qi long, gold string")
    b = spark.createDataFrame([(1, "g"), (2, "other")], "qi long, gold string")
    assert [r.qi for r in runlog.disagreeing(a, b, "qi", "gold").collect()] == [2]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1}\nbroken\n{"k": 2}\n')
    assert sorted(r.k for r in io.tolerant_lines(spark, str(tmp_path / "a.json"), "k long").collect()) == [1, 2]
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        io.strict_lines(spark, str(tmp_path / "a.json"), "k long").collect()
    one = lambda k, v: spark.createDataFrame([(k, v)], "block string, v int")
    for k, v in (("x", 1), ("y", 2), ("x", 3)):
        io.merge_block(one(k, v), str(tmp_path / "m"), "block")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "m")).select("block", "v").collect())) == [("x", 3), ("y", 2)]
    io.append_log(one("x", 1), str(tmp_path / "log"), "1")
    io.append_log(one("x", 2), str(tmp_path / "log"), "2")
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert "<td>1</td>" in io.html_report(one("<x>", 1), "t") and "&lt;x&gt;" in io.html_report(one("<x>", 1), "t")


def test_written_lines_documents_and_ablation(spark, tmp_path):
    for v in (1, 2):
        io.write_lines(spark.range(v), str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2
    io.write_document(spark.createDataFrame([("a", [1, 2])], "k string, v array<int>"), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).first().v == [1, 2] and len(list((tmp_path / "d").glob("part-*"))) == 1
    d = spark.createDataFrame([("Answer. Or say so. Now.",)], "p string")
    assert d.select(tx.ablated(F.col("p"), " Or say so.")).first()[0] == "Answer. Now."
    with pytest.raises(Exception, match="not in the prompt"):
        d.select(tx.ablated(F.col("p"), "absent")).collect()


def test_streamed_run_log_resumes(spark, tmp_path):
    (tmp_path / "tasks").mkdir()

    def feed(name, ids):
        (tmp_path / "tasks" / name).write_text("".join(f'{{"qi": {i}}}\n' for i in ids))
        generate = lambda rows: rows.withColumn("done_reason", F.when(F.col("qi") == 2, "error:x").otherwise("stop"))
        stream.run_tasks(spark, str(tmp_path / "tasks"), "qi long", str(tmp_path / "log"), str(tmp_path / "ck"), generate, ["qi"]).awaitTermination()

    feed("1.json", [1, 2, 2])
    feed("2.json", [1, 2, 3])
    log = spark.read.json(str(tmp_path / "log"))
    assert sorted((r.qi, r.done_reason) for r in log.collect()) == [(1, "stop"), (2, "error:x"), (2, "error:x"), (3, "stop")]


def test_normalisers(spark):
    d = spark.createDataFrame([("ﬁn  Straße\r\n\n\n\nÄ!",)], "t string")
    got = d.select(tx.clean(tx.nfkc(F.col("t"))), tx.letters_only(tx.casefold(tx.nfkc(F.col("t")))), tx.latin(F.col("t"))).first()
    assert tuple(got) == ("fin Straße\n\nÄ!", "finstrasseä", "n stra e")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


def test_exact_mcnemar_of_many_pairs():
    """Against exact sums; large counts take no longer than a few terms."""
    import math
    import time

    from siftline.functions import stats

    for b, c in [(0, 0), (3, 3), (0, 9), (12, 5), (400, 431), (1200, 1100), (30, 2500)]:
        n, k = b + c, min(b, c)
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
        assert math.isclose(stats.two_sided(b, c), want, rel_tol=1e-9), (b, c)
    began = time.time()
    assert 0.3 < stats.two_sided(50_000_000, 50_010_000) < 0.4 and stats.two_sided(10, 10**9) < 1e-300
    assert time.time() - began < 2


def test_samples_of_ties_and_hot_strata(spark):
    """As one sorted list would give them, with a stratum of nearly all rows, nulls and one tied score."""
    from siftline.operators import runlog

    rows = [(i, "hot" if i % 50 else None, 0.5 if i % 3 else i / 5000) for i in range(5000)]
    table = spark.createDataFrame(rows, "id long, s string, x double").repartition(7)

    def every(own, want):
        step = max(len(own) // want, 1)
        return {r[0] for p, r in enumerate(own) if p % step == 0 and p // step < want}

    want = every([r for r in rows if r[1]], 40) | every([r for r in rows if not r[1]], 40)
    assert {r.id for r in runlog.systematic(table, 40, ["s"], "id").collect()} == want
    assert {r.id for r in runlog.strided(table, "x", "id", 60).collect()} == every(sorted(rows, key=lambda r: (r[2], r[0])), 60)
    assert runlog.systematic(table.limit(0), 40, ["s"], "id").count() == 0
