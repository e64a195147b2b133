import json
import math
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftline.functions import stats as st
from siftline.operators import chunking, extraction, learning, retrieval, runlog
from siftline.sources import models


class Server(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def do_GET(self):
        self.reply(b"payload")

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/embed":
            return self.reply(json.dumps({"embeddings": [[float(len(t)), 1.0] for t in asked["input"]]}).encode())
        if self.path == "/chat":
            said = {"content": f" {asked['messages'][-1]['content']}! ", "reasoning_content": "hm"}
            return self.reply(json.dumps({"choices": [{"message": said, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}).encode())
        text = asked["prompt"]
        if text == "fail":
            return self.send_error(500)
        reason = "length" if text == "long" else "stop"
        return self.reply(json.dumps({"response": text, "eval_count": 1, "prompt_eval_count": 2, "done_reason": reason}).encode())

    def reply(self, body):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_generation_and_its_errors(spark, url):
    rows = spark.createDataFrame([(1, "hello"), (2, "fail"), (3, None)], "qi long, prompt string")
    got = {r.qi: (r.answer, r.done_reason, r.gen_tokens) for r in models.generate(rows, models.Generate(f"{url}/generate", "m")).collect()}
    assert got == {1: ("hello", "stop", 1), 2: ("", "error:HTTPError", 0), 3: ("", "stop", 1)}
    r = models.generate(rows.limit(1), models.Chat(f"{url}/chat", "be brief")).first()
    assert (r.answer, r.thinking_len, r.prompt_tokens, r.gen_tokens) == ("hello!", 2, 3, 2)


def test_extraction_statuses(spark, url):
    full = json.dumps({"entities": [{"name": "A", "type": "OTHER", "description": ""}], "relationships": [{"source": "A", "target": "B", "strength": 3}]})
    rows = spark.createDataFrame([(1, full), (2, "long"), (3, "no json"), (4, "fail")], "id long, prompt string")
    got = {r.id: r for r in models.extract(rows, models.Generate(f"{url}/generate", "m")).collect()}
    assert [got[i].status for i in range(1, 5)] == ["ok", "truncated", "unparseable", "error:HTTPError"]
    assert got[1].entities[0].name == "A" and got[1].relationships[0].strength == 3 and got[3].entities is None


def test_vectors_and_matrix_files(spark, url, tmp_path):
    texts = spark.createDataFrame([(i, "x" * i) for i in range(70)], "row long, text string")
    made = models.embed(texts, models.Embed(f"{url}/embed", "m", longest=50), "row", "text")
    vec = {r.row: r.vec for r in made.collect()}
    assert vec[3] == pytest.approx([3 / math.sqrt(10), 1 / math.sqrt(10)]) and vec[60] == vec[50]
    models.save_npy(made, str(tmp_path / "m.npy"))
    assert np.load(tmp_path / "m.npy").shape == (70, 2)
    again = {r.row: r.vec for r in models.load_npy(spark, str(tmp_path / "m.npy"), 16).collect()}
    assert again == vec
    with pytest.raises(ValueError, match="gap"):
        models.save_npy(made.filter("row > 3"), str(tmp_path / "n.npy"))


def test_downloads_are_kept(url, tmp_path):
    path = tmp_path / "a" / "f"
    assert models.fetch(url, str(path)) == str(path) and path.read_bytes() == b"payload"
    path.write_bytes(b"kept")
    models.fetch(url, str(path))
    assert path.read_bytes() == b"kept" and [p.name for p in path.parent.iterdir()] == ["f"]


def test_comparison_of_chunkings(spark):
    big = spark.createDataFrame([(1, "apple||bear"), (1, "c||d"), (1, "e||f"), (1, "g||zz")], "doc long, relation string")
    small = spark.createDataFrame([(1, "g||x")], "doc long, relation string")
    coarse = spark.createDataFrame([(1, ""), (2, "")], "doc long, chunk string")
    fine = spark.createDataFrame([(1, "An Apple"), (1, "bears, C and D"), (1, "e f g")], "doc long, chunk string")
    got = {r.doc: r.asDict() for r in extraction.compare(big, small, coarse, fine).collect()}
    assert got[1] == {"doc": 1, "at_big": 4, "at_small": 1, "lost": 4, "gained": 1, "severed": 1, "unemitted": 2, "unclassified": 1}
    assert got[2]["lost"] == got[2]["unclassified"] == 0
    split = spark.createDataFrame([(1, "Xaa Ybb. zzzz Qcc Rdd"), (2, None), (3, "Aaa Bbb")], "id long, text string")
    got = {r.doc: (r.whole, r.halves, r.lost, r.severed) for r in extraction.half_split(split, "id", "text").collect()}
    assert got == {1: (3, 2, 1, 1), 2: (0, 0, 0, 0), 3: (1, 0, 1, 1)}


def test_severance_of_planted_facts(spark):
    docs = spark.createDataFrame([(1, "x" * 1000 + "needle" + "y" * 1000), (2, "short needle")], "id long, text string")
    pairs = spark.createDataFrame([(1, "needle"), (2, "needle")], "doc long, fact string")
    got = {r.label: (r.spans, r.severed) for r in chunking.severed(pairs, docs, "id", "text", [("cut", 1003, 0), ("over", 1003, 500)]).collect()}
    assert got == {"cut": (2, 2), "over": (2, 1)}


def test_learning_pass(spark):
    n, k = 50, 5
    rng = random.Random(3)
    pool = {q: rng.sample(range(n), 8) for q in range(200)}
    gold = {q: set(rng.sample(p, 2)) for q, p in pool.items()}
    ranked = spark.createDataFrame([(q, d, i + 1) for q, p in pool.items() for i, d in enumerate(p)], "qid long, doc long, rank int")
    golds = spark.createDataFrame([(q, d) for q, g in gold.items() for d in g], "qid long, doc long")
    split = learning.split(ranked.select("qid").distinct(), 2).cache()
    shown = learning.explored(split, ranked, n, k).cache()
    learns = {(r.seed, r.qid) for r in split.filter("learns").collect()}
    assert 180 < len(learns) < 300 and {(r.seed, r.qid) for r in shown.collect()} == learns
    swaps = shown.filter("swapped").groupBy("seed", "qid").count().collect()
    assert swaps and all(r["count"] == 1 for r in swaps)
    want = {}
    for r in shown.collect():
        if r.doc in gold[r.qid]:
            want[r.seed, r.doc] = want.get((r.seed, r.doc), 0) + (50.0 if r.swapped else 1 / 0.9)
    credit = learning.credit(shown, golds, n, k)
    got = {(r.seed, r.doc): r.credit for r in credit.collect()}
    assert got == pytest.approx(want)
    moved = {(r.seed, r.doc): r.credit for r in learning.shuffled(credit, n).collect()}
    assert len(moved) == len(got) and sorted(moved.values()) == pytest.approx(sorted(got.values())) and moved.keys() != got.keys()
    seeded = split.filter("NOT learns").select("seed", "qid").join(ranked, "qid")
    again = {}
    for r in learning.rerank(seeded, credit).orderBy("rank").collect():
        again.setdefault((r.seed, r.qid), []).append(r.doc)
    for (seed, q), docs in again.items():
        most = max(v for (s, _), v in got.items() if s == seed)
        own = {d: (8 - i) / 8 + 0.3 * got.get((seed, d), 0) / most for i, d in enumerate(pool[q])}
        assert docs == sorted(own, key=lambda d: (-round(own[d], 9), d))
    with pytest.raises(ValueError, match="divides"):
        learning.shuffled(credit, learning.STRIDE)


def test_gates(spark):
    rows = [("similar", "learned", "base", 2.0, 1.0, 0.01), ("novel", "learned", "base", -1.0, -2.0, 0.3), ("similar", "learned", "popularity", 1.0, 0.1, 0.04)]
    names = "split string, a string, b string, mean double, low double, p double"
    assert tuple(learning.gates(spark.createDataFrame(rows, names)).first()) == (True, True, True, False, False)
    rows.append(("similar", "learned", "shuffled", 1.0, 0.1, 0.02))
    assert all(learning.gates(spark.createDataFrame(rows, names)).first())


def test_outcomes_of_all_arms_in_one_pass(spark):
    """Against the arms one by one; queries without gold, docs on several lines, queries of no table."""
    rng = random.Random(4)
    n, k, seeds, e = 60, 4, 3, 0.6
    rows = [(q, min(rng.randrange(n), rng.randrange(n)), at, rng.random() < 0.2) for q in range(400) for at in range(rng.randrange(1, 10))] + [(0, 7, 9, None), (None, 3, 1, True)]
    lines = spark.createDataFrame(rows, "qid long, doc long, at int, gold boolean")
    queries = spark.range(390).select(F.col("id").alias("qid"))
    by = Window.partitionBy("qid").orderBy("at", "doc")
    pool = lines.groupBy("qid", "doc").agg(F.min("at").alias("at")).select("qid", "doc", F.row_number().over(by).alias("rank")).cache()
    golds = lines.filter("gold").select("qid", "doc").distinct().cache()
    split = learning.split(queries, seeds).cache()
    credit = learning.credit(learning.explored(split, pool, n, k, e), golds, n, k, e, 4.0).cache()
    seeded = split.filter("NOT learns").select("seed", "qid").join(pool, "qid").cache()
    arms = {"base": seeded, "learned": learning.rerank(seeded, credit), "popularity": learning.rerank(seeded, credit, text=False), "shuffled": learning.rerank(seeded, learning.shuffled(credit, n))}
    want = {(r.seed, r.qid): [r.similar] for r in learning.similar(split, golds).collect()}
    for ranked in arms.values():
        for r in learning.strict(split, golds, ranked, 2).collect():
            want[r.seed, r.qid].append(r.strict)
    found = learning.outcomes(queries, lines, n, seeds, k, 2, e, 4.0)
    got = {(r.seed, r.qid): [r.similar, r.base, r.learned, r.popularity, r.shuffled] for r in found.collect()}
    assert got == want and len(got) > 200 and len({tuple(x) for x in got.values()}) > 6
    with pytest.raises(ValueError, match="divides"):
        learning.outcomes(queries, lines, learning.STRIDE, seeds)


def test_bootstrap_as_plain_resampling(spark):
    rng = random.Random(5)
    diffs = [rng.choice([-1.0, 0.0, 0.0, 1.0, 1.0]) for _ in range(300)]
    r = st.bootstrap(spark.createDataFrame([("a", d) for d in diffs] + [("b", None)], "g string, d double"), "g", "d", 4000, scale=100.0).orderBy("g").collect()
    means = sorted(100 * sum(rng.choices(diffs, k=300)) / 300 for _ in range(2000))
    assert r[0].n == 300 and r[0].mean == pytest.approx(100 * sum(diffs) / 300)
    assert r[0].low == pytest.approx(means[50], abs=2.0) and r[0].high == pytest.approx(means[1950], abs=2.0)
    assert tuple(r[1])[1:] == (0, 0.0, 0.0, 0.0, 1.0)


def test_delta_family(spark):
    rows = [("c", 1, "t", "x", 1), ("c", 1, "t", "y", 0), ("c", 2, "u", "x", 1), ("c", 3, "t", "x", 0), ("c", 3, "t", "y", 1)]
    got = st.delta_family(spark.createDataFrame(rows, "config string, qid long, type string, arm string, m int"), [("x", "y")], ["m"])
    assert sorted(map(tuple, got.collect())) == [("c/all/x-y/m", -1.0), ("c/all/x-y/m", 1.0), ("c/t/x-y/m", -1.0), ("c/t/x-y/m", 1.0)]


def test_samples(spark):
    rows = spark.createDataFrame([(i, "big" if i < 90 else "small") for i in range(100)], "id long, kind string")
    got = sorted(r.id for r in runlog.proportional(rows, 10, "kind", "id").collect())
    assert got == [0, 10, 20, 30, 40, 50, 60, 70, 80, 90]
    scored = spark.createDataFrame([(i, (i * 37 % 101) / 100 if i % 9 else 1.0) for i in range(101)], "id long, s double")
    order = sorted(scored.collect(), key=lambda r: (r.s, r.id))
    assert sorted(r.id for r in runlog.strided(scored, "s", "id", 10).collect()) == sorted(order[i * 10].id for i in range(10))


def test_fates_and_completeness(spark):
    rows = spark.createDataFrame([(True, False, True), (True, False, False), (True, True, False), (False, True, True)], "b boolean, n boolean, c boolean")
    assert tuple(rows.agg(*runlog.fates(F.col("b"), F.col("n"), F.col("c"))).first()) == (1, 1, 1)
    want = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "arm string, qi long")
    log = spark.createDataFrame([("x", 1), ("x", 1)], "arm string, qi long")
    assert sorted(map(tuple, runlog.completeness(log, want, ["arm", "qi"], "arm").collect())) == [("x", 2, 1, 1), ("y", 1, 0, 1)]


def test_graded_metrics(spark):
    gold = spark.createDataFrame([(1, 10), (1, 11), (2, 5)], "qid long, doc long")
    ranked = spark.createDataFrame([(1, 10, 2), (1, 99, 1), (1, 11, 3)], "qid long, doc long, rank int")
    got = {r.qid: (r.recall, r.ndcg) for r in retrieval.graded(gold, ranked, 2).collect()}
    assert got == {1: (0.5, pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))), 2: (0.0, 0.0)}


def test_products_above_a_bound(spark):
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(40)], "vec_id long, embedding array<float>")
    got = {(r.qid, r.doc) for r in retrieval.above(v, v.filter("vec_id % 20 = 0"), 0.5, block=1).collect()}
    assert got == {(q, d) for q in (0, 20) for d in range(40) if math.cos(q - d) >= 0.5}
