import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import stats
from siftline.operators import chunking, graph, reporting
from siftline.sources import io


def by(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def test_calibration_with_empty_cells(spark):
    rows = [("a", 1, 1, 0), ("a", 1, 0, 1), ("a", 0, 1, 0), ("a", 0, 0, 0), ("b", 1, 0, 0)]
    df = spark.createDataFrame(rows, "k string, c int, a int, r int")
    got = by(reporting.calibration(df, F.col("c") == 1, F.col("a") == 1, F.col("r") == 1, "k"), "k")
    assert got["a",]["precision"] == 0.5 and got["a",]["recall"] == 0.5 and got["a",]["base_rate_pct"] == 50
    assert got["b",]["precision"] is None and got["b",]["recall"] is None and got["b",]["abstain_pct_complete"] == 0
    assert got["all",]["n"] == 5 and got["all",]["answered"] == 2 and got["all",]["answered_pct"] == 50
    assert reporting.calibration(df.limit(0), F.col("c") == 1, F.col("a") == 1, F.col("r") == 1, "k").count() == 0


def test_constant_baseline(spark):
    df = spark.createDataFrame([(["Yes", "x"],), (["yes!"],), (["No"],), ([""],), ([],), (None,)], "golds array<string>")
    got = by(reporting.constant_baseline(df, F.col("golds"), [("always_yes", "Yes", F.size("golds") == 1)]), "baseline")
    assert got["most_common",]["answer"] == "" and got["most_common",]["contained"] == 0 and got["most_common",]["n"] == 6
    assert (got["always_yes",]["n"], got["always_yes",]["contained"]) == (3, 1)


def test_traffic_mix(spark):
    cells = spark.createDataFrame([("x", "p", 10.0), ("x", "q", 20.0), ("y", "p", 20.0)], "config string, type string, value double")
    mix = spark.createDataFrame([("m", "p", 1.0), ("m", "q", 1.0), ("zero", "p", 0.0), ("zero", "q", 0.0)], "preset string, type string, weight double")
    got = {k: (v["weighted"], v["winner"]) for k, v in by(reporting.traffic_mix(cells, mix), "preset", "config").items()}
    assert got == {("m", "x"): (15.0, True), ("m", "y"): (10.0, False), ("zero", "x"): (0.0, True), ("zero", "y"): (0.0, False)}


def test_severance_by_type(spark):
    facts = [(1, "t", "d", "a fact of some length"), (1, "t", "d", "a severed fact here"), (2, "t", "d", "short"), (3, None, "e", "not in any chunk at all")]
    chunks = spark.createDataFrame([("d", "this is a fact of some length"), ("d", "a severed"), ("d", "fact here")], "doc string, chunk string")
    got = by(reporting.severance(spark.createDataFrame(facts, "qid int, type string, doc string, fact string"), chunks), "type")
    assert {k[0]: (v["spans"], v["severed"], v["queries"], v["queries_hit"]) for k, v in got.items()} == {"t": (2, 1, 2, 1), "unknown": (1, 1, 1, 1), "all": (3, 2, 3, 2)}
    only_short = reporting.severance(spark.createDataFrame(facts[2:3], "qid int, type string, doc string, fact string"), chunks)
    assert by(only_short, "type")["t",]["span_pct"] is None


def test_repeats(spark):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 2, "x"), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, "x"), ("c", 2, None), ("d", 1, None)]
    got = by(reporting.repeats(spark.createDataFrame(rows, "k string, r int, i string"), "k", "r", "i"), "k")
    assert {k[0]: v["equal"] for k, v in got.items()} == {"a": True, "b": False, "c": False, "d": True}


def test_claims(spark):
    outcomes = spark.createDataFrame([("a", 1), ("a", 0), ("a", 1), ("b", 1)], "g string, o int")
    stored = spark.createDataFrame([("a", 3, 66.67, 0.1, 0.2), ("b", 2, 50.0, -1.0, 1.0), ("c", 1, 0.0, -2.0, -1.0)], "g string, n int, pct double, low double, high double")
    got = {k[0]: v["ok"] for k, v in by(reporting.claims(outcomes, stored, "g", "o"), "check").items()}
    assert [got[f"{x}:a"] for x in ("mean", "rows", "excludes_zero")] == [True] * 3
    assert [got[f"{x}:b"] for x in ("mean", "rows", "excludes_zero")] == [False] * 3
    assert [got[f"{x}:c"] for x in ("mean", "rows", "excludes_zero")] == [False, False, True]


def plain_digest(texts):
    level = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    for _ in range(reporting.LEVELS):
        level = [hashlib.sha256("".join(level[i : i + reporting.WIDTH]).encode()).hexdigest() for i in range(0, len(level), reporting.WIDTH)]
    return level[0][:16]


def test_digest_depends_on_order_and_not_on_partitions(spark):
    texts = [f"row {i * 7919 % 2503}" for i in range(2503)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = reporting.digest(df.repartition(7), "i", F.col("t")).first()
    assert (got["n_rows"], got["digest"]) == (2503, plain_digest(texts))
    assert reporting.digest(df.withColumn("i", -F.col("i")), "i", F.col("t")).first()["digest"] == plain_digest(texts[::-1])


def test_digest_of_ties_nulls_and_nothing(spark):
    rows = [(1, "b"), (1, "a"), (None, None), (1, "a")]
    one = reporting.digest(spark.createDataFrame(rows, "i long, t string"), "i", F.col("t")).first()["digest"]
    again = reporting.digest(spark.createDataFrame(rows[::-1], "i long, t string").repartition(3), "i", F.col("t")).first()["digest"]
    assert one == again
    nothing = reporting.digest(spark.createDataFrame([], "i long, t string"), "i", F.col("t")).first()
    assert (nothing["n_rows"], nothing["digest"]) == (0, hashlib.sha256(b"").hexdigest()[:16])


def test_file_digests(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"")
    got = {r["file"]: (r["n_bytes"], r["file_sha256"]) for r in io.file_digests(spark, [str(tmp_path)]).collect()}
    assert got == {"a.bin": (3, hashlib.sha256(b"abc").hexdigest()[:16])}


def plain_bootstrap(diffs, draws, seed=0):
    a, c, m = stats.LCG
    diffs, n, means = sorted(diffs), len(diffs), []
    for d in range(draws):
        x, total = int(hashlib.md5(f"{seed}:{d}".encode()).hexdigest()[:7], 16), 0.0
        for _ in range(n):
            x = (a * x + c) % m
            total += diffs[x * n // m]
        means.append(total / n)
    means.sort()
    ge, le = sum(x >= 0 for x in means) / draws, sum(x <= 0 for x in means) / draws
    return sum(diffs) / n, means[int(0.025 * draws)], means[int(0.975 * draws)], max(min(2 * min(ge, le), 1.0), 1 / draws)


def test_bootstrap_by_place_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(stats, "PLACES", 16)
    rng = random.Random(5)
    groups = {"many": [float(rng.choice((-1, 0, 0, 1))) for _ in range(61)], "one": [1.0]}
    rows = [(g, d) for g, ds in groups.items() for d in ds] + [("none", None), ("many", None)]
    got = by(stats.bootstrap_lcg(spark.createDataFrame(rows, "g string, d double"), "g", "d", 300), "g")
    for g, ds in groups.items():
        assert [got[g,][c] for c in ("mean", "low", "high", "p")] == pytest.approx(plain_bootstrap(ds, 300))
        assert got[g,]["n"] == len(ds)
    assert [got["none",][c] for c in ("n", "mean", "low", "high", "p")] == [0, 0, 0, 0, 1]


def test_bootstrap_forms_agree(spark):
    rows = [("g", float(x)) for x in [1] * 30 + [0] * 150 + [-1] * 20]
    df = spark.createDataFrame(rows, "g string, d double")
    a, b = stats.bootstrap_lcg(df, "g", "d").first(), stats.bootstrap(df, "g", "d").first()
    assert a["low"] == pytest.approx(b["low"], abs=0.01) and a["high"] == pytest.approx(b["high"], abs=0.01) and a["p"] == pytest.approx(b["p"], abs=0.03)


def test_whole_family_of_deltas(spark):
    rows = [(f"c{c}", q, f"t{q % 3}", a, q % 2, 1) for c in range(4) for q in range(6) for a in "xyz"]
    df = spark.createDataFrame(rows, "config string, qid int, type string, arm string, s int, h int")
    pairs = stats.delta_family(df, [("x", "y"), ("x", "z"), ("y", "z")], ["s", "h"])
    more = stats.contrast_family(df, [("0-1", "c0", "c1"), ("2-3", "c2", "c3"), ("0-2", "c0", "c2")], "s")
    assert pairs.unionByName(more).select("family").distinct().count() == 105
    lacking = stats.contrast_family(df.filter("NOT (config = 'c1' AND qid = 0)"), [("0-1", "c0", "c1")], "s")
    assert lacking.groupBy("family").count().select("count").distinct().collect()[0][0] == 5


def test_token_counts_by_a_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", None, "Hello, world! " * 50, "déjà vu\n\n  42", "x" * 5000]
    got = chunking.token_counts(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "i", "t", lambda: chunking.FileCounter(path))
    model = Tokenizer.from_file(path)
    assert {r["doc"]: r["n_tokens"] for r in got.collect()} == {i: len(model.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    with pytest.raises(Exception, match="canary"):
        chunking.token_counts(spark.createDataFrame([(1, "a")], "i long, t string"), "i", "t", lambda: chunking.FileCounter(path), ("abc", 99)).collect()


def test_subword_packing_keeps_every_sentence(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    body = " ".join(f"Sentence number {i} is here." for i in range(200)) + " " + "word " * 300 + "end."
    docs = spark.createDataFrame([(1, "Title", body)], "i long, t string, b string")
    got = chunking.pack_counted(docs, "i", "t", "b", 60, lambda: chunking.FileCounter(path)).orderBy("chunk_index").collect()
    counter = chunking.FileCounter(path)
    soft = [r for r in got if not r["hard_split"]]
    assert all(r["n_tokens"] == counter.count(r["text"]) <= 60 for r in soft)
    joined = " ".join(r["text"].removeprefix("Title\n\n") for r in soft)
    assert [f"Sentence number {i} is here." in joined for i in range(200)] == [True] * 200
    assert any(r["hard_split"] for r in got)


def test_mini_evaluation(spark):
    rows = [(["Ja!"], True, "nein", "Insufficient information", "ja"), (["x"], False, "x", "INSUFFICIENT-information.", "no"), (["Ja!"], True, "", "Ja, ja", "ja"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "golds array<string>, found boolean, closed string, rag string, ablated string")
    got = {r["metric"]: r["value"] for r in reporting.mini_evaluation(df, "closed", "rag", "ablated", "golds", "found", "insufficient information").collect()}
    assert (got["questions"], got["base_containment"], got["arm_containment"], got["arm_abstained"]) == (4, 25, 25, 50)
    assert (got["delta_pp"], got["mcnemar_p"]) == (0, 1)
    assert (got["abstained_when_retrieved"], got["abstained_when_missed"]) == (50, 50)
    assert (got["refusals_that_answer"], got["of_them_contained"], got["constant_containment"]) == (2, 1, 50)
    none = {r["metric"]: r["value"] for r in reporting.mini_evaluation(df.limit(0), "closed", "rag", "ablated", "golds", "found", "x").collect()}
    assert none["questions"] == 0 and none["delta_pp"] is None


def test_pair_table(spark):
    rows = [("c1/all/x-y/s", 2.0, True), ("c1/all/x-z/s", 1.0, False), ("c1/t0/x-y/s", 9.0, True), ("0-1/x/s", 5.0, True)]
    got = reporting.pair_table(spark.createDataFrame(rows, "family string, delta double, significant boolean"), ["x-y", "x-z"]).collect()
    assert [r.asDict() for r in got] == [{"config": "c1", "metric": "s", "x-y_delta": 2.0, "x-y_significant": True, "x-z_delta": 1.0, "x-z_significant": False}]


def test_table_function_in_sql(spark):
    docs = spark.createDataFrame([(1, "T", "One two. Three four five. Six."), (2, "", ""), (3, None, "a " * 30)], "i long, t string, b string")
    by_function = chunking.pack_table(docs, "i", "t", "b", 5).collect()
    by_fold = chunking.pack(docs, "i", "t", "b", 5).collect()
    assert sorted(map(tuple, by_function)) == sorted(map(tuple, by_fold)) and len(by_fold) > 4
    assert spark.sql("SELECT * FROM pack_chunks('', null, array(named_struct('text', 'a', 'starts_paragraph', true)), 5)").count() == 0


def test_longest_match(spark):
    cut = chunking.LongestMatch(["ab", "abc", "cd"])
    assert cut("abcd abx") == ["abc", "d", " ", "ab", "x"] and cut("") == [] and chunking.LongestMatch([])("ab") == ["a", "b"]
    docs = spark.createDataFrame([(1, "abcd, ab"), (2, None), (3, "")], "i long, t string")
    got = {r["doc"]: r["tokens"] for r in chunking.segments(docs, "i", "t", lambda: chunking.LongestMatch(["ab", "abc"])).collect()}
    assert got == {1: ["abc", "d", "ab"], 2: [], 3: []}


def test_chunk_coverage(spark):
    units = spark.createDataFrame([(1, True), (2, True), (3, False), (4, None)], "chunk int, ok boolean")
    mentions = spark.createDataFrame([(1, "A"), (1, "B"), (2, " "), (3, "C"), (9, "D")], "chunk int, name string")
    assert tuple(graph.coverage(mentions, units).first()) == (4, 2, 1)


def test_extraction_gates(spark):
    rows = [("a", True, 10.0), ("a", True, 89.9), ("b", True, 1.0), ("b", False, 2.0), ("c", True, 1.0), ("c", True, 90.0), ("d", True, 1.0), ("e", None, 1.0), ("e", True, None)]
    df = spark.createDataFrame(rows, "g string, v boolean, s double")
    got = by(reporting.extraction_gates(df, "g", F.col("v"), F.col("s"), 2, 90, F.lit(7200)), "g")
    assert {k[0]: (v["all_valid"], v["in_time"], v["passed"]) for k, v in got.items()} == {"a": (True, True, True), "b": (False, True, False), "c": (True, False, False), "d": (False, True, False), "e": (False, False, False)}
    assert got["b",]["hours"] == 3 and got["b",]["valid_rate"] == 0.5
