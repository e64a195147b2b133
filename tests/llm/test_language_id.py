import numpy as np
import pytest

from siftline.llm import language_id as op


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return op.train(docs)


def best_value(s, switch):
    v = s[0].copy()
    for row in s[1:]:
        v = np.maximum(v, v.max() - switch) + row
    return v.max()


def value(s, path, switch):
    return s[np.arange(len(path)), path].sum() - switch * (np.diff(path) != 0).sum()


def test_paths_are_best_with_and_without_the_shortcut():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = rng.integers(0, 12, 6)
        s = rng.normal(size=(lengths.sum(), rng.integers(2, 5))) * rng.choice([0.5, 3])
        for way in (op.label, op.viterbi):
            path, at = way(s, lengths, 2.0), 0
            for n in lengths:
                if n:
                    assert value(s[at : at + n], path[at : at + n], 2.0) == pytest.approx(best_value(s[at : at + n], 2.0))
                at += n


def test_held_out_accuracy(docs, model):
    rows = op.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows) > 200
    assert all(0 <= r.score <= 1 for r in rows)


def test_spans_of_mixed_text(model):
    labeller = op.Labeller(model)
    words = "the and that with was then this for of to is are in it on at by from".split() * 2 + "der die und das nicht mit sich auf den von ein eine ist zu auch als".split() * 2
    spans = op.spans(labeller.scores[labeller.rows_of(words)].astype(float), np.array([len(words)]))[0]
    assert [model.languages[k] for *_, k in spans] == ["en", "de"] and abs(spans[0][1] - 36) <= 2


def test_scripts_narrow_candidates(spark):
    rows = [(3 * i, "привет мир это слово", "ru") for i in range(60)] + [(3 * i + 1, "hello world this word", "en") for i in range(60)]
    model = op.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    s = model.score(["мама", "mama", "日本"])
    ru, en = model.languages.index("ru"), model.languages.index("en")
    assert s[0][ru] > s[0][en] + op.SWITCH and s[1][en] > s[1][ru] + op.SWITCH and s[2][ru] == s[2][en]


def test_odd_rows(odd, odd_rows, none, model):
    got = op.identify(odd, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in odd_rows)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (3, 4, 11))
    assert all(r.lang_pred in model.languages for r in got if r.doc_id in (1, 2, 5, 10))
    assert op.identify(none, model).count() == 0


def test_no_letters_and_no_training_rows(spark, odd, none, model):
    rows = spark.createDataFrame([(1, "12 ² ½ ..."), (2, "²a")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in op.identify(rows, model).collect()}
    assert got[1] == "und" and got[2] in model.languages
    assert {r.lang_pred for r in op.identify(odd, op.train(none)).collect()} == {"und"}


def test_spans_and_scores_as_plain_viterbi(spark, docs, model):
    """The query's rows against the paths of viterbi() alone, and spans that cover the text."""
    mixed = [(1, "the and that with was then this for of to is are in it " * 3 + "İ der die und das nicht mit sich auf den von ein eine ist zu " * 3), (2, "12 -")]
    rows = [tuple(r) for r in docs.select("doc_id", "text").limit(300).collect()] + mixed
    got = op.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    labeller, many = op.Labeller(model), 0
    for (_, text), r in zip(rows, got, strict=True):
        words = [w for w in op._WORD.findall((text or "").lower()) if any(c.isalpha() for c in w)]
        if not words:
            assert (r.lang_pred, r.score, r.lang_spans) == ("und", 0.0, "")
            continue
        at = labeller.rows_of(words)
        path = op.viterbi(labeller.scores[at].astype(float), np.array([len(words)]), op.SWITCH)
        letters = [sum(map(str.isalpha, w)) for w in words]
        share = np.bincount(path, letters, len(model.languages))
        assert r.lang_pred == model.languages[share.argmax()] and r.score == pytest.approx(share.max() / sum(letters))
        spans = [x.split(":") for x in r.lang_spans.split(",")]
        assert [x[0] for x in spans] == [model.languages[path[0]], *(model.languages[b] for a, b in zip(path, path[1:]) if a != b)]
        assert spans[0][1] == "0" and int(spans[-1][2]) == len(text) and all(a[2] == b[1] for a, b in zip(spans, spans[1:]))
        many += len(spans) > 1
    assert many >= 1
    one = next(r for r in got if r.doc_id == 1 and r.lang_spans.count(":") > 2)
    start = int(one.lang_spans.split(",")[1].split(":")[1])
    assert mixed[0][1][start - 1] == " " and abs(start - mixed[0][1].index("İ")) < 20


def test_training_by_hand(spark):
    """Weights against plain counts; a hot language, id and copies take no more than their share."""
    rows = [(i, f"hello w{i}", "en") for i in range(400)] + [(5000, "again", "en")] * 500 + [(1000 + i, f"hallo v{i}", "de") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = op.train(docs, max_rows=10_000)
    import zlib

    for k, lang in enumerate(model.languages):
        own = {(i, t) for i, t, x in rows if x == lang and zlib.crc32(str(i).encode()) % 3 != 1}
        count = np.zeros(op.BUCKETS)
        for _, t in own:
            for w in op._WORD.findall(t):
                for n in op.GRAMS:
                    for a in range(len(w) + 3 - n):
                        h = 0
                        for c in f" {w} "[a : a + n]:
                            h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) % 2**64
                        count[((h ^ h >> 29) * 0xC2B2AE3D27D4EB4F % 2**64 >> 32) % op.BUCKETS] += 1
        assert np.allclose(model.weights[:, k], np.log(count + op.SMOOTH) - np.log(count.sum() + op.SMOOTH * op.BUCKETS))
    kept = op._sample(docs, 60).collect()
    n = sum(r.lang == "de" for r in kept)
    assert len(kept) <= 60 and 24 <= n <= 30 and len(kept) - n >= 20
