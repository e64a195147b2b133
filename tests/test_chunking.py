import random
import re

import pytest
from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.operators import chunking, graph, retrieval


class Joined:
    """Counts words and, behind the second, one more for each join: parts never add up."""

    def count(self, text):
        return len(text.split()) + max(0, text.count(" ") - 1)

    def pieces(self, text, room):
        words = text.split()
        return [" ".join(words[i : i + room]) for i in range(0, len(words), room)]


def documents(rng, n=30, longest=30):
    rows = []
    for i in range(n):
        paragraphs = ["\n".join(" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randint(1, longest))) + "." for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 3))]
        rows.append((i, "a title" if i % 2 else None, "\n\n".join(paragraphs)))
    return rows


def test_sentences_are_trimmed_and_keep_their_digits(spark):
    row = spark.createDataFrame([("0 a. 1 b. 2 c!\n 3 d \n\n  4 e",)], "t string").select(tx.sentences(F.col("t")).alias("s")).first()
    assert [(s.text, s.starts_paragraph) for s in row.s] == [("0 a.", True), ("1 b.", False), ("2 c!", False), ("3 d", False), ("4 e", True)]


def test_long_sentences_get_chunks_of_their_own(spark):
    docs = spark.createDataFrame([(1, "t", "a b c. d-e f g h i. j k.\n\nl."), (2, "one two three four five", "gone."), (3, "t", "  \n "), (4, None, "x"), (5, "", None)], "id long, title string, body string")
    got = [tuple(r)[1:] for r in chunking.pack(docs, "id", "title", "body", 5).filter("doc = 1").orderBy("chunk_index").collect()]
    assert got == [
        (0, "t\n\na b c.", 4, 0, 6, False),
        (1, "t\n\nd-e f g", 5, -1, -1, True),
        (2, "t\n\nh i.", 3, -1, -1, True),
        (3, "t\n\nj k. l.", 4, 20, 28, False),
    ]
    assert {r.doc for r in chunking.pack(docs, "id", "title", "body", 5).collect()} == {1, 4}
    assert tuple(chunking.dropped(docs, "id", "title", "body", 5).first()) == (3, 1)
    assert chunking.pack(docs.limit(0), "id", "title", "body", 5).count() == 0


def test_words_pack_alike_in_both_forms(spark):
    class Words:
        def count(self, text):
            return len(text.split())

        pieces = Joined.pieces

    docs = spark.createDataFrame(documents(random.Random(3)), "id long, title string, body string")
    for budget in (9, 20, 60):
        a = chunking.pack(docs, "id", "title", "body", budget).orderBy("doc", "chunk_index").collect()
        b = chunking.pack_counted(docs, "id", "title", "body", budget, Words).orderBy("doc", "chunk_index").collect()
        assert a == b and all(r.n_tokens <= budget for r in a)


def test_recounted_chunks_keep_every_sentence(spark):
    rows = documents(random.Random(4), longest=9)
    docs = spark.createDataFrame(rows, "id long, title string, body string")
    got = chunking.pack_counted(docs, "id", "title", "body", 20, Joined).orderBy("doc", "chunk_index").collect()
    assert max(r.n_tokens for r in got) <= 20
    for i, title, body in rows:
        own = [r for r in got if r.doc == i]
        head = f"{title}\n\n" if title else ""
        assert [r.chunk_index for r in own] == list(range(len(own)))
        assert " ".join(r.text.removeprefix(head) for r in own).split() == body.split()
        assert all(body[r.char_start : r.char_end].split() == r.text.removeprefix(head).split() for r in own)


def test_byte_counter_cuts_whole_characters():
    c = chunking.ByteCounter(2)
    assert "".join(c.pieces("aé€x" * 9, 2)) == "aé€x" * 9 and max(map(c.count, c.pieces("aé€x" * 9, 2))) <= 2
    assert c.pieces("", 3) == [] and c.pieces("€", 1) == ["€"]


def test_canary_stops_another_tokenizer(spark):
    docs = spark.createDataFrame([(1, "t", "a b.")], "id long, title string, body string")
    assert chunking.pack_counted(docs, "id", "title", "body", 20, Joined, ("a b c", 4)).count() == 1
    with pytest.raises(Exception, match="canary"):
        chunking.pack_counted(docs, "id", "title", "body", 20, Joined, ("a b c", 3)).collect()


@pytest.mark.parametrize("block,scores,pairs", [(1024, 1 << 22, 1_000_000), (4, 20, 40)])
def test_index_is_verified_where_documents_lie(spark, monkeypatch, block, scores, pairs):
    monkeypatch.setattr(retrieval, "SCORES", scores)
    monkeypatch.setattr(retrieval, "PAIRS", pairs)
    rng = random.Random(5)
    make = lambda n, k: [(i, " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(k)))) for i in range(n)]
    docs = spark.createDataFrame([*make(50, 30), (70, None), (71, ""), (72, "only here")], "id long, text string")
    asked = spark.createDataFrame([*make(9, 5), (50, None), (51, "nowhere"), (52, "w1 w1 nowhere")], "id long, text string")
    tokens = tx.latin_tokens(F.col("text"))
    want = {r.qid: r.n for r in retrieval.bm25(retrieval.index(docs, "id", tokens)[0], asked, "id", tokens).groupBy("qid").agg(F.count("*").alias("n")).collect()}
    check = lambda: {r.qid: (r.n, r.differing) for r in retrieval.verified(docs, "id", tokens, asked, "id", block=block).collect()}
    assert check() == {q: (n, 0) for q, n in want.items()} and len(want) > 5
    # Pairs aren't shuffled: texts are dealt out by their id, and counts (and the queries' own terms) by the query.
    monkeypatch.setattr(retrieval, "few", F.broadcast)
    plan = retrieval.verified(docs, "id", tokens, asked, "id")._jdf.queryExecution().executedPlan().toString()
    assert sorted(re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\((.+?), \d+\)", plan)) == ["id", "id", "qid", "qid, term"]
    # A score that is wrong, or one that is missing, is found.
    right = retrieval.bm25
    monkeypatch.setattr(retrieval, "bm25", lambda *a: right(*a).filter("NOT (qid = 52 AND doc < 10)").withColumn("score", F.col("score") + F.when(F.col("doc") == 20, 1e-6).otherwise(0)))
    lost = {(r.qid, r.doc) for r in right(retrieval.index(docs, "id", tokens)[0], asked, "id", tokens).filter("doc = 20 OR qid = 52 AND doc < 10").collect()}
    assert check() == {q: (n, sum(q == x for x, _ in lost)) for q, n in want.items()} and len(lost) > 3


def test_direct_scores_are_those_of_the_index(spark):
    rng = random.Random(5)
    make = lambda n, k: spark.createDataFrame([(i, " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(k)))) for i in range(n)], "id long, text string")
    docs, asked, tokens = make(50, 30), make(9, 5), tx.latin_tokens(F.col("text"))
    weighted, corpus = retrieval.index(docs, "id", tokens)
    want = {(r.qid, r.doc): r.score for r in retrieval.bm25(weighted, asked, "id", tokens).collect()}
    idf = weighted.select("term", "idf").distinct()
    got = {(r.qid, r.doc): r.score for r in retrieval.direct(docs, "id", tokens, asked, "id", idf, corpus, block=4).collect()}
    assert got == pytest.approx(want) and retrieval.direct(docs, "id", tokens, asked.limit(0), "id", idf, corpus).count() == 0


def test_mentions_without_a_name_are_none(spark):
    m = spark.createDataFrame([(" A  b ",), (" ",), (None,)], "name string")
    assert [r.name for r in graph.normalised(m).collect()] == ["a b"]


def test_integrity_sees_what_is_lost_and_doubled(spark):
    docs = spark.createDataFrame([(1, "T", "One two. Three four. Five six."), (2, None, "Seven eight. Nine."), (3, "a b c d", "Gone now.")], "id long, title string, body string")
    rows = lambda c, n: {r.doc: tuple(r)[1:] for r in chunking.integrity(docs, c, "id", "title", "body", n).collect()}
    packed = chunking.pack(docs, "id", "title", "body", 4)
    assert rows(packed, 4) == {1: (3, 0, 0, 3, 0), 2: (2, 0, 0, 1, 0), 3: (1, 1, 0, 0, 0)}
    bad = packed.filter("doc != 1 OR chunk_index != 1").unionByName(packed.filter("doc = 2").withColumn("chunk_index", F.lit(9)))
    assert rows(bad, 2) == {1: (3, 1, 0, 2, 2), 2: (2, 0, 2, 2, 2), 3: (1, 1, 0, 0, 0)}
    s = chunking.statistics(packed, docs, "id", "title", "body", 4).first()
    assert (s.chunks, s.mean, s.fill_rate, s.hard_splits, s.over_budget) == (4, 3.0, 0.75, 0, 0) and s.chars_per_token == pytest.approx(57 / 11)


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_of_a_tokenizer_file_join_to_the_text(file):
    """Cuts lie between characters, also where a character is many tokens, and a piece counts no more than it may."""
    import public_tokenizers

    counter = chunking.FileCounter(public_tokenizers.path(file))
    for text in ["日本語の文章🙂ぁ龘龗 and words", "plain words, only words. " * 9, "🙂" * 20, "a", "  lead and trail  ", "éé ‍ x"]:
        for room in (1, 2, 5, 40):
            pieces = counter.pieces(text, room)
            assert "".join(pieces) == text and all(pieces)
            assert all(counter.count(p) <= room + 1 or len(p.strip()) <= 2 for p in pieces), (room, pieces)


def test_hard_pieces_keep_to_the_budget_with_their_title(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    body = "日本語の文章🙂ぁ龘龗" * 12 + " x" * 90
    docs = spark.createDataFrame([(1, "A title of some words", body)], "doc long, title string, body string")
    counter = chunking.FileCounter(path)
    got = sorted(chunking.pack_counted(docs, "doc", "title", "body", 24, lambda: chunking.FileCounter(path)).collect(), key=lambda r: r.chunk_index)
    assert all(r.hard_split and r.n_tokens == counter.count(r.text) <= 24 for r in got)
    assert "".join(r.text.removeprefix("A title of some words\n\n") for r in got) == body
