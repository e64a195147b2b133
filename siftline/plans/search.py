"""Queries over a stream of vectors, over vectors with rights, and over learned dictionaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import cells, chunking, leaders, retrieval, segmenting
from ..sources import io
from .queries import _DOCS, _LATIN, _SCORED, _gold, _with, query

# Leader clusters ------------------------------------------------------------------------------

#: The cosine within which a leader covers a vector.
_RADIUS = 0.3
_LEAD = f"""v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS i, [CAST(x AS DOUBLE) / (sqrt(list_sum([CAST(y AS DOUBLE) * y FOR y IN embedding])) + 1e-12) FOR x IN embedding] AS u FROM embeddings),
s AS (SELECT a.i, b.i AS j, round(list_dot_product(a.u, b.u), 9) AS sim FROM v a JOIN v b ON b.i < a.i WHERE round(list_dot_product(a.u, b.u), 9) >= {_RADIUS}),
near AS (SELECT i, list(j) AS js FROM s GROUP BY i),
rec AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS lead UNION ALL SELECT rec.i + 1, CASE WHEN list_has_any(coalesce(js, CAST([] AS BIGINT[])), lead) THEN lead ELSE list_append(lead, rec.i + 1) END FROM rec LEFT JOIN near ON near.i = rec.i + 1 WHERE rec.i < (SELECT count(*) FROM v)),
l AS (SELECT unnest(lead) AS i FROM (SELECT lead FROM rec ORDER BY i DESC LIMIT 1)),
c AS (SELECT v.i, v.vec_id, v.label, CASE WHEN v.i IN (FROM l) THEN v.vec_id ELSE (SELECT w.vec_id FROM s JOIN v w ON w.i = s.j WHERE s.i = v.i AND s.j IN (FROM l) ORDER BY sim DESC, s.j LIMIT 1) END AS leader, CASE WHEN v.i IN (FROM l) THEN 1.0 ELSE (SELECT max(sim) FROM s WHERE s.i = v.i AND s.j IN (FROM l)) END AS similarity FROM v)"""


def _stream(t):
    return leaders.stream(t("embeddings"), "vec_id", "vec_id", "embedding")


@query("l1c_leader_clusters", f"WITH RECURSIVE {_LEAD} SELECT vec_id, leader, round(similarity, 6) AS similarity FROM c")
def _(t):
    return leaders.clusters(_stream(t), _RADIUS).select(F.col("id").alias("vec_id"), "leader", F.round("similarity", 6).alias("similarity"))


_CREDIT = """, pool AS (SELECT l_orderkey AS qid, l_partkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_partkey) AS rank FROM lineitem GROUP BY l_orderkey, l_partkey), gold AS (SELECT DISTINCT l_orderkey AS qid, l_partkey AS doc FROM lineitem WHERE l_returnflag = 'R'),
q AS (SELECT o_orderkey AS qid, leader AS cluster FROM orders JOIN c ON vec_id = o_orderkey % (SELECT count(*) FROM embeddings)),
cr AS (SELECT cluster, doc, count(gold.qid) AS credited, count(*) AS surfaced FROM pool JOIN q USING (qid) LEFT JOIN gold USING (qid, doc) WHERE qid % 10 < 6 AND rank <= 5 GROUP BY cluster, doc)"""
_BOOSTED = ", m AS (SELECT qid, doc, rank, count(*) OVER (PARTITION BY qid) AS m FROM pool WHERE qid % 10 > 5), b AS (SELECT qid, doc, (m - rank + 1) / m + 0.3 * ln((1 + coalesce(credited, 0)) / (1 + coalesce(surfaced, 0))) AS score FROM m LEFT JOIN q USING (qid) LEFT JOIN cr USING (cluster, doc))"


def _credit(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("doc"), "l_linenumber", "l_returnflag")
    first = lines.groupBy("qid", "doc").agg(F.min("l_linenumber").alias("at"))
    pool = first.select("qid", "doc", F.row_number().over(Window.partitionBy("qid").orderBy("at", "doc")).alias("rank"))
    n = t("embeddings").count()
    own = leaders.clusters(_stream(t), _RADIUS).select(F.col("id").alias("vec_id"), F.col("leader").alias("cluster"))
    cluster = t("orders").select(F.col("o_orderkey").alias("qid"), (F.col("o_orderkey") % n).alias("vec_id")).join(own, "vec_id").select("qid", "cluster")
    credit = leaders.credit_by_cluster(pool.filter("qid % 10 < 6 AND rank <= 5"), lines.filter("l_returnflag = 'R'"), cluster)
    return pool, cluster, credit


@query("l1c_cluster_credit", f"WITH RECURSIVE {_LEAD}{_CREDIT} SELECT cluster, doc, credited, surfaced FROM cr")
def _(t):
    return _credit(t)[2]


@query("l1c_boosted_rank", f"WITH RECURSIVE {_LEAD}{_CREDIT}{_BOOSTED} SELECT qid, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM b")
def _(t):
    pool, cluster, credit = _credit(t)
    return leaders.reranked(pool.filter("qid % 10 > 5"), cluster, credit).withColumn("score", F.round("score", 6))


# Semantic cache ---------------------------------------------------------------------------------


@query("l2_semantic_cache", f"WITH RECURSIVE {_LEAD} SELECT vec_id, CASE WHEN leader <> vec_id THEN leader END AS served, CASE WHEN leader <> vec_id THEN round(similarity, 6) END AS similarity FROM c")
def _(t):
    return leaders.cache(_stream(t), _RADIUS).select(F.col("id").alias("vec_id"), "served", F.round("similarity", 6).alias("similarity"))


@query("l2_cache_hits", f"WITH RECURSIVE {_LEAD} SELECT c.label, count(*) AS n, count(*) FILTER (c.leader <> c.vec_id) AS hits, count(*) FILTER (c.leader <> c.vec_id AND w.label = c.label) AS right_answers FROM c JOIN v w ON w.vec_id = c.leader GROUP BY c.label")
def _(t):
    """An answer is the label of the row that serves it."""
    label = t("embeddings").select("vec_id", "label")
    found = leaders.cache(_stream(t), _RADIUS).join(label.withColumnRenamed("vec_id", "id"), "id")
    found = found.join(label.select(F.col("vec_id").alias("served"), F.col("label").alias("answer")), "served", "left")
    return found.groupBy("label").agg(F.count("*").alias("n"), F.count("served").alias("hits"), F.count_if(F.col("answer") == F.col("label")).alias("right_answers"))


# Rights ---------------------------------------------------------------------------------------

_SEEN = "WITH e AS (SELECT vec_id, embedding, (1 << label) | CASE WHEN vec_id % 7 = 0 THEN 1024 ELSE 0 END AS access, (1 << label) | (1 << ((label + 3) % 10)) AS clearance FROM embeddings), s AS (SELECT q.vec_id AS qid, d.vec_id AS doc, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(d.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])))) AS score FROM e q JOIN e d ON q.vec_id % 20 = 0 AND (d.access & q.clearance) <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM s)"


def _permitted(t):
    bit = lambda c: F.expr(f"shiftleft(1L, CAST({c} AS INT))")
    public = F.when(F.col("vec_id") % 7 == 0, F.lit(1024)).otherwise(F.lit(0)).cast("long")
    v = t("embeddings").withColumns({"access": bit("label").bitwiseOR(public), "clearance": bit("label").bitwiseOR(bit("(label + 3) % 10"))})
    centres = cells.fit(v, "vec_id", "embedding")
    table = cells.index(v, centres)
    asked = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"), "clearance")
    return cells.permitted(table, centres, asked, 10)


@query("r16_permitted_top10", f"{_SEEN} SELECT qid, doc, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def _(t):
    return _permitted(t)[0].select("qid", "doc", F.round("score", 6).alias("score"), "rank")


# Learned dictionaries ---------------------------------------------------------------------------


@query("t4_corpus_dictionary", "SELECT w AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents) WHERE length(w) <= 24 GROUP BY w ORDER BY n DESC, w LIMIT 200000")
def _(t):
    return segmenting.dictionary(t("documents"), "text")


@query("t4_best_path_segments")
def _(t):
    """Texts without their blanks, cut by the dictionary of the texts with them."""
    docs = t("documents")
    cut = segmenting.BestPath((r.term, r.n) for r in segmenting.dictionary(docs, "text").collect())
    sent = docs.sparkSession.sparkContext.broadcast(cut)
    bare = docs.select("doc_id", F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_]+", "").alias("text"))
    return chunking.segments(bare, "doc_id", "text", lambda: sent.value).select("doc", F.size("tokens").cast("long").alias("n"))


_STOPS = """t AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}][\\p{L}\\p{N}_.''’-]*')) AS w FROM documents),
k AS (SELECT CASE WHEN stop THEN left(w, length(w) - 1) ELSE w END AS type, count(*) AS n, CAST(sum(CAST(stop AS INT)) AS BIGINT) AS k FROM (SELECT w, w LIKE '%.' AND w NOT LIKE '%..' AS stop FROM t) GROUP BY ALL),
p AS (SELECT sum(k) / sum(n) AS p FROM k),
r AS (SELECT type, n, k, length(type) - length(regexp_replace(type, '[^.]', '', 'g')) AS size, length(regexp_replace(type, '[^.]', '', 'g')) AS stops, 2 * (k * ln(0.99) + CASE WHEN n = k THEN 0 ELSE (n - k) * ln(1 - 0.99) END - k * ln(p) - CASE WHEN n = k THEN 0 ELSE (n - k) * ln(1 - CASE WHEN n = k THEN 0 ELSE p END) END) AS ratio FROM k, p WHERE k > 0 AND regexp_matches(type, '\\p{L}')),
a AS (SELECT type, n, k, ratio * exp(-size) * (stops + 1) * pow(size, -(n - k)) AS score FROM r)"""


@query("t6_abbreviations", f"WITH {_STOPS} SELECT type, n, k, round(score, 6) AS score FROM a WHERE score >= 0.3")
def _(t):
    return segmenting.abbreviations(t("documents"), "text").withColumn("score", F.round("score", 6))


_WHOLE = f"""WITH {_STOPS},
d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\r\\n\\f\\v]+[ \\t\\r\\n\\f\\v]*')) AS s, generate_subscripts(regexp_extract_all(text, '[^ \\t\\r\\n\\f\\v]+[ \\t\\r\\n\\f\\v]*'), 1) AS i FROM documents),
w AS (SELECT doc_id, i, s, regexp_replace(s, '[ \\t\\r\\n\\f\\v]+$', '') AS w FROM d),
b AS (SELECT doc_id, i, s, contains(s, chr(10)) OR (s <> w AND regexp_matches(w, '[.!?]$') AND NOT coalesce(lower(regexp_extract(w, '([\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}_.''’-]*)\\.$', 1)) IN (SELECT type FROM a WHERE score >= 0.3), false)) AS ends FROM w),
g AS (SELECT doc_id, i, s, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM b),
x AS (SELECT doc_id, length(regexp_replace(string_agg(s, '' ORDER BY i), '[ \\t\\r\\n\\f\\v]+$', '')) AS n FROM g GROUP BY doc_id, g)
SELECT doc_id, count(*) AS n_sentences, CAST(sum(n) AS BIGINT) AS n_chars FROM x GROUP BY doc_id"""


@query("t6_whole_sentences", _WHOLE)
def _(t):
    docs = t("documents")
    known = [r.type for r in segmenting.abbreviations(docs, "text").collect()]
    s = docs.select("doc_id", F.explode(segmenting.whole_sentences(F.col("text"), known)).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("s.text")).alias("n_chars"))


# Arms and corpora -------------------------------------------------------------------------------

_PLACE = "CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % 100"
_IN_GOLD = "doc_id IN (SELECT d.doc_id FROM benchmark b, documents d WHERE contains(d.text, b.text))"


def _curve_sql(share: int) -> str:
    corpus = f"(SELECT * FROM documents WHERE {_IN_GOLD} OR {_PLACE} < {share})"
    ranked = _with(_DOCS, _SCORED, **_LATIN).replace("FROM documents)", f"FROM {corpus} c)")
    per = f"SELECT g.qid, count(r.rank) / count(*) AS recall, coalesce(sum(1 / log2(r.rank + 1.0)), 0) / list_sum([1 / log2(i + 1.0) FOR i IN range(1, least(count(*), 10) + 1)]) AS ndcg FROM g LEFT JOIN ranked r ON r.qid = g.qid AND r.doc = g.doc AND r.rank <= 10 GROUP BY g.qid"
    return f"({ranked}, g AS (SELECT item_id AS qid, doc_id AS doc FROM benchmark b, documents d WHERE contains(d.text, b.text)), per AS ({per}) SELECT {share} AS share, (SELECT n FROM corpus) AS docs, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM per)"


_SHARES = [25, 50, 100]


@query("a29_corpus_size_curve", " UNION ALL ".join(map(_curve_sql, _SHARES)))
def _(t):
    """The share of a corpus's other documents beside those that hold an item; the last corpus is whole."""
    docs = t("documents")
    place = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("long") % 100
    curve = retrieval.size_curve(docs, "doc_id", tx.latin_tokens(F.col("text")), t("benchmark"), "item_id", io.kept(_gold(t), "gold"), place, _SHARES)
    return curve.withColumns({c: F.round(c, 6) for c in ("recall", "ndcg")})


@query("a30_structured_arm", "SELECT source || ' ' || lang AS qid, count(*) AS answer FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang UNION ALL SELECT 'other ' || lang, NULL FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) UNION ALL SELECT 'nobody ' || lang, 0 FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def _(t):
    """Questions made of the table's own sources and languages; of another form, and about nobody."""
    docs = t("documents").select("source", "lang")
    known = docs.filter("source IS NOT NULL AND lang IS NOT NULL").distinct()
    ask = lambda who, text: F.struct(F.concat_ws(" ", who, "lang").alias("qid"), F.format_string(text, who, F.col("lang")).alias("text"))
    form = "How many documents did %s publish in %s?"
    questions = known.select(ask(F.col("source"), form).alias("q"))
    for who, text in (("other", "What does %s say in %s?"), ("nobody", form)):
        questions = questions.unionAll(known.select("lang").distinct().select(ask(F.lit(who), text).alias("q")))
    return retrieval.structured(questions.select("q.*"), docs, r"^How many documents did (\S+) publish in (\S+)\?$", ["source", "lang"])
