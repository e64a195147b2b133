"""Queries of single relational steps: strict scans, joins, the index's parts, windows, orders and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, graph, retrieval
from .queries import _CLEAN, _DOCS, _EDGE, _LATIN, _LOG, _MENT, _METRIC, _PACKED, _SCORED, _edges, _gold, _log, _mentions, _ranked, _with, query

# Sources ----------------------------------------------------------------------------------------


@query("s2_strict_json", "SELECT doc_id, lang, n_chars FROM documents")
def _(t):
    lines = t("documents").select(F.to_json(F.struct("doc_id", "lang", "n_chars")).alias("line"))
    strict = F.from_json("line", "doc_id long, lang string, n_chars long", {"mode": "FAILFAST"})
    return lines.select(strict.alias("r")).select("r.*")


@query("s4_nested_json", "SELECT conv_id, turn, role FROM conversations")
def _(t):
    whole = t("conversations").groupBy("conv_id").agg(F.to_json(F.struct("conv_id", F.collect_list(F.struct("turn", "role")).alias("turns"))).alias("line"))
    read = whole.select(F.from_json("line", "conv_id long, turns array<struct<turn: long, role: string>>").alias("r"))
    return read.select("r.conv_id", F.inline("r.turns"))


@query("p12_truncated", f"WITH {_LOG} SELECT arm, count(*) AS n, count(*) FILTER (done_reason = 'view') AS truncated FROM log GROUP BY arm")
def _(t):
    return _log(t).groupBy("arm").agg(F.count("*").alias("n"), F.count_if(F.col("done_reason") == "view").alias("truncated"))


# Chunking and prompts ---------------------------------------------------------------------------


@query("t8_canary")
def _(t):
    return chunking.pack_counted(t("benchmark"), "item_id", "item_id", "text", 60, chunking.ByteCounter, ("Zwölf Boxkämpfer", 5))


@query("t8_canary_counts", "SELECT doc_id AS doc, CAST(ceil(strlen(coalesce(text, '')) / 4.0) AS BIGINT) AS n_tokens FROM documents")
def _(t):
    """The counter must count the canary as told before it counts anything."""
    return chunking.token_counts(t("documents"), "doc_id", "text", chunking.ByteCounter, ("Zwölf Boxkämpfer", 5))


#: The fold with a counter of four bytes a token: what a step closes is counted as joined, and the sentences behind the budget wait on.
_RECOUNTED = f"""WITH RECURSIVE d AS (SELECT doc_id AS doc, {_CLEAN.format('source')} AS title, {_CLEAN.format('text')} AS body FROM documents),
h AS (SELECT doc, body, CASE WHEN title = '' THEN '' ELSE title || chr(10) || chr(10) END AS head FROM d WHERE body <> ''),
r AS (SELECT *, strlen(head) AS hb, 300 - (strlen(head) + 3) // 4 AS room FROM h WHERE (strlen(head) + 3) // 4 < 300),
par AS (SELECT doc, generate_subscripts(ps, 1) AS pi, unnest(ps) AS t FROM (SELECT doc, string_split(body, chr(10) || chr(10)) AS ps FROM r)),
sen AS (SELECT doc, pi, list_filter([trim(x) FOR x IN string_split(regexp_replace(t, '([.!?])[ \\t\\r\\n\\f\\v]+', '\\1' || chr(10), 'g'), chr(10))], lambda x: x <> '') AS ss FROM par),
u0 AS (SELECT doc, pi, generate_subscripts(ss, 1) AS si, unnest(ss) AS s FROM sen),
u AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY pi, si) AS i, s, si = 1 AS p, strlen(s) AS b FROM u0),
l AS (SELECT doc, hb, room, list(b ORDER BY i) AS bs, list(p ORDER BY i) AS ps, count(*) AS n FROM u JOIN r USING (doc) GROUP BY doc, hb, room),
f AS (SELECT doc, 0 AS step, CAST(1 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS w, CAST([] AS BIGINT[]) AS closed, CAST(NULL AS BIGINT) AS hard FROM l
  UNION ALL SELECT doc, step + 1, least(i + 1, n + 1), CASE WHEN i > n OR (bs[i] + 3) // 4 > room THEN w[keep + 1:] ELSE list_append(w[keep + 1:], i) END, w[1:keep], CASE WHEN i <= n AND (bs[i] + 3) // 4 > room THEN i END
  FROM (SELECT *, CASE WHEN len(w) = 0 OR NOT (i > n OR used + (bs[i] + 3) // 4 > room OR (ps[i] AND used >= CAST(0.85 AS DOUBLE) * room)) THEN 0
      ELSE greatest(1, coalesce(list_max([k FOR k IN range(1, len(w) + 1) IF (hb + list_sum([bs[x] FOR x IN w[1:k]]) + k - 1 + 3) // 4 <= 300]), 1)) END AS keep
    FROM (SELECT f.*, hb, room, bs, ps, n, coalesce(list_sum([(bs[x] + 3) // 4 FOR x IN w]), 0) AS used FROM f JOIN l USING (doc) WHERE f.i <= n OR len(w) > 0))),
hc AS (SELECT doc, i, room, k, sum(strlen(substr(s, k, 1))) OVER (PARTITION BY doc, i ORDER BY k) AS cb FROM (SELECT doc, i, s, room, unnest(range(1, length(s) + 1)) AS k FROM u JOIN r USING (doc) WHERE (b + 3) // 4 > room)),
hp AS (SELECT DISTINCT doc, i, CAST(0 AS BIGINT) AS a, CAST(0 AS HUGEINT) AS ca FROM hc UNION ALL SELECT hp.doc, hp.i, max(k), CAST(max(cb) AS HUGEINT) FROM hp JOIN hc ON hc.doc = hp.doc AND hc.i = hp.i AND k > a AND cb <= ca + room * 4 GROUP BY hp.doc, hp.i, a),
cuts AS (SELECT doc, i, lag(a) OVER (PARTITION BY doc, i ORDER BY a) AS a, a AS b FROM hp),
whole AS (SELECT f.doc, step, string_agg(s, ' ' ORDER BY u.i) AS text, arg_min(s, u.i) AS first, arg_max(s, u.i) AS last FROM f JOIN u ON u.doc = f.doc AND list_contains(closed, u.i) GROUP BY f.doc, step),
parts AS (SELECT doc, step, CAST(-1 AS BIGINT) AS place, text, first, last FROM whole UNION ALL SELECT f.doc, step, c.a, substr(s, c.a + 1, c.b - c.a), NULL, NULL FROM f JOIN cuts c ON c.doc = f.doc AND c.i = f.hard AND c.a IS NOT NULL JOIN u ON u.doc = f.doc AND u.i = f.hard),
o AS (SELECT parts.*, head, body, place >= 0 AS hard, instr(body, first) AS pos FROM parts JOIN r USING (doc))
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY step, place) - 1 AS INT) AS chunk_index, head || text AS text, CAST((strlen(head || text) + 3) // 4 AS INT) AS n_tokens, CAST(CASE WHEN hard THEN -1 ELSE pos - 1 END AS INT) AS char_start,
  CAST(CASE WHEN hard OR instr(substr(body, greatest(pos, 1)), last) = 0 THEN -1 ELSE greatest(pos, 1) - 2 + instr(substr(body, greatest(pos, 1)), last) + length(last) END AS INT) AS char_end, hard AS hard_split FROM o"""


@query("t10_recounted_packing", _RECOUNTED)
def _(t):
    return chunking.pack_counted(t("documents"), "doc_id", "source", "text", 300, chunking.ByteCounter)


@query("t11_hard_split", "SELECT doc_id, CAST(unnest(range(len(p))) AS INT) AS piece, md5(trim(unnest(p))) AS piece_md5 FROM (SELECT doc_id, regexp_extract_all(text, '(?:[^\\p{L}\\p{N}_]*[\\p{L}\\p{N}_]+){1,50}[^\\p{L}\\p{N}_]*') AS p FROM documents)")
def _(t):
    pieces = chunking.hard_pieces(F.col("text"), F.lit(50))
    return t("documents").select("doc_id", F.posexplode(pieces).alias("piece", "p")).select("doc_id", "piece", F.md5(F.col("p").cast("binary")).alias("piece_md5"))


@query("t12_dropped_titles", "SELECT count(*) AS articles, CAST(count(*) FILTER (len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) >= 40) AS BIGINT) AS dropped FROM conversations WHERE trim(role) <> ''")
def _(t):
    return chunking.dropped(t("conversations"), "conv_id", "text", "role", 40)


@query("t13_chunk_offsets", "SELECT item_id, CAST(instr(text, a) - 1 AS INT) AS char_start, CAST(CASE WHEN instr(substr(text, instr(text, a)), b) = 0 THEN -1 ELSE instr(text, a) + instr(substr(text, instr(text, a)), b) - 2 + length(b) END AS INT) AS char_end FROM (SELECT item_id, text, split_part(text, ' ', 3) AS a, split_part(text, ' ', 5) AS b FROM benchmark) WHERE a <> '' AND b <> ''")
def _(t):
    words = F.split("text", " ")
    rows = t("benchmark").select("item_id", "text", F.get(words, 2).alias("a"), F.get(words, 4).alias("b")).filter("a != '' AND b != ''")
    start, end = chunking.offsets(F.col("text"), F.col("a"), F.col("b"))
    return rows.select("item_id", start.alias("char_start"), end.alias("char_end"))


@query("t13_document_offsets", "SELECT doc_id, CAST(instr(text, a) - 1 AS INT) AS char_start, CAST(CASE WHEN instr(substr(text, instr(text, a)), b) = 0 THEN -1 ELSE instr(text, a) + instr(substr(text, instr(text, a)), b) - 2 + length(b) END AS INT) AS char_end FROM (SELECT doc_id, text, split_part(text, ' ', 3) AS a, split_part(text, ' ', 5) AS b FROM documents) WHERE a <> '' AND b <> ''")
def _(t):
    words = F.split("text", " ")
    rows = t("documents").select("doc_id", "text", F.get(words, 2).alias("a"), F.get(words, 4).alias("b")).filter("a != '' AND b != ''")
    start, end = chunking.offsets(F.col("text"), F.col("a"), F.col("b"))
    return rows.select("doc_id", start.alias("char_start"), end.alias("char_end"))


_ESCAPE = " If the context does not say, answer that you do not know."
_PROMPT = "Answer from the context." + _ESCAPE + "\n\nContext:\n%s\n\nAnswer:"


@query("t17_prompts", "SELECT item_id, md5(p) AS prompt_md5, md5(replace(p, '" + _ESCAPE + "', '')) AS ablated_md5 FROM (SELECT item_id, '" + _PROMPT.replace("\n", "' || chr(10) || '").replace("%s", "' || text || '") + "' AS p FROM benchmark)")
def _(t):
    prompt = F.format_string(_PROMPT, "text")
    md5 = lambda c: F.md5(c.cast("binary"))
    return t("benchmark").select("item_id", md5(prompt).alias("prompt_md5"), md5(tx.ablated(prompt, _ESCAPE)).alias("ablated_md5"))


# Joins ------------------------------------------------------------------------------------------


@query("j1_postings_of_queries", _with(_DOCS, _SCORED, **_LATIN) + " SELECT qid, count(*) AS n, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT DISTINCT qid, term FROM qt) JOIN post USING (term) GROUP BY qid")
def _(t):
    asked = t("benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(tx.latin_tokens(F.col("text")))).alias("term"))
    post = retrieval.postings(t("documents"), "doc_id", tx.latin_tokens(F.col("text")), retrieval.few(asked.select("term").distinct()))
    return post.join(asked, "term").groupBy("qid").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"))


@query("j3_gold_in_top", _with(_DOCS, _SCORED, _METRIC, **_LATIN) + " SELECT qid, doc FROM gold g WHERE EXISTS (SELECT 1 FROM ranked r WHERE r.qid = g.qid AND r.doc = g.doc AND rank <= 10)")
def _(t):
    return _gold(t).join(_ranked(t, k=10), ["qid", "doc"], "left_semi")


@query("j11_provenance", f"WITH {_MENT} SELECT name, count(DISTINCT chunk) AS chunks FROM m JOIN orders ON o_orderkey = chunk WHERE o_orderstatus = 'O' GROUP BY name")
def _(t):
    known = t("orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("chunk"))
    return graph.normalised(_mentions(t)).join(known, "chunk").groupBy("name").agg(F.count_distinct("chunk").alias("chunks"))


# Index ------------------------------------------------------------------------------------------


@query("r2_idf", _with(_DOCS, **_LATIN) + " SELECT term, round(idf, 9) AS idf FROM terms")
def _(t):
    return retrieval.idf(t("documents"), "doc_id", tx.latin_tokens(F.col("text"))).withColumn("idf", F.round("idf", 9))


@query("r3_bm25_scores", _with(_DOCS, _SCORED, **_LATIN) + " SELECT qid, count(*) AS n, round(sum(score), 4) AS total, round(max(score), 6) AS best FROM scored GROUP BY qid")
def _(t):
    tokens = tx.latin_tokens(F.col("text"))
    asked = t("benchmark")
    scored = retrieval.bm25(retrieval.index(t("documents"), "doc_id", tokens, retrieval.asked_terms(asked, tokens))[0], asked, "item_id", tokens)
    return scored.groupBy("qid").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"), F.round(F.max("score"), 6).alias("best"))


@query("r6_index_verifier", _with(_DOCS, _SCORED, **_LATIN) + " SELECT qid, count(*) AS n, CAST(0 AS BIGINT) AS differing FROM scored WHERE qid % 20 = 0 GROUP BY qid")
def _(t):
    return retrieval.verified(t("documents"), "doc_id", tx.latin_tokens(F.col("text")), t("benchmark").filter("item_id % 20 = 0"), "item_id")


@query("r6_index_verifier_all", _with(_DOCS, _SCORED, **_LATIN) + " SELECT qid, count(*) AS n, CAST(0 AS BIGINT) AS differing FROM scored GROUP BY qid")
def _(t):
    return retrieval.verified(t("documents"), "doc_id", tx.latin_tokens(F.col("text")), t("benchmark"), "item_id")


# Windows ----------------------------------------------------------------------------------------


@query("w1_rank_in_query", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def _(t):
    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t("orders").select("o_custkey", "o_orderkey", F.row_number().over(by).alias("rank"))


@query("w2_first_occurrence", "SELECT l_partkey, min(l_orderkey) AS first_order FROM lineitem GROUP BY l_partkey")
def _(t):
    return t("lineitem").groupBy("l_partkey").agg(F.min("l_orderkey").alias("first_order"))


@query("w3_last_row", f"WITH {_LOG} SELECT qi, arm, max(seq) AS seq FROM log GROUP BY qi, arm")
def _(t):
    return _log(t).groupBy("qi", "arm").agg(F.max("seq").alias("seq"))


@query("w7_step_down", "WITH p AS (SELECT lang, count(*) AS n, count(*) FILTER (toxic = 1) AS k FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT lang, bool_and(k * 20 <= n) OVER (ORDER BY n DESC, lang) AS still FROM p")
def _(t):
    rows = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id")
    p = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("k"))
    so_far = Window.orderBy(F.desc("n"), "lang").rowsBetween(Window.unboundedPreceding, 0)  # a row for each language
    return p.select("lang", F.every(F.col("k") * 20 <= F.col("n")).over(so_far).alias("still"))


@query("w8_trailing_mean", f"WITH {_LOG} SELECT seq, round(avg(value) OVER (PARTITION BY arm, qi ORDER BY seq ROWS 49 PRECEDING), 9) AS mean FROM log")
def _(t):
    last = Window.partitionBy("arm", "qi").orderBy("seq").rowsBetween(-49, 0)
    return _log(t).select("seq", F.round(F.avg("value").over(last), 9).alias("mean"))


@query("w9_packing_fold", f"{_PACKED} SELECT doc, count(*) AS chunks, max(n_tokens) AS most FROM packed GROUP BY doc")
def _(t):
    return chunking.pack(t("documents"), "doc_id", "source", "text", 120).groupBy("doc").agg(F.count("*").alias("chunks"), F.max("n_tokens").alias("most"))


@query("w10_chunk_index", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS chunk_index FROM conversations")
def _(t):
    by = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select("conv_id", "turn", (F.row_number().over(by) - 1).alias("chunk_index"))


# Orders and sets --------------------------------------------------------------------------------


@query("o1_corpus_order", "SELECT doc_id, source FROM documents ORDER BY coalesce(source, ''), doc_id")
def _(t):
    return t("documents").select("doc_id", "source").orderBy(F.coalesce("source", F.lit("")), "doc_id")


@query("o3_partial_sort_top", "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 10")
def _(t):
    by = Window.partitionBy("l_partkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return t("lineitem").withColumn("rank", F.row_number().over(by)).filter("rank <= 10").select("l_partkey", "l_orderkey", "l_linenumber")


@query("o5_union", f"WITH {_MENT}{_EDGE} SELECT a AS name FROM e UNION SELECT b FROM e")
def _(t):
    e = _edges(t)
    return e.select(F.col("a").alias("name")).union(e.select("b")).distinct()


@query("o6_except", f"WITH {_MENT}{_EDGE} SELECT DISTINCT name FROM m EXCEPT SELECT a FROM e")
def _(t):
    return graph.normalised(_mentions(t)).select("name").subtract(_edges(t).select("a"))


@query("o8_drift", "(SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT p_partkey FROM part WHERE p_size < 45) UNION ALL (SELECT p_partkey FROM part WHERE p_size < 45 EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def _(t):
    a, b = t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")), t("part").filter("p_size < 45").select("p_partkey")
    return a.exceptAll(b).unionAll(b.exceptAll(a))


@query("o10_bag_union", _with(_DOCS, _SCORED, **_LATIN) + " SELECT qid, doc, 'top5' AS list FROM ranked WHERE rank <= 5 UNION ALL SELECT qid, doc, 'top10' FROM ranked WHERE rank <= 10")
def _(t):
    ranked = _ranked(t, k=10)
    return ranked.filter("rank <= 5").select("qid", "doc", F.lit("top5").alias("list")).unionAll(ranked.select("qid", "doc", F.lit("top10")))
