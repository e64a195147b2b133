"""Queries of the evaluation: learning, extraction, variants of metrics, samples, joins and set tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as st
from ..functions import text as tx
from ..operators import chunking, extraction, graph, learning, retrieval, runlog
from .queries import _DOCS, _EDGE, _LATIN, _LOG, _MENT, _METRIC, _SCORED, _edges, _gold, _log, _mentions, _ranked, _with, query

_GOLD = ", gold AS (SELECT item_id AS qid, doc_id AS doc FROM benchmark b, documents d WHERE contains(d.text, b.text))"


# Learning ---------------------------------------------------------------------------------------
# Questions are orders, a ranked list is an order's lines by number, gold the parts of lines returned.

_SEEDS = 3
_DRAW = "CAST('0x' || substr(md5(concat_ws(':', {0})), 1, 15) AS BIGINT)"
_SHIFT = _DRAW.format("seed, 'shift'")
_LEARN = (
    "q AS (SELECT seed, o_orderkey AS qid, " + _DRAW.format("seed, o_orderkey, 'split'") + f" % 1000 < 600 AS learns FROM orders, range({_SEEDS}) s(seed)), "
    "pool AS (SELECT l_orderkey AS qid, l_partkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_partkey) AS rank FROM lineitem GROUP BY l_orderkey, l_partkey), "
    "gold AS (SELECT DISTINCT l_orderkey AS qid, l_partkey AS doc FROM lineitem WHERE l_returnflag = 'R'), "
    "n AS (SELECT max(p_partkey) + 1 AS n FROM part), "
    "shown AS (SELECT seed, qid, rank, e AND rank = slot AS swapped, CASE WHEN e AND rank = slot THEN other ELSE doc END AS doc FROM (SELECT seed, q.qid, rank, doc, "
    + _DRAW.format("seed, q.qid, 'explore'") + " % 1000 < 100 AS e, " + _DRAW.format("seed, q.qid, 'slot'") + " % 5 + 1 AS slot, " + _DRAW.format("seed, q.qid, 'doc'") + " % n AS other FROM q JOIN pool USING (qid), n WHERE learns AND rank <= 5)), "
    "credit AS (SELECT seed, doc, sum(CASE WHEN swapped THEN 50.0 ELSE 1 / 0.9 END) AS credit FROM shown s WHERE EXISTS (SELECT 1 FROM gold g WHERE g.qid = s.qid AND g.doc = s.doc) GROUP BY seed, doc)"
)


class _Pass:
    """The tables of one learning pass."""

    def __init__(self, t):
        lines = t("lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("doc"), "l_linenumber", "l_returnflag")
        first = lines.groupBy("qid", "doc").agg(F.min("l_linenumber").alias("at"))
        self.pool = first.select("qid", "doc", F.row_number().over(Window.partitionBy("qid").orderBy("at", "doc")).alias("rank"))
        self.gold = lines.filter("l_returnflag = 'R'").select("qid", "doc").distinct()
        self.n = t("part").agg(F.max("p_partkey") + 1).first()[0]
        self.split = learning.split(t("orders").select(F.col("o_orderkey").alias("qid")), _SEEDS)
        self.credit = learning.credit(learning.explored(self.split, self.pool, self.n, 5), self.gold, self.n, 5)
        self.seeded = self.split.filter("NOT learns").select("seed", "qid").join(self.pool, "qid")

    def arms(self) -> dict[str, DataFrame]:
        return {
            "base": self.seeded,
            "learned": learning.rerank(self.seeded, self.credit),
            "popularity": learning.rerank(self.seeded, self.credit, text=False),
            "shuffled": learning.rerank(self.seeded, learning.shuffled(self.credit, self.n)),
        }


@query("st3_learning_pass", f"WITH {_LEARN} SELECT seed, doc, round(credit, 6) AS credit FROM credit")
def _(t):
    return _Pass(t).credit.select(F.col("seed").cast("long").alias("seed"), "doc", F.round("credit", 6).alias("credit"))


@query("st5_shuffled_credit", f"WITH {_LEARN} SELECT seed, (doc % n * 1000003 + {_SHIFT} % n) % n AS doc, round(credit, 6) AS credit FROM credit, n")
def _(t):
    p = _Pass(t)
    return learning.shuffled(p.credit, p.n).select(F.col("seed").cast("long").alias("seed"), "doc", F.round("credit", 6).alias("credit"))


def _reranked(score: str) -> str:
    return (
        f"WITH {_LEARN}, top AS (SELECT seed, max(credit) AS most FROM credit GROUP BY seed), s AS (SELECT q.seed, q.qid, p.doc, count(*) OVER w AS m, rank, coalesce(credit / most, 0) AS share FROM q JOIN pool p USING (qid) LEFT JOIN credit c ON c.seed = q.seed AND c.doc = p.doc LEFT JOIN top ON top.seed = q.seed WHERE NOT learns WINDOW w AS (PARTITION BY q.seed, q.qid)) "
        f"SELECT seed, qid, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY seed, qid ORDER BY round(score, 9) DESC, doc) AS rank FROM (SELECT *, {score} AS score FROM s)"
    )


@query("r14_feedback_rerank", _reranked("(m - rank + 1) / m + 0.3 * share"))
def _(t):
    return _Pass(t).arms()["learned"].withColumn("seed", F.col("seed").cast("long")).withColumn("score", F.round("score", 6))


@query("r15_popularity_rank", _reranked("share"))
def _(t):
    return _Pass(t).arms()["popularity"].withColumn("seed", F.col("seed").cast("long")).withColumn("score", F.round("score", 6))


#: Base, random boosts and the ceiling: what a learned order has to be told from.
_CONTROLS = f"""WITH {_LEARN}, top AS (SELECT seed, max(credit) AS most FROM credit GROUP BY seed),
s AS (SELECT q.seed, q.qid, p.doc, rank, coalesce(credit / most, 0) AS share FROM q JOIN pool p USING (qid) LEFT JOIN credit c ON c.seed = q.seed AND c.doc = p.doc LEFT JOIN top ON top.seed = q.seed WHERE NOT learns),
m AS (SELECT *, count(*) OVER w AS m, list(share) OVER (w ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS shares, row_number() OVER (w ORDER BY {_DRAW.format("seed, qid, doc, 'boost'")}, doc) AS drawn FROM s WINDOW w AS (PARTITION BY seed, qid)),
b AS (SELECT seed, qid, doc, rank, (m - rank + 1) / m + 0.3 * share AS learned, (m - rank + 1) / m + 0.3 * shares[drawn] AS random, EXISTS (SELECT 1 FROM gold g WHERE g.qid = m.qid AND g.doc = m.doc) AS hit FROM m),
arms AS (SELECT 'base' AS arm, seed, qid, doc, rank FROM b UNION ALL SELECT 'learned', seed, qid, doc, row_number() OVER (PARTITION BY seed, qid ORDER BY round(learned, 9) DESC, doc) FROM b UNION ALL SELECT 'random', seed, qid, doc, row_number() OVER (PARTITION BY seed, qid ORDER BY round(random, 9) DESC, doc) FROM b UNION ALL SELECT 'oracle', seed, qid, doc, row_number() OVER (PARTITION BY seed, qid ORDER BY hit DESC, rank) FROM b),
w AS (SELECT seed, q.qid, g.doc FROM q JOIN gold g USING (qid) WHERE NOT learns),
per AS (SELECT arm, w.seed, w.qid, coalesce(sum(1 / log2(rank + 1.0)), 0) AS gain, count(*) AS golds FROM (SELECT DISTINCT arm FROM arms) x, w LEFT JOIN arms a ON a.arm = x.arm AND a.seed = w.seed AND a.qid = w.qid AND a.doc = w.doc AND a.rank <= 3 GROUP BY x.arm, w.seed, w.qid)"""


@query("x15_learning_controls", _CONTROLS.replace("SELECT arm, w.seed", "SELECT x.arm, w.seed") + " SELECT arm, seed, count(*) AS n, round(avg(gain / list_sum([1 / log2(i + 1.0) FOR i IN range(1, least(golds, 3) + 1)])), 6) AS ndcg FROM per GROUP BY arm, seed")
def _(t):
    p, out = _Pass(t), None
    arms = {"base": p.seeded, "learned": learning.rerank(p.seeded, p.credit), "random": learning.random_boost(p.seeded, p.credit), "oracle": learning.oracle(p.seeded, p.gold)}
    for arm, ranked in arms.items():
        own = learning.ndcg(p.split, p.gold, ranked, 3).withColumn("arm", F.lit(arm))
        out = own if out is None else out.unionAll(own)
    return out.groupBy("arm", F.col("seed").cast("long").alias("seed")).agg(F.count("*").alias("n"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


@query("x9_learning_gates")
def _(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("doc"), F.col("l_linenumber").alias("at"), (F.col("l_returnflag") == "R").alias("gold"))
    n = t("part").agg(F.max("p_partkey") + 1).first()[0]
    rows = learning.outcomes(t("orders").select(F.col("o_orderkey").alias("qid")), lines, n, _SEEDS, 5, 3)
    rows = rows.withColumns({"config": F.when(F.col("similar"), "similar").otherwise("novel"), "type": F.lit("all")})
    pairs = [("learned", "base"), ("learned", "popularity"), ("learned", "shuffled")]
    deltas = st.bootstrap(st.wide_family(rows, pairs, ["strict"]), "family", "diff", scale=100.0)
    part = lambda i: F.split(F.col("family"), "[/-]")[i]
    return learning.gates(deltas.select(part(0).alias("split"), part(2).alias("a"), part(3).alias("b"), "mean", "low", "p"))


# Extraction -------------------------------------------------------------------------------------


def _pairs_sql(text: str) -> str:
    names = f"[lower(x) FOR x IN regexp_extract_all({text}, '[A-Z][a-z]+')]"
    return f"list_distinct([CASE WHEN z[1] < z[2] THEN z[1] || '||' || z[2] ELSE z[2] || '||' || z[1] END FOR z IN list_zip({names}[:-2], {names}[2:]) IF z[1] <> z[2]])"


_CUT = "SELECT doc_id AS doc, start, substr(text, CAST(start + 1 AS BIGINT), {0}) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), {0})) AS start FROM documents) WHERE length(text) > 0"


def _cut(t, size: int) -> DataFrame:
    return chunking.slide(t("documents"), "doc_id", "text", size, 0, 1)


@query("p14_payload_validity", "SELECT event_id, v IN (0, 1) AS valid, CASE WHEN v = 3 THEN 'truncated' WHEN v = 2 THEN 'unparseable' ELSE 'ok' END AS status FROM (SELECT event_id, event_id % 5 AS v FROM events)")
def _(t):
    full = '{"entities": [{"name": "A", "type": "OTHER", "description": ""}], "relationships": []}'
    v = F.col("event_id") % 5
    e = t("events").select("event_id", F.when(v == 3, "length").otherwise("stop").alias("why"), F.when(v < 2, full).when(v == 4, '{"entities": []}').otherwise(full[:40]).alias("r"))
    return e.select("event_id", extraction.valid(F.col("r")).alias("valid"), extraction.status(F.col("why"), F.col("r")).alias("status"))


@query("u4_cooccurrence", f"SELECT doc_id AS doc, unnest({_pairs_sql('text')}) AS relation FROM documents")
def _(t):
    return extraction.relations(t("documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("chunk")))


@query("j9_name_in_chunk", f"WITH c AS ({_CUT.format(1024)}), e AS (SELECT DISTINCT doc_id AS doc, lower(unnest(regexp_extract_all(text, '[A-Z][a-z]+'))) AS name FROM documents) SELECT doc, name, start FROM e JOIN c USING (doc) WHERE contains(trim(regexp_replace(lower(chunk), '\\s+', ' ', 'g')), name)")
def _(t):
    entities = t("documents").select(F.col("doc_id").alias("doc"), F.explode(F.array_distinct(extraction.names(F.col("text")))).alias("name"))
    return extraction.homes(entities, _cut(t, 1024)).withColumn("start", F.col("start").cast("long"))


_COMPARE = f"""WITH big AS ({_CUT.format(4096)}), small AS ({_CUT.format(512)}),
rb AS (SELECT DISTINCT doc, unnest({_pairs_sql('chunk')}) AS r FROM big), rs AS (SELECT DISTINCT doc, unnest({_pairs_sql('chunk')}) AS r FROM small),
lost AS (SELECT doc, r, split_part(r, '||', 1) AS a, split_part(r, '||', 2) AS b FROM (SELECT doc, r FROM rb EXCEPT SELECT doc, r FROM rs)),
gained AS (SELECT doc, r FROM rs EXCEPT SELECT doc, r FROM rb),
body AS (SELECT doc, trim(regexp_replace(lower(chunk), '\\s+', ' ', 'g')) AS body FROM small),
f AS (SELECT l.doc, l.r, bool_or(contains(body, a)) AS a, bool_or(contains(body, b)) AS b, bool_or(contains(body, a) AND contains(body, b)) AS ab FROM lost l JOIN body USING (doc) GROUP BY ALL),
k AS (SELECT doc, count(*) AS lost, sum(CAST(a AND b AND NOT ab AS BIGINT)) AS severed, sum(CAST(ab AS BIGINT)) AS unemitted FROM f GROUP BY doc)
SELECT d.doc, (SELECT count(*) FROM rb WHERE rb.doc = d.doc) AS at_big, (SELECT count(*) FROM rs WHERE rs.doc = d.doc) AS at_small, coalesce(lost, 0) AS lost, (SELECT count(*) FROM gained g WHERE g.doc = d.doc) AS gained,
CAST(coalesce(severed, 0) AS BIGINT) AS severed, CAST(coalesce(unemitted, 0) AS BIGINT) AS unemitted, CAST(coalesce(lost, 0) - coalesce(severed, 0) - coalesce(unemitted, 0) AS BIGINT) AS unclassified FROM (SELECT DISTINCT doc FROM big) d LEFT JOIN k USING (doc)"""


@query("a21_extraction_comparison", _COMPARE)
def _(t):
    big, small = _cut(t, 4096), _cut(t, 512)
    return extraction.compare(extraction.relations(big), extraction.relations(small), big, small)


_HALVES = f"""WITH h AS (SELECT doc_id AS doc, text, substr(text, 1, length(text) // 2) AS x, substr(text, length(text) // 2 + 1) AS y FROM documents),
r AS (SELECT doc, {_pairs_sql('text')} AS w, list_distinct(list_concat({_pairs_sql('x')}, {_pairs_sql('y')})) AS s, lower(x) AS x, lower(y) AS y FROM h),
k AS (SELECT *, [e FOR e IN w IF NOT list_contains(s, e)] AS lost FROM r),
o AS (SELECT doc, w, s, lost, [(contains(x, split_part(e, '||', 1)), contains(y, split_part(e, '||', 1)), contains(x, split_part(e, '||', 2)), contains(y, split_part(e, '||', 2))) FOR e IN lost] AS c FROM k)
SELECT doc, len(w) AS whole, len(s) AS halves, len(lost) AS lost, len([e FOR e IN s IF NOT list_contains(w, e)]) AS gained, len([e FOR e IN c IF (e[1] AND NOT e[2] AND e[4] AND NOT e[3]) OR (e[2] AND NOT e[1] AND e[3] AND NOT e[4])]) AS severed FROM o"""


@query("a22_half_split_severed", _HALVES)
def _(t):
    return extraction.half_split(t("documents"), "doc_id", "text")


_POWER = [("256", 1024, 0), ("512", 2048, 0), ("1024", 4096, 0), ("1024+128", 4096, 512)]
_POWER_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS label, count(*) AS spans, CAST(sum(CAST(NOT whole AS BIGINT)) AS BIGINT) AS severed, round(100.0 * sum(CAST(NOT whole AS BIGINT)) / count(*), 2) AS pct FROM (SELECT qid, doc, coalesce(bool_or(length(c) >= 200 AND contains(c, fact)), false) AS whole FROM (SELECT qid, doc, fact, substr(t, CAST(i + 1 AS BIGINT), {size}) AS c FROM (SELECT qid, doc, b.text AS fact, d.text AS t, unnest(range(0, greatest(length(d.text) - {over}, 1), {size - over})) AS i FROM gold JOIN benchmark b ON b.item_id = qid JOIN documents d ON d.doc_id = doc)) GROUP BY qid, doc)"
    for name, size, over in _POWER
)


@query("a19_severance_power", "WITH " + _GOLD[2:] + " " + _POWER_SQL)
def _(t):
    pairs = _gold(t).join(t("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("fact")), "qid").select("doc", "fact")
    return chunking.severed(pairs, t("documents"), "doc_id", "text", _POWER)


# Variants of metrics ----------------------------------------------------------------------------

_UNIT = _GOLD + ", unit AS (SELECT qid, source, min(rank) AS chunk_rank FROM ranked JOIN documents ON doc = doc_id WHERE rank <= 10 GROUP BY qid, source)"


def _by_source(t) -> DataFrame:
    ranked = _ranked(t, k=10).join(t("documents").select(F.col("doc_id").alias("doc"), "source"), "doc")
    return retrieval.first_documents(ranked, "source")


@query("r13_first_documents", _with(_DOCS, _SCORED, _UNIT, **_LATIN) + " SELECT qid, source, chunk_rank, row_number() OVER (PARTITION BY qid ORDER BY chunk_rank) AS rank FROM unit")
def _(t):
    return _by_source(t)


@query("a2_chunk_rank_mrr", _with(_DOCS, _SCORED, _UNIT, **_LATIN) + ", g AS (SELECT DISTINCT qid, source FROM gold JOIN documents ON doc = doc_id) SELECT g.qid, round(coalesce(max(1.0 / chunk_rank), 0), 6) AS rr FROM g LEFT JOIN unit USING (qid, source) GROUP BY g.qid")
def _(t):
    gold = _gold(t).join(t("documents").select(F.col("doc_id").alias("doc"), "source"), "doc").select("qid", F.col("source").alias("doc")).distinct()
    ranked = _by_source(t).select("qid", F.col("source").alias("doc"), F.col("chunk_rank").alias("rank"))
    return retrieval.metrics(gold.select("qid").distinct(), gold, ranked, 10).select("qid", F.round("rr", 6).alias("rr"))


@query("a3_hits_at", _with(_DOCS, _SCORED, _GOLD, **_LATIN) + ", g AS (SELECT qid, min(doc) AS doc FROM gold GROUP BY qid) SELECT count(*) AS n, round(100.0 * avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 2) AS hits1, round(100.0 * avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END), 2) AS hits5, round(100.0 * avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 2) AS hits10 FROM g LEFT JOIN ranked USING (qid, doc)")
def _(t):
    gold = _gold(t).groupBy("qid").agg(F.min("doc").alias("doc"))
    at = gold.join(_ranked(t, k=10), ["qid", "doc"], "left")
    return at.agg(F.count("*").alias("n"), *(F.round(100.0 * F.avg(F.when(F.col("rank") <= k, 1).otherwise(0)), 2).alias(f"hits{k}") for k in (1, 5, 10)))


@query("a1_recall_ndcg", _with(_DOCS, _SCORED, _GOLD, **_LATIN) + ", h AS (SELECT g.qid, count(rank) AS found, count(*) AS n, coalesce(sum(1 / log2(rank + 1)), 0) AS dcg FROM gold g LEFT JOIN (SELECT * FROM ranked WHERE rank <= 10) r USING (qid, doc) GROUP BY g.qid) SELECT qid, round(found / n, 6) AS recall, round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= n), 6) AS ndcg FROM h")
def _(t):
    return retrieval.graded(_gold(t), _ranked(t, k=10), 10).select("qid", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"))


_ARMS2 = f"WITH {_LOG}, l AS (SELECT * FROM log WHERE NOT starts_with(done_reason, 'error') QUALIFY row_number() OVER (PARTITION BY arm, qi ORDER BY seq DESC) = 1), p AS (SELECT a.qi, a.done_reason = 'view' AS base, b.done_reason = 'view' AS now, b.value > 10 AS contained FROM l a JOIN l b ON a.qi = b.qi AND a.arm = 0 AND b.arm = 1)"


@query("a10_abstention_fates", _ARMS2 + " SELECT CAST(sum(CASE WHEN base AND NOT now AND contained THEN 1 ELSE 0 END) AS BIGINT) AS recovered, CAST(sum(CASE WHEN base AND NOT now AND NOT contained THEN 1 ELSE 0 END) AS BIGINT) AS exposed, CAST(sum(CASE WHEN base AND now THEN 1 ELSE 0 END) AS BIGINT) AS still_abstains FROM p")
def _(t):
    last = runlog.latest(_log(t), ["arm", "qi"], "seq")
    base = last.filter("arm = 0").select("qi", (F.col("done_reason") == "view").alias("base"))
    now = last.filter("arm = 1").select("qi", (F.col("done_reason") == "view").alias("now"), (F.col("value") > 10).alias("contained"))
    return base.join(now, "qi").agg(*runlog.fates(F.col("base"), F.col("now"), F.col("contained")))


# A family of deltas: arms are return flags, configurations are lines by number, outcomes are order-wise.
# Four configurations, three pairs of arms, two metrics, all and three types; and three contrasts of configurations in each arm.

_FAM = "o AS (SELECT l_shipmode_ AS config, l_orderkey AS qid, 't' || l_orderkey % 3 AS type, arm, CAST(max(l_quantity) > 25 AS INT) AS large, CAST(max(l_discount) > 0.05 AS INT) AS cheap FROM (SELECT *, 'F' || l_linenumber % 4 AS l_shipmode_, CASE l_returnflag WHEN 'A' THEN 'a' WHEN 'N' THEN 'n' ELSE 'r' END AS arm FROM lineitem) GROUP BY ALL)"
_PAIR_ARMS = [("a", "n"), ("a", "r"), ("n", "r")]
_FAM_ROWS = " UNION ALL ".join(
    f"SELECT x.config || '/' || s.stratum || '/{a}-{b}/{m}' AS family, x.{m} - y.{m} AS diff FROM o x JOIN o y USING (config, qid, type), LATERAL (SELECT unnest(['all', x.type]) AS stratum) s WHERE x.arm = '{a}' AND y.arm = '{b}'"
    for a, b in _PAIR_ARMS
    for m in ("large", "cheap")
)
_CONTRASTS = [("0-1", "F0", "F1"), ("2-3", "F2", "F3"), ("0-2", "F0", "F2")]
_FAM_ROWS += "".join(f" UNION ALL SELECT '{name}/' || x.arm || '/large', x.large - y.large FROM o x JOIN o y USING (qid, type, arm) WHERE x.config = '{a}' AND y.config = '{b}'" for name, a, b in _CONTRASTS)


def _family(t) -> DataFrame:
    arm = F.when(F.col("l_returnflag") == "A", "a").when(F.col("l_returnflag") == "N", "n").otherwise("r")
    kind = F.concat(F.lit("t"), (F.col("l_orderkey") % 3).cast("string"))
    rows = t("lineitem").groupBy(F.concat(F.lit("F"), (F.col("l_linenumber") % 4).cast("string")).alias("config"), F.col("l_orderkey").alias("qid"), kind.alias("type"), arm.alias("arm"))
    rows = rows.agg((F.max("l_quantity") > 25).cast("int").alias("large"), (F.max("l_discount") > 0.05).cast("int").alias("cheap"))
    return st.delta_family(rows, _PAIR_ARMS, ["large", "cheap"]).unionByName(st.contrast_family(rows, _CONTRASTS, "large"))


@query("x6_delta_family", f"WITH {_FAM}, d AS ({_FAM_ROWS}) SELECT family, count(*) AS n, round(100.0 * avg(diff), 6) AS delta FROM d GROUP BY family")
def _(t):
    return _family(t).groupBy("family").agg(F.count("*").alias("n"), F.round(100.0 * F.avg("diff"), 6).alias("delta"))


@query("x4_delta_tests")
def _(t):
    tests = st.bootstrap(_family(t), "family", "diff", 4_000, scale=100.0)
    return st.holm(tests, "p", order="family")


# Samples, guards, windows -----------------------------------------------------------------------


@query("w5_proportional_sample", "WITH s AS (SELECT source, count(*) AS n, greatest(CAST(round_even(100 * count(*) / (SELECT count(*) FROM documents), 0) AS BIGINT), 1) AS w FROM documents GROUP BY source), p AS (SELECT doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY doc_id) - 1 AS pos, w, greatest(n // w, 1) AS step FROM documents d JOIN s USING (source)) SELECT doc_id, source FROM p WHERE pos % step = 0 AND pos // step < w ORDER BY doc_id LIMIT 100")
def _(t):
    return runlog.proportional(t("documents").select("doc_id", "source"), 100, "source", "doc_id")


@query("w6_strided_sample", "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents), r AS (SELECT doc_id, len(list_filter(ws, lambda x: regexp_matches(x, '^\\p{Lu}'))) / greatest(len(ws), 1) AS ratio FROM w), p AS (SELECT doc_id, ratio, row_number() OVER (ORDER BY ratio, doc_id) - 1 AS pos, greatest(count(*) OVER () // 30, 1) AS step FROM r) SELECT doc_id, round(ratio, 6) AS ratio FROM p WHERE pos % step = 0 AND pos // step < 30")
def _(t):
    rows = t("documents").select("doc_id", tx.capital_ratio(F.col("text")).alias("ratio"))
    return runlog.strided(rows, "ratio", "doc_id", 30).withColumn("ratio", F.round("ratio", 6))


@query("st2_identity_guard", "SELECT doc_id, source AS gold FROM documents WHERE doc_id % 50 = 0")
def _(t):
    log = t("documents").select("doc_id", F.col("source").alias("gold"))
    return runlog.disagreeing(log, log.withColumn("gold", F.when(F.col("doc_id") % 50 == 0, "changed").otherwise(F.col("gold"))), "doc_id", "gold")


@query("st6_completeness", f"WITH {_LOG}, e AS (SELECT DISTINCT arm, qi FROM (SELECT DISTINCT qi FROM log), range(3) a(arm)), f AS (SELECT DISTINCT arm, qi, 1 AS one FROM log WHERE done_reason = 'purchase') SELECT arm, count(*) AS expected, count(one) AS found, count(*) - count(one) AS missing FROM e LEFT JOIN f USING (arm, qi) GROUP BY arm")
def _(t):
    expected = _log(t).select("qi").distinct().withColumn("arm", F.explode(F.array(*(F.lit(a).cast("long") for a in range(3)))))
    return runlog.completeness(_log(t).filter("done_reason = 'purchase'"), expected, ["arm", "qi"], "arm")


@query("p9_english_abstention", "SELECT conv_id, turn, contains(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')), 'the by') AS abstained FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", tx.latin(F.col("text")).contains("the by").alias("abstained"))


# Joins, graphs, sets ----------------------------------------------------------------------------


@query("j7_dense_scores", "SELECT qid, doc, round(score, 6) AS score FROM (SELECT q.vec_id AS qid, d.vec_id AS doc, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0) WHERE score >= 0.2")
def _(t):
    v = t("embeddings")
    return retrieval.above(v, v.filter("vec_id % 20 = 0"), 0.2).withColumn("score", F.round("score", 6))


@query("j10_neighbours", f"WITH {_MENT}{_EDGE} SELECT a AS src, b AS dst, CAST(weight AS BIGINT) AS weight FROM e UNION ALL SELECT b, a, CAST(weight AS BIGINT) FROM e")
def _(t):
    return graph.both_ways(_edges(t))


@query("j12_real_edges", f"WITH {_MENT}{_EDGE}, v AS (SELECT DISTINCT name FROM m WHERE type <> 'SMALL') SELECT a, b, CAST(weight AS BIGINT) AS weight, n AS count FROM e WHERE a IN (SELECT name FROM v) AND b IN (SELECT name FROM v)")
def _(t):
    return graph.real_edges(_edges(t), graph.vertices(_mentions(t).filter("type != 'SMALL'"))).select("a", "b", "weight", "count")


@query("j14_outcome_calibration", _with(_DOCS, _SCORED, _METRIC, **_LATIN) + f", {_LOG}, l AS (SELECT qi, max_by(done_reason, seq) = 'view' AS abstained FROM log GROUP BY qi) SELECT strict, count(*) AS n, CAST(sum(CAST(abstained AS INT)) AS BIGINT) AS abstained FROM per JOIN l ON qi = qid GROUP BY strict")
def _(t):
    got = retrieval.metrics(t("benchmark").select(F.col("item_id").alias("qid")), _gold(t), _ranked(t, k=10), 10).select("qid", "strict")
    said = _log(t).groupBy(F.col("qi").alias("qid")).agg((F.max_by("done_reason", "seq") == "view").cast("long").alias("a"))
    return got.join(said, "qid").groupBy("strict").agg(F.count("*").alias("n"), F.sum("a").alias("abstained"))


@query("j15_two_chunkings", f"SELECT doc, a.n AS coarse, b.n AS fine FROM (SELECT doc, count(*) AS n FROM ({_CUT.format(4096)}) GROUP BY doc) a JOIN (SELECT doc, count(*) AS n FROM ({_CUT.format(512)}) GROUP BY doc) b USING (doc)")
def _(t):
    count = lambda size, name: _cut(t, size).groupBy("doc").agg(F.count("*").alias(name))
    return count(4096, "coarse").join(count(512, "fine"), "doc")


_ENT = "toks AS (SELECT p_partkey AS doc, regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[a-z0-9]+') AS ts FROM part)"


@query("r10_entity_ranking", _with(_DOCS, _SCORED, ", q AS (SELECT 1)", **_LATIN).replace(_DOCS[: _DOCS.index(", post")].replace("{pattern}", "[a-z0-9]+"), _ENT).replace("SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark", "SELECT p_type AS qid, unnest(regexp_extract_all(lower(p_type || ' gear bolt'), '[a-z0-9]+')) AS term FROM (SELECT DISTINCT p_type FROM part)") + " SELECT qid, doc, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10")
def _(t):
    text = tx.latin_tokens(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    weighted, _corpus = retrieval.index(t("part"), "p_partkey", text)
    asked = t("part").select("p_type").distinct()
    ranked = retrieval.top(retrieval.bm25(weighted, asked, "p_type", tx.latin_tokens(F.concat("p_type", F.lit(" gear bolt")))), 10)
    return ranked.withColumn("score", F.round("score", 6))


@query("o9_subset_test", "SELECT o_orderkey, bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 45)) AS within FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _(t):
    inside = t("part").filter("p_size < 45").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("hit"))
    rows = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_partkey").join(inside, "l_partkey", "left")
    return rows.groupBy("o_orderkey").agg(F.every(F.coalesce("hit", F.lit(False))).alias("within"))


@query("o2_global_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("s14_row_hash", "SELECT source, count(*) AS n_rows, CAST(sum(CAST(CAST('0x' || substr(sha256('{\"doc_id\":' || doc_id || ',\"n_chars\":' || n_chars || '}'), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM documents GROUP BY source")
def _(t):
    part = F.conv(F.substring(F.sha2(F.to_json(F.struct("doc_id", "n_chars")).cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return t("documents").groupBy("source").agg(F.count("*").alias("n_rows"), F.sum(part).cast("string").alias("digest"))
