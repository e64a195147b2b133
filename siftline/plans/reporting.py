"""Queries of report figures, digests in order, repeatable bootstraps and counts by a tokenizer file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as st
from ..operators import chunking, graph, learning, reporting
from ..sources import io
from .evaluation import _FAM, _FAM_ROWS, _PAIR_ARMS, _family
from .queries import _EDGE, _MENT, _N1, _N5, _PACKED, _SLIDE, _edges, _gold, _mentions, query

# Digests ----------------------------------------------------------------------------------------


def _digest_sql(order: str, leaf: str, table: str) -> str:
    """Digests of WIDTH neighbours, LEVELS times."""
    levels = "".join(
        f", l{i + 1} AS (SELECT p // {reporting.WIDTH} AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM l{i} GROUP BY p // {reporting.WIDTH})"
        for i in range(reporting.LEVELS)
    )
    return f"WITH x AS (SELECT {order} AS o, sha256({leaf}) AS h FROM {table}), l0 AS (SELECT row_number() OVER (ORDER BY o, h) - 1 AS p, h FROM x){levels} SELECT (SELECT count(*) FROM x) AS n_rows, substr(max(h), 1, 16) AS digest FROM l{reporting.LEVELS}"


_JSON = "'{\"doc_id\":' || doc_id || ',\"lang\":' || CASE WHEN lang IS NULL THEN 'null' ELSE '\"' || lang || '\"' END || ',\"n_chars\":' || n_chars || '}'"


@query("s14_ordered_row_hash", _digest_sql("doc_id", _JSON, "documents"))
def _(t):
    return reporting.digest(t("documents"), "doc_id", reporting.sorted_json(["n_chars", "lang", "doc_id"]))


@query("s15_corpus_fingerprint", _digest_sql("doc_id", "CAST(doc_id AS VARCHAR) || chr(0) || coalesce(text, '') || chr(1)", "documents"))
def _(t):
    row = F.concat(F.col("doc_id").cast("string"), F.lit("\x00"), F.coalesce("text", F.lit("")), F.lit("\x01"))
    return reporting.digest(t("documents"), "doc_id", row)


@query("s13_chunk_digest", _digest_sql("doc * 1000000 + start", "chunk", f"({_SLIDE})"))
def _(t):
    chunks = chunking.slide(t("documents"), "doc_id", "text", 512, 64)
    return reporting.digest(chunks.withColumn("at", F.col("doc") * 1_000_000 + F.col("start")), "at", F.col("chunk"))


@query("s13_file_digests")
def _(t):
    docs = t("documents")
    return io.file_digests(docs.sparkSession, docs.inputFiles())


# Counts by a tokenizer file ---------------------------------------------------------------------

#: A text and its tokens in the file below, known before.
_CANARY = ("Zwölf Boxkämpfer", 9)


def _counter() -> chunking.FileCounter:
    import public_tokenizers

    return chunking.FileCounter(public_tokenizers.path("byte_bpe_50k.json"))


@query("t7_subword_count")
def _(t):
    return chunking.token_counts(t("documents"), "doc_id", "text", _counter, _CANARY)


@query("t10_subword_packing")
def _(t):
    return chunking.pack_counted(t("documents"), "doc_id", "source", "text", 600, _counter, _CANARY)


# Report figures ------------------------------------------------------------------------------


_CROSS = "x AS (SELECT unnest(['all', lang]) AS lang, quality = 1 AS c, toxic = 1 AS a, n_chars % 2 = 0 AS r FROM labels JOIN documents USING (doc_id)), s AS (SELECT lang, count(*) AS n, count(*) FILTER (c) AS complete, count(*) FILTER (NOT c) AS incomplete, count(*) FILTER (c AND a) AS fp, count(*) FILTER (NOT c AND a) AS tp, count(*) FILTER (c AND NOT a) AS answered, count(*) FILTER (c AND NOT a AND r) AS met FROM x GROUP BY lang)"


@query("a9_calibration_cross", f"WITH {_CROSS} SELECT lang, n, complete, incomplete, round(100.0 * fp / nullif(complete, 0), 6) AS abstain_pct_complete, round(100.0 * tp / nullif(incomplete, 0), 6) AS abstain_pct_incomplete, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(incomplete, 0), 6) AS recall, round(100.0 * incomplete / n, 6) AS base_rate_pct, answered, round(100.0 * met / nullif(answered, 0), 6) AS answered_pct FROM s")
def _(t):
    d = t("labels").join(t("documents").select("doc_id", "lang", "n_chars"), "doc_id")
    out = reporting.calibration(d, F.col("quality") == 1, F.col("toxic") == 1, F.col("n_chars") % 2 == 0, "lang")
    return out.select(*(F.round(c, 6).alias(c) if kind == "double" else c for c, kind in out.dtypes))


_ANSWERS = [("always_economy", "It is economy.", "p_size > 25"), ("always_yes", "Yes", "p_size > 25")]


@query("a11_constant_answers", "WITH top AS (SELECT p_type AS answer FROM part GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 1), c AS (SELECT 'most_common' AS baseline, answer, [p_type, p_brand] AS golds FROM part, top" + "".join(f" UNION ALL SELECT '{n}', '{a}', [p_type, p_brand] FROM part WHERE {w}" for n, a, w in _ANSWERS) + f"), m AS (SELECT baseline, answer, len(list_filter(golds, lambda g: {_N1.format('g')} <> '' AND contains({_N1.format('answer')}, {_N1.format('g')}))) > 0 AS met FROM c) SELECT baseline, answer, count(*) AS n, count(*) FILTER (met) AS contained, round(100.0 * avg(CAST(met AS INT)), 6) AS pct FROM m GROUP BY ALL")
def _(t):
    fixed = [(name, answer, F.expr(asked)) for name, answer, asked in _ANSWERS]
    return reporting.constant_baseline(t("part"), F.array("p_type", "p_brand"), fixed).withColumn("pct", F.round("pct", 6))


#: Weights of question types in the report's mixes; 'nothing' shows a mix without weight.
_MIX = [
    ("lookup-heavy", "inference", 70.0),
    ("lookup-heavy", "comparison", 20.0),
    ("lookup-heavy", "temporal", 10.0),
    ("analyst desk", "inference", 25.0),
    ("analyst desk", "comparison", 45.0),
    ("analyst desk", "temporal", 30.0),
    ("nothing", "inference", 0.0),
    ("nothing", "comparison", 0.0),
    ("nothing", "temporal", 0.0),
]
_TYPES = ["inference", "comparison", "temporal"]
_CELLS = "l AS (SELECT l_returnflag || l_linestatus AS config, list_extract(['inference', 'comparison', 'temporal'], CAST(l_orderkey % 3 + 1 AS INT)) AS type, l_quantity > 25 AS strict FROM lineitem), cells AS (SELECT config, type, 100.0 * avg(CAST(strict AS INT)) AS value FROM l GROUP BY ALL)"
_NATIVE = "SELECT 'native mix' AS preset, type, round(100.0 * count(*) / (SELECT count(*) FROM l)) AS weight FROM l GROUP BY type"


@query("a15_mix_winner", f"WITH {_CELLS}, mix AS ({_NATIVE} UNION ALL SELECT * FROM (VALUES {', '.join(map(str, _MIX))}) v), s AS (SELECT preset, config, sum(weight * coalesce(value, 0)) AS s FROM (SELECT DISTINCT config FROM cells) CROSS JOIN mix LEFT JOIN cells USING (config, type) GROUP BY preset, config), w AS (SELECT preset, config, CASE WHEN total = 0 THEN 0 ELSE s / total END AS weighted FROM s JOIN (SELECT preset, sum(weight) AS total FROM mix GROUP BY preset) USING (preset)) SELECT preset, config, round(weighted, 6) AS weighted, row_number() OVER (PARTITION BY preset ORDER BY round(weighted, 9) DESC, config) = 1 AS winner FROM w")
def _(t):
    kind = F.get(F.array(*map(F.lit, _TYPES)), (F.col("l_orderkey") % 3).cast("int"))
    rows = t("lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("config"), kind.alias("type"), (F.col("l_quantity") > 25).cast("int").alias("strict"))
    counted = rows.groupBy("config", "type").agg(F.count("*").alias("n"), (100.0 * F.avg("strict")).alias("value"))
    types = counted.groupBy("type").agg(F.sum("n").alias("n"))
    native = types.crossJoin(types.agg(F.sum("n").alias("all"))).select(F.lit("native mix").alias("preset"), "type", F.round(100.0 * F.col("n") / F.col("all")).alias("weight"))  # a row for each type
    mix = native.unionByName(rows.sparkSession.createDataFrame(_MIX, "preset string, type string, weight double"))
    return reporting.traffic_mix(counted.drop("n"), mix).withColumn("weighted", F.round("weighted", 6))


_TYPED = "g AS (SELECT item_id AS qid, CASE WHEN length(b.text) < 200 THEN 'short' ELSE 'long' END AS type, doc_id AS doc, b.text AS fact FROM benchmark b, documents d WHERE contains(d.text, b.text))"


@query("a18_severance_by_type", f"WITH c AS ({_SLIDE}), {_TYPED}, w AS (SELECT g.*, length(fact) >= 12 AS span, length(fact) >= 12 AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc = g.doc AND contains(chunk, fact)) AS lost FROM g), q AS (SELECT qid, unnest(['all', type]) AS type, count(*) FILTER (span) AS spans, count(*) FILTER (lost) AS severed FROM w GROUP BY qid, w.type) SELECT type, CAST(sum(spans) AS BIGINT) AS spans, CAST(sum(severed) AS BIGINT) AS severed, count(*) AS queries, count(*) FILTER (severed > 0) AS queries_hit, round(100.0 * sum(severed) / nullif(sum(spans), 0), 6) AS span_pct, round(100.0 * count(*) FILTER (severed > 0) / count(*), 6) AS query_pct FROM q GROUP BY type")
def _(t):
    kind = F.when(F.length("text") < 200, "short").otherwise("long")
    facts = _gold(t).join(t("benchmark").select(F.col("item_id").alias("qid"), kind.alias("type"), F.col("text").alias("fact")), "qid")
    out = reporting.severance(facts, chunking.slide(t("documents"), "doc_id", "text", 512, 64))
    return out.withColumn("span_pct", F.round("span_pct", 6)).withColumn("query_pct", F.round("query_pct", 6))


@query("a25_equal_runs", "WITH e AS (SELECT user_id AS key, event_id % 3 AS run, CASE WHEN event_type <> 'error' THEN event_type END AS item FROM events), r AS (SELECT key, run, coalesce(list_sort(list(DISTINCT item) FILTER (item IS NOT NULL)), []) AS s FROM e GROUP BY key, run), k AS (SELECT key, count(*) AS runs, count(DISTINCT s) = 1 AS equal FROM r GROUP BY key), i AS (SELECT key, count(*) AS items FROM (SELECT DISTINCT key, item FROM e WHERE item IS NOT NULL) GROUP BY key), h AS (SELECT key, item, count(DISTINCT run) AS held FROM e WHERE item IS NOT NULL GROUP BY key, item) SELECT k.key, runs, coalesce(items, 0) AS items, coalesce((SELECT count(*) FROM h WHERE h.key = k.key AND held = runs), 0) AS common, equal FROM k LEFT JOIN i USING (key)")
def _(t):
    item = F.when(F.col("event_type") != "error", F.col("event_type"))
    rows = t("events").select(F.col("user_id").alias("key"), (F.col("event_id") % 3).alias("run"), item.alias("item"))
    return reporting.repeats(rows, "key", "run", "item")


@query("p16_extraction_gates", "SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus <> 'P') AS valid, round(avg(s), 6) AS mean, median(s) AS median, min(s) AS least, max(s) AS most, round(100.0 * avg(s) / 3600, 6) AS hours, max(s) < 90 AS in_time, round(count(*) FILTER (o_orderstatus <> 'P') / count(*), 6) AS valid_rate, count(*) = 10 AND count(*) FILTER (o_orderstatus <> 'P') = 10 AS all_valid, count(*) = 10 AND count(*) FILTER (o_orderstatus <> 'P') = 10 AND max(s) < 90 AS passed FROM (SELECT *, CAST(o_orderkey % 91 AS DOUBLE) AS s FROM orders) GROUP BY o_custkey")
def _(t):
    """Customers' orders stand for extractions."""
    out = reporting.extraction_gates(t("orders"), "o_custkey", F.col("o_orderstatus") != "P", F.col("o_orderkey") % 91, 10, 90, F.lit(100))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "hours", "valid_rate")})


# Repeatable bootstraps --------------------------------------------------------------------------


def _bootstrap_sql(rows: str, draws: int, scale: float) -> str:
    """Tests of ``rows`` (g, d) by the generator, place by place."""
    a, c, m = st.LCG
    return (
        f"WITH RECURSIVE r AS ({rows}), v AS (SELECT g, d, row_number() OVER (PARTITION BY g ORDER BY d) - 1 AS pos FROM r WHERE d IS NOT NULL), n AS (SELECT g, count(d) AS n, coalesce({scale} * avg(d), 0) AS mean FROM r GROUP BY g), "
        f"co AS (SELECT CAST(1 AS BIGINT) AS i, CAST({a} AS BIGINT) AS x, CAST({c} AS BIGINT) AS y UNION ALL SELECT i + 1, x * {a} % {m}, (y * {a} + {c}) % {m} FROM co WHERE i < (SELECT max(n) FROM n)), "
        f"st AS (SELECT k, CAST('0x' || substr(md5('0:' || k), 1, 7) AS BIGINT) AS x0 FROM range({draws}) z(k)), "
        f"pl AS (SELECT n.g, k, (x0 * x + y) % {m} * n // {m} AS pos FROM n JOIN co ON i <= n CROSS JOIN st), "
        "ms AS (SELECT g, k, avg(d) AS x FROM pl JOIN v USING (g, pos) GROUP BY g, k), "
        f"q AS (SELECT g, list_sort(list(x)) AS xs, greatest(least(2 * least(count(*) FILTER (x >= 0), count(*) FILTER (x <= 0)) / {draws}, 1), 1 / {draws}) AS p FROM ms GROUP BY g), "
        f"boot AS (SELECT n.g, n, round(mean, 6) AS mean, round(coalesce({scale} * xs[{int(0.025 * draws) + 1}], 0), 6) AS low, round(coalesce({scale} * xs[{int(0.975 * draws) + 1}], 0), 6) AS high, round(coalesce(p, 1), 6) AS p FROM n LEFT JOIN q USING (g))"
    )


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if kind == "double" else c for c, kind in df.dtypes))


_DIFFS = "SELECT lang AS g, CAST(quality - toxic AS DOUBLE) AS d FROM labels JOIN documents USING (doc_id)"


def _differences(t):
    return t("labels").join(t("documents").select("doc_id", F.col("lang").alias("g")), "doc_id").select("g", (F.col("quality") - F.col("toxic")).alias("d"))


@query("x3_bootstrap_by_place", _bootstrap_sql(_DIFFS, 10_000, 1.0) + " SELECT * FROM boot")
def _(t):
    return _rounded(st.bootstrap_lcg(_differences(t), "g", "d"))


@query("x4_bootstrap_percent", _bootstrap_sql(_DIFFS.replace("CAST(quality - toxic AS DOUBLE)", "CASE WHEN lang <> 'fr' THEN CAST(quality - toxic AS DOUBLE) END"), 4_000, 100.0) + " SELECT g, n, mean, low, high FROM boot")
def _(t):
    """One group has no differences: 0, 0 and 0."""
    rows = _differences(t).withColumn("d", F.when(F.col("g") != "fr", F.col("d")))
    return _rounded(st.bootstrap_lcg(rows, "g", "d", 4_000, scale=100.0)).drop("p")


@query("a27_claims", _bootstrap_sql(_DIFFS, 4_000, 100.0) + ", s AS (SELECT g, n, mean, low, high, round(100 * avg(quality), 2) + CASE WHEN g = 'de' THEN 1 ELSE 0 END AS pct, count(*) AS rows_, round(100 * avg(quality), 2) AS again FROM boot JOIN documents ON lang = g JOIN labels USING (doc_id) GROUP BY g, n, mean, low, high), c AS (SELECT 'mean:' || g AS \"check\", round(pct, 2) AS expected, again AS actual FROM s UNION ALL SELECT 'rows:' || g, n, rows_ FROM s UNION ALL SELECT 'excludes_zero:' || g, 1, CASE WHEN low > 0 OR high < 0 THEN 1 ELSE 0 END FROM s) SELECT \"check\", CAST(expected AS DOUBLE) AS expected, CAST(actual AS DOUBLE) AS actual, expected = actual AS ok FROM c")
def _(t):
    """The stored mean of one group is a point too high."""
    outcomes = t("labels").join(t("documents").select("doc_id", F.col("lang").alias("g")), "doc_id").select("g", "quality")
    pct = F.round(100 * F.avg("quality"), 2) + F.when(F.col("g") == "de", 1).otherwise(0)
    stored = outcomes.groupBy("g").agg(pct.alias("pct")).join(st.bootstrap_lcg(_differences(t), "g", "d", 4_000, scale=100.0).select("g", "n", "low", "high"), "g")
    return reporting.claims(outcomes, stored, "g", "quality")


@query("x9_gate_rules", _bootstrap_sql(_DIFFS, 4_000, 100.0) + ", b AS (SELECT max(mean) FILTER (g = 'en') > 0 AND max(p) FILTER (g = 'en') < 0.05 AS better_on_similar, max(low) FILTER (g = 'de') > -3 AS not_worse_on_novel, max(mean) FILTER (g = 'fr') > 0 AND max(p) FILTER (g = 'fr') < 0.05 AS beats_popularity, max(p) FILTER (g = 'es') <= 0.05 AS not_structural FROM boot) SELECT *, better_on_similar AND not_worse_on_novel AND beats_popularity AND not_structural AS permitted FROM b")
def _(t):
    """Languages stand for the four comparisons."""
    cases = {"en": ("similar", "base"), "de": ("novel", "base"), "fr": ("similar", "popularity"), "es": ("similar", "shuffled")}
    at = lambda i: F.coalesce(*(F.when(F.col("g") == g, case[i]) for g, case in cases.items()))
    deltas = st.bootstrap_lcg(_differences(t), "g", "d", 4_000, scale=100.0)
    return learning.gates(deltas.select(at(0).alias("split"), F.lit("learned").alias("a"), at(1).alias("b"), "mean", "low", "p"))


# Tables of pairs, the mini evaluation -----------------------------------------------------------

#: p of counts b and c by the logarithm of the gamma function.
_EXACT = "least(1, 2 * list_sum([exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)) FOR i IN range(least(b, c) + 1)]))"
_PAIRED = [f"{a}-{b}" for a, b in _PAIR_ARMS]


@query("a16_pair_table", f"WITH {_FAM}, d AS ({_FAM_ROWS}), f AS (SELECT family, round(100.0 * avg(diff), 6) AS delta, count(*) FILTER (diff > 0) AS b, count(*) FILTER (diff < 0) AS c FROM d GROUP BY family), p AS (SELECT family, delta, CASE WHEN b + c = 0 THEN 1 ELSE {_EXACT} END AS p FROM f), s AS (SELECT *, row_number() OVER (ORDER BY p, family) AS i, count(*) OVER () AS m FROM p), h AS (SELECT string_split(family, '/') AS x, delta, bool_and(p <= 0.05 / (m - i + 1)) OVER (ORDER BY i) AS ok FROM s) SELECT x[1] AS config, x[4] AS metric, " + ", ".join(f"max(delta) FILTER (x[3] = '{p}') AS \"{p}_delta\", bool_or(ok) FILTER (x[3] = '{p}') AS \"{p}_significant\"" for p in _PAIRED) + " FROM h WHERE len(x) = 4 AND x[2] = 'all' GROUP BY x[1], x[4]")
def _(t):
    deltas = _family(t).groupBy("family").agg(F.round(100.0 * F.avg("diff"), 6).alias("delta"), F.count_if(F.col("diff") > 0).alias("b"), F.count_if(F.col("diff") < 0).alias("c"))
    deltas = st.holm(deltas.withColumn("p", st.mcnemar(F.col("b"), F.col("c"))), "p", order="family")
    return reporting.pair_table(deltas, _PAIRED)


_REFUSAL = "Insufficient information."
_TALK = f"t AS (SELECT [lang, source] AS golds, quality = 1 AS found, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE 'none' END AS closed, CASE WHEN toxic = 1 OR doc_id % 7 = 0 THEN '{_REFUSAL}' ELSE source || ' it is' END AS rag, CASE WHEN doc_id % 14 = 0 THEN '{_REFUSAL}' WHEN doc_id % 2 = 0 THEN lang ELSE 'unsure' END AS ablated FROM labels JOIN documents USING (doc_id))"
_HELD = lambda c: f"len(list_filter(golds, lambda g: {_N5.format('g')} <> '' AND contains({_N5.format(c)}, {_N5.format('g')}))) > 0"
_TALK_SQL = f"""WITH {_TALK}, top AS (SELECT golds[1] AS answer FROM t GROUP BY golds[1] ORDER BY count(*) DESC, golds[1] LIMIT 1),
e AS (SELECT found, {_HELD('closed')} AS m0, {_HELD('rag')} AS m1, {_HELD('ablated')} AS m2, closed = '{_REFUSAL}' AS a0, rag = '{_REFUSAL}' AS a1, ablated = '{_REFUSAL}' AS a2, len(list_filter(golds, lambda g: {_N1.format('g')} <> '' AND contains({_N1.format('answer')}, {_N1.format('g')}))) > 0 AS k FROM t, top),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (m0) AS m0, count(*) FILTER (m1) AS m1, count(*) FILTER (m2) AS m2, count(*) FILTER (a0) AS a0, count(*) FILTER (a1) AS a1, count(*) FILTER (a2) AS a2, count(*) FILTER (m1 AND NOT m0) AS b, count(*) FILTER (m0 AND NOT m1) AS c, count(*) FILTER (found) AS f, count(*) FILTER (found AND a1) AS fa, count(*) FILTER (NOT found AND a1) AS ma, count(*) FILTER (a1 AND NOT a2) AS flips, count(*) FILTER (a1 AND NOT a2 AND m2) AS fm, count(*) FILTER (k) AS k, 1.959963984540054 AS z FROM e),
w AS (SELECT *, m0 / n AS p0, m1 / n AS p1, 1 + z * z / n AS d FROM s),
o AS (SELECT unnest([struct_pack(metric := 'questions', value := n), struct_pack(metric := 'base_containment', value := 100.0 * m0 / n), struct_pack(metric := 'base_low', value := round(100 * ((p0 + z*z/(2*n)) / d - z / d * sqrt(p0*(1-p0)/n + z*z/(4*n*n))), 2)), struct_pack(metric := 'base_high', value := round(100 * ((p0 + z*z/(2*n)) / d + z / d * sqrt(p0*(1-p0)/n + z*z/(4*n*n))), 2)), struct_pack(metric := 'base_abstained', value := 100.0 * a0 / n),
struct_pack(metric := 'arm_containment', value := 100.0 * m1 / n), struct_pack(metric := 'arm_low', value := round(100 * ((p1 + z*z/(2*n)) / d - z / d * sqrt(p1*(1-p1)/n + z*z/(4*n*n))), 2)), struct_pack(metric := 'arm_high', value := round(100 * ((p1 + z*z/(2*n)) / d + z / d * sqrt(p1*(1-p1)/n + z*z/(4*n*n))), 2)), struct_pack(metric := 'arm_abstained', value := 100.0 * a1 / n),
struct_pack(metric := 'delta_pp', value := 100.0 * (b - c) / n), struct_pack(metric := 'mcnemar_p', value := {_EXACT}), struct_pack(metric := 'abstained_when_retrieved', value := 100.0 * fa / nullif(f, 0)), struct_pack(metric := 'abstained_when_missed', value := 100.0 * ma / nullif(n - f, 0)), struct_pack(metric := 'constant_containment', value := 100.0 * k / n),
struct_pack(metric := 'ablated_containment', value := 100.0 * m2 / n), struct_pack(metric := 'ablated_abstained', value := 100.0 * a2 / n), struct_pack(metric := 'refusals_that_answer', value := CAST(flips AS DOUBLE)), struct_pack(metric := 'of_them_contained', value := CAST(fm AS DOUBLE))]) AS x FROM w)
SELECT x.metric AS metric, round(x.value, 6) AS value FROM o"""


@query("u8_evaluation_report", _TALK_SQL)
def _(t):
    """Answers by rule stand for the models'."""
    d = t("labels").join(t("documents").select("doc_id", "lang", "source"), "doc_id")
    i = F.col("doc_id")
    rows = d.select(
        F.array("lang", "source").alias("golds"),
        (F.col("quality") == 1).alias("found"),
        F.when(i % 3 == 0, F.upper("lang")).otherwise("none").alias("closed"),
        F.when((F.col("toxic") == 1) | (i % 7 == 0), _REFUSAL).otherwise(F.concat("source", F.lit(" it is"))).alias("rag"),
        F.when(i % 14 == 0, _REFUSAL).when(i % 2 == 0, F.col("lang")).otherwise("unsure").alias("ablated"),
    )
    out = reporting.mini_evaluation(rows, "closed", "rag", "ablated", "golds", "found", "insufficient information")
    return out.withColumn("value", F.round("value", 6))


# Graph figures, table functions, segmenters -----------------------------------------------------


@query("a12_descriptions", f"WITH {_MENT} SELECT name, string_agg(description, '|' ORDER BY chunk, seq, description) AS descriptions FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY chunk, seq, description) AS i FROM m WHERE coalesce(description, '') <> '') WHERE i <= 5 GROUP BY name")
def _(t):
    return graph.vertices(_mentions(t)).select("name", F.array_join("descriptions", "|").alias("descriptions")).filter("descriptions != ''")


@query("a14_phantom_edges", f"WITH {_MENT}{_EDGE}, v AS (SELECT DISTINCT name FROM m WHERE type <> 'SMALL' AND name NOT LIKE 'red%'), k AS (SELECT * FROM e WHERE a IN (SELECT name FROM v) AND b IN (SELECT name FROM v)), d AS (SELECT x, count(*) AS d FROM (SELECT a AS x FROM k UNION ALL SELECT b FROM k) GROUP BY x) SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM k) AS edges, (SELECT count(*) FROM e) - (SELECT count(*) FROM k) AS phantom, (SELECT coalesce(round(avg(d), 6), 0) FROM d) AS degree_mean, (SELECT coalesce(median(d), 0) FROM d) AS degree_median, (SELECT count(*) FROM v) - (SELECT count(*) FROM d) AS isolated")
def _(t):
    known = _mentions(t).filter("type != 'SMALL' AND name NOT LIKE 'red%'")
    return graph.stats(graph.vertices(known), _edges(t))


@query("a14_chunk_coverage", "SELECT (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'O') AS excluded, (SELECT count(DISTINCT l_orderkey) FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' AND p_type = 'SMALL') AS covered")
def _(t):
    units = t("orders").select(F.col("o_orderkey").alias("chunk"), (F.col("o_orderstatus") == "O").alias("ok"))
    return graph.coverage(_mentions(t).filter("type = 'SMALL'"), units)


@query("u6_pack_table", f"{_PACKED} SELECT * FROM packed")
def _(t):
    return chunking.pack_table(t("documents"), "doc_id", "source", "text", 120).withColumn("n_tokens", F.col("n_tokens").cast("long"))


#: Words of the dictionary in the query: the commonest pairs and triples of letters stand for a language's words.
_PARTS = ["the", "and", "tion", "ing", "est", "eau", "oue", "lle", "sch", "ung", "ein", "los", "que", "ent"]


@query("t4_dictionary_segments", "SELECT doc_id AS doc, len(list_filter(regexp_extract_all(text, '" + "|".join(sorted(_PARTS, key=len, reverse=True)) + "|[\\s\\S]'), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]'))) AS n FROM documents")
def _(t):
    return chunking.segments(t("documents"), "doc_id", "text", lambda: chunking.LongestMatch(_PARTS)).select("doc", F.size("tokens").cast("long").alias("n"))
