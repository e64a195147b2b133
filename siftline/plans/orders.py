"""Queries over orders of whole tables: signed ranks, risk by coverage, rank correlation, equivalence; answers scored by tokens."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sql
from ..functions import stats as st
from ..functions import text as tx
from .queries import _N1, _discord, query

# Signed ranks -------------------------------------------------------------------------------

#: Steps of eight between a user's events, for each kind of event and for each user and kind: tied and zero ones among them.
_STEPS = "e AS (SELECT user_id, event_type, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events), s AS (SELECT unnest([event_type, event_type || ' ' || user_id]) AS grp, floor(d / 8) AS d FROM e WHERE d IS NOT NULL)"
_SIGNED = f"""WITH RECURSIVE {_STEPS},
c AS (SELECT grp, abs(d) AS a, count(*) AS n, count(*) FILTER (d > 0) AS up FROM s WHERE d <> 0 GROUP BY ALL),
r AS (SELECT *, 2 * coalesce(sum(n) OVER (PARTITION BY grp ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n + 1 AS r2 FROM c),
t AS (SELECT grp, CAST(sum(n) AS BIGINT) AS n, CAST(sum(up * r2) AS BIGINT) AS w2, sum(n * n * n - n) AS ties FROM r GROUP BY grp),
z AS (SELECT *, (w2 / 2.0 - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS z FROM t),
x AS (SELECT grp, r2, row_number() OVER (PARTITION BY grp ORDER BY r2) AS i FROM (SELECT grp, r2, unnest(range(n)) FROM r WHERE grp IN (SELECT grp FROM t WHERE n <= 50))),
w AS (SELECT DISTINCT grp, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS s, CAST(1 AS DOUBLE) AS ways FROM x
      UNION ALL SELECT w.grp, any_value(x.i), CAST(w.s + k * x.r2 AS BIGINT), sum(ways) FROM w JOIN x ON x.grp = w.grp AND x.i = w.i + 1, (VALUES (0), (1)) v(k) GROUP BY w.grp, CAST(w.s + k * x.r2 AS BIGINT)),
ex AS (SELECT z.grp, least(1, 2 * least(sum(ways) FILTER (w.s <= w2), sum(ways) FILTER (w.s >= w2)) / 2.0 ** any_value(n)) AS p FROM z JOIN w ON w.grp = z.grp AND w.i = z.n GROUP BY z.grp),
nm AS (SELECT grp, sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(0 - (abs(z) + i * 0.003) * (abs(z) + i * 0.003) / 2)) * 0.001 * 2 / sqrt(2 * pi()) AS p FROM z, (SELECT unnest(range(4001)) AS i) WHERE n > 50 GROUP BY grp)
SELECT g.grp, coalesce(z.n, 0) AS n, round(coalesce(w2 / 2.0, 0), 1) AS w_plus, round(coalesce(z.n * (z.n + 1) / 2 - w2 / 2.0, 0), 1) AS w_minus, round(coalesce(z, 0), 8) AS z, round(coalesce(ex.p, nm.p, 1), 8) AS p
FROM (SELECT DISTINCT grp FROM s) g LEFT JOIN z USING (grp) LEFT JOIN ex USING (grp) LEFT JOIN nm USING (grp)"""


@query("x10_signed_rank", _SIGNED)
def _(t):
    step = F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = t("events").select("event_type", "user_id", step.alias("d")).filter("d IS NOT NULL")
    kinds = F.explode(F.array("event_type", F.concat_ws(" ", "event_type", "user_id")))
    rows = rows.select(kinds.alias("grp"), F.floor(F.col("d") / 8).alias("d"))
    return st.signed_rank(rows, "grp", "d").select("grp", "n", "w_plus", "w_minus", F.round("z", 8).alias("z"), F.round("p", 8).alias("p"))


# Risk by coverage -----------------------------------------------------------------------------

#: A rule for a model: sure by the text's length, right where the length's parity says the quality.
_RISK = "b AS (SELECT lang, n_chars % 97 AS score, quality <> n_chars % 2 AS wrong FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, score, count(*) AS taken, count(*) FILTER (wrong) AS e FROM b GROUP BY ALL), k AS (SELECT lang, score, taken, CAST(sum(taken) OVER w AS BIGINT) AS covered, CAST(sum(e) OVER w AS BIGINT) AS errors, CAST(sum(taken) OVER (PARTITION BY lang) AS BIGINT) AS n FROM c WINDOW w AS (PARTITION BY lang ORDER BY score DESC))"


def _curve(t):
    rows = t("labels").join(t("documents"), "doc_id").select("lang", (F.col("n_chars") % 97).alias("score"), (F.col("quality") != F.col("n_chars") % 2).alias("wrong"))
    return st.risk_coverage(rows, ["lang"], "score", "wrong")


@query("x11_risk_coverage", f"WITH {_RISK} SELECT lang, score, taken, covered, errors, round(covered / n, 9) AS coverage, round(errors / covered, 9) AS risk FROM k")
def _(t):
    return _curve(t).withColumns({c: F.round(c, 9) for c in ("coverage", "risk")})


_AREA = ", a AS (SELECT lang, CAST(sum(taken) AS BIGINT) AS n, max_by(errors / covered, covered) AS risk, sum(errors / covered * taken) / sum(taken) AS area FROM k GROUP BY lang) SELECT lang, n, round(risk, 9) AS risk, round(area, 9) AS area, round(area - CASE WHEN risk >= 1 THEN 1 ELSE risk + (1 - risk) * ln(1 - risk) END, 9) AS excess FROM a"


@query("x11_risk_area", f"WITH {_RISK}{_AREA}")
def _(t):
    return st.risk_area(_curve(t), ["lang"]).withColumns({c: F.round(c, 9) for c in ("risk", "area", "excess")})


# Rank correlation -------------------------------------------------------------------------------

_TAU = """WITH o AS (SELECT o_orderpriority AS priority, floor(o_totalprice / 50) AS x, CAST(epoch(o_orderdate) / 86400 AS BIGINT) AS y FROM orders),
p AS (SELECT priority, x, y, count(*) AS n FROM o GROUP BY ALL),
d AS (SELECT a.priority, sum(a.n * b.n) FILTER (b.y < a.y) AS discordant, sum(a.n * b.n) FILTER (b.y > a.y) AS concordant FROM p a JOIN p b ON a.priority = b.priority AND a.x < b.x GROUP BY ALL),
t AS (SELECT priority, sum(n * (n - 1)) AS tx FROM (SELECT priority, x, sum(n) AS n FROM p GROUP BY ALL) GROUP BY priority),
u AS (SELECT priority, sum(n * (n - 1)) AS ty FROM (SELECT priority, y, sum(n) AS n FROM p GROUP BY ALL) GROUP BY priority),
m AS (SELECT priority, sum(n) AS n FROM p GROUP BY priority)
SELECT priority, CAST(n AS BIGINT) AS n, CAST(concordant AS BIGINT) AS concordant, CAST(discordant AS BIGINT) AS discordant, round(2 * (concordant - discordant) / (sqrt(n * (n - 1) - tx) * sqrt(n * (n - 1) - ty)), 9) AS tau_b
FROM d JOIN t USING (priority) JOIN u USING (priority) JOIN m USING (priority)"""


@query("x12_kendall", _TAU)
def _(t):
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    rows = t("orders").select(F.col("o_orderpriority").alias("priority"), F.floor(F.col("o_totalprice") / 50).alias("x"), days.alias("y"))
    return st.kendall(rows, ["priority"], "x", "y").withColumn("tau_b", F.round("tau_b", 9))


# Paired tests without new mechanism ---------------------------------------------------------

_MID = "WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic <> 1) AS b, count(*) FILTER (toxic = 1 AND quality <> 1) AS c FROM labels JOIN documents USING (doc_id) GROUP BY lang), lf AS (SELECT i, sum(CASE WHEN i = 0 THEN 0 ELSE ln(i) END) OVER (ORDER BY i) AS l FROM (SELECT unnest(range(0, (SELECT max(b + c) + 1 FROM c))) AS i)), q AS (SELECT lang, b, c, a.i AS i, exp(n.l - a.l - r.l - (b + c) * ln(2)) AS q FROM c JOIN lf n ON n.i = b + c JOIN lf a ON a.i <= least(b, c) JOIN lf r ON r.i = b + c - a.i) SELECT lang, round(CASE WHEN b = c THEN 1 - sum(q) FILTER (i = least(b, c)) ELSE 2 * sum(q) - sum(q) FILTER (i = least(b, c)) END, 9) AS p FROM q GROUP BY lang, b, c"


@query("x13_mid_p", _MID)
def _(t):
    return _discord(t).select("lang", F.round(st.mid_p(F.col("b"), F.col("c")), 9).alias("p"))


_TOST = "WITH d AS (SELECT lang, 100.0 * (quality - toxic) AS d FROM labels JOIN documents USING (doc_id)), m AS (SELECT lang, count(d) AS n, avg(d) AS mean, 1.6448536269514722 * stddev_samp(d) / sqrt(count(d)) AS half FROM d GROUP BY lang) SELECT lang, n, round(mean, 6) AS mean, round(mean - half, 6) AS low, round(mean + half, 6) AS high, coalesce(mean - half > -7 AND mean + half < 7, false) AS equivalent FROM m"


@query("x14_equivalence", _TOST)
def _(t):
    rows = t("labels").join(t("documents"), "doc_id").select("lang", (100.0 * (F.col("quality") - F.col("toxic"))).alias("d"))
    return st.equivalence(rows, "lang", "d", 7.0).withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")})


# Answers by tokens ------------------------------------------------------------------------------

_TURNS = f"a AS (SELECT conv_id, turn, {_N1.format('text')} AS answer, {_N1.format('lag(text) OVER (PARTITION BY conv_id ORDER BY turn)')} AS gold FROM conversations)"
_TOKENS = f"""WITH {_TURNS}, b AS (SELECT *, [x FOR x IN string_split(answer, ' ') IF x <> ''] AS ta, [x FOR x IN string_split(gold, ' ') IF x <> ''] AS tg FROM a WHERE gold IS NOT NULL AND answer IS NOT NULL),
c AS (SELECT *, list_sum([least(len(list_filter(ta, lambda y: y = x)), len(list_filter(tg, lambda y: y = x))) FOR x IN list_distinct(ta)]) AS common, len(list_intersect(list_distinct(ta), list_distinct(tg))) AS shared, len(list_distinct(ta)) + len(list_distinct(tg)) AS kinds FROM b)
SELECT conv_id, turn, answer = gold AS em, round(CASE WHEN len(ta) + len(tg) = 0 THEN 1 ELSE 2 * coalesce(common, 0) / (len(ta) + len(tg)) END, 9) AS f1, round(CASE WHEN kinds = 0 THEN 1 ELSE 2 * shared / kinds END, 9) AS set_f1 FROM c"""


@query("a28_token_f1", _TOKENS)
def _(t):
    gold = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t("conversations").select("conv_id", "turn", tx.latin(F.col("text")).alias("answer"), tx.latin(gold).alias("gold")).filter("answer IS NOT NULL AND gold IS NOT NULL")
    em, f1, set_f1 = tx.answer_scores(F.col("answer"), F.col("gold"))
    return rows.select("conv_id", "turn", em.alias("em"), F.round(f1, 9).alias("f1"), F.round(set_f1, 9).alias("set_f1"))


# Statistics called from SQL -----------------------------------------------------------------

_DRAWS = 400


def _weights() -> str:
    u = "CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':' || CAST(draw // 4 AS VARCHAR)), CAST(1 + 8 * (draw % 4) AS INT), 8) AS BIGINT) AS DOUBLE) / 4294967296"
    copies = " + ".join(f"CAST(u >= {s!r} AS INT)" for s in sql.SHARES)
    return f"d AS (SELECT lang, doc_id, quality - toxic AS d FROM labels JOIN documents USING (doc_id)), k AS (SELECT lang, d, draw, {u} AS u FROM d, (SELECT unnest(range({_DRAWS})) AS draw)), m AS (SELECT lang, draw, sum(({copies}) * d) / nullif(sum({copies}), 0) AS x FROM k GROUP BY ALL)"


def _outcomes(t):
    return t("labels").join(t("documents").select("doc_id", "lang"), "doc_id").withColumn("d", F.col("quality") - F.col("toxic"))


_ENDS = f", s AS (SELECT lang, list_sort(list(coalesce(x, 0))) AS xs, greatest(least(2 * least(count(*) FILTER (coalesce(x, 0) >= 0), count(*) FILTER (coalesce(x, 0) <= 0)) / {_DRAWS}.0, 1), 1 / {_DRAWS}.0) AS p FROM m GROUP BY lang) SELECT lang, n, round(mean, 6) AS mean, round(xs[{int(0.025 * _DRAWS) + 1}], 6) AS low, round(xs[{int(0.975 * _DRAWS) + 1}], 6) AS high, round(p, 6) AS p FROM s JOIN (SELECT lang, count(*) AS n, avg(d) AS mean FROM d GROUP BY lang) USING (lang)"


@query("u7_poisson_bootstrap", f"WITH {_weights()}{_ENDS}")
def _(t):
    return sql.poisson_bootstrap(_outcomes(t), "lang", "d", "doc_id", _DRAWS).withColumns({c: F.round(c, 6) for c in ("mean", "low", "high", "p")})


@query("u7_weights_in_sql", f"WITH {_weights()} SELECT lang, draw, round(x, 6) AS mean FROM m WHERE draw % 50 = 0")
def _(t):
    rows = _outcomes(t)
    rows.createOrReplaceTempView("u7_outcomes")
    sql.register(rows.sparkSession)
    return rows.sparkSession.sql(f"SELECT lang, draw, round(sum(poisson_weight(doc_id, draw) * d) / sum(poisson_weight(doc_id, draw)), 6) AS mean FROM u7_outcomes LATERAL VIEW explode(sequence(0L, {_DRAWS - 1}L, 50L)) AS draw GROUP BY lang, draw")


_PER_LANG = "o AS (SELECT lang, count(*) FILTER (quality = 1) AS k, count(*) AS n, count(*) FILTER (quality = 1 AND toxic <> 1) AS b, count(*) FILTER (toxic = 1 AND quality <> 1) AS c FROM labels JOIN documents USING (doc_id) GROUP BY lang)"
_TESTS = f"WITH {_PER_LANG}, w AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM o), x AS (SELECT lang, b, c, unnest(range(0, least(b, c) + 1)) AS i FROM o), t AS (SELECT lang, least(1, 2 * sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))) AS mcnemar FROM x GROUP BY lang) SELECT lang, round(100 * (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 2) AS low, round(100 * (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 2) AS high, round(CASE WHEN b = c THEN 1 ELSE mcnemar END, 9) AS p FROM w JOIN t USING (lang)"


@query("u7_tests_in_sql", _TESTS)
def _(t):
    rows = _outcomes(t)
    rows.createOrReplaceTempView("u7_outcomes")
    sql.register(rows.sparkSession)
    return rows.sparkSession.sql("SELECT lang, w.low, w.high, round(p, 9) AS p FROM (SELECT lang, wilson(count_if(quality = 1), count(*)) AS w, mcnemar(count_if(quality = 1 AND toxic <> 1), count_if(toxic = 1 AND quality <> 1)) AS p FROM u7_outcomes GROUP BY lang)")
