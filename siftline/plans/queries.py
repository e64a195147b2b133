"""One query for each operator over the tables of a folder, and the SQL it must agree with.

Keys start with the operator's id in the coverage list (README). Query sets are all benchmark items,
and for vectors every row whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats as st
from ..functions import text as tx
from ..operators import chunking, graph, ordered, retrieval, runlog
from ..sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# Sources ----------------------------------------------------------------------------------------


@query("s1_parquet_scan", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(t):
    return t("documents").select("doc_id", "lang", "source", "n_chars")


@query("s3_tolerant_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props) AND json_extract(props, '$.k') IS NOT NULL")
def _(t):
    return t("events").select("event_id", F.from_json("props", "k long").alias("p")).filter("p.k IS NOT NULL").select("event_id", F.col("p.k").alias("k"))


_NESTED = """WITH n AS (SELECT conv_id, list(struct_pack(turn := turn, role := role) ORDER BY turn) AS turns FROM conversations GROUP BY conv_id)
SELECT conv_id, len(turns) AS n_turns, array_to_string(list_sort(list_distinct([x.role FOR x IN turns])), ',') AS roles FROM n"""


@query("s5_nested_flatten", _NESTED)
def _(t):
    nested = t("conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"))
    flat = nested.select("conv_id", F.explode("turns").alias("x")).select("conv_id", "x.turn", "x.role")
    golds = F.array_sort(F.array_distinct(F.filter(F.collect_list("role"), lambda r: F.trim(r) != "")))
    return flat.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(golds, ",").alias("roles"))


@query("s13_manifest", "SELECT count(*) AS n_rows, sum(length(text)) AS n_chars, CAST(sum(CAST(CAST('0x' || substr(sha256(text), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM documents")
def _(t):
    return io.manifest(t("documents"), "text")


@query("s15_fingerprint", "SELECT lang, count(*) AS n_rows, CAST(sum(CAST(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR) || chr(1) || text), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM documents GROUP BY lang")
def _(t):
    d = t("documents").withColumn("row", F.concat(F.col("doc_id").cast("string"), F.lit("\x01"), "text"))
    part = F.conv(F.substring(F.sha2(F.col("row").cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return d.groupBy("lang").agg(F.count("*").alias("n_rows"), F.sum(part).cast("string").alias("digest"))


@query("s16_log_scrape", "SELECT user_id, max_by(CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT), event_id) AS last_k FROM events WHERE regexp_matches(props, '\"k\": [0-9]+') GROUP BY user_id")
def _(t):
    k = F.regexp_extract("props", r'"k": ([0-9]+)', 1)
    return t("events").withColumn("k", k).filter("k != ''").groupBy("user_id").agg(F.max_by(F.col("k").cast("long"), "event_id").alias("last_k"))


# Predicates and projections ---------------------------------------------------------------------


@query("p1_category_filter", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def _(t):
    return t("documents").filter(F.col("lang").isin("en", "de")).select("doc_id", "lang")


_EVIDENCE = "FROM lineitem l LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 45) p ON l.l_partkey = p.p_partkey GROUP BY l_orderkey"


def _evidence(t) -> DataFrame:
    corpus = t("part").filter("p_size < 45").select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("found"))
    rows = t("lineitem").select("l_orderkey", "l_partkey").join(corpus, "l_partkey", "left")
    return rows.groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("n_gold"), F.count_distinct(F.when(F.col("found") == 1, F.col("l_partkey"))).alias("n_in"))


@query("p2_evidence_strict", f"SELECT l_orderkey, count(DISTINCT l_partkey) AS n_gold {_EVIDENCE} HAVING count(DISTINCT p_partkey) = count(DISTINCT l_partkey) AND count(DISTINCT p_partkey) > 0")
def _(t):
    return _evidence(t).filter("n_in = n_gold AND n_in > 0").select("l_orderkey", "n_gold")


@query("p3_evidence_loose", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_size < 45)")
def _(t):
    held = t("lineitem").join(t("part").filter("p_size < 45").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return t("orders").select("o_orderkey").join(held.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("p4_header_strip", "WITH h AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN source || chr(10) || chr(10) || text ELSE text END AS body FROM documents) SELECT doc_id, md5(CASE WHEN starts_with(body, source || chr(10) || chr(10)) THEN substr(body, length(source) + 3) ELSE body END) AS body_md5 FROM h")
def _(t):
    head = F.concat("source", F.lit("\n\n"))
    d = t("documents").withColumn("body", F.when(F.col("doc_id") % 2 == 0, F.concat(head, "text")).otherwise(F.col("text")))
    body = F.when(F.col("body").startswith(head), F.col("body").substr(F.length(head) + 1, F.length("body"))).otherwise(F.col("body"))
    return d.select("doc_id", F.md5(body.cast("binary")).alias("body_md5"))


@query("p5_header_variants", "SELECT doc_id, md5(text) AS body, md5(concat_ws(' — ', nullif(lang, ''), text)) AS titled, md5(concat_ws(' — ', nullif(lang, ''), nullif(source, ''), text)) AS sourced FROM documents")
def _(t):
    md5 = lambda c: F.md5(c.cast("binary"))
    some = lambda c: F.expr(f"nullif({c}, '')")
    return t("documents").select("doc_id", md5(F.col("text")).alias("body"), md5(F.concat_ws(" — ", some("lang"), "text")).alias("titled"), md5(F.concat_ws(" — ", some("lang"), some("source"), "text")).alias("sourced"))


@query("p6_context_trim", "SELECT doc_id, length(substr(text, 1, 2500)) AS n, md5(substr(text, 1, 2500)) AS context_md5 FROM documents")
def _(t):
    c = F.substring("text", 1, 2500)
    return t("documents").select("doc_id", F.length(c).alias("n"), F.md5(c.cast("binary")).alias("context_md5"))


_N1 = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_N5 = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


_SAID = "SELECT *, CASE WHEN turn % 2 = 0 THEN upper(role) || ': ' || text ELSE text END AS answer FROM conversations"


@query("p7_containment", f"SELECT conv_id, turn, {_N1.format('role')} <> '' AND contains({_N1.format('answer')}, {_N1.format('role')}) AS found FROM ({_SAID})")
def _(t):
    answer = F.when(F.col("turn") % 2 == 0, F.concat(F.upper("role"), F.lit(": "), "text")).otherwise(F.col("text"))
    gold = tx.latin(F.col("role"))
    return t("conversations").select("conv_id", "turn", ((gold != "") & tx.latin(answer).contains(gold)).alias("found"))


@query("p8_containment_any", f"SELECT doc_id, contains({_N5.format('text')}, 'der') OR contains({_N5.format('text')}, 'que') AS found FROM documents")
def _(t):
    golds = F.array(*(tx.letters_only(F.lit(g)) for g in ("Der!", "", "q-ue")))
    return t("documents").select("doc_id", tx.contains_any(tx.letters_only(F.col("text")), golds).alias("found"))


@query("p10_abstention", f"WITH p(lang, phrase) AS (VALUES ('en', 'that'), ('de', 'und'), ('fr', 'les'), ('es', 'los')) SELECT doc_id, bool_or(contains({_N5.format('text')}, {_N5.format('phrase')})) AS abstained FROM documents d JOIN p ON p.lang = d.lang OR p.lang = 'en' GROUP BY doc_id")
def _(t):
    phrases = {"en": "that", "de": "und", "fr": "les", "es": "los"}
    text = tx.letters_only(F.col("text"))
    own = F.coalesce(*(F.when(F.col("lang") == k, text.contains(v)) for k, v in phrases.items()), F.lit(False))
    return t("documents").filter(F.col("lang").isNotNull()).select("doc_id", (own | text.contains(phrases["en"])).alias("abstained"))


@query("p11_error_rows", "SELECT event_id, starts_with(event_type, 'error') AS is_error, event_type = 'signup' AS truncated FROM events")
def _(t):
    return t("events").select("event_id", F.col("event_type").startswith("error").alias("is_error"), (F.col("event_type") == "signup").alias("truncated"))


@query("p13_extraction_status", "SELECT event_id, CASE WHEN event_type = 'signup' THEN 'truncated' WHEN NOT json_valid(p) THEN 'unparseable' ELSE 'ok' END AS status FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN substr(props, 1, 4) ELSE props END AS p FROM events)")
def _(t):
    e = t("events").withColumn("p", F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")))
    bad = F.from_json("p", "k long, _corrupt_record string", {"mode": "PERMISSIVE"})
    e = e.withColumn("j", bad)
    return e.select("event_id", F.when(F.col("event_type") == "signup", "truncated").when(F.col("j._corrupt_record").isNotNull() | F.col("j").isNull(), "unparseable").otherwise("ok").alias("status"))


@query("p15_min_length", "SELECT item_id, length(text) AS n FROM benchmark WHERE length(text) >= 200")
def _(t):
    return t("benchmark").filter(F.length("text") >= 200).select("item_id", F.length("text").alias("n"))


@query("p16_gates", "SELECT event_type, count(*) >= 100 AND max(value) < 1000 AND avg(value) > 0 AS passed FROM events GROUP BY event_type")
def _(t):
    return t("events").groupBy("event_type").agg(((F.count("*") >= 100) & (F.max("value") < 1000) & (F.avg("value") > 0)).alias("passed"))


@query("p17_default_fill", "SELECT l_orderkey, l_linenumber, coalesce(nullif(CAST(l_discount * 100 AS BIGINT), 0), 1) AS strength, coalesce(nullif(p_type, ''), 'OTHER') AS type FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size < 30")
def _(t):
    p = t("part").filter("p_size < 30").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    strength = F.coalesce(F.expr("nullif(cast(round(l_discount * 100) as bigint), 0)"), F.lit(1).cast("long"))
    return t("lineitem").join(p, "l_partkey", "left").select("l_orderkey", "l_linenumber", strength.alias("strength"), F.coalesce(F.expr("nullif(p_type, '')"), F.lit("OTHER")).alias("type"))


# Text -------------------------------------------------------------------------------------------

_SQ = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query("t1_normalisers", f"SELECT doc_id, md5({_N1.format('text')}) AS n1, md5({_SQ.format('lower(text)')}) AS n2, md5({_SQ.format('text')}) AS n4, md5({_N5.format('text')}) AS n5 FROM documents")
def _(t):
    c, md5 = F.col("text"), lambda c: F.md5(c.cast("binary"))
    return t("documents").select("doc_id", md5(tx.latin(c)).alias("n1"), md5(tx.lowered(c)).alias("n2"), md5(tx.spaced(c)).alias("n4"), md5(tx.letters_only(c)).alias("n5"))


@query("t2_latin_tokens", "SELECT tok AS term, count(*) AS tf FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM documents) GROUP BY tok")
def _(t):
    return t("documents").select(F.explode(tx.latin_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))


@query("t3_unicode_tokens", "SELECT tok AS term, count(*) AS tf FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS tok FROM documents) GROUP BY tok")
def _(t):
    return t("documents").select(F.explode(tx.unicode_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))


_BIGRAMS = "CAST(coalesce(list_sum([greatest(length(w) - 1, 1) FOR w IN regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')]), 0) AS INT) AS n"


@query("t4_bigram_segmenter", f"SELECT item_id, {_BIGRAMS} FROM benchmark")
def _(t):
    return t("benchmark").select("item_id", F.size(tx.bigram_tokens(F.col("text"))).alias("n"))


@query("t4_bigram_documents", f"SELECT doc_id, {_BIGRAMS} FROM documents")
def _(t):
    return t("documents").select("doc_id", F.size(tx.bigram_tokens(F.col("text"))).alias("n"))


@query("t5_discarded_script", "SELECT lang, count(*) FILTER (regexp_matches(text, '[^\\x00-\\x7F]')) AS n_dropped FROM (SELECT lang, regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g') AS text FROM documents) GROUP BY lang")
def _(t):
    return t("documents").groupBy("lang").agg(F.sum(tx.drops_script(F.col("text")).cast("long")).alias("n_dropped"))


@query("t6_sentences", "SELECT doc_id, count(*) AS n_sentences, sum(length(s)) AS n_chars FROM (SELECT doc_id, trim(unnest(regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t\\r\\n\\f\\v]+', '\\1' || chr(10), 'g'), chr(10)))) AS s FROM documents) WHERE s <> '' GROUP BY doc_id")
def _(t):
    s = t("documents").select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("s.text")).alias("n_chars"))


@query("t7_token_count", "SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS n_tokens FROM documents")
def _(t):
    return t("documents").select("doc_id", F.size(tx.unicode_tokens(F.col("text"))).cast("long").alias("n_tokens"))


_WORDS = "len(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'))"
_CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
#: Greedy packing of documents under 120 words, sentence by sentence.
_PACKED = f"""WITH RECURSIVE d AS (SELECT doc_id AS doc, {_CLEAN.format('source')} AS title, {_CLEAN.format('text')} AS body FROM documents),
r AS (SELECT doc, body, title, CAST(120 - {_WORDS.format('title')} AS INT) AS room FROM d WHERE body <> '' AND {_WORDS.format('title')} < 120),
par AS (SELECT doc, room, generate_subscripts(ps, 1) AS pi, unnest(ps) AS t FROM (SELECT doc, room, string_split(body, chr(10) || chr(10)) AS ps FROM r)),
sen AS (SELECT doc, room, pi, list_filter([trim(x) FOR x IN string_split(regexp_replace(t, '([.!?])[ \\t\\r\\n\\f\\v]+', '\\1' || chr(10), 'g'), chr(10))], lambda x: x <> '') AS ss FROM par),
u0 AS (SELECT doc, room, pi, generate_subscripts(ss, 1) AS si, unnest(ss) AS s FROM sen),
u1 AS (SELECT *, {_WORDS.format('s')} AS n FROM u0),
cut AS (SELECT doc, room, pi, si, regexp_extract_all(s, '(?:[^\\p{{L}}\\p{{N}}_]*[\\p{{L}}\\p{{N}}_]+){{1,' || room || '}}[^\\p{{L}}\\p{{N}}_]*') AS xs FROM u1 WHERE n > room),
u2 AS (SELECT doc, room, pi, si, 0 AS hi, s, si = 1 AS p, n, false AS hard FROM u1 WHERE n <= room
  UNION ALL SELECT doc, room, pi, si, hi, trim(x), false, {_WORDS.format('x')}, true FROM (SELECT doc, room, pi, si, generate_subscripts(xs, 1) AS hi, unnest(xs) AS x FROM cut)),
u AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pi, si, hi) AS i FROM u2),
f AS (SELECT doc, i, n AS used, 0 AS chunk, hard FROM u WHERE i = 1
  UNION ALL SELECT doc, i, CASE WHEN fresh THEN n ELSE used + n END, chunk + CAST(fresh AS INT), hard FROM (SELECT u.doc, u.i, u.n, f.used, f.chunk, u.hard, f.hard OR u.hard OR f.used + u.n > u.room OR (u.p AND f.used >= CAST(0.85 AS DOUBLE) * u.room) AS fresh FROM f JOIN u ON u.doc = f.doc AND u.i = f.i + 1)),
c AS (SELECT doc, chunk, string_agg(s, ' ' ORDER BY i) AS text, CAST(sum(u.n) AS BIGINT) AS n, bool_or(u.hard) AS hard, arg_min(s, i) AS a, arg_max(s, i) AS b FROM f JOIN u USING (doc, i) GROUP BY doc, chunk),
o AS (SELECT c.*, title, body, CAST(120 - room AS BIGINT) AS head_n, instr(body, a) AS pos FROM c JOIN r USING (doc)),
packed AS (SELECT doc, chunk AS chunk_index, CASE WHEN title = '' THEN '' ELSE title || chr(10) || chr(10) END || text AS text, n + head_n AS n_tokens, CAST(CASE WHEN hard THEN -1 ELSE pos - 1 END AS INT) AS char_start,
  CAST(CASE WHEN hard OR instr(substr(body, greatest(pos, 1)), b) = 0 THEN -1 ELSE greatest(pos, 1) - 2 + instr(substr(body, greatest(pos, 1)), b) + length(b) END AS INT) AS char_end, hard AS hard_split FROM o)"""


@query("t9_greedy_packing", f"{_PACKED} SELECT * FROM packed")
def _(t):
    return chunking.pack(t("documents"), "doc_id", "source", "text", 120)


_SLIDE = "SELECT doc_id AS doc, start, substr(text, CAST(start + 1 AS BIGINT), 512) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 64, 1), 448)) AS start FROM documents) WHERE length(substr(text, CAST(start + 1 AS BIGINT), 512)) >= 200"


@query("t14_sliding_chunks", f"SELECT doc, start, md5(chunk) AS chunk_md5 FROM ({_SLIDE})")
def _(t):
    return chunking.slide(t("documents"), "doc_id", "text", 512, 64).select("doc", F.col("start").cast("long").alias("start"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query("t15_half_split", "SELECT doc_id, md5(substr(text, 1, length(text) // 2)) AS a, md5(substr(text, length(text) // 2 + 1)) AS b FROM documents")
def _(t):
    return t("documents").select("doc_id", F.expr("md5(cast(substring(text, 1, length(text) div 2) as binary))").alias("a"), F.expr("md5(cast(substring(text, cast(length(text) div 2 + 1 as int)) as binary))").alias("b"))


@query("t16_capital_ratio", "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents) SELECT doc_id, round(len(list_filter(ws, lambda x: regexp_matches(x, '^\\p{Lu}'))) / greatest(len(ws), 1), 6) AS ratio FROM w")
def _(t):
    return t("documents").select("doc_id", F.round(tx.capital_ratio(F.col("text")), 6).alias("ratio"))


@query("t18_context_assembly", "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS context_md5 FROM conversations GROUP BY conv_id")
def _(t):
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")
    return t("conversations").groupBy("conv_id").agg(F.md5(joined.cast("binary")).alias("context_md5"))


# Joins ------------------------------------------------------------------------------------------


@query("j2_dimension_lookup", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey")
def _(t):
    return t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")


@query("j4_resume_anti", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(t):
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left_anti")


@query("j5_symmetric_difference", "(SELECT doc_id FROM documents WHERE n_chars > 3000 EXCEPT ALL SELECT doc_id FROM labels) UNION ALL (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents WHERE n_chars > 3000)")
def _(t):
    a, b = t("documents").filter("n_chars > 3000").select("doc_id"), t("labels").select("doc_id")
    return a.exceptAll(b).unionAll(b.exceptAll(a))


@query("j6_pairing", "SELECT q.conv_id, q.turn, length(q.text) AS n_user, length(a.text) AS n_assistant FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'")
def _(t):
    c = t("conversations")
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").alias("n_assistant"))
    return c.filter("role = 'user'").join(a, ["conv_id", "turn"]).select("conv_id", "turn", F.length("text").alias("n_user"), "n_assistant")


@query("j8_verbatim_containment", "SELECT item_id AS qid, doc_id AS doc FROM benchmark b, documents d WHERE contains(d.text, b.text)")
def _(t):
    return _gold(t)


def _gold(t) -> DataFrame:
    return retrieval.containing(t("documents"), "doc_id", "text", t("benchmark"), "item_id", "text", tx.unicode_tokens)


@query("j13_pivot_complete", "WITH p AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id) SELECT * FROM p WHERE click > 0 AND view > 0 AND purchase > 0")
def _(t):
    return t("events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).count().dropna()


# Retrieval --------------------------------------------------------------------------------------

_DOCS = "toks AS (SELECT doc_id AS doc, regexp_extract_all(lower(text), '{pattern}') AS ts FROM documents), post AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(ts) AS term FROM toks) GROUP BY doc, term), corpus AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM toks), terms AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), corpus)"
_SCORED = ", qt AS (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '{pattern}')) AS term FROM benchmark), scored AS (SELECT qid, doc, sum(idf * tf * ({k1} + 1) / (tf + {k1} * (1 - 0.75 + 0.75 * len(ts) / avgdl))) AS score FROM qt JOIN post USING (term) JOIN terms USING (term) JOIN toks USING (doc), corpus GROUP BY qid, doc), ranked AS (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM scored)"
_LATIN = {"pattern": "[a-z0-9]+", "k1": 1.2}
_WORD = {"pattern": "[\\p{L}\\p{N}_]+", "k1": 1.5}


def _with(*parts: str, **values) -> str:
    out = "".join(parts)
    for k, v in values.items():
        out = out.replace("{" + k + "}", str(v))
    return "WITH " + out


def _ranked(t, tokens=tx.latin_tokens, k1: float = 1.2, k: int = 50) -> DataFrame:
    asked, own = t("benchmark"), tokens(F.col("text"))
    return retrieval.bm25_top(t("documents"), "doc_id", own, asked, "item_id", k, k1)


@query("r1_index_build", _with(_DOCS, **_LATIN) + " SELECT doc, term, tf, len(ts) AS dl, round(idf, 9) AS idf FROM post JOIN terms USING (term) JOIN toks USING (doc)")
def _(t):
    return retrieval.index(t("documents"), "doc_id", tx.latin_tokens(F.col("text")))[0].select("doc", "term", "tf", "dl", F.round("idf", 9).alias("idf"))


@query("r4_bm25_top10", _with(_DOCS, _SCORED, **_LATIN) + " SELECT qid, doc, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10")
def _(t):
    return _ranked(t, k=10).withColumn("score", F.round("score", 6))


@query("r5_language_bm25_top10", _with(_DOCS, _SCORED, **_WORD) + " SELECT qid, doc, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10")
def _(t):
    return _ranked(t, tx.unicode_tokens, 1.5, 10).withColumn("score", F.round("score", 6))


@query("r7_unit_vectors", "WITH n AS (SELECT vec_id, sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding])) + 1e-12 AS norm, embedding FROM embeddings) SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS place, round(unnest([CAST(x AS DOUBLE) / norm FOR x IN embedding]), 9) AS x FROM n")
def _(t):
    return t("embeddings").select("vec_id", F.posexplode(retrieval.unit(F.col("embedding"))).alias("place", "x")).select("vec_id", (F.col("place") + 1).cast("long").alias("place"), F.round("x", 9).alias("x"))


@query("r8_vector_top10", "WITH s AS (SELECT q.vec_id AS qid, d.vec_id AS doc, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM s) SELECT qid, doc, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def _(t):
    v = t("embeddings")
    return retrieval.nearest(v, v.filter("vec_id % 20 = 0"), 10).withColumn("score", F.round("score", 6))


_DENSE = ", dense AS (SELECT * FROM (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM (SELECT q.vec_id AS qid, d.vec_id AS doc, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN (SELECT DISTINCT item_id FROM benchmark) ON item_id = q.vec_id, embeddings d)) WHERE rank <= 50)"
_FUSED = _with(_DOCS, _SCORED, ", lex AS (SELECT * FROM ranked WHERE rank <= 50)", _DENSE, ", fused AS (SELECT qid, doc, sum(1.0 / (60 + rank)) AS score FROM (SELECT qid, doc, rank FROM lex UNION ALL SELECT qid, doc, rank FROM dense) GROUP BY qid, doc), fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM fused)", **_LATIN)


def _arms(t, again: bool = False) -> dict[str, DataFrame]:
    """Lexical and dense lists of the items (an item's vector is the one of its id) and their fusion."""
    vectors = t("embeddings")
    asked = vectors.join(t("benchmark").select(F.col("item_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    lex, dense = _ranked(t), retrieval.nearest(vectors, asked, 50)
    if again:  # 50 rows an item
        lex, dense = io.kept(lex, "bm25"), io.kept(dense, "dense")
    return {"bm25": lex, "dense": dense, "fused": retrieval.top(retrieval.fuse(lex, dense), 50)}


@query("r9_rank_fusion", _FUSED + " SELECT qid, doc, round(score, 6) AS score, rank FROM fr WHERE rank <= 10")
def _(t):
    return _arms(t)["fused"].filter("rank <= 10").withColumn("score", F.round("score", 6))


# Graph ------------------------------------------------------------------------------------------

_MENT = "m AS (SELECT l_orderkey AS chunk, l_linenumber AS seq, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS name, p_type AS type, p_brand AS description, CAST(l_quantity AS BIGINT) AS strength FROM lineitem JOIN part ON l_partkey = p_partkey)"
_EDGE = ", rel AS (SELECT a.name AS s, b.name AS t, coalesce(nullif(a.strength, 0), 1) AS w FROM m a JOIN m b ON a.chunk = b.chunk AND b.seq = a.seq + 1 WHERE a.name <> b.name), e AS (SELECT least(s, t) AS a, greatest(s, t) AS b, sum(w) AS weight, count(*) AS n FROM rel GROUP BY ALL)"


def _mentions(t) -> DataFrame:
    return t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").alias("seq"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("description"), F.col("l_quantity").cast("long").alias("strength"))


def _edges(t) -> DataFrame:
    m = _mentions(t)
    nxt = m.select("chunk", (F.col("seq") - 1).alias("seq"), F.col("name").alias("target"))
    return graph.edges(m.join(nxt, ["chunk", "seq"]).select(F.col("name").alias("source"), "target", "strength"))


@query("a12_vertices", f"WITH {_MENT}, k AS (SELECT name, type, count(*) AS n, min((chunk, seq)) AS seen FROM m GROUP BY ALL), b AS (SELECT name, type FROM k QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, seen) = 1), v AS (SELECT name, count(DISTINCT chunk) AS chunks, count(*) AS mentions FROM m GROUP BY name) SELECT name, type, chunks, mentions FROM v JOIN b USING (name)")
def _(t):
    return graph.vertices(_mentions(t)).select("name", "type", "chunks", "mentions")


@query("a13_edges", f"WITH {_MENT}{_EDGE} SELECT a, b, CAST(weight AS BIGINT) AS weight, n AS count FROM e")
def _(t):
    return _edges(t)


@query("a14_graph_stats", f"WITH {_MENT}{_EDGE}, d AS (SELECT x, count(*) AS d FROM (SELECT a AS x FROM e UNION ALL SELECT b FROM e) GROUP BY x), v AS (SELECT DISTINCT name FROM m) SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e) AS edges, CAST(0 AS BIGINT) AS phantom, (SELECT round(avg(d), 6) FROM d) AS degree_mean, (SELECT median(d) FROM d) AS degree_median, (SELECT count(*) FROM v) - (SELECT count(*) FROM d) AS isolated")
def _(t):
    return graph.stats(graph.vertices(_mentions(t)), _edges(t))


_EXPAND = f"WITH {_MENT}{_EDGE}, s AS (SELECT type AS qid, name, 1.0 / rank AS score FROM (SELECT type, name, row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, name) AS rank FROM m GROUP BY type, name) WHERE rank <= 5), ends AS (SELECT a AS src, b AS dst, weight FROM e UNION ALL SELECT b, a, weight FROM e), tot AS (SELECT src, sum(weight) AS total FROM ends GROUP BY src), x AS (SELECT qid, name, max(score) AS score FROM (SELECT * FROM s UNION ALL SELECT qid, dst, 0.5 * score * weight / total FROM s JOIN ends ON src = name JOIN tot USING (src)) GROUP BY qid, name)"


def _expanded(t) -> DataFrame:
    m = _mentions(t).groupBy("type", F.col("name")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("type").orderBy(F.desc("n"), "name")
    seeds = m.withColumn("rank", F.row_number().over(by)).filter("rank <= 5").select(F.col("type").alias("qid"), "name", "rank")
    return graph.expand(seeds, _edges(t))


@query("r11_graph_expansion", _EXPAND + " SELECT qid, name, round(score, 6) AS score FROM x")
def _(t):
    return _expanded(t).withColumn("score", F.round("score", 6))


@query("r12_chunk_scores", _EXPAND + ", c AS (SELECT qid, chunk AS doc, sum(score) AS score FROM x JOIN (SELECT DISTINCT name, chunk FROM m) USING (name) GROUP BY qid, chunk), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM c) SELECT qid, doc, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def _(t):
    links = _mentions(t).select("name", "chunk").distinct()
    return retrieval.top(graph.chunk_scores(_expanded(t), links), 10).withColumn("score", F.round("score", 6))


# Aggregates -------------------------------------------------------------------------------------

_METRIC = ", gold AS (SELECT item_id AS qid, doc_id AS doc FROM benchmark b, documents d WHERE contains(d.text, b.text)), per AS (SELECT g.qid, coalesce(min(r.rank) = 1, false) AS hits1, count(r.rank) > 0 AS hitsk, count(r.rank) = count(*) AS strict, coalesce(max(1.0 / r.rank), 0) AS rr FROM gold g LEFT JOIN (SELECT * FROM ranked WHERE rank <= 10) r ON r.qid = g.qid AND r.doc = g.doc GROUP BY g.qid)"


@query("a1_retrieval_metrics", _with(_DOCS, _SCORED, _METRIC, **_LATIN) + " SELECT qid, hits1, hitsk, strict, round(rr, 6) AS rr FROM per")
def _(t):
    m = retrieval.metrics(t("benchmark").select(F.col("item_id").alias("qid")), _gold(t), _ranked(t, k=10), 10)
    return m.withColumn("rr", F.round("rr", 6))


@query("a4_summary_by_stratum", _with(_DOCS, _SCORED, _METRIC, **_LATIN) + ", s AS (SELECT per.*, CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS stratum FROM per JOIN benchmark ON qid = item_id) SELECT coalesce(stratum, 'all') AS stratum, count(*) AS n, round(100.0 * avg(CAST(hits1 AS INT)), 2) AS hits1, round(100.0 * avg(CAST(strict AS INT)), 2) AS strict, round(avg(rr), 4) AS mrr FROM s GROUP BY GROUPING SETS ((), (stratum))")
def _(t):
    m = retrieval.metrics(t("benchmark").select(F.col("item_id").alias("qid")), _gold(t), _ranked(t, k=10), 10)
    size = t("benchmark").select(F.col("item_id").alias("qid"), F.when(F.length("text") < 200, "short").otherwise("long").alias("stratum"))
    pct = lambda c: F.round(100 * F.avg(F.col(c).cast("int")), 2).alias(c)
    out = m.join(size, "qid").rollup("stratum").agg(F.count("*").alias("n"), pct("hits1"), pct("strict"), F.round(F.avg("rr"), 4).alias("mrr"))
    return out.withColumn("stratum", F.coalesce("stratum", F.lit("all")))


def _log(t) -> DataFrame:
    return t("events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("qi"), (F.col("event_id") % 3).alias("arm"), F.col("event_type").alias("done_reason"), "value", "ts")


_LOG = "log AS (SELECT event_id AS seq, user_id AS qi, event_id % 3 AS arm, event_type AS done_reason, value FROM events)"


@query("a5_latest_row", f"WITH {_LOG} SELECT qi, arm, seq, done_reason FROM log WHERE NOT starts_with(done_reason, 'error') QUALIFY row_number() OVER (PARTITION BY arm, qi ORDER BY seq DESC) = 1")
def _(t):
    return runlog.latest(_log(t), ["arm", "qi"], "seq").select("qi", "arm", "seq", "done_reason")


@query("a6_unrecovered_errors", f"WITH {_LOG} SELECT arm, qi, max_by(done_reason, seq) AS done_reason FROM log GROUP BY arm, qi HAVING starts_with(max_by(done_reason, seq), 'error')")
def _(t):
    return runlog.unrecovered(_log(t), ["arm", "qi"], "seq")


@query("a7_arm_summary", f"WITH {_LOG} SELECT arm, done_reason, count(*) AS n, round(100.0 * avg(CASE WHEN value > 10 THEN 1 ELSE 0 END), 2) AS contained, round(avg(value), 4) AS mean_value FROM log GROUP BY GROUPING SETS ((arm), (arm, done_reason))")
def _(t):
    rows = _log(t).rollup("arm", "done_reason").agg(F.count("*").alias("n"), F.round(100 * F.avg((F.col("value") > 10).cast("int")), 2).alias("contained"), F.round(F.avg("value"), 4).alias("mean_value"))
    return rows.filter("arm IS NOT NULL")


_PAIRS = "FROM labels l JOIN documents d USING (doc_id) GROUP BY lang"


def _discord(t) -> DataFrame:
    d = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id")
    return d.groupBy("lang").agg(*runlog.discordance(F.col("quality") == 1, F.col("toxic") == 1))


@query("a8_discordance", f"SELECT lang, count(*) AS n, sum(CAST(quality = 1 AND toxic <> 1 AS BIGINT))::BIGINT AS b, sum(CAST(toxic = 1 AND quality <> 1 AS BIGINT))::BIGINT AS c, round(100.0 * (sum(CAST(quality = 1 AND toxic <> 1 AS BIGINT)) - sum(CAST(toxic = 1 AND quality <> 1 AS BIGINT))) / count(*), 4) AS delta_pp {_PAIRS}")
def _(t):
    return _discord(t)


@query("a9_calibration", "SELECT lang, sum(quality)::BIGINT AS complete, sum(toxic)::BIGINT AS abstained, sum(CASE WHEN toxic = 1 AND quality = 0 THEN 1 ELSE 0 END)::BIGINT AS right_, round(CASE WHEN sum(toxic) > 0 THEN sum(CASE WHEN toxic = 1 AND quality = 0 THEN 1 ELSE 0 END) / sum(toxic) END, 6) AS precision_ FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def _(t):
    d = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id")
    right = F.sum(((F.col("toxic") == 1) & (F.col("quality") == 0)).cast("long"))
    return d.groupBy("lang").agg(F.sum("quality").alias("complete"), F.sum("toxic").alias("abstained"), right.alias("right_"), F.round(F.try_divide(right, F.sum("toxic")), 6).alias("precision_"))


@query("a11_constant_baseline", "WITH top AS (SELECT event_type FROM events GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1) SELECT t.event_type AS answer, round(100.0 * avg(CAST(e.event_type = t.event_type AS INT)), 4) AS pct FROM events e, top t GROUP BY t.event_type")
def _(t):
    e = t("events")
    best = e.groupBy("event_type").count().orderBy(F.desc("count"), "event_type").limit(1).select(F.col("event_type").alias("answer"))
    return e.crossJoin(F.broadcast(best)).groupBy("answer").agg(F.round(100 * F.avg((F.col("event_type") == F.col("answer")).cast("int")), 4).alias("pct"))  # one row


@query("a15_traffic_mix", "WITH mix(event_type, w) AS (VALUES ('click', 3.0), ('view', 2.0), ('purchase', 1.0)) SELECT user_id, round(sum(w * value) / sum(w), 6) AS weighted FROM events JOIN mix USING (event_type) GROUP BY user_id")
def _(t):
    mix = t("events").sparkSession.createDataFrame([("click", 3.0), ("view", 2.0), ("purchase", 1.0)], "event_type string, w double")
    return t("events").join(F.broadcast(mix), "event_type").groupBy("user_id").agg(F.round(F.sum(F.col("w") * F.col("value")) / F.sum("w"), 6).alias("weighted"))


@query("a16_pivot_report", "SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 4) AS o, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 4) AS f FROM lineitem GROUP BY l_returnflag")
def _(t):
    p = t("lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.round(F.avg("l_quantity"), 4))
    return p.withColumnsRenamed({"O": "o", "F": "f"})


@query("a17_chunk_statistics", f"SELECT count(*) AS n, round(avg(length(chunk)), 4) AS mean_chars, median(length(chunk)) AS median_chars, min(length(chunk)) AS least, max(length(chunk)) AS most FROM ({_SLIDE})")
def _(t):
    n, chunks = F.length("chunk"), chunking.slide(t("documents"), "doc_id", "text", 512, 64)
    middle = ordered.medians(chunks.select(n.alias("n")), [], "n").select(F.col("median").alias("median_chars"))
    return middle.crossJoin(chunks.agg(F.count("*").alias("n"), F.round(F.avg(n), 4).alias("mean_chars"), F.min(n).alias("least"), F.max(n).alias("most")))


@query("a18_severance", f"WITH c AS ({_SLIDE}), g AS (SELECT item_id, b.text, doc_id AS doc FROM benchmark b, documents d WHERE contains(d.text, b.text)), x AS (SELECT item_id, g.doc, coalesce(bool_or(contains(chunk, text)), false) AS whole FROM g LEFT JOIN c ON c.doc = g.doc GROUP BY ALL) SELECT count(*) AS spans, sum(CAST(NOT whole AS BIGINT))::BIGINT AS severed, round(CASE WHEN count(*) > 0 THEN 100.0 * sum(CAST(NOT whole AS BIGINT)) / count(*) END, 4) AS pct FROM x")
def _(t):
    gold = _gold(t).join(t("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("fact")), "qid")
    found = chunking.severed(gold.select("doc", "fact"), t("documents"), "doc_id", "text", [("512/64", 512, 64)])
    spans, bad = F.sum("spans"), F.sum("severed")
    return found.agg(F.coalesce(spans, F.lit(0)).alias("spans"), bad.alias("severed"), F.round(F.try_divide(100.0 * bad, spans), 4).alias("pct"))


@query("a20_occurrences", "SELECT doc_id, (length(text) - length(replace(text, 'the ', ''))) // 4 AS n FROM documents")
def _(t):
    return t("documents").select("doc_id", tx.occurrences(F.col("text"), F.lit("the ")).alias("n"))


_HEADED = "CASE WHEN title = '' THEN '' ELSE title || chr(10) || chr(10) END"
_TIMES = "(length({0}) - length(replace({0}, x, ''))) // length(x)"
_WHOLE = f"""{_PACKED}, joined AS (SELECT doc, string_agg(CASE WHEN starts_with(text, {_HEADED}) THEN substr(text, length({_HEADED}) + 1) ELSE text END, ' ' ORDER BY chunk_index) AS j, count(*) AS chunks, count(*) FILTER (n_tokens > 120) AS over_budget FROM packed JOIN r USING (doc) GROUP BY doc),
ss AS (SELECT doc, list(s) AS ss FROM u0 GROUP BY doc)
SELECT doc, CAST(len(ss) AS INT) AS sentences, CAST(len(list_filter(ss, lambda x: NOT contains(j, x))) AS INT) AS lost, CAST(len(list_filter(ss, lambda x: contains(j, x) AND {_TIMES.format('j')} > {_TIMES.format('body')})) AS INT) AS duplicated, chunks, over_budget FROM ss JOIN joined USING (doc) JOIN r USING (doc)"""


@query("a20_chunk_integrity", _WHOLE)
def _(t):
    packed = chunking.pack(t("documents"), "doc_id", "source", "text", 120)
    return chunking.integrity(t("documents"), packed, "doc_id", "source", "text", 120)


@query("a17_packing_statistics", f"{_PACKED} SELECT count(*) AS chunks, round(avg(n_tokens), 6) AS mean, median(n_tokens) AS median, min(n_tokens) AS least, max(n_tokens) AS most, round(avg(n_tokens) / 120, 6) AS fill_rate, count(*) FILTER (hard_split) AS hard_splits, count(*) FILTER (n_tokens > 120) AS over_budget, (SELECT round(sum(length(body)) / sum({_WORDS.format('body')}), 6) FROM d WHERE body <> '') AS chars_per_token FROM packed")
def _(t):
    packed = chunking.pack(t("documents"), "doc_id", "source", "text", 120)
    out = chunking.statistics(packed, t("documents"), "doc_id", "source", "text", 120)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "fill_rate", "chars_per_token")})


@query("a23_volume", "SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, median(n_chars) AS median, min(n_chars) AS least, max(n_chars) AS most, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(n_chars) * count(*) / 3600, 6) AS hours FROM documents GROUP BY lang")
def _(t):
    """Hours at a second for each character."""
    n = F.col("n_chars")
    return t("documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"), F.sum(n).alias("total"), F.round(F.avg(n) * F.count("*") / 3600, 6).alias("hours")).join(ordered.medians(t("documents").withColumnRenamed("lang", "of"), ["of"], "n_chars"), F.col("lang").eqNullSafe(F.col("of"))).drop("of")


@query("a23_rolling_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 9) AS rolling FROM events")
def _(t):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-49, 0)
    return t("events").select("event_id", F.round(F.avg("value").over(w), 9).alias("rolling"))


@query("a24_throughput", "SELECT event_type, round(CASE WHEN sum(value) > 0 THEN count(*) / sum(value) END, 6) AS rate FROM events GROUP BY event_type")
def _(t):
    return t("events").groupBy("event_type").agg(F.round(F.try_divide(F.count("*").cast("double"), F.sum("value")), 6).alias("rate"))


@query("a25_repeat_determinism", "SELECT p_name, count(DISTINCT p_type) = 1 AS equal FROM part GROUP BY p_name")
def _(t):
    return t("part").groupBy("p_name").agg((F.count_distinct("p_type") == 1).alias("equal"))


@query("a26_popularity", "SELECT l_partkey AS doc, count(*) AS n FROM lineitem GROUP BY l_partkey")
def _(t):
    return t("lineitem").groupBy(F.col("l_partkey").alias("doc")).agg(F.count("*").alias("n"))


@query("a27_claim_checks", "SELECT 'rows' AS name, count(*) = max(doc_id) + 1 AS ok FROM documents UNION ALL SELECT 'chars', bool_and(n_chars = length(text)) FROM documents")
def _(t):
    d = t("documents")
    return d.agg((F.count("*") == F.max("doc_id") + 1).alias("ok")).select(F.lit("rows").alias("name"), "ok").unionAll(d.agg(F.every(F.col("n_chars") == F.length("text")).alias("ok")).select(F.lit("chars").alias("name"), "ok"))


# Statistics, windows, samples -------------------------------------------------------------------


@query("x1_wilson", f"WITH c AS (SELECT lang, sum(quality) AS k, count(*) AS n {_PAIRS}), q AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM c) SELECT lang, n, round(100 * ((p + z*z/(2*n)) / (1 + z*z/n) - z / (1 + z*z/n) * sqrt(p*(1-p)/n + z*z/(4*n*n))), 2) AS low, round(100 * ((p + z*z/(2*n)) / (1 + z*z/n) + z / (1 + z*z/n) * sqrt(p*(1-p)/n + z*z/(4*n*n))), 2) AS high FROM q")
def _(t):
    d = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    low, high = st.wilson(F.col("k"), F.col("n"))
    return d.select("lang", "n", low.alias("low"), high.alias("high"))


_MC = f"c AS (SELECT lang, CAST(sum(CAST(quality = 1 AND toxic <> 1 AS INT)) AS BIGINT) AS b, CAST(sum(CAST(toxic = 1 AND quality <> 1 AS INT)) AS BIGINT) AS c {_PAIRS}), lf AS (SELECT i, sum(CASE WHEN i = 0 THEN 0 ELSE ln(i) END) OVER (ORDER BY i) AS l FROM (SELECT unnest(range(0, (SELECT max(b + c) + 1 FROM c))) AS i)), p AS (SELECT lang, least(1, 2 * sum(exp(n.l - a.l - r.l - (b + c) * ln(2)))) AS p FROM c JOIN lf n ON n.i = b + c JOIN lf a ON a.i <= least(b, c) JOIN lf r ON r.i = b + c - a.i GROUP BY lang)"


@query("x2_mcnemar", f"WITH {_MC} SELECT lang, round(p, 9) AS p FROM p")
def _(t):
    return _discord(t).select("lang", F.round(st.mcnemar(F.col("b"), F.col("c")), 9).alias("p"))


@query("x3_bootstrap")
def _(t):
    d = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id").withColumn("d", F.col("quality") - F.col("toxic"))
    return st.bootstrap(d, "lang", "d")


@query("x5_holm", f"WITH {_MC}, s AS (SELECT *, row_number() OVER (ORDER BY p, lang) AS i, count(*) OVER () AS m FROM p) SELECT lang, bool_and(p <= 0.05 / (m - i + 1)) OVER (ORDER BY i) AS significant FROM s")
def _(t):
    p = _discord(t).select("lang", st.mcnemar(F.col("b"), F.col("c")).alias("p"))
    return st.holm(p, "p", order="lang").select("lang", "significant")


@query("x7_geometric_mean", "SELECT l_returnflag, round(exp(avg(ln(l_extendedprice / l_quantity))), 6) AS ratio FROM lineitem WHERE l_quantity > 0 GROUP BY l_returnflag")
def _(t):
    return t("lineitem").filter("l_quantity > 0").groupBy("l_returnflag").agg(F.round(st.geometric_mean(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("ratio"))


@query("x8_clipped_credit", "SELECT l_partkey AS doc, round(sum(CASE WHEN l_returnflag = 'R' THEN least(1 / greatest(l_discount, 1e-6), 50) ELSE 1 / 0.9 END), 6) AS credit FROM lineitem GROUP BY l_partkey")
def _(t):
    c = F.when(F.col("l_returnflag") == "R", F.least(1 / F.greatest(F.col("l_discount"), F.lit(1e-6)), F.lit(50.0))).otherwise(1 / F.lit(0.9))
    return t("lineitem").groupBy(F.col("l_partkey").alias("doc")).agg(F.round(F.sum(c), 6).alias("credit"))


@query("w4_systematic_sample", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, greatest(count(*) OVER (PARTITION BY lang) // 15, 1) AS step FROM documents) WHERE pos % step = 0 AND pos // step < 15")
def _(t):
    return runlog.systematic(t("documents").select("doc_id", "lang"), 15, ["lang"], "doc_id")


@query("o4_mixed_order_top", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def _(t):
    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t("orders").withColumn("rank", F.row_number().over(by)).filter("rank <= 3").select("o_custkey", "o_orderkey", "rank")


@query("o7_set_operations", "SELECT 'intersect' AS op, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'union', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)")
def _(t):
    a, b = t("documents").select("doc_id"), t("labels").select("doc_id")
    n = lambda name, d: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return n("intersect", a.intersect(b)).unionAll(n("except", a.subtract(b))).unionAll(n("union", a.union(b).distinct()))


@query("st4_evaluation_split", "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey WHERE a.l_orderkey = o_orderkey AND b.l_orderkey % 5 < 3) AS similar FROM orders WHERE o_orderkey % 5 >= 3")
def _(t):
    li = t("lineitem").select("l_orderkey", "l_partkey")
    seen = li.filter("l_orderkey % 5 < 3").select("l_partkey").distinct()
    near = li.join(seen, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    return t("orders").filter("o_orderkey % 5 >= 3").select("o_orderkey").join(near, "o_orderkey", "left").select("o_orderkey", F.coalesce("hit", F.lit(False)).alias("similar"))


@query("u8_mini_evaluation", _FUSED + ", gold AS (SELECT item_id AS qid, doc_id AS doc FROM benchmark b, documents d WHERE contains(d.text, b.text)), arms AS (SELECT 'fused' AS arm, qid, doc, rank FROM fr UNION ALL SELECT 'dense', qid, doc, rank FROM dense UNION ALL SELECT 'bm25', qid, doc, rank FROM lex), names AS (SELECT DISTINCT arm FROM arms), per AS (SELECT n.arm, g.qid, coalesce(min(a.rank) = 1, false) AS hits1, count(a.rank) = count(*) AS strict FROM gold g CROSS JOIN names n LEFT JOIN (SELECT * FROM arms WHERE rank <= 10) a ON a.arm = n.arm AND a.qid = g.qid AND a.doc = g.doc GROUP BY n.arm, g.qid) SELECT arm, count(*) AS n, round(100.0 * avg(CAST(hits1 AS INT)), 2) AS hits1, round(100.0 * avg(CAST(strict AS INT)), 2) AS strict FROM per GROUP BY arm")
def _(t):
    gold, asked, out = io.kept(_gold(t), "gold"), t("benchmark").select(F.col("item_id").alias("qid")), None
    pct = lambda c: F.round(100 * F.avg(F.col(c).cast("int")), 2).alias(c)
    for arm, ranked in _arms(t, again=True).items():
        row = retrieval.metrics(asked, gold, ranked, 10).agg(F.count("*").alias("n"), pct("hits1"), pct("strict")).select(F.lit(arm).alias("arm"), "*")
        out = row if out is None else out.unionAll(row)
    return out
