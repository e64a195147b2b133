"""Figures of a report: calibration, baselines, mixes, severance, repeats, claims, digests in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as st
from ..functions import text as tx
from . import runlog
from .ordered import medians

#: Rows, then digests, that one digest is taken over.
WIDTH = 1024
#: Levels of digests: WIDTH ** LEVELS rows have one digest at last.
LEVELS = 4


def calibration(rows: DataFrame, complete: Column, abstained: Column, contained: Column, by: str) -> DataFrame:
    """Abstention against complete evidence, for each value of ``by`` and for all (``by`` is 'all').

    Abstaining counts as a detector of incomplete evidence: precision, recall and base rate; shares of
    nothing are null. answered, answered_pct: answers given on complete evidence, and those that contain a gold.
    """
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    cross = rows.select(F.explode(F.array(F.lit("all"), F.col(by).cast("string"))).alias(by), complete.alias("_c"), abstained.alias("_a"), contained.alias("_r"))
    complete, abstained, contained = F.col("_c"), F.col("_a"), F.col("_r")
    sums = [
        F.count("*").alias("n"),
        n(complete).alias("complete"),
        n(~complete).alias("incomplete"),
        n(complete & abstained).alias("fp"),
        n(~complete & abstained).alias("tp"),
        n(complete & ~abstained).alias("answered"),
        n(complete & ~abstained & contained).alias("right"),
    ]
    out = cross.groupBy(by).agg(*sums).withColumn("abstained", F.col("tp") + F.col("fp"))
    return out.select(
        by,
        "n",
        "complete",
        "incomplete",
        (100 * share("fp", "complete")).alias("abstain_pct_complete"),
        (100 * share("tp", "incomplete")).alias("abstain_pct_incomplete"),
        share("tp", "abstained").alias("precision"),
        share("tp", "incomplete").alias("recall"),
        (100 * share("incomplete", "n")).alias("base_rate_pct"),
        "answered",
        (100 * share("right", "answered")).alias("answered_pct"),
    )


def constant_baseline(rows: DataFrame, golds: Column, fixed: list[tuple[str, str, Column]]) -> DataFrame:
    """baseline, answer, n, contained, pct of one answer given to every question.

    'most_common' answers with the commonest first gold (ties: the lesser); ``fixed`` holds (label, answer,
    questions it is given to). A question is met when one of its golds, normalised, lies in the answer.
    """
    first = F.get(golds, 0)
    best = rows.filter(first.isNotNull()).groupBy(first.alias("answer")).count().orderBy(F.desc("count"), "answer").limit(1)
    cases = [rows.select(golds.alias("golds")).crossJoin(F.broadcast(best.select(F.lit("most_common").alias("baseline"), "answer")))]  # one row
    cases += [rows.filter(asked).select(golds.alias("golds"), F.lit(label).alias("baseline"), F.lit(answer).alias("answer")) for label, answer, asked in fixed]
    every = cases[0]
    for case in cases[1:]:
        every = every.unionByName(case)
    met = F.exists("golds", lambda g: (tx.latin(g) != "") & tx.latin(F.col("answer")).contains(tx.latin(g)))
    met = F.coalesce(met, F.lit(False)).cast("long")
    return every.groupBy("baseline", "answer").agg(F.count("*").alias("n"), F.sum(met).alias("contained"), (100 * F.avg(met)).alias("pct"))


def mini_evaluation(rows: DataFrame, base: str, arm: str, ablated: str, golds: str, retrieved: str, phrase: str) -> DataFrame:
    """metric, value: two arms' answers to the same questions, and the arm's answers to prompts without their way out.

    rows: a question each, with the three answers, its golds (an array) and whether its gold was retrieved. An answer
    that holds ``phrase`` abstains. Containment and its 95 % interval, abstentions, the paired difference with its exact
    p, abstentions by retrieval, the commonest gold as a constant answer, and refusals that turn into answers without
    the way out. Shares of nothing are null; no rows give no questions and nulls.
    """
    said = lambda c: tx.letters_only(F.lower(F.coalesce(F.col(c), F.lit(""))))
    wanted = F.transform(F.coalesce(F.col(golds), F.array().cast("array<string>")), lambda g: tx.letters_only(F.lower(g)))
    held = tx.letters_only(F.lower(F.lit(phrase)))
    each = rows.select(
        *(F.coalesce(tx.contains_any(said(c), wanted), F.lit(False)).alias(f"{k}_met") for k, c in (("base", base), ("arm", arm), ("ablated", ablated))),
        *(said(c).contains(held).alias(f"{k}_abstained") for k, c in (("base", base), ("arm", arm), ("ablated", ablated))),
        F.coalesce(F.col(retrieved), F.lit(False)).alias("found"),
    )
    hit = {
        "base_met": "base_met",
        "arm_met": "arm_met",
        "ablated_met": "ablated_met",
        "base_abstained": "base_abstained",
        "arm_abstained": "arm_abstained",
        "ablated_abstained": "ablated_abstained",
        "b": "arm_met AND NOT base_met",
        "c": "base_met AND NOT arm_met",
        "found": "found",
        "found_abstained": "found AND arm_abstained",
        "missed_abstained": "NOT found AND arm_abstained",
        "flips": "arm_abstained AND NOT ablated_abstained",
        "flips_met": "arm_abstained AND NOT ablated_abstained AND ablated_met",
    }
    sums = each.agg(F.count("*").alias("n"), *(F.count_if(F.expr(cond)).alias(name) for name, cond in hit.items()))
    constant = constant_baseline(rows, F.col(golds), []).select(F.col("pct").alias("constant_pct"))
    one = sums.join(constant, F.lit(True), "left").withColumn("missed", F.col("n") - F.col("found"))  # one row each
    pct = lambda a, b: F.try_divide(100.0 * F.col(a), F.col(b))
    values = {"questions": F.col("n")}
    for k in ("base", "arm"):
        low, high = st.wilson(F.col(f"{k}_met"), F.col("n"))
        values |= {f"{k}_containment": pct(f"{k}_met", "n"), f"{k}_low": low, f"{k}_high": high, f"{k}_abstained": pct(f"{k}_abstained", "n")}
    values |= {
        "delta_pp": F.try_divide(100.0 * (F.col("b") - F.col("c")), F.col("n")),
        "mcnemar_p": st.mcnemar(F.col("b"), F.col("c")),
        "abstained_when_retrieved": pct("found_abstained", "found"),
        "abstained_when_missed": pct("missed_abstained", "missed"),
        "constant_containment": F.col("constant_pct"),
        "ablated_containment": pct("ablated_met", "n"),
        "ablated_abstained": pct("ablated_abstained", "n"),
        "refusals_that_answer": F.col("flips"),
        "of_them_contained": F.col("flips_met"),
    }
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()))))


def extraction_gates(rows: DataFrame, by: str, valid: Column, seconds: Column, wanted: int, most_seconds: float, planned: Column) -> DataFrame:
    """``by``, n, valid, valid_rate, the seconds' mean, median, least and most, hours, all_valid, in_time, passed.

    hours: ``planned`` units at the mean. all_valid needs exactly ``wanted`` rows, all of them valid; in_time needs every
    row under ``most_seconds``; a null validity or time fails its gate.
    """
    good, s = F.coalesce(valid, F.lit(False)), seconds.cast("double")
    middle = medians(rows.select(F.col(by).alias("_by"), s.alias("_s")), ["_by"], "_s")
    out = rows.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if(good).alias("valid"),
        F.avg(s).alias("mean"),
        F.min(s).alias("least"),
        F.max(s).alias("most"),
        (F.first(planned) * F.avg(s) / 3600).alias("hours"),
        F.every(F.coalesce(s < most_seconds, F.lit(False))).alias("in_time"),
    )
    out = out.join(middle, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    out = out.withColumn("valid_rate", F.col("valid") / F.col("n")).withColumn("all_valid", (F.col("n") == wanted) & (F.col("valid") == wanted))
    return out.withColumn("passed", F.col("all_valid") & F.col("in_time"))


def pair_table(deltas: DataFrame, pairs: list[str]) -> DataFrame:
    """config, metric and for each pair its delta and whether it is significant: the family's rows over all types.

    deltas: family (config/stratum/pair/metric), delta, significant. Rows of other families are left out.
    """
    part = F.split("family", "/")
    rows = deltas.filter((F.size(part) == 4) & (part[1] == "all")).select(part[0].alias("config"), part[3].alias("metric"), part[2].alias("pair"), "delta", "significant")
    wide = rows.groupBy("config", "metric").pivot("pair", pairs).agg(F.first("delta").alias("delta"), F.first("significant").alias("significant"))
    return wide


def traffic_mix(cells: DataFrame, mix: DataFrame) -> DataFrame:
    """preset, config, weighted, winner: sum(weight * value) / sum(weight) over types; 0 where all weights are.

    cells: config, type, value (a row each); mix: preset, type, weight. The greatest wins, ties by config.
    A type that a config lacks counts as 0.
    """
    total = mix.groupBy("preset").agg(F.sum("weight").alias("total"))
    got = cells.select("config").distinct().crossJoin(mix).join(cells, ["config", "type"], "left")  # configs by weights: a report's few cells
    sums = got.groupBy("preset", "config").agg(F.sum(F.col("weight") * F.coalesce("value", F.lit(0.0))).alias("s")).join(total, "preset")
    out = sums.select("preset", "config", F.when(F.col("total") == 0, 0.0).otherwise(F.col("s") / F.col("total")).alias("weighted"))
    best = Window.partitionBy("preset").orderBy(F.desc(F.round("weighted", 9)), "config")
    return out.withColumn("winner", F.row_number().over(best) == 1)


def severance(facts: DataFrame, chunks: DataFrame, least: int = 12) -> DataFrame:
    """type (or 'all'), spans, severed, span_pct, queries, queries_hit, query_pct.

    facts: qid, type, doc, fact; chunks: doc, chunk. A fact that no chunk of its document holds whole is severed;
    facts under ``least`` characters aren't checked, though their query counts. Shares of nothing are null.
    """
    checked = facts.filter(F.length("fact") >= least).select("qid", "doc", "fact").distinct()
    texts = chunks.select("doc", "chunk").join(checked.select("doc").distinct(), "doc", "left_semi")
    whole = checked.join(texts, "doc").filter(F.col("chunk").contains(F.col("fact"))).select("qid", "doc", "fact").distinct().withColumn("whole", F.lit(True))
    rows = facts.join(whole, ["qid", "doc", "fact"], "left")
    span = F.length("fact") >= least
    lost = span & F.col("whole").isNull()
    each = rows.withColumn("type", F.coalesce("type", F.lit("unknown"))).groupBy("qid", "type").agg(F.count_if(span).alias("spans"), F.count_if(lost).alias("severed"))
    each = each.select(F.explode(F.array(F.lit("all"), "type")).alias("type"), "spans", "severed")
    out = each.groupBy("type").agg(F.sum("spans").alias("spans"), F.sum("severed").alias("severed"), F.count("*").alias("queries"), F.count_if(F.col("severed") > 0).alias("queries_hit"))
    pct = lambda a, b: F.try_divide(100.0 * F.col(a), F.col(b))
    return out.withColumn("span_pct", pct("severed", "spans")).withColumn("query_pct", pct("queries_hit", "queries"))


def repeats(rows: DataFrame, key: str, run: str, item: str) -> DataFrame:
    """key, runs, items, common, equal: whether all runs of a key gave the same set; a null item only names its run.

    Runs are counted for each item, so no set is gathered.
    """
    runs = rows.groupBy(key).agg(F.count_distinct(run).alias("runs"))
    held = rows.filter(F.col(item).isNotNull()).groupBy(key, item).agg(F.count_distinct(run).alias("held"))
    held = held.join(runs, key).groupBy(key).agg(F.count("*").alias("items"), F.count_if(F.col("held") == F.col("runs")).alias("common"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = runs.join(held, key, "left").select(key, "runs", none("items"), none("common"))
    return out.withColumn("equal", F.col("items") == F.col("common"))


def claims(outcomes: DataFrame, stored: DataFrame, group: str, outcome: str, digits: int = 2) -> DataFrame:
    """check, expected, actual, ok: a stored summary against the outcomes it sums up.

    stored: group, n, pct and the bounds low and high of a difference. Means are recomputed from the 0/1
    outcomes and rows counted; a group without outcomes has an actual of null and fails. An interval passes if it excludes zero.
    """
    again = outcomes.groupBy(F.col(group).alias("_g")).agg(F.count(outcome).cast("double").alias("_n"), F.round(100.0 * F.avg(outcome), digits).alias("_pct"))
    rows = stored.join(again, F.col(group) == F.col("_g"), "left")
    off = F.when((F.col("low") > 0) | (F.col("high") < 0), 1.0).otherwise(0.0)
    case = lambda name, want, got: F.struct(F.concat_ws(":", F.lit(name), F.col(group).cast("string")).alias("check"), want.cast("double").alias("expected"), got.cast("double").alias("actual"))
    cases = F.array(case("mean", F.round("pct", digits), F.col("_pct")), case("rows", F.col("n"), F.col("_n")), case("excludes_zero", F.lit(1.0), off))
    return rows.select(F.inline(cases)).withColumn("ok", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


def digest(rows: DataFrame, order: str, text: Column) -> DataFrame:
    """One row: n_rows, digest (16 hex digits), which depends on the rows' texts and their order.

    Rows follow ``order`` (a number), ties their own hash. Hashes of WIDTH neighbours are hashed together, LEVELS
    times, so no task gets more than WIDTH of them; a null text counts as empty. No rows give the digest of nothing.
    """
    leaves = rows.select(F.col(order).alias("_o"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("_h"))
    leaves = leaves.withColumn("_c", runlog._cells(leaves, "_o"))
    at = runlog.ranked(leaves, [], ["_o", "_h"], ["_c"]).select(F.col("_p").alias("_i"), "_h", F.lit(1).cast("long").alias("_k"))
    for _ in range(LEVELS):
        block = F.floor(F.col("_i") / WIDTH)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_h"))), lambda x: x["_h"]), "")
        at = at.groupBy(block.alias("_b")).agg(F.sha2(joined.cast("binary"), 256).alias("_h"), F.sum("_k").alias("_k")).select(F.col("_b").alias("_i"), "_h", "_k")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return at.agg(F.coalesce(F.sum("_k"), F.lit(0)).alias("n_rows"), F.substring(F.coalesce(F.min("_h"), nothing), 1, 16).alias("digest"))


def sorted_json(columns: list[str]) -> Column:
    """The named columns as JSON with sorted keys, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
