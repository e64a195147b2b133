import random
import re
from collections import Counter, defaultdict

from siftline.llm import divergence as op
from siftline.llm import queries
from tests.oracle import connect, difference

SCHEMA = "text string, lang string, source string, doc_id long, term string, n long, vector string, value long, p long, zero long, many long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2, "v", 3, 4, 5, 6) for r in rows], SCHEMA)


def brute(rows, least=op.LEAST, ranks=op.RANKS):
    """Every term against every pair of sources, as told."""
    words, met, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        words[lang, source].update(found)
        met[lang].update(set(found))
    out = []
    for lang, sources in langs.items():
        keep = {t for t, n in met[lang].items() if n >= least}
        whole = sum((words[lang, s] for s in sources), Counter())

        def share(c):
            n = sum(c[t] for t in keep) + len(keep)
            return {t: 1 + 10**9 * (c[t] + 1) // n for t in keep}

        p, q = {s: share(words[lang, s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in keep), o.encode(), o) for o in sources if o != s]
            own = [(-f(p[s][t], q[t]), t.encode(), t) for t in keep if words[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(own)[:ranks])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def found(spark, rows, **how):
    got = op.audit(table(spark, rows), **how)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect()))


def test_terms():
    text = "It's a Ümlaut—naïve_x2 ÀB\x00c\U0001f600D日本"
    assert [t.decode() for t in op.terms(text)] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_small_corpus_against_brute_force(spark, monkeypatch):
    """Pieces of seven pairs and tasks that hand on at nine counts; hot source, hot words, ties, short ranks."""
    monkeypatch.setattr(op, "PAIRS", 7)
    monkeypatch.setattr(op, "GATHERED", 9)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.choice([1, 1, 2, 3])))
    rows = [(" ".join(word() for _ in range(rng.randrange(30))), rng.choice(["x", "y", None]), "s0" if i % 3 == 0 else f"s{rng.randrange(6)}") for i in range(120)]
    rows += [("only here twice", "z", "s1"), ("only here", "z", "s2"), ("", "w", "s1")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, least=1, ranks=3) == brute(rows, 1, 3)


def test_odd_rows(spark):
    long = " ".join(["Wort", "wort", "日本"] * 40_000)
    rows = [(None, None, None), ("", "en", "a"), ("A b", "en", None), ("a B", "en", ""), ("a b", "en", "b"), ("a b", "en", "b"), (long, "en", "c"), (long, "en", "c"), (long, "en", "d"), ("12 _ !", "en", "e"), ("x", "de", "a")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [("a", "x", "y")]) == []


def test_whole_table_against_sql(spark, sf_dir):
    assert difference(queries.QUERIES["op11_divergence"](spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL["op11_divergence"]) == ""
