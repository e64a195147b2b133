import hashlib
import math
import random
import re

from siftline.llm import secret_scan as op

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(a, b, op.BASE[k]) for a, k, b in sorted(out)]


def test_base_spans_as_brute_force():
    rng = random.Random(1)
    parts = ["password", "PassWd", "api_key", "APIKEY", "ſecret", "secret", "token", " ", "=", ":", '"', "'", "abc123", "AKIA", "ABCDEF1234567890", "0123456789abcdef", "é", "\n", ".", "-"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert op.base_spans(t) == brute(t), t


def segments(v):
    """Costs of all segments, as the module tells them."""
    low, plain = v.lower(), v.lower().translate(op._FOLD)
    for i in range(len(v)):
        for j in range(i + 1, len(v) + 1):
            n = j - i
            if n == 1:
                yield i, j, math.log10(op._charset(v[i]))
            ranks = op.guess_cost.rank
            rank, folded = ranks.get(low[i:j]), ranks.get(plain[i:j])
            if rank or folded:
                yield i, j, (math.log10(rank) if rank else math.log10(folded) + 0.6) + 0.3 * (v[i:j] != low[i:j])
            m = op._DATE.match(v, i)
            if m and m.end() == j:
                yield i, j, math.log10(365 * 120 if n > 4 else 120)
            starts = i == 0 or low[i] != low[i - 1]
            if n >= 3 and len(set(low[i:j])) == 1 and starts:
                yield i, j, math.log10(op._charset(v[j - 1])) + math.log10(n)
            keys = low.translate(op.SHIFTED)
            walks = i == 0 or keys[i - 1 : i + 1] not in op._NEXT
            moves = [op._NEXT.get(keys[k : k + 2]) for k in range(i, j - 1)]
            if n >= 3 and walks and all(moves):
                yield i, j, math.log10(36 * n) + sum(a != b for a, b in zip(moves, moves[1:])) * math.log10(4)


def test_guess_cost_is_the_least_over_all_segmentations():
    rng = random.Random(2)
    parts = ["password", "P@ssw0rd", "qwer", "asdf", "aaaa", "1111", "1999", "2020-01-02", "x", "Z", "$", "é", "love", "12", "1qaz", "!@#", "zaq!"]
    for _ in range(600):
        v = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
        cost = [0.0] + [math.inf] * len(v)
        for i, j, c in sorted(segments(v), key=lambda s: s[1]):
            cost[j] = min(cost[j], cost[i] + c)
        assert math.isclose(op.guess_cost(v), cost[-1], abs_tol=1e-9), v
    assert op.guess_cost("") == 0


def test_guessed_values():
    spans = lambda t: [t[a:b] for a, b, _ in op.guessed_spans(t)]
    assert spans("pwd: X9$kq!2pLm and password = changeme, auth=qwerty123") == ["X9$kq!2pLm"]
    assert spans("x9$kq!2pLm without any context") == []


def test_rows(odd, odd_rows, none, spark, sf_dir):
    assert op.scan(none).count() == 0
    got = {r.doc_id: r for r in op.scan(odd).collect() if r.doc_id is not None}
    assert got[3].base_sha256 == hashlib.sha256(b"").hexdigest() and got[3].spans == ""
    assert op.scan(odd).count() == len(odd_rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in op.scan(docs).collect():
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(op.joined(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for *_, k in base) for x in op.BASE]
        assert set(op.joined(base).split(",")) <= set(r.spans.split(","))


def test_prose_behind_a_credential_word_is_no_secret(spark):
    import public_tokenizers

    english = op.vocabulary_words(public_tokenizers.path("word_bpe_49k.json"))
    guess = op.Guesser([op.WORDS, english])
    spans = lambda t: [t[a:b] for a, b, _ in op.guessed_spans(t, guess)]
    prose = "token: tomorrow auth: required Secret: friendship password: banana secret: everyone token: sequence "
    prose += "the secret: nobody knows. Auth: disabled, api key: optional password = required token=true credentials: missing"
    assert spans(prose) == []
    secrets = ["xK9#mQ2$vL7p", "q7GhT2pLx9Zw", "zmtrwqkvhx", "9f8e7d6c5b4a", "Tr0ub4dor&3xyz!"]
    for v in secrets:
        assert spans(f"password: {v}") == [v], v
    for v in ["1qaz2wsx", "qwertyuiop", "!@#$%^&*()", "zaq12wsx", "aaaaaaaaaaaa", "2020-01-02", "Password1999"]:
        assert spans(f"password: {v}") == [], v


def test_words_are_learned_from_all_texts_but_not_from_values(spark):
    rows = [(i, f"Zorblat wimple token: qhzkvxwpmt {'gribbet ' * (i % 3)}") for i in range(60)] + [(99, None), (100, "rare " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert op.learned_words(docs) == ["gribbet", "wimple", "zorblat"]
    assert op.learned_words(docs, most=2) == [] and op.learned_words(docs.limit(0)) == []
    guess = op.Guesser([op.WORDS, op.learned_words(docs)])
    assert op.guessed_spans("secret: zorblat", guess) == [] and len(op.guessed_spans("secret: qhzkvxwpmt", guess)) == 1


def test_learned_words_by_share(spark, monkeypatch):
    """The same corpus ten times over has the same learned words, once the share is what counts."""
    monkeypatch.setattr(op, "SHARE", 0.05)
    text = " ".join(["gribbet"] * 40 + ["wimple"] * 20 + ["rarely"] * 11 + [f"other{chr(97 + i)}x" for i in range(26)] * 8)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    many = spark.createDataFrame([(i, text) for i in range(10)], "doc_id long, text string")
    assert op.learned_words(docs) == op.learned_words(many) == ["gribbet", "wimple"]
