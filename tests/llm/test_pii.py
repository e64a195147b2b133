import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from siftline.llm import pii as op

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(*m.span(), "email") for m in EMAIL.finditer(text)]
    out += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(*m.span(), "card") for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(*m.span(), "phone") for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_as_brute_force():
    rng = random.Random(1)
    parts = ["a", "b@", "@", ".", "c-d", "%", "+", "1", "23", "255", "0256", "4111111111111111", "4111 1111-1111 1111", " ", "-", "(", ")", "é", "\n", "5500005555555559"]
    for _ in range(30_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert op.base_spans(t) == brute(t), t


def test_long_runs_take_no_square_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + "(" * 300_000, "9" * 5000 + ".1.1.1"):
        op.base_spans(t)


def test_decoding_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, k = int(rng.integers(1, 7)), 3
        e, a = rng.normal(size=(n, k)) * 2, rng.normal(size=(k, k))
        e[:, 0] += rng.choice([0, 2, 4])
        value = lambda p, e=e, a=a, n=n: sum(e[i, p[i]] for i in range(n)) + sum(a[x, y] for x, y in zip([0, *p], [*p, 0]))
        assert value(op.decode(e, a).tolist()) == pytest.approx(max(value(p) for p in itertools.product(range(k), repeat=n)))


def test_the_field_on_another_draw_of_its_table():
    finder, right, all_ = op.Finder(), 0, 0
    for tokens, labels in op.training_table(seed=99):
        x = np.array([0, 0, *finder.numbers(tokens), 0, 0])
        e = sum(finder.weights[o][x[o : o + len(tokens)]] for o in range(5))
        got = op.decode(e, finder.moves)
        right += sum(op.LABELS[g] == w for g, w in zip(got, labels))
        all_ += len(labels)
    assert right > 0.98 * all_


def test_what_the_field_adds():
    found = lambda t: [(t[a:b], k) for a, b, k in op.Finder()([t])[0]]
    assert found("please call 555-123-4567 now") == [("555-123-4567", "crf_phone")]
    assert found("her ssn 123-45-6789 is") == [("123-45-6789", "crf_id")]
    assert found("so Mr. John Smith went") == [("John Smith", "crf_name")]
    assert found("in 2020-01-02 of 12-34 and 4845168114") == []
    assert op.added([(0, 5, "ip"), (2, 9, "card")], [(8, 10, "crf_id"), (9, 10, "crf_phone")]) == [(9, 10, "crf_phone")]


def test_rows(odd, odd_rows, none, spark, sf_dir):
    assert op.scan(none).count() == 0 and op.scan(odd).count() == len(odd_rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in op.scan(docs).collect():
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(op.joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for *_, k in base) for x in op.BASE]
        assert r.spans.startswith(op.joined(base))


def test_held_out_sentences():
    """Precision and recall on sentences in other words than the table's, and no spans in most of the driver's texts."""
    import re

    from .pii_held_out import SENTENCES

    finder, right, extra, missed = op.Finder(), 0, 0, 0
    assert not set(SENTENCES) & set(op.SENTENCES)
    for sentence in SENTENCES:
        text, gold, at = "", set(), 0
        for m in re.finditer(r"\[(phone|id|name) ([^\]]+)\]", sentence):
            text += sentence[at : m.start()]
            gold.add((len(text), len(text) + len(m[2]), f"crf_{m[1]}"))
            text, at = text + m[2], m.end()
        found = set(finder([text + sentence[at:]])[0])
        right, extra, missed = right + len(found & gold), extra + len(found - gold), missed + len(gold - found)
    assert right / (right + extra) >= 0.9 and right / (right + missed) >= 0.8
