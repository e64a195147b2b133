import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from siftline.llm import packing as op

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()


def check(rows, texts, library, cap=op.CAPACITY):
    """rows: pieces of documents with ids that are unique; texts: doc_id to text."""
    docs, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r[0]].append(r)
        windows[r[5]].append(r)
    assert docs.keys() == texts.keys()
    for doc, pieces in docs.items():
        data, at = ids(library, texts[doc]), 0
        for _, start, n, crc, total, _, _ in sorted(pieces, key=lambda r: r[1]):
            assert start == at and n > 0 and total == len(data) // 4 and crc == zlib.crc32(data[4 * at : 4 * (at + n)])
            at += n
        assert at == len(data) // 4
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r[6]):
            assert r[6] == at
            at += r[2]
        assert at <= cap
    return len(windows)


def test_encoder_as_the_library(library):
    rng, encode = random.Random(3), op.Encoder(PATH)
    assert encode.by_word
    parts = ["'s", "'S", "'re", "’", "a", "A", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "é", "İ", "ı", "ß", "ſ", "K", "½", "²", "12", "_", "-", "!!", "µ", "ª", "日本", "<|endoftext|>", "ŉ", "×"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert encode(t) == encode.whole(t), ascii(t)
    letters = "".join(map(chr, range(0x20, 0x250)))
    assert encode(letters) == encode.whole(letters)


def test_place_minimises_the_sum_of_squares():
    rng, levels = random.Random(4), op.Levels(20)
    for i in range(400):
        size, before = rng.randint(1, 19), levels.count.copy()
        levels.place(size, (i, 0, b"\0" * 4 * size, size))

        def after(h, size=size, before=before):
            n = before.copy()
            if h:
                n[h] -= 1
            if h + size < 20:
                n[h + size] += 1
            return int((n**2).sum())

        choices = [h for h in range(0, 21 - size) if h == 0 or before[h]]
        assert int((levels.count**2).sum()) == min(map(after, choices))
        assert all(len(levels.windows[h]) == levels.count[h] for h in range(1, 20))


@pytest.mark.parametrize("most", [op.OPEN, 3])
def test_round_trip_on_small_windows(library, monkeypatch, most):
    monkeypatch.setattr(op, "OPEN", most)
    rng = random.Random(6)
    texts = {i: " ".join("w" for _ in range(rng.randint(0, 70))) for i in range(300)}
    encode = op.Encoder(PATH)
    rows = list(op.pack_rows(texts.items(), encode, 32, 2, 0))
    check(rows, texts, library, 32)
    fills = defaultdict(int)
    for r in rows:
        fills[r[5]] += r[2]
    # All windows but one are full, or were left as they were at the end.
    assert sum(n < op.LEFT * 32 for n in fills.values()) <= 1
    assert most > 3 or sum(n < 32 for n in fills.values()) <= 4


def test_whole_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = [tuple(r) for r in op.pack(docs.repartition(3), PATH).collect()]
    windows = check(rows, texts, library)
    assert sum(r[2] for r in rows) > 0.94 * 4096 * (windows - 3)


def test_odd_rows(odd, odd_rows, none, library):
    rows = [tuple(r) for r in op.pack(odd, PATH).collect()]
    assert sum(r[2] for r in rows) == sum(len(ids(library, t)) // 4 for _, t in odd_rows)
    assert len([r for r in rows if r[0] in (3, 4)]) == 2
    assert op.pack(none, PATH).count() == 0
