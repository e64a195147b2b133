import public_tokenizers
import pytest

from siftline.llm import token_count as op

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_whole_tokens_are_proven(library):
    v = op.Vocabulary(PATH)
    assert v.splits and len(v.whole) > 10_000
    assert all(len(library.encode(w)) == 1 for w in list(v.whole)[:2000])


def test_as_the_library(library):
    import random

    rng, count = random.Random(2), op.counter(PATH)
    parts = ["a", "the", " ", "  ", "\n", " \n", "▁", "\t", "é", "日本", "\x00", "<s>", "<unk>", "12", ".", "\r", "👍", "\xa0", "ing"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert count(t) == len(library.encode(t)), ascii(t)


def test_memory_is_emptied_without_harm(library, monkeypatch):
    monkeypatch.setattr(op, "REMEMBERED", 3)
    count = op.counter(PATH)
    for t in ("qqx zzv qqx", "aab bbq qqx wwv eer", "zzv zzv"):
        assert count(t) == len(library.encode(t))


def test_rows(odd, odd_rows, none, library):
    got = sorted((tuple(r) for r in op.count_tokens(odd, PATH).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in odd_rows]
    assert got == sorted(want, key=str)
    assert op.count_tokens(none, PATH).count() == 0
