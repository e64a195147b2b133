"""Token counts by the whole-token shortcut.

The vocabulary is examined once, before any text: a piece that the library itself encodes as
that one token, when it stands alone behind its space mark, is proven whole. In a text, a
pre-token that is such a piece counts as one; only the others are merged by the library.

Pre-tokens are the stretches between spaces and line ends. No piece crosses them: the space mark
occurs in a piece only at its start or in runs of marks, and a line end is in no piece, so it is
always one byte token. ``Vocabulary`` checks both facts for the file at hand and falls back to
the library on whole texts where they fail.

A null text counts as empty and has no tokens; a very long text is counted whole. Counts know no ties. Repeated rows are counted each for itself, null
ids stay null, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame

from .runtime import map_rows, once, texts

MARK = "▁"
LIMIT = 4096
#: Merged pre-tokens that a task remembers; the table is emptied when it is full.
REMEMBERED = 400_000


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        plain = [i for i in range(n) if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i))]
        pieces = {i: self.lib.id_to_piece(i) for i in plain}
        self.splits = not any((MARK in p.lstrip(MARK)) or "\n" in p for p in pieces.values()) and self._keeps_spaces()
        # "x" alone is encoded as MARK + x, just as it is behind a space.
        words = [p[1:] for p in pieces.values() if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
        self.whole = frozenset(w for w, ids in zip(words, self.lib.encode(words), strict=True) if len(ids) == 1) if self.splits else frozenset()

    def _keeps_spaces(self) -> bool:
        """Whether a space becomes one mark, with one more in front, and nothing else changes."""
        return self.lib.normalize("a  \u212b\n ") == f"{MARK}a{MARK}{MARK}\u212b\n{MARK}"


def counter(path: str) -> Callable[[str], int]:
    """The function from a text to its number of tokens."""
    vocabulary = Vocabulary(path)
    encode, whole = vocabulary.lib.encode, vocabulary.whole
    if not vocabulary.splits:
        return lambda text: len(encode(text, num_threads=1))
    base = dict.fromkeys(whole, 1)
    known = dict(base)

    def count(text: str) -> int:
        if not text:
            return 0
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " " or "\x00" in text or " \n" in text:
            # Runs of marks merge with what follows: the library takes such texts whole.
            return len(encode(text, num_threads=1))
        words = text.split(" ")
        get = known.get
        found = list(map(get, words))
        if None in found:
            new = list({w for w, n in zip(words, found, strict=True) if n is None})
            if len(known) + len(new) > REMEMBERED + len(base):
                known.clear()
                known.update(base)
                new = list(set(words).difference(known))
            known.update(zip(new, map(len, encode(new, num_threads=1)), strict=True))
            found = map(known.__getitem__, words)
        return sum(found)

    return count


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row. ``tokenizer``: the file's place."""

    def make() -> Callable[[Iterator[tuple]], Iterable[tuple]]:
        count = once(f"count {tokenizer}", lambda: counter(tokenizer))

        def rows(source: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, text in source:
                n = count(text)
                yield doc_id, len(text.encode()), n, n > limit

        return rows

    return map_rows(texts(docs, id_col, text_col), make, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
