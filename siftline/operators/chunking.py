"""Sentence packing and fixed-size chunking."""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean, occurrences, sentences
from .ordered import medians
from .retrieval import spread

#: Share of the room from which a paragraph's start closes a chunk.
LATE = 0.85
CHUNKS = "chunk_index int, text string, n_tokens long, char_start int, char_end int, hard_split boolean"


def word_count(c: Column) -> Column:
    return F.regexp_count(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"))


def hard_pieces(text: Column, room: Column) -> Column:
    """The text cut behind every ``room``-th word; nothing is lost but blanks at the cuts."""
    other, word = r"[^\p{L}\p{N}_]*+", r"[\p{L}\p{N}_]++"
    pattern = F.concat(F.lit(f"((?:{other}{word}){{1,"), room.cast("string"), F.lit(f"}}+{other})"))
    return F.transform(F.regexp_extract_all(text, pattern), lambda s: F.trim(s))


def offsets(body: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """Start of the first sentence and end of the last one at or behind it, from 0; -1 where not found."""
    start = F.position(first, body) - 1
    end = F.position(last, body, F.greatest(start, F.lit(0)) + 1) - 1
    return start, F.when(end >= 0, end + F.length(last)).otherwise(F.lit(-1))


def _articles(docs: DataFrame, doc: str, title: str, body: str) -> DataFrame:
    """doc, title, body, cleaned; articles without a body are none."""
    text = lambda c: clean(F.coalesce(F.col(c), F.lit("")))
    return spread(docs).select(F.col(doc).alias("doc"), text(title).alias("title"), text(body).alias("body")).filter("body != ''")


def _head(title: Column) -> Column:
    return F.when(title == "", F.lit("")).otherwise(F.concat(title, F.lit("\n\n")))


def pack(docs: DataFrame, doc: str, title: str, body: str, budget: int) -> DataFrame:
    """doc and CHUNKS: sentences packed greedily under the token budget.

    The title is charged to every chunk; a document whose title leaves no room is dropped (``dropped``
    counts them). A chunk is closed when the next sentence would not fit, or at a paragraph's start
    once 85 % of the room is used; a sentence longer than the room is cut into chunks of its own,
    which have no offsets (-1). Tokens are words, whose counts add up, so that a joined chunk never
    outgrows its sentences; ``pack_counted`` takes counters that don't. A document is folded in its
    own row, without a shuffle.
    """
    rows = _articles(docs, doc, title, body)
    rows = rows.withColumn("head_n", word_count(F.col("title"))).withColumn("room", F.lit(budget) - F.col("head_n")).filter("room > 0")

    # Each sentence is counted once.
    counted = lambda s: F.struct(s["text"].alias("text"), s["starts_paragraph"].alias("p"), word_count(s["text"]).alias("n"), F.lit(False).alias("hard"))
    rows = rows.withColumn("whole", F.transform(sentences(F.col("body")), counted))

    def cut(s: Column) -> Column:
        """The sentence, or its pieces of ``room`` words."""
        pieces = F.transform(hard_pieces(s["text"], F.col("room")), lambda x: F.struct(x.alias("text"), F.lit(False).alias("p"), word_count(x).alias("n"), F.lit(True).alias("hard")))
        return F.when(s["n"] > F.col("room"), pieces).otherwise(F.array(s))

    rows = rows.withColumn("units", F.flatten(F.transform("whole", cut)))
    rows = rows.withColumn("units", F.transform("units", lambda s, i: s.withField("i", i)))
    empty = F.struct(F.lit(0).alias("used"), F.lit(True).alias("closed"), F.array().cast("array<int>").alias("starts"))

    def step(state: Column, s: Column) -> Column:
        full = (state["used"] + s["n"] > F.col("room")) | (s["p"] & (state["used"] >= LATE * F.col("room")))
        fresh = state["closed"] | s["hard"] | full
        used = F.when(fresh, s["n"]).otherwise(state["used"] + s["n"])
        starts = F.when(fresh, F.concat(state["starts"], F.array(s["i"]))).otherwise(state["starts"])
        return F.struct(used.alias("used"), s["hard"].alias("closed"), starts.alias("starts"))

    rows = rows.withColumn("starts", F.aggregate("units", empty, step, lambda s: s["starts"]))
    until = lambda c: F.coalesce(F.try_element_at("starts", c + 2), F.size("units"))
    parts = F.transform("starts", lambda at, c: F.slice("units", at + 1, until(c) - at))
    rows = rows.select("doc", "title", "body", "head_n", F.posexplode(parts).alias("chunk_index", "part"))
    start, end = offsets(F.col("body"), F.col("part")[0]["text"], F.element_at("part", -1)["text"])
    hard, none = F.col("part")[0]["hard"], F.lit(-1)
    n = F.aggregate("part", F.lit(0).cast("long"), lambda a, s: a + s["n"]) + F.col("head_n")
    text = F.concat(_head(F.col("title")), F.array_join(F.transform("part", lambda s: s["text"]), " "))
    return rows.select("doc", "chunk_index", text.alias("text"), n.alias("n_tokens"), F.when(hard, none).otherwise(start).alias("char_start"), F.when(hard, none).otherwise(end).alias("char_end"), hard.alias("hard_split"))


def dropped(docs: DataFrame, doc: str, title: str, body: str, budget: int) -> DataFrame:
    """articles, dropped: one row; articles with a body, and those whose title leaves no room."""
    out = (word_count(F.col("title")) >= budget).cast("long")
    return _articles(docs, doc, title, body).agg(F.count("*").alias("articles"), F.coalesce(F.sum(out), F.lit(0)).alias("dropped"))


def integrity(docs: DataFrame, chunks: DataFrame, doc: str, title: str, body: str, budget: int) -> DataFrame:
    """doc, sentences, lost, duplicated, chunks, over_budget for every article. chunks: as ``pack`` gives them.

    Sentences are sought in the chunks' texts without their titles, joined by blanks in order: one that
    isn't there is lost, one that is there more often than in the body is duplicated. An article without
    chunks has lost all. Ids must be those of single articles.
    """
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    cut = chunks.groupBy(F.col("doc").alias("of")).agg(parts.alias("parts"), F.count("*").alias("chunks"), F.count_if(F.col("n_tokens") > budget).alias("over_budget"))
    rows = _articles(docs, doc, title, body).withColumn("head", _head(F.col("title"))).join(cut, F.col("doc").eqNullSafe(F.col("of")), "left")
    bare = lambda t: F.when(F.startswith(t, F.col("head")), F.substring(t, F.length("head") + 1, F.length(t))).otherwise(t)
    rows = rows.withColumn("joined", F.coalesce(F.array_join(F.transform("parts", lambda c: bare(c["text"])), " "), F.lit("")))
    rows = rows.withColumn("s", F.transform(sentences(F.col("body")), lambda s: s["text"]))
    there = lambda s: F.col("joined").contains(s)
    again = F.filter("s", lambda s: there(s) & (occurrences(F.col("joined"), s) > occurrences(F.col("body"), s)))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("doc", F.size("s").alias("sentences"), F.size(F.filter("s", lambda s: ~there(s))).alias("lost"), F.size(again).alias("duplicated"), none("chunks"), none("over_budget"))


def statistics(chunks: DataFrame, docs: DataFrame, doc: str, title: str, body: str, budget: int) -> DataFrame:
    """One row: chunks, tokens a chunk, fill rate, characters a token of the bodies, hard splits, over budget."""
    n = F.col("n_tokens")
    of = chunks.agg(F.count("*").alias("chunks"), F.avg(n).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"), (F.avg(n) / budget).alias("fill_rate"), F.count_if("hard_split").alias("hard_splits"), F.count_if(n > budget).alias("over_budget"))
    return of.crossJoin(medians(chunks, [], "n_tokens")).crossJoin(_articles(docs, doc, title, body).agg(F.try_divide(F.sum(F.length("body")), F.sum(word_count(F.col("body")))).alias("chars_per_token")))


class ByteCounter:
    """A token for every ``size`` bytes begun: counts of parts don't add up, as with subword tokens."""

    def __init__(self, size: int = 4):
        self.size = size

    def count(self, text: str) -> int:
        return -(-len(text.encode()) // self.size)

    def pieces(self, text: str, room: int) -> list[str]:
        """Whole characters, at most ``room`` tokens each, joined again the text."""
        out, at, used = [], 0, 0
        for i, c in enumerate(text):
            n = len(c.encode())
            if used + n > room * self.size and i > at:
                out.append(text[at:i])
                at, used = i, 0
            used += n
        return [*out, text[at:]] if text else out


class WordCounter:
    """Runs of letters, digits and underscores: what ``word_count`` and ``hard_pieces`` count and cut."""

    WORD = r"[\p{L}\p{N}_]"

    def __init__(self):
        import regex

        self.word = regex.compile(f"{self.WORD}+")
        self.around = lambda room: regex.compile(f"(?:[^\\p{{L}}\\p{{N}}_]*+{self.WORD}++){{1,{room}}}[^\\p{{L}}\\p{{N}}_]*+")

    def count(self, text: str) -> int:
        return len(self.word.findall(text.lower()))

    def pieces(self, text: str, room: int) -> list[str]:
        return [p.strip(" ") for p in self.around(room).findall(text)]


class FileCounter:
    """Counts tokens with a tokenizer file that every executor can read; no special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)

    def count(self, text: str) -> int:
        return len(self.model.encode(text, add_special_tokens=False).ids)

    def pieces(self, text: str, room: int) -> list[str]:
        """The text itself, cut between characters behind every ``room``-th token or a little before."""
        at = self.model.encode(text, add_special_tokens=False).offsets
        # Tokens may share a character: a cut lies where one ends that the next doesn't go on with.
        clean = [0, *(j for j in range(1, len(at)) if at[j][0] >= at[j - 1][1]), len(at)]
        cuts, first = [0], 0
        while first < len(at):
            k = bisect_right(clean, first + room) - 1
            first = clean[k] if clean[k] > first else clean[bisect_right(clean, first)]
            cuts.append(at[first][0] if first < len(at) else len(text))
        return [text[a:b] for a, b in itertools.pairwise(cuts) if b > a]


def token_counts(docs: DataFrame, doc: str, text: str, counter: Callable[[], object], canary: tuple[str, int] | None = None) -> DataFrame:
    """doc, n_tokens of every whole text (null: empty), by a counter made in each task. A canary that counts differently fails the task."""
    rows = spread(docs).select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = _checked(counter(), canary)
        for batch in batches:
            yield pd.DataFrame({"doc": batch["doc"], "n_tokens": [tokens.count(t) for t in batch["text"]]})

    return rows.mapInPandas(run, f"doc {rows.schema['doc'].dataType.simpleString()}, n_tokens long")


def _checked(tokens, canary: tuple[str, int] | None):
    """The counter, if it counts the canary as it should."""
    if canary and tokens.count(canary[0]) != canary[1]:
        raise ValueError(f"tokenizer counts {tokens.count(canary[0])} tokens in the canary, not {canary[1]}")
    return tokens


def pack_counted(docs: DataFrame, doc: str, title: str, body: str, budget: int, counter: Callable[[], object], canary: tuple[str, int] | None = None) -> DataFrame:
    """As ``pack``, for counters whose counts don't add up (``counter()`` makes one in each task).

    Before a chunk is closed its joined text is counted again; sentences that no longer fit go to
    the next chunk, none is lost. A canary (text, tokens) that counts differently fails the task.
    Sentences are cut in the JVM; a document is folded in its own row.
    """
    rows = _articles(docs, doc, title, body).withColumn("s", sentences(F.col("body")))
    rows = rows.select("doc", "body", _head(F.col("title")).alias("head"), F.col("s.text").alias("texts"), F.col("s.starts_paragraph").alias("firsts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = _checked(counter(), canary)
        for batch in batches:
            found = [(row.doc, i, *c) for row in batch.itertuples(index=False) for i, c in enumerate(_fold(tokens, budget, row.head, row.body, list(row.texts), list(row.firsts)))]
            yield pd.DataFrame(found, columns=["doc", *(f.split()[0] for f in CHUNKS.split(", "))])

    return rows.mapInPandas(run, f"doc {rows.schema['doc'].dataType.simpleString()}, {CHUNKS}")


def register_functions(spark: SparkSession, counter: Callable[[], object] = WordCounter) -> None:
    """``pack_chunks(title, body, sentences, budget)`` for SQL's LATERAL: CHUNKS of one cleaned article.

    sentences: array of structs (text, starts_paragraph) in order. Null or empty bodies give no chunks.
    """

    class PackChunks:
        def __init__(self):
            self.tokens = counter()

        def eval(self, title: str, body: str, sentences: list, budget: int):
            if body:
                head = f"{title}\n\n" if title else ""
                found = _fold(self.tokens, budget, head, body, [s["text"] for s in sentences], [s["starts_paragraph"] for s in sentences])
                for i, chunk in enumerate(found):
                    yield (i, *chunk)

    spark.udtf.register("pack_chunks", F.udtf(PackChunks, returnType=CHUNKS))


def pack_table(docs: DataFrame, doc: str, title: str, body: str, budget: int, counter: Callable[[], object] = WordCounter) -> DataFrame:
    """As ``pack``, through the table function: doc and CHUNKS."""
    register_functions(docs.sparkSession, counter)
    rows = _articles(docs, doc, title, body).withColumn("s", sentences(F.col("body")))
    fields = ", ".join("c." + f.split()[0] for f in CHUNKS.split(", "))
    return docs.sparkSession.sql(f"SELECT doc, {fields} FROM {{rows}} r, LATERAL pack_chunks(r.title, r.body, r.s, {int(budget)}) c", rows=rows)


#: Characters whose tokens a task holds at a time, besides those of one text.
CUT = 1 << 19


def segments(docs: DataFrame, doc: str, text: str, segmenter: Callable[[], Callable[[str], list[str]]]) -> DataFrame:
    """doc, tokens: every text's tokens by a segmenter made in each task; tokens without a letter or digit are dropped, a null text has none.

    A segmenter that has ``many`` gets a batch's texts at once.
    """
    rows = spread(docs).select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = segmenter()
        many = getattr(cut, "many", None) or (lambda texts: map(cut, texts))
        for batch in batches:
            for _, rows in batch.groupby(batch["text"].str.len().cumsum() // CUT):
                yield pd.DataFrame({"doc": rows["doc"], "tokens": [[w for w in ws if w.isalnum() or any(c.isalnum() for c in w)] for ws in many(rows["text"].tolist())]})

    return rows.mapInPandas(run, f"doc {rows.schema['doc'].dataType.simpleString()}, tokens array<string>")


class LongestMatch:
    """Cuts a text at the longest words of a dictionary, from the left; what no word starts is a token of one character."""

    def __init__(self, words: list[str]):
        self.words, self.longest = frozenset(words), max(map(len, words), default=1)

    def __call__(self, text: str) -> list[str]:
        out, at = [], 0
        while at < len(text):
            size = next((n for n in range(min(self.longest, len(text) - at), 1, -1) if text[at : at + n] in self.words), 1)
            out.append(text[at : at + size])
            at += size
        return out


def _hard(tokens, budget: int, head: str, text: str, room: int) -> Iterator[tuple[str, int]]:
    """The pieces of a sentence that is too long, each counted as a whole behind the head; those over the budget are cut again."""
    for piece in tokens.pieces(text, room):
        n = tokens.count(head + piece)
        if n > budget and room > 1 and len(piece) > 1:
            yield from _hard(tokens, budget, head, piece, max(1, min(room - 1, room - (n - budget))))
        else:
            yield piece, n


def _fold(tokens, budget: int, head: str, body: str, texts: list[str], firsts: list[bool]) -> Iterator[tuple]:
    """text, n_tokens, char_start, char_end, hard_split of one document's chunks."""
    head_n = tokens.count(head) if head else 0
    room = budget - head_n
    if room <= 0:
        return
    sizes = [tokens.count(s) for s in texts]
    waiting: list[int] = []

    def closed() -> tuple:
        """The chunk of as many waiting sentences as fit, at least one; the others wait on."""
        for keep in range(len(waiting), 0, -1):
            text = head + " ".join(texts[i] for i in waiting[:keep])
            n = tokens.count(text)
            if n <= budget or keep == 1:
                break
        first, last = texts[waiting[0]], texts[waiting[keep - 1]]
        del waiting[:keep]
        start = body.find(first)
        end = body.find(last, max(start, 0))
        return text, n, start, end + len(last) if end >= 0 else -1, False

    for i, size in enumerate(sizes):
        used = sum(sizes[j] for j in waiting)
        over = used + size > room or (firsts[i] and used >= LATE * room)
        if waiting and over:
            yield closed()
        if size > room:
            for piece, n in _hard(tokens, budget, head, texts[i], room):
                yield head + piece, n, -1, -1, True
        else:
            waiting.append(i)
    while waiting:
        yield closed()


def slide(docs: DataFrame, doc: str, text: str, size: int, overlap: int, least: int = 200) -> DataFrame:
    """doc, start, chunk: windows of ``size`` characters; those under ``least`` are dropped."""
    last = F.greatest(F.length(text) - overlap, F.lit(1)) - 1
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), F.explode(F.sequence(F.lit(0), last, F.lit(size - overlap))).alias("start"))
    return rows.select("doc", "start", F.col("text").substr(F.col("start") + 1, F.lit(size)).alias("chunk")).filter(F.length("chunk") >= least)


def severed(pairs: DataFrame, docs: DataFrame, doc: str, text: str, sizes: list[tuple[str, int, int]], least: int = 200) -> DataFrame:
    """label, spans, severed, pct: facts that no chunk holds whole, for each (label, size, overlap).

    pairs: doc, fact. Only texts that a pair names are cut, inside the row that tests them.
    """
    rows = pairs.join(docs.select(F.col(doc).alias("doc"), F.col(text).alias("t")), "doc")

    def whole(size: int, overlap: int) -> Column:
        last = F.greatest(F.length("t") - overlap, F.lit(1)) - 1
        at = lambda i: F.col("t").substr(i + 1, F.lit(size))
        return F.exists(F.sequence(F.lit(0), last, F.lit(size - overlap)), lambda i: (F.length(at(i)) >= least) & at(i).contains(F.col("fact")))

    cases = F.array(*(F.struct(F.lit(name).alias("label"), whole(size, overlap).alias("whole")) for name, size, overlap in sizes))
    out = rows.select(F.explode(cases).alias("x")).groupBy("x.label").agg(F.count("*").alias("spans"), F.sum((~F.col("x.whole")).cast("long")).alias("severed"))
    return out.withColumn("pct", F.round(F.try_divide(100.0 * F.col("severed"), F.col("spans")), 2))
