import random

import numpy as np
import pytest

from siftline.llm import similar as op


def jaccard(a, b):
    s = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    return len(s(a) & s(b)) / len(s(a) | s(b))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("pairwise", [8, 1])
def test_similar_texts_meet_and_others_do_not(spark, pairwise, monkeypatch):
    monkeypatch.setattr(op.links, "__defaults__", (pairwise,))
    rng, texts = random.Random(1), {}
    for g in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for c in range(4):
            texts[10 * g + c] = " ".join(edited(rng, base, c))
        texts[10 * g + 9] = " ".join(edited(rng, base, 60))
    of = dict(op.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect())
    for g in range(40):
        for c in range(4):
            assert jaccard(texts[10 * g], texts[10 * g + c]) > 0.8 and of[10 * g + c] == 10 * g
        assert jaccard(texts[10 * g], texts[10 * g + 9]) < 0.6 and of[10 * g + 9] == 10 * g + 9


def test_keep_first_and_odd_rows(odd, none):
    got = op.keep_first(odd)
    assert got.columns == odd.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 5, 7, 8, 9, 10]
    assert op.keep_first(none).count() == 0


def test_recall_of_blocks_is_that_of_the_similarity():
    """Keys take no number of texts, and pairs at 0.8 share one."""
    rng, hit = np.random.default_rng(2), 0
    for _ in range(300):
        h = rng.integers(0, 2**64, 450, np.uint64)  # 360 in both, 45 in each alone
        hit += bool(set(op.bands(op.minima(h[:405]))) & set(op.bands(op.minima(h[45:]))))
    assert hit >= 298
    assert not set(op.bands(op.minima(h[:200]))) & set(op.bands(op.minima(h[200:])))


def test_short_texts_are_told_apart(spark):
    rows = [(i, f"call {i * 7919} now") for i in range(1320)] + [(2000 + i, f"Call  {i * 7919} NOW") for i in range(0, 1320, 10)]
    of = dict(op.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert all(of[i] == i for i in range(1320)) and all(of[2000 + i] == i for i in range(0, 1320, 10))


def test_the_exact_similarity_decides(spark):
    """Pairs at 0.80 are linked and pairs just below are not, every one."""
    rng, texts, rows = random.Random(3), {}, []
    for g in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(84 + g)]
        n = len(words) - 4  # shingles
        cut = n // 5  # the tail's own shingles: n - cut of n are left
        for c, k in enumerate([cut, cut + 1]):
            texts[3 * g + c + 1] = " ".join(words[: len(words) - k])
        texts[3 * g] = " ".join(words)
    few = [f"s{i}" for i in range(9)]
    texts[600], texts[601] = " ".join(few), " ".join(few[:8])  # 5 and 4 shingles
    rows = [(i, t) for i, t in texts.items() if i % 3 != 1 or i >= 600]
    of = dict(op.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert of[601] == 600
    assert all(jaccard(texts[3 * g], texts[3 * g + 2]) < 0.8 and of[3 * g + 2] == 3 * g + 2 for g in range(150))
    rows = [(i, t) for i, t in texts.items() if i % 3 != 2 and i < 600]
    of = dict(op.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert all(jaccard(texts[3 * g], texts[3 * g + 1]) >= 0.8 and of[3 * g + 1] == 3 * g for g in range(150))


def test_null_and_repeated_ids_lose_no_group(spark):
    rng = random.Random(4)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(40)]
    rows = [(None if i % 2 else i % 4, " ".join(w), i) for i, w in enumerate(words)]
    rows += [(None, f"{t}  ", 100 + i) for _, t, i in rows[:10]] + [(7, rows[1][1] + " more", 200), (0, rows[2][1] + " more", 201)]
    got = {r.n for r in op.keep_first(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()}
    # Row 1 yields to the row with an id, row 2 to the smaller id; of null ids the largest row stays.
    assert got == (set(range(40)) - {1, 2, 3, 5, 7, 9}) | {103, 105, 107, 109, 200, 201}


def test_columns_of_any_name_and_type(spark):
    rng = random.Random(6)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(5)]
    rows = [(i % 9, " ".join(words[i % 5]), {"k": i}, f"u{i}", i, i, i) for i in range(90)] + [(None, None, None, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, props map<string,int>, `meta.url` string, __n int, root int, doc int").repartition(5)
    got = op.keep_first(docs)
    assert got.columns == docs.columns
    left = [tuple(r) for r in got.collect()]
    assert len(left) == 6 and {(r[0], r[1]) for r in left} == {(0, " ".join(w)) for w in words} | {(None, None)}
    assert all(r[2] == {"k": r[4]} and r[3] == f"u{r[4]}" for r in left if r[0] is not None)


def _components(texts, least=0.8):
    """Smallest id of each id's component, by the true Jaccard similarity of all pairs."""
    sets = {i: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))} if t.split() else set() for i, t in texts.items()}
    of = {i: i for i in texts}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    where = {}
    for i, s in sets.items():
        for x in s or {None}:
            where.setdefault(x, []).append(i)
    seen = set()
    for ids in where.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((root(a), root(b)))
                        of[y] = x
    return {i: root(i) for i in texts}


def test_whole_table_as_true_jaccard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got = dict(op.similar_groups(docs).collect())
    assert got == _components(texts) and len(set(got.values())) < len(got)


def test_a_large_group_just_under_and_over_the_similarity(spark):
    """300 texts made from one by edits: most pairs are near 0.8, in blocks of many components."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = {}
    for i in range(300):
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(len(words))] = rng.choice([f"new{rng.randrange(10**6)}", "often", "here"])
        texts[i] = " ".join(words)
    got = dict(op.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect())
    assert got == _components(texts) and 5 < len(set(got.values())) < 250


def test_form_letters_that_are_not_similar_are_not_paired(spark):
    """Letters from one template at 0.75 to 0.79: what the last step looks at grows no faster than their number."""
    from pyspark.sql import functions as F

    def letters(n):
        rng, out = random.Random(11), []
        base = [f"w{i}" for i in range(200)]
        for _ in range(n):
            words = list(base)
            for place in range(20, 200, 36):
                words[place] = f"name{rng.randrange(10**9)}"
            out.append(" ".join(words))
        return out

    texts = letters(40)
    assert all(0.75 <= jaccard(a, b) < 0.8 for a, b in zip(texts, texts[1:], strict=False))
    looked = []
    for n in (500, 2000):
        rows = [(i, op.shingles(t, 5).view("int64").tolist()) for i, t in enumerate(letters(n))]
        sets = spark.createDataFrame(rows, "node long, items array<long>")
        member = sets.select("node", F.col("node").alias("root"))
        known = op._prefixes(member, sets, 0.8)
        looked.append(known.groupBy("t").agg((F.count("*") * F.count_if("short")).alias("pairs")).agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0])
        assert op._sharing_rare(member, sets, 0.8).count() == 0
    assert looked[1] <= 4 * looked[0]
    got = dict(op.similar_groups(spark.createDataFrame(list(enumerate(letters(600))), "doc_id long, text string")).collect())
    assert got == {i: i for i in range(600)}


def test_crowded_shingles_are_dealt_to_cells(spark, monkeypatch):
    monkeypatch.setattr(op, "CELL", 16)
    test_a_large_group_just_under_and_over_the_similarity(spark)


def _told(known):
    return sorted((r.t, r.node, r.root, r.size, r.place, r.short, r.largest, r.cells) for r in known.collect())


def test_shingles_that_a_large_group_shares_are_not_joined(spark, monkeypatch):
    """Of 400 letters from one template only their own shingles meet in a join: a fixed few from each letter."""
    from pyspark.sql import functions as F

    rng, rows = random.Random(12), []
    for i in range(400):
        words = [f"w{k}" for k in range(200)]
        for place in range(20, 200, 36):
            words[place] = f"name{rng.randrange(10**9)}"
        rows.append((i, op.shingles(" ".join(words), 5).view("int64").tolist()))
    rows += [(400 + i, [1000 * i + k for k in range(30)] + [7] * (i % 3 == 0)) for i in range(30)] + [(500, rows[0][1][:180]), (501, [9]), (502, [9])]
    sets = spark.createDataFrame(rows, "node long, items array<long>")
    member = sets.select("node", F.col("node").alias("root"))
    joined, whole = [], op.with_groups
    monkeypatch.setattr(op, "with_groups", lambda r, *a: joined.append(r.count()) or whole(r, *a))
    known = _told(op._prefixes(member, sets, 0.8))
    assert sum(joined) < sum(len(x) for _, x in rows) / 8
    # The same prefixes as by one order of all shingles, the rarest first.
    often = {}
    for _, items in rows:
        for t in items:
            often[t] = often.get(t, 0) + 1
    want = set()
    for node, items in rows:
        n = len(items)
        for place, t in enumerate(sorted(items, key=lambda t: (often[t], t))[: n - -(-n * 4 // 5) + 1]):
            if often[t] > 1:
                want.add((t, node, n, place, place <= n - -(-n * 8 // 9)))
    met = {t for t, *_, short in want if short and len({w[1] for w in want if w[0] == t}) > 1}
    assert {(t, node, n, place, short) for t, node, _, n, place, short, *_ in known} == {w for w in want if w[0] in met}
    # However few shingles count as hot, the prefixes are these.
    for hot in (1, 10**9):
        monkeypatch.setattr(op, "HOT", hot)
        assert _told(op._prefixes(member, sets, 0.8)) == known


def test_no_task_gets_a_large_block_whole(spark, monkeypatch):
    """Blocks that still hold several components are found again without dealing their texts by block."""
    asked, whole = [], op.with_groups
    monkeypatch.setattr(op, "with_groups", lambda rows, groups, key, size, total: asked.append((key, groups.agg({size: "max"}).first()[0])) or whole(rows, groups, key, size, total))
    test_a_large_group_just_under_and_over_the_similarity(spark)
    assert max(n or 0 for key, n in asked if key == "block") >= 100
