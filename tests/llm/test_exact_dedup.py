import hashlib
from collections import defaultdict

import pytest

from siftline.llm import exact_dedup as op

FOLD = str.maketrans(op.__dict__.get("UPPER", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(FOLD)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known, default=None)
        stays = [False] * len(ids)
        stays[ids.index(keep)] = True
        out += [(i, keep, len(ids), k, hashlib.sha256(t.encode()).hexdigest()) for i, k in zip(ids, stays)]
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 2])
def test_as_brute_force_even_if_hashes_collide(odd, odd_rows, bits):
    got = op.verdicts(odd, hash_bits=bits).drop("n_chunks").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(odd_rows)


def test_whole_table_as_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    for bits in (64, 4):
        assert sorted((tuple(r) for r in op.verdicts(docs, hash_bits=bits).drop("n_chunks").collect()), key=str) == want


def test_one_row_of_each_group_is_kept_with_its_columns(odd, odd_rows):
    got = op.keep_first(odd)
    assert got.columns == odd.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(i) for i, _, _, kept, _ in brute(odd_rows) if kept)


def test_empty_table(none):
    assert op.verdicts(none).count() == 0 and op.keep_first(none).count() == 0


def test_chunks_make_up_the_text(odd):
    from pyspark.sql import functions as F

    assert odd.filter(F.array_join(op._chunks(F.col("text")), "") != F.col("text")).count() == 0


def test_an_edit_changes_few_chunks(spark):
    import random

    rng = random.Random(1)
    t = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) + rng.choice(["", "", "."]) for _ in range(20_000))
    rows = op.recipes(spark.createDataFrame([(1, t), (2, "inserted. " + t)], "doc_id long, text string")).collect()
    a, b = (set(r.recipe) for r in rows)
    assert len(a) > 100 and len(a & b) > 0.9 * len(a)


def test_columns_of_any_name_and_type(spark):
    """Dotted names, names used inside, maps; a shuffled input."""
    rows = [(i % 7, f"Text {i % 5}", {"k": i}, f"u{i}", i, i, i) for i in range(200)] + [(None, None, None, None, None, None, None)] * 3
    schema = "doc_id long, text string, props map<string,int>, `meta.url` string, __stay_n int, n int, doc int"
    docs = spark.createDataFrame(rows, schema).repartition(5)
    got = op.keep_first(docs)
    assert got.columns == docs.columns
    left = [tuple(r) for r in got.collect()]
    # Ids 0 to 6 meet all five texts; id 6 stays for each, of its rows the largest as JSON.
    assert len(left) == 6 and sorted((r[0] is None, r[0], r[1]) for r in left if r[0] is not None) == [(False, 6, f"Text {t}") for t in range(5)]
    assert all((r[0], r[1], r[2], r[3]) == (r[4] % 7, f"Text {r[4] % 5}", {"k": r[4]}, f"u{r[4]}") for r in left if r[0] is not None)
