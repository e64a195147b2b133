import zlib
from collections import Counter, defaultdict

import pytest

from siftline.llm import sharding as op


def check(rows, texts, shards=op.SHARDS):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = op.assign(docs).collect()
    check(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) < 0.03 * max(load.values())


def test_odd_rows(odd, odd_rows, none):
    check(op.assign(odd).collect(), odd_rows)
    assert op.assign(none).count() == 0


def test_a_grown_map_moves_slots_to_the_new_shard_only():
    import random

    rng = random.Random(1)
    size = {s: rng.randint(1, 1000) for s in range(op.SLOTS)}
    first = op.SlotMap.first(8).rebalanced(size)
    grown = first.rebalanced(size, 9)
    moved = [s for s in range(op.SLOTS) if first.shard_of[s] != grown.shard_of[s]]
    assert grown.version == first.version + 1 and {grown.shard_of[s] for s in moved} == {8}
    load = Counter()
    for s, b in size.items():
        load[grown.shard_of[s]] += b
    assert max(load.values()) < 1.02 * sum(size.values()) / 9
    with pytest.raises(ValueError):
        grown.rebalanced(size, 3)


def test_versions_are_stored(spark, tmp_path):
    a = op.SlotMap.first(3, 16)
    b = a.rebalanced({0: 10, 3: 20})
    a.save(spark, str(tmp_path))
    b.save(spark, str(tmp_path))
    assert op.SlotMap.load(spark, str(tmp_path)) == b and op.SlotMap.load(spark, str(tmp_path), 1) == a


def test_the_query_edits_the_stored_map(spark, sf_dir, tmp_path):
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), str(tmp_path / "slots")
    before = op.assign(docs.limit(100), folder=folder).collect()
    rows = op.assign(docs, folder=folder).collect()
    grown = op.assign(docs, shards=9, folder=folder).collect()
    versions = [op.SlotMap.load(spark, folder, v) for v in range(1, grown[0].map_version + 1)]
    assert versions[0] == op.SlotMap.first() and before[0].map_version < rows[0].map_version < grown[0].map_version
    for got in (before, rows, grown):
        of = versions[got[0].map_version - 1].shard_of
        assert all(r.shard == of[r.virtual_slot] for r in got)
    slot = {(r.doc_id, r.text_crc32): r.virtual_slot for r in rows}
    assert all(slot[r.doc_id, r.text_crc32] == r.virtual_slot for r in grown)
    assert all(a == b or b == 8 for a, b in zip(versions[-2].shard_of, versions[-1].shard_of))


def test_rows_that_repeat_id_and_text_are_spread(spark):
    rows = [(7, "same text")] * 3000 + [(None, None)] * 3000 + [(i, f"t{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = op.assign(docs).collect()
    check(got, rows)
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) < 0.03 * max(load.values())
