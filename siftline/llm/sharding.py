"""Sharding by fixed virtual slots.

A row's slot is a hash of its id and text, one of 4,096, and never changes. Bytes and rows are
added up by slot, and a slot-to-shard map says where each slot lies. Maps have versions, each a stored
table: the first deals slots out in turn; ``rebalanced`` edits a map into the next version by moving single
slots from the heaviest to the lightest shard while that brings them closer. An edit that adds shards
moves slots into the new ones only. Only the map is edited; rows of slots that don't move stay where
they are. ``assign`` reads the last version of a folder, stores the next one there and follows it.

Law: ``bytes``, sizes near equal. Equal texts form no unit: copies under different ids are spread over slots
like any other rows, as a group that holds a third of all bytes couldn't stay together under this law.
Rows that repeat both id and text would share a slot: each of them but the first of its repeats is put by a
number that it gets when the rows are written, so that they are spread too.

Null texts count as empty (size 1), null ids hash like a value of their own; very long texts are one row of
their size. Of equally heavy shards, ties, the first gives and takes; of equally good slots the first moves.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import durable, exists, new_folder, texts

SLOTS, SHARDS = 4096, 8


@dataclass(frozen=True)
class SlotMap:
    version: int
    shards: int
    shard_of: tuple[int, ...]

    @staticmethod
    def first(shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
        return SlotMap(1, shards, tuple(s % shards for s in range(slots)))

    def rebalanced(self, slot_bytes: dict[int, int], shards: int | None = None) -> SlotMap:
        """The next version; with ``shards`` more than now, new shards start empty."""
        count = shards or self.shards
        if count < self.shards:
            raise ValueError("a map can't lose shards: move their slots first")
        if max(slot_bytes, default=0) >= len(self.shard_of):
            raise ValueError("the map has fewer slots")
        of, load = list(self.shard_of), [0] * count
        held: list[dict[int, int]] = [{} for _ in range(count)]
        for slot, size in slot_bytes.items():
            load[of[slot]] += size
            held[of[slot]][slot] = size
        takers = range(self.shards, count) if count > self.shards else range(count)
        while True:
            most, least = max(range(count), key=lambda i: (load[i], -i)), min(takers, key=lambda i: (load[i], i))
            gap = load[most] - load[least]
            # Moving size b leaves a gap of |gap - 2b| between the two.
            slot = min(held[most], key=lambda s: (abs(gap - 2 * held[most][s]), s), default=None)
            if slot is None or not 0 < held[most][slot] < gap:
                break
            size = held[most].pop(slot)
            held[least][slot], of[slot] = size, least
            load[most] -= size
            load[least] += size
        return SlotMap(self.version + 1, count, tuple(of))

    def save(self, spark: SparkSession, folder: str) -> None:
        """As one more version under ``folder``; earlier ones stay."""
        rows = [(s, k, self.shards) for s, k in enumerate(self.shard_of)]
        spark.createDataFrame(rows, "slot int, shard int, shards int").coalesce(1).write.mode("error").parquet(f"{folder}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        table = spark.read.parquet(folder)
        version = table.agg(F.max("version")).first()[0] if version is None else version
        rows = sorted(tuple(r) for r in table.filter(F.col("version") == version).select("slot", "shard", "shards").collect())
        return SlotMap(int(version), rows[0][2], tuple(r[1] for r in rows))


def slotted(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row, virtual_slot: durable, without texts."""
    rows = texts(docs, id_col, text_col).select("doc_id", (F.octet_length("text").cast("long") + 1).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()))
    again = rows.groupBy(F.col("doc_id").alias("id"), F.col("text_crc32").alias("crc"), F.col("size").alias("s")).agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = durable(again.drop("n"))
    rows = rows.withColumn("salt", F.lit(0).cast("long"))
    if not again.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_crc32") == F.col("crc")) & (F.col("size") == F.col("s"))
        rows = rows.join(again, same, "left").withColumn("salt", F.when(F.col("row") > F.col("first"), F.col("row")).otherwise(0).cast("long"))
    h = F.when(F.col("salt") == 0, F.xxhash64("doc_id", "text_crc32")).otherwise(F.xxhash64("doc_id", "text_crc32", "salt"))
    return durable(rows.select("doc_id", "size", "text_crc32", "row", F.pmod(h, F.lit(slots)).cast("int").alias("virtual_slot")))


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Slot to (bytes, rows); as many as there are slots at most."""
    return {r[0]: (r[1], r[2]) for r in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()}


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard), grown_shard, virtual_slot, map_version.

    ``folder``: where the versions of the map are stored; without one they go to a new folder of the shared one.
    The last version there (or the first map) is rebalanced to the rows at hand and, if that moves a slot
    or adds shards, stored as the next version.
    """
    spark = docs.sparkSession
    rows = slotted(docs, slots, id_col, text_col)
    sizes = slot_sizes(rows)
    folder = folder or new_folder(spark, "slots")
    if not exists(spark, folder):
        SlotMap.first(shards, slots).save(spark, folder)
    old = SlotMap.load(spark, folder)
    new = old.rebalanced({s: b for s, (b, _) in sizes.items()}, shards)
    if (new.shards, new.shard_of) != (old.shards, old.shard_of):
        new.save(spark, folder)
    slot_map = SlotMap.load(spark, folder)
    base, filled = [], [0] * slot_map.shards
    for slot in range(slots):
        base.append((slot, slot_map.shard_of[slot], filled[slot_map.shard_of[slot]]))
        filled[slot_map.shard_of[slot]] += sizes.get(slot, (0, 0))[1]
    # One row for each slot: a proven bound.
    places = F.broadcast(spark.createDataFrame(base, "virtual_slot int, shard int, base long"))
    turn = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "row"))
    return rows.withColumn("turn", turn).join(places, "virtual_slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("turn") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(slot_map.version).alias("map_version"),
    )
