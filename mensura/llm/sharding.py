"""Sharding by fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut, own_name

SHARDS = 40
#: Virtual slots never change; only the map from slots to shards does.
SLOTS = 4096
#: Records that are numbered in one task, on average: a shard is numbered in as many parts as that takes.
PART_RECORDS = 1 << 18
#: Equal records that are written out from one row.
COPIES = 1 << 16
#: Bytes a record takes besides its text.
RECORD_BYTES = 16


@dataclass(frozen=True)
class SlotMap:
    """Which shard each virtual slot is in. A change makes a new version."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, k, s) for k, s in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, shards int, vslot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Each version is a folder of its own; versions are never overwritten."""
        self.frame(spark).coalesce(1).write.parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{path}/version={version}").select("shards", "vslot", "shard").orderBy("vslot").collect()
        return SlotMap(version, rows[0][0], tuple(r[2] for r in rows))


def place(slot_bytes: list[int], shards: int) -> SlotMap:
    """A first map: heaviest slot first, into the lightest shard (ties: the smallest number)."""
    heap = [(0, s) for s in range(shards)]
    shard_of = [0] * len(slot_bytes)
    for k in sorted(range(len(slot_bytes)), key=lambda k: (-slot_bytes[k], k)):
        held, s = heapq.heappop(heap)
        shard_of[k] = s
        heapq.heappush(heap, (held + slot_bytes[k], s))
    return SlotMap(1, shards, tuple(shard_of))


def rebalance(old: SlotMap, slot_bytes: list[int], shards: int) -> SlotMap:
    """The next version, for as many shards as asked for: few slots move.

    Slots of shards that go are dealt anew; then the heaviest shard gives the lightest one a slot as long
    as that narrows the gap between the two.
    """
    shard_of = list(old.shard_of)
    held = [0] * shards
    loose = []
    for k, s in enumerate(shard_of):
        if s < shards:
            held[s] += slot_bytes[k]
        else:
            loose.append(k)
    for k in sorted(loose, key=lambda k: (-slot_bytes[k], k)):
        s = min(range(shards), key=lambda s: (held[s], s))
        shard_of[k] = s
        held[s] += slot_bytes[k]
    own: list[list[int]] = [[] for _ in range(shards)]
    for k, s in enumerate(shard_of):
        own[s].append(k)
    for _ in range(4 * len(shard_of)):
        high, low = max(range(shards), key=lambda s: (held[s], -s)), min(range(shards), key=lambda s: (held[s], s))
        gap = held[high] - held[low]
        fits = [k for k in own[high] if 0 < slot_bytes[k] < gap]
        if not fits:
            break
        k = min(fits, key=lambda k: (abs(gap / 2 - slot_bytes[k]), k))
        own[high].remove(k)
        own[low].append(k)
        shard_of[k] = low
        held[high] -= slot_bytes[k]
        held[low] += slot_bytes[k]
    return SlotMap(old.version + 1, shards, tuple(shard_of))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32 and the hash of the text; a null text is as an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + RECORD_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )


def records_of(rows: DataFrame) -> DataFrame:
    """The distinct records, with the number n of rows that each stands for: rows that repeat are one record, however many."""
    return cut(rows.groupBy("id", "size", "text_crc32", "h").agg(F.count("*").alias("n")))


def numbered(records: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Adds start: the number of rows before a record among those of its keys. Records are ordered in parts, by hash; no task has all of a key."""
    order = ["id", "text_crc32", "size", "h"]
    placed = records.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sums = placed.groupBy(*keys, "part").agg(F.sum("n").alias("part_n"))
    before = F.sum("part_n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*keys, "part", F.coalesce(before, F.lit(0)).alias("part_start"))
    rest = [c for c in records.columns if c not in (*order, *keys, "n")]
    within = F.sum("n").over(Window.partitionBy(*keys, "part").orderBy(*order, *rest).rowsBetween(Window.unboundedPreceding, -1))
    joined = placed.withColumn("within", F.coalesce(within, F.lit(0))).join(starts, [*keys, "part"])
    return joined.withColumn("start", F.col("part_start") + F.col("within")).drop("part", "part_start", "within")


def heavy_texts(records: DataFrame, shards: int) -> list[int]:
    """Hashes of texts whose copies make over half a shard's fair share; fewer than two a shard by that definition."""
    total = records.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0
    groups = records.groupBy("h").agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.sum("n").alias("n"))
    return sorted(r[0] for r in groups.where((F.col("b") > total / shards / 2) & (F.col("n") > 1)).select("h").collect())


def by_text(slots: int):
    return F.pmod(F.col("h"), F.lit(slots)).cast("int")


def slotted(records: DataFrame, heavy: list[int], slots: int, parts: int) -> DataFrame:
    """Adds vslot. Equal texts share a slot, by hash; rows of a heavy text are numbered and dealt over all slots in turn.

    So a record of a heavy text that stands for many rows is in several slots, with a row for each.
    """
    if not heavy:
        return records.withColumn("vslot", by_text(slots))
    is_heavy = F.col("h").isin(heavy)
    light = records.where(~is_heavy).withColumn("vslot", by_text(slots))
    turn = numbered(records.where(is_heavy), parts, "h").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n"), F.lit(slots)) - 1)))
    dealt = turn.withColumn("vslot", F.pmod(F.col("start") + F.col("j"), F.lit(slots)).cast("int")).withColumn("n", F.floor((F.col("n") - 1 - F.col("j")) / slots) + 1)
    return light.unionByName(dealt.select(*light.columns))


def planned(slots_of: DataFrame, shards: int, slots: int, store: str) -> DataFrame:
    """(vslot, shard, version): the map that is in force. slots_of has vslot, size and n of all records.

    Version 1, which deals slots alike, is stored before anything is known of their bytes; then the bytes of each slot are summed, and
    version 2 is stored, the same map edited by the rebalancing. The driver sees a sum per slot, as many as there are slots.
    """
    spark = slots_of.sparkSession
    place([1] * slots, shards).save(spark, store)
    slot_bytes = [0] * slots
    for r in slots_of.groupBy("vslot").agg(F.sum(F.col("size") * F.col("n")).alias("b")).collect():
        slot_bytes[r[0]] = r[1]
    rebalance(SlotMap.load(spark, store, 1), slot_bytes, shards).save(spark, store)
    return SlotMap.load(spark, store, 2).frame(spark).select("vslot", "shard", "version")


def _store(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex}"


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", store: str | None = None) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version.

    Law: bytes. Shards get near equal bytes; equal texts share a shard, unless their copies make over half
    a shard: these are dealt in turn. slot is the row's place in its shard, from 0 without gaps; vslot is the virtual slot that
    the map assigns. The map's versions are stored in the folder `store`, else in one of the shared folder. A null text has
    size 16 and crc 0; a null id is a value like any other. Repeated rows are counted as one record and written out again, each
    with a place of its own. No rows in, no rows out; other columns are not read.
    """
    spark = docs.sparkSession
    records = records_of(measured(docs, id_col, text_col))
    parts = max(1, records.count() // PART_RECORDS)
    placed = slotted(records, heavy_texts(records, shards), slots, parts)
    slot_map = planned(placed, shards, slots, store or _store(spark))
    ranged = numbered(placed.join(F.broadcast(slot_map), "vslot"), max(1, parts // shards), "shard")
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))
    rows = ranged.withColumn("block", block).withColumn("k", F.explode(F.sequence(F.col("block"), F.least(F.col("block") + COPIES, F.col("n")) - 1)))
    return rows.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("k")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        F.col("version").alias("map_version"),
    )


def add_shards(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """docs with vslot and shard; no text is shuffled. Columns of these names are replaced.

    Rows of a heavy text take the slots of its records in turn; rows that repeat a doc_id, too, have any of theirs. Nulls and empty
    tables: as shard_documents. docs has to be a written table, or small: a row's place in it deals repeated rows.
    """
    spark = docs.sparkSession
    records = records_of(measured(docs))
    heavy = heavy_texts(records, shards)
    parts = max(1, records.count() // PART_RECORDS)
    slot_map = planned(slotted(records, heavy, slots, parts), shards, slots, store or _store(spark))
    keep = [c for c in docs.columns if c.lower() not in ("vslot", "shard")]
    names = {c: own_name(f"_{c}", docs) for c in ("h", "same", "id", "start", "n", "vslot")}
    found = docs.select(*keep, F.xxhash64(F.coalesce("text", F.lit(""))).alias(names["h"]))
    vslot = F.pmod(F.col(names["h"]), F.lit(slots)).cast("int")
    if heavy:
        firsts = numbered(records.where(F.col("h").isin(heavy)), parts, "h").select(*(F.col(c).alias(names[c]) for c in ("h", "id", "start", "n")))
        same = firsts.withColumnRenamed(names["h"], names["same"])
        is_heavy = F.col(names["h"]).isin(heavy)
        turned = found.where(is_heavy).withColumn(names["vslot"], F.monotonically_increasing_id()).join(
            same, (F.col(names["h"]) == F.col(names["same"])) & F.col("doc_id").eqNullSafe(F.col(names["id"])))
        turn = F.pmod(F.col(names["start"]) + F.pmod(F.col(names["vslot"]), F.col(names["n"])), F.lit(slots)).cast("int")
        found = found.where(~is_heavy).withColumn(names["vslot"], vslot).unionByName(turned.withColumn(names["vslot"], turn).select(*keep, names["h"], names["vslot"]))
    else:
        found = found.withColumn(names["vslot"], vslot)
    named = slot_map.select(F.col("vslot").alias(names["id"]), F.col("shard").alias(names["n"]))
    joined = found.join(F.broadcast(named), F.col(names["vslot"]) == F.col(names["id"]))
    return joined.select(*keep, F.col(names["vslot"]).alias("vslot"), F.col(names["n"]).alias("shard"))
