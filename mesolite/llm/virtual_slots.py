"""Operator 13: sharding by fixed virtual slots.

Each record is hashed to one of thousands of slots, whose number never changes.
A small map says in which shard each slot lies.  The map is a table of versions
(version, slot, shard): version 1 deals the slots out in equal runs; an edit
reads the map and the bytes of the slots and appends a version.  Two edits are
known: ``rebalanced`` moves slots between shards until their bytes are near
equal, ``grown`` moves slots from every shard into one more, and none between
the old ones.  Records are never dealt again, they follow their slots.

The law of the query is ``bytes``: the shards' sizes are near equal.  The
largest slots of a shard stay as far as they fit its share of all bytes, the
rest goes, largest first, to the lightest shard, so two shards differ by little
more than the smallest slots do, unless one slot is larger than a share.

A record's hash is taken of its id, size and checksum, so rows with one id (or
none) spread over all slots.  Its place in the shard is the sum of three counts:
the slots before its own, the parts of the slot before its own (each slot has
``PARTS``), the rows of the part before it.  Only parts are numbered row by row.

Only DataFrame functions are used.  The map has ``SLOTS`` rows and the counts
``SLOTS * PARTS`` at most, whatever the input.

Defined cases: a null text has no bytes and checksum 0, its size is 1; an empty
text is the same; a null id is hashed as empty text; rows that agree in id, size
and checksum share a slot and take neighbouring places in any order; a text of
any length is one record; without rows the map is still stored and the result
is empty; columns of other names are not read (``write_shards`` keeps the whole
row in ``doc``).  Results depend on nothing but the rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mesolite.llm._spark import documents, shared_dir, written

SLOTS = 4096
PARTS = 64
SHARDS = 8


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, key, virtual_slot, part) of each row, and the columns that ``carry`` names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(*carry, F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32")
    keyed = sized.withColumn("key", F.md5(named.cast("binary")))
    digits = lambda at, n: F.conv(F.substring("key", at, n), 16, 10).cast("long")
    return keyed.withColumns({"virtual_slot": digits(1, 8) % slots, "part": (digits(9, 4) % PARTS).cast("int")})


def part_counts(rows: DataFrame) -> DataFrame:
    """(virtual_slot, part, rows, bytes): added up in the tasks before the shuffle."""
    return rows.groupBy("virtual_slot", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


def slot_bytes(counts: DataFrame) -> DataFrame:
    """(slot, bytes, rows) of the slots that hold rows."""
    return counts.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1: the slots in runs of equal length."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").alias("slot"), F.expr(f"id * {shards} div {slots}").cast("int").alias("shard"))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Appends a version to the store."""
    slot_map.select("version", "slot", "shard").coalesce(1).write.mode("append").partitionBy("version").parquet(path, compression="zstd")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the store, the newest where none is named."""
    store = spark.read.schema("slot long, shard int, version int").parquet(path).select("version", "slot", "shard")
    if version is None:
        version = store.agg(F.max("version")).first()[0]
    return store.filter(F.col("version") == version)


def _weighed(slot_map: DataFrame, loads: DataFrame) -> DataFrame:
    return slot_map.join(loads.select("slot", "bytes"), "slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("long"))


def rebalanced(slot_map: DataFrame, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version over shards 0 to ``shards`` - 1: the bytes of ``loads`` (slot, bytes) near equal, few slots moved."""
    share = F.ceil(F.sum("bytes").over(Window.partitionBy()) / shards)
    largest_first = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.sum(F.when(F.col("bytes") <= F.col("share"), F.col("bytes")).otherwise(0)).over(largest_first) <= F.col("share")
    weighed = _weighed(slot_map, loads).withColumn("share", share)
    stays = (F.col("shard") < shards) & ((F.col("bytes") == 0) | ((F.col("bytes") <= F.col("share")) & fits))
    judged = weighed.withColumn("stays", stays)
    # one row: the kept bytes of each shard and the slots to move, largest first
    kept = F.array(*[F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == s), F.col("bytes"))), F.lit(0)).cast("long") for s in range(shards)])
    moving = F.array_sort(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), "slot"))))
    row = judged.agg(F.max("version").alias("version"), kept.alias("kept"), moving.alias("moving"))
    dealt = F.expr("""aggregate(moving,
        struct(kept AS loads, cast(array() AS array<struct<slot: bigint, shard: int>>) AS moved),
        (a, x) -> struct(
            transform(a.loads, (b, s) -> if(s = array_position(a.loads, array_min(a.loads)) - 1, b - x.less, b)) AS loads,
            concat(a.moved, array(struct(x.slot AS slot, cast(array_position(a.loads, array_min(a.loads)) - 1 AS int) AS shard))) AS moved))""")
    moved = row.select(F.explode(dealt["moved"]).alias("m")).select(F.col("m.slot").alias("slot"), F.col("m.shard").alias("to"))
    return slot_map.join(moved, "slot", "left").select((F.col("version") + 1).alias("version"), "slot", F.coalesce("to", "shard").alias("shard"))


def grown(slot_map: DataFrame, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version over one shard more: every shard gives it slots until what is left is a share of ``shards`` + 1; empty slots by number."""
    share = F.sum("bytes").over(Window.partitionBy()) / (shards + 1)
    own = Window.partitionBy("shard")
    in_order = own.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    left = F.sum("bytes").over(own) - F.sum("bytes").over(in_order)
    weighed = _weighed(slot_map, loads).withColumn("share", share).withColumn("left", left)
    goes = F.when(F.col("bytes") > 0, F.col("left") >= F.col("share")).otherwise(F.col("slot") % (shards + 1) == shards)
    return weighed.select((F.col("version") + 1).alias("version"), "slot", F.when(goes, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def placed(rows: DataFrame, counts: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with shard and slot, the place in the shard: from 0, without gaps."""
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    slots = slot_map.join(slot_bytes(counts).select("slot", "rows"), "slot").withColumn("slots_before", F.coalesce(F.sum("rows").over(before("shard", "slot")), F.lit(0)))
    parts = counts.withColumn("parts_before", F.coalesce(F.sum("rows").over(before("virtual_slot", "part")), F.lit(0)))
    starts = parts.join(slots.select(F.col("slot").alias("virtual_slot"), "shard", "slots_before"), "virtual_slot")
    starts = starts.select("virtual_slot", "part", "shard", (F.col("slots_before") + F.col("parts_before")).alias("start"))
    at = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("key")) - 1
    return rows.join(starts, ["virtual_slot", "part"]).withColumn("slot", (F.col("start") + at).cast("long")).drop("start")


def write_shards(docs: DataFrame, path: str, slot_map: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The rows themselves, in ``doc``, in folders ``shard=...`` under ``path``, with size, checksum, virtual slot and place."""
    slots = slot_map.count()
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id__"), F.col(text_col).alias("text__"))
    rows = records(whole, "id__", "text__", slots, carry=("doc",))
    out = placed(rows, written(part_counts(rows), "slot-counts"), slot_map).select("shard", "doc", "size", "text_crc32", "virtual_slot", "slot")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path, compression="zstd")


def op13_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by version 2, the rebalanced map; home_shard is that of version 1, next_shard that of version 3, grown by a shard."""
    rows = written(records(documents(spark, sf_dir)), "slot-records")
    counts = written(part_counts(rows), "slot-counts")
    loads = slot_bytes(counts)
    store = f"{shared_dir(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex}"
    save_map(first_map(spark), store)
    save_map(rebalanced(load_map(spark, store), loads), store)
    save_map(grown(load_map(spark, store), loads), store)
    versions = {v: load_map(spark, store, v).select(F.col("slot").alias("virtual_slot"), F.col("shard").alias(c)) for v, c in ((1, "home_shard"), (3, "next_shard"))}
    out = placed(rows, counts, load_map(spark, store, 2)).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int"), "map_version": F.lit(2)})
    # a map has SLOTS rows
    for other in versions.values():
        out = out.join(F.broadcast(other), "virtual_slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot", "map_version", "home_shard", "next_shard")
