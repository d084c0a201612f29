"""Sharding by fixed virtual slots and a versioned map from slots to shards. Columns only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fairground.llm.common import scratch, scratch_path

#: Slots.
SLOTS = 4096
#: What a record takes besides its text.
RECORD_BYTES = 16


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, place (a number of the row's own) and virtual_slot of every row.

    Texts are read once; what is needed of them is a scratch table. A row's slot is a hash of its id, or
    of its text if it has none; rows that repeat an id (or, without one, a text) would all weigh on one
    slot, and so are spread by their place as well."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    named = docs[id_col].isNotNull()
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"), F.when(named, F.xxhash64(docs[id_col].cast("string"))).otherwise(F.xxhash64(F.lit("text"), text)).alias("key"),
    )
    rows = scratch(rows, "records")
    repeated = rows.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    spread = rows.join(repeated, "key", "left")
    slot = F.pmod(F.when(F.col("times").isNull(), F.xxhash64("key")).otherwise(F.xxhash64("key", "place")), F.lit(SLOTS)).cast("int")
    return spread.select("doc_id", "size", "text_crc32", "place", slot.alias("virtual_slot"))


def slot_bytes(slotted: DataFrame) -> DataFrame:
    """virtual_slot, bytes, rows: at most SLOTS rows, summed before the shuffle."""
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _unfold(folded: DataFrame, version: int) -> DataFrame:
    """The map as a table, from a row of the two arrays slots and shards."""
    pairs = folded.select(F.explode(F.arrays_zip("slots", "shards")).alias("x"))
    return pairs.select(F.lit(version).alias("version"), F.col("x.slots").alias("virtual_slot"), F.col("x.shards").alias("shard"))


def first_map(totals: DataFrame, shards: int) -> DataFrame:
    """version, virtual_slot, shard: slots from the largest on, each to the lightest shard so far.

    The fold runs over one row that holds at most SLOTS slots, whatever the size of the table."""
    slots = totals.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot"))).alias("slots"))
    empty = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("to"))

    def place(state, slot):
        to = F.array_position(state["load"], F.array_min(state["load"])).cast("int")  # from 1; the first of equals
        load = F.transform(state["load"], lambda x, i: F.when(i == to - 1, x - slot["less"]).otherwise(x))
        return F.struct(load.alias("load"), F.concat(state["to"], F.array(to - 1)).alias("to"))

    folded = slots.select(F.col("slots.virtual_slot").alias("slots"), F.aggregate("slots", empty, place)["to"].alias("shards"))
    return _unfold(folded, 1)


def edit_map(old: DataFrame, totals: DataFrame, shards: int, version: int) -> DataFrame:
    """The next version of a map for one or more shards more, numbered after the old ones.

    Each old shard, its slots taken by size, gives up slots while its load after it stays at or over
    the new mean; the new shards take these slots in turn. No slot moves between old shards."""
    weighed = old.join(F.broadcast(totals.select("virtual_slot", "bytes")), "virtual_slot", "left").fillna(0, ["bytes"])
    mean = weighed.agg((F.sum("bytes") / F.lit(shards)).alias("mean"), (F.max("shard") + 1).alias("had"))
    running = W.partitionBy("shard").orderBy("bytes", "virtual_slot")
    left = weighed.crossJoin(F.broadcast(mean)).withColumn("kept", F.sum("bytes").over(W.partitionBy("shard")) - F.sum("bytes").over(running))
    gone = left.where(F.col("kept") >= F.col("mean"))
    turn = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("bytes"), "virtual_slot")) - 1
    gone = gone.select("virtual_slot", (F.col("had") + turn % (F.lit(shards) - F.col("had"))).cast("int").alias("to"))
    edited = old.join(F.broadcast(gone), "virtual_slot", "left")
    return edited.select(F.lit(version).alias("version"), "virtual_slot", F.coalesce("to", "shard").alias("shard"))


def write_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map: no earlier version is changed."""
    slot_map.coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """version, virtual_slot, shard: the stored map of that version, or of the last."""
    stored = spark.read.schema("version int, virtual_slot int, shard int").parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """Every row's shard under the stored map, with its place there, from 0 without gaps, and its shard
    under the next version, rebalanced for one shard more.

    Rows are hashed into SLOTS slots, bytes are summed per slot, and the map from slots to shards makes
    the shards' bytes near equal. The map is a table at map_path (a scratch table by default) that
    holds every version: the first is written here, read back to place the rows, edited for one shard
    more, and the edited one is added as version 2. Only ids, sizes and checksums are shuffled.

    Null texts count as empty; rows without an id are hashed by their text; rows that repeat an id are
    spread over all slots. In a slot, rows are ordered by id, size, checksum and place in the table. An
    empty table gives an empty result and a map of no slots. Other columns are ignored."""
    spark = docs.sparkSession
    slotted = with_slots(docs, id_col, text_col)
    totals = scratch(slot_bytes(slotted), "slot_bytes")
    path = map_path or scratch_path(spark, "slot_map")
    write_map(first_map(totals, shards), path)
    current = read_map(spark, path, 1)
    write_map(edit_map(current, totals, shards + 1, 2), path)
    moved = read_map(spark, path, 2).select("virtual_slot", F.col("shard").alias("rebalanced_shard"))
    placed = totals.join(F.broadcast(current), "virtual_slot").join(F.broadcast(moved), "virtual_slot")
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.select("virtual_slot", "shard", "rebalanced_shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32", "place")) - 1
    out = slotted.withColumn("rank", rank).join(F.broadcast(placed), "virtual_slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", F.lit(1).alias("map_version"), "rebalanced_shard",
    )
