"""Sharding by fixed virtual slots.

Every record hashes into one of a fixed number of virtual slots, whatever the number of shards. A small versioned
table maps slots to shards; rebalancing edits that table from the bytes held by each slot and moves as few slots
as it needs. Everything is DataFrame functions; the map has one row per slot, a number fixed by a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sightline.llm.common import shared_folder, utf8

SLOTS = 4096
SHARDS = 16


def records(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes and 1), text_crc32, copy.

    A null text has no bytes. Equal rows are counted before the shuffle and numbered by ``copy``, so a row repeated
    very often spreads over many slots as well. A null doc_id is a value like any other.
    """
    digest = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(utf8("text")) + 1).cast("long").alias("size"),
        F.crc32(utf8("text")).alias("text_crc32"),
    )
    counted = digest.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")


def with_slot(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``rows`` of :func:`records` with ``virtual_slot``, which depends on the record alone."""
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "copy"), F.lit(slots)).cast("int"))


def slot_bytes(slotted: DataFrame) -> DataFrame:
    """Rows and bytes per slot; at most one row per slot."""
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """The map before any rebalancing: slots dealt out in turn."""
    return spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The map edited for ``shards`` shards of near-equal bytes.

    Each shard keeps its largest slots as long as they fit its fair share; the others go, largest first, to the shard
    that holds least by then. A slot of a shard that no longer exists always goes. Slots without bytes stay.
    """
    sized = slot_map.join(sizes.select("virtual_slot", "bytes"), "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("long"))
    inside = W.partitionBy("shard").orderBy(F.col("bytes").desc(), "virtual_slot").rowsBetween(W.unboundedPreceding, 0)
    fair = sized.agg((F.sum("bytes") / F.lit(shards)).alias("fair"))
    judged = sized.withColumn("upto", F.sum("bytes").over(inside)).join(F.broadcast(fair))  # one row
    judged = judged.withColumn("stays", (F.col("shard") < shards) & ((F.col("upto") <= F.col("fair")) | (F.col("bytes") == 0)))
    kept = judged.where("stays").groupBy("shard").agg(F.sum("bytes").alias("held"))
    loads = kept.agg(F.map_from_entries(F.collect_list(F.struct("shard", "held"))).alias("held"))
    # One row holds the moved slots: as many entries as the map has slots, at most.
    moved = judged.where("not stays").agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "virtual_slot"))).alias("moved"))
    placed = loads.join(F.broadcast(moved)).select(
        F.expr(
            f"""aggregate(moved,
                  named_struct('loads', transform(sequence(0, {shards - 1}), s -> coalesce(element_at(held, int(s)), 0L)),
                               'picks', cast(array() as array<struct<virtual_slot: int, shard: int>>)),
                  (a, x) -> named_struct(
                    'loads', transform(a.loads, (l, i) -> if(i + 1 = array_position(a.loads, array_min(a.loads)), l - x.order, l)),
                    'picks', concat(a.picks, array(named_struct('virtual_slot', x.virtual_slot,
                             'shard', int(array_position(a.loads, array_min(a.loads)) - 1))))),
                  a -> a.picks)"""
        ).alias("picks")
    )
    edits = placed.select(F.explode("picks").alias("p")).select("p.virtual_slot", "p.shard")
    return judged.where("stays").select("virtual_slot", "shard").unionByName(edits)


def store_map(slot_map: DataFrame, folder: str, version: int) -> None:
    """Write one version of the map; versions are never overwritten, so readers of an older one are not disturbed."""
    slot_map.coalesce(1).write.mode("error").parquet(f"{folder}/version={version}")


def read_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{folder}/version={version}")


def shard(docs: DataFrame, slots: int = SLOTS, shards: int = SHARDS, folder: str | None = None) -> DataFrame:
    """Records with ``virtual_slot``, ``shard`` and ``position``, which counts from 0 without gaps in each shard.

    Stores version 0 of the map (slots in turn) and version 1 (edited by bytes) in ``folder`` and reads version 1 back.
    An empty table gives no rows and a map that is left as it was.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "slot-map")
    slotted = with_slot(records(docs), slots)
    store_map(first_map(spark, slots, shards), folder, 0)
    sizes_folder = f"{folder}/slot_bytes"
    slot_bytes(slotted).coalesce(1).write.parquet(sizes_folder)
    sizes = spark.read.schema("virtual_slot int, bytes long, rows long").parquet(sizes_folder)
    store_map(rebalanced(read_map(spark, folder, 0), sizes, shards), folder, 1)
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    starts = read_map(spark, folder, 1).join(sizes, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy")
    return slotted.join(F.broadcast(starts), "virtual_slot").withColumn(  # one row per slot
        "position", F.col("start") + F.row_number().over(inside) - 1
    ).drop("start")
