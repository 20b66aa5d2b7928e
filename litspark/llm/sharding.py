"""Contiguous shards of near-equal byte size, from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

SHARDS = 40
ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``bytes``).

    Documents lie in ascending id (nulls first; ties by the text's checksum, hash and size) and are cut where
    the middle of a document passes an equal share of all bytes, so a shard is off its share by one document
    at most. Range partitions give the order; each partition's total, summed over the partitions before it,
    turns its own running sums into global ones. The totals, one row a partition, and the first row of each
    shard are all that is broadcast. A document without text has ``row_bytes``; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    keys = ["doc_id", "text_crc32", "tie", "size"]
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + row_bytes).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("tie"),
    )
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(partitions, *keys).withColumn("part", F.spark_partition_id()))
    in_order = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part",
        (F.sum("bytes").over(so_far) - F.col("bytes")).alias("bytes_before"),
        (F.sum("rows").over(so_far) - F.col("rows")).alias("rows_before"),
        F.sum("bytes").over(everything).alias("all_bytes"),
    )
    placed = (
        ranged.select("doc_id", "size", "text_crc32", "part", F.sum("size").over(in_order).alias("upto"), F.row_number().over(in_order).alias("nth"))
        .join(F.broadcast(offsets), "part")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.expr(f"least({shards - 1}, (2 * (bytes_before + upto) - size) * {shards} div (2 * all_bytes))").cast("int").alias("shard"),
            (F.col("rows_before") + F.col("nth") - 1).alias("row"),
        )
    )
    placed = cut(placed)
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
