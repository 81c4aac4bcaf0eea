"""Contiguous shards of near-equal bytes by global prefix sums (DataFrame functions only).

Rows are range-partitioned by id once, without their texts; each partition's byte and
row totals (one row per partition) give the prefix sums before it, and a running sum
inside each partition does the rest. A row goes to the shard in whose equal share of
the total the row's first byte lies, so shards are contiguous in id order and differ
from the target by less than one document.

Defined results: a null text has no bytes, every row has size bytes + 1, so rows with
null or empty texts are dealt too; null ids come first; rows with equal ids are ordered
by size, checksum and place in the scan and may be split over shards and partitions, so
a hot id doesn't land in one task; an empty table gives no rows; further columns are
ignored. Copies of a text have no say in this law: a group may be larger than a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenar.storage import table, written


def byte_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(payload) + 1).cast("long").alias("size"), F.crc32(payload).alias("text_crc32"))
    slim = slim.withColumn("place", F.monotonically_increasing_id())
    order = ["doc_id", "size", "text_crc32", "place"]
    ranged = written(slim.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "shard-ranges")

    # One row per partition: small at any input size, so a single ordered pass over it is cheap.
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    starts = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(everything).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    start = F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = (
        ranged.join(F.broadcast(starts), "part")
        .withColumn("start", start)
        .withColumn("row", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(f"cast(start * {shards} div all_bytes as int)"))
        .select("doc_id", "size", "text_crc32", "shard", "row")
    )
    placed = written(placed, "shard-rows")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # as many rows as shards
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(table(spark, sf_dir, "documents"))
