"""A membership filter of bounded size for semi-joins against large texts (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: eight for each key, within these bounds: 1 MB to 16 MB to broadcast at any input size.
#: Beyond 16 million keys more rows pass that need not; the exact join that follows gives the same rows.
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 27


def filter_bits(keys: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (8 * keys).bit_length()))


def slot_of(key: Column, bits: int) -> Column:
    """Never null, or the join would test its key for nulls by computing it a second time."""
    return F.coalesce(F.pmod(F.xxhash64(key), F.lit(bits)), F.lit(0))


def membership(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """The bitmaps (bucket, bitmap) of the keys' slots."""
    slot = slot_of(F.col(key), bits)
    return keys.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bitmap"))


def _tested(rows: DataFrame, key: Column, keys: DataFrame, keys_key: str, how: str) -> tuple[DataFrame, Column]:
    n = filter_bits(keys.count())
    rows = rows.withColumn("_slot", slot_of(key, n))
    rows = rows.withColumn("_bucket", F.coalesce(F.bitmap_bucket_number("_slot"), F.lit(0))).withColumn("_bit", F.bitmap_bit_position("_slot").cast("int"))
    bits = membership(keys, keys_key, n).select(F.col("bucket").alias("_bucket"), F.col("bitmap").alias("_bitmap"))
    byte = F.conv(F.hex(F.expr("substring(_bitmap, _bit div 8 + 1, 1)")), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, F.expr("_bit % 8")).bitwiseAND(F.lit(1)) == 1
    return rows.join(F.broadcast(bits), "_bucket", how), hit


def marked_members(rows: DataFrame, key: Column, keys: DataFrame, keys_key: str, mark: str) -> DataFrame:
    """``rows`` with a boolean ``mark``: false where the key is surely not among ``keys``."""
    columns = rows.columns
    rows, hit = _tested(rows, key, keys, keys_key, "left")
    return rows.select(*columns, F.coalesce(hit, F.lit(False)).alias(mark))


def maybe_members(rows: DataFrame, key: str, keys: DataFrame, keys_key: str) -> DataFrame:
    """Rows whose key may be among ``keys``: none is lost; others may pass, so an exact join follows."""
    columns = rows.columns
    rows, hit = _tested(rows, F.col(key), keys, keys_key, "inner")
    return rows.where(hit).select(*columns)
