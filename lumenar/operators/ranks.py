"""Running sums and order statistics over all rows without a task that sees them all.

Rows are range-partitioned once and written, so ranges hold still; one row per range gives the
sums before it, and a window inside each range does the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenar.storage import written


def running_sum(rows: DataFrame, order: list[Column], value: str, out: str, before: bool = False) -> DataFrame:
    """rows with ``out``: the sum of ``value`` over all rows up to each in the order, or before it. Ties of the order are arbitrary, so it should be total."""
    ranged = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_total"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = totals.select("_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    joined = ranged.join(F.broadcast(starts), "_range")
    return joined.withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_range", "_start")


def order_statistics(rows: DataFrame, column: str, ranks: list[int]) -> list[float]:
    """The values of the given ranks (from 0) of the column's known values; as many rows as ranks reach the driver."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_sum(counts, [F.col("_v")], "_n", "_below", before=True)
    wanted = rows.sparkSession.createDataFrame([(r,) for r in sorted(set(ranks))], "_rank long")
    hit = (F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_n"))
    found = {r["_rank"]: r["_v"] for r in placed.join(F.broadcast(wanted), hit).select("_rank", "_v").collect()}
    return [found[r] for r in ranks]


def quantile(rows: DataFrame, column: str, level: float, n: int) -> float:
    """The linearly interpolated quantile of the column's ``n`` known values."""
    at = level * (n - 1)
    low, high = order_statistics(rows, column, [math.floor(at), min(n - 1, math.floor(at) + 1)])
    return float(low) + (at - math.floor(at)) * (float(high) - float(low))
