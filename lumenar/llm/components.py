"""Connected components by alternating large-star and small-star steps over written edge tables.

Every step is a shuffle by node with a map-side combined minimum; the minima of nodes with
very many edges are broadcast, so that their edges never meet in one task. Nothing is
gathered on the driver but a count and a checksum of each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenar.llm.hot_keys import join_facts
from lumenar.storage import remove, written_at


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_facts(both.where("v > u"), least, "u", "n", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    joined = join_facts(edges, least, "u", "n", total)
    hooked = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select("u", F.col("m").alias("v"))
    return hooked.unionByName(kept).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the smallest node reachable.

    Loops and repeated edges are allowed, rows with a null end are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    table, path = written_at(down, name)
    seen, total = None, table.count()
    while True:
        # a large-star step keeps the number of edges or lowers it
        step, step_path = written_at(_small_star(_large_star(table, total), total), name)
        remove(spark, path)
        table, path = step, step_path
        mark = tuple(table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen, total = mark, mark[0]
    roots = table.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return table.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
