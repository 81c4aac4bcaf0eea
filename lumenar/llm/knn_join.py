"""Exact top-k inner products by a Voronoi join.

Vectors are quantised to integers; queries and data are grouped by their nearest pivot, and
pivots are a bounded sample. A group of queries lies within radius u of its pivot p, so a
vector x scores at least p.x - u|x| and at most p.x + u|x| against each of them. Summaries:
each group's radius, and the k + 1 highest of those lower bounds over all data (one more, since a
query's own row is no candidate), which every query of the group is sure to reach. A vector
is replicated to the groups of queries whose k-th sure score its upper bound reaches, and to
no other. Groups of queries are cut into chunks and the vectors that reach a group into blocks
of bounded size, so that a group with a third of all rows is many tasks; each (chunk, block) is
solved locally by matrix products, and the blocks' k best are merged.

Defined results: vectors that are null or hold null or non-finite components take no part,
nor do rows with a null vec_id; rows that repeat a vec_id are rows of their own, as queries and
as candidates, and only a query's own row is no candidate; vectors of unequal length are
compared as if padded with zeros; components whose multiple exceeds a double count as the
largest double; scores beyond 64 bits saturate; ties go to the smaller vec_id, then to the row
read first; fewer candidates than k give fewer rows; an empty table gives none; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenar.storage import table, written

PIVOTS = 32
BLOCK_ROWS, CHUNK_QUERIES = 16_384, 16_384
TILE = 512
SCALE = 256


def _matrix(vectors, width: int | None = None) -> np.ndarray:
    rows = list(vectors)
    width = max((len(x) for x in rows), default=0) if width is None else width
    if rows and all(len(x) == width for x in rows):
        return np.stack(rows).astype(np.float64) if width else np.zeros((len(rows), 0))
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while they hold all partial sums, else in integers of any size."""
    if not queries.size or not data.size:
        return np.zeros((len(queries), len(data)), np.int64)
    if np.abs(queries).max() * np.abs(data).max() * queries.shape[1] < 2**53:
        return (queries @ data.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(queries) @ whole(data).T
    return np.clip(exact, 1 - 2**63, 2**63 - 1).astype(np.int64)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, row, v): a number of the row, and scale * x of each component as a double, for the rows that take part."""
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.col(vector_col).cast("array<double>").alias("v"))
    infinite, most = float("inf"), float(np.finfo(np.float64).max)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(infinite)))
    # rounded in Python: floor() gives a 64-bit integer here, which a large component exceeds
    scaled = F.transform("v", lambda x: F.greatest(F.least(x * scale, F.lit(most)), F.lit(-most)))
    return slim.where(F.col("vec_id").isNotNull() & fine).select("vec_id", "row", scaled.alias("v"))


def _wide(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, max(0, width - rows.shape[1]))))


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row, by score, then by column; entries of the least integer are none."""
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        row, column = np.nonzero(score >= least[:, None])
    else:
        row, column = np.nonzero(score > _NONE)
    row, column = row[score[row, column] > _NONE], column[score[row, column] > _NONE]
    order = np.lexsort((column, -score[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


_NONE = np.iinfo(np.int64).min


def knn_join(vectors: DataFrame, is_query: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row that ``is_query`` (SQL over vec_id) selects."""
    fine = quantised(vectors, id_col, vector_col)
    sample = [np.floor(r["v"]) for r in fine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()]
    width = max((len(x) for x in sample), default=0)
    at = _matrix(sample, width)

    def placed(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        data = np.floor(_matrix(batch["v"], max(width, max((len(x) for x in batch["v"]), default=0))))
        return data, _wide(at, data.shape[1])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data, pivot = placed(batch)
            with np.errstate(all="ignore"):
                cell = ((data**2).sum(1)[:, None] - 2 * data @ pivot.T + (pivot**2).sum(1)[None, :]).argmin(1)
                far = np.sqrt(((data - pivot[cell]) ** 2).sum(1))
            yield pd.DataFrame({"cell": cell.astype("int32"), "far": np.nan_to_num(far, nan=np.inf), "vec_id": batch["vec_id"], "row": batch["row"], "v": list(data)})

    cells = written(fine.mapInPandas(assign, "cell int, far double, vec_id long, row long, v array<double>"), "cells")
    asked = cells.where(is_query)
    # One row per pivot; their number is the parameter above.
    groups = {r["cell"]: r for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("queries"), F.max("far").alias("radius")).collect()}
    empty = "query_id long, rank int, vec_id long, score long"
    if not groups:
        return cells.sparkSession.createDataFrame([], empty)
    names = np.array(sorted(groups), np.int64)
    radius = np.array([groups[c]["radius"] for c in names])
    chunks = np.array([-(-groups[c]["queries"] // CHUNK_QUERIES) for c in names])

    def bounds(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Middle, spread and slack of the score of each vector with each group of queries."""
        data, pivot = placed(batch)
        with np.errstate(all="ignore"):
            middle, spread = data @ pivot[names].T, np.linalg.norm(data, axis=1)[:, None] * radius[None, :]
            return middle, spread, 1 + 1e-9 * (np.abs(middle) + spread)

    def sure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k + 1 highest lower bounds of a task for each group."""
        best = np.full((0, len(names)), -np.inf)
        for batch in batches:
            if not batch.empty:
                middle, spread, slack = bounds(batch)
                low = middle - spread - slack
                best = -np.sort(-np.concatenate([best, np.where(np.isnan(low), -np.inf, low)]), axis=0)[: k + 1]
        yield pd.DataFrame({"g": np.tile(np.arange(len(names), dtype="int32"), len(best)), "low": best.ravel()})

    # at most k + 1 rows a task and group, and k + 1 of a group here
    ranked = cells.select("vec_id", "row", "v").mapInPandas(sure, "g int, low double").withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("low")))).where(F.col("place") == k + 1)
    kth = np.full(len(names), -np.inf)
    for r in ranked.collect():
        kth[r["g"]] = r["low"]

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not batch.empty:
                middle, spread, slack = bounds(batch)
                near = ~(middle + spread + slack < kth[None, :])  # where the bound is no number, the vector goes
                yield batch.assign(reached=[np.flatnonzero(x).astype("int32") for x in near])

    data = written(cells.select("vec_id", "row", "v").mapInPandas(reach, "vec_id long, row long, v array<double>, reached array<int>"), "reaching")
    sizes = {r["g"]: r["count"] for r in data.select(F.explode("reached").alias("g")).groupBy("g").count().collect()}  # one row per pivot
    blocks = np.array([max(1, -(-sizes.get(g, 0) // BLOCK_ROWS)) for g in range(len(names))])

    def of_group(values: np.ndarray, g: Column) -> Column:
        return F.element_at(F.array(*[F.lit(int(x)) for x in values]), g + 1)

    group_of = F.element_at(F.create_map(*[F.lit(int(x)) for pair in zip(names, range(len(names)), strict=True) for x in pair]), F.col("cell"))
    key = ["g", "chunk", "block"]
    left = asked.withColumn("g", group_of).withColumn("chunk", F.pmod(F.xxhash64("row"), of_group(chunks, F.col("g"))).cast("int"))
    left = left.select("g", "chunk", F.explode(F.sequence(F.lit(0), of_group(blocks, F.col("g")) - 1)).alias("block"), F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), F.col("v").alias("q"))
    right = data.select(F.explode("reached").alias("g"), "vec_id", "row", "v").withColumn("block", F.pmod(F.xxhash64("row"), of_group(blocks, F.col("g"))).cast("int"))
    right = right.select("g", F.explode(F.sequence(F.lit(0), of_group(chunks, F.col("g")) - 1)).alias("chunk"), "block", "vec_id", "row", "v")

    def solve(some: pd.DataFrame, those: pd.DataFrame) -> pd.DataFrame:
        if some.empty or those.empty:
            return pd.DataFrame({c: [] for c in ("query_id", "query_row", "vec_id", "row", "score")}).astype("int64")
        wide = max(max(map(len, some["q"])), max(map(len, those["v"])))
        those = those.sort_values(["vec_id", "row"])
        ids, rows = those["vec_id"].to_numpy(), those["row"].to_numpy()
        asks, own_rows = some["query_id"].to_numpy(), some["query_row"].to_numpy()
        data = _matrix(those["v"], wide)
        out = []
        for first in range(0, len(some), TILE):
            score = _scores(_matrix(some["q"].iloc[first : first + TILE], wide), data)
            score[own_rows[first : first + TILE, None] == rows[None, :]] = _NONE
            i, j = _best(score, k)  # ids ascend, so ties keep the smaller
            out.append(pd.DataFrame({"query_id": asks[first + i], "query_row": own_rows[first + i], "vec_id": ids[j], "row": rows[j], "score": score[i, j]}))
        return pd.concat(out)

    local = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(solve, "query_id long, query_row long, vec_id long, row long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_voronoi_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


ORACLE = """
WITH e AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
         , q.n AS query_row
  FROM e q JOIN e d ON q.n <> d.n WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
