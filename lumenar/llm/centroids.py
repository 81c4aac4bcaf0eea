"""Centroid clustering of quantised vectors: Lloyd's rounds over distinct vectors with multiplicities.

1. Vectors are quantised to integers, and identical ones become one row with a multiplicity
   (combined before the shuffle, so a vector that a third of all rows hold costs one row a task).
2. The start is the k kept vectors whose ids have the smallest SHA-256 with a seed.
3. A round assigns every distinct vector in its task and returns one row a centroid: the weight and
   the weighted componentwise sums, exact integers. Their totals, k rows, give the next centroids as
   exact floors. Only centroids, k times the dimensions, ever reach the driver.
4. After the last round distinct vectors are assigned once more, and assignments go back to the ids
   by the vector's digest; those of hot vectors are broadcast and their rows stay where they are.

All arithmetic is on integers, so results depend on no order, partitioning or attempt.

Defined results: vectors that are null, of another length, or hold null or non-finite components
are left out; ties go to the centroid with the smaller number; rows that repeat an id count as often
as they occur (as starts too, where two equal starts leave the second one without vectors); rows with
a null id count and are returned, but are no start; with fewer vectors than k there are as many
centroids as vectors with an id, and without any there are no rows; further columns are ignored. A
quantised component of 2^25 or more in absolute value is an error: its distances need not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenar.llm.hot_keys import join_facts
from lumenar.storage import table, written

#: Squared distances of vectors whose components are smaller fit a long at up to 2^11 dimensions.
MOST_COMPONENT = 1 << 25
BLOCK = 4096


def quantised(vectors: DataFrame, scale: int, dim: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, q, digest) of the vectors that take part; the digest is the SHA-256 of the components as decimals joined by commas."""
    x = F.col(vector_col)
    whole = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    component = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    small = F.forall("q", lambda c: (c < MOST_COMPONENT) & (c > -MOST_COMPONENT))
    rows = vectors.where(x.isNotNull() & whole).select(F.col(id_col).cast("long").alias("vec_id"), component.alias("q"))
    safe = F.when(small, F.col("q")).otherwise(F.raise_error(F.lit(f"a quantised component is beyond {MOST_COMPONENT}")).cast("array<long>"))
    rows = rows.select("vec_id", safe.cast("array<int>").alias("q"))
    return rows.withColumn("digest", F.sha2(F.array_join("q", ","), 256))


def _starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").select(order.alias("h"), "q").orderBy("h", "q").limit(k)
    return np.array([r["q"] for r in first.collect()], np.int64)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row; ties go to the smaller number."""
    most = max(int(np.abs(q).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    # floats are exact below 2^53, and multiply faster
    kind = np.float64 if 4 * q.shape[1] * most * most < 1 << 52 else np.int64
    a, c = q.astype(kind), centroids.astype(kind)
    squares = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]
    cluster = squares.argmin(1)
    return cluster, squares[np.arange(len(q)), cluster].astype(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, _matrix(part.column("q"), dim)


def _weighted_sums(q: np.ndarray, weight: np.ndarray) -> list[int]:
    """Exact also where a long would overflow: halves of the weights are summed apart."""
    low, high = weight & 0xFFFF, weight >> 16
    return [int(a) + (int(b) << 16) for a, b in zip(low @ q, high @ q, strict=True)]


def totals(distinct: DataFrame, centroids: np.ndarray, dim: int) -> DataFrame:
    """(cluster, weight, sums) of the assigned distinct vectors, summed exactly in each task and then over tasks."""
    kind = pa.list_(pa.decimal128(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sums = [0] * len(centroids), [[0] * dim for _ in centroids]
        for part, q in _blocks(batches, dim):
            weight = part.column("weight").to_numpy()
            cluster, _ = nearest(q, centroids)
            for c in np.unique(cluster).tolist():
                mine = cluster == c
                weights[c] += int(weight[mine].sum())
                sums[c] = [a + b for a, b in zip(sums[c], _weighted_sums(q[mine], weight[mine]), strict=True)]
        full = [c for c, w in enumerate(weights) if w]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([weights[c] for c in full], pa.int64()), pa.array([sums[c] for c in full], kind)], ["cluster", "weight", "sums"])

    found = distinct.select("q", "weight").mapInArrow(run, "cluster int, weight long, sums array<decimal(38,0)>")
    return found.groupBy("cluster").agg(F.sum("weight").alias("weight"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dim))).alias("sums"))


def assigned(distinct: DataFrame, centroids: np.ndarray, dim: int) -> DataFrame:
    """distinct vectors with their cluster and squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, q in _blocks(batches, dim):
            cluster, distance = nearest(q, centroids)
            yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("weight"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["digest", "weight", "cluster", "distance"])

    return distinct.select("q", "digest", "weight").mapInArrow(run, "digest string, weight long, cluster int, distance long")


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int, dim: int) -> np.ndarray:
    """Centroids after the rounds; those without vectors stay. k rows a round reach the driver."""
    for _ in range(rounds):
        moved = centroids.copy()
        for r in totals(distinct, centroids, dim).collect():
            moved[r["cluster"]] = [int(s) // r["weight"] for s in r["sums"]]
        centroids = moved
    return centroids


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid of every vector that takes part."""
    spark = vectors.sparkSession
    schema = "cluster int, cluster_inertia long, inertia long, centroid array<int>, centroid_sha256 string"
    rows = quantised(vectors, scale, dim, id_col, vector_col)
    distinct = written(rows.groupBy("digest", "q").agg(F.count(F.lit(1)).alias("weight")), "distinct-vectors")
    centroids = _starts(rows, k, seed)
    if not len(centroids):
        none = spark.createDataFrame([], "vec_id long, distance long, " + schema)
        return none.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
    centroids = lloyd(distinct, centroids, rounds, dim)
    homes = written(assigned(distinct, centroids, dim), "assigned-vectors")
    inertia = homes.groupBy("cluster").agg(F.sum(F.col("weight") * F.col("distance")).alias("inertia"), F.sum("weight").alias("rows")).collect()  # k rows
    whole, total = sum(r["inertia"] for r in inertia), sum(r["rows"] for r in inertia)
    facts = [(r["cluster"], r["inertia"], whole, centroids[r["cluster"]].tolist(), _sha(centroids[r["cluster"]])) for r in inertia]
    placed = join_facts(rows.select("vec_id", "digest"), homes, "digest", "weight", total)
    told = placed.join(F.broadcast(spark.createDataFrame(facts, schema)), "cluster")  # k rows
    return told.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def _sha(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings")).drop("centroid")


def _round_sql(i: int) -> str:
    """Round i: components of assigned vectors, and the centroids after it."""
    return f"""
a{i} AS MATERIALIZED (
  SELECT v.row, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS distance
  FROM long v JOIN c{i} c ON v.i = c.i GROUP BY v.row, c.cluster
  QUALIFY row_number() OVER (PARTITION BY v.row ORDER BY sum((v.x - c.x) * (v.x - c.x)), c.cluster) = 1),
m{i} AS MATERIALIZED (
  SELECT a.cluster, v.i, sum(v.x) AS s, count(*) AS n FROM long v JOIN a{i} a USING (row) GROUP BY a.cluster, v.i),
c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, c.i, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (cluster, i))"""


#: Lloyd's rounds written out over (row, place, component).
ORACLE = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
long AS MATERIALIZED (SELECT row, unnest(range(64)) AS i, unnest(q) AS x FROM kept),
starts AS (SELECT row, row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS cluster FROM kept WHERE vec_id IS NOT NULL QUALIFY cluster < 16),
c1 AS MATERIALIZED (SELECT s.cluster, v.i, v.x FROM starts s JOIN long v USING (row)),
{_round_sql(1)}, {_round_sql(2)}, {_round_sql(3)}, {_round_sql(4)},
told AS (SELECT cluster, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c4 GROUP BY cluster)
SELECT vec_id, cluster::INTEGER AS cluster, distance::BIGINT AS distance,
       (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a4 JOIN kept USING (row) JOIN told USING (cluster)
"""
