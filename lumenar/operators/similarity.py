"""Similarity, ranking, clustering and sampling over embeddings and feature sets."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenar.functions.values import cosine, dot
from lumenar.storage import Scratch


def vector_literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def top_k(docs: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest by cosine, ties to the smaller id; a zero query has none."""
    if not any(query):
        return docs.select(F.col(id_col), F.lit(0.0).alias("score")).limit(0)
    return docs.select(F.col(id_col), cosine(F.col(vector), vector_literal(query)).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def rank_or_filter(docs: DataFrame, query: list[float], k: int | None = None, threshold: float | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Missing embeddings score -1; the k best, or all from the threshold on."""
    score = F.when(F.col(vector).isNull(), -1.0).otherwise(cosine(F.col(vector), vector_literal(query)))
    scored = docs.select(F.col(id_col), score.alias("score"))
    return scored.orderBy(F.desc("score"), id_col).limit(k) if k else scored.where(F.col("score") >= threshold)


def similarity_stats(scores: DataFrame, column: str) -> DataFrame:
    return scores.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))


def clusters(vectors: DataFrame, k: int, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    data = vectors.select(F.col(id_col), array_to_vector(F.col(vector)).alias("features"))
    return KMeans(k=k, seed=seed).fit(data).transform(data).select(id_col, F.col("prediction").alias("cluster"))


def mean_vector(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row with the mean: components are averaged by position."""
    means = vectors.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))


def squared_distance(a: Column, b: Column) -> Column:
    difference = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return dot(difference, difference)


def farthest_from_mean(available: DataFrame, selected: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    mean = mean_vector(selected, vector)  # one row
    return available.join(F.broadcast(mean)).select(F.col(id_col), F.sqrt(squared_distance(F.col(vector), F.col("mean"))).alias("distance")).orderBy(F.desc("distance"), id_col).limit(1)


#: Picks that one pass adds to the least distances, written out in its plan.
PICKS_A_PASS = 32


def _distances(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances, summed component by component in order as ``squared_distance`` does."""
    out = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        out += (vectors[:, j] - centre[j]) ** 2
    return out


def k_center(vectors: DataFrame, k: int, first: int, id_col: str = "vec_id", vector: str = "embedding", pool: int = 1024) -> list[int]:
    """Greedy farthest-point picks, ties to the smaller id: the same as one pass a pick gives, in far fewer passes.

    A pass keeps the ``pool`` rows that are farthest from all picks so far, and where the next one lies. Distances only
    shrink as picks are added, so picks from the pool are exact until its best falls behind that bound; ``pool``
    vectors reach the driver a pass. Null vectors are never picked; ids are unique.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    start = rows.where(F.col("id") == first).select("v").first()
    if start is None or k < 1:
        return []
    chosen, fresh = [first], [start["v"]]
    rows = rows.withColumn("least", F.lit(float("inf")))
    scratch = Scratch(vectors.sparkSession)
    while len(chosen) < k:
        steps = [squared_distance(F.col("v"), vector_literal(v)) for v in fresh]
        rows = scratch.written(rows.where(~F.col("id").isin(chosen)).withColumn("least", F.least("least", *steps)), "k-center")
        held = rows.orderBy(F.desc("least"), "id").limit(pool + 1).collect()
        if not held:
            break
        bound = (-held[pool]["least"], held[pool]["id"]) if len(held) > pool else (math.inf, 0)
        held = held[:pool]
        ids, least, points, fresh = np.array([r["id"] for r in held]), np.array([r["least"] for r in held]), np.array([r["v"] for r in held]), []
        while len(chosen) < k and len(ids) and len(fresh) < PICKS_A_PASS:
            at = np.lexsort((ids, -least))[0]
            if (-least[at], ids[at]) > bound:
                break
            chosen.append(int(ids[at]))
            fresh.append(points[at].tolist())
            rest = np.arange(len(ids)) != at
            least = np.minimum(least, _distances(points, points[at]))[rest]
            ids, points = ids[rest], points[rest]
    scratch.clear()
    return chosen


def pooled(tokens: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean and maximum of a group's vectors, by position, side by side."""
    by = tokens.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("mean"), F.max("x").alias("most"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "mean", "most")))
    return by.groupBy(key).agg(F.concat(F.transform(listed, lambda s: s["mean"]), F.transform(listed, lambda s: s["most"].cast("double"))).alias("pooled"))


def schema_features(schema: list[dict]) -> set[str]:
    out = set()
    for t in schema:
        out.add(f"table:{t['Schema Name']}")
        for a in t["Attributes"]:
            out |= {f"{t['Schema Name']}.{a['Attribute Name']}", f"attr:{a['Attribute Name']}"}
    return out


def set_entropy(current: Column, before: Column) -> Column:
    """Share of features that changed; the first set and two empty ones have entropy 1."""
    union = F.size(F.array_union(current, before))
    changed = F.size(F.array_except(current, before)) + F.size(F.array_except(before, current))
    return F.when(before.isNull() | (union == 0), 1.0).otherwise(changed / union)


def minimum_samples(features: int, epsilon: float, delta: float) -> int:
    return math.ceil(math.log(max(features, 1) / delta) / epsilon)


def entropy_stops(streak: int, n: int, features: int, needed: int, least: int, epsilon: float, delta: float) -> bool:
    return streak >= needed and n >= least and (1 - epsilon) ** n * features <= delta


def missing_mass(features: DataFrame, doc: str, feature: str) -> DataFrame:
    """Good-Turing: features seen in one document only, over documents."""
    seen = features.select(doc, feature).distinct()
    once = seen.groupBy(feature).count().agg(F.count_if(F.col("count") == 1).alias("once"), F.count(F.lit(1)).alias("features"))
    docs = seen.agg(F.countDistinct(doc).alias("docs"))
    return once.crossJoin(docs).withColumn("missing_mass", F.col("once") / F.col("docs"))  # one row each
