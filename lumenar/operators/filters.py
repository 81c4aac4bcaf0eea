"""Document filters: which documents a query need not read at all, and how several filters combine."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenar.functions.values import cosine
from lumenar.operators.cascade import recall_threshold
from lumenar.operators.relational import keep_by_tables
from lumenar.sources import sinks


class DocumentFilter(ABC):
    """``excluded`` returns (doc_id) of the documents that a query does not need."""

    name = "filter"

    @abstractmethod
    def excluded(self, query_id: str, docs: DataFrame) -> DataFrame: ...

    def kept(self, query_id: str, docs: DataFrame) -> DataFrame:
        return docs.join(self.excluded(query_id, docs), "doc_id", "left_anti")


class NoFilter(DocumentFilter):
    name = "none"

    def excluded(self, query_id: str, docs: DataFrame) -> DataFrame:
        return docs.select("doc_id").where("false")


class SchemaRelevance(DocumentFilter):
    """Documents whose known tables are none of the query's, or whose vector is too far from the query's.

    A target recall of 1 or more leaves vectors aside. The threshold is given, or is that of
    the training documents for the target recall. Documents without a vector are kept.
    """

    name = "schema_relevance"

    def __init__(self, tables: dict[str, list[str]], query_vectors: dict[str, list[float]] | None = None, threshold: float | None = None, target_recall: float = 0.95, training: DataFrame | None = None, keep_unknown: bool = True) -> None:
        self.tables, self.query_vectors, self.threshold = tables, query_vectors or {}, threshold
        self.target_recall, self.training, self.keep_unknown = target_recall, training, keep_unknown

    def excluded(self, query_id: str, docs: DataFrame) -> DataFrame:
        ids = docs.select("doc_id").where("false")
        if "schema_tables" in docs.columns and query_id in self.tables:
            kept = keep_by_tables(docs, self.tables[query_id], keep_unknown=self.keep_unknown)
            ids = docs.select("doc_id").join(kept.select("doc_id"), "doc_id", "left_anti")
        vector = self.query_vectors.get(query_id)
        if vector is None or self.target_recall >= 1:
            return ids
        near = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector]))
        least = self.threshold
        if least is None:
            if self.training is None:
                raise ValueError("without a threshold, training documents are needed")
            least = recall_threshold(self.training.select(near.alias("s")), "s", self.target_recall)
        return ids.unionByName(docs.where(F.col("embedding").isNotNull() & (near < least)).select("doc_id")).distinct()


class Composite(DocumentFilter):
    """Filters combined by ``union`` or ``intersection`` of what they exclude.

    A filter that fails is left out and named in ``failed``; if all fail nothing is excluded.
    """

    name = "composite"

    def __init__(self, filters: list[DocumentFilter], strategy: str = "union") -> None:
        if strategy not in ("union", "intersection"):
            raise ValueError("strategy is 'union' or 'intersection'")
        self.filters, self.strategy, self.failed = filters, strategy, {}

    def excluded(self, query_id: str, docs: DataFrame) -> DataFrame:
        parts = []
        self.failed = {}
        for f in self.filters:
            try:
                parts.append(f.excluded(query_id, docs))
            except (ValueError, KeyError) as error:
                self.failed[f.name] = str(error)
        if not parts:
            return docs.select("doc_id").where("false")
        return merged(parts, self.strategy)


def merged(parts: list[DataFrame], strategy: str = "union") -> DataFrame:
    if strategy not in ("union", "intersection"):
        raise ValueError("strategy is 'union' or 'intersection'")
    ids = [p.select("doc_id") for p in parts]
    return reduce(DataFrame.union, ids).distinct() if strategy == "union" else reduce(DataFrame.intersect, ids).distinct()


FILTERS: dict[str, Callable[..., DocumentFilter]] = {"none": NoFilter, "schema_relevance": SchemaRelevance, "composite": Composite}


def create_filter(name: str, **options) -> DocumentFilter:
    if name not in FILTERS:
        raise ValueError(f"unknown filter {name!r}; known: {', '.join(sorted(FILTERS))}")
    return FILTERS[name](**options)


def reused(spark: SparkSession, f: DocumentFilter, query_id: str, docs: DataFrame, path: str) -> DataFrame:
    """Excluded ids, computed once per query and filter settings: the path is the caller's key of both."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        sinks.filter_artifact(docs, f.excluded(query_id, docs), query_id, path)
    return spark.read.parquet(path).where(F.col("excluded") & (F.col("query_id") == query_id)).select("doc_id")
