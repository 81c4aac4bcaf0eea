"""Sinks: results per query, resumption, relational tables, chunked datasets, usage logs, caches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenar.operators.adaptive import batched
from lumenar.sources.datasets import relation
from lumenar.storage import written


def save_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").partitionBy("query_id").parquet(path)


def pending(docs: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that no written result has yet."""
    return docs.join(done.select(key).distinct(), key, "left_anti")


def drop_training(results: DataFrame, train_ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return results.join(train_ids.select(key).distinct(), key, "left_anti")


def publish_relations(records: DataFrame, schema: list[dict], prefix: str = "") -> list[str]:
    """A temporary view for each table of the schema; returns their names."""
    names = []
    for t in schema:
        relation(records, t["Schema Name"], [a["Attribute Name"] for a in t["Attributes"]]).createOrReplaceTempView(prefix + t["Schema Name"])
        names.append(prefix + t["Schema Name"])
    return names


def save_relations(records: DataFrame, schema: list[dict], root: str) -> None:
    for t in schema:
        relation(records, t["Schema Name"], [a["Attribute Name"] for a in t["Attributes"]]).write.mode("overwrite").parquet(f"{root}/{t['Schema Name']}")


def chunk_documents(docs: DataFrame, chunks) -> DataFrame:
    """Rows of (doc_id, doc_text, ...) per chunk of the array column ``chunks``: id ``parent-i``."""
    return docs.select(F.col("doc_id").alias("parent_doc_id"), F.posexplode(chunks).alias("chunk_index", "doc_text")).select(
        F.concat_ws("-", F.col("parent_doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("doc_id"), "doc_text", "parent_doc_id", "chunk_index", F.lit(True).alias("is_chunked")
    )


def truth_of_chunks(chunks: DataFrame, truth: DataFrame) -> DataFrame:
    """Every chunk has all cells of its document."""
    return chunks.select("doc_id", "parent_doc_id").join(truth.withColumnRenamed("doc_id", "parent_doc_id"), "parent_doc_id")


def filter_artifact(docs: DataFrame, excluded: DataFrame, query_id: str, path: str, key: str = "doc_id") -> None:
    marked = docs.select(key).join(excluded.select(key).distinct().withColumn("excluded", F.lit(True)), key, "left")
    marked.select(F.lit(query_id).alias("query_id"), key, F.coalesce("excluded", F.lit(False)).alias("excluded")).write.mode("overwrite").parquet(path)


def cache_through(spark: SparkSession, path: str, docs: DataFrame, compute, key: str = "doc_id") -> DataFrame:
    """Cached rows, and those of documents not yet cached, computed and appended."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    missing = pending(docs, spark.read.parquet(path), key) if target.getFileSystem(conf).exists(target) else docs
    compute(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(docs.select(key).distinct(), key, "left_semi")


def embedding_cache_through(spark: SparkSession, path: str, docs: DataFrame, compute, model: str, provider: str = "local") -> DataFrame:
    """(doc_id, embedding) of all documents: cached under (doc_id, model, provider), or computed from (doc_id, doc_text) and appended."""
    here = f"{path}/provider={provider}/model={model.replace('/', '_')}"

    def rows(missing: DataFrame) -> DataFrame:
        return missing.select("doc_id", compute(F.col("doc_text")).cast("array<float>").alias("embedding"))

    return cache_through(spark, here, docs, rows)


def saved_in_steps(docs: DataFrame, process, path: str, step: int, order: str = "doc_pos", key: str = "doc_id") -> int:
    """Process documents that ``path`` has no result of, ``step`` at a time in order, each step appended when it is done; the number of steps.

    A run that stops goes on where it was.
    """
    spark = docs.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    left = pending(docs, spark.read.parquet(path), key) if target.getFileSystem(conf).exists(target) else docs
    batches = written(batched(left, step, order, key).select(F.col("at.k").alias(key), "batch"), "steps")
    n = (batches.agg(F.max("batch")).first()[0] if not batches.isEmpty() else -1) + 1
    for i in range(n):
        process(left.join(batches.where(F.col("batch") == i).select(key), key, "left_semi")).write.mode("append").parquet(path)
    return n


def save_index(vectors: DataFrame, path: str, model: str, metadata: dict | None = None) -> None:
    """A retrieval index: (id, embedding) as Parquet, with the model and notes beside it."""
    vectors.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(f"{path}/vectors")
    note = json.dumps({"model": model, "metadata": metadata or {}}, sort_keys=True)
    vectors.sparkSession.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(vectors, what is noted about them)."""
    return spark.read.parquet(f"{path}/vectors"), json.loads(spark.read.text(f"{path}/about").first()["value"])  # one line


def write_chunked_dataset(documents: DataFrame, truth: DataFrame, chunks, root: str, name: str, metadata: dict | None = None, overwrite: bool = False) -> None:
    """A dataset of chunks: documents, ground truth repeated on every chunk, and a manifest."""
    mode = "overwrite" if overwrite else "errorifexists"
    cut = chunk_documents(documents, chunks)
    cut.withColumn("dataset_id", F.lit(name)).write.mode(mode).parquet(f"{root}/documents.parquet")
    spark = documents.sparkSession
    truth_of_chunks(spark.read.parquet(f"{root}/documents.parquet"), truth).write.mode(mode).parquet(f"{root}/ground_truth.parquet")
    note = json.dumps({"dataset_id": name, "documents": "documents.parquet", "ground_truth": "ground_truth.parquet", **(metadata or {})}, sort_keys=True)
    spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode(mode).text(f"{root}/manifest")


def append_usage(rows: DataFrame, path: str) -> None:
    """Usage rows as JSON lines, a row for each call."""
    rows.write.mode("append").json(path)


def usage_summary(log: DataFrame) -> DataFrame:
    """Calls and tokens per query and stage of a usage log (JSON lines)."""
    return log.groupBy(F.coalesce("context.query_id", F.lit("unattributed")).alias("query_id"), F.col("context.stage").alias("stage")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("usage.prompt_tokens").alias("prompt_tokens"), F.sum("usage.completion_tokens").alias("completion_tokens"),
        F.sum("usage.total_tokens").alias("total_tokens"), F.count_if(F.col("usage.total_tokens").isNull()).alias("without_tokens"),
    )


def write_report(conflicts: DataFrame, root: str) -> None:
    conflicts.write.mode("overwrite").json(f"{root}/json")
    conflicts.write.mode("overwrite").option("header", True).csv(f"{root}/csv")
    markdown(conflicts).write.mode("overwrite").text(f"{root}/markdown")


def markdown(rows: DataFrame) -> DataFrame:
    """(value): a Markdown table, a line for each row; bars and line ends in cells are escaped. The heading is the first line of one file."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"\|", r"\\|"), r"[\r\n]+", " ")
    heading = [f"| {' | '.join(rows.columns)} |", f"|{'---|' * len(rows.columns)}"]
    head = rows.sparkSession.createDataFrame([("\n".join(heading),)], "value string").coalesce(1)
    return head.unionByName(rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[plain(c) for c in rows.columns]), F.lit(" |")).alias("value")))
