"""Fit a model on a bounded sample in one task, so the driver holds the model only."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenar.llm.memory import give_back


def one_row_an_id(rows: DataFrame, text: str) -> DataFrame:
    """Of rows that repeat a doc_id that whose text has the smallest hash, combined before the shuffle: an id may be that of a million rows."""
    least = rows.groupBy("doc_id").agg(F.min(F.xxhash64(text)).alias("_least"))
    # no more ids than the sample's bound
    return rows.join(F.broadcast(least), "doc_id").where(F.xxhash64(text) == F.col("_least")).drop("_least").dropDuplicates(["doc_id"])


def fitted(sample: DataFrame, schema: pa.Schema, fit: Callable[[pa.Table], Any]) -> Any:
    """``fit`` of the whole sample. The sample's bound is its caller's documented parameter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit(pa.Table.from_batches([b.cast(schema) for b in batches], schema))
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    rows = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(rows[0]["model"]) if rows else fit(schema.empty_table())
