"""Documents that wait for their join key: reduction before extraction on streams.

Rows of the joining side arrive in any order. A row is admitted when its key has turned up among the rows that survive on
the other side, at once or whenever the key arrives later; until then it is kept in the state by its key. Keys are made
distinct in the state first, so a row is admitted exactly once, however often its key turns up and wherever a failed run
is taken up again: state and output belong to the checkpoint in the shared folder.

Without a time limit every row that still waits is kept. With one, rows and keys that are older than the watermark are
dropped from the state, so a row whose key turns up later than the limit is never admitted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenar.storage import new_path


def admitted(waiting: DataFrame, keys: DataFrame, key: str, time: str | None = None, within: str | None = None) -> DataFrame:
    """The rows of the stream ``waiting`` whose ``key`` is among those of the stream ``keys`` (key).

    With ``time``, a timestamp that both have, and ``within``, an interval, row and key are at most that far apart. Null keys wait for nothing.
    """
    columns = waiting.columns
    waiting, keys = waiting.where(F.col(key).isNotNull()), keys.where(F.col(key).isNotNull())
    if time is None:
        met = keys.select(F.col(key).alias("_key")).dropDuplicates(["_key"])
        return waiting.join(met, F.col(key) == F.col("_key")).select(*columns)
    met = keys.select(F.col(key).alias("_key"), F.col(time).alias("_time")).withWatermark("_time", within).dropDuplicatesWithinWatermark(["_key"])
    near = F.col(time).between(F.col("_time") - F.expr(f"INTERVAL {within}"), F.col("_time") + F.expr(f"INTERVAL {within}"))
    return waiting.withWatermark(time, within).join(met, (F.col(key) == F.col("_key")) & near).select(*columns)


def replay(rows: DataFrame, batches: int, name: str, by: list[str] | None = None) -> DataFrame:
    """``rows`` as a stream of about so many micro-batches; rows that agree in ``by`` arrive together."""
    path = new_path(rows.sparkSession, name)
    dealt = rows.repartition(batches, *by) if by else rows.repartition(batches)
    dealt.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def landed(stream: DataFrame, name: str) -> tuple[DataFrame, list[dict]]:
    """All that the stream gives for what has arrived, written exactly once, and the progress of its micro-batches."""
    spark = stream.sparkSession
    path, checkpoint = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
    done = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(StructType(stream.schema.fields)).parquet(path), [dict(p) for p in done.recentProgress]
