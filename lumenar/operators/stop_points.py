"""Where schema discovery over batches would stop, without reading batch after batch.

A schema only grows, so what a rule sees after each batch is told by the first two documents of every
feature: a feature is new in the batch of its first document, and seen once until the batch of its second.
Those places, at most two rows a feature and found with a partial top-two in each task, give the course of
entropy and missing mass; between two of them nothing changes but the number of documents read, so the
first batch that meets a rule follows from a closed form, tested exactly at its neighbours.

The number of jobs is constant. Windows without a key run over at most two rows a feature: as many as
the schema has tables and attributes, never over documents or batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenar.operators.adaptive import EntropyRule, MissingMassRule, batched
from lumenar.storage import written


def schema_features(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, feature) of cells (key, table_id, column_name): the table, the attribute, and the attribute of the table."""
    table, name = F.coalesce("table_id", F.lit("None")), F.coalesce("column_name", F.lit("None"))
    three = F.array(F.concat(F.lit("table:"), table), F.concat(table, F.lit("."), name), F.concat(F.lit("attr:"), name))
    return cells.select(key, F.explode(three).alias("feature"))


def attribute_features(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, feature): the attributes of tables alone."""
    return cells.select(key, F.concat(F.coalesce("table_id", F.lit("None")), F.lit("."), F.coalesce("column_name", F.lit("None"))).alias("feature"))


@dataclass
class Course:
    """What discovery over all batches would see: first two places of every feature, and how many documents there are."""

    places: DataFrame  # feature, nth (1 or 2), batch
    documents: int
    size: int

    @property
    def last(self) -> int:
        return -(-self.documents // self.size) - 1

    def read(self, batch: Column) -> Column:
        return F.least((batch + 1) * self.size, F.lit(self.documents))

    def firsts(self) -> DataFrame:
        return self.places.where("nth = 1").select("feature", "batch")


def course(docs: DataFrame, features: DataFrame, size: int, order: str = "doc_pos", key: str = "doc_id") -> Course:
    """The course of ``features`` (key, feature) over the documents in the order, ties by the key, ``size`` a batch."""
    placed = written(batched(docs, size, order, key), "document-batches")
    seen = features if order == key else features.join(docs.select(key, order), key)
    seen = seen.select("feature", F.struct(F.col(order).alias("o"), F.col(key).alias("k")).alias("at"))
    nth = F.dense_rank().over(Window.partitionBy("feature").orderBy("at"))
    two = seen.withColumn("nth", nth).where("nth <= 2").distinct()
    places = written(two.join(placed, "at").select("feature", "nth", "batch"), "feature-places")
    return Course(places, placed.count(), size)


def _with_next(events: DataFrame, seen: Course) -> tuple[DataFrame, Window]:
    """Events (batch, ...) with the batch after which the next one changes what is known."""
    order = Window.orderBy("batch")
    return events.withColumn("end", F.coalesce(F.lead("batch").over(order), F.lit(seen.last + 1))), order


def _first(events: DataFrame, guess: Column, met: Callable[[Column], Column], seen: Course) -> DataFrame:
    """(stop): the first batch of all stretches that meets the rule, or null. What a rule asks only grows easier along a stretch."""
    tried = F.array("batch", guess - 1, guess, guess + 1)
    inside = F.filter(tried, lambda b: (b >= F.col("batch")) & (b < F.col("end")) & (b <= seen.last) & met(b))
    return events.select(F.array_min(inside).alias("stop")).agg(F.min("stop").alias("stop"))


def entropy_stop(seen: Course, rule: EntropyRule) -> DataFrame:
    """(stop) by ``rule``, which is not changed."""
    spark = seen.places.sparkSession
    events = seen.firsts().groupBy("batch").agg(F.count(F.lit(1)).alias("fresh"))
    events = events.unionByName(spark.createDataFrame([(0, 0)], "batch long, fresh long")).groupBy("batch").agg(F.sum("fresh").alias("fresh"))
    events, order = _with_next(events, seen)
    events = events.withColumn("known", F.sum("fresh").over(order))
    none = F.col("known") == 0  # two empty schemas have entropy 1, as the first one has
    entropy = F.when((F.col("batch") == 0) | none, 1.0).otherwise(F.col("fresh") / F.col("known"))
    restless = F.when(none, 1.0).otherwise(0.0) >= rule.limit  # the batches between this event and the next
    events = events.withColumn("restless", restless).withColumn("high", F.when(entropy >= rule.limit, F.col("batch")))
    events = events.withColumn("high_end", F.when(F.col("restless") & (F.col("end") - 1 > F.col("batch")), F.col("end") - 1))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last_high = F.coalesce(F.greatest(F.max("high").over(order), F.max("high_end").over(before)), F.lit(-1))
    features = F.greatest("known", F.lit(1))
    events = events.withColumn("last_high", last_high).withColumn("features", features)
    if 0 < rule.epsilon < 1 and rule.delta > 0:
        wanted = F.ceil(F.log(rule.delta / F.col("features")) / F.log(F.lit(1 - rule.epsilon)))
    else:
        wanted = F.lit(1)
    guess = F.greatest(F.col("batch"), F.col("last_high") + rule.needed, F.ceil(F.greatest(F.lit(rule.least), wanted) / seen.size) - 1)

    def met(b: Column) -> Column:
        streak = F.when(F.col("restless") & (b > F.col("batch")), 0).otherwise(b - F.col("last_high"))
        n = seen.read(b)
        return (streak >= rule.needed) & (n >= rule.least) & (F.pow(F.lit(1 - rule.epsilon), n) * F.col("features") <= rule.delta)

    return _first(events, guess, met, seen)


def missing_mass_stop(seen: Course, rule: MissingMassRule) -> DataFrame:
    """(stop) by ``rule``, which is not changed: features in one document only, over documents read."""
    spark = seen.places.sparkSession
    events = seen.places.groupBy("batch").agg(F.sum(F.when(F.col("nth") == 1, 1).otherwise(-1)).alias("more"))
    events = events.unionByName(spark.createDataFrame([(0, 0)], "batch long, more long")).groupBy("batch").agg(F.sum("more").alias("more"))
    events, order = _with_next(events, seen)
    events = events.withColumn("once", F.sum("more").over(order))
    wanted = F.floor(F.col("once") / rule.delta) + 1 if rule.delta > 0 else F.lit(1)
    guess = F.greatest(F.col("batch"), F.ceil(F.greatest(F.lit(rule.least), wanted) / seen.size) - 1)
    return _first(events, guess, lambda b: (seen.read(b) >= rule.least) & (F.col("once") / seen.read(b) < rule.delta), seen)


def discovered(docs: DataFrame, cells: DataFrame, rule: EntropyRule | MissingMassRule, size: int = 100, order: str = "doc_pos", key: str = "doc_id") -> DataFrame:
    """(table_id, column_name, documents, batches, stopped): the attributes that discovery in batches would know when ``rule`` stops it.

    For cells that are known or cheap (ground truth, recorded answers, patterns). A model that costs by the document is
    better asked in batches (``adaptive.discover``). The same rows, without a job a batch; without documents there are none.
    """
    by_entropy = isinstance(rule, EntropyRule)
    seen = course(docs, schema_features(cells, key) if by_entropy else attribute_features(cells, key), size, order, key)
    stop = entropy_stop(seen, rule) if by_entropy else missing_mass_stop(seen, rule)
    last = F.coalesce("stop", F.lit(seen.last))
    told = stop.select(last.alias("stop"), seen.read(last).alias("documents"), (last + 1).alias("batches"), F.col("stop").isNotNull().alias("stopped"))
    # an attribute is as old as its feature; cells repeat it, so names are taken from the cells once
    names = cells.select("table_id", "column_name").distinct()
    feature = F.concat(F.coalesce("table_id", F.lit("None")), F.lit("."), F.coalesce("column_name", F.lit("None")))
    known = names.withColumn("feature", feature).join(seen.firsts(), "feature")
    return known.join(F.broadcast(told), F.col("batch") <= F.col("stop")).select("table_id", "column_name", "documents", "batches", "stopped")  # told is one row
