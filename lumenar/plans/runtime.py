"""Reduction before extraction: which documents of each table an extractor has to read for a query.

Tables are processed one after the other, that with most safe predicates first and then those that join what
was read, so that a rejection reaches every table after it. Of a table's
documents a cascade of proxies rejects those that cannot satisfy its predicates; what is known of
the keys of tables already read rejects those that no join would meet (only the key attribute is
extracted for that); the rest is extracted, or taken from a cache that queries share. A table of
which nothing survives spares all that joins connect it with. Every step is a DataFrame over document ids; the
driver loops over tables and predicates only.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenar.functions import values as V
from lumenar.operators import cascade, proxies, relational
from lumenar.operators.cascade import Proxy
from lumenar.operators.predicates import all_of
from lumenar.plans.sqlx import Analysis, Predicate, joined_order, joined_tables, table_order
from lumenar.storage import written

Extractor = Callable[[DataFrame, list[dict]], DataFrame]
RECORDS = "doc_id string, table_id string, record_id string, data map<string,string>"
PROXIES = ("none", "heuristic", "learned", "oracle", "auto")


@dataclass(frozen=True)
class RuntimeOptions:
    """What may be rejected before extraction, and how surely.

    proxies: ``heuristic`` looks for evidence in the text, ``learned`` fits document vectors to the
    training documents' ground truth, ``auto`` learns where it can and looks for evidence
    elsewhere, ``oracle`` knows the ground truth (an upper bound), ``none`` rejects nothing. A
    target recall of 1 or more rejects nothing by proxies either.
    """

    target_recall: float = 0.95
    proxies: str = "none"
    join_resolution: bool = True
    both_ways: bool = True
    selective_first: bool = True
    text: str = "doc_text"
    vector: str | None = None
    training: DataFrame | None = None  # (doc_id)
    cache: str | None = None
    namespace: str = "default"

    def __post_init__(self) -> None:
        if self.proxies not in PROXIES:
            raise ValueError(f"unknown proxies {self.proxies!r}; known: {', '.join(PROXIES)}")


@dataclass
class TableRun:
    """What one table took: its documents, those that were read or reused, how they were chosen, and their records."""

    table: str
    assigned: DataFrame
    read: DataFrame
    reused: DataFrame
    how: str
    records: DataFrame
    statistics: DataFrame | None = None


def cell(column: str) -> Column:
    """The cell as the relational tables hold it."""
    return V.sql_value(F.try_element_at("data", F.lit(column)))


def join_key(column: str) -> Column:
    """Equal for all cells that the tables' columns would join."""
    return V.let(cell(column), lambda text: F.coalesce(V.join_value(text), text))


_LOOKS_NUMERIC = re.compile(r"\s*[+-]?(\d|\.\d)")


def keeps_all_answers(p: Predicate) -> bool:
    """Whether the predicate's cell test, which disregards case and types, passes every row that SQL's passes."""
    numeric = p.is_numeric
    if p.operator in ("<", ">", "<=", ">="):
        return numeric
    if p.operator == "BETWEEN":
        return all(isinstance(v, (int, float)) for v in p.value)
    if p.operator in ("=", "IN", "LIKE"):
        texts = p.value if p.operator == "IN" else [p.value]
        return (numeric and p.operator == "=") or all(isinstance(v, str) and not _LOOKS_NUMERIC.match(v.lstrip("%_")) for v in texts)
    return p.operator == "IS NOT NULL"


def satisfying(records: DataFrame, predicates: list[Predicate]) -> DataFrame:
    return records.where(all_of(predicates, {p.attribute: cell(p.attribute) for p in predicates})) if predicates else records


def reduced(records: DataFrame, plan: Analysis, need: dict[str, list[str]]) -> DataFrame:
    """Records after safe predicates and semi-joins along the whole join graph, up and down again."""
    rows = {t: records.where(F.col("table_id") == t) for t in need}
    for t, ps in plan.safe.items():
        rows[t] = satisfying(rows[t], [p for p in ps if keeps_all_answers(p)])
    rows = relational.fully_reduced(rows, [(j.parent, j.child) for j in plan.joins], lambda column: V.membership_key(join_key(column)))
    return reduce(DataFrame.unionByName, rows.values())


# --- which table a document belongs to -----------------------------------------------


def assigned_tables(docs: DataFrame, tables: list[str], cached: DataFrame | None = None, truth: DataFrame | None = None, assigner: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, table_id): from the cache, else the document's metadata, else the ground truth, else ``assigner``.

    Metadata are the first of ``schema_tables`` that is asked for, ``schema_table``, ``table_id`` or
    ``source_table``. A document known to belong to other tables belongs to none here, and is not
    asked about again.
    """
    allowed = F.array(*[F.lit(t) for t in tables]).cast("array<string>")
    told = [F.col(c) for c in ("schema_table", "table_id", "source_table") if c in docs.columns]
    if "schema_tables" in docs.columns:
        told.insert(0, F.coalesce(F.try_element_at(F.array_intersect("schema_tables", allowed), F.lit(1)), F.try_element_at("schema_tables", F.lit(1))))
    known = docs.select("doc_id", (F.coalesce(*told) if told else F.lit(None).cast("string")).alias("_told"))
    if cached is not None:
        known = known.join(cached.groupBy("doc_id").agg(F.min("table_id").alias("_cached")), "doc_id", "left").select("doc_id", F.coalesce("_cached", "_told").alias("_told"))
    out = known.where("_told is not null").select("doc_id", F.col("_told").alias("table_id"))
    open_docs = known.where("_told is null").select("doc_id")
    if truth is not None:
        of_truth = truth.select("doc_id", "table_id").distinct()
        out = out.unionByName(open_docs.join(of_truth, "doc_id"))
        open_docs = open_docs.join(of_truth, "doc_id", "left_anti")
    if assigner is not None:
        out = out.unionByName(assigner(docs.join(open_docs, "doc_id", "left_semi")).select("doc_id", "table_id"))
    return out.where(F.array_contains(allowed, F.col("table_id")))


def first_truth_table(truth: DataFrame, tables: list[str], pos: str) -> DataFrame:
    """(doc_id, table_id): of a document's ground truth tables among ``tables`` the first by ``pos``."""
    return truth.where(F.col("table_id").isin(tables)).groupBy("doc_id").agg(F.min_by("table_id", pos).alias("table_id"))


def training_documents(assigned: DataFrame, truth: DataFrame, training: DataFrame, table: str) -> DataFrame:
    """(doc_id) of the training documents of a table: as assigned, else as the ground truth tells."""
    ids = training.select("doc_id").distinct()
    known = ids.join(assigned.select("doc_id").distinct(), "doc_id", "left_semi")
    mine = known.join(assigned.where(F.col("table_id") == table).select("doc_id").distinct(), "doc_id", "left_semi")
    rest = ids.join(known, "doc_id", "left_anti")
    return mine.unionByName(rest.join(truth.where(F.col("table_id") == table).select("doc_id").distinct(), "doc_id", "left_semi"))


def relevant_training(truth: DataFrame, training: DataFrame, tables: list[str]) -> DataFrame:
    """(doc_id) of training documents with ground truth in the query's tables, whatever the case of their names."""
    wanted = [t.lower() for t in tables]
    return training.select("doc_id").distinct().join(truth.where(F.lower("table_id").isin(wanted)).select("doc_id").distinct(), "doc_id", "left_semi")


def calibration_context(docs: DataFrame, records: DataFrame, ids: DataFrame, table: str, predicates: list[Predicate]) -> DataFrame:
    """The documents of ``ids`` with ``relevant``: 1 where a ground truth record of the table satisfies all predicates."""
    hits = satisfying(records.where(F.col("table_id") == table), predicates).select("doc_id").distinct().withColumn("relevant", F.lit(1))
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").join(hits, "doc_id", "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))


# --- proxies of one table --------------------------------------------------------------


def predicate_proxies(docs: DataFrame, predicates: list[Predicate], options: RuntimeOptions, calibration: DataFrame | None) -> tuple[DataFrame, DataFrame | None, list[Proxy], tuple[str, ...]]:
    """(documents and calibration rows with the learned scores, proxies, names of the learned ones), one proxy for each predicate."""
    made, learned = [], []
    for i, p in enumerate(predicates):
        name = proxies.guard_key(p)
        if options.proxies in ("learned", "auto") and options.vector and calibration is not None:
            train = calibration.where(F.col(options.vector).isNotNull())
            both = proxies.learned_scores(docs, train, options.vector, "relevant", out=f"_score{i}")
            if both is not None:
                docs, calibration = both, proxies.learned_scores(calibration, train, options.vector, "relevant", out=f"_score{i}")
                made.append(Proxy(f"learned_{name}", F.col(f"_score{i}")))
                learned.append(f"learned_{name}")
                continue
        if options.proxies in ("heuristic", "auto"):
            made.append(proxies.HeuristicProxy(p, options.text).proxy())
        elif options.proxies == "learned":
            raise ValueError("learned proxies need document vectors and training documents of both kinds")
    return docs, calibration, made, tuple(learned)


def through_proxies(docs: DataFrame, predicates: list[Predicate], options: RuntimeOptions, calibration: DataFrame | None = None) -> tuple[DataFrame, str, DataFrame | None]:
    """(documents that pass, how they were chosen, statistics of the cascade)."""
    if not predicates or options.target_recall >= 1 or options.proxies in ("none", "oracle"):
        return docs, "all", None
    columns = docs.columns
    scored, calibration, made, learned = predicate_proxies(docs, predicates, options, calibration)
    if calibration is not None:
        made = proxies.recalibrated(made, calibration.where("relevant = 1"), options.target_recall, tuple(p.name for p in made if p.name not in learned))
    made = proxies.observed_pass_rates(scored, made)
    kept, how = proxies.survivors_or_fallback(scored, made, options.target_recall, learned)
    done = cascade.run(scored, made, options.target_recall)
    return kept.select(*columns), how, cascade.statistics(done, made, F.lit(False)).select("position", "proxy", "evaluated", "passed", "rejected", "avg_score", "rejection_rate")


def execution_ratios(evaluated: int, passed: int, relevant: int, cost_of_proxies: float = 0.0, cost_of_reading: float = 1.0) -> dict[str, float]:
    """Rejection rate, precision of what is read, and the share of the cost that was saved."""
    whole = evaluated * cost_of_reading
    spent = evaluated * cost_of_proxies + passed * cost_of_reading
    return {
        "rejection_rate": 1 - passed / evaluated if evaluated else 0.0,
        "oracle_precision": relevant / passed if passed else 0.0,
        "cost_savings": max(0.0, 1 - spent / whole) if whole else 0.0,
    }


def joined_documents(docs: DataFrame, table: dict, attribute: str, keys: DataFrame, extractor: Extractor) -> DataFrame:
    """Documents of which a record's join attribute is among ``keys``; nothing but that attribute is extracted."""
    only = [{**table, "Attributes": [a for a in table["Attributes"] if a["Attribute Name"] == attribute] or [{"Attribute Name": attribute}]}]
    found = extractor(docs, only).where(F.col("table_id") == table["Schema Name"]).withColumn("_k", join_key(attribute))
    return docs.join(relational.reduce_by_keys(found, "_k", keys).select("doc_id"), "doc_id", "left_semi")


# --- extraction ------------------------------------------------------------------------


def merged_extraction(records: DataFrame, extracted: DataFrame) -> DataFrame:
    """records with what was extracted for their document and table; a document with several records of the table keeps them as they are.

    Both: doc_id, table_id, record_id, data. Extracted attributes that begin with two underscores are
    notes, not cells. Documents without a record of the table get the extracted one.
    """
    keys = ["doc_id", "table_id"]
    cells = extracted.select(*keys, "record_id", F.map_filter("data", lambda k, _: ~k.startswith("__")).alias("data")).where(F.size("data") > 0)
    both = records.select(*keys, "record_id", "data", F.lit(False).alias("_got")).unionByName(cells.withColumn("_got", F.lit(True)))
    # one shuffle and one sort: aggregates by document before it would hold every document of a task
    mine, got = Window.partitionBy(*keys), F.col("_got")
    known = F.count_if(~got).over(mine)
    new = F.min_by(F.when(got, F.struct("record_id", "data")), F.when(got, F.struct("record_id"))).over(mine)
    place = F.row_number().over(mine.orderBy("_got", "record_id"))
    rows = both.select("*", known.alias("_n"), new.alias("_new"), place.alias("_place")).where(~got | ((F.col("_n") == 0) & (F.col("_place") == 1)))
    told = F.col("_new")["data"]
    kept = F.map_filter("data", lambda k, _: ~F.array_contains(F.map_keys(told), k))
    data = F.when(got, told).when((F.col("_n") == 1) & F.col("_new").isNotNull(), F.map_concat(kept, told)).otherwise(F.col("data"))
    return rows.select(*keys, F.when(got, F.col("_new")["record_id"]).otherwise(F.col("record_id")).alias("record_id"), data.alias("data"))


def filled_attributes(records: DataFrame, docs: DataFrame, table: dict, extractor: Extractor) -> DataFrame:
    """The table's records with attributes that lacked a value extracted from their documents; nothing else is read again."""
    names = [a["Attribute Name"] for a in table["Attributes"]]
    mine = records.where(F.col("table_id") == table["Schema Name"])
    lacking = F.exists(F.array(*[F.lit(n) for n in names]), lambda n: V.is_none_value(F.try_element_at(F.col("data"), n)))
    got = extractor(docs.join(mine.where(lacking).select("doc_id").distinct(), "doc_id", "left_semi"), [table])
    got = got.where(F.col("table_id") == table["Schema Name"]).groupBy("doc_id", "table_id").agg(F.min_by("data", "record_id").alias("_got"))
    known = F.map_filter("data", lambda _, v: ~V.is_none_value(v))
    rest = F.map_filter(F.coalesce("_got", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(known), k))
    return mine.join(got, ["doc_id", "table_id"], "left").select("doc_id", "table_id", "record_id", F.map_concat(known, rest).alias("data"))


CACHE = "namespace string, table_id string, generation string, attributes array<string>, doc_id string, record_id string, data map<string,string>"


def extracted_through_cache(docs: DataFrame, table: dict, extractor: Extractor, path: str, namespace: str = "default") -> tuple[DataFrame, DataFrame]:
    """(records of all documents, ids of those that were taken from the cache).

    A cached document counts if all the attributes asked for were extracted then; a document without
    records is remembered as such. Others are extracted and appended.
    """
    spark, name = docs.sparkSession, table["Schema Name"]
    names = sorted(a["Attribute Name"] for a in table["Attributes"])
    cached = read_cache(spark, path).where((F.col("namespace") == namespace) & (F.col("table_id") == name))
    covering = cached.where(F.forall(F.array(*[F.lit(n) for n in names]).cast("array<string>"), lambda n: F.array_contains("attributes", n)))
    latest = covering.groupBy("doc_id").agg(F.max("generation").alias("generation")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    hits = written(covering.join(latest, ["doc_id", "generation"]).select("doc_id", "table_id", "record_id", "data"), "cache-hits")
    missing = docs.join(hits.select("doc_id").distinct(), "doc_id", "left_anti")
    got = extractor(missing, [table]).where(F.col("table_id") == name).select("doc_id", "record_id", "data")
    rows = missing.select("doc_id").distinct().join(got, "doc_id", "left")
    generation = uuid.uuid1().hex
    told = [F.lit(namespace).alias("namespace"), F.lit(name).alias("table_id"), F.lit(generation).alias("generation"), F.array(*[F.lit(n) for n in names]).cast("array<string>").alias("attributes")]
    rows.select(*told, "doc_id", "record_id", "data").write.mode("append").parquet(path)
    fresh = read_cache(spark, path).where(F.col("generation") == generation).select("doc_id", "table_id", "record_id", "data")
    both = hits.unionByName(fresh).where("record_id is not null")
    return both.withColumn("data", F.map_filter("data", lambda k, _: k.isin(*names))), hits.select("doc_id").distinct()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(CACHE).parquet(path) if target.getFileSystem(conf).exists(target) else spark.createDataFrame([], CACHE)


def materialised(docs: DataFrame, schema: list[dict], extractor: Extractor, path: str, fingerprint: str) -> DataFrame:
    """The records of all documents and tables, whatever is asked, written once under ``path`` for a fingerprint of the data and read after that."""
    spark = docs.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = f"{path}/{fingerprint}"
    done = jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        extractor(docs, schema).select("doc_id", "table_id", "record_id", "data").write.mode("overwrite").parquet(target)
    return spark.read.schema(RECORDS).parquet(target)


def materialised_extractor(records: DataFrame) -> Extractor:
    """An extractor that reads precomputed records."""

    def run(docs: DataFrame, schema: list[dict]) -> DataFrame:
        wanted = [t["Schema Name"] for t in schema]
        return records.where(F.col("table_id").isin(wanted)).join(docs.select("doc_id"), "doc_id", "left_semi")  # not made distinct: a semi-join needs no copy of the ids in memory

    return run


def merged_chunk_records(records: DataFrame, docs: DataFrame, how: str) -> DataFrame:
    """Records of chunks merged into records of their parent documents, value by value in order of the chunks; others stay."""
    if not {"parent_doc_id", "chunk_index"} <= set(docs.columns):
        return records
    chunks = docs.where(F.col("parent_doc_id").isNotNull()).select("doc_id", "parent_doc_id", F.coalesce(F.col("chunk_index").cast("long"), F.lit(0).cast("long")).alias("chunk_index"))
    own = records.join(chunks.select("doc_id"), "doc_id", "left_anti").select("doc_id", "table_id", "record_id", "data")
    cells = records.join(chunks, "doc_id").select("parent_doc_id", "table_id", F.col("record_id").alias("record_key"), "chunk_index", F.explode("data").alias("column_name", "value"))
    values = relational.merge_chunks(cells, how)
    listed = F.map_from_entries(F.sort_array(F.collect_list(F.struct("column_name", "value"))))  # a record's columns
    merged = values.groupBy("parent_doc_id", "table_id", "record_key").agg(listed.alias("data"))
    return own.unionByName(merged.select(F.col("parent_doc_id").cast("string").alias("doc_id"), "table_id", F.col("record_key").alias("record_id"), "data"))


def run_tables(docs: DataFrame, assigned: DataFrame, schema: list[dict], plan: Analysis, extractor: Extractor, options: RuntimeOptions, truth: DataFrame | None = None, joins_are_safe: bool = True) -> list[TableRun]:
    """One run for each table of ``schema``, in processing order. truth: ground truth records, for calibration and the oracle."""
    by_name = {t["Schema Name"]: t for t in schema}
    first = joined_order(plan) if options.selective_first and options.both_ways else table_order(plan)
    order = [t for t in first if t in by_name] + [t for t in by_name if t not in first]
    joins = [j for j in plan.joins if j.parent[0] != j.child[0]] if options.join_resolution and joins_are_safe else []
    keys: dict[tuple[str, str], DataFrame] = {}
    spared: set[str] = set()
    runs: list[TableRun] = []
    for name in order:
        own = docs.join(assigned.where(F.col("table_id") == name).select("doc_id"), "doc_id", "left_semi")
        none = own.select("doc_id").where("false")
        if name in spared:
            runs.append(TableRun(name, own.select("doc_id"), none, none, "empty join", docs.sparkSession.createDataFrame([], RECORDS)))
            continue
        predicates = [p for p in plan.safe.get(name, []) if keeps_all_answers(p)]
        calibration = None
        if truth is not None and options.training is not None and predicates:
            ids = training_documents(assigned, truth, options.training, name)
            calibration = calibration_context(docs, truth, ids, name, predicates)
        if options.proxies == "oracle" and truth is not None and predicates:
            kept, how, statistics = own.join(proxies.oracle_docs(truth, name, predicates), "doc_id", "left_semi"), "oracle", None
        else:
            kept, how, statistics = through_proxies(own, predicates, options, calibration)
        for j in joins:
            for (mine, other) in ((j.child, j.parent), (j.parent, j.child)):
                if mine[0] == name and other in keys and (options.both_ways or mine is j.child):
                    kept = joined_documents(kept, by_name[name], mine[1], keys[other], extractor)
        kept = written(kept.select("doc_id").distinct(), f"read-{len(runs)}")
        wanted = docs.join(kept, "doc_id", "left_semi")
        if options.cache:
            records, reused = extracted_through_cache(wanted, by_name[name], extractor, options.cache, options.namespace)
        else:
            records, reused = extractor(wanted, [by_name[name]]).where(F.col("table_id") == name).select("doc_id", "table_id", "record_id", "data"), none
        records = written(records, f"records-{len(runs)}")
        survivors = satisfying(records, predicates)
        for j in joins:
            for (table, column) in (j.parent, j.child):
                if table == name:
                    # written before they are made distinct: as a grouping key the expression is too long to compile
                    keys[table, column] = relational.key_values(written(survivors.select(join_key(column).alias("_k")), "join-keys"), "_k")
        if joins and options.both_ways and survivors.isEmpty():
            spared |= joined_tables(plan, name) - {name}
        runs.append(TableRun(name, own.select("doc_id"), kept.join(reused, "doc_id", "left_anti"), reused, how, records, statistics))
    return runs


def read_counts(runs: list[TableRun]) -> DataFrame:
    """table_id, assigned, read, reused: documents of each table, and how many an extractor or the cache gave."""
    parts = []
    for r in runs:
        each = [f.select(F.lit(kind).alias("kind")) for kind, f in (("assigned", r.assigned), ("read", r.read), ("reused", r.reused))]
        parts.append(reduce(DataFrame.unionByName, each).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("assigned", "read", "reused")]).select(F.lit(r.table).alias("table_id"), "assigned", "read", "reused"))
    return reduce(DataFrame.unionByName, parts)


def with_alphas(options: RuntimeOptions, plan: cascade.AlphaPlan) -> RuntimeOptions:
    """Options whose proxies give up the share of a query's predicate stage in ``plan``."""
    return replace(options, target_recall=1 - plan.alphas["predicate"])


def without_proxies(options: RuntimeOptions) -> RuntimeOptions:
    return replace(options, proxies="none")
