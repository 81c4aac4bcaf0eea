"""Requests in, answers and their scores out: the engine's public interface.

``extract`` runs a query's plan over documents: filter documents, assign them to tables, reject by
proxies and join keys what the query cannot need, extract the rest table by table, merge the
records of chunks, reduce them by predicates and keys, answer the SQL. The extractor is a function
of one's own (documents, schema) -> records; ``ground_truth_extractor`` copies the truth.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenar.operators import adaptive, metrics, relational
from lumenar.operators.filters import DocumentFilter, NoFilter
from lumenar.plans import answers
from lumenar.plans.runtime import Extractor, RuntimeOptions, TableRun, assigned_tables, keeps_all_answers, merged_chunk_records, reduced, run_tables
from lumenar.plans.sqlx import Analysis, analyse
from lumenar.sources.datasets import Dataset, attribute_names, create_loader, project_schema, records_of, split_ids

__all__ = ["Extractor", "RuntimeOptions", "keeps_all_answers", "reduced"]

log = logging.getLogger(__name__)

PROVIDERS: dict[str, Callable[..., Any]] = {}
_listeners: list[Callable[[dict], None]] = []


def register_provider(name: str, make: Callable[..., Any], aliases: tuple[str, ...] = ()) -> None:
    """A model or embedding provider of one's own, by name and aliases."""
    for n in (name, *aliases):
        PROVIDERS[n.lower()] = make


def provider(model: str, **options: Any) -> Any:
    """The provider whose name, or the prefix of ``name/model``, is the model's; unknown ones raise ValueError."""
    key = model.lower() if model.lower() in PROVIDERS else model.split("/", 1)[0].lower()
    if key not in PROVIDERS:
        raise ValueError(f"no provider for {model!r}; known: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[key](model=model, **options)


def on_progress(listener: Callable[[dict], None]) -> Callable[[], None]:
    """Register a listener of progress events; the returned function removes it."""
    _listeners.append(listener)
    return lambda: _listeners.remove(listener)


def emit(stage: str, **detail: Any) -> None:
    for listener in list(_listeners):
        listener({"stage": stage, **detail})


@dataclass
class StaticSQL:
    """A text-to-SQL adapter that always answers the same query; others have the same ``sql_for``."""

    sql: str

    def sql_for(self, question: str, schema: list[dict]) -> str:
        return self.sql


@dataclass
class Config:
    """A run's settings. Unknown keys, versions and query ids are errors."""

    version: int = 1
    loader: str = "hf_manifest"
    root: str = ""
    query_ids: list[str] = field(default_factory=list)
    stages: list[str] = field(default_factory=lambda: ["extract", "evaluate"])
    target_recall: float = 0.95
    proxies: str = "none"
    vector: str = ""
    training_documents: int = 0
    cache: str = ""
    merge: str = "first_non_null"
    output: str = ""

    STAGES = ("preprocess", "refine", "extract", "evaluate")

    @classmethod
    def of(cls, raw: dict[str, Any]) -> Config:
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(raw) - known):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        out = cls(**raw)
        if out.version != 1:
            raise ValueError(f"unknown version {out.version}")
        if wrong := [s for s in out.stages if s not in cls.STAGES]:
            raise ValueError(f"unknown stages: {', '.join(wrong)}")
        if not 0 < out.target_recall <= 1:
            raise ValueError("target_recall is over 0 and at most 1")
        if out.training_documents < 0:
            raise ValueError("the number of training documents is not negative")
        RuntimeOptions(proxies=out.proxies)
        if out.merge not in relational.MERGES:
            raise ValueError(f"unknown merge {out.merge!r}")
        create_loader(out.loader)
        return out


def select_queries(data: Dataset, query_ids: list[str] | None = None, experiment_ids: list[str] | None = None, one: str | None = None) -> list[dict]:
    """The experiment's ids, else the listed ones, else the one, else all; unknown ids are left out with a warning."""
    wanted = experiment_ids or query_ids or ([one] if one else None)
    if not wanted:
        return list(data.queries)
    by_id = {q["query_id"]: q for q in data.queries}
    for q in wanted:
        if q not in by_id:
            log.warning("unknown query %s", q)
    return [by_id[q] for q in wanted if q in by_id]


def columns_by_table(schema: list[dict]) -> dict[str, list[str]]:
    return {t["Schema Name"]: [a["Attribute Name"] for a in t["Attributes"]] for t in schema}


def required_by_table(data: Dataset, query: dict[str, Any], plan: Analysis) -> dict[str, list[str]]:
    """Columns that the query's declaration, predicates and joins need, of each of its tables."""
    everything = columns_by_table(data.schema)
    need = columns_by_table(project_schema(data.schema, query))
    for t in plan.tables:
        need.setdefault(t, everything.get(t, []))
    for t, ps in plan.safe.items():
        need[t] = list(dict.fromkeys([*need.get(t, []), *(p.attribute for p in ps)]))
    for j in plan.joins:
        for t, c in (j.parent, j.child):
            need[t] = list(dict.fromkeys([*need.get(t, []), c]))
    return need


def ground_truth_extractor(data: Dataset) -> Extractor:
    """Records copied from the ground truth of the documents asked for."""

    def run(docs: DataFrame, schema: list[dict]) -> DataFrame:
        wanted = [t["Schema Name"] for t in schema]
        own = data.ground_truth.where(F.col("table_id").isin(wanted)).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        return records_of(own)

    return run


@dataclass
class Extraction:
    query_id: str
    records: DataFrame
    required: dict[str, list[str]]
    sql: str
    runs: list[TableRun] = field(default_factory=list)
    types: answers.Types = field(default_factory=dict)

    def answer(self) -> DataFrame | None:
        return answers.answer(self.records, self.sql, self.required, self.types) if self.sql else None


_OUTER = {"LEFT", "RIGHT", "FULL"}


def extract(
    data: Dataset, query: dict[str, Any], extractor: Extractor | None = None, document_filter: DocumentFilter | None = None, adapter: StaticSQL | None = None,
    options: RuntimeOptions | None = None, merge: str = "first_non_null", assigner: Callable[[DataFrame], DataFrame] | None = None,
) -> Extraction:
    """One query over a dataset's documents; the query's own SQL, or the adapter's for its question.

    Documents belong to tables by their metadata, else by the ground truth, else as ``assigner`` tells;
    without any of these, every document may belong to every table.
    """
    sql = query["sql"] or (adapter.sql_for(query["question"], data.schema) if adapter else "")
    plan = analyse(sql, columns_by_table(data.schema)) if sql else Analysis()
    need = required_by_table(data, query, plan)
    options = options or RuntimeOptions()
    emit("extract", query_id=query["query_id"], tables=list(need))
    whole = data.documents_with_provenance
    docs = (document_filter or NoFilter()).kept(query["query_id"], whole if document_filter else data.documents)
    schema = [{**t, "Attributes": [a for a in t["Attributes"] if a["Attribute Name"] in need[t["Schema Name"]]]} for t in data.schema if t["Schema Name"] in need]
    words = {t.word for t in answers.tokens(sql)} if sql else set()
    # a table that is referenced twice, an outer join or a set operation needs rows that a reduction would drop
    inner = not (words & _OUTER) and not plan.set_operation and len(set(plan.tables)) == len(plan.tables) and "SELECT" not in _after_first(sql)
    tables = [t["Schema Name"] for t in schema]
    provenance = whole.join(docs.select("doc_id"), "doc_id", "left_semi")
    known = {"schema_tables", "schema_table", "table_id", "source_table"} & set(whole.columns)
    has_truth = not data.ground_truth.isEmpty()
    if known or has_truth or assigner:
        assigned = assigned_tables(provenance, tables, truth=data.ground_truth if has_truth else None, assigner=assigner)
    else:
        assigned = docs.select("doc_id", F.explode(F.array(*[F.lit(t) for t in tables])).alias("table_id")) if tables else docs.select("doc_id", F.lit(None).cast("string").alias("table_id"))
    if options.vector and options.vector not in docs.columns:
        docs = docs.join(whole.select("doc_id", options.vector), "doc_id")
    safe = plan if sql and inner else Analysis()
    truth = records_of(data.ground_truth) if has_truth else None
    runs = run_tables(docs, assigned, schema, safe, extractor or ground_truth_extractor(data), options, truth, inner)
    records = reduce(DataFrame.unionByName, [r.records for r in runs]) if runs else data.records().where("false")
    records = merged_chunk_records(records, provenance, merge)
    records = reduced(records, plan, need) if sql and inner else records.where(F.col("table_id").isin(list(need)))
    return Extraction(query["query_id"], records, need, sql, runs, answers.declared_types(data.schema))


def _after_first(sql: str) -> list[str]:
    return [t.word for t in answers.tokens(sql)][1:] if sql else []


def evaluate(data: Dataset, done: Extraction, merge: str = "first_non_null") -> dict[str, float]:
    """Recall and precision of the answer as a multiset; without SQL both are 1."""
    if not done.sql:
        return {"query_id": done.query_id, "recall": 1.0, "precision": 1.0, "truth_rows": 0, "predicted_rows": 0}
    truth = answers.answer(merged_chunk_records(records_of(data.ground_truth), data.documents_with_provenance, merge), done.sql, done.required, done.types)
    row = metrics.answer_bags(truth, done.answer()).first().asDict()
    emit("evaluate", query_id=done.query_id, **row)
    return {"query_id": done.query_id, **{k: row[k] for k in ("recall", "precision", "truth_rows", "predicted_rows")}}


def run_request(spark: SparkSession, documents: Any, schema: Any, queries: Any, extractor: Extractor, **options: Any) -> dict[str, Extraction]:
    """An in-memory request: an extraction for each of its queries."""
    data = create_loader("memory")(spark, documents, schema, queries, **options)
    return {q["query_id"]: extract(data, q, extractor) for q in data.queries}


def run(spark: SparkSession, config: Config, extractor: Extractor | None = None, processor: Callable[[DataFrame], DataFrame] | None = None) -> list[dict[str, float]]:
    """The configured stages over the configured dataset, each writing under ``output``.

    ``preprocess`` discovers the general schema with ``processor`` (documents -> cells of tables and
    columns), ``refine`` fits a schema to each query, ``extract`` writes records, ``evaluate`` scores
    them. The first two need a processor; by default it reads the ground truth.
    """
    data = create_loader(config.loader)(spark, config.root)
    process = processor or truth_processor(data)
    general: adaptive.Schema = {}
    reports: list[dict[str, float]] = []
    if "preprocess" in config.stages:
        general = preprocess(data, process)
        write_json(spark, general, f"{config.output}/schema_general") if config.output else None
    training = split_ids(data.documents, config.training_documents, "prefix", pos_col="doc_pos").where("split = 'train'").select("doc_id") if config.training_documents else None
    options = RuntimeOptions(target_recall=config.target_recall, proxies=config.proxies, vector=config.vector or None, training=training, cache=config.cache or None, namespace=config.root)
    for q in select_queries(data, config.query_ids):
        if "refine" in config.stages:
            schema = refine(data, q, process, general or columns_by_table(data.schema))
            write_json(spark, schema, f"{config.output}/{q['query_id']}/schema") if config.output else None
            reports += [] if "extract" in config.stages or "evaluate" in config.stages else [{"query_id": q["query_id"], "tables": len(schema)}]
        if not {"extract", "evaluate"} & set(config.stages):
            continue
        done = extract(data, q, extractor, options=options, merge=config.merge)
        if "extract" in config.stages and config.output:
            done.records.write.mode("overwrite").parquet(f"{config.output}/{q['query_id']}/records")
        if "evaluate" in config.stages:
            reports.append(evaluate(data, done, config.merge))
    return reports


def truth_processor(data: Dataset) -> Callable[[DataFrame], DataFrame]:
    """documents -> (doc_id, table_id, column_name) of their ground truth."""
    return lambda docs: data.ground_truth.join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", "table_id", "column_name")


def preprocess(data: Dataset, process: Callable[[DataFrame], DataFrame], rule: adaptive.EntropyRule | None = None) -> adaptive.Schema:
    """The general schema of the documents, read in batches until it holds still."""
    return adaptive.discover(data.documents, process, rule).schema


def refine(data: Dataset, query: dict[str, Any], process: Callable[[DataFrame], DataFrame], general: adaptive.Schema, document_filter: DocumentFilter | None = None, rule: adaptive.EntropyRule | None = None) -> adaptive.Schema:
    """The general schema cut to one query: documents that the filter keeps are read in order, and what they show of the query's tables and columns stays."""
    need = columns_by_table(project_schema(data.schema, query))
    docs = renumbered((document_filter or NoFilter()).kept(query["query_id"], data.documents))

    def wanted(schema: adaptive.Schema, batch: DataFrame) -> adaptive.Schema:
        seen = adaptive.schema_of(process(batch))
        fits = {t: [a for a in attributes if a in need.get(t, [])] for t, attributes in seen.items() if t in need}
        return adaptive.folded(schema, {t: a for t, a in fits.items() if t in general})

    return adaptive.tailored(docs.withColumn("_order", -F.col("doc_pos")), {}, wanted, "_order", rule).schema


def renumbered(docs: DataFrame) -> DataFrame:
    """Kept documents with positions from 0, in the order of the old ones: counted by ranges, so no task sees them all."""
    old = docs.withColumnRenamed("doc_pos", "_old")
    places = adaptive.batched(old, 1, "_old").select(F.col("at.k").alias("doc_id"), F.col("batch").cast("long").alias("doc_pos"))
    return old.drop("_old").join(places, "doc_id")


def write_json(spark: SparkSession, value: object, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def output_columns(query: dict[str, Any]) -> list[str]:
    return attribute_names(query["output_columns"])


def load_config(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return Config.of(json.load(f))
