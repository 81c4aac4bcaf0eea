"""Dataset sources: documents, long-form ground truth, declared schema and queries.

Ordinary reads expose text only; provenance is a separate view that a stage must ask for.
Document order matters to a few operators, so ingest adds ``doc_pos``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENTS = "dataset_id string, doc_id string, doc_text string, source_id string, source_table string, source_row_id string, parent_doc_id string, chunk_index int, is_chunked boolean, split string"
GROUND_TRUTH = "dataset_id string, doc_id string, record_id string, table_id string, column_id string, column_name string, value string, value_type string, source_row_id string"


def normalize_identifier(value: Any) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", str(value)).strip("_").lower() or "unknown"


def default_query(schema: list[dict], dataset_id: str = "default") -> dict[str, Any]:
    """No queries declared: every column of every table, no SQL."""
    tables = [t["Schema Name"] for t in schema]
    columns = [f"{t['Schema Name']}.{a['Attribute Name']}" for t in schema for a in t["Attributes"]]
    return {"query_id": "default", "question": "", "sql": "", "required_tables": tables, "required_columns": columns, "output_columns": [], "tags": [], "difficulty": None, "dataset_id": dataset_id}


def runtime_schema(raw: Any) -> list[dict[str, Any]]:
    """A contract's tables, a mapping of tables or an already flat list, as [{Schema Name, Description, Attributes}]."""
    if isinstance(raw, str):
        raw = json.loads(raw)
    if isinstance(raw, list):
        return raw
    tables = raw.get("tables", raw) if isinstance(raw, dict) else {}
    items = [(t.get("table_id") or t.get("name"), t) for t in tables] if isinstance(tables, list) else list(tables.items())
    out = []
    for name, body in items:
        columns = body.get("columns", []) if isinstance(body, dict) else body
        columns = columns if isinstance(columns, list) else [{"name": k, "description": v} for k, v in columns.items()]
        columns = [{"name": c} if isinstance(c, str) else c for c in columns]
        attributes = [{"Attribute Name": c.get("name") or c["column_id"].split(".")[-1], "Description": c.get("description", "")} | ({"Type": c["type"]} if c.get("type") not in (None, "string") else {}) for c in columns]
        out.append({"Schema Name": (body.get("name") if isinstance(body, dict) else None) or name, "Description": body.get("description", "") if isinstance(body, dict) else "", "Attributes": attributes})
    return out


def query_records(raw: Any, schema: list[dict], dataset_id: str = "default") -> list[dict[str, Any]]:
    """A list, a mapping by id, one query or JSON text, in one form; aliases of the fields are accepted."""
    raw = json.loads(raw) if isinstance(raw, str) else raw
    if isinstance(raw, dict) and "queries" in raw:
        raw = raw["queries"]
    if isinstance(raw, dict):
        raw = [raw] if "sql" in raw or "question" in raw else [{"query_id": k, **v} for k, v in raw.items()]
    out = []
    for i, q in enumerate(raw or []):
        golden = q.get("golden_schema") or {}
        out.append({
            "query_id": str(q.get("query_id") or q.get("id") or f"q{i + 1}"), "question": q.get("question") or q.get("natural_language") or "", "sql": q.get("sql") or "",
            "required_tables": list(q.get("required_tables") or golden.get("tables") or []), "required_columns": list(q.get("required_columns") or golden.get("columns") or []),
            "output_columns": list(q.get("output_columns") or []), "tags": list(q.get("tags") or []), "difficulty": q.get("difficulty"), "dataset_id": dataset_id,
        })
    return out or [default_query(schema, dataset_id)]


def project_schema(schema: list[dict], query: dict[str, Any]) -> list[dict]:
    """Only the query's tables and columns; a table of which no column is named keeps all."""
    wanted: dict[str, set[str]] = {}
    for c in query["required_columns"]:
        table, _, column = c.partition(".")
        wanted.setdefault(table, set()).add(column)
    tables = set(query["required_tables"]) | set(wanted)
    return [{**t, "Attributes": [a for a in t["Attributes"] if t["Schema Name"] not in wanted or a["Attribute Name"] in wanted[t["Schema Name"]]]} for t in schema if not tables or t["Schema Name"] in tables]


def attribute_names(column_ids: list[str]) -> list[str]:
    return list(dict.fromkeys(c.split(".")[-1] for c in column_ids))


@dataclass
class Dataset:
    """documents, ground_truth, schema and queries of one dataset; frames stay lazy."""

    documents_with_provenance: DataFrame
    ground_truth: DataFrame
    schema: list[dict] = field(default_factory=list)
    queries: list[dict] = field(default_factory=list)
    names: dict[str, Any] | None = None
    root: str = ""
    reload: Callable[[], Dataset] | None = None

    @property
    def documents(self) -> DataFrame:
        return self.documents_with_provenance.select("doc_id", "doc_text", "doc_pos")

    def document(self, doc_id: str) -> tuple[str, str]:
        """(text, id); an unknown id has an empty text."""
        row = self.documents.where(F.col("doc_id") == doc_id).select("doc_text").first()
        return (row[0] if row else "", doc_id)

    def query(self, query_id: str) -> dict[str, Any]:
        return next(q for q in self.queries if q["query_id"] == query_id)

    def records(self) -> DataFrame:
        return records_of(self.ground_truth)

    def document_tables(self) -> DataFrame:
        """(doc_id, schema_tables, schema_table) as the ground truth tells."""
        return table_provenance(self.ground_truth)

    def document_records(self, doc_id: str) -> DataFrame:
        return self.records().where(F.col("doc_id") == doc_id)

    def sql(self, query_id: str) -> str:
        return self.query(query_id)["sql"]

    def name_map(self, query_id: str | None = None) -> dict[str, Any]:
        """Names of tables and attributes in the ground truth by those of the task; the same, unless told otherwise."""
        return name_map(self.schema, self.names)

    def summary(self) -> dict[str, int]:
        """How many documents, cells, tables, attributes and queries there are."""
        return {
            "documents": self.documents.count(), "cells": self.ground_truth.count(), "tables": len(self.schema),
            "attributes": sum(len(t["Attributes"]) for t in self.schema), "queries": len(self.queries),
        }

    def refreshed(self) -> Dataset:
        """The dataset read again from where it came from; one of memory stays as it is."""
        if self.reload is None:
            return self
        spark = self.documents_with_provenance.sparkSession
        spark.catalog.refreshByPath(self.root)
        return self.reload()


def with_positions(docs: DataFrame) -> DataFrame:
    """doc_pos in the order of the scan."""
    return docs if "doc_pos" in docs.columns else docs.withColumn("doc_pos", F.monotonically_increasing_id())


def from_manifest(spark: SparkSession, root: str, manifest: dict[str, str] | None = None) -> Dataset:
    """documents.parquet and ground_truth.parquet under ``root``, schema.json and queries.json under its metadata folder."""
    names = {"documents": "documents.parquet", "ground_truth": "ground_truth.parquet", "schema": "metadata/schema.json", "queries": "metadata/queries.json"} | (manifest or {})

    def whole(name: str) -> Any:
        rows = spark.read.text(f"{root}/{names[name]}", wholetext=True).collect()  # a small metadata file
        return json.loads(rows[0][0])

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def exists(name: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{names[name]}")
        return path.getFileSystem(conf).exists(path)

    docs = with_positions(spark.read.parquet(f"{root}/{names['documents']}"))
    truth = spark.read.parquet(f"{root}/{names['ground_truth']}") if exists("ground_truth") else spark.createDataFrame([], GROUND_TRUTH)
    schema = runtime_schema(whole("schema")) if exists("schema") else []
    return Dataset(docs, truth, schema, query_records(whole("queries") if exists("queries") else [], schema), root=root, reload=lambda: from_manifest(spark, root, manifest))


def from_memory(spark: SparkSession, documents: list[dict] | str, schema: Any = None, queries: Any = None, id_column: str = "doc_id", text_column: str = "doc_text") -> Dataset:
    rows = json.loads(documents) if isinstance(documents, str) else documents
    ids = [str(r.get(id_column) or "").strip() for r in rows]
    if not all(ids) or len(set(ids)) != len(ids):
        raise ValueError("documents need unique, non-empty ids")
    extra = sorted({k for r in rows for k in r} - {id_column, text_column})
    data = [(i, str(r.get(text_column) or ""), pos, *[None if r.get(k) is None else str(r[k]) for k in extra]) for pos, (i, r) in enumerate(zip(ids, rows, strict=True))]
    frame = spark.createDataFrame(data, ", ".join(["doc_id string", "doc_text string", "doc_pos long", *[f"`{k}` string" for k in extra]]))
    flat = runtime_schema(schema or [])
    return Dataset(frame, spark.createDataFrame([], GROUND_TRUTH), flat, query_records(queries, flat))


def name_map(schema: list[dict], given: dict[str, Any] | None = None) -> dict[str, Any]:
    """{"table": {name: ground truth name}, "attribute": {table: {name: ground truth name}}}: identity but for what is given."""
    given = given or {}
    tables = {t["Schema Name"]: given.get("table", {}).get(t["Schema Name"], t["Schema Name"]) for t in schema}
    attributes = {t["Schema Name"]: {a["Attribute Name"]: given.get("attribute", {}).get(t["Schema Name"], {}).get(a["Attribute Name"], a["Attribute Name"]) for a in t["Attributes"]} for t in schema}
    return {"table": tables, "attribute": attributes}


def renamed_truth(truth: DataFrame, names: dict[str, Any]) -> DataFrame:
    """Ground truth cells under the task's names of tables and columns; others keep theirs."""
    rows = [(gt, None, task, None) for task, gt in names["table"].items()] + [(names["table"].get(t, t), gt, None, a) for t, xs in names["attribute"].items() for a, gt in xs.items()]
    listed = truth.sparkSession.createDataFrame(rows, "gt_table string, gt_column string, task_table string, task_column string")
    tables = listed.where("gt_column is null").select(F.col("gt_table").alias("table_id"), "task_table")
    columns = listed.where("gt_column is not null").select(F.col("gt_table").alias("table_id"), F.col("gt_column").alias("column_name"), "task_column")
    both = truth.join(F.broadcast(tables), "table_id", "left").join(F.broadcast(columns), ["table_id", "column_name"], "left")  # as many rows as the schema has names
    return both.withColumn("table_id", F.coalesce("task_table", "table_id")).withColumn("column_name", F.coalesce("task_column", "column_name")).select(*truth.columns)


LOADERS = {"hf_manifest": from_manifest, "memory": from_memory}


def create_loader(name: str):
    if name not in LOADERS:
        raise ValueError(f"unknown loader {name!r}; known: {', '.join(sorted(LOADERS))}")
    return LOADERS[name]


def records_of(truth: DataFrame, order: str | None = None) -> DataFrame:
    """Long cells to records: (doc_id, table_id, record_id, data map). Of repeated columns the last value wins."""
    record = F.coalesce("record_id", "source_row_id", F.lit("0"))
    cells = truth.withColumn("_pos", F.col(order) if order else F.monotonically_increasing_id()).withColumn("record_id", record)
    last = cells.groupBy("doc_id", "table_id", "record_id", "column_name").agg(F.max_by("value", "_pos").alias("value"))
    return last.groupBy("doc_id", "table_id", "record_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("column_name", "value")))).alias("data"))


def relation(records: DataFrame, table_id: str, columns: list[str]) -> DataFrame:
    """One table of records with its provenance, a column for each attribute."""
    cells = [F.try_element_at("data", F.lit(c)).alias(c) for c in columns]
    return records.where(F.col("table_id") == table_id).select(F.col("doc_id").alias("__doc_id"), F.col("record_id").alias("row_id"), *cells)


def nested_records(records: DataFrame) -> DataFrame:
    """One row per document with its records in order; the first is the primary one."""
    listed = records.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("record_id"), F.col("table_id").alias("table"), F.to_json("data").alias("data")))).alias("records"))
    return listed.withColumn("table", F.col("records")[0]["table"]).withColumn("data", F.col("records")[0]["data"])


def table_provenance(truth: DataFrame, key: str = "doc_id", table: str = "table_id") -> DataFrame:
    """(key, schema_tables sorted and distinct, schema_table where there is exactly one)."""
    found = truth.groupBy(key).agg(F.sort_array(F.collect_set(table)).alias("schema_tables"))
    return found.withColumn("schema_table", F.when(F.size("schema_tables") == 1, F.col("schema_tables")[0]))


def contract_errors(documents: DataFrame, truth: DataFrame, schema: list[dict], queries: list[dict]) -> DataFrame:
    """(error, subject): ground truth of unknown documents or columns, queries on unknown tables or columns."""
    spark = documents.sparkSession
    columns = {f"{normalize_identifier(t['Schema Name'])}.{normalize_identifier(a['Attribute Name'])}" for t in schema for a in t["Attributes"]}
    tables = {t["Schema Name"] for t in schema}
    listed = spark.createDataFrame([(c,) for c in sorted(columns)], "column_id string")
    orphans = truth.join(documents.select("doc_id"), "doc_id", "left_anti").select(F.lit("orphan document").alias("error"), F.col("doc_id").alias("subject")).distinct()
    unknown = truth.join(listed, "column_id", "left_anti").select(F.lit("unknown column").alias("error"), F.col("column_id").alias("subject")).distinct()
    wrong = [("unknown table", t) for q in queries for t in q["required_tables"] if t not in tables] + [("unknown column", c) for q in queries for c in q["required_columns"] if c not in columns]
    return reduce(DataFrame.unionByName, [orphans, unknown, spark.createDataFrame(sorted(set(wrong)), "error string, subject string")])


def registry(spark: SparkSession, root: str, name: str = "registry.json") -> list[dict[str, Any]]:
    """The datasets of a root: {dataset_id, path, queries}; paths are relative to the root."""
    rows = spark.read.text(f"{root}/{name}", wholetext=True).collect()  # a small file
    raw = json.loads(rows[0][0])
    listed = raw.get("datasets", raw) if isinstance(raw, dict) else raw
    listed = [{"dataset_id": k, **(v if isinstance(v, dict) else {"path": v})} for k, v in listed.items()] if isinstance(listed, dict) else listed
    return [{"dataset_id": d["dataset_id"], "path": d.get("path") or d["dataset_id"], "queries": list(d.get("queries") or [])} for d in listed]


def selected_datasets(listed: list[dict[str, Any]], datasets: list[str] | str | None = None, query_ids: list[str] | str | None = None) -> list[dict[str, Any]]:
    """The chosen datasets and queries; names are lists, or texts with commas, and unknown datasets raise ValueError."""
    names = lambda x: list(dict.fromkeys(p.strip() for part in ([x] if isinstance(x, str) else x or []) for p in part.split(",") if p.strip()))
    wanted, queries = names(datasets), names(query_ids)
    known = {d["dataset_id"] for d in listed}
    if missing := [d for d in wanted if d not in known]:
        raise ValueError(f"unknown datasets: {', '.join(missing)}")
    return [{**d, "queries": queries or d["queries"]} for d in listed if not wanted or d["dataset_id"] in wanted]


def registry_errors(spark: SparkSession, root: str) -> DataFrame:
    """(dataset_id, error, subject) of every dataset of the registry; one that cannot be read is an error of its own."""
    parts = [spark.createDataFrame([], "dataset_id string, error string, subject string")]
    for d in registry(spark, root):
        try:
            data = from_manifest(spark, f"{root}/{d['path']}")
            parts.append(contract_errors(data.documents, data.ground_truth, data.schema, data.queries).select(F.lit(d["dataset_id"]).alias("dataset_id"), "error", "subject"))
        except AnalysisException as wrong:
            parts.append(spark.createDataFrame([(d["dataset_id"], "cannot be read", str(wrong).split("\n")[0])], parts[0].schema))
    return reduce(DataFrame.unionByName, parts)


def orphans(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``rows`` that ``known`` lacks."""
    return rows.join(known.select(key), key, "left_anti").select(key).distinct()


def found_rows(wanted: DataFrame, rows: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """(source_row_id, row_id): the row that a source row id names: by row id, else ``column-value`` of a column, else any column's value; the first of several.

    One shuffle by the text compared, whatever the number of columns, and no join: the texts of the rows are many times their
    table, so what Spark knows of its size would have it send them all through the driver.
    """
    texts = [F.struct(F.lit(0).alias("place"), F.col(row_id).cast("string").alias("text"))]
    for i, c in enumerate(columns):
        texts.append(F.struct(F.lit(1 + i).alias("place"), F.concat(F.lit(f"{c}-"), F.col(c).cast("string")).alias("text")))
        texts.append(F.struct(F.lit(1 + len(columns) + i).alias("place"), F.col(c).cast("string").alias("text")))
    names = rows.select(F.col(row_id).alias("_row"), F.explode(F.array(*texts)).alias("t")).select(F.col("t.text").alias("source_row_id"), F.struct("t.place", "_row").alias("_name"), F.lit(False).alias("_asked"))
    asked = wanted.select("source_row_id", F.lit(None).cast(names.schema["_name"].dataType).alias("_name"), F.lit(True).alias("_asked"))
    both = asked.unionByName(names).where("source_row_id is not null").groupBy("source_row_id").agg(F.min("_name").alias("_best"), F.max("_asked").alias("_asked"))
    return both.where("_asked").select("source_row_id", F.col("_best._row").alias("row_id"))


def repaired_truth(documents: DataFrame, truth: DataFrame, sources: dict[str, DataFrame], schema: list[dict], row_id: str = "row_id", keep_scope: bool = True) -> DataFrame:
    """Ground truth cells built anew from the source tables by the documents' row ids; cells of documents without a source row stay.

    With ``keep_scope`` only columns that the old truth had of a table are built.
    """
    had = truth.select("table_id", "column_name").distinct()
    out = None
    for t in schema:
        name, columns = t["Schema Name"], [a["Attribute Name"] for a in t["Attributes"]]
        if name not in sources:
            continue
        mine = documents.where((F.col("source_table") == name) & F.col("source_row_id").isNotNull()).select("doc_id", "source_row_id")
        found = mine.hint("merge").join(found_rows(mine, sources[name], columns, row_id), "source_row_id").where("row_id is not null")
        wide = found.join(sources[name].withColumnRenamed(row_id, "row_id").hint("merge"), "row_id")  # never broadcast: a row's text is many times its size in a file
        cells = wide.select("doc_id", "source_row_id", F.col("row_id").cast("string").alias("record_id"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(["doc_id", "source_row_id", "record_id"], columns, "column_name", "value")
        cells = cells.where("value is not null").select("doc_id", "record_id", F.lit(name).alias("table_id"), "column_name", "value", "source_row_id")
        out = cells if out is None else out.unionByName(cells)
    old = truth.select("doc_id", "record_id", "table_id", "column_name", "value", "source_row_id")
    if out is None:
        return old
    fresh = out.join(F.broadcast(had), ["table_id", "column_name"], "left_semi").select(*out.columns) if keep_scope else out  # as many rows as the schema has columns
    return fresh.unionByName(old.join(out.select("doc_id").hint("merge"), "doc_id", "left_anti"))


def split_ids(docs: DataFrame, n: int, strategy: str = "prefix", seed: int = 42, id_col: str = "doc_id", pos_col: str = "doc_id") -> DataFrame:
    """docs with ``split``: the first n by position, or by the hash of seed and id, are ``train``."""
    if n < 0:
        raise ValueError("the number of training documents is not negative")
    if strategy not in ("prefix", "hash"):
        raise ValueError("strategy is 'prefix' or 'hash'")
    key = F.col(pos_col) if strategy == "prefix" else F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    # the n-th smallest key bounds the training set: a top-n and a filter instead of a global window
    chosen = docs.select(F.col(id_col), key.alias("_k")).orderBy("_k").limit(n).select(id_col).withColumn("_train", F.lit(True))
    return docs.join(chosen, id_col, "left").withColumn("split", F.when(F.col("_train"), "train").otherwise("test")).drop("_train")


def python_hash_split(ids: list[str], n: int, seed: int) -> list[str]:
    return sorted(ids, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())[:n]


def positional_fill(docs: DataFrame, truth_rows: DataFrame, table: str = "source_table", row: str = "source_row_id", pos: str = "doc_pos") -> DataFrame:
    """Missing row ids of documents are filled, within a table, by position with the ids of its ground truth rows."""
    missing = docs.where(F.col(row).isNull()).withColumn("_n", F.row_number().over(Window.partitionBy(table).orderBy(pos)))
    known = truth_rows.select(table, F.col("row_id").alias("_row")).withColumn("_n", F.row_number().over(Window.partitionBy(table).orderBy("_row")))
    filled = missing.join(known, [table, "_n"], "left").withColumn(row, F.col("_row")).select(*docs.columns)
    return docs.where(F.col(row).isNotNull()).unionByName(filled)


def unpivot_cells(wide: DataFrame, key: str, columns: list[str], name: str = "column_name", value: str = "value") -> DataFrame:
    """Long cells of a wide table, as text."""
    return wide.select(F.col(key), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([key], columns, name, value)
