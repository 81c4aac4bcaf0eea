"""Query curation: columns profiled in one pass, candidates near coverage targets, their choice, audits of text against truth."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenar.functions.values import alnum_text, is_null_eval, number, safe_ratio
from lumenar.operators import relational
from lumenar.operators.predicates import all_of
from lumenar.operators.proxies import HeuristicProxy
from lumenar.operators.ranks import running_sum
from lumenar.plans import answers
from lumenar.plans.sqlx import Predicate, quote


def column_profiles(wide: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, non_null, distinct_values, numeric, avg_length, from long cells aggregated once."""
    cells = wide.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column_name", "value")
    known = F.when(~is_null_eval(F.col("value")), F.col("value"))
    return cells.groupBy("column_name").agg(
        F.count(known).alias("non_null"), F.countDistinct(known).alias("distinct_values"), F.count(number(known)).alias("numeric"), F.avg(F.length(known)).alias("avg_length")
    )


def output_scores(profiles: DataFrame, excluded: str | None = None) -> DataFrame:
    """Profiles with a score for showing a column in an answer: names, text and distinct values are good."""
    text = 1 - F.col("numeric") / F.greatest("non_null", F.lit(1))
    named = F.when(F.lower("column_name").rlike("name|title"), 4.0).otherwise(0.0)
    unique = F.col("distinct_values") / F.greatest("non_null", F.lit(1))
    scored = profiles.where(F.col("non_null") >= 2).withColumn("score", named + 3 * text + F.least(F.col("avg_length") / 20, F.lit(2.0)) + unique)
    return scored.where(F.col("column_name") != excluded) if excluded else scored


def threshold_candidates(rows: DataFrame, value: str, doc: str, buckets: list[float], total: int) -> DataFrame:
    """Per bucket, the value v for which the share of documents with a value of at least v comes closest; ties to the larger v.

    Documents count by their largest value, so running sums over distinct values give the shares.
    """
    best = rows.groupBy(doc).agg(F.max(value).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("docs"))
    covered = running_sum(best, [-F.col("v")], "docs", "covered")
    targets = rows.sparkSession.createDataFrame([(b,) for b in buckets], "bucket double")
    near = covered.join(F.broadcast(targets)).withColumn("gap", F.abs(F.col("covered") / F.lit(total) - F.col("bucket")))
    picked = near.groupBy("bucket").agg(F.min(F.struct("gap", (-F.col("v")).alias("minus"), "covered")).alias("s"))
    return picked.select("bucket", (-F.col("s.minus")).alias("threshold"), F.col("s.covered").alias("covered"))


def categorical_candidates(rows: DataFrame, value: str, doc: str) -> DataFrame:
    return rows.where(~is_null_eval(F.col(value))).groupBy(value).agg(F.countDistinct(doc).alias("docs"))


def nullness(rows: DataFrame, value: str, doc: str) -> DataFrame:
    null = is_null_eval(F.col(value))
    return rows.agg(F.countDistinct(F.when(null, F.col(doc))).alias("null_docs"), F.countDistinct(F.when(~null, F.col(doc))).alias("known_docs"))


def conflicts(rows: DataFrame, text_says: Column, truth_says: Column) -> DataFrame:
    """Rows where the text and the ground truth disagree about a predicate; unknown evidence is no conflict."""
    kind = F.when(text_says & ~truth_says, "text_pass_gt_fail").when(~text_says & truth_says, "text_fail_gt_pass")
    return rows.withColumn("conflict_type", kind).where(F.col("conflict_type").isNotNull())


def best_first(variants: DataFrame, measures: list[str], cost: str, *ties: str) -> DataFrame:
    """Lexicographic order: measures descending, then the cost and further columns ascending; rank from 1. As many rows as variants."""
    order = Window.orderBy(*[F.desc(m) for m in measures], cost, *ties)
    return variants.withColumn("rank", F.row_number().over(order))


def negatives_with_own_value(docs: DataFrame, truth: DataFrame, column: str, target: str, most: int = 5) -> DataFrame:
    """Documents whose own value differs from the target and stands in the text, by id."""
    cells = truth.where((F.col("column_name") == column) & (F.lower("value") != target.lower()))
    return docs.join(cells, "doc_id").where(F.col("doc_text").contains(F.col("value"))).select("doc_id").distinct().orderBy("doc_id").limit(most)


# --- candidates for queries ------------------------------------------------------------


@dataclass(frozen=True)
class Candidate:
    """A query that might be asked: its SQL, the tables and the predicate it uses, and the documents it needs."""

    sql: str
    tables: tuple[str, ...]
    column: str
    operator: str
    value: str
    documents: int
    coverage: float
    bucket: float
    cells: int = 0
    status: str = "keep"

    @property
    def is_join(self) -> bool:
        return len(self.tables) > 1

    @property
    def gap(self) -> float:
        return abs(self.coverage - self.bucket)

    @property
    def predicate(self) -> str:
        return f"{self.column}::{self.operator}::{self.value}"


def nearest_bucket(coverage: float, buckets: list[float]) -> float:
    return min(buckets, key=lambda b: (abs(coverage - b), b))


def usable_columns(wide: DataFrame, columns: list[str], keys: tuple[str, ...] = ("doc_id", "row_id")) -> list[str]:
    """Columns but keys with at least two known values, counted in one pass."""
    asked = [c for c in columns if c not in keys]
    if not asked:
        return []
    found = wide.agg(*[F.count_if(~is_null_eval(F.col(c).cast("string"))).alias(c) for c in asked]).first()
    return [c for c in asked if found[c] >= 2]


def _literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _plain(value: float) -> str:
    return str(int(value)) if float(value).is_integer() else repr(float(value))


def _made(sql: str, tables: tuple[str, ...], column: str, operator: str, value: str, documents: int, total: int, buckets: list[float]) -> Candidate:
    coverage = documents / total if total else 0.0
    return Candidate(sql, tables, column, operator, value, documents, coverage, nearest_bucket(coverage, buckets))


def predicates_of_column(rows: DataFrame, table: str, column: str, buckets: list[float], total: int, doc: str = "doc_id", max_in_values: int = 3) -> list[tuple[str, str, str, int]]:
    """(SQL, operator, value, documents) of predicates on one column: known values, thresholds of numbers near the buckets, single values and lists of the commonest.

    A column is numeric with at least three known values of which 60 of 100 are numbers.
    """
    text, name = F.col(column).cast("string"), f"{quote(table)}.{quote(column)}"
    known = rows.where(~is_null_eval(text)).select(F.col(doc).alias("doc_id"), text.alias("v"))
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.count(number(F.col("v"))).alias("numbers"), F.countDistinct("doc_id").alias("docs")).first()
    out = [(f"{name} IS NOT NULL", "IS NOT NULL", "is not null", counts["docs"])] if counts["docs"] else []
    if counts["n"] >= 3 and counts["numbers"] >= 0.6 * counts["n"]:
        numbers = known.select("doc_id", number(F.col("v")).alias("x"))
        for r in threshold_candidates(numbers, "x", "doc_id", buckets, total).orderBy("bucket").collect():  # a row for each bucket
            out.append((f"{name} >= {_plain(r['threshold'])}", ">=", _plain(r["threshold"]), r["covered"]))
        return list(dict.fromkeys(out))
    common = categorical_candidates(known, "v", "doc_id").orderBy(F.desc("docs"), "v").limit(max(max_in_values, len(buckets))).collect()
    out += [(f"{name} = {_literal(r['v'])}", "=", r["v"], r["docs"]) for r in common]
    for size in range(2, min(max_in_values, len(common)) + 1):
        listed = [r["v"] for r in common[:size]]
        docs = known.where(F.col("v").isin(listed)).agg(F.countDistinct("doc_id").alias("n")).first()["n"]
        out.append((f"{name} IN ({', '.join(map(_literal, listed))})", "IN", "|".join(listed), docs))
    return out


def table_candidates(rows: DataFrame, table: str, columns: list[str], output: str, buckets: list[float], total: int, max_in_values: int = 3) -> list[Candidate]:
    """Queries on one table that show ``output`` for a predicate on one of its columns."""
    out = []
    for c in columns:
        for sql, operator, value, docs in predicates_of_column(rows, table, c, buckets, total, max_in_values=max_in_values):
            out.append(_made(f"SELECT {quote(table)}.{quote(output)} FROM {quote(table)} WHERE {sql}", (table,), f"{table}.{c}", operator, value, docs, total, buckets))
    return out


@dataclass(frozen=True)
class JoinPair:
    left_table: str
    left_column: str
    right_table: str
    right_column: str


def join_candidates(tables: dict[str, DataFrame], pair: JoinPair, outputs: dict[str, str], columns: dict[str, list[str]], buckets: list[float], total: int, most_rows: int = 50_000, max_columns: int = 4, max_in_values: int = 3) -> list[Candidate]:
    """Queries on an inner join that show a column of one side, for no predicate or one on the other side; documents are those that take part.

    A join of no rows, or of more than ``most_rows``, gives none.
    """
    left, right = tables[pair.left_table], tables[pair.right_table]
    joined = lambda where=None: relational.joined_documents(left, right, pair.left_column, pair.right_column, "inner", where, None if where is not None else most_rows)
    whole = joined()
    if whole is None:
        return []
    every = whole.first()["documents"]
    on = f"{quote(pair.left_table)} JOIN {quote(pair.right_table)} ON {quote(pair.left_table)}.{quote(pair.left_column)} = {quote(pair.right_table)}.{quote(pair.right_column)}"
    names = tuple(sorted((pair.left_table, pair.right_table)))
    out = []
    for shown, asked, side in ((pair.left_table, pair.right_table, "r"), (pair.right_table, pair.left_table, "l")):
        head = f"SELECT {quote(shown)}.{quote(outputs[shown])} FROM {on}"
        out.append(_made(head, names, "", "JOIN_ALL", "all", every, total, buckets))
        key = pair.right_column if side == "r" else pair.left_column
        for c in [c for c in columns[asked] if c != key][:max_columns]:
            for sql, operator, value, _ in predicates_of_column(tables[asked], asked, c, buckets, total, max_in_values=max_in_values):
                docs = joined(_condition(F.col(f"{side}.{c}").cast("string"), operator, value)).first()["documents"]
                if docs:
                    out.append(_made(f"{head} WHERE {sql}", names, f"{asked}.{c}", operator, value, docs, total, buckets))
    return out


def left_join_candidates(tables: dict[str, DataFrame], pair: JoinPair, outputs: dict[str, str], columns: dict[str, list[str]], buckets: list[float], total: int, max_columns: int = 4) -> list[Candidate]:
    """Queries on left joins that keep each side in turn, for all rows or those with a known value in a column of that side."""
    out, names = [], tuple(sorted((pair.left_table, pair.right_table)))
    for kept, key, other, other_key in ((pair.left_table, pair.left_column, pair.right_table, pair.right_column), (pair.right_table, pair.right_column, pair.left_table, pair.left_column)):
        head = f"SELECT {quote(kept)}.{quote(outputs[kept])} FROM {quote(kept)} LEFT JOIN {quote(other)} ON {quote(kept)}.{quote(key)} = {quote(other)}.{quote(other_key)}"
        every = relational.joined_documents(tables[kept], tables[other], key, other_key, "left").first()["documents"]
        if every:
            out.append(_made(head, names, "", "LEFT_JOIN_ALL", "all", every, total, buckets))
        for c in [c for c in columns[kept] if c != key][:max_columns]:
            known = _condition(F.col(f"l.{c}").cast("string"), "IS NOT NULL", "")
            docs = relational.joined_documents(tables[kept], tables[other], key, other_key, "left", known).first()["documents"]
            if docs:
                out.append(_made(f"{head} WHERE {quote(kept)}.{quote(c)} IS NOT NULL", names, f"{kept}.{c}", "IS NOT NULL", "is not null", docs, total, buckets))
    return out


def _condition(text: Column, operator: str, value: str) -> Column:
    if operator == "IS NOT NULL":
        return ~is_null_eval(text)
    if operator == ">=":
        return number(text) >= float(value)
    return text.isin(value.split("|")) if operator == "IN" else text == value


def prefiltered(candidates: list[Candidate], buckets: list[float], most: int) -> list[Candidate]:
    """At most ``most`` of each bucket: closest to it, joins before others, each predicate once as long as that fills it."""
    out: list[Candidate] = []
    for b in buckets:
        mine = sorted((c for c in candidates if abs(c.bucket - b) < 1e-12), key=lambda c: (c.gap, not c.is_join, c.sql))
        chosen: list[Candidate] = []
        used: set[str] = set()
        for again in (False, True):
            for c in mine:
                if len(chosen) < most and c.sql not in {x.sql for x in chosen} and (again or c.predicate not in used):
                    chosen.append(c)
                    used.add(c.predicate)
        out += chosen if len(mine) > most else mine
    return out


def diverse(candidates: list[Candidate], per_bucket: int, least_joins: int) -> list[Candidate]:
    """Candidates of one bucket worth keeping, one at a time: new predicates first, then new sets of tables, joins, small gaps and many cells.

    Joins come first until ``least_joins`` of them are chosen, or none is left.
    """
    left = [c for c in candidates if c.status == "keep"]
    chosen: list[Candidate] = []

    def best(of: list[Candidate], joins_first: bool) -> Candidate | None:
        predicates, tables, texts = {c.predicate for c in chosen}, {c.tables for c in chosen}, {c.sql for c in chosen}
        free = [c for c in of if c.sql not in texts]
        return min(free, key=lambda c: (c.predicate in predicates, c.tables in tables, joins_first and not c.is_join, c.gap, -c.cells, c.sql), default=None)

    while len(chosen) < per_bucket and sum(c.is_join for c in chosen) < least_joins and (c := best([x for x in left if x.is_join], False)):
        chosen.append(c)
    while len(chosen) < per_bucket and (c := best(left, True)):
        chosen.append(c)
    return chosen


def profile(records: DataFrame, sql: str, required: dict[str, list[str]], all_ids: DataFrame, evaluated_ids: DataFrame, least_documents: int = 1, least_cells: int = 1) -> dict:
    """What a query needs of all documents and of those to be evaluated, and whether to keep it.

    ``keep``, ``review_sql_provenance`` where the SQL doesn't tell the rows it reads, or
    ``remove_...``: no required attributes, or too few documents or cells.
    """
    references = answers.answer_references(records, sql, required) if sql and required else None
    counts = {}
    for name, ids in (("all", all_ids), ("evaluated", evaluated_ids)):
        mine = records.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        rows = answers.required_cells(answers.required_records(mine, required, references), required).collect() if required else []  # a row for each table
        counts[name] = {"documents": sum(r["docs"] for r in rows), "cells": sum(r["cells"] for r in rows), "total": ids.select("doc_id").distinct().count()}
    told = "not_sql" if not sql else "ok" if references is not None else "fallback_all_required_rows"
    mine = counts["evaluated"]
    if not required:
        status = "remove_no_required_attrs"
    elif mine["documents"] < least_documents or mine["cells"] < least_cells:
        status = "remove_too_few_docs_or_cells"
    else:
        status = "keep" if told != "fallback_all_required_rows" else "review_sql_provenance"
    rate = lambda c: c["documents"] / c["total"] if c["total"] else None
    return {"all": {**counts["all"], "rate": rate(counts["all"])}, "evaluated": {**mine, "rate": rate(mine)}, "provenance": told, "status": status}


def curated(tables: dict[str, DataFrame], columns: dict[str, list[str]], pairs: list[JoinPair], buckets: list[float], total: int, per_bucket: int = 5, least_joins: int = 1, most_per_bucket: int = 50, judge: Callable[[Candidate], Candidate] | None = None) -> list[Candidate]:
    """Queries worth asking: candidates of every table and join pair, cut per bucket, judged (profiled), and chosen to differ.

    tables: by name, rows of doc_id and columns. Candidates are counted by Spark; only they reach the driver.
    """
    usable = {t: usable_columns(rows, columns[t]) for t, rows in tables.items()}
    outputs = {t: output_column(rows, usable[t]) for t, rows in tables.items() if usable[t]}
    raw = [c for t in outputs for c in table_candidates(tables[t], t, usable[t], outputs[t], buckets, total)]
    for p in pairs:
        if p.left_table in outputs and p.right_table in outputs:
            raw += join_candidates(tables, p, outputs, usable, buckets, total) + left_join_candidates(tables, p, outputs, usable, buckets, total)
    kept = prefiltered(raw, buckets, most_per_bucket)
    kept = [judge(c) for c in kept] if judge else kept
    return [c for b in buckets for c in diverse([x for x in kept if abs(x.bucket - b) < 1e-12], per_bucket, least_joins)]


def output_column(rows: DataFrame, columns: list[str]) -> str:
    """The best column to show; the first, if none scores."""
    best = output_scores(column_profiles(rows, columns)).orderBy(F.desc("score"), "column_name").first()
    return best["column_name"] if best else columns[0]


def one_predicate_query(query_id: str, table: str, column: str, operator: str, value: object, output: str, dataset_id: str = "default") -> dict:
    """A query record that asks for ``output`` of one table under one predicate."""
    shown = value if isinstance(value, (int, float)) else _literal(str(value))
    sql = f"SELECT {quote(table)}.{quote(output)} FROM {quote(table)} WHERE {quote(table)}.{quote(column)} {operator} {shown}"
    return {
        "query_id": query_id, "question": f"{output} of {table} where {column} {operator} {value}", "sql": sql, "required_tables": [table],
        "required_columns": list(dict.fromkeys([f"{table}.{output}", f"{table}.{column}"])), "output_columns": [f"{table}.{output}"], "tags": ["one_predicate"], "difficulty": None, "dataset_id": dataset_id,
    }


# --- audits and ablations --------------------------------------------------------------


def identity_mismatches(docs: DataFrame, truth: DataFrame, name_column: str, source_table: str | None = None) -> DataFrame:
    """(doc_id) of documents whose text lacks the name that the ground truth gives them, letters and digits compared."""
    names = truth.where(F.lower("column_name") == name_column.lower()).groupBy("doc_id").agg(F.max("value").alias("_name"))
    rows = docs.where(F.lower("source_table") == source_table.lower()) if source_table else docs
    plain = alnum_text(F.col("_name"))
    return rows.join(names, "doc_id").where((plain != "") & ~alnum_text(F.col("doc_text")).contains(plain)).select("doc_id").distinct()


def conflict_documents(found: DataFrame, kind: str, by_predicate: bool = False, mismatches: DataFrame | None = None) -> DataFrame:
    """(subject, documents, doc_ids): documents with conflicts of one kind, by attribute or by predicate, sorted; identity mismatches don't count.

    found: doc_id, attribute, operator, value, conflict_type.
    """
    rows = found.where(F.col("conflict_type") == kind)
    if mismatches is not None:
        rows = rows.join(mismatches.select("doc_id").distinct(), "doc_id", "left_anti")
    subject = F.concat_ws("::", F.lower("attribute"), "operator", "value") if by_predicate else F.lower("attribute")
    return rows.groupBy(subject.alias("subject")).agg(F.countDistinct("doc_id").alias("documents"), F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))


def conflict_totals(found: DataFrame, *by: str) -> DataFrame:
    """Conflicts of each kind (and further columns), with their documents and the first of them."""
    return found.groupBy(*by, "conflict_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc"))


def audit(docs: DataFrame, records: DataFrame, table: str, predicates: list[Predicate], text: str = "doc_text") -> DataFrame:
    """(doc_id, attribute, operator, value, conflict_type) of documents whose text and ground truth disagree about a predicate; texts without evidence agree."""
    out = None
    mine = records.where(F.col("table_id") == table)
    for p in predicates:
        hits = all_of([p], {p.attribute: F.try_element_at("data", F.lit(p.attribute))})
        told = mine.select("doc_id", F.coalesce(hits, F.lit(False)).alias("truth")).groupBy("doc_id").agg(F.max("truth").alias("truth"))
        said = docs.select("doc_id", HeuristicProxy(p, text).score().alias("score")).join(told, "doc_id")
        found = conflicts(said.where("score <> 0.5"), F.col("score") > 0.5, F.col("truth"))
        rows = found.select("doc_id", F.lit(p.attribute).alias("attribute"), F.lit(p.operator).alias("operator"), F.lit(str(p.value)).alias("value"), "conflict_type")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("predicates are not empty")
    return out


def artifact_summary(runs: DataFrame, key: str = "artifact_id") -> DataFrame:
    """Totals over an artifact's queries: recalls of answers, cells and tables (1 of nothing), queries that can be answered, documents and what was saved.

    runs: covered and total of answer, cell and table, can_answer, docs_before and docs_read, a row for each query.
    """
    sums = runs.groupBy(key).agg(
        F.count(F.lit(1)).alias("queries"), F.count_if("can_answer").alias("can_answer"),
        *[F.coalesce(F.sum(f"{n}_{k}"), F.lit(0)).alias(f"{n}_{k}") for n in ("answer", "cell", "table") for k in ("covered", "total")],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs_before", "docs_read")],
    )
    for n in ("answer", "cell", "table"):
        sums = sums.withColumn(f"{n}_recall", safe_ratio(F.col(f"{n}_covered"), F.col(f"{n}_total"), 1.0))
    sums = sums.withColumn("saved_rate", safe_ratio(F.greatest(F.col("docs_before") - F.col("docs_read"), F.lit(0)), F.col("docs_before")))
    return sums.withColumn("full_recall", (F.col("answer_recall") >= 1) & (F.col("cell_recall") >= 1) & (F.col("table_recall") >= 1))


def best_upper_bound(variants: DataFrame, offline: str = "offline", cost: str = "docs_read") -> DataFrame:
    """Of the variants that know the truth and lose nothing, the one that reads fewest documents; no row, if there is none."""
    return variants.where(F.col(offline) & F.col("full_recall")).orderBy(cost, "artifact_id").limit(1)


def density(docs: DataFrame, truth: DataFrame, by: list[str], text: str = "doc_text") -> DataFrame:
    """Documents, cells and words per group, cells a document and a thousand words, and documents with cells of several tables."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")
    cells = truth.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_cells"), F.countDistinct("table_id").alias("_tables"))
    rows = docs.select("doc_id", *by, words.alias("_words")).join(cells, "doc_id", "left")
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("_cells"), F.lit(0)).alias("cells"), F.sum("_words").alias("tokens"), F.count_if(F.col("_tables") > 1).alias("docs_of_several_tables"))
    return out.withColumn("cells_a_doc", safe_ratio(F.col("cells"), F.col("docs"))).withColumn("cells_a_thousand_tokens", safe_ratio(1000 * F.col("cells"), F.col("tokens")))
