"""Answering SQL over extracted records, and the rows an answer comes from.

Records are text. A column whose values are all numbers is published as numbers, every other one
as text, so comparisons and aggregates of the query mean what they mean over a declared schema.
A column that mixes both stays text; Spark then compares it with a number by casting, and where
it cannot cast the query fails rather than answer something else. A column whose type is declared is
published as declared, without a look at its values; a cell that is none of its type is null there.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenar.functions import values as V
from lumenar.operators.predicates import all_of
from lumenar.plans.sqlx import _ENDS, _SETS, Predicate, Token, _depths, quote, table_references, tokens
from lumenar.sources.datasets import relation

Required = dict[str, list[str]]
Types = dict[str, dict[str, str]]  # table -> column -> declared type

#: How declared types are published; others are told by their values.
DECLARED = {
    "int": "bigint", "integer": "bigint", "bigint": "bigint", "long": "bigint",
    "double": "double", "float": "double", "number": "double", "real": "double", "text": "string",
}


def declared_types(schema: list[dict]) -> Types:
    """The types that a schema declares for its attributes; ``string``, which contracts also write where none is known, declares nothing."""
    out: Types = {}
    for t in schema:
        for a in t["Attributes"]:
            if str(a.get("Type", "")).lower() in DECLARED:
                out.setdefault(t["Schema Name"], {})[a["Attribute Name"]] = str(a["Type"]).lower()
    return out


def numeric_columns(rows: DataFrame, columns: list[str]) -> dict[str, str]:
    """column -> ``bigint`` or ``double`` where every known value is a number; one aggregation for all columns."""
    checks = []
    for c in columns:
        text = V.sql_value(F.col(f"`{c}`"))
        checks += [F.count(text).alias(f"{c}__n"), F.count(V.number(text)).alias(f"{c}__d"), F.count_if(text.rlike(r"^[+-]?\d{1,18}$")).alias(f"{c}__i")]
    if not checks:
        return {}
    found = rows.agg(*checks).first()
    kinds = {}
    for c in columns:
        n, doubles, integers = found[f"{c}__n"], found[f"{c}__d"], found[f"{c}__i"]
        if n and n == doubles:
            kinds[c] = "bigint" if n == integers else "double"
    return kinds


def typed_relation(records: DataFrame, table: str, columns: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """One table of records, (__doc_id, row_id, columns), typed as declared, else by its values: only undeclared columns are looked at first."""
    rows = relation(records, table, columns)
    kinds = {c: DECLARED[t] for c, t in (types or {}).items() if c in columns}
    cells = {c: V.sql_value(F.col(f"`{c}`")) for c in columns}
    cells |= {c: cells[c].try_cast(kind) for c, kind in kinds.items() if kind != "string"}
    cells |= {c: cells[c].cast(kind) for c, kind in numeric_columns(rows, [c for c in columns if c not in kinds]).items()}
    return rows.select("__doc_id", "row_id", *(cells[c].alias(c) for c in columns))


def records_for(records: DataFrame, doc_ids: DataFrame, required: Required) -> DataFrame:
    """Records of the evaluated documents in the tables that the query needs."""
    return records.where(F.col("table_id").isin(list(required))).join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")


def _renamed(sql: str, views: dict[str, str]) -> list[Token]:
    """The tokens of ``sql`` where table references name views; a table without an alias keeps its name as one."""
    items = tokens(sql)
    out: list[Token] = []
    opened: list[bool] = [False]  # whether a table may stand here, per bracket
    for i, t in enumerate(items):
        if t.text == "(" and t.kind == "mark":
            opened.append(opened[-1])
        elif t.text == ")" and t.kind == "mark":
            if len(opened) > 1:
                opened.pop()
            opened[-1] = False
        elif t.word in ("FROM", "JOIN"):
            opened[-1] = True
        elif t.text == "," and opened[-1] is False and _in_from(items, i):
            opened[-1] = True
        elif t.kind == "name" and opened[-1]:
            opened[-1] = False
            if t.name in views:
                following = items[i + 1] if i + 1 < len(items) else None
                own = following is not None and following.kind == "name" and following.word not in _AFTER_TABLE
                out.append(Token("name", f"`{views[t.name]}`"))
                if not own:
                    out += [Token("name", "AS"), Token("name", "`" + t.name.replace("`", "``") + "`")]
                continue
        out.append(t)
    return out


_AFTER_TABLE = {"JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "OUTER", "NATURAL", "ON", "USING", "WHERE", *_ENDS}


def _in_from(items: list[Token], at: int) -> bool:
    """Whether the comma at ``at`` separates tables: the nearest clause word of its level is FROM or a join's."""
    depth = _depths(items)
    for i in range(at - 1, -1, -1):
        if depth[i] < depth[at]:
            return False
        if depth[i] == depth[at] and items[i].word in {"SELECT", "WHERE", "ON", "USING", "FROM", "JOIN", *_ENDS}:
            return items[i].word in ("FROM", "JOIN", "ON", "USING")
    return False


def _spark_text(items: list[Token]) -> str:
    """Names in double quotes or square brackets become backquoted; an unknown quoted name was a literal."""
    words = []
    for t in items:
        if t.kind == "name" and t.text[0] in '"[':
            words.append("`" + t.name.replace("`", "``") + "`")
        else:
            words.append(t.text)
    return re.sub(r" ?\. ?(?=[`\w])", ".", " ".join(words)) if not any(t.kind == "string" for t in items) else _join_dots(words)


def _join_dots(words: list[str]) -> str:
    out = ""
    for w in words:
        out += w if w == "." or out.endswith(".") or not out else f" {w}"
    return out


def publish(records: DataFrame, required: Required, types: Types | None = None) -> dict[str, str]:
    """A view of a fresh name for each table, so that answers of several runs do not meet."""
    run = uuid.uuid4().hex[:8]
    views = {}
    for i, (table, columns) in enumerate(required.items()):
        views[table] = f"answer_{run}_{i}"
        typed_relation(records, table, columns, (types or {}).get(table)).createOrReplaceTempView(views[table])
    return views


def answer(records: DataFrame, sql: str, required: Required, types: Types | None = None) -> DataFrame:
    """The rows of ``sql`` over the records' tables."""
    views = publish(records, required, types)
    return records.sparkSession.sql(_spark_text([t for t in _renamed(sql, views) if t.text != ";"]))


def provenance_sql(sql: str) -> str | None:
    """``sql`` with its SELECT list replaced by document and row of every table reference.

    Groups, ORDER BY and LIMIT fall away, so every row that an aggregate reads counts as its
    source. Set operations have no single list of references: None.
    """
    items = [t for t in tokens(sql) if t.text != ";"]
    depth = _depths(items)
    if any(t.word in _SETS for t in items):
        return None
    start = next((i for i, t in enumerate(items) if t.word == "FROM" and depth[i] == 0), None)
    if start is None or not items or items[0].word != "SELECT":
        return None
    limited = any(t.word == "LIMIT" and d == 0 for t, d in zip(items, depth, strict=True))
    grouped = any(t.word in ("GROUP", "HAVING") and d == 0 for t, d in zip(items, depth, strict=True))
    stops = {"GROUP", "HAVING", "ORDER", "LIMIT"} if grouped or not limited else set()
    end = next((i for i in range(start, len(items)) if depth[i] == 0 and items[i].word in stops), len(items))
    refs, _ = table_references(sql)
    if not refs:
        return None
    chosen = ", ".join(f"{quote(a)}.__doc_id AS doc_{i}, {quote(a)}.row_id AS row_{i}" for i, (_, a) in enumerate(refs))
    return f"SELECT {chosen} {_join_dots([t.text for t in items[start:end]])}"


def answer_references(records: DataFrame, sql: str, required: Required) -> DataFrame | None:
    """Distinct (table_id, doc_id, record_id) the answer comes from; None where that cannot be told, so all rows count."""
    rewritten = provenance_sql(sql)
    if rewritten is None:
        return None
    refs, _ = table_references(sql)
    wide = answer(records, rewritten, required)
    rows = F.array(*[F.struct(F.lit(t).alias("table_id"), F.col(f"doc_{i}").alias("doc_id"), F.col(f"row_{i}").alias("record_id")) for i, (t, _) in enumerate(refs)])
    return wide.select(F.explode(rows).alias("r")).select("r.*").where("doc_id is not null").distinct()


def post_query_output(rows: DataFrame, predicates: list[Predicate], output: list[str]) -> DataFrame:
    """Rows that satisfy all predicates, with their output columns, where all of these are known."""
    return rows.where(all_of(predicates)).select(*output).dropna()


def required_records(records: DataFrame, required: Required, references: DataFrame | None = None) -> DataFrame:
    """The ground truth records an evaluation asks for: those of the answer, or all of the required tables."""
    kept = records.where(F.col("table_id").isin(list(required)))
    return kept if references is None else kept.join(references, ["table_id", "doc_id", "record_id"], "left_semi")


def required_cells(records: DataFrame, required: Required) -> DataFrame:
    """(table_id, docs, cells): documents and non-null required cells of each table."""
    wanted = F.lit(None).cast("array<string>")
    for table, columns in required.items():
        wanted = F.when(F.col("table_id") == table, F.array(*[F.lit(c) for c in columns]).cast("array<string>")).otherwise(wanted)
    known = F.size(F.filter(wanted, lambda c: ~V.is_null_eval(F.try_element_at("data", c))))
    return records.where(F.col("table_id").isin(list(required))).groupBy("table_id").agg(F.countDistinct("doc_id").alias("docs"), F.coalesce(F.sum(known), F.lit(0)).alias("cells"))
