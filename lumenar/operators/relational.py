"""Joins and record assembly: semi-join reduction, join inference, chunk merge, greedy record matching."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenar.functions.values import decimal_value, is_none_value, is_null_eval, join_value, let, membership_key, normal_text
from lumenar.storage import written


def key_values(rows: DataFrame, key: str) -> DataFrame:
    """Distinct non-blank keys of surviving rows."""
    return rows.select(membership_key(F.col(key).cast("string")).alias("key")).where("key is not null").distinct()


def reduce_by_keys(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key is among ``keys`` (a left semi-join on normal keys); null and blank keys never pass."""
    return rows.withColumn("_key", membership_key(F.col(key).cast("string"))).join(keys.withColumnRenamed("key", "_key"), "_key", "left_semi").select(*rows.columns)


def reduce_both_ways(parent: DataFrame, parent_key: str, child: DataFrame, child_key: str) -> tuple[DataFrame, DataFrame]:
    """The child reduced by the parent's keys, then the parent by the surviving child's."""
    child = reduce_by_keys(child, child_key, key_values(parent, parent_key))
    return reduce_by_keys(parent, parent_key, key_values(child, child_key)), child


@dataclass(frozen=True)
class Edge:
    """Two tables and the pairs of columns that join them, all of them at once."""

    parent: str
    child: str
    columns: tuple[tuple[str, str], ...]

    def of(self, table: str) -> list[str]:
        return [c[0 if table == self.parent else 1] for c in self.columns]

    def other(self, table: str) -> str:
        return self.child if table == self.parent else self.parent


def join_tree(joins: list[tuple[tuple[str, str], tuple[str, str]]]) -> tuple[list[Edge], list[Edge]]:
    """(edges of a spanning forest, parents before children; edges that close a cycle) of joins ((table, column), (table, column)).

    Joins of the same two tables are one edge; a table joined with itself is none.
    """
    pairs: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for (a, x), (b, y) in joins:
        if a != b:
            key, columns = ((a, b), (x, y)) if (b, a) not in pairs else ((b, a), (y, x))
            if columns not in pairs.setdefault(key, []):
                pairs[key].append(columns)
    edges = [Edge(a, b, tuple(c)) for (a, b), c in pairs.items()]
    tree, used, seen = [], set(), set()
    for start in dict.fromkeys(t for e in edges for t in (e.parent, e.child)):
        todo = [] if start in seen else [start]
        seen.add(start)
        while todo:
            table = todo.pop(0)
            for e in edges:
                if e not in used and table in (e.parent, e.child) and e.other(table) not in seen:
                    used.add(e)
                    seen.add(e.other(table))
                    todo.append(e.other(table))
                    tree.append(e if e.parent == table else Edge(table, e.other(table), tuple((y, x) for x, y in e.columns)))
    return tree, [e for e in edges if e not in used]


def fully_reduced(rows: dict[str, DataFrame], joins: list[tuple[tuple[str, str], tuple[str, str]]], key: Callable[[str], Column]) -> dict[str, DataFrame]:
    """Rows of each table without those that no row of the whole inner join uses, if the joins form a tree.

    Semi-joins go from the leaves up and then down again, so what a table rejects reaches every other one. Joins that
    close a cycle reduce both their tables once before, which is safe but need not be all. ``key`` gives a column's join
    key; rows with a null key join nothing. Between steps only distinct keys are kept, in the shared folder.
    """
    tree, cycles = join_tree(joins)
    rows = dict(rows)

    def told(table: str, edge: Edge) -> DataFrame:
        return rows[table].select(*(key(c).alias(f"_k{i}") for i, c in enumerate(edge.of(table))))

    def reduce_to(table: str, edge: Edge) -> None:
        names = [f"_k{i}" for i in range(len(edge.columns))]
        # written before they are made distinct: as a grouping key the expression is too long to compile
        keys = written(told(edge.other(table), edge).dropna(), "edge-keys").distinct()
        columns = rows[table].columns
        marked = rows[table].select("*", *(key(c).alias(f"_k{i}") for i, c in enumerate(edge.of(table))))
        rows[table] = marked.join(keys, names, "left_semi").select(*columns)

    for edge in cycles:
        reduce_to(edge.child, edge)
        reduce_to(edge.parent, edge)
    for edge in reversed(tree):
        reduce_to(edge.parent, edge)
    for edge in tree:
        reduce_to(edge.child, edge)
    return rows


def keep_by_tables(docs: DataFrame, allowed: list[str], tables: str = "schema_tables", keep_unknown: bool = True) -> DataFrame:
    """Documents whose known tables meet the allowed ones; unknown ones as told."""
    known = F.size(F.coalesce(tables, F.array().cast("array<string>"))) > 0
    meets = F.arrays_overlap(tables, F.array(*[F.lit(t) for t in allowed]))
    return docs.where(F.when(known, meets).otherwise(F.lit(keep_unknown)))


def join_pairs(cells: DataFrame, most: int = 32) -> DataFrame:
    """Column pairs of different tables that share values, best first. cells: table_id, column_name, value.

    Shared values are counted from distinct (table, column, value) rows; the self-join is on the value.
    """
    distinct = cells.select("table_id", "column_name", join_value(F.col("value")).alias("v")).where("v is not null").distinct()
    sizes = distinct.groupBy("table_id", "column_name").agg(F.count(F.lit(1)).alias("n"))
    left, right = (distinct.select(F.col("v"), F.col("table_id").alias(f"{s}_table"), F.col("column_name").alias(f"{s}_column")) for s in ("left", "right"))
    shared = left.join(right, "v").where("left_table < right_table").groupBy("left_table", "left_column", "right_table", "right_column").agg(F.count(F.lit(1)).alias("shared"))
    for s in ("left", "right"):
        shared = shared.join(sizes.select(F.col("table_id").alias(f"{s}_table"), F.col("column_name").alias(f"{s}_column"), F.col("n").alias(f"{s}_n")), [f"{s}_table", f"{s}_column"])
    small, large = F.col("shared") / F.greatest("left_n", "right_n"), F.col("shared") / F.least("left_n", "right_n")
    score = 10 * name_similarity(F.col("left_column"), F.col("right_column")) + F.col("shared") + 20 * small + 5 * large
    return shared.withColumn("score", score).orderBy(F.desc("score"), "left_table", "left_column", "right_table", "right_column").limit(most)


def name_similarity(left: Column, right: Column) -> Column:
    """4 for equal names, else the Jaccard similarity of their words, with a bonus for a common last word."""
    a, b = F.split(F.lower(left), "[^a-z0-9]+"), F.split(F.lower(right), "[^a-z0-9]+")
    jaccard = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    bonus = F.when(F.element_at(a, -1) == F.element_at(b, -1), 0.5).otherwise(0.0)
    return F.when(F.lower(left) == F.lower(right), 4.0).otherwise(jaccard + bonus)


def estimated_join_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    a, b = left.groupBy(key).count(), right.groupBy(key).agg(F.count(F.lit(1)).alias("other"))
    return a.join(b, key).agg(F.coalesce(F.sum(F.col("count") * F.col("other")), F.lit(0)).alias("rows"))


MERGES = ("first_non_null", "last_non_null", "concat", "majority")


def merge_chunks(cells: DataFrame, how: str = "first_non_null", keys: tuple[str, ...] = ("parent_doc_id", "table_id", "record_key", "column_name"), order: str = "chunk_index") -> DataFrame:
    """One value per key from chunk values in order; ties of a majority go to the smallest text."""
    if how not in MERGES:
        raise ValueError(f"unknown merge {how!r}")
    known = cells.withColumn("_v", F.when(~is_none_value(F.col("value")), F.col("value")))
    if how == "first_non_null":
        return known.groupBy(*keys).agg(F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("value"))
    if how == "last_non_null":
        return known.groupBy(*keys).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("value"))
    if how == "concat":
        # distinct values first, so a long document's list holds each value once
        firsts = known.where("_v is not null").groupBy(*keys, "_v").agg(F.min(order).alias("_at"))
        listed = F.array_sort(F.collect_list(F.struct("_at", "_v")))
        return firsts.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["_v"]), " | ").alias("value"))
    counts = known.where("_v is not null").groupBy(*keys, "_v").count()
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("_v"))).alias("best"))
    return best.select(*keys, F.col("best._v").alias("value"))


def chunked_parents(docs: DataFrame, parent: str = "parent_doc_id") -> DataFrame:
    return docs.where(F.col(parent).isNotNull()).groupBy(parent).agg(F.count(F.lit(1)).alias("chunks")).where("chunks > 1")


def merged_row_id(record_id: Column, parent: Column, doc_id: Column, index: Column, several: Column) -> Column:
    return F.coalesce(record_id.cast("string"), F.when(several, F.concat_ws("#", parent.cast("string"), index.cast("string"))), parent.cast("string"), doc_id.cast("string"))


def active_records(records: Column) -> Column:
    return F.filter(records, lambda r: r["table"].isNotNull())


def updated_record(records: Column, index: int, attribute: str, value: Column) -> Column:
    """The records with one attribute of one record set."""
    return F.transform(
        records,
        lambda r, i: F.when(i == index, r.withField("data", F.map_concat(F.map_filter(r["data"], lambda k, _: k != attribute), F.create_map(F.lit(attribute), value)))).otherwise(r),
    )


def match_records(predicted: DataFrame, truth: DataFrame, required: dict[str, list[str]] | None = None) -> DataFrame:
    """Greedy one-to-one matching within a document and table, truth in order, each taking the free prediction with most equal cells.

    Both: doc_id, table_id, record_id, data map. With ``required``, cells of a table's required
    columns count, equal as values are (numbers, blanks, case), and of equally good predictions
    the one with more known cells is taken; without it, all of the truth's cells count, equal as
    texts. A document's records are one row's arrays; their number is what one text can hold.
    """

    def cells_of(rows: DataFrame, said: bool) -> DataFrame:
        """data as comparable texts: what values_equal takes for equal is one text, nulls are left out."""
        data = F.col("data")
        if required is not None:
            same = lambda v: F.coalesce(F.concat(F.lit("n:"), decimal_value(v).cast("string")), F.concat(F.lit("t:"), normal_text(v)))
            known = F.map_filter("data", lambda _, v: ~is_null_eval(v))
            data = F.transform_values(known, lambda _, v: same(v))
        return rows.select("doc_id", "table_id", F.lit(said).alias("_said"), F.struct(F.col("record_id").cast("string").alias("id"), data.alias("data")).alias("_r"))

    keys = ["doc_id", "table_id"]
    both = cells_of(predicted, True).unionByName(cells_of(truth, False)).groupBy(*keys)  # one shuffle; null keys are keys
    groups = both.agg(F.collect_list(F.when(F.col("_said"), F.col("_r"))).alias("_free"), F.collect_list(F.when(~F.col("_said"), F.col("_r"))).alias("_truth")).where(F.size("_truth") > 0)
    in_order = lambda a, b: F.when(a["id"].eqNullSafe(b["id"]), 0).when(a["id"].isNull(), 1).when(b["id"].isNull(), -1).when(a["id"] < b["id"], -1).otherwise(1)
    groups = groups.select(*keys, F.array_sort("_free", in_order).alias("_free"), F.array_sort("_truth", in_order).alias("_truth"))
    kind = "array<struct<record_id:string,predicted_id:string,equal_cells:bigint>>"
    if required is not None:
        wanted = F.lit(None).cast("array<string>")
        for name, columns in required.items():
            wanted = F.when(F.col("table_id") == name, F.array(*[F.lit(c) for c in columns]).cast("array<string>")).otherwise(wanted)
        groups = groups.withColumn("_wanted", F.coalesce(wanted, F.array().cast("array<string>")))

    def taken(state: Column, t: Column) -> Column:
        """The state after one record of the truth: the best prediction left the free ones."""
        asked = F.map_keys(t["data"]) if required is None else F.col("_wanted")
        equal = lambda p: F.size(F.filter(asked, lambda k: F.try_element_at(p["data"], k).eqNullSafe(F.try_element_at(t["data"], k))))
        known = lambda p: F.lit(0) if required is None else F.size(F.filter(asked, lambda k: F.map_contains_key(p["data"], k)))
        scored = F.transform(state["free"], lambda p, i: F.struct(equal(p).alias("equal"), known(p).alias("known"), (-i).alias("at"), p["id"].alias("id")))

        def after(best: Column) -> Column:
            row = F.struct(t["id"].alias("record_id"), best["id"].alias("predicted_id"), F.coalesce(best["equal"], F.lit(0)).cast("bigint").alias("equal_cells"))
            left = F.filter(state["free"], lambda _, i: F.coalesce(i != -best["at"], F.lit(True)))
            return F.struct(left.alias("free"), F.concat(state["rows"], F.array(row)).cast(kind).alias("rows"))

        return let(F.array_max(scored), after)

    start = F.struct(F.col("_free").alias("free"), F.array().cast(kind).alias("rows"))
    matched = groups.select(*keys, F.explode(F.aggregate("_truth", start, taken, lambda state: state["rows"])).alias("m"))
    return matched.select("doc_id", "table_id", "m.record_id", "m.predicted_id", "m.equal_cells")


def joined_documents(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", where: Column | None = None, most_rows: int | None = None) -> DataFrame | None:
    """``documents``: distinct documents of either side that take part in a join of two record tables (doc_id and columns each).

    Columns of the sides are ``l`` and ``r`` structs in ``where``. None if the join would have no
    rows, or more than ``most_rows``: its size is counted from the keys first.
    """
    l = left.select(F.struct(*left.columns).alias("l"), join_value(F.col(left_key)).alias("k"))  # noqa: E741
    r = right.select(F.struct(*right.columns).alias("r"), join_value(F.col(right_key)).alias("k"))
    if most_rows is not None:
        rows = estimated_join_rows(l.where("k is not null"), r.where("k is not null"), "k").first()["rows"]
        if not 0 < rows <= most_rows:
            return None
    both = l.join(r, "k", how)
    if where is not None:
        both = both.where(where)
    ids = both.select(F.explode(F.array_compact(F.array(F.col("l.doc_id").cast("string"), F.col("r.doc_id").cast("string")))).alias("id"))
    return ids.agg(F.countDistinct("id").alias("documents"))


def grouped_records(documents: DataFrame, records: DataFrame) -> DataFrame:
    """Records without chunk merging, one for each row id of a table; of equal row ids the last document's record stays.

    documents: doc_id, parent_doc_id, doc_pos; records: doc_id, table_id, record_id, data. The row id is the
    record's, else its parent and place where a document has several, else the parent or document.
    """
    rows = records.join(documents.select("doc_id", "parent_doc_id", "doc_pos"), "doc_id")
    mine = Window.partitionBy("doc_id", "table_id")
    rows = rows.withColumn("_i", F.row_number().over(mine.orderBy("record_id")) - 1).withColumn("_n", F.count(F.lit(1)).over(mine))
    given = F.when(F.col("record_id") != "0", F.col("record_id"))
    rows = rows.withColumn("row_id", merged_row_id(given, F.coalesce("parent_doc_id", "doc_id"), F.col("doc_id"), F.col("_i"), F.col("_n") > 1))
    return rows.groupBy("table_id", "row_id").agg(F.max_by(F.struct("doc_id", "data"), F.struct("doc_pos", "_i")).alias("_last")).select("table_id", "row_id", "_last.doc_id", "_last.data")


def row_id_of_document(source_row_id: Column, parent: Column) -> Column:
    """The document's own row id, else what follows the last dash of its parent's id."""
    return F.coalesce(source_row_id.cast("string"), F.nullif(F.regexp_extract(parent.cast("string"), r"-([^-]*)$", 1), F.lit("")))


def oversample(rows: DataFrame, label: str, order: str) -> DataFrame:
    """Rows of the smaller classes repeated, in order and round robin, up to the largest class's count."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    most = counts.agg(F.max("_n").alias("_most"))
    sizes = counts.crossJoin(most)  # as many rows as classes
    place = F.row_number().over(Window.partitionBy(label).orderBy(order)) - 1
    copies = F.floor((F.col("_most") - 1 - F.col("_place")) / F.col("_n")) + 1
    return rows.withColumn("_place", place).join(F.broadcast(sizes), label).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("_place", "_n", "_most", "_copy")
