"""The engine's queries over the driver tables and their DuckDB oracles; ``catalog_runtime`` holds more of them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenar.functions import evidence
from lumenar.functions import values as V
from lumenar.operators import adaptive, alpha_table, cascade, curation, filters, metrics, proxies, ranks, relational, segments, similarity, stop_points
from lumenar.operators.predicates import all_of, compile_predicate
from lumenar.plans import answers, runtime
from lumenar.plans.registry import ORACLES, QUERIES, query
from lumenar.plans.sqlx import Predicate, analyse, table_order
from lumenar.sources import datasets, sinks
from lumenar.storage import table, written
from lumenar.streaming import windows

# --- sources ---------------------------------------------------------------------------


@query("SELECT * FROM nation")
def default_query_all_columns(s, d):
    return table(s, d, "nation")


@query("SELECT doc_id, lang, n_chars FROM documents")
def scan_documents_projection(s, d):
    return table(s, d, "documents").select("doc_id", "lang", "n_chars")


PART_COLUMNS = ["p_name", "p_brand", "p_type", "p_size"]


def part_cells(s, d):
    cells = datasets.unpivot_cells(table(s, d, "part"), "p_partkey", PART_COLUMNS)
    return cells.select(F.col("p_partkey").cast("string").alias("doc_id"), F.lit("part").alias("table_id"), F.lit(None).cast("string").alias("record_id"), F.lit(None).cast("string").alias("source_row_id"), "column_name", "value")


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part")
def eav_pivot_records(s, d):
    return datasets.relation(datasets.records_of(part_cells(s, d), "column_name"), "part", PART_COLUMNS).drop("row_id").withColumnRenamed("__doc_id", "doc_id")


@query("SELECT c.c_nationkey AS k, list_sort(list_distinct(list(t))) [1] AS first_table, len(list_distinct(list(t))) AS tables, CASE WHEN len(list_distinct(list(t))) = 1 THEN min(t) END AS only_table FROM (SELECT c_nationkey, 'customer' AS t FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier) c GROUP BY 1")
def provenance_single_table_flag(s, d):
    rows = table(s, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("t")).unionByName(table(s, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("t")))
    out = datasets.table_provenance(rows, "k", "t")
    return out.select("k", F.col("schema_tables")[0].alias("first_table"), F.size("schema_tables").cast("long").alias("tables"), F.col("schema_table").alias("only_table"))


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def contract_orphan_ids(s, d):
    return datasets.orphans(table(s, d, "labels"), table(s, d, "documents").where("lang = 'en'"), "doc_id")


@query("SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g')), '^_+|_+$', '', 'g')) AS ident FROM part")
def identifier_normalise(s, d):
    return table(s, d, "part").select("p_partkey", V.identifier(F.col("p_name")).alias("ident"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= 50 THEN 'train' ELSE 'test' END AS split FROM documents")
def split_prefix(s, d):
    return datasets.split_ids(table(s, d, "documents").select("doc_id"), 50, "prefix")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha256(concat('42:', doc_id))) <= 50 THEN 'train' ELSE 'test' END AS split FROM documents")
def split_hash(s, d):
    return datasets.split_ids(table(s, d, "documents").select("doc_id"), 50, "hash")


@query("SELECT o_orderkey, kind, val FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders) UNPIVOT (val FOR kind IN (o_orderstatus, o_orderpriority))")
def gt_build_unpivot(s, d):
    return datasets.unpivot_cells(table(s, d, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"], "kind", "val")


@query("WITH m AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer), k AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier) SELECT c_custkey, k.s_suppkey AS row_id FROM m LEFT JOIN k ON m.c_nationkey = k.s_nationkey AND m.n = k.n")
def positional_row_fill(s, d):
    docs = table(s, d, "customer").select(F.col("c_custkey").alias("doc_pos"), F.col("c_nationkey").alias("source_table"), F.lit(None).cast("long").alias("source_row_id"))
    truth = table(s, d, "supplier").select(F.col("s_nationkey").alias("source_table"), F.col("s_suppkey").alias("row_id"))
    return datasets.positional_fill(docs, truth).select(F.col("doc_pos").alias("c_custkey"), F.col("source_row_id").alias("row_id"))


# --- predicates ------------------------------------------------------------------------


def _predicate(name: str, tbl: str, key: str, p: Predicate, sql: str) -> None:
    column = p.attribute

    def run(s: SparkSession, d: str) -> DataFrame:
        return table(s, d, tbl).where(compile_predicate(p, F.col(column))).select(key)

    query(f"SELECT {key} FROM {tbl} WHERE {sql}", name)(run)


_predicate("pred_eq_ci", "customer", "c_custkey", Predicate("c_mktsegment", "=", "building"), "lower(c_mktsegment) = 'building'")
_predicate("pred_neq_null_false", "part", "p_partkey", Predicate("p_brand", "<>", "Brand#12"), "lower(p_brand) <> 'brand#12'")
_predicate("pred_numeric_on_text", "part", "p_partkey", Predicate("p_size", ">", "25"), "TRY_CAST(CAST(p_size AS VARCHAR) AS DOUBLE) > 25")
_predicate("pred_like_ci", "part", "p_partkey", Predicate("p_name", "LIKE", "%A%"), "p_name ILIKE '%A%'")
_predicate("pred_not_like", "part", "p_partkey", Predicate("p_name", "NOT LIKE", "%re%"), "p_name NOT ILIKE '%re%'")
_predicate("pred_in_list", "lineitem", "l_orderkey", Predicate("l_returnflag", "IN", ["A", "r"]), "lower(l_returnflag) IN ('a', 'r')")
_predicate("pred_not_in_list", "lineitem", "l_orderkey", Predicate("l_returnflag", "NOT IN", ["A", "R"]), "lower(l_returnflag) NOT IN ('a', 'r')")
_predicate("pred_between", "lineitem", "l_orderkey", Predicate("l_quantity", "BETWEEN", [10, 20]), "l_quantity BETWEEN 10 AND 20")
_predicate("pred_contains", "documents", "doc_id", Predicate("text", "CONTAINS", "the"), "contains(lower(text), 'the')")
_predicate("pred_is_not_null", "documents", "doc_id", Predicate("lang", "IS NOT NULL", None), "trim(lang) <> ''")
_predicate("pred_is_null", "documents", "doc_id", Predicate("lang", "IS NULL", None), "lang IS NULL OR trim(lang) = ''")

WORDS = "(SELECT 'NA' AS v UNION ALL SELECT ' n/a ' UNION ALL SELECT 'unknown' UNION ALL SELECT 'ok' UNION ALL SELECT NULL UNION ALL SELECT '')"


@query(f"SELECT count(*) FILTER (v IS NULL OR lower(trim(v)) IN {V.LOADER_NULLS}) AS loader, count(*) FILTER (v IS NULL OR lower(trim(v)) IN {V.EVALUATION_NULLS}) AS evaluation FROM (SELECT v FROM {WORDS}, nation)")
def pred_null_words(s, d):
    words = s.createDataFrame([("NA",), (" n/a ",), ("unknown",), ("ok",), (None,), ("",)], "v string")
    return table(s, d, "nation").select("n_nationkey").crossJoin(F.broadcast(words)).agg(F.count_if(V.is_none_value(F.col("v"))).alias("loader"), F.count_if(V.is_null_eval(F.col("v"))).alias("evaluation"))


PUSHED = "SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderstatus = 'F' AND o.o_totalprice > 100000"
SCHEMA = {"customer": ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]}


@query(PUSHED)
def rowsafe_pushdown_equivalence(s, d):
    plan = analyse(PUSHED, SCHEMA)
    rows = {t: table(s, d, t).where(all_of(plan.safe.get(t, []))) for t in table_order(plan)}
    (j,) = plan.joins
    return rows[j.parent[0]].join(rows[j.child[0]], F.col(j.parent[1]) == F.col(j.child[1])).select("c_name", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE lower(o_orderpriority) = '1-urgent' AND o_totalprice IS NOT NULL")
def post_query_output(s, d):
    return answers.post_query_output(table(s, d, "orders"), [Predicate("o_orderpriority", "=", "1-URGENT")], ["o_orderkey", "o_totalprice"])


FLAG_SQL = "SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderstatus = 'F'"


@query("SELECT c.c_name, CAST(o.o_orderkey AS VARCHAR) AS o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderstatus = 'F'")
def flagship_extract_join_answer(s, d):
    """Parse, push safe predicates, reduce by keys both ways, then extract cells, rebuild relations and run the SQL."""
    plan = analyse(FLAG_SQL, SCHEMA)
    rows = {t: table(s, d, t).select(*SCHEMA[t]).where(all_of(plan.safe.get(t, []))) for t in table_order(plan, selective_first=True)}
    (j,) = plan.joins
    parent, child = j.parent[0], j.child[0]
    rows[parent], rows[child] = relational.reduce_both_ways(rows[parent], j.parent[1], rows[child], j.child[1])
    cells = None
    for t, df in rows.items():
        key = SCHEMA[t][0]
        long = datasets.unpivot_cells(df.withColumn("_id", F.col(key)), "_id", SCHEMA[t]).select(
            F.concat_ws("-", F.lit(t), F.col("_id").cast("string")).alias("doc_id"), F.lit(t).alias("table_id"), F.col("_id").cast("string").alias("record_id"), F.lit(None).cast("string").alias("source_row_id"), "column_name", "value"
        )
        cells = long if cells is None else cells.unionByName(long)
    records = datasets.records_of(cells, "column_name")
    sinks.publish_relations(records, [{"Schema Name": t, "Attributes": [{"Attribute Name": a} for a in SCHEMA[t]]} for t in SCHEMA], "flag_")
    return s.sql(re.sub(r"\b(customer|orders)\b", r"flag_\1", FLAG_SQL))


# --- SQL over tables of records: joins, sets, groups -----------------------------------


def table_records(s: SparkSession, d: str, columns: dict[str, list[str]]) -> DataFrame:
    """The tables' rows as records of text cells, a document each."""
    out = None
    for t, names in columns.items():
        data = F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.col(c).cast("string") for c in names]))
        place = F.monotonically_increasing_id().cast("string")
        rows = table(s, d, t).select(F.concat_ws("-", F.lit(t), place).alias("doc_id"), F.lit(t).alias("table_id"), place.alias("record_id"), data.alias("data"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _answered(name: str, sql: str, **columns: str) -> None:
    """A query whose tables are assembled from records of text, typed as declared, before Spark answers its SQL."""
    need = {t: c.split() for t, c in columns.items()}

    def run(s: SparkSession, d: str) -> DataFrame:
        declared = {t: {c: "text" if kind == "string" else kind for c, kind in table(s, d, t).dtypes if kind in ("string", *answers.DECLARED)} for t in need}
        return answers.answer(table_records(s, d, need), sql, need, declared)

    query(sql, name)(run)


for _how in ("INNER", "LEFT", "RIGHT", "FULL"):
    _answered(f"join_{_how.lower()}", f"SELECT c_custkey, o_orderkey FROM customer {_how} JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000", customer="c_custkey", orders="o_orderkey o_custkey o_totalprice")
_answered("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region", nation="n_name", region="r_name")
_answered("join_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", customer="c_custkey", orders="o_custkey o_totalprice")
_answered("join_three_way", "SELECT r_name, n_name, c_name FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey", region="r_regionkey r_name", nation="n_nationkey n_regionkey n_name", customer="c_nationkey c_name")
_answered("sql_group_having", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY o_custkey HAVING count(*) > 12", orders="o_custkey o_totalprice")
_answered("sql_count_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) > 3", lineitem="l_suppkey l_partkey")
_answered("sql_avg_cast", "SELECT p_brand, round(avg(CAST(p_size AS DOUBLE)), 4) AS size FROM part GROUP BY p_brand", part="p_brand p_size")
_answered("sql_column_comparison", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount < l_tax AND l_quantity < 10", lineitem="l_orderkey l_linenumber l_discount l_tax l_quantity")
_answered("orderby_limit_tiebreak", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10", orders="o_custkey")
_answered("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", customer="c_nationkey", supplier="s_nationkey")
_answered("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", customer="c_nationkey", supplier="s_nationkey")
_answered("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier", nation="n_nationkey", supplier="s_nationkey")
_answered("set_except_all", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer", orders="o_custkey", customer="c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def join_semi_forward(s, d):
    return relational.reduce_by_keys(table(s, d, "orders"), "o_custkey", relational.key_values(table(s, d, "customer").where("c_mktsegment = 'BUILDING'"), "c_custkey")).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join_semi_reverse(s, d):
    return relational.reduce_by_keys(table(s, d, "customer"), "c_custkey", relational.key_values(table(s, d, "orders").where("o_orderstatus = 'F'"), "o_custkey")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(s, d):
    return datasets.orphans(table(s, d, "customer"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS key FROM orders WHERE o_totalprice > 250000")
def join_keys_distinct(s, d):
    return relational.key_values(table(s, d, "orders").where("o_totalprice > 250000"), "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'none such')")
def join_empty_short_circuit(s, d):
    return relational.reduce_by_keys(table(s, d, "orders"), "o_custkey", relational.key_values(table(s, d, "customer").where("c_mktsegment = 'none such'"), "c_custkey")).select("o_orderkey")


@query("SELECT CAST(sum(c.n * o.n) AS BIGINT) AS rows FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) o USING (k)")
def bounded_join_estimate(s, d):
    return relational.estimated_join_rows(table(s, d, "customer").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").select(F.col("s_nationkey").alias("k")), "k")


PAIR_CELLS = {"customer": ["c_custkey", "c_nationkey"], "nation": ["n_nationkey", "n_regionkey"], "region": ["r_regionkey"]}


@query(
    "WITH v AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, CAST({c} AS VARCHAR) AS v FROM {t}" for t, cs in PAIR_CELLS.items() for c in cs) + ") WHERE v IS NOT NULL)"
    " SELECT a.t AS left_table, a.c AS left_column, b.t AS right_table, b.c AS right_column, count(*) AS shared FROM v a JOIN v b ON a.v = b.v AND a.t < b.t GROUP BY ALL"
)
def join_pair_inference(s, d):
    cells = None
    for t, columns in PAIR_CELLS.items():
        keyed = table(s, d, t).withColumn("_k", F.lit(0))
        long = datasets.unpivot_cells(keyed, "_k", columns).select(F.lit(t).alias("table_id"), "column_name", "value")
        cells = long if cells is None else cells.unionByName(long)
    return relational.join_pairs(cells).select("left_table", "left_column", "right_table", "right_column", "shared")


@query(None)
def record_matching_greedy(s, d):
    cells = part_cells(s, d).where("column_name <> 'p_name'")
    truth = datasets.records_of(cells, "column_name")
    said = datasets.records_of(cells.withColumn("value", F.when((F.crc32(F.col("doc_id").cast("binary")) % 3 == 0) & (F.col("column_name") == "p_size"), "0").otherwise(F.col("value"))), "column_name")
    return relational.match_records(said, truth)


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') OR lang IS NULL")
def relevance_filter_metadata(s, d):
    docs = table(s, d, "documents").withColumn("schema_tables", F.when(F.col("lang").isNotNull(), F.array("lang")))
    return relational.keep_by_tables(docs, ["en", "de"]).select("doc_id")


# --- evaluation ------------------------------------------------------------------------

ANSWERS = "SELECT c_nationkey AS a, c_mktsegment AS b FROM customer"
PREDICTED = "SELECT c_nationkey AS a, CASE WHEN c_custkey % 7 = 0 THEN 'MACHINERY' ELSE c_mktsegment END AS b FROM customer WHERE c_custkey % 11 <> 0"


def _answers(s, d):
    c = table(s, d, "customer")
    said = c.where("c_custkey % 11 <> 0").select(F.col("c_nationkey").alias("a"), F.when(F.col("c_custkey") % 7 == 0, "MACHINERY").otherwise(F.col("c_mktsegment")).alias("b"))
    return c.select(F.col("c_nationkey").alias("a"), F.col("c_mktsegment").alias("b")), said


@query(
    f"WITH t AS (SELECT a, b, count(*) AS n FROM ({ANSWERS}) GROUP BY ALL), p AS (SELECT a, b, count(*) AS n FROM ({PREDICTED}) GROUP BY ALL),"
    " c AS (SELECT coalesce(sum(least(t.n, p.n)), 0) AS common FROM t JOIN p USING (a, b)), x AS (SELECT (SELECT sum(n) FROM t) AS tr, (SELECT sum(n) FROM p) AS pr, common FROM c)"
    " SELECT CAST(tr AS BIGINT) AS truth_rows, CAST(pr AS BIGINT) AS predicted_rows, CAST(common AS BIGINT) AS common, round(common / tr, 6) AS recall, round(common / pr, 6) AS precision FROM x"
)
def answer_bag_recall(s, d):
    return metrics.answer_bags(*_answers(s, d)).withColumn("recall", F.round("recall", 6)).withColumn("precision", F.round("precision", 6))


@query(f"SELECT *, 'missing' AS side FROM ({ANSWERS} EXCEPT ALL {PREDICTED}) UNION ALL SELECT *, 'extra' FROM ({PREDICTED} EXCEPT ALL {ANSWERS})")
def answer_missing_extra(s, d):
    return metrics.missing_and_extra(*_answers(s, d))


@query(
    "WITH t AS (SELECT p_partkey, column_name, value FROM (SELECT p_partkey, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part) UNPIVOT (value FOR column_name IN (p_name, p_brand, p_size))),"
    " p AS (SELECT p_partkey, column_name, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'wrong' ELSE value END AS got FROM t)"
    " SELECT CASE column_name WHEN 'p_name' THEN 'answer' WHEN 'p_brand' THEN 'predicate' ELSE 'other' END AS role, count(*) AS total, count(*) FILTER (got = value) AS covered,"
    " count(*) FILTER (got IS NULL) AS missing, count(*) FILTER (got <> value) AS mismatched FROM t JOIN p USING (p_partkey, column_name) GROUP BY 1"
)
def cell_recall_layers(s, d):
    t = datasets.unpivot_cells(table(s, d, "part"), "p_partkey", ["p_name", "p_brand", "p_size"])
    p = t.withColumn("value", F.when(F.col("p_partkey") % 5 == 0, F.lit(None)).when(F.col("p_partkey") % 7 == 0, "wrong").otherwise(F.col("value")))
    return metrics.cell_recall(t, p, ["p_partkey"], {"p_name": "answer", "p_brand": "predicate"}).drop("recall")


LABELLED = "SELECT doc_id, toxic, quality, CAST(doc_id % 10 AS DOUBLE) / 10 AS s1, CAST(doc_id % 7 AS DOUBLE) / 7 AS s2, CAST(doc_id % 3 AS DOUBLE) / 3 AS s3 FROM labels"


def labelled(s, d):
    return table(s, d, "labels").selectExpr("doc_id", "toxic", "quality", "CAST(doc_id % 10 AS DOUBLE) / 10 AS s1", "CAST(doc_id % 7 AS DOUBLE) / 7 AS s2", "CAST(doc_id % 3 AS DOUBLE) / 3 AS s3")


@query(
    f"WITH c AS (SELECT count(*) FILTER (quality = 1 AND p = 1) AS tp, count(*) FILTER (quality <> 1 AND p = 1) AS fp, count(*) FILTER (quality = 1 AND p <> 1) AS fn, count(*) FILTER (quality <> 1 AND p <> 1) AS tn FROM (SELECT *, CASE WHEN s1 >= 0.5 THEN 1 ELSE 0 END AS p FROM ({LABELLED}))),"
    " r AS (SELECT *, tp / (tp + fp) AS pr, tp / (tp + fn) AS rc FROM c) SELECT tp, fp, fn, tn, round(pr, 6) AS precision, round(rc, 6) AS recall, round(2 * pr * rc / (pr + rc), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM r"
)
def confusion_metrics(s, d):
    out = metrics.confusion(labelled(s, d).withColumn("p", (F.col("s1") >= 0.5).cast("int")), "quality", "p")
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query(f"WITH l AS ({LABELLED}) SELECT round(sum(CASE WHEN a.s1 > b.s1 THEN 1.0 WHEN a.s1 = b.s1 THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM l a, l b WHERE a.quality = 1 AND b.quality <> 1")
def roc_auc(s, d):
    return metrics.roc_auc(labelled(s, d), "quality", "s1").select(F.round("auc", 6).alias("auc"))


@query(f"SELECT doc_id, CAST((s1 >= 0.5)::INT + (s2 >= 0.5)::INT + (s3 >= 0.5)::INT >= 2 AS INTEGER) AS vote FROM ({LABELLED})")
def voting_hard(s, d):
    return labelled(s, d).select("doc_id", metrics.votes([F.col("s1"), F.col("s2"), F.col("s3")], "hard").alias("vote"))


@query(f"SELECT doc_id, CAST((s1 + s2 + s3) / 3 >= 0.5 AS INTEGER) AS vote FROM ({LABELLED})")
def voting_soft(s, d):
    return labelled(s, d).select("doc_id", metrics.votes([F.col("s1"), F.col("s2"), F.col("s3")], "soft").alias("vote"))


_HALF = " + ".join(f"(CASE WHEN s{i} >= 0.5 THEN 1.0 WHEN s{i} >= 0.25 THEN 0.5 ELSE 0 END)" for i in (1, 2, 3))


@query(f"SELECT doc_id, CAST(({_HALF}) * 2 >= 3 AS INTEGER) AS vote FROM ({LABELLED})")
def voting_half(s, d):
    return labelled(s, d).select("doc_id", metrics.votes([F.col("s1"), F.col("s2"), F.col("s3")], "half").alias("vote"))


_V = ", ".join(f"CAST(s{i} >= 0.5 AS INTEGER) AS v{i}" for i in (1, 2, 3))


@query(
    f"SELECT round(avg(((v1 <> quality)::INT + (v2 <> quality)::INT + (v3 <> quality)::INT) / 3), 6) AS mean_error, round(avg(((v1 <> v2)::INT + (v1 <> v3)::INT + (v2 <> v3)::INT) / 3), 6) AS disagreement,"
    f" round(avg(CAST((v1 <> quality)::INT + (v2 <> quality)::INT + (v3 <> quality)::INT >= 2 AS INTEGER)), 6) AS majority_error FROM (SELECT *, {_V} FROM ({LABELLED}))"
)
def majority_vote_error(s, d):
    rows = labelled(s, d).selectExpr("quality", *[f"CAST(s{i} >= 0.5 AS INTEGER) AS v{i}" for i in (1, 2, 3)])
    return metrics.majority_error(rows, "quality", ["v1", "v2", "v3"]).select(*[F.round(c, 6).alias(c) for c in ("mean_error", "disagreement", "majority_error")])


@query(
    f"WITH v AS (SELECT t.threshold, quality, (s1 >= threshold)::INT + (s2 >= threshold)::INT + (s3 >= threshold)::INT AS ones FROM ({LABELLED}), (SELECT unnest([0.2, 0.4, 0.6])::DOUBLE AS threshold) t)"
    " SELECT threshold, least(least(ones, 3 - ones), 3) AS bucket, count(*) AS n, round(avg(CAST((ones * 2 >= 3)::INT <> quality AS INTEGER)), 6) AS error_rate FROM v GROUP BY ALL"
)
def disagreement_buckets(s, d):
    return metrics.disagreement_buckets(labelled(s, d), "quality", ["s1", "s2", "s3"], [0.2, 0.4, 0.6]).withColumn("error_rate", F.round("error_rate", 6))


# --- chunks and merges -----------------------------------------------------------------

TURNS = "SELECT conv_id AS parent_doc_id, turn AS chunk_index, CASE WHEN turn % 3 = 0 THEN 'none' ELSE concat(role, CAST(turn % 4 AS VARCHAR)) END AS value FROM conversations"
KNOWN = f"SELECT * FROM ({TURNS}) WHERE value <> 'none'"
PARENTS = f"SELECT DISTINCT parent_doc_id FROM ({TURNS})"


def turns(s, d):
    value = F.when(F.col("turn") % 3 == 0, "none").otherwise(F.concat("role", (F.col("turn") % 4).cast("string")))
    return table(s, d, "conversations").select(F.col("conv_id").alias("parent_doc_id"), F.col("turn").alias("chunk_index"), value.alias("value"))


def _merge(name: str, how: str, sql: str) -> None:
    query(sql, name)(lambda s, d: relational.merge_chunks(turns(s, d), how, ("parent_doc_id",)))


_merge("chunk_merge_first", "first_non_null", f"SELECT parent_doc_id, k.value FROM ({PARENTS}) LEFT JOIN (SELECT parent_doc_id, arg_min(value, chunk_index) AS value FROM ({KNOWN}) GROUP BY 1) k USING (parent_doc_id)")
_merge("chunk_merge_last", "last_non_null", f"SELECT parent_doc_id, k.value FROM ({PARENTS}) LEFT JOIN (SELECT parent_doc_id, arg_max(value, chunk_index) AS value FROM ({KNOWN}) GROUP BY 1) k USING (parent_doc_id)")
_merge("chunk_merge_concat", "concat", f"SELECT parent_doc_id, string_agg(value, ' | ' ORDER BY a) AS value FROM (SELECT parent_doc_id, value, min(chunk_index) AS a FROM ({KNOWN}) GROUP BY 1, 2) GROUP BY 1")
_merge("chunk_merge_majority", "majority", f"SELECT parent_doc_id, value FROM (SELECT parent_doc_id, value, row_number() OVER (PARTITION BY parent_doc_id ORDER BY count(*) DESC, value) AS r FROM ({KNOWN}) GROUP BY 1, 2) WHERE r = 1")


@query("SELECT conv_id AS parent_doc_id, count(*) AS chunks FROM conversations GROUP BY 1 HAVING count(*) > 1")
def chunking_detection(s, d):
    return relational.chunked_parents(table(s, d, "conversations").select(F.col("conv_id").alias("parent_doc_id")))


@query("SELECT concat(doc_id, '-', i) AS doc_id, i AS chunk_index, substring(text, CAST(i * 900 + 1 AS BIGINT), 1000) AS doc_text FROM (SELECT doc_id, text, CAST(unnest(range(0, greatest(CAST(floor((length(text) - 101) / 900) AS BIGINT), 0) + 1)) AS INTEGER) AS i FROM documents)")
def char_chunks_overlap(s, d):
    docs = table(s, d, "documents").select("doc_id", F.col("text").alias("doc_text"))
    return sinks.chunk_documents(docs, V.char_chunks(F.col("doc_text"), 1000, 100)).select("doc_id", "chunk_index", "doc_text")


@query("WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents) SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, array_to_string(ws[i * 90 + 1 : i * 90 + 100], ' ') AS chunk FROM (SELECT doc_id, ws, unnest(range(0, greatest(CAST(floor((len(ws) - 11) / 90) AS BIGINT), 0) + 1)) AS i FROM w)")
def token_chunks(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(V.token_chunks(F.col("text"), 100, 10)).alias("chunk_index", "chunk"))


# --- cascade, calibration --------------------------------------------------------------


def _proxies():
    return [
        cascade.Proxy("length", F.least(F.col("n_chars") / 2000, F.lit(1.0)), 0.3, cost=1.0, pass_rate=0.7),
        cascade.Proxy("the", F.when(F.lower("text").contains("the"), 1.0).otherwise(0.0), 0.5, cost=2.0, pass_rate=0.6),
        cascade.Proxy("source", F.when(F.col("source").endswith("0"), 0.2).otherwise(0.8), 0.5, cost=0.5, pass_rate=0.9),
    ]


_REJECT = (
    "SELECT doc_id, n_chars, lang, text, CASE WHEN least(n_chars / 2000, 1.0) < 0.3 THEN 0 WHEN NOT contains(lower(text), 'the') THEN 1 WHEN source LIKE '%0' THEN 2 END AS r FROM documents"
)


@query(
    "WITH m AS (SELECT count(*) AS n, count_if(least(n_chars / 2000, 1.0) >= 0.3) AS l, count_if(contains(lower(text), 'the')) AS t, count_if(NOT (source LIKE '%0')) AS s FROM documents), "
    "p AS (SELECT 0 AS k, 'length' AS proxy, CAST(1 AS DOUBLE) AS cost, l / n AS pass_rate FROM m UNION ALL SELECT 1, 'the', 2, t / n FROM m UNION ALL SELECT 2, 'source', 0.5, s / n FROM m) "
    "SELECT CAST(row_number() OVER (ORDER BY (1 - pass_rate) / cost DESC, k) - 1 AS INTEGER) AS position, proxy, cost, pass_rate FROM p"
)
def order_by_rejection_efficiency(s, d):
    """The order by pass rates measured over all documents."""
    measured = proxies.observed_pass_rates(table(s, d, "documents"), _proxies())
    return s.createDataFrame([(i, p.name, p.cost, p.pass_rate) for i, p in enumerate(cascade.ordered(measured))], "position int, proxy string, cost double, pass_rate double")


@query(
    f"WITH d AS ({_REJECT}) SELECT CAST(i AS INTEGER) AS position, ['length', 'the', 'source'][i + 1] AS proxy, count(*) FILTER (r IS NULL OR r >= i) AS evaluated, count(*) FILTER (r IS NULL OR r > i) AS passed, count(*) FILTER (r = i) AS rejected,"
    " count(*) FILTER ((r IS NULL OR r >= i) AND lang = 'en') AS relevant, count(*) FILTER ((r IS NULL OR r > i) AND lang = 'en') AS relevant_passed FROM d, (SELECT unnest([0, 1, 2]) AS i) GROUP BY i"
)
def proxy_stats_cascade(s, d):
    done = cascade.run(table(s, d, "documents"), _proxies())
    return cascade.statistics(done, _proxies(), F.col("lang") == "en").drop("avg_score", "recall", "rejection_rate")


@query(f"SELECT doc_id FROM ({_REJECT}) WHERE r IS NULL AND lang <> 'en' ORDER BY doc_id DESC LIMIT 1000")
def hard_negatives(s, d):
    return cascade.hard_negatives(cascade.run(table(s, d, "documents"), _proxies()), F.col("lang") == "en", F.col("doc_id")).select("doc_id")


@query(
    "WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL), l AS (SELECT DISTINCT n, least(1.0, ceil((n + 1) * CAST(0.95 AS DOUBLE)) / n) * (n - 1) AS place FROM r)"
    " SELECT l.n, a.value + (place - floor(place)) * (b.value - a.value) AS threshold FROM l JOIN r a ON a.i = floor(place) JOIN r b ON b.i = least(floor(place) + 1, l.n - 1)"
)
def conformal_threshold(s, d):
    return cascade.conformal_threshold(table(s, d, "events"), "value", 0.05)


@query("SELECT round(quantile_cont(value, 0.95), 4) AS q95, round(-quantile_cont(-value, 0.95), 4) AS s95 FROM events")
def conformal_quantiles(s, d):
    e = table(s, d, "events").select("value", cascade.nonconformity(F.col("value")).alias("nc"))
    n = e.where("value is not null").count()
    return s.createDataFrame([(round(ranks.quantile(e, "value", 0.95, n), 4), round(-ranks.quantile(e, "nc", 0.95, n), 4))], "q95 double, s95 double")


@query("WITH p AS (SELECT n_chars / 1000 AS v FROM documents), n AS (SELECT count(*) AS n FROM p) SELECT round(v, 6) AS threshold FROM (SELECT v, row_number() OVER (ORDER BY v) AS r FROM p), n WHERE r = least(floor(0.1 * n + 1e-9), n - 1) + 1")
def target_recall_order_statistic(s, d):
    scores = table(s, d, "documents").select((F.col("n_chars") / 1000).alias("v"))
    return s.createDataFrame([(round(cascade.recall_threshold(scores, "v", 0.9), 6),)], "threshold double")


@query("SELECT doc_id, CASE WHEN len(y) = 0 THEN 0.5 WHEN len(list_filter(y, lambda v: CAST(v AS INTEGER) >= 1950)) > 0 THEN 1.0 ELSE 0.0 END AS score FROM (SELECT doc_id, regexp_extract_all(text, '\\b(?:19|20)\\d{2}\\b') AS y FROM documents)")
def heuristic_scores(s, d):
    y = V.years(F.col("text"))
    return table(s, d, "documents").select("doc_id", cascade.heuristic_score(F.col("text"), y, F.exists(y, lambda v: v >= 1950)).alias("score"))


#: Scores of two stages on orders: ties in both, nulls in one.
_DOC_SCORE, _PREDICATE_SCORE = "o_totalprice", "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey % 97 END"
_ALPHAS = [0.0, 0.01, 0.02, 0.05, 0.1]


def _alpha_sql(predicate_alphas: list[float]) -> str:
    """Documents over both cuts of every pair of alphas: cuts by rank, counts by comparison."""
    return f"""
s AS MATERIALIZED (SELECT o_orderkey, o_custkey, CAST({_DOC_SCORE} AS DOUBLE) AS d, CAST({_PREDICATE_SCORE} AS DOUBLE) AS p FROM orders),
rd AS (SELECT d AS v, row_number() OVER (ORDER BY d) - 1 AS r, count(*) OVER () AS n FROM s WHERE d IS NOT NULL),
rp AS (SELECT p AS v, row_number() OVER (ORDER BY p) - 1 AS r, count(*) OVER () AS n FROM s WHERE p IS NOT NULL),
ad AS (SELECT unnest({_ALPHAS}::DOUBLE[]) AS a), ap AS (SELECT unnest({predicate_alphas}::DOUBLE[]) AS a),
cd AS (SELECT a, CASE WHEN a <= 0 THEN '-inf'::DOUBLE ELSE (SELECT v FROM rd WHERE r = least(floor(a * n + 1e-9), n - 1)) END AS cut FROM ad),
cp AS (SELECT a, CASE WHEN a <= 0 THEN '-inf'::DOUBLE ELSE (SELECT v FROM rp WHERE r = least(floor(a * n + 1e-9), n - 1)) END AS cut FROM ap)"""


@query(
    f"WITH {_alpha_sql(_ALPHAS)}, a AS (SELECT o_custkey, min(d) AS d, CASE WHEN count(p) = count(*) THEN min(p) END AS p FROM s GROUP BY 1)"
    " SELECT cd.a AS doc_alpha, cp.a AS predicate_alpha, (SELECT count(*) FROM s WHERE d >= cd.cut AND p >= cp.cut) AS cost, (SELECT count(*) FROM a WHERE d >= cd.cut AND p >= cp.cut) AS answers FROM cd, cp"
)
def alpha_costs_and_answers(s, d):
    """What every pair of alphas costs, and how many answers (a customer's orders together) it keeps."""
    orders = table(s, d, "orders")
    ranked = alpha_table.alpha_table(orders, F.col(_DOC_SCORE), F.expr(_PREDICATE_SCORE), _ALPHAS, _ALPHAS, "o_orderkey")
    costs, (kept, _) = ranked.costs(), ranked.answers(orders.select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey")
    return s.createDataFrame([(*k, costs[k], kept[k]) for k in costs], "doc_alpha double, predicate_alpha double, cost long, answers long")


@query(None)
def alpha_greedy(s, d):
    """A query's alphas: greedy by savings, then by the answers that they keep; every probe is read from one table."""
    orders = table(s, d, "orders")
    sources = orders.select("o_orderkey", F.col("o_custkey").alias("answer"))
    plan = alpha_table.plan_of_query(orders, F.col(_DOC_SCORE), F.expr(_PREDICATE_SCORE), _ALPHAS, 0.9, sources, "o_orderkey")
    return s.createDataFrame([(plan.alphas["doc"], plan.alphas["predicate"], plan.cost, len(plan.steps))], "doc double, predicate double, cost double, steps int")


@query(
    "WITH c AS (SELECT toxic, count(*) AS n, row_number() OVER (ORDER BY toxic) - 1 AS q FROM labels GROUP BY 1), a AS (SELECT unnest([0, 1, 2]) AS i),"
    " o AS (SELECT q, i, CAST(floor(n * (1 - [0.0, 0.05, 0.1][i + 1])) AS BIGINT) AS covered, n, [0.0, 0.05, 0.1][i + 1] AS alpha FROM c, a),"
    " b AS (SELECT x.i AS i0, y.i AS i1, (x.covered + y.covered) / (x.n + y.n) AS rate, x.alpha + y.alpha AS total FROM o x, o y WHERE x.q = 0 AND y.q = 1),"
    " w AS (SELECT * FROM b ORDER BY round(abs(rate - 0.95), 12), rate < 0.95, total, i0, i1 LIMIT 1)"
    " SELECT CAST(0 AS INTEGER) AS query, CAST(i0 AS INTEGER) AS choice FROM w UNION ALL SELECT 1, i1 FROM w"
)
def alpha_global_dp(s, d):
    counts = table(s, d, "labels").groupBy("toxic").count().orderBy("toxic").collect()  # two labels
    options = [[(a, int(r["count"] * (1 - a)), r["count"]) for a in (0.0, 0.05, 0.1)] for r in counts]
    return s.createDataFrame([(i, p) for i, p in enumerate(cascade.global_choice(options, 0.95))], "query int, choice int")


# --- similarity and sampling -----------------------------------------------------------


def _vector(s, d, vec_id=0):
    return [float(x) for x in table(s, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query(f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def topk_cosine(s, d):
    return similarity.top_k(table(s, d, "embeddings"), _vector(s, d), 10).withColumn("score", F.round("score", 6))


@query(f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {_COS} >= 0.2")
def relevance_rank_threshold(s, d):
    return similarity.rank_or_filter(table(s, d, "embeddings"), _vector(s, d), threshold=0.2).withColumn("score", F.round("score", 6))


@query(f"SELECT round(min(c), 6) AS min, round(max(c), 6) AS max, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std FROM (SELECT {_COS} AS c FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)")
def similarity_stats(s, d):
    scores = table(s, d, "embeddings").select(V.cosine(F.col("embedding"), similarity.vector_literal(_vector(s, d))).alias("c"))
    return similarity.similarity_stats(scores, "c").select(*[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std")])


@query(None)
def kmeans_clusters(s, d):
    return similarity.clusters(table(s, d, "embeddings"), 8).groupBy("cluster").count()


def _farthest_sql(picks: int) -> str:
    """Greedy picks written out: after each, the least distance of every vector to all of them."""
    steps = "p1 AS (SELECT 0::BIGINT AS vec_id)"
    for i in range(1, picks):
        far = f"SELECT e.vec_id, min(list_sum(list_transform(list_zip(e.embedding, c.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))) AS least FROM embeddings e, p{i} p JOIN embeddings c ON c.vec_id = p.vec_id WHERE e.vec_id NOT IN (SELECT vec_id FROM p{i}) GROUP BY e.vec_id"
        steps += f", p{i + 1} AS MATERIALIZED (SELECT vec_id FROM p{i} UNION ALL (SELECT vec_id FROM ({far}) ORDER BY least DESC, vec_id LIMIT 1))"
    chosen = " UNION ALL ".join(f"SELECT {i} AS pick, vec_id FROM p{i + 1}" + (f" WHERE vec_id NOT IN (SELECT vec_id FROM p{i})" if i else "") for i in range(picks))
    return f"WITH {steps} SELECT CAST(pick AS INTEGER) AS pick, vec_id FROM ({chosen})"


@query(_farthest_sql(5))
def kcenter_batch(s, d):
    return s.createDataFrame([(i, v) for i, v in enumerate(similarity.k_center(table(s, d, "embeddings"), 5, 0))], "pick int, vec_id long")


@query(None)
def farthest_from_mean(s, d):
    e = table(s, d, "embeddings")
    return similarity.farthest_from_mean(e.where("vec_id >= 10"), e.where("vec_id < 10"))


@query("SELECT label, CAST(p AS INTEGER) AS pos, round(avg(x), 5) AS mean, round(max(x), 5) AS most FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings) GROUP BY ALL")
def mean_max_pool(s, d):
    pooled = similarity.pooled(table(s, d, "embeddings"), "label")
    half = (F.size("pooled") / 2).cast("int")
    pairs = F.arrays_zip(F.slice("pooled", F.lit(1), half).alias("m"), F.slice("pooled", half + 1, half).alias("x"))
    return pooled.select("label", F.posexplode(pairs).alias("pos", "z")).select("label", "pos", F.round("z.m", 5).alias("mean"), F.round("z.x", 5).alias("most"))


@query(
    "WITH b AS (SELECT doc_id // 100 AS b, list_sort(list_distinct(list(source))) AS f FROM documents GROUP BY 1), w AS (SELECT b, f, lag(f) OVER (ORDER BY b) AS g FROM b)"
    " SELECT b, round(CASE WHEN g IS NULL THEN 1.0 ELSE (len(list_filter(f, lambda x: NOT list_contains(g, x))) + len(list_filter(g, lambda x: NOT list_contains(f, x)))) / len(list_distinct(list_concat(f, g))) END, 6) AS entropy FROM w"
)
def entropy_sequence(s, d):
    sets = table(s, d, "documents").groupBy(F.expr("doc_id div 100").alias("b")).agg(F.collect_set("source").alias("f"))
    return sets.select("b", F.round(similarity.set_entropy(F.col("f"), F.lag("f").over(Window.orderBy("b"))), 6).alias("entropy"))


@query("WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM w GROUP BY 1) SELECT count(*) FILTER (n = 1) AS once, count(*) AS features, (SELECT count(DISTINCT doc_id) FROM w) AS docs, round(count(*) FILTER (n = 1) / (SELECT count(DISTINCT doc_id) FROM w), 6) AS missing_mass FROM c")
def good_turing_missing_mass(s, d):
    words = table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))).alias("w"))
    return similarity.missing_mass(words, "doc_id", "w").withColumn("missing_mass", F.round("missing_mass", 6))


@query("SELECT source, len(list_distinct(list(lang))) AS langs FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def gt_schema_fold(s, d):
    cells = table(s, d, "documents").where("lang is not null").select("doc_id", F.col("source").alias("table_id"), F.col("lang").alias("column_name"))
    return adaptive.schema_rows(cells).select(F.col("table_id").alias("source"), F.size("attributes").cast("long").alias("langs"))


# --- scalar functions ------------------------------------------------------------------


@query(
    "SELECT p_partkey, CASE WHEN p_partkey % 8 IN (0, 1, 2, 3, 4) THEN TRUE ELSE FALSE END AS equal FROM part"
)
def value_compare_matrix(s, d):
    """Pairs that are equal as numbers with signs, as texts but for blanks, case and a last dot, as nulls; and pairs that are not."""
    k, size, name = F.col("p_partkey") % 8, F.col("p_size").cast("string"), F.col("p_name")
    left = F.when(k == 0, F.concat(F.lit("$"), size, F.lit(",000"))).when(k == 1, F.concat(size, F.lit("%"))).when(k == 2, F.concat(F.upper(name), F.lit(" ."))).when(k == 3, F.lit(None)).when(k == 4, F.concat(F.lit(" "), size, F.lit(".0"))).when(k == 5, name).when(k == 6, size).otherwise(F.lit("n/a"))
    right = F.when(k == 0, F.concat(size, F.lit("000"))).when(k.isin(1, 4), size).when(k == 2, F.concat(F.lit("  "), name)).when(k == 3, F.lit("N/A")).when(k == 5, F.lit(None)).when(k == 6, F.concat(size, F.lit("1"))).otherwise(name)
    return table(s, d, "part").select("p_partkey", V.values_equal(left, right).alias("equal"))


@query("SELECT n_nationkey, CAST(replace(concat(n_nationkey * 1000, ',', '500'), ',', '') AS DOUBLE) AS amount FROM nation")
def money_and_number_parse(s, d):
    return table(s, d, "nation").select("n_nationkey", V.coerce_number(F.concat(F.lit("$"), (F.col("n_nationkey") * 1000).cast("string"), F.lit(",500"))).alias("amount"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\b(?:19|20)\\d{2}\\b')) AS years FROM documents")
def year_extract(s, d):
    return table(s, d, "documents").select("doc_id", F.size(V.years(F.col("text"))).cast("long").alias("years"))


@query(None)
def nearby_numbers(s, d):
    return table(s, d, "pages").select("page_id", F.size(evidence.nearby_numbers(F.col("html"), "ad")).alias("numbers"))


@query(None)
def hash_embedding(s, d):
    return table(s, d, "documents").select("doc_id", evidence.hash_embedding(F.col("text")).alias("embedding"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field_coercion(s, d):
    return table(s, d, "events").select("event_id", V.json_payload(F.col("props"), "k string")["k"].alias("k"))


@query("SELECT doc_id, substring(text, greatest(greatest(strpos(lower(text), 'the'), 1) - 110, 1), 220) AS excerpt FROM documents")
def text_excerpt(s, d):
    return table(s, d, "documents").select("doc_id", V.excerpt(F.col("text"), F.lit("the")).alias("excerpt"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'cached' END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, o_orderpriority) AS assigned FROM orders")
def table_assignment_cached(s, d):
    o = table(s, d, "orders")
    docs = o.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("source_table"), "o_orderpriority")
    tables = ["cached", *(r[0] for r in o.select("o_orderstatus").union(o.select("o_orderpriority")).distinct().collect())]  # a few codes
    cached = docs.where("doc_id % 3 = 0").select("doc_id", F.lit("cached").alias("table_id"))
    found = runtime.assigned_tables(docs, tables, cached=cached, assigner=lambda left: left.select("doc_id", F.col("o_orderpriority").alias("table_id")))
    return found.select(F.col("doc_id").alias("o_orderkey"), F.col("table_id").alias("assigned"))


# --- accounting, curation, audit -------------------------------------------------------


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS calls, round(sum(value), 2) AS tokens FROM events GROUP BY ALL")
def usage_by_query_stage(s, d):
    log = table(s, d, "events").select("event_type", F.date_trunc("hour", "ts").alias("hour"), F.lit(None).cast("double").alias("prompt_tokens"), F.lit(None).cast("double").alias("completion_tokens"), F.col("value").alias("total_tokens"))
    return metrics.usage_by(log, "event_type", "hour").select("event_type", "hour", "calls", F.round("total_tokens", 2).alias("tokens"))


@query("WITH a AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1), o AS (SELECT avg(value) AS m FROM events) SELECT event_type, round(10 * coalesce(a.m, o.m), 4) AS saved FROM a, o")
def token_savings_estimate(s, d):
    usage = table(s, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("value").alias("calls"), F.sum("value").alias("total_tokens"))
    saved = usage.select("stage", F.lit(10).alias("calls_saved"))
    return metrics.token_savings(saved, usage).select(F.col("stage").alias("event_type"), F.round("tokens_saved", 4).alias("saved"))


@query("SELECT source, count(*) AS docs FROM documents GROUP BY 1 HAVING count(*) > 5")
def schema_frequency_threshold(s, d):
    return adaptive.frequent_tables(table(s, d, "documents").select("doc_id", F.col("source").alias("table_id"))).select(F.col("table_id").alias("source"), "docs")


@query(
    "WITH b AS (SELECT o_custkey, max(o_totalprice) AS v FROM orders GROUP BY 1), t AS (SELECT count(*) AS total FROM customer), c AS (SELECT v, count(*) OVER (ORDER BY v DESC) AS covered FROM b),"
    " g AS (SELECT bucket, v, covered, abs(covered / total - bucket) AS gap FROM c, t, (SELECT unnest([0.1, 0.3, 0.5])::DOUBLE AS bucket))"
    " SELECT bucket, v AS threshold, covered FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY gap, v DESC) AS r FROM g) WHERE r = 1"
)
def coverage_threshold_candidates(s, d):
    return curation.threshold_candidates(table(s, d, "orders"), "o_totalprice", "o_custkey", [0.1, 0.3, 0.5], table(s, d, "customer").count())


@query("SELECT c_mktsegment, count(DISTINCT c_nationkey) AS docs FROM customer GROUP BY 1")
def categorical_candidates(s, d):
    return curation.categorical_candidates(table(s, d, "customer"), "c_mktsegment", "c_nationkey")


@query("SELECT count(DISTINCT CASE WHEN lang IS NULL THEN doc_id END) AS null_docs, count(DISTINCT CASE WHEN lang IS NOT NULL THEN doc_id END) AS known_docs FROM documents")
def nullness_candidates(s, d):
    return curation.nullness(table(s, d, "documents"), "lang", "doc_id")


_PROFILE = "SELECT '{c}' AS column_name, count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values, count(TRY_CAST({c} AS DOUBLE)) AS \"numeric\", round(avg(length(CAST({c} AS VARCHAR))), 6) AS avg_length FROM part"


@query(" UNION ALL ".join(_PROFILE.format(c=c) for c in PART_COLUMNS))
def output_column_profiles(s, d):
    return curation.column_profiles(table(s, d, "part"), PART_COLUMNS).withColumn("avg_length", F.round("avg_length", 6))


_AUDIT = "SELECT doc_id, source, CASE WHEN n_chars > 2000 AND quality <> 1 THEN 'text_pass_gt_fail' WHEN n_chars <= 2000 AND quality = 1 THEN 'text_fail_gt_pass' END AS conflict_type FROM documents JOIN labels USING (doc_id)"


def _audit(s, d):
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    return curation.conflicts(rows, F.col("n_chars") > 2000, F.col("quality") == 1)


@query(f"SELECT doc_id, conflict_type FROM ({_AUDIT}) WHERE conflict_type IS NOT NULL")
def consistency_audit(s, d):
    return _audit(s, d).select("doc_id", "conflict_type")


@query(f"SELECT conflict_type, count(*) AS n FROM ({_AUDIT}) WHERE conflict_type IS NOT NULL GROUP BY 1")
def conflict_counts(s, d):
    return curation.conflict_totals(_audit(s, d)).select("conflict_type", "n")


@query(f"SELECT source, conflict_type, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM ({_AUDIT}) WHERE conflict_type IS NOT NULL GROUP BY 1, 2")
def conflict_docs_by_attribute(s, d):
    return curation.conflict_totals(_audit(s, d), "source").select("source", "conflict_type", "docs", "first_doc")


@query("SELECT lang, source, count(*) AS docs, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS tokens FROM documents GROUP BY 1, 2")
def density_per_source(s, d):
    truth = table(s, d, "labels").select("doc_id", F.lit("labels").alias("table_id"))
    return curation.density(table(s, d, "documents"), truth, ["lang", "source"], text="text").select("lang", "source", "docs", "tokens")


@query("WITH v AS (SELECT s_nationkey AS variant, round(avg(s_acctbal), 2) AS answer, count(*) AS docs FROM supplier GROUP BY 1) SELECT variant, answer, docs, row_number() OVER (ORDER BY answer DESC, docs, variant) AS rank FROM v")
def variant_leaderboard(s, d):
    v = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("variant")).agg(F.round(F.avg("s_acctbal"), 2).alias("answer"), F.count(F.lit(1)).alias("docs"))
    return curation.best_first(v, ["answer"], "docs", "variant")


@query(
    "WITH n AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1), m AS (SELECT max(n) AS most FROM n), p AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) - 1 AS i FROM labels)"
    " SELECT doc_id, toxic FROM (SELECT doc_id, p.toxic, unnest(range(0, CAST(floor((most - 1 - i) / n.n) + 1 AS BIGINT))) AS c FROM p JOIN n ON p.toxic = n.toxic, m)"
)
def oversample_minority(s, d):
    return relational.oversample(table(s, d, "labels").select("doc_id", "toxic"), "toxic", "doc_id")


_LONG, _ODD = "SELECT doc_id FROM documents WHERE n_chars > 5000", "SELECT doc_id FROM documents WHERE doc_id % 2 = 1"


@query(f"{_LONG} UNION {_ODD}")
def filter_merge_union(s, d):
    t = table(s, d, "documents")
    return filters.merged([t.where("n_chars > 5000"), t.where("doc_id % 2 = 1")], "union")


@query(f"{_LONG} INTERSECT {_ODD}")
def filter_merge_intersection(s, d):
    t = table(s, d, "documents")
    return filters.merged([t.where("n_chars > 5000"), t.where("doc_id % 2 = 1")], "intersection")


# --- answers over records, proxies, filters, discovery ---------------------------------

RECORD_COLUMNS = {"customer": ["c_custkey", "c_name", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]}


def records_of_tables(s, d):
    """The two tables' rows as records of text cells, a document each."""
    out = None
    for t, columns in RECORD_COLUMNS.items():
        data = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("string") for c in columns]))
        rows = table(s, d, t).select(F.concat_ws("-", F.lit(t), F.col(columns[0]).cast("string")).alias("doc_id"), F.lit(t).alias("table_id"), F.col(columns[0]).cast("string").alias("record_id"), data.alias("data"))
        out = rows if out is None else out.unionByName(rows)
    return out


_JOINED = "FROM customer AS c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = 'BUILDING' AND o.o_totalprice > 150000.5"
_TOTALS = f"SELECT c.c_name, count(*) AS n, round(sum(o.o_totalprice), 2) AS total {_JOINED} GROUP BY c.c_name HAVING count(*) > 1"


@query(_TOTALS)
def answer_over_records(s, d):
    return answers.answer(records_of_tables(s, d), _TOTALS, RECORD_COLUMNS)


@query(f"SELECT DISTINCT 'customer' AS table_id, concat('customer-', c_custkey) AS doc_id, CAST(c_custkey AS VARCHAR) AS record_id {_JOINED} UNION ALL SELECT 'orders', concat('orders-', o_orderkey), CAST(o_orderkey AS VARCHAR) {_JOINED}")
def answer_provenance(s, d):
    return answers.answer_references(records_of_tables(s, d), _TOTALS, RECORD_COLUMNS)


@query("SELECT 'customer' AS table_id, count(*) AS docs, count(c_custkey) + count(c_name) + count(c_mktsegment) AS cells FROM customer UNION ALL SELECT 'orders', count(*), count(o_orderkey) + count(o_custkey) + count(o_orderstatus) + count(o_totalprice) FROM orders")
def required_cells(s, d):
    return answers.required_cells(records_of_tables(s, d), RECORD_COLUMNS)


@query("SELECT concat('orders-', o_orderkey) AS doc_id FROM orders WHERE lower(o_orderstatus) = 'f' AND o_totalprice > 200000")
def oracle_predicate_documents(s, d):
    return proxies.oracle_docs(records_of_tables(s, d), "orders", [Predicate("o_orderstatus", "=", "f"), Predicate("o_totalprice", ">", 200000)])


@query("SELECT doc_id, CASE WHEN contains(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), 'the') THEN 1.0 ELSE 0.0 END AS score FROM documents WHERE text IS NOT NULL")
def heuristic_proxy_text(s, d):
    docs = table(s, d, "documents").where("text is not null")
    return docs.select("doc_id", proxies.HeuristicProxy(Predicate("word", "=", "the"), text="text").score().alias("score"))


_WRONG = f"SELECT *, CAST((s1 >= 0.5) <> (quality = 1) AS INTEGER) AS wrong FROM ({LABELLED})"
_CENTRES = (
    f"WITH l AS ({_WRONG}), g AS (SELECT s1, s2, count(*) FILTER (wrong = 0) AS right_rows, count(*) FILTER (wrong <> 0) AS faults FROM l GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM l),"
    " o AS (SELECT *, coalesce(sum(right_rows) OVER (ORDER BY (faults + right_rows) / right_rows, right_rows DESC, s1, s2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM g WHERE right_rows > 0)"
    " SELECT s1, s2, right_rows, faults FROM o, n WHERE earlier < ceil(0.7 * (n + 1))"
)


def _calibrated(s, d):
    return labelled(s, d).withColumn("wrong", ((F.col("s1") >= 0.5) != (F.col("quality") == 1)).cast("int"))


@query(_CENTRES)
def conformal_centres(s, d):
    return proxies.conformal_centres(_calibrated(s, d), ["s1", "s2"], "wrong", 0.3).withColumnRenamed("right", "right_rows")


@query(f"SELECT l.doc_id, c.s1 IS NOT NULL AS covered FROM ({LABELLED}) l LEFT JOIN ({_CENTRES}) c ON l.s1 = c.s1 AND l.s2 = c.s2")
def nearest_centre(s, d):
    rows = _calibrated(s, d)
    return proxies.nearest_centre(rows, rows, proxies.conformal_centres(rows, ["s1", "s2"], "wrong", 0.3), ["s1", "s2"], "doc_id")


@query(None)
def learned_proxy_scores(s, d):
    rows = table(s, d, "embeddings").select("vec_id", "embedding", (F.col("label") == table(s, d, "embeddings").agg(F.min("label")).first()[0]).cast("int").alias("relevant"))
    return proxies.learned_scores(rows, rows.where("vec_id % 5 <> 0"), "embedding", "relevant").select("vec_id", "score")


@query("SELECT doc_id FROM documents WHERE lang IS NOT NULL AND lang NOT IN ('en', 'de') UNION SELECT doc_id FROM documents WHERE n_chars < 200")
def composite_filter(s, d):
    class Short(filters.DocumentFilter):
        name = "short"

        def excluded(self, query_id, docs):
            return docs.where("n_chars < 200").select("doc_id")

    docs = table(s, d, "documents").withColumn("schema_tables", F.when(F.col("lang").isNotNull(), F.array("lang")))
    return filters.Composite([filters.SchemaRelevance({"q": ["en", "de"]}), Short()]).excluded("q", docs)


@query("SELECT (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 64 AS batch, doc_id FROM documents WHERE n_chars IS NOT NULL")
def document_batches(s, d):
    """Every document with its batch; the bound is the count."""
    docs = table(s, d, "documents").where("n_chars is not null")
    return adaptive.batched(docs, 64, "n_chars").select("batch", F.col("at.k").alias("doc_id"))


def _cells_by_source(docs):
    return docs.where("lang is not null").select("doc_id", F.col("lang").alias("table_id"), F.col("source").alias("column_name"))


_BATCH_SQL = """
WITH d AS (SELECT doc_id, lang AS t, source AS c, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS b FROM documents),
batches AS (SELECT b, sum(count(*)) OVER (ORDER BY b) AS n FROM d GROUP BY b),"""
_KNOWN_SQL = """
SELECT DISTINCT t AS table_id, c AS attribute, (SELECT n::BIGINT FROM batches JOIN stop USING (b)) AS documents FROM d WHERE t IS NOT NULL AND b <= (SELECT b FROM stop)"""


@query(
    _BATCH_SQL
    + """
f AS (SELECT b, unnest(['table:' || t, t || '.' || coalesce(c, 'None'), 'attr:' || coalesce(c, 'None')]) AS feature FROM d WHERE t IS NOT NULL),
firsts AS (SELECT feature, min(b) AS b FROM f GROUP BY 1),
course AS (SELECT b, n, count(feature) AS fresh FROM batches LEFT JOIN firsts USING (b) GROUP BY b, n),
seen AS (SELECT *, sum(fresh) OVER (ORDER BY b) AS known FROM course),
e AS (SELECT *, CASE WHEN b = 0 OR known = 0 THEN 1.0 ELSE fresh / known END AS entropy FROM seen),
s AS (SELECT *, b - coalesce(max(CASE WHEN entropy >= 0.1 THEN b END) OVER (ORDER BY b), -1) AS streak FROM e),
stop AS (SELECT coalesce(min(b) FILTER (streak >= 2 AND n >= 50 AND pow(0.95, n) * greatest(known, 1) <= 0.05), max(b)) AS b FROM s)"""
    + _KNOWN_SQL
)
def schema_discovery_entropy(s, d):
    docs = table(s, d, "documents")
    found = stop_points.discovered(docs, _cells_by_source(docs), adaptive.EntropyRule(limit=0.1, needed=2, least=50), size=50, order="doc_id")
    return found.select("table_id", F.col("column_name").alias("attribute"), "documents")


@query(
    _BATCH_SQL
    + """
f AS (SELECT DISTINCT b, doc_id, t || '.' || coalesce(c, 'None') AS feature FROM d WHERE t IS NOT NULL),
two AS (SELECT feature, b, row_number() OVER (PARTITION BY feature ORDER BY doc_id) AS nth FROM f),
course AS (SELECT b, n, coalesce(sum(CASE nth WHEN 1 THEN 1 WHEN 2 THEN -1 END), 0) AS more FROM batches LEFT JOIN two USING (b) GROUP BY b, n),
s AS (SELECT *, sum(more) OVER (ORDER BY b) AS once FROM course),
stop AS (SELECT coalesce(min(b) FILTER (n >= 50 AND once / n < 0.1), max(b)) AS b FROM s)"""
    + _KNOWN_SQL
)
def schema_discovery_missing_mass(s, d):
    docs = table(s, d, "documents")
    found = stop_points.discovered(docs, _cells_by_source(docs), adaptive.MissingMassRule(0.1, 50), size=50, order="doc_id")
    return found.select("table_id", F.col("column_name").alias("attribute"), "documents")


@query("""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, greatest(coalesce(n_chars, 0), 0) AS c, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
g AS (
  SELECT doc_id, i, 0::BIGINT AS batch, 1 AS docs, c AS chars FROM d WHERE i = 1
  UNION ALL
  SELECT d.doc_id, d.i, CASE WHEN docs >= 32 OR chars + c > 40000 THEN batch + 1 ELSE batch END,
         CASE WHEN docs >= 32 OR chars + c > 40000 THEN 1 ELSE docs + 1 END, CASE WHEN docs >= 32 OR chars + c > 40000 THEN c ELSE chars + c END
  FROM g JOIN d ON d.i = g.i + 1)
SELECT doc_id, batch FROM g""")
def document_batches_by_size(s, d):
    """Every document with its batch of at most 32 documents and 40,000 characters, for one call of an extractor."""
    return segments.batches_by_size(table(s, d, "documents"), 32, 40_000, order="doc_id").select(F.col("at.k").alias("doc_id"), "batch")


@query("SELECT lang AS table_id, count(DISTINCT doc_id) AS docs FROM documents WHERE lang IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 5")
def frequent_tables(s, d):
    return adaptive.frequent_tables(_cells_by_source(table(s, d, "documents")))


_CELLS = "SELECT p_partkey AS doc_id, column_name, value, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'wrong' ELSE value END AS got FROM (SELECT p_partkey, p_name, p_brand FROM part) UNPIVOT (value FOR column_name IN (p_name, p_brand))"
_KINDS = f"SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN CASE WHEN got IS NULL THEN 'tn' ELSE 'fp' END WHEN got = value THEN 'tp' WHEN got IS NULL THEN 'fn' ELSE 'fp' END AS k FROM ({_CELLS})"


def _told(s, d):
    t = datasets.unpivot_cells(table(s, d, "part").withColumnRenamed("p_partkey", "doc_id"), "doc_id", ["p_name", "p_brand"])
    return t, t.withColumn("value", F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, "wrong").otherwise(F.col("value")))


@query(f"SELECT doc_id, count(*) FILTER (k = 'tp') AS tp, count(*) FILTER (k = 'fp') AS fp, count(*) FILTER (k = 'fn') AS fn, count(*) FILTER (k = 'tn') AS tn, count(*) FILTER (k IN ('fp', 'fn')) = 0 AS correct FROM ({_KINDS}) GROUP BY 1")
def document_outcomes(s, d):
    truth, said = _told(s, d)
    return metrics.cell_outcomes(truth, said, truth.where("doc_id % 11 <> 0"))


@query(f"SELECT column_name, count(*) AS total, count(*) FILTER (got = value) AS correct, 0 AS judged, round(count(*) FILTER (got = value) / count(*), 6) AS accuracy FROM ({_CELLS}) GROUP BY 1")
def attribute_accuracy(s, d):
    return metrics.attribute_accuracy(*_told(s, d), ["doc_id"]).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT doc_id, lang AS table_id, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'xx' ELSE lang END AS got, CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 4 = 0 THEN 'wrong' ELSE 'covered' END AS state FROM documents WHERE lang IS NOT NULL")
def table_coverage(s, d):
    docs = table(s, d, "documents").where("lang is not null")
    said = docs.select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit(None)).when(F.col("doc_id") % 4 == 0, "xx").otherwise(F.col("lang")).alias("table_id"))
    return metrics.table_coverage(docs.select("doc_id", F.col("lang").alias("table_id")), said)


_STAGES = "SELECT event_type AS stage, count(*) AS before, count(*) FILTER (value < 50) AS after FROM events GROUP BY 1"


@query(f"WITH e AS ({_STAGES}), a AS (SELECT * FROM e UNION ALL SELECT 'total', sum(before), sum(after) FROM e) SELECT stage, before, after, before - after AS saved, round((before - after) / before, 6) AS reduction FROM a")
def call_reduction(s, d):
    stages = table(s, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("before"), F.count_if(F.col("value") < 50).alias("after"))
    return metrics.call_reduction(stages).withColumn("reduction", F.round("reduction", 6))


# --- extension: event windows ----------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def ext_tumbling_windows(s, d):
    return windows.windowed(table(s, d, "events"), "1 hour", keys=("event_type",)).withColumn("total", F.round("total", 2))


@query(
    "WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '1 hour' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),"
    " g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '1 hour' AS session_end, count(*) AS n FROM g GROUP BY user_id, k"
)
def ext_session_windows(s, d):
    return windows.sessions(table(s, d, "events"), "1 hour")


FLAGSHIP = flagship_extract_join_answer

from lumenar.plans import catalog_runtime  # noqa: E402, F401 - registers its queries
