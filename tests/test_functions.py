import math

import pytest
from pyspark.sql import functions as F

from lumenar.functions import evidence
from lumenar.functions import values as V
from lumenar.operators import cascade, relational, similarity
from lumenar.operators.predicates import compile_predicate
from lumenar.plans.sqlx import Predicate
from lumenar.sources import datasets, sinks


def column(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("v"))).collect()]


def test_values(spark):
    texts = ["1,200", "$5.50", "12%", "abc", None, " n/a ", "1d", "unknown"]
    assert column(spark, texts, V.number) == [None, None, None, None, None, None, None, None]
    assert column(spark, texts, V.coerce_number) == [1200.0, 5.5, None, None, None, None, None, None]
    assert column(spark, texts, V.is_none_value) == [False, False, False, False, True, True, False, False]
    assert column(spark, texts, V.is_null_eval) == [False, False, False, False, True, True, False, True]
    assert column(spark, ["three", "7", "None"], V.word_number) == [3.0, 7.0, 0.0]
    assert column(spark, [" 'Foo   Bar.' ", "x;"], V.normal_text) == ["foo bar", "x"]
    assert column(spark, ["A b-c", "__", None], V.identifier) == ["a_b_c", "unknown", "unknown"]
    assert column(spark, ["5", "4", "x", None], lambda v: V.satisfies(v, ">=", 5)) == [True, False, False, False]
    assert column(spark, ["x" * 25, "", None, "x" * 10], lambda v: F.size(V.char_chunks(v, 10, 2))) == [3, 1, 1, 1]
    assert column(spark, ["a b c d e", ""], lambda v: V.token_chunks(v, 3, 1)) == [["a b c", "c d e"], [""]]


def test_value_equality(spark):
    frame = spark.createDataFrame([("1,000", "1000.0"), ("a", "A."), (None, "NA"), ("x", None), ("1", "2")], "a string, b string")
    assert [r[0] for r in frame.select(V.values_equal(F.col("a"), F.col("b"))).collect()] == [True, True, True, False, False]


@pytest.mark.parametrize(
    ("p", "expected"),
    [
        (Predicate("v", "=", 5), [True, True, False, False, False]), (Predicate("v", "!=", 5), [False, False, False, True, False]), (Predicate("v", "LIKE", "A_c"), [False, False, True, False, False]),
        (Predicate("v", "IN", [5, "ABC"]), [True, False, True, False, False]), (Predicate("v", "IS NULL", None), [False, False, False, False, True]), (Predicate("v", "BETWEEN", [5, 8]), [True, True, False, True, False]),
        (Predicate("v", ">", "6"), [False, False, False, True, False]),
    ],
)
def test_predicates(spark, p, expected):
    assert column(spark, ["5", "5.0", "abc", "7", None], lambda v: compile_predicate(p, v)) == expected


def test_evidence(spark):
    assert evidence.asserts("The company posted a profit.", evidence.PHRASES["is_profitable"])
    assert not evidence.asserts("It was not profitable", evidence.PHRASES["is_profitable"]) and not evidence.asserts(None, ("x",))
    assert evidence.numbers_near("average of 513 in math; year 1999", "avg_math") == [513.0, 1999.0]
    assert evidence.parsed_numbers("He is 180 cm tall and weighs 150 lbs", "height") == [180.0]
    assert evidence.parsed_numbers("twelve students took the test", "num_tst_takr") == [12.0]
    assert math.isclose(sum(x * x for x in evidence.hash_embed("a b c")), 1.0) and not any(evidence.hash_embed(None))
    assert column(spark, ["x", "no growth in jobs", "saw job growth"], lambda v: evidence.closed_world_boolean("growth_in_jobs", v)) == ["0", "0", "1"]
    assert column(spark, ["x"], lambda v: evidence.closed_world_boolean("dropped_in_rank", v, F.lit(-3))) == ["1"]
    assert column(spark, ["updated figures of $1.5 billion", "none"], evidence.market_value_millions) == [1500.0, None]
    assert column(spark, ["ticker symbol: WMT", "x"], evidence.ticker) == ["WMT", None]


def test_calibration(spark):
    scores = spark.createDataFrame([(i / 10,) for i in range(1, 11)], "s double")
    assert cascade.recall_threshold(scores, "s", 0.9) == pytest.approx(0.2) and cascade.recall_threshold(scores, "s", 0.9) < 0.2
    assert cascade.recall_threshold(scores.limit(0), "s", 0.9) == 0.01
    assert cascade.conformal_threshold(scores, "s", 0.05).first()["threshold"] == 1.0
    assert cascade.conformal_level(100, 0.05) == 0.96
    alphas, cost, steps = cascade.allocate(["a", "b"], [0.0, 0.05, 0.1], 0.9, lambda x: 100 - 500 * x["a"] - 100 * x["b"])
    assert alphas == {"a": 0.1, "b": 0.0} and cost == 50 and len(steps) == 2
    assert cascade.global_choice([[(0.0, 10, 10), (0.1, 8, 10)], [(0.0, 10, 10), (0.2, 7, 10)]], 0.9) == [1, 0]
    assert cascade.closest_alpha([(0.0, 1.0), (0.05, 0.96), (0.1, 0.94)], 0.95) == 0.05
    assert cascade.fill_leftover({"doc": 0.0, "predicate": 0.02}, "predicate", 0.9)["predicate"] == pytest.approx(0.1)
    assert similarity.minimum_samples(10, 0.1, 0.05) == 53 and similarity.entropy_stops(3, 60, 10, 3, 5, 0.1, 0.05)


def test_cascade_keeps_everything_at_full_recall(spark):
    rows = spark.createDataFrame([(0.1,), (0.9,)], "s double")
    proxy = cascade.Proxy("p", F.col("s"), 0.5)
    assert cascade.survivors(rows, [proxy]).count() == 1 and cascade.survivors(rows, [proxy], 1.0).count() == 2
    assert cascade.ordered([proxy, cascade.Proxy("free", F.lit(1.0), cost=0)])[0].name == "free"


def test_memory_dataset_and_contract(spark):
    docs = [{"doc_id": "d1", "doc_text": "x", "extra": 1}, {"doc_id": "d2", "doc_text": None}]
    schema = {"tables": [{"table_id": "course", "name": "course", "columns": [{"name": "title"}, {"name": "credits"}]}]}
    data = datasets.from_memory(spark, docs, schema, [{"id": "q1", "sql": "SELECT title FROM course", "golden_schema": {"tables": ["course"], "columns": ["course.title"]}}])
    assert data.document("d1") == ("x", "d1") and data.document("none") == ("", "none") and data.documents.columns == ["doc_id", "doc_text", "doc_pos"]
    assert datasets.project_schema(data.schema, data.query("q1"))[0]["Attributes"] == [{"Attribute Name": "title", "Description": ""}]
    assert datasets.default_query(data.schema)["required_columns"] == ["course.title", "course.credits"]
    with pytest.raises(ValueError):
        datasets.from_memory(spark, [{"doc_id": "a"}, {"doc_id": "a"}])
    with pytest.raises(ValueError):
        datasets.create_loader("none")
    truth = spark.createDataFrame([("ds", "d9", "r", "course", "course.title", "title", "v", "string", None)], datasets.GROUND_TRUTH)
    errors = {(r["error"], r["subject"]) for r in datasets.contract_errors(data.documents, truth, data.schema, [{"required_tables": ["x"], "required_columns": []}]).collect()}
    assert errors == {("orphan document", "d9"), ("unknown table", "x")}


def test_chunks_merge_to_one_row(spark):
    cells = spark.createDataFrame([("doc-1", "course", "__single__", "title", 0, "DB"), ("doc-1", "course", "__single__", "title", 1, None), ("doc-1", "course", "__single__", "credits", 1, "4")], "parent_doc_id string, table_id string, record_key string, column_name string, chunk_index int, value string")
    got = {r["column_name"]: r["value"] for r in relational.merge_chunks(cells).collect()}
    assert got == {"title": "DB", "credits": "4"}
    docs = spark.createDataFrame([("d", "abcdef")], "doc_id string, doc_text string")
    assert [r["doc_id"] for r in sinks.chunk_documents(docs, V.char_chunks(F.col("doc_text"), 4, 1)).orderBy("chunk_index").collect()] == ["d-0", "d-1"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("q1", "d1"), ("q1", "d2")], "query_id string, doc_id string")
    sinks.save_results(rows, f"{tmp_path}/out")
    docs = spark.createDataFrame([("d1",), ("d3",)], "doc_id string")
    assert [r[0] for r in sinks.pending(docs, spark.read.parquet(f"{tmp_path}/out")).collect()] == ["d3"]
    compute = lambda d: d.withColumn("x", F.lit(1))
    assert sinks.cache_through(spark, f"{tmp_path}/cache", docs.limit(1), compute).count() == 1
    assert sinks.cache_through(spark, f"{tmp_path}/cache", docs, compute).count() == 2
