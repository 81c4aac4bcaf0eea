"""Words that stand for attributes, and the numbers by which documents name their rows."""

import pytest

from lumenar.functions import evidence
from lumenar.operators.proxies import HeuristicProxy
from lumenar.plans.sqlx import Predicate


@pytest.mark.parametrize(
    ("attribute", "text", "want"),
    [
        ("salary", "She earns 52000 a year", [52000.0]),
        ("salary", "They were paid $48000", [48000.0]),
        ("salary", "A flat of 48000 square feet", []),
        ("avg_scr_read", "an average of 512 in reading", [512.0]),
        ("credits", "It is worth 4 credits", [4.0]),
        ("home_price", "the home has 3 rooms" + " " * 200 + "and 9 doors", [3.0]),
        ("___", "any 5 and 6", [5.0, 6.0]),
        ("top10", "the top10 list of 10 and 12", [12.0]),
    ],
)
def test_numbers_near_hint_words(attribute, text, want):
    assert evidence.numbers_near(text, attribute) == want
    assert evidence.numbers_near(None, attribute) == []


def test_rows_named_by_their_documents(spark):
    rows = [("a", "7", None, None), ("b", None, "9", None), ("c", None, None, "part-7"), ("d", None, None, None), ("e", "x", " ", "none")]
    docs = spark.createDataFrame([(i, "", *r) for i, *r in rows], "doc_id string, doc_text string, source_row_id string, row_id string, parent_doc_id string")
    proxy = HeuristicProxy(Predicate("row_id", "=", 7), row_id=("source_row_id", "row_id", "parent_doc_id"))
    assert {r["doc_id"]: r["s"] for r in docs.select("doc_id", proxy.score().alias("s")).collect()} == {"a": 1.0, "b": 0.5, "c": 1.0, "d": 0.5, "e": 0.5}


def test_declared_types_are_not_asked_of_the_values(spark):
    from lumenar.plans import answers
    from lumenar.sources import datasets

    schema = datasets.runtime_schema({"tables": [{"name": "t", "columns": [{"name": "a", "type": "integer"}, {"name": "b", "type": "text"}, {"name": "c", "type": "string"}, "d"]}]})
    assert answers.declared_types(schema) == {"t": {"a": "integer", "b": "text"}}
    rows = [("1", {"a": "7", "b": "10", "c": "5"}), ("2", {"a": "seven", "b": "9", "c": "6.5"})]
    records = spark.createDataFrame([(i, "t", i, d) for i, d in rows], "doc_id string, table_id string, record_id string, data map<string,string>")
    told = answers.answer(records, "SELECT a, b, c FROM t ORDER BY c", {"t": ["a", "b", "c"]}, answers.declared_types(schema))
    assert [f.dataType.simpleString() for f in told.schema.fields] == ["bigint", "string", "double"]
    assert [tuple(r) for r in told.collect()] == [(7, "10", 5.0), (None, "9", 6.5)]
    by_value = answers.answer(records, "SELECT a, b FROM t", {"t": ["a", "b"]})
    assert [f.dataType.simpleString() for f in by_value.schema.fields] == ["string", "bigint"]
