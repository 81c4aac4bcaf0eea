"""What must not grow with the tables: what goes through the driver, one task or a worker."""

import hashlib
import os
import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenar import providers
from lumenar.functions import evidence
from lumenar.functions import values as V
from lumenar.operators import relational
from lumenar.plans import runtime
from lumenar.plans.catalog import QUERIES
from lumenar.plans.runtime import RECORDS
from lumenar.sources import datasets


@pytest.fixture
def eager_broadcasts(spark):
    """Spark takes every table for a small one."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 40))
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def values(spark, rows, names):
    """A table whose size Spark knows."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_repaired_truth_sends_no_table_through_the_driver(spark, eager_broadcasts):
    docs = values(spark, "('d1', 't', '1'), ('d2', 't', 't-none'), ('d3', 't', 'b'), ('d4', 't', NULL), ('d5', 't', 'a-x')", "doc_id, source_table, source_row_id")
    rows = values(spark, "(1, 'x', '1'), (2, 'b', 'y'), (3, 'x', 'b')", "row_id, a, b")
    old = values(spark, "('d1', '0', 't', 'a', 'wrong', NULL), ('d4', '0', 't', 'a', 'stays', NULL)", "doc_id, record_id, table_id, column_name, value, source_row_id")
    schema = [{"Schema Name": "t", "Attributes": [{"Attribute Name": "a"}, {"Attribute Name": "b"}]}]
    found = datasets.repaired_truth(docs, old, {"t": rows}, schema)
    assert plan_of(found).count("BroadcastHashJoin") <= 1  # the scope: as many rows as the schema has columns
    got = sorted(map(tuple, found.select("doc_id", "record_id", "value").collect()))
    assert got == [("d1", "1", "x"), ("d3", "2", "b"), ("d4", "0", "stays"), ("d5", "1", "x")]


def test_found_rows_takes_the_first_place_and_keeps_unknown_ids(spark, eager_broadcasts):
    asked = values(spark, "('1'), ('1'), ('a-x'), ('x'), ('nobody'), (NULL)", "source_row_id")
    found = datasets.found_rows(asked, values(spark, "(1, 'x'), (2, '1'), (3, 'x')", "row_id, a"), ["a"])
    assert "Broadcast" not in plan_of(found)
    assert sorted(map(tuple, found.collect())) == [("1", 1), ("a-x", 1), ("nobody", None), ("x", 1)]


def test_texts_whose_hashed_tokens_cancel_out_are_known(spark, tmp_path):
    assert not any(evidence.hash_embed("the w305", 64)) and any(evidence.hash_embed("the", 64))
    values(spark, "(1L, 'the w305'), (2L, 'the w305'), (3L, '...'), (4L, CAST(NULL AS STRING)), (5L, 'The of')", "doc_id, text").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["embeddings_through_a_cache"](spark, str(tmp_path))
    assert sorted(map(tuple, found.select("doc_id", "dimensions", "known", "cached").collect())) == [(i, 64, i not in (3, 4), 1) for i in range(1, 6)]


def test_hashed_vectors_are_signed_counts_in_flat_arrays(spark):
    text = "The cat_1 and the dog; the END. Élan"
    want = np.zeros(16)
    for token in ["the", "cat_1", "and", "the", "dog", "the", "end", "lan"]:
        raw = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
        want[raw % 16] += 1 if raw >> 8 & 1 else -1
    assert np.allclose(evidence.hash_embed(text, 16), want / np.linalg.norm(want), atol=0, rtol=1e-15)
    assert isinstance(evidence._hash_vector(text, 16), np.ndarray)
    got = values(spark, f"('{text}'), (NULL)", "text").select(evidence.hash_embedding(F.col("text"), 16)).collect()
    assert [list(r[0]) for r in got] == [evidence.hash_embed(text, 16), [0.0] * 16]


def greedy(said, truth, wanted):
    """The rule of ``match_records`` for one document: truth in order, each the free prediction with most equal and then most known cells."""
    free, rows = sorted(said), []
    for rid, cells in sorted(truth):
        names = cells if wanted is None else wanted
        scored = [(sum(p.get(k) == cells.get(k) for k in names), wanted is not None and sum(k in p for k in names), -i) for i, (_, p) in enumerate(free)]
        most = max(scored, default=None)
        rows.append((rid, free.pop(-most[2])[0], most[0]) if most else (rid, None, 0))
    return rows


@pytest.mark.parametrize("wanted", [None, ["x", "y"]])
def test_records_are_matched_without_python_for_each_document(spark, wanted):
    pick = random.Random(5)
    sides, rows = [{}, {}], [[], []]
    for side in (0, 1):
        for d in [*range(40), None]:
            made = {str(i): {k: pick.choice("ab") for k in "xyz" if pick.random() < 0.8} for i in range(pick.randrange(5))}
            sides[side][d] = [(i, cells) for i, cells in made.items()]
            rows[side] += [(None if d is None else str(d), "t", i, cells) for i, cells in made.items()]
    said, truth = (spark.createDataFrame(r, RECORDS) for r in rows)
    found = relational.match_records(said, truth, wanted and {"t": wanted})
    assert not re.search("Pandas|Arrow|Python", plan_of(found))
    want = [(None if d is None else str(d), *r) for d in sides[1] for r in greedy(sides[0][d], sides[1][d], wanted)]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, found.select("doc_id", "record_id", "predicted_id", "equal_cells").collect()), key=key) == sorted(want, key=key)


def test_each_answer_is_asked_for_once(spark, tmp_path):
    log = str(tmp_path)

    def provider(request):
        with open(f"{log}/{uuid.uuid4()}", "w") as f:
            f.write(request.prompt)
        n = int(request.prompt.split()[0])
        return providers.Completion(f'{{"n": {n}}}' if n % 2 or "\n" in request.prompt and n % 4 else "no answer")

    done = providers.complete_typed(spark.createDataFrame([(k, str(k)) for k in range(8)], "key long, prompt string"), provider, "n long", repairs=1)
    assert sorted((r.key, r.valid) for r in done.collect()) == [(k, k % 4 != 0) for k in range(8)]
    asked = [open(f"{log}/{name}").read() for name in os.listdir(log)]
    assert len(asked) == len(set(asked)) == 12


def test_extractions_are_merged_in_one_shuffle(spark):
    records = spark.createDataFrame([("a", "t", "1", {"x": "1", "y": "1"}), ("b", "t", "1", {"x": "1"}), ("b", "t", "2", {"x": "2"}), ("c", "t", "1", {"x": "3"})], RECORDS)
    got = spark.createDataFrame([("a", "t", "9", {"x": "n", "__note": "z"}), ("a", "t", "8", {"x": "m", "w": "k"}), ("b", "t", "1", {"x": "n"}), ("d", "t", "2", {"x": "p"}), ("d", "t", "1", {"x": "q"}), ("c", "t", "1", {"__note": "z"}), ("e", "t", "1", {"__note": "z"})], RECORDS)
    found = runtime.merged_extraction(records, got)
    assert plan_of(found).count("Exchange") == 1
    rows = sorted((r.doc_id, r.record_id, sorted(r.data.items())) for r in found.collect())
    assert rows == [("a", "1", [("w", "k"), ("x", "m"), ("y", "1")]), ("b", "1", [("x", "1")]), ("b", "2", [("x", "2")]), ("c", "1", [("x", "3")]), ("d", "1", [("x", "q")])]


def test_a_materialised_extractor_keeps_no_copy_of_the_ids(spark):
    records = spark.createDataFrame([("a", "t", "1", {"x": "1"}), ("b", "t", "1", {"x": "2"})], RECORDS)
    found = runtime.materialised_extractor(records)(spark.createDataFrame([("a",), ("a",)], "doc_id string"), [{"Schema Name": "t", "Attributes": []}])
    assert "Aggregate" not in plan_of(found) and [r.doc_id for r in found.collect()] == ["a"]


def test_plain_numbers_keep_their_cells_and_keys(spark):
    told = {
        "12": ("12", "12"), "100": ("100", "100"), "0": ("0", "0"), "007": ("007", "7"), "-5": ("-5", "-5"), "1.50": ("1.50", "1.5"), "5.": ("5.", "5"), ".5": (".5", "0.5"), "1e3": ("1e3", "1000"),
        " 7 ": ("7", "7"), "7\n": ("7", "7"), "$1,200": ("1200", "1200"), "3%": ("3", "3"), "12.": ("12.", "12"), "n/a": (None, "n/a"), "Abc.": ("Abc", "abc."), "": (None, None), "1" * 19: ("1" * 19, "1" * 19),
    }
    rows = spark.createDataFrame([(t,) for t in told], "t string").select("t", V.sql_value(F.col("t")).alias("cell"), V.join_value(F.col("t")).alias("key"))
    assert {r.t: (r.cell, r.key) for r in rows.collect()} == told
    shown = rows._jdf.queryExecution().analyzed().toString()
    assert V._BARE in shown and V._WHOLE in shown
