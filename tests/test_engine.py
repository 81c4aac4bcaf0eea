"""Answers with provenance, proxies, filters, discovery and the public interface on small fixtures."""

import io
import json

import pytest
from pyspark.sql import functions as F

from lumenar import engine
from lumenar.__main__ import main
from lumenar.operators import adaptive, filters, metrics, proxies
from lumenar.operators.cascade import Proxy
from lumenar.plans import answers
from lumenar.plans.sqlx import Predicate

SCHEMA = [
    {"Schema Name": "city", "Attributes": [{"Attribute Name": "name"}, {"Attribute Name": "size"}]},
    {"Schema Name": "mayor", "Attributes": [{"Attribute Name": "city"}, {"Attribute Name": "age"}]},
]
CELLS = [
    ("d1", "city", {"name": "Ulm", "size": "126,000"}), ("d2", "city", {"name": "Bonn", "size": "330000"}), ("d3", "city", {"name": "Hof, Saale", "size": "n/a"}),
    ("d4", "mayor", {"city": "Ulm", "age": "61"}), ("d5", "mayor", {"city": "Bonn", "age": "44"}), ("d5", "mayor", {"city": "Ulm", "age": "70"}),
]
SQL = "SELECT c.name, m.age FROM city c JOIN mayor m ON c.name = m.city WHERE c.size > 100000 AND m.age > 50"
NEED = {"city": ["name", "size"], "mayor": ["city", "age"]}


@pytest.fixture
def records(spark):
    return spark.createDataFrame([(d, t, str(i), x) for i, (d, t, x) in enumerate(CELLS)], "doc_id string, table_id string, record_id string, data map<string,string>")


@pytest.fixture
def collection(spark, tmp_path):
    docs = [(d, f"about {d}") for d in ("d1", "d2", "d3", "d4", "d5")]
    spark.createDataFrame(docs, "doc_id string, doc_text string").write.parquet(str(tmp_path / "documents.parquet"))
    truth = [("x", d, str(i), t, f"{t}.{c}", c, v, "str", None) for i, (d, t, x) in enumerate(CELLS) for c, v in x.items()]
    names = "dataset_id string, doc_id string, record_id string, table_id string, column_id string, column_name string, value string, value_type string, source_row_id string"
    spark.createDataFrame(truth, names).write.parquet(str(tmp_path / "ground_truth.parquet"))
    (tmp_path / "metadata").mkdir()
    (tmp_path / "metadata" / "schema.json").write_text(json.dumps(SCHEMA))
    (tmp_path / "metadata" / "queries.json").write_text(json.dumps([{"query_id": "q1", "sql": SQL, "required_tables": ["city", "mayor"]}]))
    return str(tmp_path)


def test_columns_get_types_and_text_stays_text(records):
    rows = answers.typed_relation(records, "city", ["name", "size"])
    assert dict(rows.dtypes)["size"] == "bigint" and dict(rows.dtypes)["name"] == "string"
    assert {r["size"] for r in rows.collect()} == {126000, 330000, None}
    assert answers.typed_relation(records.limit(0), "city", ["name"]).count() == 0


def test_answers(records):
    assert sorted(map(tuple, answers.answer(records, SQL, NEED).collect())) == [("Ulm", 61), ("Ulm", 70)]
    quoted = "SELECT city.name FROM city, mayor WHERE city.name = mayor.city AND city.name <> 'from city, mayor' ORDER BY mayor.age LIMIT 1;"
    assert answers.answer(records, quoted, NEED).collect() == [("Bonn",)]
    nested = "SELECT name FROM city WHERE name NOT IN (SELECT city FROM mayor) UNION SELECT 'x' FROM city"
    assert sorted(r[0] for r in answers.answer(records, nested, NEED).collect()) == ["Hof, Saale", "x"]


def test_provenance(records):
    grouped = SQL.replace("c.name, m.age", "c.name, count(*)") + " GROUP BY c.name"
    found = {(r.table_id, r.doc_id, r.record_id) for r in answers.answer_references(records, grouped, NEED).collect()}
    assert found == {("city", "d1", "0"), ("mayor", "d4", "3"), ("mayor", "d5", "5")}
    assert answers.provenance_sql("SELECT a FROM t UNION SELECT b FROM u") is None and answers.provenance_sql("SELECT 1") is None
    kept = answers.required_records(records, NEED, answers.answer_references(records, SQL, NEED))
    assert kept.count() == 3 and answers.required_records(records, {"city": []}).count() == 3
    assert {(r.table_id, r.docs, r.cells) for r in answers.required_cells(records, NEED).collect()} == {("city", 3, 5), ("mayor", 2, 6)}


def test_heuristic_proxy(spark):
    docs = spark.createDataFrame([("a", "a height of 180 cm"), ("b", "a height of 150 cm"), ("c", "nothing"), ("d", None), ("r", "height 180"), ("p", "height 1")], "doc_id string, doc_text string")
    p = proxies.HeuristicProxy(Predicate("height", ">", 170), rejected=("r",), passed=("p",))
    got = {r[0]: r[1] for r in docs.select("doc_id", p.score()).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 0.5, "d": 0.5, "r": -1.0, "p": 1.0}
    through = proxies.HeuristicProxy(Predicate("height", ">", 170), through=("height",))
    assert {r[0] for r in docs.select(through.score()).collect()} == {1.0}
    assert proxies.guard_key(p.predicate) == "height::>::170"


def test_recalibration_and_fallback(spark):
    rows = spark.createDataFrame([(i, i / 10) for i in range(1, 11)], "doc_id int, s double")
    a, h = Proxy("a", F.col("s"), 2.0), Proxy("h", F.col("s"), 2.0)
    new = proxies.recalibrated([a, h], rows.where("s > 0.6"), 0.95, ("h",))
    assert new[0].threshold == pytest.approx(0.7) and new[1].threshold == 0.5
    assert [p.threshold for p in proxies.recalibrated([a], rows.limit(0), 0.9)] == [0.0]
    assert proxies.survivors_or_fallback(rows, new)[1] == "cascade"
    kept, how = proxies.survivors_or_fallback(rows, [a, new[1]], learned=("a",))
    assert how == "conservative" and kept.count() == 6
    assert proxies.survivors_or_fallback(rows, [a, h])[1] == "all"
    assert proxies.observed_pass_rates(rows, new)[0].pass_rate == a.pass_rate
    more = rows.unionByName(rows)
    assert proxies.observed_pass_rates(more, new)[0].pass_rate == pytest.approx(0.4)


def test_learned_scores(spark):
    rows = spark.createDataFrame([(i, [float(i % 2), float(i % 3)], i % 2) for i in range(40)], "doc_id int, v array<double>, y int")
    got = proxies.learned_scores(rows, rows, "v", "y", [1.0]).select("y", "score").collect()
    assert all((r.score > 0.5) == (r.y == 1) for r in got)
    assert proxies.learned_scores(rows, rows.where("y = 0"), "v", "y") is None


def test_records_and_contradictions(spark, records):
    both = records.groupBy("doc_id").agg(F.collect_list("data").alias("r"))
    hit = both.select("doc_id", proxies.any_record(F.col("r"), [Predicate("city", "=", "ulm"), Predicate("age", "<", 50)]).alias("x"))
    assert not any(r.x for r in hit.collect())
    docs = spark.createDataFrame([("d4", "age of 61"), ("d9", "age of 80"), ("d8", "no word")], "doc_id string, doc_text string")
    oracle = proxies.oracle_docs(records, "mayor", [Predicate("age", ">", 50)])
    assert [r.doc_id for r in proxies.contradicted(docs, oracle, Predicate("age", ">", 50)).collect()] == ["d9"]


def test_centres_are_bounded(spark):
    rows = spark.createDataFrame([(i, float(i), 0) for i in range(5)], "doc_id int, s double, wrong int")
    chosen = proxies.conformal_centres(rows, ["s"], "wrong", 0.5)
    assert chosen.count() == 3
    probe = spark.createDataFrame([(1, 0.4), (2, 9.0)], "doc_id int, s double")
    assert {r.doc_id: r.covered for r in proxies.nearest_centre(probe, rows, chosen, ["s"], "doc_id").collect()} == {1: True, 2: False}
    with pytest.raises(ValueError):
        proxies.nearest_centre(probe, rows, chosen, ["s"], "doc_id", most=3)


def test_filters(spark, tmp_path):
    docs = spark.createDataFrame([("a", ["t"], [1.0, 0.0]), ("b", ["u"], [1.0, 0.0]), ("c", None, [0.0, 1.0]), ("d", ["t"], None)], "doc_id string, schema_tables array<string>, embedding array<double>")
    near = filters.SchemaRelevance({"q": ["t"]}, {"q": [1.0, 0.0]}, threshold=0.5)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(near.excluded("q", docs)) == ["b", "c"] and ids(near.kept("q", docs)) == ["a", "d"]
    assert ids(filters.SchemaRelevance({"q": ["t"]}, {"q": [1.0, 0.0]}, target_recall=1.0).excluded("q", docs)) == ["b"]
    failing = filters.SchemaRelevance({}, {"q": [1.0, 0.0]})
    both = filters.Composite([near, failing])
    assert ids(both.excluded("q", docs)) == ["b", "c"] and "schema_relevance" in both.failed
    assert ids(filters.Composite([failing]).excluded("q", docs)) == []
    assert ids(filters.merged([docs.where("doc_id < 'c'"), docs.where("doc_id > 'a'")], "intersection")) == ["b"]
    for path in [str(tmp_path / "f")] * 2:
        assert ids(filters.reused(spark, near, "q", docs, path)) == ["b", "c"]
    with pytest.raises(ValueError):
        filters.create_filter("none such")
    with pytest.raises(ValueError):
        filters.Composite([], "xor")


def test_batches():
    assert adaptive.batches([("a", 5), ("b", 5), ("c", 50), ("d", 1), ("e", 1), ("f", 1)], 2, 10) == [["a", "b"], ["c"], ["d", "e"], ["f"]]
    seen = []

    def fussy(xs):
        seen.append(len(xs))
        if "bad" in xs:
            raise RuntimeError
        return [x.upper() for x in xs]

    assert adaptive.with_halving(["a", "b", "bad", "c"], fussy, lambda x: None) == ["A", "B", None, "C"] and seen[0] == 4


def test_discovery(spark):
    docs = spark.createDataFrame([(f"d{i:03}", i, "t" if i < 30 else "u") for i in range(90)], "doc_id string, doc_pos long, kind string")
    cells = lambda b: b.select("doc_id", F.col("kind").alias("table_id"), F.concat(F.lit("c"), (F.col("doc_pos") % 2).cast("string")).alias("column_name"))
    full = adaptive.discover(docs, cells, adaptive.EntropyRule(needed=99), size=20)
    assert full.documents == 90 and full.batches == 5 and not full.stopped and full.schema == {"t": ["c0", "c1"], "u": ["c0", "c1"]}
    early = adaptive.discover(docs, cells, adaptive.EntropyRule(limit=0.1, needed=2, least=20, epsilon=0.2, delta=0.5), size=10)
    assert early.stopped and early.documents == 30 and early.schema == {"t": ["c0", "c1"]}
    mass = adaptive.discover_by_missing_mass(docs, cells, adaptive.MissingMassRule(0.05, 10), size=10)
    assert mass.stopped and mass.documents == 10
    fit = adaptive.tailored(docs, {}, lambda s, b: adaptive.folded(s, adaptive.schema_of(cells(b))), "doc_pos", adaptive.EntropyRule(needed=1, limit=0.1, least=1, epsilon=0.5, delta=0.9), size=10)
    assert fit.schema == {"u": ["c0", "c1"]}
    assert adaptive.discover(docs.limit(0), cells).documents == 0
    assert adaptive.entropy(set(), None) == 1.0 and adaptive.entropy({"a"}, {"a"}) == 0.0 and adaptive.entropy({"a", "b"}, {"a"}) == 0.5
    assert adaptive.grown({"t": ["a"]}, lambda s: {"t": ["b"]}, 2) == {"t": ["a", "b"]}


def test_metrics(spark):
    truth = spark.createDataFrame([("a", "x", "1"), ("a", "y", None), ("b", "x", "2"), ("c", "x", "3")], "doc_id string, column_name string, value string")
    said = spark.createDataFrame([("a", "x", "1.0"), ("a", "y", "NA"), ("b", "x", None), ("c", "x", "9"), ("z", "x", "5")], "doc_id string, column_name string, value string")
    out = {r.doc_id: (r.tp, r.fp, r.fn, r.tn, r.correct) for r in metrics.cell_outcomes(truth, said, truth).collect()}
    assert out == {"a": (1, 0, 0, 1, True), "b": (0, 0, 1, 0, False), "c": (0, 1, 0, 0, False), "z": (0, 1, 0, 0, False)}
    r = metrics.ratios(metrics.cell_outcomes(truth, said, truth)).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 2, 1, 1) and r.recall == 0.5
    judged = metrics.attribute_accuracy(truth, said, ["doc_id"], lambda a, b: a == "9").where("column_name = 'x'").first()
    assert (judged.total, judged.correct, judged.judged) == (3, 2, 1)
    s = metrics.set_counts(truth.select("doc_id"), said.select("doc_id")).first()
    assert (s.tp, s.fp, s.fn) == (3, 0, 1)
    assert metrics.harvested({"a": {"recall": 1, "x": [{"recall": 0.5}]}}) == {"recall": [1.0, 0.5]} and metrics.summary([1.0, 3.0])["mean"] == 2.0


def test_engine_and_command_line(spark, collection, tmp_path):
    config = {"root": collection, "output": str(tmp_path / "out")}
    (tmp_path / "run.json").write_text(json.dumps(config))
    events = []
    remove = engine.on_progress(events.append)
    (report,) = engine.run(spark, engine.Config.of(config))
    remove()
    assert report["recall"] == report["precision"] == 1.0 and report["truth_rows"] == 2
    assert {e["stage"] for e in events} == {"extract", "evaluate"}
    out = io.StringIO()
    assert main(["evaluate", str(tmp_path / "run.json"), "--query", "q1"], out) == 0 and json.loads(out.getvalue())["recall"] == 1.0
    assert main(["validate", collection], out) == 0
    out = io.StringIO()
    main(["sql", collection, "SELECT name FROM city WHERE size > 200000"], out)
    assert json.loads(out.getvalue()) == {"name": "Bonn"}
    for bad in ({"rot": 1}, {"version": 2}, {"stages": ["x"]}, {"target_recall": 0}, {"merge": "x"}, {"loader": "x"}):
        with pytest.raises(ValueError):
            engine.Config.of(bad)


@pytest.mark.parametrize(
    ("p", "kept"),
    [
        (Predicate("v", "=", 5), True), (Predicate("v", "=", "5"), False), (Predicate("v", "=", "a"), True), (Predicate("v", "<>", "a"), False), (Predicate("v", "<", "a"), False),
        (Predicate("v", "<", 3), True), (Predicate("v", "IN", ["a", "5"]), False), (Predicate("v", "IN", ["a", "b"]), True), (Predicate("v", "LIKE", "%50"), False),
        (Predicate("v", "LIKE", "a%"), True), (Predicate("v", "IS NULL", None), False), (Predicate("v", "BETWEEN", [1, 2]), True),
    ],
)
def test_only_predicates_that_lose_no_answer_are_applied_early(p, kept):
    assert engine.keeps_all_answers(p) is kept


def test_request_in_memory(spark):
    docs = [{"doc_id": "1", "doc_text": "Ulm 126000"}, {"doc_id": "2", "doc_text": "Bonn 330000"}]

    def words(frame, schema):
        parts = F.split("doc_text", " ")
        return frame.select("doc_id", F.lit("city").alias("table_id"), F.lit("0").alias("record_id"), F.create_map(F.lit("name"), parts[0], F.lit("size"), parts[1]).alias("data"))

    done = engine.run_request(spark, docs, SCHEMA, [{"query_id": "q", "sql": "SELECT name FROM city WHERE size > 200000"}], words)
    assert [r.name for r in done["q"].answer().collect()] == ["Bonn"]
    engine.register_provider("echo", lambda model: model.upper(), ("e",))
    assert engine.provider("e/x") == "E/X"
    with pytest.raises(ValueError):
        engine.provider("nobody")


def test_every_document_has_its_batch(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "id % 7 AS n_chars")
    got = {r["at"]["k"]: r["batch"] for r in adaptive.batched(docs, 64, "n_chars").collect()}
    assert got == {i: place // 64 for place, i in enumerate(sorted(range(1000), key=lambda i: (i % 7, i)))}
