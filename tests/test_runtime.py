"""Reduction before extraction, model providers, classifiers, curation and repairs on small fixtures."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenar import engine, providers
from lumenar.functions import evidence
from lumenar.operators import cascade, classifiers, curation, metrics, ranks, relational
from lumenar.plans import runtime
from lumenar.plans.sqlx import Predicate, analyse
from lumenar.sources import datasets, sinks

COLUMNS = {"city": ["name", "size"], "mayor": ["city", "age"]}
SCHEMA = [{"Schema Name": t, "Attributes": [{"Attribute Name": c} for c in cs]} for t, cs in COLUMNS.items()]
CELLS = [
    ("d1", "city", {"name": "Ulm", "size": "126000"}, "Ulm has a size of 126000"), ("d2", "city", {"name": "Bonn", "size": "330000"}, "Bonn, a size of 330000"), ("d3", "city", {"name": "Hof", "size": "45000"}, "Hof has the size 45000"),
    ("d4", "mayor", {"city": "Ulm", "age": "61"}, "age 61"), ("d5", "mayor", {"city": "Bonn", "age": "44"}, "age 44"), ("d6", "mayor", {"city": "Hof", "age": "70"}, "age 70"), ("d7", "mayor", {"city": None, "age": "70"}, "age 70"),
]
SQL = "SELECT c.name, m.age FROM city c JOIN mayor m ON c.name = m.city WHERE c.size > 100000 AND m.age > 50"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(d, x, t, [float(i % 2), 1.0]) for i, (d, t, _, x) in enumerate(CELLS)], "doc_id string, doc_text string, source_table string, embedding array<double>")


@pytest.fixture
def records(spark):
    return spark.createDataFrame([(d, t, "0", x) for d, t, x, _ in CELLS], runtime.RECORDS)


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def tables_run(docs, records, sql=SQL, safe=True, **options):
    seen = []

    def extract(frame, schema):
        seen.append((schema[0]["Schema Name"], [a["Attribute Name"] for a in schema[0]["Attributes"]], ids(frame)))
        return runtime.materialised_extractor(records)(frame, schema)

    assigned = runtime.assigned_tables(docs, list(COLUMNS))
    runs = runtime.run_tables(docs, assigned, SCHEMA, analyse(sql, COLUMNS), extract, runtime.RuntimeOptions(**options), records, safe)
    return {r.table: r for r in runs}, seen


def test_documents_are_rejected_before_they_are_read(docs, records):
    runs, seen = tables_run(docs, records, proxies="heuristic")
    assert ids(runs["city"].read) == ["d1", "d2"] and ids(runs["mayor"].read) == ["d4"]
    assert ("mayor", ["city"], ["d4", "d6", "d7"]) in seen  # the join key alone, of those that the proxy passed
    assert seen[-1] == ("mayor", ["city", "age"], ["d4"])
    whole, _ = tables_run(docs, records, proxies="heuristic", target_recall=1.0, join_resolution=False)
    assert len(ids(whole["city"].read)) == 3 and len(ids(whole["mayor"].read)) == 4
    unsafe, _ = tables_run(docs, records, safe=False)
    assert len(ids(unsafe["mayor"].read)) == 4
    with pytest.raises(ValueError):
        runtime.RuntimeOptions(proxies="guess")


def test_a_table_of_which_nothing_survives_spares_its_neighbour(docs, records):
    runs, _ = tables_run(docs, records, SQL.replace("100000", "900000"))
    assert runs["mayor"].how == "empty join" and runs["mayor"].records.count() == 0 and ids(runs["mayor"].assigned) == ["d4", "d5", "d6", "d7"]


def test_learned_proxies_and_the_oracle(spark, docs, records):
    many = docs.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("doc_id", F.concat_ws("_", "doc_id", "n")).drop("n")
    truth = records.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("doc_id", F.concat_ws("_", "doc_id", "n")).drop("n")
    sql = "SELECT name FROM city WHERE size > 50000"
    vectors = many.withColumn("embedding", F.when(F.col("doc_id").startswith("d3"), F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))))
    training = vectors.where("doc_id like '%\\_1' or doc_id like '%\\_2'").select("doc_id")
    runs, _ = tables_run(vectors, truth, sql, proxies="learned", vector="embedding", training=training)
    assert {i[:2] for i in ids(runs["city"].read)} == {"d1", "d2"} and runs["city"].how == "cascade"
    best, _ = tables_run(docs, records, sql, proxies="oracle")
    assert ids(best["city"].read) == ["d1", "d2"]
    with pytest.raises(ValueError):
        tables_run(docs, records, sql, proxies="learned")


def test_tables_of_documents(spark):
    docs = spark.createDataFrame([("a", ["x", "t"], None), ("b", None, "u"), ("c", None, "zz"), ("d", None, None), ("e", None, None), ("f", [], None)], "doc_id string, schema_tables array<string>, source_table string")
    cached = spark.createDataFrame([("b", "t")], "doc_id string, table_id string")
    truth = spark.createDataFrame([("d", "t"), ("d", "u"), ("c", "t")], "doc_id string, table_id string")
    got = runtime.assigned_tables(docs, ["t", "u"], cached, truth, lambda left: left.select("doc_id", F.lit("u").alias("table_id")))
    assert sorted(map(tuple, got.collect())) == [("a", "t"), ("b", "t"), ("d", "t"), ("d", "u"), ("e", "u"), ("f", "u")]


def test_extractions_are_cached_and_merged(spark, docs, records, tmp_path):
    path, asked = str(tmp_path / "cache"), []

    def extract(frame, schema):
        asked.append(ids(frame))
        return runtime.materialised_extractor(records)(frame, schema)

    some = {"Schema Name": "city", "Attributes": [{"Attribute Name": "name"}]}
    first, hits = runtime.extracted_through_cache(docs.where("doc_id in ('d1', 'd4')"), some, extract, path)
    assert ids(first) == ["d1"] and hits.count() == 0 and set(first.first().data) == {"name"}
    again, hits = runtime.extracted_through_cache(docs, some, extract, path)
    assert ids(again) == ["d1", "d2", "d3"] and ids(hits) == ["d1", "d4"] and "d4" not in asked[-1]
    _, hits = runtime.extracted_through_cache(docs, SCHEMA[0], extract, path)
    assert hits.count() == 0
    _, hits = runtime.extracted_through_cache(docs, some, extract, path, "other")
    assert hits.count() == 0
    several = records.unionByName(records.where("doc_id = 'd2'").withColumn("record_id", F.lit("1")))
    new = spark.createDataFrame([(d, "city", "0", {"size": "1", "__n": "x"}) for d in ("d1", "d2", "d9")], runtime.RECORDS)
    got = {(r.doc_id, r.record_id): r.data for r in runtime.merged_extraction(several, new).collect()}
    assert got["d1", "0"] == {"name": "Ulm", "size": "1"} and got["d2", "0"]["size"] == "330000" and got["d9", "0"] == {"size": "1"} and len(got) == 9


def test_chunks_are_merged(spark):
    docs = spark.createDataFrame([("p-0", "p", 0), ("p-1", "p", 1), ("q", None, None)], "doc_id string, parent_doc_id string, chunk_index int")
    rows = spark.createDataFrame([("p-0", "t", "0", {"a": "1", "b": None}), ("p-1", "t", "0", {"a": "2", "b": "3"}), ("q", "t", "0", {"a": "9"})], runtime.RECORDS)
    got = {(r.doc_id, r.record_id): r.data for r in runtime.merged_chunk_records(rows, docs, "last_non_null").collect()}
    assert got == {("p", "0"): {"a": "2", "b": "3"}, ("q", "0"): {"a": "9"}}
    assert runtime.merged_chunk_records(rows, docs.drop("chunk_index"), "concat").count() == 3


def test_engine_reduces_and_merges(spark, tmp_path):
    texts = [("d1", "Ulm has a size of 126000", "city"), ("d2", "Bonn, a size of 330000", "city"), ("d3", "Hof has the size 45000", "city")]
    spark.createDataFrame(texts, "doc_id string, doc_text string, source_table string").write.parquet(str(tmp_path / "documents.parquet"))
    truth = [("x", d, "0", t, f"{t}.{c}", c, v, "str", None) for d, t, x, _ in CELLS[:3] for c, v in x.items()]
    spark.createDataFrame(truth, datasets.GROUND_TRUTH).write.parquet(str(tmp_path / "ground_truth.parquet"))
    (tmp_path / "metadata").mkdir()
    (tmp_path / "metadata" / "schema.json").write_text(json.dumps(SCHEMA[:1]))
    (tmp_path / "metadata" / "queries.json").write_text(json.dumps([{"query_id": "q", "sql": "SELECT name FROM city WHERE size > 100000", "required_tables": ["city"], "required_columns": ["city.name"]}]))
    data = datasets.from_manifest(spark, str(tmp_path))
    done = engine.extract(data, data.query("q"), options=engine.RuntimeOptions(proxies="heuristic"))
    assert ids(done.runs[0].read) == ["d1", "d2"] and sorted(r.name for r in done.answer().collect()) == ["Bonn", "Ulm"]
    config = engine.Config.of({"root": str(tmp_path), "output": str(tmp_path / "out"), "stages": ["preprocess", "refine", "extract", "evaluate"], "proxies": "heuristic", "target_recall": 0.9, "cache": str(tmp_path / "cache")})
    for _ in range(2):
        (report,) = engine.run(spark, config)
        assert report["recall"] == report["precision"] == 1.0
    assert json.loads(spark.read.text(str(tmp_path / "out" / "schema_general")).first().value) == {"city": ["name", "size"]}
    assert json.loads(spark.read.text(str(tmp_path / "out" / "q" / "schema")).first().value) == {"city": ["name"]}
    for bad in ({"proxies": "x"}, {"training_documents": -1}):
        with pytest.raises(ValueError):
            engine.Config.of(bad)


def test_completions_are_tried_again_and_repaired(spark):
    recorded = providers.RecordedProvider({"a": '```json\n{"n": 3}\n```', "b": 'so {"n": "x"} it is'}, default=None)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "key int, prompt string")
    done = {r.key: r for r in providers.typed(providers.completions(rows, recorded), "n int").collect()}
    assert done[1].valid and done[1].value.n == 3 and not done[2].valid and done[3].error and not done[4].valid
    calls = []

    def flaky(request):
        calls.append(request)
        if len(calls) < 3:
            raise OSError("busy")
        return providers.Completion("ok")

    assert providers.complete_text(flaky, providers.Request("x")).text == "ok" and len(calls) == 3
    with pytest.raises(OSError):
        providers.complete_text(lambda r: (_ for _ in ()).throw(OSError("down")), providers.Request("x"), 2)
    assert providers.json_block('text {"a": "}"} more {"b": 1}') == {"a": "}"} and providers.json_block("[1]") is None and providers.json_block(None) is None
    with pytest.raises(ValueError):
        providers.create_prompt("none such")
    with pytest.raises(ValueError):
        providers.create_prompt("text_to_sql", schema="x")
    for wrong in (lambda: providers.embedder("nobody/x"), lambda: providers.create_chunker("x", 5), lambda: providers.create_chunker("token", 5, 5)):
        with pytest.raises(ValueError):
            wrong()


def test_text_classifiers(spark):
    rows = spark.createDataFrame([(i, "red round thing" if i % 2 else "blue flat thing", i % 2) for i in range(40)], "doc_id int, doc_text string, label int")
    p = Predicate("shape", "=", "round")
    scored, made = classifiers.fine_tuned(rows.select("doc_id", "doc_text"), {"shape::=::round": rows.select("doc_text", "label")}, [p, Predicate("x", "=", 1)])
    assert [m.name for m in made] == ["finetuned_shape::=::round"] and {r.doc_id % 2 for r in cascade.survivors(scored, made).collect()} == {1}
    assert classifiers.text_classifier(rows.where("label = 1")) is None
    classifiers.register_classifier("has", lambda asked: lambda texts: texts.str.contains(asked.split()[-1], regex=False))
    (has,) = classifiers.pretrained([p], "has")
    assert rows.where(has.score >= 0.5).count() == 20
    (zero,) = [classifiers.zero_shot(Predicate("shape", "=", "round thing"))]
    best = rows.select("doc_id", zero.score.alias("s")).orderBy(F.desc("s")).first()
    assert best.doc_id % 2 == 1
    with pytest.raises(ValueError):
        classifiers.pretrained([p], "unknown")
    sets = classifiers.layer_subsets(list(range(10)), 3, seed=1)
    assert len(sets) == 3 and len({x for s in sets for x in s}) == 9 and sets == classifiers.layer_subsets(list(range(10)), 3, seed=1)


def test_ranks_of_many_ranges(spark):
    rows = spark.range(1000).selectExpr("id", "(id * 7919 % 1009) / 10.0 AS x", "1 AS one")
    got = {r.id: r.c for r in ranks.running_sum(rows, [F.col("x"), F.col("id")], "one", "c").collect()}
    order = sorted(range(1000), key=lambda i: (i * 7919 % 1009, i))
    assert got == {i: n + 1 for n, i in enumerate(order)}
    series = pd.Series([float(r.x) for r in rows.collect()])
    assert ranks.quantile(rows.withColumn("x", F.col("x").cast("double")), "x", 0.37, 1000) == pytest.approx(series.quantile(0.37))


def test_alpha_plans():
    cost = lambda a: 100 - 300 * a["doc"] - 200 * a["p"]
    plan = cascade.alpha_plan(["doc", "p"], [0.0, 0.05, 0.1], 0.8, cost, "p")
    assert plan.alphas["doc"] == 0.1 and plan.alphas["p"] > 0.1 and not plan.calibrated
    kept = cascade.alpha_plan(["doc", "p"], [0.0, 0.05, 0.1], 0.8, cost, "p", lambda a: 1 - 3 * a)
    assert kept.calibrated and kept.alphas["p"] == 0.05 and cascade.decide({"x": 0.4}, [lambda r: r["x"], lambda r: 1], [0.5, 0.5]) == (False, [(0, 0.4)])


def test_records_match_query_aware(spark):
    truth = spark.createDataFrame([("a", "t", "0", {"x": "1", "y": "A b."}), ("a", "t", "1", {"x": "2", "y": None})], runtime.RECORDS)
    said = spark.createDataFrame([("a", "t", "5", {"x": "2.0", "y": "n/a"}), ("a", "t", "6", {"x": "1.00", "y": "a  B"}), ("a", "t", "7", {"x": "2", "y": "c"})], runtime.RECORDS)
    got = {r.record_id: (r.predicted_id, r.equal_cells) for r in relational.match_records(said, truth, {"t": ["x", "y"]}).collect()}
    assert got == {"0": ("6", 2), "1": ("5", 2)}


def test_voting_errors(spark):
    rows = spark.createDataFrame([(1, 1, 1, 0), (1, 0, 0, 1), (0, 0, 0, 0), (1, 1, 1, 1)], "y int, a int, b int, c int")
    assert metrics.voting_error(rows.limit(0), "y", ["a", "b", "c"]).first().error == 0
    assert metrics.voting_error(rows.where("y = 0"), "y", ["a", "b", "c"]).first().error == 0
    assert 0 < metrics.voting_error(rows, "y", ["a", "b", "c"]).first().error < 1
    with pytest.raises(ValueError):
        metrics.voting_error(rows, "y", ["a"])


def test_curated_candidates_are_bounded_and_differ():
    made = [curation.Candidate(f"s{i}", ("t",) if i % 3 else ("t", "u"), f"c{i % 4}", "=", str(i % 2), i, i / 40, 0.5) for i in range(40)]
    few = curation.prefiltered(made, [0.5], 10)
    assert len(few) == 10 and len({c.sql for c in few}) == 10
    chosen = curation.diverse(few, 4, 2)
    assert len(chosen) == 4 and sum(c.is_join for c in chosen) >= 2 and len({c.predicate for c in chosen}) == 4
    assert curation.diverse([], 4, 2) == [] and curation.nearest_bucket(0.3, [0.1, 0.5]) == 0.1
    q = curation.one_predicate_query("q", "t", "c", "=", "it's", "n")
    assert q["sql"].endswith("= 'it''s'") and q["required_columns"] == ["t.n", "t.c"]


def test_registries(spark, tmp_path):
    (tmp_path / "registry.json").write_text(json.dumps({"datasets": [{"dataset_id": "a", "path": "x", "queries": ["q1"]}, {"dataset_id": "b"}]}))
    listed = datasets.registry(spark, str(tmp_path))
    assert [d["path"] for d in listed] == ["x", "b"] and datasets.selected_datasets(listed, "b, a", ["q2,q3"])[0]["queries"] == ["q2", "q3"]
    assert [d["dataset_id"] for d in datasets.selected_datasets(listed, ["b"])] == ["b"]
    with pytest.raises(ValueError):
        datasets.selected_datasets(listed, "c")
    assert {r.error for r in datasets.registry_errors(spark, str(tmp_path)).collect()} == {"cannot be read"}


def test_reports_and_spans(spark, tmp_path):
    rows = spark.createDataFrame([("a|b", "x\ny", None)], "p string, q string, r int")
    sinks.write_report(rows, str(tmp_path))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "markdown")).collect())
    assert "| a\\|b | x y |  |" in text and "| p | q | r |" in text
    assert evidence.span_of_tokens([2, 3], [1, 2, 3, 2, 3], ((1, 3),)) == (3, 5) and evidence.span_of_tokens([], [1]) is None
    assert evidence.span_of_text("new york", ["▁New", "▁Yo", "rk", "!"]) == (0, 3) and evidence.span_of_text("x", ["y"]) is None
    assert evidence.loosely_equal("Ａ b", "a B") and not evidence.loosely_equal("a", None) and evidence.loosely_equal("[1, 2]", "[1,2]")
    assert evidence.parsed_numbers("120 students took the SAT test. A quarter of the students scored over 1500.", "num_ge1500", common=False) == [30.0]
    assert evidence.parsed_numbers("No students scored above 1500", "num_ge1500")[-1] == 0.0
