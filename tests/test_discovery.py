"""Stop points and batches against the loops that they replace, on random documents."""

import random

import pytest

from lumenar.operators import adaptive, segments, stop_points


def random_cells(seed, n=230):
    rng = random.Random(seed)
    features = rng.choice([0, 1, 5, 40])
    cells = []
    for i in range(n):
        for _ in range(rng.choice([0, 1, 2]) if features else 0):
            cells.append((i, f"t{rng.randrange(3)}", f"c{int(rng.paretovariate(1)) % features}" if rng.random() > 0.02 else None))
    if seed == 3:
        cells = [c for c in cells if c[0] % 50 == 0] * 2
    return cells


def frames(spark, seed, n=230):
    rng = random.Random(1000 + seed)
    docs = spark.createDataFrame([(i, rng.random()) for i in range(n)], "doc_id long, pos double")
    return docs, spark.createDataFrame(random_cells(seed, n), "doc_id long, table_id string, column_name string").cache(), rng


def told(found):
    rows = found.collect()
    return {(r["table_id"], r["column_name"]) for r in rows}, {(r["documents"], r["batches"], r["stopped"]) for r in rows}


def looped(d):
    return {(t, c) for t, cs in d.schema.items() for c in cs}, {(d.documents, d.batches, d.stopped)} if d.schema else set()


@pytest.mark.parametrize("seed", range(6))
def test_stop_by_entropy_is_that_of_the_loop(spark, seed):
    docs, cells, rng = frames(spark, seed)
    rule = {"limit": rng.choice([0.0, 0.02, 0.1, 1.5]), "needed": rng.choice([0, 1, 3]), "least": rng.choice([1, 60, 1000]), "epsilon": rng.choice([0.02, 0.2]), "delta": rng.choice([0.01, 0.5])}
    size = rng.choice([20, 50, 500])
    loop = adaptive.discover(docs, lambda b: cells.join(b.select("doc_id"), "doc_id"), adaptive.EntropyRule(**rule), size, "pos")
    assert told(stop_points.discovered(docs, cells, adaptive.EntropyRule(**rule), size, "pos")) == looped(loop)


@pytest.mark.parametrize("seed", range(10, 15))
def test_stop_by_missing_mass_is_that_of_the_loop(spark, seed):
    docs, cells, rng = frames(spark, seed)
    rule, size = {"delta": rng.choice([0.01, 0.05, 0.3]), "least": rng.choice([1, 60, 1000])}, rng.choice([20, 50, 500])
    loop = adaptive.discover_by_missing_mass(docs, lambda b: cells.join(b.select("doc_id"), "doc_id"), adaptive.MissingMassRule(**rule), size, "pos")
    assert told(stop_points.discovered(docs, cells, adaptive.MissingMassRule(**rule), size, "pos")) == looped(loop)


def test_stop_points_of_nothing(spark):
    docs, cells, _ = frames(spark, 2)
    for rule in (adaptive.EntropyRule(), adaptive.MissingMassRule()):
        assert stop_points.discovered(docs.limit(0), cells.limit(0), rule, 10, "pos").count() == 0
        assert stop_points.discovered(docs, cells.limit(0), rule, 10, "pos").count() == 0


@pytest.mark.parametrize(("n", "most_docs", "most_chars", "block"), [(1, 3, 10, 4), (400, 7, 60, 20), (400, 7, 60, 7), (200, 1, 5, 3), (300, 50, 1000, 60), (200, 20, 0, 30)])
def test_batches_by_size_are_those_of_the_loop(spark, n, most_docs, most_chars, block):
    rng = random.Random(n + most_docs)
    rows = [(i, rng.choice([0, 1, 5, 9, 13, 30, 80])) for i in range(n)]
    want = {doc: b for b, ids in enumerate(adaptive.batches(rows, most_docs, most_chars)) for doc in ids}
    docs = spark.createDataFrame(rng.sample(rows, n), "doc_id long, n_chars long")
    got = {r["at"]["k"]: r["batch"] for r in segments.batches_by_size(docs, most_docs, most_chars, order="doc_id", block_docs=block).collect()}
    assert got == want


def test_batches_by_size_of_odd_lengths(spark):
    docs = spark.createDataFrame([(1, None), (2, -5), (3, 10), (4, 1)], "doc_id long, n_chars long")
    got = {r["at"]["k"]: r["batch"] for r in segments.batches_by_size(docs, 10, 10, order="doc_id").collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1}
    assert segments.batches_by_size(docs.limit(0), 10, 10, order="doc_id").count() == 0
    with pytest.raises(ValueError, match="one document"):
        segments.batches_by_size(docs, 0, 10)


def test_k_center_in_few_passes_is_the_greedy_one(spark):
    from lumenar.operators import similarity

    rng = random.Random(9)
    points = {i: [float(rng.randrange(6)), float(rng.randrange(6)), rng.random()] for i in range(60)}
    points |= {100 + i: points[i] for i in range(10)}  # repeated vectors
    frame = spark.createDataFrame([*points.items(), (999, None)], "vec_id long, embedding array<float>")
    exact = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in frame.where("embedding is not null").collect()}
    want = [3]
    while len(want) < 12:
        want.append(min((i for i in exact if i not in want), key=lambda i: (-min(sum((a - b) ** 2 for a, b in zip(exact[i], exact[c], strict=True)) for c in want), i)))
    for pool in (2, 7, 1024):
        assert similarity.k_center(frame, 12, 3, pool=pool) == want
    assert sorted(similarity.k_center(frame, 500, 3)) == sorted(exact) and similarity.k_center(frame, 5, 12345) == []
