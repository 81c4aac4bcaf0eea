"""The table of alphas against direct counting and against the plan that probes one pair at a time."""

import random

import pytest
from pyspark.sql import functions as F

from lumenar.operators import alpha_table, cascade
from lumenar.plans import runtime


def scored(spark, seed, n=300):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, *map(float, range(40))]), rng.random() if rng.random() > 0.1 else None, rng.randrange(60)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, d double, p double, answer long")


@pytest.mark.parametrize("seed", [1, 2])
def test_costs_are_those_of_direct_counting(spark, seed):
    rows, docs = scored(spark, seed)
    grid = [0.0, 0.05, 0.2, 0.9, 1.0]
    ranked = alpha_table.alpha_table(docs, F.col("d"), F.col("p"), grid, grid)
    costs, (kept, total) = ranked.costs(), ranked.answers(docs.select("doc_id", "answer"))
    for a in grid:
        for b in (0.0, 0.2, 1.0):
            assert costs[a, b] == cascade.surviving_documents(docs, F.col("d"), a, F.col("p"), b)

    def cut(values, alpha):
        known = sorted(v for v in values if v is not None)
        return float("-inf") if alpha <= 0 else known[min(int(alpha * len(known) + 1e-9), len(known) - 1)]

    for a in grid:
        for b in grid:
            x, y = cut([r[1] for r in rows], a), cut([r[2] for r in rows], b)
            lost = {r[3] for r in rows if r[1] is None or r[2] is None or r[1] < x or r[2] < y}
            assert kept[a, b] == len({r[3] for r in rows} - lost)
    assert total == len({r[3] for r in rows})


def test_plan_of_a_query_is_that_of_single_probes(spark):
    _, docs = scored(spark, 5)
    grid = [0.0, 0.01, 0.02, 0.05, 0.1]
    plan = alpha_table.plan_of_query(docs, F.col("d"), F.col("p"), grid, 0.85)
    seen = {}

    def cost(a):
        key = a["doc"], a["predicate"]
        if key not in seen:
            seen[key] = cascade.surviving_documents(docs, F.col("d"), key[0], F.col("p"), key[1])
        return seen[key]

    want = cascade.alpha_plan(["doc", "predicate"], grid, 0.85, cost, "predicate")
    assert (plan.alphas, plan.cost, plan.steps) == (want.alphas, want.cost, want.steps)
    with_answers = alpha_table.plan_of_query(docs, F.col("d"), F.col("p"), grid, 0.85, docs.select("doc_id", "answer"))
    assert with_answers.calibrated and with_answers.alphas["predicate"] <= plan.alphas["predicate"] + 1e-12
    options = runtime.with_alphas(runtime.RuntimeOptions(proxies="heuristic"), plan)
    assert options.target_recall == 1 - plan.alphas["predicate"] and options.proxies == "heuristic"


def test_tables_of_nothing(spark):
    _, docs = scored(spark, 1)
    none = alpha_table.alpha_table(docs.limit(0), F.col("d"), F.col("p"), [0.0, 0.1], [0.0, 0.1])
    assert set(none.costs().values()) == {0} and none.answers(docs.select("doc_id", "answer").limit(0))[1] == 0
