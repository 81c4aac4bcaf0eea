"""The full reducer against the whole join, on random trees, cycles and null keys."""

import random

from pyspark.sql import functions as F

from lumenar.operators import relational
from lumenar.plans import sqlx


def test_join_tree_tells_cycles_apart():
    joins = [(("a", "x"), ("b", "x")), (("c", "y"), ("b", "y")), (("a", "z"), ("c", "z")), (("b", "w"), ("a", "w")), (("d", "q"), ("d", "r")), (("e", "p"), ("f", "p"))]
    tree, cycles = relational.join_tree(joins)
    assert [(e.parent, e.child) for e in tree] == [("a", "b"), ("a", "c"), ("e", "f")]
    assert tree[0].columns == (("x", "x"), ("w", "w")) and [(e.parent, e.child, e.columns) for e in cycles] == [("c", "b", (("y", "y"),))]
    assert relational.join_tree([]) == ([], [])


def reduced_by_join(rows, joins):
    """The rows that the inner join of all tables uses, by nested loops."""
    names = list(rows)
    used = {t: set() for t in names}

    def go(k, chosen):
        if k == len(names):
            for t in names:
                used[t].add(chosen[t][0])
            return
        t = names[k]
        for r in rows[t]:
            chosen[t] = r
            if all(a[0] not in names[: k + 1] or b[0] not in names[: k + 1] or (chosen[a[0]][a[1]] is not None and chosen[a[0]][a[1]] == chosen[b[0]][b[1]]) for a, b in joins):
                go(k + 1, chosen)
        chosen.pop(t, None)

    go(0, {})
    return used


def test_full_reducer_leaves_what_the_join_uses(spark):
    rng = random.Random(2)
    for shape in ([(0, 1), (1, 2), (2, 3)], [(0, 1), (0, 2), (0, 3)], [(1, 0), (1, 2), (3, 2), (0, 1)]):
        rows = {f"t{i}": [(j, *(rng.choice([None, *range(5)]) for _ in range(3))) for j in range(9)] for i in range(4)}
        joins = [((f"t{a}", rng.randrange(1, 4)), (f"t{b}", rng.randrange(1, 4))) for a, b in shape]
        frames = {t: spark.createDataFrame(r, "c0 long, c1 long, c2 long, c3 long") for t, r in rows.items()}
        got = relational.fully_reduced(frames, [((a, f"c{x}"), (b, f"c{y}")) for (a, x), (b, y) in joins], F.col)
        assert {t: {r["c0"] for r in f.collect()} for t, f in got.items()} == reduced_by_join(rows, joins)


def test_cycles_are_reduced_safely(spark):
    rows = {"a": [(1, 1, 1), (2, 2, 2), (3, 9, 3)], "b": [(1, 1, 1), (2, 2, 3)], "c": [(1, 1, 1), (2, 3, 2)]}
    joins = [(("a", 1), ("b", 1)), (("b", 2), ("c", 1)), (("c", 2), ("a", 2))]
    frames = {t: spark.createDataFrame(r, "c0 long, c1 long, c2 long") for t, r in rows.items()}
    got = relational.fully_reduced(frames, [((a, f"c{x}"), (b, f"c{y}")) for (a, x), (b, y) in joins], F.col)
    want = reduced_by_join(rows, joins)
    left = {t: {r["c0"] for r in f.collect()} for t, f in got.items()}
    assert all(want[t] <= left[t] for t in want) and left["a"] == {1, 2}


def test_tables_are_read_along_their_joins():
    plan = sqlx.analyse("SELECT 1 FROM a JOIN b ON a.x = b.x JOIN c ON b.y = c.y JOIN d ON c.z = d.z WHERE d.v > 1 AND a.w > 1 AND d.u > 2 AND b.t > 3 AND b.s > 2 AND b.q > 1", {t: [] for t in "abcd"})
    assert sqlx.joined_order(plan) == ["b", "a", "c", "d"]
    assert sqlx.joined_tables(plan, "a") == set("abcd")
    apart = sqlx.analyse("SELECT 1 FROM a, b WHERE b.x > 1", {"a": [], "b": ["x"]})
    assert sqlx.joined_order(apart) == ["b", "a"] and sqlx.joined_tables(apart, "a") == {"a"}
