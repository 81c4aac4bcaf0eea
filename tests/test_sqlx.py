import pytest

from lumenar.plans import sqlx
from lumenar.plans.sqlx import Predicate


def one(sql):
    (p,) = sqlx.predicates(sql)
    return p


@pytest.mark.parametrize(
    ("where", "expected"),
    [
        ("CAST(row_id AS INTEGER) <= 89", Predicate("row_id", "<=", 89)),
        ("LOWER(TRIM(t.name)) = 'x'", Predicate("name", "=", "x", "t")),
        ("title = 'A <= B AND C'", Predicate("title", "=", "A <= B AND C")),
        ("name LIKE '%it''s%'", Predicate("name", "LIKE", "%it's%")),
        ("a NOT IN ('x', 2, -3.5)", Predicate("a", "NOT IN", ["x", 2, -3.5])),
        ("a BETWEEN 1 AND 3", Predicate("a", "BETWEEN", [1, 3])),
        ("\"odd name\" IS NOT NULL", Predicate("odd name", "IS NOT NULL", None)),
        ("[b] IS NULL", Predicate("b", "IS NULL", None)),
        ('x = "Other"', Predicate("x", "=", "Other")),
        ("((x <> 4))", Predicate("x", "<>", 4)),
    ],
)
def test_conditions(where, expected):
    assert one(f"SELECT * FROM t WHERE {where} ORDER BY 1") == expected


def test_conjuncts_and_safety():
    sql = "SELECT a.x FROM course AS a LEFT OUTER JOIN teaches b ON a.title = b.course_title AND b.k > 1 WHERE a.x = 1 AND b.y IN (SELECT y FROM z) AND a.p = b.q AND (a.x = 1 OR a.x = 2) AND dept = 'CS'"
    got = sqlx.analyse(sql, {"course": ["x", "p", "title", "dept"], "teaches": ["y", "q", "course_title"]})
    assert got.safe == {"course": [Predicate("x", "=", 1, "a"), Predicate("dept", "=", "CS")]}
    assert [r for _, r in got.unsafe] == ["subquery", "compares columns", "disjunction"]
    assert got.joins == [sqlx.Join(("course", "title"), ("teaches", "course_title"))]
    assert sqlx.table_order(got) == ["course", "teaches"]


@pytest.mark.parametrize("kind", ["JOIN", "INNER JOIN", "FULL OUTER JOIN"])
def test_join_parent_is_the_earlier_table(kind):
    got = sqlx.analyse(f"SELECT 1 FROM b {kind} a ON a.k = b.k")
    assert got.joins == [sqlx.Join(("b", "k"), ("a", "k"))]


def test_set_operations_only_outside_literals():
    assert not sqlx.has_set_operation("SELECT 1 FROM t WHERE a = 'UNION'") and sqlx.has_set_operation("SELECT 1 UNION SELECT 2")
    assert sqlx.analyse("SELECT a FROM t WHERE a = 1 INTERSECT SELECT a FROM u").unsafe == [("a = 1", "set operation")]
    assert not sqlx.has_join("SELECT 'JOIN' FROM t") and sqlx.alias_map('FROM "my t" x') == {"x": "my t", "my t": "my t"}


def test_cycles_and_selective_order():
    got = sqlx.analyse("SELECT 1 FROM a JOIN b ON a.x = b.x JOIN c ON b.y = c.y WHERE c.z = 1 AND c.w = 2 AND b.q = 1")
    assert sqlx.table_order(got) == ["a", "b", "c"] and sqlx.table_order(got, selective_first=True) == ["c", "b", "a"]
    assert sqlx.quote('a"b') == '"a""b"'
