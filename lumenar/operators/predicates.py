"""Predicates as columns over text cells: numeric literals compare numerically, text regardless of case, nulls fail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenar.functions.values import number
from lumenar.plans.sqlx import Predicate


def compile_predicate(p: Predicate, value: Column) -> Column:
    text = F.lower(value.cast("string"))
    plain = value.cast("string")
    op = p.operator.upper()
    if op == "IS NULL":
        test = value.isNull() | (F.trim(plain) == "")
    elif op == "IS NOT NULL":
        test = F.trim(plain) != ""
    elif op in ("=", "!=", "<>"):
        equal = number(plain) == F.lit(float(p.value)) if p.is_numeric else text == str(p.value).lower()
        test = equal if op == "=" else ~equal
    elif op in ("<", ">", "<=", ">="):
        v, e = number(plain), number(F.lit(str(p.value)))
        test = {"<": v < e, ">": v > e, "<=": v <= e, ">=": v >= e}[op]
    elif op in ("LIKE", "NOT LIKE"):
        like = plain.ilike(str(p.value))
        test = like if op == "LIKE" else ~like
    elif op in ("IN", "NOT IN"):
        inside = text.isin(*[str(v).lower() for v in p.value])
        test = inside if op == "IN" else ~inside
    elif op == "BETWEEN":
        test = number(plain).between(float(p.value[0]), float(p.value[1]))
    elif op == "CONTAINS":
        test = text.contains(str(p.value).lower())
    else:
        raise ValueError(f"unknown operator {p.operator}")
    return F.coalesce(test, F.lit(False))


def all_of(predicates: list[Predicate], column: dict[str, Column] | None = None) -> Column:
    """The conjunction; predicates on one attribute all count."""
    tests = [compile_predicate(p, (column or {}).get(p.attribute, F.col(p.attribute))) for p in predicates]
    return reduce(lambda a, b: a & b, tests, F.lit(True))
