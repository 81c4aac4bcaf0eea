"""Joins and samples in which no key's rows meet in one task, however many it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot with more rows than this, and than a thousandth of all rows.
LEAST_HOT = 1000
HOT_KEYS = 1000
#: Expected rows of a sample before its last cut, as a multiple of the rows wanted.
MARGIN = 2.0


def hot_bound(total: int) -> int:
    """Rows beyond which a key is hot: of ``total`` rows, at most HOT_KEYS keys can have more."""
    return max(LEAST_HOT, -(-total // HOT_KEYS))


def join_facts(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """Inner or left join of ``rows`` with ``facts``, which holds one row a key and in ``n`` that key's rows in ``rows``.

    The facts of hot keys, at most HOT_KEYS where ``n`` sums to ``total``, are broadcast, so their
    rows stay where they are; all other rows are shuffled by key. Null keys have no match, and
    in a left join they are not shuffled either.
    """
    most = hot_bound(total)
    others = [c for c in facts.columns if c != key]
    if total <= most:  # no key can be hot
        return rows.join(facts, key, how).select(*rows.columns, *others)
    hot = facts.where(F.col(n) > most).select(key, F.struct(*others).alias("_hot"))
    marked = rows.where(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left")
    many = marked.where("_hot is not null").select(*rows.columns, *(F.col("_hot")[c].alias(c) for c in others))
    few = marked.where("_hot is null").drop("_hot").join(facts.where(F.col(n) <= most), key, how)
    joined = many.unionByName(few.select(*rows.columns, *others))
    if how == "left":
        kinds = facts.schema
        joined = joined.unionByName(rows.where(F.col(key).isNull()).select(*rows.columns, *(F.lit(None).cast(kinds[c].dataType).alias(c) for c in others)))
    return joined


def look_up(rows: DataFrame, facts: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``join_facts`` where nothing is known of the keys' counts; ``total`` is the number of ``rows``."""
    if total <= hot_bound(total):
        return rows.join(facts, key, how).select(*rows.columns, *(c for c in facts.columns if c != key))
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return join_facts(rows, facts.join(counts, key), key, "_n", total, how).drop("_n")


def likely_first(key: Column, wanted: int, distinct: Column) -> Column:
    """Whether ``key`` may be one of the ``wanted`` smallest by ``xxhash64(key)`` of ``distinct`` keys.

    About MARGIN times as many pass (all, if there are no more), so a sort of what is left is
    small at any input size; that fewer than 400 of an expected 800 pass has a chance under 1e-40.
    """
    return F.xxhash64(key) / F.lit(2.0**64) + 0.5 <= F.lit(MARGIN * wanted) / distinct
