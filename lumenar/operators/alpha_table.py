"""Costs and answer recalls of a whole grid of alphas from one table of ranks.

An alpha gives up that share of the lowest known scores of a stage. A document's rank at a stage is how far up the
grid its score survives; counts of documents by their two ranks, as many rows as the grid has pairs, hold the cost of
every pair of alphas as sums over the upper right. An answer survives where all its documents do, so the lowest
ranks of its documents, one join with the provenance, hold the answer recall of every pair in the same way.
Both take a constant number of jobs, whatever is probed afterwards.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenar.operators import cascade, ranks

DOC, PREDICATE = "doc", "predicate"


def with_leftovers(grid: list[float], target_recall: float) -> list[float]:
    """The grid and, for each of its alphas at the first stage, what the budget leaves over for the second."""
    left = [1 - math.exp(-max(-math.log(max(target_recall, 1e-12)) - cascade.budget(a), 0.0)) for a in grid]
    return sorted({*grid, *left})


def _cuts(scores: DataFrame, column: str, alphas: list[float]) -> list[float]:
    """The least score that survives each alpha: all known scores survive an alpha of 0."""
    n = scores.where(F.col(column).isNotNull()).count()
    if not n:
        return [-math.inf] * len(alphas)
    wanted = [min(math.floor(a * n + 1e-9), n - 1) for a in alphas]
    return [-math.inf if a <= 0 else float(v) for a, v in zip(alphas, ranks.order_statistics(scores, column, wanted), strict=True)]


def _rank(score: Column, cuts: list[float]) -> Column:
    """How many of the ascending cuts the score survives; null scores survive none."""
    return sum((F.when(score >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


@dataclass
class AlphaTable:
    doc_alphas: list[float]
    predicate_alphas: list[float]
    ranks: DataFrame  # key, d, p: how many alphas of each stage the document survives

    def _sums(self, counts: DataFrame) -> list[list[int]]:
        rows = {(r["d"], r["p"]): r["n"] for r in counts.groupBy("d", "p").agg(F.count(F.lit(1)).alias("n")).collect()}  # the grid's pairs at most
        a, b = len(self.doc_alphas), len(self.predicate_alphas)
        out = [[0] * (b + 2) for _ in range(a + 2)]
        for i in range(a, -1, -1):
            for j in range(b, -1, -1):
                out[i][j] = rows.get((i, j), 0) + out[i + 1][j] + out[i][j + 1] - out[i + 1][j + 1]
        return out

    def _table(self, sums: list[list[int]]) -> dict[tuple[float, float], int]:
        return {(x, y): sums[i + 1][j + 1] for i, x in enumerate(self.doc_alphas) for j, y in enumerate(self.predicate_alphas)}

    def costs(self) -> dict[tuple[float, float], int]:
        """(alpha of the document stage, alpha of the predicate stage) -> documents that survive both."""
        return self._table(self._sums(self.ranks))

    def answers(self, sources: DataFrame, key: str = "doc_id", answer: str = "answer") -> tuple[dict[tuple[float, float], int], int]:
        """(alphas -> answers of which all documents survive, number of answers); sources: (answer, key), unknown documents survive nothing."""
        met = sources.join(self.ranks, key, "left")
        least = met.groupBy(answer).agg(F.min(F.coalesce("d", F.lit(0))).alias("d"), F.min(F.coalesce("p", F.lit(0))).alias("p"))
        sums = self._sums(least)
        return self._table(sums), sums[0][0]


def alpha_table(docs: DataFrame, doc_score: Column, predicate_score: Column, doc_alphas: list[float], predicate_alphas: list[float], key: str = "doc_id") -> AlphaTable:
    """Ranks of all documents; a document with a null score at a stage survives no alpha of it."""
    doc_alphas, predicate_alphas = sorted(set(doc_alphas)), sorted(set(predicate_alphas))
    scored = docs.select(key, doc_score.cast("double").alias("_d"), predicate_score.cast("double").alias("_p"))
    told = scored.select(key, _rank(F.col("_d"), _cuts(scored, "_d", doc_alphas)).alias("d"), _rank(F.col("_p"), _cuts(scored, "_p", predicate_alphas)).alias("p"))
    return AlphaTable(doc_alphas, predicate_alphas, told)


def plan_of_query(docs: DataFrame, doc_score: Column, predicate_score: Column, grid: list[float], target_recall: float, sources: DataFrame | None = None, key: str = "doc_id") -> cascade.AlphaPlan:
    """The alphas of a query's two stages: greedy by what they save, then by which answers they keep (``sources``), all read from one table."""
    table = alpha_table(docs, doc_score, predicate_score, grid, with_leftovers(grid, target_recall), key)
    costs = table.costs()
    covered, total = table.answers(sources, key) if sources is not None else ({}, 0)
    doc_alpha = cascade.allocate([DOC, PREDICATE], grid, target_recall, lambda a: costs[a[DOC], a[PREDICATE]])[0][DOC]
    known = lambda a: covered[doc_alpha, a] / total if total else 1.0  # noqa: E731 - no answer is lost where there is none
    return cascade.alpha_plan([DOC, PREDICATE], grid, target_recall, lambda a: costs[a[DOC], a[PREDICATE]], PREDICATE, known if sources is not None else None)
