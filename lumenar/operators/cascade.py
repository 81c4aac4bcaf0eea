"""Row-filter cascade: scored filters in order of benefit, calibration, recall budgets, statistics."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenar.functions.values import safe_ratio
from lumenar.operators import ranks


@dataclass
class Proxy:
    """A cheap predicate: rows with score below the threshold are rejected."""

    name: str
    score: Column
    threshold: float = 0.5
    cost: float = 1.0
    pass_rate: float = 0.5

    @property
    def efficiency(self) -> float:
        return math.inf if self.cost <= 0 else (1 - self.pass_rate) / self.cost


def ordered(proxies: list[Proxy]) -> list[Proxy]:
    """Most rejections per cost first; equal ones as they come."""
    return sorted(proxies, key=lambda p: -p.efficiency)


def run(rows: DataFrame, proxies: list[Proxy], target_recall: float = 0.95) -> DataFrame:
    """rows with ``rejected_by`` (position of the first rejecting proxy, null if it survives); a target recall of 1 rejects nothing."""
    first = F.lit(None).cast("int")
    if target_recall < 1 - 1e-6:
        for i, p in reversed(list(enumerate(ordered(proxies)))):
            first = F.when(p.score < p.threshold, F.lit(i)).otherwise(first)
    return rows.withColumn("rejected_by", first)


def survivors(rows: DataFrame, proxies: list[Proxy], target_recall: float = 0.95) -> DataFrame:
    return run(rows, proxies, target_recall).where("rejected_by is null").drop("rejected_by")


def statistics(done: DataFrame, proxies: list[Proxy], relevant: Column) -> DataFrame:
    """Per proxy in order: evaluated, passed, rejected, recall over the relevant rows that reached it, and its average score."""
    order = ordered(proxies)
    reached = lambda i: F.coalesce(F.col("rejected_by") >= i, F.lit(True))
    columns = []
    for i, p in enumerate(order):
        hit, out = reached(i), F.coalesce(F.col("rejected_by") == i, F.lit(False))
        columns.append(F.struct(
            F.lit(i).alias("position"), F.lit(p.name).alias("proxy"), F.count_if(hit).alias("evaluated"), F.count_if(hit & ~out).alias("passed"), F.count_if(out).alias("rejected"),
            F.count_if(hit & relevant).alias("relevant"), F.count_if(hit & ~out & relevant).alias("relevant_passed"), F.avg(F.when(hit, p.score)).alias("avg_score"),
        ))
    stats = done.agg(F.array(*columns).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return stats.withColumn("recall", safe_ratio(F.col("relevant_passed"), F.col("relevant"), 1.0)).withColumn("rejection_rate", safe_ratio(F.col("rejected"), F.col("evaluated")))


def hard_negatives(done: DataFrame, satisfied: Column, order: Column, most: int = 1000) -> DataFrame:
    """The latest rows that passed every proxy and then failed the predicate."""
    return done.where(F.col("rejected_by").isNull() & ~satisfied).orderBy(order.desc()).limit(most)


def heuristic_score(document: Column, evidence: Column, satisfied: Column, forced: Column | None = None) -> Column:
    """-1 forced out, 1 supported by the text, 0 contradicted, 0.5 unknown."""
    score = F.when(F.size(evidence) == 0, 0.5).when(satisfied, 1.0).otherwise(0.0)
    return F.when(forced, -1.0).otherwise(score) if forced is not None else score


def conformal_level(n: int, alpha: float) -> float:
    return min(1.0, math.ceil((n + 1) * (1 - alpha)) / n)


def conformal_threshold(scores: DataFrame, column: str, alpha: float, default: float = 0.0) -> DataFrame:
    """n and the linearly interpolated quantile of non-conformity scores at ceil((n + 1)(1 - alpha)) / n."""
    n = scores.where(F.col(column).isNotNull()).count()
    threshold = ranks.quantile(scores, column, conformal_level(n, alpha), n) if n else default
    return scores.sparkSession.createDataFrame([(n, threshold)], "n long, threshold double")


def similarity_threshold(scores: DataFrame, column: str, alpha: float) -> DataFrame:
    """The conformal threshold of similarities: their negatives are the non-conformity scores."""
    negative = scores.select(nonconformity(F.col(column)).alias("nc"))
    return conformal_threshold(negative, "nc", alpha).withColumn("threshold", -F.col("threshold"))


def nonconformity(similarity: Column) -> Column:
    return -similarity


def positive_quantile(scores: DataFrame, column: str, label: str, target: float, default: float = 0.0) -> float:
    """The quantile 1 - target of the scores of rows with label 1."""
    positives = scores.where((F.col(label) == 1) & F.col(column).isNotNull())
    n = positives.count()
    return ranks.quantile(positives, column, 1 - target, n) if n else default


def recall_threshold(scores: DataFrame, column: str, target: float, empty: float = 0.01) -> float:
    """Just below the score that a share ``target`` of positives reaches, not below 0."""
    n = scores.where(F.col(column).isNotNull()).count()
    if not n:
        return empty
    at = min(math.floor((1 - target) * n + 1e-9), n - 1)
    (value,) = ranks.order_statistics(scores, column, [at])
    return max(0.0, float(np.nextafter(value, -np.inf)))


def ordering_summary(proxies: list[Proxy]) -> dict[str, float]:
    """How many proxies there are, their mean cost and pass rate."""
    n = len(proxies)
    return {"proxies": n, "avg_cost": sum(p.cost for p in proxies) / n if n else 0.0, "avg_pass_rate": sum(p.pass_rate for p in proxies) / n if n else 0.0}


def decide(row: dict, proxies: list[Callable[[dict], float]], thresholds: list[float]) -> tuple[bool, list[tuple[int, float]]]:
    """One document in the caller's process: whether it passes, and the scores up to the first that rejects it."""
    seen = []
    for i, (score, least) in enumerate(zip(proxies, thresholds, strict=True)):
        seen.append((i, float(score(row))))
        if seen[-1][1] < least:
            return False, seen
    return True, seen


def budget(alpha: float) -> float:
    return -math.log(1 - min(max(alpha, 0.0), 1 - 1e-12))


def allocate(stages: list[str], grid: list[float], target_recall: float, cost: Callable[[dict[str, float]], float]) -> tuple[dict[str, float], float, list[tuple[str, float, float]]]:
    """Raise the stage that saves most cost per budget until nothing affordable saves: (alphas, cost, steps)."""
    if not stages or not grid:
        raise ValueError("stages and grid are not empty")
    grid = sorted(set(grid))
    total = -math.log(max(target_recall, 1e-12)) + 1e-12
    level = dict.fromkeys(stages, 0)
    seen: dict[tuple[int, ...], float] = {}

    def price(levels: dict[str, int]) -> float:
        key = tuple(levels[s] for s in stages)
        if key not in seen:
            seen[key] = float(cost({s: grid[levels[s]] for s in stages}))
        return seen[key]

    used = lambda levels: sum(budget(grid[levels[s]]) for s in stages)
    now, steps = price(level), []
    while True:
        moves = []
        for s in stages:
            if level[s] + 1 < len(grid) and used(raised := {**level, s: level[s] + 1}) <= total and price(raised) < now:
                moves.append(((now - price(raised)) / (used(raised) - used(level)), s, raised))
        if not moves:
            return {s: grid[level[s]] for s in stages}, now, steps
        _, s, level = max(moves, key=lambda m: m[0])
        now = price(level)
        steps.append((s, grid[level[s]], now))


@dataclass
class AlphaPlan:
    alphas: dict[str, float]
    cost: float
    steps: list[tuple[str, float, float]]
    calibrated: bool = False


def alpha_plan(stages: list[str], grid: list[float], target_recall: float, cost: Callable[[dict[str, float]], float], predicate_stage: str | None = None, answer_recall: Callable[[float], float] | None = None) -> AlphaPlan:
    """A query's alphas: greedy by savings per budget, the budget left over for the predicate stage, then that stage's alpha by what answers it gives.

    ``answer_recall`` measures the recall of the answers for a predicate alpha; of those of the grid
    that the budget allows, the one closest to the target counts, at or above it first, then the smaller.
    """
    alphas, spent, steps = allocate(stages, grid, target_recall, cost)
    if predicate_stage is None:
        return AlphaPlan(alphas, spent, steps)
    alphas = fill_leftover(alphas, predicate_stage, target_recall)
    if answer_recall is None:
        return AlphaPlan(alphas, float(cost(alphas)), steps)
    tried = sorted({a for a in grid if a <= alphas[predicate_stage] + 1e-12} | {alphas[predicate_stage]})
    best = closest_alpha([(a, answer_recall(a)) for a in tried], target_recall)
    alphas = {**alphas, predicate_stage: best}
    return AlphaPlan(alphas, float(cost(alphas)), steps, True)


def surviving_documents(docs: DataFrame, doc_score: Column, doc_alpha: float, predicate_score: Column, predicate_alpha: float) -> int:
    """The cost of two alphas: documents whose scores are over the quantiles that the alphas give up at both stages."""
    scored = docs.select(doc_score.alias("d"), predicate_score.alias("p"))
    cuts = {}
    for name, alpha in (("d", doc_alpha), ("p", predicate_alpha)):
        n = scored.where(F.col(name).isNotNull()).count()
        cuts[name] = ranks.order_statistics(scored, name, [min(math.floor(alpha * n + 1e-9), n - 1)])[0] if n and alpha > 0 else -math.inf
    return scored.where((F.col("d") >= cuts["d"]) & (F.col("p") >= cuts["p"])).count()


def fill_leftover(alphas: dict[str, float], stage: str, target_recall: float) -> dict[str, float]:
    left = -math.log(max(target_recall, 1e-12)) - sum(budget(a) for s, a in alphas.items() if s != stage)
    return {**alphas, stage: max(alphas[stage], 1 - math.exp(-max(left, 0.0)))}


def global_choice(options: list[list[tuple[float, int, int]]], target: float) -> list[int]:
    """One (alpha, covered, total) of each query, so that overall coverage comes closest to the target, above it if equally close, with low alphas."""
    states: dict[tuple[int, int], tuple[float, list[int]]] = {(0, 0): (0.0, [])}
    for choices in options:
        nxt: dict[tuple[int, int], tuple[float, list[int]]] = {}
        for (c, t), (a, picks) in states.items():
            for i, (alpha, covered, total) in enumerate(choices):
                key, value = (c + covered, t + total), (a + alpha, [*picks, i])
                if key not in nxt or value < nxt[key]:
                    nxt[key] = value
        states = nxt
    rate = lambda k: k[0] / k[1] if k[1] else 1.0
    best = min(states.items(), key=lambda s: (round(abs(rate(s[0]) - target), 12), rate(s[0]) < target, s[1]))
    return best[1][1]


def closest_alpha(observed: list[tuple[float, float]], target: float) -> float:
    """Of (alpha, recall): closest to the target, at or above it first, then the smaller alpha."""
    return min(observed, key=lambda o: (o[1] < target, round(abs(o[1] - target), 12), o[0]))[0]
