"""Predicate proxies: what rejects a document before extraction, and how it is calibrated.

Every proxy is a score column, so a cascade of them is one narrow projection over the scan.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenar.functions import evidence
from lumenar.functions import values as V
from lumenar.operators import cascade, ranks
from lumenar.operators.cascade import Proxy
from lumenar.operators.predicates import all_of
from lumenar.plans.sqlx import Predicate
from lumenar.storage import written


def guard_key(p: Predicate) -> str:
    return f"{p.attribute}::{p.operator}::{p.value}"


def description(p: Predicate) -> str:
    """What a filter asks for, in words, where no better text is given."""
    return f"{p.attribute.replace('_', ' ')} {p.operator.lower()} {p.value}"


class PredicateProxy(ABC):
    """A proxy of one's own: ``score`` gives a column between 0 and 1."""

    name = "proxy"
    cost = 1.0
    threshold = 0.5

    @abstractmethod
    def score(self) -> Column: ...

    def proxy(self) -> Proxy:
        return Proxy(self.name, self.score(), self.threshold, self.cost)


class HeuristicProxy(PredicateProxy):
    """Evidence in the text for one predicate.

    In order: documents on the reject list score -1, those on the pass list and attributes that
    pass through score 1; a row id is compared with the document's own, or with all numbers by which it
    names its row (``row_id`` as the three columns that may), which prove it but don't refute it; text is sought as a
    substring; numbers are what the attribute's own parser finds or, if it has none, what stands near
    its words. Without evidence: 0.5.
    """

    def __init__(self, p: Predicate, text: str = "doc_text", doc_id: str = "doc_id", row_id: str | tuple[str, str, str] | None = None, rejected: tuple[str, ...] = (), passed: tuple[str, ...] = (), through: tuple[str, ...] = ()) -> None:
        self.name = guard_key(p)
        self.predicate, self.text, self.doc_id, self.row_id = p, text, doc_id, row_id
        self.rejected, self.passed, self.through = rejected, passed, through

    def _evidence(self) -> Column:
        p, text = self.predicate, F.col(self.text)
        if p.attribute in ("row_id", "rowid") and isinstance(self.row_id, tuple) and isinstance(p.value, (int, float)):
            named = evidence.row_id_numbers(*map(F.col, self.row_id))
            return F.when(F.exists(named, lambda v: V.satisfies(v.cast("string"), p.operator, p.value)), 1.0).otherwise(0.5)
        if p.attribute in ("row_id", "rowid") and isinstance(self.row_id, str):
            return F.when(V.satisfies(F.col(self.row_id), p.operator, p.value), 1.0).otherwise(0.0)
        if isinstance(p.value, str) and p.operator in ("=", "LIKE", "CONTAINS"):
            wanted = V.like_contains(text, p.value) if p.operator == "LIKE" else V.contains_value(text, F.lit(p.value))
            return F.when(wanted, 1.0).otherwise(0.0)
        if isinstance(p.value, (int, float)) and p.operator in ("=", "!=", "<>", "<", "<=", ">", ">="):
            numbers = evidence.explicit_numbers(text, p.attribute) if evidence.has_parser(p.attribute) else evidence.nearby_numbers(text, p.attribute)
            return cascade.heuristic_score(text, numbers, F.exists(numbers, lambda v: V.satisfies(v.cast("string"), p.operator, p.value)))
        return F.lit(0.5)

    def score(self) -> Column:
        known = F.coalesce(self._evidence(), F.lit(0.5))
        if self.predicate.attribute in self.through:
            known = F.lit(1.0)
        doc = F.col(self.doc_id).cast("string")
        out = F.when(doc.isin(*self.passed), 1.0).otherwise(known) if self.passed else known
        return F.when(doc.isin(*self.rejected), -1.0).otherwise(out) if self.rejected else out


def embedding_proxy(name: str, vector: Column, query: list[float], threshold: float = 0.0, cost: float = 1.0) -> Proxy:
    """The cosine similarity of a document's vector with the query's."""
    return Proxy(name, V.cosine(vector, F.array(*[F.lit(float(x)) for x in query])), threshold, cost)


def learned_scores(rows: DataFrame, train: DataFrame, vector: str, label: str, query: list[float] | None = None, least: int = 2, out: str = "score") -> DataFrame | None:
    """rows with the probability of label 1 by a balanced logistic regression over document and filter vector.

    None with fewer than ``least`` rows of either label. Fitting is distributed; nothing is collected but the model.
    """
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    if counts.get(1, 0) < least or counts.get(0, 0) < least:
        return None
    tail = F.array(*[F.lit(float(x)) for x in query or []]).cast("array<double>")
    side = F.concat(F.transform(F.col(vector), lambda x: x.cast("double")), tail)
    total = counts[0] + counts[1]
    weight = F.when(F.col(label) == 1, total / (2 * counts[1])).otherwise(total / (2 * counts[0]))
    fitted = train.select(array_to_vector(side).alias("_features"), F.col(label).cast("double").alias("_label"), weight.alias("_weight"))
    model = LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_weight", maxIter=100, regParam=0.01).fit(fitted)
    scored = model.transform(rows.withColumn("_features", array_to_vector(side)))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")


def recalibrated(proxies: list[Proxy], positives: DataFrame, target_recall: float, heuristic: tuple[str, ...] = ()) -> list[Proxy]:
    """Each proxy with the threshold that its positives ask for.

    Without positives the threshold is 0. A heuristic's is at most 0.5 where the target is 0.95
    or more, so unknown documents pass.
    """
    scored = written(positives.select(*[p.score.cast("double").alias(f"s{i}") for i, p in enumerate(proxies)]), "calibration")
    out = []
    for i, p in enumerate(proxies):
        t = cascade.recall_threshold(scored, f"s{i}", target_recall, empty=0.0)
        if p.name in heuristic and target_recall >= 0.95:
            t = min(t, 0.5)
        out.append(Proxy(p.name, p.score, t, p.cost, p.pass_rate))
    return out


def observed_pass_rates(rows: DataFrame, proxies: list[Proxy], least: int = 10) -> list[Proxy]:
    """Pass rates as seen on rows, where more than ``least`` were seen; one aggregation for all proxies."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(p.score >= p.threshold).alias(f"p{i}") for i, p in enumerate(proxies)]).first()
    if found["n"] <= least:
        return list(proxies)
    return [Proxy(p.name, p.score, p.threshold, p.cost, found[f"p{i}"] / found["n"]) for i, p in enumerate(proxies)]


def survivors_or_fallback(rows: DataFrame, proxies: list[Proxy], target_recall: float = 0.95, learned: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """(survivors, how): ``cascade``; ``conservative`` without the learned proxies if all were rejected; else ``all``."""
    for how, used in (("cascade", proxies), ("conservative", [p for p in proxies if p.name not in learned])):
        if how == "conservative" and len(used) in (0, len(proxies)):
            continue
        kept = cascade.survivors(rows, used, target_recall)
        if not kept.isEmpty():
            return kept, how
    return rows, "all"


def any_record(records: Column, predicates: list[Predicate]) -> Column:
    """Whether any record (a map of cells) satisfies every predicate; no records satisfy none."""

    def one(r: Column) -> Column:
        return all_of(predicates, {p.attribute: F.try_element_at(r, F.lit(p.attribute)) for p in predicates})

    return F.coalesce(F.exists(records, one), F.lit(False))


def oracle_docs(records: DataFrame, table: str, predicates: list[Predicate]) -> DataFrame:
    """Documents of which a ground truth record satisfies the predicates: the upper bound of any proxy."""
    own = records.where(F.col("table_id") == table)
    cells = {p.attribute: F.try_element_at("data", F.lit(p.attribute)) for p in predicates}
    return own.where(all_of(predicates, cells)).select("doc_id").distinct()


def contradicted(docs: DataFrame, oracle: DataFrame, p: Predicate, text: str = "doc_text") -> DataFrame:
    """Documents whose text satisfies a numeric predicate although the ground truth does not."""
    numbers = evidence.nearby_numbers(F.col(text), p.attribute)
    says = F.exists(numbers, lambda v: V.satisfies(v.cast("string"), p.operator, p.value))
    return docs.join(oracle, "doc_id", "left_anti").where(says)


def conformal_centres(calibration: DataFrame, scores: list[str], wrong: str, alpha: float) -> DataFrame:
    """Score vectors of the calibration set, chosen until they cover ceil((1 - alpha)(n + 1)) rows.

    calibration: score columns and ``wrong`` (0 or 1). Rows of one score vector form a centre with
    t right and f wrong rows; centres with a lower (f + t) / t come first, ties by more rows and
    then by the vector. Centres without a right row are never chosen.
    """
    cells = calibration.groupBy(*scores).agg(F.count_if(F.col(wrong) == 0).alias("right"), F.count_if(F.col(wrong) != 0).alias("faults"))
    n = calibration.count()
    order = [(F.col("faults") + F.col("right")) / F.col("right"), -F.col("right"), *map(F.col, scores)]
    placed = ranks.running_sum(cells.where("right > 0"), order, "right", "_before", before=True)
    return placed.where(F.col("_before") < math.ceil((1 - alpha) * (n + 1))).drop("_before")


def nearest_centre(rows: DataFrame, cells: DataFrame, chosen: DataFrame, scores: list[str], key: str, most: int = 10_000) -> DataFrame:
    """(key, covered): whether a row's nearest calibration vector is a chosen centre; ties go to the smaller vector.

    The centres are broadcast, so their number is checked: beyond ``most`` this raises ValueError
    (round the scores first). Rows stay where they are, one narrow pass.
    """
    listed = cells.select(*scores).distinct().join(chosen.select(*scores).withColumn("_chosen", F.lit(True)), scores, "left").orderBy(*scores).limit(most + 1).collect()
    if len(listed) > most:
        raise ValueError(f"more than {most} centres: round the scores first")
    if not listed:
        return rows.select(key, F.lit(False).alias("covered"))
    table = rows.sparkSession.createDataFrame([([[float(r[s]) for s in scores] for r in listed], [bool(r["_chosen"]) for r in listed])], "v array<array<double>>, c array<boolean>")
    joined = rows.crossJoin(F.broadcast(table))  # a single row
    own = F.array(*[F.col(s).cast("double") for s in scores])
    distance = F.transform("v", lambda v: F.aggregate(F.zip_with(v, own, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y))
    nearest = F.array_position(distance, F.array_min(distance)).cast("int")
    return joined.select(key, F.coalesce(F.try_element_at("c", nearest), F.lit(False)).alias("covered"))
