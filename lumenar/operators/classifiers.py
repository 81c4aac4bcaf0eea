"""Text classifiers as proxies, their training data, and analyses of ensembles of classifiers.

A classifier of one's own is a function of texts (a pandas series) -> probabilities; the ones here
are fitted by the engine on hashed words, distributed, so nothing is collected but the model.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenar.functions import evidence
from lumenar.functions import values as V
from lumenar.operators.cascade import Proxy
from lumenar.operators.proxies import HeuristicProxy, description, guard_key
from lumenar.plans.sqlx import Predicate

Classifier = Callable[[pd.Series], pd.Series]

CLASSIFIERS: dict[str, Callable[[str], Classifier]] = {}


def register_classifier(name: str, make: Callable[[str], Classifier]) -> None:
    """A pretrained classifier: given what a filter asks for, a function of texts -> probabilities."""
    CLASSIFIERS[name] = make


def classifier_proxy(name: str, classifier: Classifier, text: str = "doc_text", threshold: float = 0.5, cost: float = 1.0, pass_rate: float = 0.5) -> Proxy:
    """A classifier as a proxy, called on Arrow batches of whole texts; null texts are empty."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return classifier(texts.fillna("")).astype(float)

    return Proxy(name, score(F.col(text)), threshold, cost, pass_rate)


def calibrated_classifier(name: str, classifier: Classifier, positives: DataFrame, target_recall: float, text: str = "doc_text", cost: float = 1.0) -> Proxy:
    """A classifier's proxy with the quantile of its scores on ``positives`` that keeps the target recall."""
    made = classifier_proxy(name, classifier, text, cost=cost)
    row = positives.agg(F.percentile(made.score, F.lit(max(0.0, 1 - target_recall))).alias("t")).first()
    return Proxy(made.name, made.score, 0.0 if row["t"] is None else float(row["t"]), made.cost)


def pretrained(predicates: list[Predicate], model: str = "heuristic", text: str = "doc_text", threshold: float = 0.5) -> list[Proxy]:
    """A proxy for each predicate without training documents: evidence in the text, or a registered classifier."""
    if model == "heuristic":
        return [HeuristicProxy(p, text).proxy() for p in predicates]
    if model not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {model!r}; known: heuristic{''.join(', ' + k for k in sorted(CLASSIFIERS))}")
    return [classifier_proxy(f"{model}_{guard_key(p)}", CLASSIFIERS[model](description(p)), text, threshold) for p in predicates]


def zero_shot(p: Predicate, text: str = "doc_text", threshold: float = 0.0, dimensions: int = 256) -> Proxy:
    """The cosine similarity of a document's hashed words with what the filter asks for."""
    asked = F.array(*[F.lit(float(x)) for x in evidence.hash_embed(description(p), dimensions)])
    return Proxy(f"zero_shot_{guard_key(p)}", V.cosine(evidence.hash_embedding(F.col(text), dimensions), asked), threshold)


def text_classifier(train: DataFrame, text: str = "doc_text", label: str = "label", features: int = 1 << 14, least: int = 2) -> PipelineModel | None:
    """A balanced logistic regression over hashed words; None with fewer than ``least`` rows of either label."""
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}  # two rows
    if counts.get(1, 0) < least or counts.get(0, 0) < least:
        return None
    total = counts[0] + counts[1]
    weight = F.when(F.col(label) == 1, total / (2 * counts[1])).otherwise(total / (2 * counts[0]))
    rows = train.select(F.coalesce(text, F.lit("")).alias("_text"), F.col(label).cast("double").alias("_label"), weight.alias("_weight"))
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
    hashed = HashingTF(inputCol="_words", outputCol="_features", numFeatures=features, binary=True)
    fit = LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_weight", maxIter=50, regParam=0.01)
    return Pipeline(stages=[words, hashed, fit]).fit(rows)


def text_scores(docs: DataFrame, model: PipelineModel, text: str = "doc_text", out: str = "score") -> DataFrame:
    scored = model.transform(docs.withColumn("_text", F.coalesce(text, F.lit(""))))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("_text", "_words", "_features", "rawPrediction", "probability", "prediction")


def fine_tuned(docs: DataFrame, train: dict[str, DataFrame], predicates: list[Predicate], text: str = "doc_text", threshold: float = 0.5) -> tuple[DataFrame, list[Proxy]]:
    """docs with a score column for each predicate, and a proxy on it. train: by guard key, (text, label).

    A predicate whose training rows hold one label only has no proxy.
    """
    made = []
    for i, p in enumerate(predicates):
        rows = train.get(guard_key(p))
        model = text_classifier(rows, text) if rows is not None else None
        if model is not None:
            docs = text_scores(docs, model, text, f"_tuned{i}")
            made.append(Proxy(f"finetuned_{guard_key(p)}", F.col(f"_tuned{i}"), threshold))
    return docs, made


# --- training data ---------------------------------------------------------------------


def hard_negative_training(negatives: DataFrame, vectors: DataFrame, attribute: str) -> DataFrame:
    """(doc_id, embedding, label 0) of the documents that passed the proxies and failed on the attribute. negatives: doc_id, failed_attribute."""
    ids = negatives.where(F.col("failed_attribute") == attribute).select("doc_id").distinct()
    return vectors.join(ids, "doc_id", "left_semi").select("doc_id", "embedding", F.lit(0).alias("label"))


def training_pairs(docs: DataFrame, records: DataFrame, predicates: list[tuple[str, Predicate]], per_predicate: int | None = None, text: str = "doc_text") -> DataFrame:
    """(doc_id, predicate, doc_text, label): every document of a predicate's table, label 1 where a record satisfies it.

    With ``per_predicate``, those with the smallest hashes of each predicate and label, chosen from ids alone.
    """
    from lumenar.plans.runtime import satisfying

    out = None
    for table, p in predicates:
        mine = records.where(F.col("table_id") == table)
        hit = satisfying(mine, [p]).select("doc_id").distinct().withColumn("label", F.lit(1))
        rows = mine.select("doc_id").distinct().join(hit, "doc_id", "left").select("doc_id", F.lit(guard_key(p)).alias("predicate"), F.coalesce("label", F.lit(0)).alias("label"))
        if per_predicate is not None:
            first = [rows.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_predicate) for y in (0, 1)]
            rows = first[0].unionByName(first[1])
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("predicates are not empty")
    return out.join(docs.select("doc_id", F.col(text).alias("doc_text")), "doc_id").select("doc_id", "predicate", "doc_text", "label")


# --- ensembles -------------------------------------------------------------------------


def layer_subsets(layers: list[int], size: int, seed: int = 42, subsets: int | None = None) -> list[list[int]]:
    """Disjoint random samples of ``size`` layers, as many as fit or as asked for; the same for a seed."""
    if size <= 0 or size > len(layers):
        raise ValueError("the size is between 1 and the number of layers")
    order = random.Random(seed).sample(list(layers), len(layers))
    whole = [sorted(order[i : i + size]) for i in range(0, len(order) - size + 1, size)]
    return whole if subsets is None else whole[:subsets]


def ensemble_report(metrics: DataFrame, measures: list[str], by: tuple[str, ...] = ("size",)) -> DataFrame:
    """Runs, mean, deviation, least and most of each measure per ensemble size (or other columns)."""
    parts = []
    for m in measures:
        parts += [F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_pop(m), F.lit(0.0)).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), *parts)


def rounded_votes(scores: list[Column]) -> Column:
    """How many classifiers of an ensemble vote 1."""
    out = F.lit(0)
    for s in scores:
        out = out + (s >= 0.5).cast("int")
    return out
