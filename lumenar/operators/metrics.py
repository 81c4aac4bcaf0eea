"""Evaluation: bags of answers, cells by role, document metrics, votes and their error bounds."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenar.functions.values import canonical_cell, is_null_eval, safe_ratio, values_equal
from lumenar.operators.ranks import running_sum


def answer_bags(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """truth_rows, predicted_rows, common, recall, precision of two answers as multisets of canonical rows; an empty truth has recall 1."""
    names = [f"c{i}" for i in range(len(truth.columns))]
    bags = [
        df.select(*[canonical_cell(F.col(c).cast("string")).alias(n) for c, n in zip(df.columns, names, strict=True)]).groupBy(*names).agg(F.count(F.lit(1)).alias(k))
        for df, k in ((truth, "t"), (predicted, "p"))
    ]
    both = bags[0].join(bags[1], names, "full").fillna(0, ["t", "p"])
    sums = both.agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(n) for x, n in ((F.col("t"), "truth_rows"), (F.col("p"), "predicted_rows"), (F.least("t", "p"), "common"))])
    return sums.withColumn("recall", safe_ratio(F.col("common"), F.col("truth_rows"), 1.0)).withColumn("precision", safe_ratio(F.col("common"), F.col("predicted_rows"), 1.0))


def missing_and_extra(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    return truth.exceptAll(predicted).withColumn("side", F.lit("missing")).unionByName(predicted.exceptAll(truth).withColumn("side", F.lit("extra")))


ROLE_ORDER = ("answer", "predicate", "join", "other")


def cell_role(attribute: Column, roles: dict[str, str]) -> Column:
    """The strongest role of an attribute; unlisted ones are ``other``."""
    out = F.lit("other")
    for name, role in roles.items():
        out = F.when(attribute == name, role).otherwise(out)
    return out


def cell_recall(truth: DataFrame, predicted: DataFrame, keys: list[str], roles: dict[str, str]) -> DataFrame:
    """Per role: total, covered, missing and mismatched cells of ``keys`` + column_name, value; null truth is skipped, no cells are recall 1."""
    joined = truth.where(~is_null_eval(F.col("value"))).join(predicted.withColumnRenamed("value", "got"), [*keys, "column_name"], "left")
    # each test is a column once: repeated inside the aggregates, the expression is too long to compile
    tested = joined.select(cell_role(F.col("column_name"), roles).alias("role"), values_equal(F.col("got"), F.col("value")).alias("_equal"), is_null_eval(F.col("got")).alias("_null"))
    counts = tested.groupBy("role").agg(F.count(F.lit(1)).alias("total"), F.count_if("_equal").alias("covered"), F.count_if("_null").alias("missing"), F.count_if(~F.col("_equal") & ~F.col("_null")).alias("mismatched"))
    return counts.withColumn("recall", safe_ratio(F.col("covered"), F.col("total"), 1.0))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy; ratios without a denominator are 0."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    c = rows.agg(*[F.count_if(x).alias(n) for x, n in ((t & p, "tp"), (~t & p, "fp"), (t & ~p, "fn"), (~t & ~p, "tn"))])
    c = c.withColumn("precision", safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    c = c.withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return c.withColumn("accuracy", safe_ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def roc_auc(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the curve from counts per distinct score and their running sums: no global ranking of rows."""
    by = rows.groupBy(score).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg"))
    placed = running_sum(by, [F.col(score)], "neg", "below", before=True)
    return placed.withColumn("won", F.col("pos") * (F.col("below") + F.col("neg") / 2)).agg(safe_ratio(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auc"))


def votes(scores: list[Column], how: str = "hard", threshold: float = 0.5) -> Column:
    """hard: majority of rounded scores, ties are 1; soft: the mean; half: the mean of the confident half-steps."""
    n = len(scores)
    if how == "hard":
        return (sum(F.when(s >= threshold, 1).otherwise(0) for s in scores) * 2 >= n).cast("int")
    if how == "half":
        return (sum(F.when(s >= threshold, 1.0).when(s >= threshold / 2, 0.5).otherwise(0.0) for s in scores) * 2 >= n).cast("int")
    if how == "soft":
        return (sum(scores) / n >= threshold).cast("int")
    raise ValueError("how is 'hard', 'half' or 'soft'")


def majority_error(rows: DataFrame, truth: str, voters: list[str]) -> DataFrame:
    """Mean error, mean pairwise disagreement and the majority's error of three voters."""
    wrong = [(F.col(v) != F.col(truth)).cast("int") for v in voters]
    pairs = [(F.col(a) != F.col(b)).cast("int") for i, a in enumerate(voters) for b in voters[i + 1 :]]
    return rows.agg(F.avg(sum(wrong) / len(wrong)).alias("mean_error"), F.avg(sum(pairs) / len(pairs)).alias("disagreement"), F.avg((sum(wrong) * 2 > len(wrong)).cast("int")).alias("majority_error"))


def voting_error(rows: DataFrame, truth: str, voters: list[str], k: int = 3, of_label: int | None = None) -> DataFrame:
    """``error``: the estimated error of a majority of k voters, from the errors and disagreements of three.

    With mean error e, mean disagreement d, the error rate eps of disagreeing pairs over 2 e, and
    eta = P(most are wrong) / E(share wrong squared): eta (e + 3 (k - 1) / (2 k) (eps e - d / 2)).
    ``of_label`` keeps rows of that truth only. No rows, or no errors, give 0.
    """
    if len(voters) != 3:
        raise ValueError("the estimate needs three voters")
    if of_label is not None:
        rows = rows.where(F.col(truth) == of_label)
    wrong = [(F.col(v) != F.col(truth)).cast("double") for v in voters]
    pairs = [(0, 1), (0, 2), (1, 2)]
    apart = [(F.col(voters[a]) != F.col(voters[b])).cast("double") for a, b in pairs]
    share = sum(wrong) / 3
    told = rows.agg(
        F.avg(share).alias("e"), F.avg(sum(apart) / 3).alias("d"), F.avg(sum((wrong[a] + wrong[b]) * x for (a, b), x in zip(pairs, apart, strict=True)) / 9).alias("s"),
        F.avg((share > 0.5).cast("double")).alias("most"), F.avg(share * share).alias("square"),
    )
    eps, eta = safe_ratio(F.col("s"), 2 * F.col("e")), safe_ratio(F.col("most"), F.col("square"))
    return told.select(F.coalesce(eta * (F.col("e") + 3 * (k - 1) / (2 * k) * (eps * F.col("e") - 0.5 * F.col("d"))), F.lit(0.0)).alias("error"))


def voting_error_of_positives(rows: DataFrame, truth: str, voters: list[str], k: int = 3) -> DataFrame:
    """``error``: the error of a majority on rows of truth 1 times their share, to four digits."""
    share = rows.agg(F.avg((F.col(truth) == 1).cast("double")).alias("share"))
    return voting_error(rows, truth, voters, k, of_label=1).crossJoin(share).select(F.round(F.col("error") * F.coalesce("share", F.lit(0.0)), 4).alias("error"))  # a row each


def chernoff_bound(n: int, p: float) -> float:
    if not 0 < p < 1:
        return 0.0
    delta = 1 / (2 * p) - 1
    return math.exp(-(delta**2) * n * p / 2)


def disagreement_buckets(rows: DataFrame, truth: str, scores: list[str], thresholds: list[float], most: int = 3) -> DataFrame:
    """Per threshold and bucket (how many voters are in the minority): rows and the majority's error rate."""
    spark = rows.sparkSession
    cuts = spark.createDataFrame([(t,) for t in thresholds], "threshold double")
    ones = sum((F.col(s) >= F.col("threshold")).cast("int") for s in scores)
    voted = rows.join(F.broadcast(cuts)).withColumn("ones", ones).withColumn("bucket", F.least(F.least("ones", F.lit(len(scores)) - F.col("ones")), F.lit(most)))
    wrong = ((F.col("ones") * 2 >= len(scores)).cast("int") != F.col(truth)).cast("int")
    return voted.groupBy("threshold", "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(wrong).alias("error_rate"))


def savings(before: Column, after: Column) -> Column:
    return F.greatest(before - after, F.lit(0))


def table_coverage(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per document: its truth table, the predicted one and whether it is covered, missing or wrong. Both: doc_id, table_id (null: none)."""
    joined = truth.where(~is_null_eval(F.col("table_id"))).join(predicted.withColumnRenamed("table_id", "got"), "doc_id", "left")
    state = F.when(is_null_eval(F.col("got")), "missing").when(F.lower("got") == F.lower("table_id"), "covered").otherwise("wrong")
    return joined.select("doc_id", "table_id", "got", state.alias("state"))


def cell_outcomes(truth: DataFrame, predicted: DataFrame, relevant: DataFrame | None = None) -> DataFrame:
    """Per document tp, fp, fn, tn and whether all its cells are right. Both: doc_id, column_name, value.

    A cell with equal values is tp, or tn if both are null; a null prediction of a value is fn, any
    other difference fp. Of documents outside ``relevant``, predicted values are fp and nulls tn.
    """
    cells = truth.join(predicted.withColumnRenamed("value", "got"), ["doc_id", "column_name"], "full")
    inside = F.lit(True)
    if relevant is not None:
        cells = cells.join(relevant.select("doc_id").distinct().withColumn("_inside", F.lit(True)), "doc_id", "left")
        inside = F.coalesce("_inside", F.lit(False))
    want, got = is_null_eval(F.col("value")), is_null_eval(F.col("got"))
    equal = values_equal(F.col("got"), F.col("value"))
    kind = F.when(~inside, F.when(got, "tn").otherwise("fp")).when(want & got, "tn").when(equal, "tp").when(got, "fn").otherwise("fp")
    counts = cells.withColumn("_kind", kind).groupBy("doc_id").agg(*[F.count_if(F.col("_kind") == k).alias(k) for k in ("tp", "fp", "fn", "tn")])
    return counts.withColumn("correct", (F.col("fp") == 0) & (F.col("fn") == 0))


def ratios(outcomes: DataFrame) -> DataFrame:
    """Sums of tp, fp, fn, tn with precision, recall, f1 and the share of correct documents."""
    c = outcomes.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("tp", "fp", "fn", "tn")], safe_ratio(F.count_if("correct"), F.count(F.lit(1))).alias("document_accuracy"))
    c = c.withColumn("precision", safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def attribute_accuracy(truth: DataFrame, predicted: DataFrame, keys: list[str], judge: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(column_name, total, correct, judged, accuracy). A judge decides on pairs of values that do not match strictly."""
    cells = truth.join(predicted.withColumnRenamed("value", "got"), [*keys, "column_name"], "left")
    strict = values_equal(F.col("got"), F.col("value"))
    unsure = ~strict & ~is_null_eval(F.col("got")) & ~is_null_eval(F.col("value"))
    agreed = unsure & F.coalesce(judge(F.col("got"), F.col("value")), F.lit(False)) if judge else F.lit(False)
    out = cells.groupBy("column_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(strict | agreed).alias("correct"), F.count_if(agreed).alias("judged"))
    return out.withColumn("accuracy", safe_ratio(F.col("correct"), F.col("total")))


def semantic_accuracy(truth: DataFrame, predicted: DataFrame, judge: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(per attribute, per document) accuracy of whole records. Both: doc_id, table_id (null: none), data.

    Values that match strictly are right; a judge decides on other pairs of values. A document is
    right if its table is and all its attributes are; one without a table is right if none was said.
    """
    said = predicted.select("doc_id", F.col("table_id").alias("said_table"), F.col("data").alias("said"))
    both = truth.join(said, "doc_id", "left").withColumn("_none", is_null_eval(F.col("table_id")))
    right_table = F.coalesce(F.col("said_table") == F.col("table_id"), F.lit(False))
    cells = both.where("not _none").select("doc_id", "table_id", F.explode("data").alias("column_name", "value"), "said")
    got = F.try_element_at("said", F.col("column_name"))
    strict = F.coalesce(values_equal(got, F.col("value")), F.lit(False))
    unsure = ~strict & ~is_null_eval(got) & ~is_null_eval(F.col("value"))
    agreed = unsure & F.coalesce(judge(got, F.col("value")), F.lit(False)) if judge else F.lit(False)
    cells = cells.withColumn("_right", strict | agreed).withColumn("_judged", unsure if judge else F.lit(False))
    attributes = cells.groupBy("table_id", "column_name").agg(F.count(F.lit(1)).alias("total"), F.count_if("_right").alias("correct"), F.count_if("_judged").alias("judged"))
    attributes = attributes.withColumn("accuracy", safe_ratio(F.col("correct"), F.col("total")))
    wrong = cells.groupBy("doc_id").agg(F.count_if(~F.col("_right")).alias("_wrong"))
    documents = both.join(wrong, "doc_id", "left")
    final = F.when(F.col("_none"), is_null_eval(F.col("said_table"))).otherwise(right_table & (F.coalesce("_wrong", F.lit(0)) == 0))
    return attributes, documents.select("doc_id", F.when(F.col("_none"), is_null_eval(F.col("said_table"))).otherwise(right_table).alias("table_right"), F.coalesce("_wrong", F.lit(0)).alias("wrong"), final.alias("right"))


def query_recall(matched: DataFrame, truth: DataFrame, predicted: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """tables and cells that a query needs: covered, total, missing, wrong or mismatched, and whether it can be answered.

    matched: ``relational.match_records``; truth cells that are null count for nothing. A record
    without a match is missing if its document has no predicted record at all, else wrong.
    """
    names = F.lit(None).cast("array<string>")
    for table, columns in required.items():
        names = F.when(F.col("table_id") == table, F.array(*[F.lit(c) for c in columns]).cast("array<string>")).otherwise(names)
    any_said = predicted.select("doc_id").distinct().withColumn("_any", F.lit(True))
    keys = ["doc_id", "table_id", "record_id"]
    rows = matched.where(F.col("table_id").isin(list(required))).join(truth.select(*keys, "data"), keys).join(any_said, "doc_id", "left")
    said = predicted.select("doc_id", "table_id", F.col("record_id").alias("predicted_id"), F.col("data").alias("said"))
    rows = rows.join(said, ["doc_id", "table_id", "predicted_id"], "left")
    found = F.col("predicted_id").isNotNull()
    cells = rows.select(found.alias("_found"), "said", "data", F.explode(names).alias("c")).select("_found", F.try_element_at("data", F.col("c")).alias("want"), F.try_element_at("said", F.col("c")).alias("got")).where(~is_null_eval(F.col("want")))
    tested = cells.select((F.col("_found") & F.coalesce(values_equal(F.col("got"), F.col("want")), F.lit(False))).alias("equal"), is_null_eval(F.col("got")).alias("null"))
    equal, null = F.col("equal"), F.col("null")
    c = tested.agg(F.count(F.lit(1)).alias("cells_total"), F.count_if(equal).alias("cells_covered"), F.count_if(~equal & null).alias("cells_missing"), F.count_if(~equal & ~null).alias("cells_mismatched"))
    t = rows.agg(F.count(F.lit(1)).alias("tables_total"), F.count_if(found).alias("tables_covered"), F.count_if(~found & F.col("_any").isNull()).alias("tables_missing"), F.count_if(~found & F.col("_any").isNotNull()).alias("tables_wrong"))
    both = t.crossJoin(c)  # a row each
    both = both.withColumn("table_recall", safe_ratio(F.col("tables_covered"), F.col("tables_total"), 1.0)).withColumn("cell_recall", safe_ratio(F.col("cells_covered"), F.col("cells_total"), 1.0))
    return both.withColumn("can_answer_query", (F.col("tables_covered") == F.col("tables_total")) & (F.col("cells_covered") == F.col("cells_total")))


def token_savings(savings_of_stages: DataFrame, usage: DataFrame) -> DataFrame:
    """stage, calls_saved, tokens_saved: saved calls times the stage's mean tokens a call, or the mean of all stages where it has none. usage: stage, calls, total_tokens."""
    each = usage.groupBy("stage").agg((F.sum("total_tokens") / F.sum("calls")).alias("_mean"))
    overall = usage.agg((F.sum("total_tokens") / F.sum("calls")).alias("_all"))
    joined = savings_of_stages.join(each, "stage", "left").crossJoin(overall)  # one row
    return joined.select("stage", "calls_saved", (F.col("calls_saved") * F.coalesce("_mean", "_all", F.lit(0.0))).alias("tokens_saved"))


def usage_by(log: DataFrame, *by: str) -> DataFrame:
    """Calls, prompt, completion and total tokens of usage rows by the given columns; null text keys are ``unattributed``, rows without tokens are counted."""
    kinds_of = dict(log.select(*by).dtypes)
    keys = [(F.coalesce(F.col(b), F.lit("unattributed")) if kinds_of[b.split(".")[-1]] == "string" else F.col(b)).alias(b.split(".")[-1]) for b in by]
    kinds = ("prompt_tokens", "completion_tokens", "total_tokens")
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds], F.count_if(F.col("total_tokens").isNull()).alias("without_tokens"))


def cross_stage_cost(refinement_docs: int, extraction_docs: int, baseline_docs: int) -> dict[str, float]:
    """Documents read by schema refinement and extraction together, and what that saves of the baseline, not below 0."""
    total = refinement_docs + extraction_docs
    saved = max(0, baseline_docs - total)
    return {"documents": total, "saved": saved, "saved_rate": saved / baseline_docs if baseline_docs else 1.0}


def set_counts(found: DataFrame, gold: DataFrame) -> DataFrame:
    """tp, fp, fn of two frames as sets of rows."""
    f, g = found.distinct().withColumn("_f", F.lit(1)), gold.distinct().withColumn("_g", F.lit(1))
    both = f.join(g, found.columns, "full")
    return both.agg(F.count_if(F.col("_f").isNotNull() & F.col("_g").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_f").isNull()).alias("fn"))


def call_reduction(stages: DataFrame) -> DataFrame:
    """Saved calls and their share per stage, and in all. stages: stage, before, after."""
    saved = savings(F.col("before"), F.col("after"))
    each = stages.select("stage", "before", "after", saved.alias("saved"))
    total = each.agg(F.lit("total").alias("stage"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("before", "after", "saved")])
    return each.unionByName(total).withColumn("reduction", safe_ratio(F.col("saved"), F.col("before")))


def harvested(report: object, names: tuple[str, ...] = ("recall", "precision", "f1", "accuracy")) -> dict[str, list[float]]:
    """The numbers under the given names anywhere in a nested report, in order."""
    out: dict[str, list[float]] = {}
    stack = [report]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            for k, v in node.items():
                if k in names and isinstance(v, (int, float)) and not isinstance(v, bool):
                    out.setdefault(k, []).append(float(v))
            stack += reversed([v for v in node.values() if isinstance(v, (dict, list))])
        elif isinstance(node, list):
            stack += reversed([v for v in node if isinstance(v, (dict, list))])
    return out


def summary(values: list[float]) -> dict[str, float]:
    return {"count": len(values), "mean": sum(values) / len(values), "min": min(values), "max": max(values)} if values else {"count": 0}
