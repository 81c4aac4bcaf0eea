"""Toxicity by multiple-instance learning: documents are bags of sentences, labels are known for bags only.

A sentence's probability is the logistic of the weights of its words and their beginnings; a document's is the noisy-or
of its sentences'. Both are trained together from document labels by full-batch gradient
steps on the noisy-or likelihood, over a bounded sample of labelled rows. Scoring is one pass
over the texts with the weights of the sample's vocabulary; the sentences whose probability
is high are the offending ones.

Bounds, all parameters: at most ``per_label`` rows of each label are fitted, those with the
smallest hashes of their ids among texts of at most ``most_bytes`` bytes (of rows that repeat an
id, that whose text has the smallest hash), and words of fewer than ``least_docs`` of them are
ignored. Weights are held back by their absolute values (proximal gradient steps of one size for all
words), so that few words decide and a few labels aren't learned by heart; how strongly is chosen
by the errors on a third of the learning rows, learned from the others.

Defined results: a text that is null or without words has the score of an empty bag, 0; rows
that repeat a doc_id are scored each; labels that are null are not learned from, of labels
that differ for one doc_id the largest counts; without labels of both kinds every score is
that of the prior alone; texts of any length are scored whole; further columns are ignored
by ``scores`` and carried through by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenar.llm.hot_keys import likely_first
from lumenar.llm.memory import lean
from lumenar.llm.shingles import buffers, hashed_words, slices
from lumenar.llm.training import fitted, one_row_an_id
from lumenar.storage import table

PER_LABEL = 1500
LEAST_DOCS = 5
MOST_BYTES = 1 << 18
STEPS, RATE = 150, 0.5
#: Shares of the largest first gradient by which every step pulls weights towards 0.
PULLS = (0.02, 0.05, 0.1)
INNER_FOLDS = 3
#: Beginnings of words are features as well: inflected forms share them.
PREFIXES = (4, 5)
SAMPLE = pa.schema([("label", pa.int32()), ("doc_id", pa.int64()), ("sentence", pa.list_(pa.int32())), ("word", pa.list_(pa.int64()))])
THRESHOLD = 0.5

#: Words are runs of ASCII letters and of bytes beyond ASCII; sentences end at these bytes.
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?\n")] = True


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, sentence, word hash, first byte) of each word; sentences are numbered over the whole slice, first bytes within it."""
    row, first, word = hashed_words(data, offsets, _OUTSIDE, PREFIXES)
    stops = np.cumsum(_STOPS[data[int(offsets[0]) : int(offsets[-1])]])[first] if len(first) else first
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (stops[1:] != stops[:-1])
    return row, np.cumsum(fresh) - 1, word, first


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(doc: np.ndarray, sentence: np.ndarray, word: np.ndarray, label: np.ndarray, weight: np.ndarray, least_docs: int = LEAST_DOCS, pulls: tuple[float, ...] = PULLS) -> Model:
    """doc, sentence and word of each token (sentences ascend with docs); label and weight of each doc."""
    names, code = np.unique(word, return_inverse=True)
    code = code.astype(np.int32)
    kinds = max(1, len(names))
    in_docs = np.bincount(np.unique(doc * kinds + code) % kinds, minlength=len(names)) if len(names) else np.zeros(0, int)
    often = in_docs >= least_docs
    names, renumber = names[often], np.cumsum(often) - 1
    sentence_doc = doc[np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])] if len(sentence) else np.zeros(0, int)
    n_sentences = len(sentence_doc)
    known = often[code] if len(code) else np.zeros(0, bool)
    kinds = max(1, len(names))
    pairs = np.unique(sentence[known] * kinds + renumber[code[known]])
    at, feature = (pairs // kinds).astype(np.int32), (pairs % kinds).astype(np.int32)
    del pairs, known, code
    if not (label == 1).any() or not (label == 0).any():
        return Model(names, np.zeros(len(names)), -12.0)
    pull = pulls[0]
    if len(pulls) > 1 and (label == 1).sum() >= 2 * INNER_FOLDS:
        inner = np.arange(len(label)) % INNER_FOLDS == 0  # rows come by label, so both labels are in it
        wrong = {}
        for each in pulls:
            params, bias = _descended(at, feature, sentence_doc, label, np.where(inner, 0.0, weight), len(names), each)
            toxic = _bags(at, params[feature], bias, sentence_doc, len(label))[1] <= 1 - THRESHOLD
            wrong[each] = int(((toxic != (label == 1)) & inner).sum())
        pull = min(pulls, key=lambda x: (wrong[x], x))
    params, bias = _descended(at, feature, sentence_doc, label, weight, len(names), pull)
    used = params != 0
    return Model(names[used], params[used], bias)


def _bags(at: np.ndarray, weights: np.ndarray, bias: float, sentence_doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each sentence, and of each document that none of its sentences is toxic."""
    p = _logistic(bias + np.bincount(at, weights, len(sentence_doc)))
    return p, np.exp(np.bincount(sentence_doc, np.log1p(-np.minimum(p, 1 - 1e-12)), docs))


def _descended(at: np.ndarray, feature: np.ndarray, sentence_doc: np.ndarray, label: np.ndarray, weight: np.ndarray, words: int, pull: float) -> tuple[np.ndarray, float]:
    """Weights and bias after STEPS proximal gradient steps on the weighted likelihood; a step's largest move is RATE, later less."""
    params, bias, momentum, first = np.zeros(words), -6.0, np.zeros(words + 1), None
    total = weight.sum()
    for step in range(1, STEPS + 1):
        p, none = _bags(at, params[feature], bias, sentence_doc, len(label))
        ratio = np.where(label == 1, none / np.maximum(1 - none, 1e-9), -1.0) * weight
        slope = ratio[sentence_doc] * p / total
        grad = np.r_[np.bincount(feature, slope[at], words), slope.sum()]
        first = np.abs(grad[:-1]).max(initial=0.0) if first is None else first
        momentum = 0.9 * momentum + 0.1 * grad
        move = RATE * min(1.0, 40 / step) / (np.abs(momentum).max() + 1e-12)
        params = params + move * momentum[:-1]
        params = np.sign(params) * np.maximum(np.abs(params) - move * pull * first, 0.0)
        bias += move * momentum[-1]
    return params, float(bias)


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, least_docs: int = LEAST_DOCS, most_bytes: int = MOST_BYTES) -> Model:
    """Fit on labelled rows outside the held-out fold. docs: doc_id, text; labels: doc_id, toxic."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    counts = {r["label"]: r["count"] for r in known.groupBy(F.when(F.col("label") == 1, 1).otherwise(0).alias("label")).count().collect()}
    likely = {k: known.where(is_k).where(likely_first(F.col("doc_id"), per_label, F.lit(max(1, counts.get(k, 0))))) for k, is_k in ((1, "label = 1"), (0, "label <> 1"))}
    chosen = likely[1].orderBy(*order).limit(per_label).unionByName(likely[0].orderBy(*order).limit(per_label))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for first, last in slices(offsets):
                row, sentence, word, _ = sentences(data, offsets[first : last + 1])
                ends = pa.array(np.searchsorted(row, np.arange(last - first + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (sentence.astype(np.int32), word.view(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), *lists], SAMPLE.names)

    def learn(got: pa.Table) -> Model:
        got = got.sort_by([("label", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        label = (got["label"].to_numpy() == 1).astype(int)
        lists = [got[c].combine_chunks() for c in ("sentence", "word")]
        size = lists[0].value_lengths().to_numpy()
        number, word = lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy().view(np.uint64)
        doc = np.repeat(np.arange(len(label)), size)
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
        del got, lists, number
        share = {k: counts.get(k, 0) / max(1, int((label == k).sum())) for k in (0, 1)}
        return fit(doc, np.cumsum(fresh) - 1, word, label, np.where(label == 1, share[1], share[0]), least_docs)

    # at most 2 * per_label ids
    short = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    sample = one_row_an_id(short.join(F.broadcast(chosen), "doc_id"), "text").select("label", "doc_id", "text")
    return fitted(sample.mapInArrow(lean(tokens), "label int, doc_id long, sentence array<int>, word array<long>"), SAMPLE, learn)


def _sentence_scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, probability, first byte) of each sentence of a slice; a word counts once a sentence."""
    row, sentence, word, first = sentences(data, offsets)
    starts = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]]) if len(row) else np.zeros(0, int)
    at = np.searchsorted(model.words, word)
    at[at == len(model.words)] = 0
    hit = model.words[at] == word if len(model.words) else np.zeros(len(word), bool)
    pairs = np.unique(sentence[hit] * max(1, len(model.words)) + at[hit])
    weights = model.weights[pairs % max(1, len(model.words))] if len(pairs) else None
    z = model.bias + np.bincount(pairs // max(1, len(model.words)), weights, len(starts)) if len(pairs) else np.full(len(starts), model.bias)
    return row[starts], _logistic(z), first[starts]


def _document_scores(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """score, sentences, worst sentence and its probability of each text."""
    n = len(texts)
    score, count, worst, most = np.zeros(n), np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n)
    data, offsets = buffers(texts)
    for first, last in slices(offsets):
        row, p, _ = _sentence_scores(model, data, offsets[first : last + 1])
        if not len(row):
            continue
        rows = last - first
        score[first:last] = -np.expm1(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), rows))
        count[first:last] = (size := np.bincount(row, minlength=rows))
        begin = np.cumsum(size) - size
        order = np.lexsort((np.arange(len(row)), -p, row))
        some = np.flatnonzero(size)
        top = order[begin[some]]
        worst[first + some], most[first + some] = top - begin[some], p[top]
    return np.clip(score, 0, 1), count, worst, most


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, n_sentences, worst_sentence (from 0, null if none), worst_score for every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, count, worst, most = _document_scores(model, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(count), pa.array(worst.astype(np.int32), mask=worst < 0), pa.array(most)],
                ["doc_id", "score", "predicted", "n_sentences", "worst_sentence", "worst_score"],
            )

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    return slim.mapInArrow(lean(run), "doc_id long, score double, predicted int, n_sentences long, worst_sentence int, worst_score double")


def offending_sentences(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, sentence, start (byte), score, text of each sentence that alone reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            ids, rows = batch.column(0).to_pylist(), []
            for first, last in slices(offsets):
                row, p, start = _sentence_scores(model, data, offsets[first : last + 1])
                begin = np.searchsorted(row, row)
                base = int(offsets[first])
                for i in np.flatnonzero(p >= threshold).tolist():
                    r = first + int(row[i])
                    a = base + int(start[i])
                    span = data[a : int(offsets[r + 1])]
                    stop = np.flatnonzero(_STOPS[span])
                    text = span[: stop[0] if len(stop) else len(span)].tobytes().decode("utf-8", "replace")
                    rows.append((ids[r], int(i - begin[i]), a - int(offsets[r]), float(p[i]), text))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "sentence", "start", "score", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(lean(run), "doc_id long, sentence int, start long, score double, text string")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_document_scores(model, batch.column(at))[0] < threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scores(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_sentences", "worst_sentence", "worst_score")
