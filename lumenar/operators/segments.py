"""Greedy batches of documents in order, bounded by count and by characters, cut by many tasks at once.

Where a batch starts depends on where the one before it ended, back to the first document. The documents are
dealt into blocks of equal count, at least as many as a batch may hold, and each block answers for every batch
that may be open when it begins: what is then open at its end, and how many began inside. There are at most as
many open batches as documents in a batch. The answers of neighbouring blocks are composed by pointer doubling,
and each block then numbers its own documents. Inside a block the end of a batch is a binary search in prefix sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenar.operators.adaptive import numbered
from lumenar.storage import Scratch, written

#: Documents of a block: three numbers each in its task.
BLOCK_DOCS = 200_000

_STATE = ["docs", "chars"]
_STATES = "block long, docs long, chars long"
_ANSWERS = "block long, docs long, chars long, to_docs long, to_chars long, began long"


def batch_ends(chars: np.ndarray, most_docs: int, most_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document of a block the place after the last one of a batch that it opens, and what that batch holds if it may go on beyond the block (0 if not)."""
    n, place, through = len(chars), np.arange(len(chars)), np.cumsum(chars)
    ends = np.minimum(np.searchsorted(through, through - chars + most_chars, "right"), place + most_docs)
    ends = np.maximum(ends, place + 1)  # a longer document is a batch of its own
    held = through[-1] - through + chars
    goes_on = (ends >= n) & (place + most_docs > n) & (held <= most_chars)
    return ends, np.where(goes_on, n - place, 0)


def taken_by(docs: int, chars: int, lengths: np.ndarray, most_docs: int, most_chars: int) -> int:
    """How many of a block's documents a batch takes that is open when the block begins; none is open where it holds none."""
    if docs == 0:
        return 0
    return int(min(most_docs - docs, np.searchsorted(np.cumsum(lengths), most_chars - chars, "right")))


def _lengths(block: pa.Table) -> np.ndarray:
    return block.sort_by("place")["chars"].to_numpy()


def _batches_at_end(block: pa.Table, most_docs: int, most_chars: int) -> pa.Table:
    """The batches that may be open when the next block begins."""
    chars = _lengths(block)
    _, docs = batch_ends(chars, most_docs, most_chars)
    first = np.flatnonzero(docs)
    held = np.cumsum(chars[::-1])[::-1][first]
    return pa.table({"block": pa.array(np.full(len(first), block["block"][0].as_py() + 1), pa.int64()), "docs": pa.array(docs[first], pa.int64()), "chars": pa.array(held, pa.int64())})


def _answers(block: pa.Table, states: pa.Table, most_docs: int, most_chars: int) -> pa.Table:
    """What each batch that may be open when the block begins becomes over the block; nothing after the last block."""
    names = ["block", "docs", "chars", "to_docs", "to_chars", "began"]
    if not block.num_rows:
        return pa.table([pa.array([], pa.int64())] * len(names), names=names)
    chars = _lengths(block)
    n = len(chars)
    ends, docs = batch_ends(chars, most_docs, most_chars)
    last, began = list(range(n)), [1] * n
    for i, end in zip(range(n - 1, -1, -1), ends[::-1].tolist(), strict=True):
        if end < n:
            last[i], began[i] = last[end], began[end] + 1
    held = np.cumsum(chars[::-1])[::-1]
    rows = []
    for open_docs, open_chars in [(0, 0), *zip(states["docs"].to_pylist(), states["chars"].to_pylist(), strict=True)]:
        taken = taken_by(open_docs, open_chars, chars, most_docs, most_chars)
        if taken == n:  # only in the last block, which may be short
            rows.append((open_docs, open_chars, 0, 0, 0))
            continue
        at = last[taken]
        rows.append((open_docs, open_chars, int(docs[at]), int(held[at]) if docs[at] else 0, began[taken]))
    number = block["block"][0].as_py()
    columns = [[number] * len(rows), *map(list, zip(*rows, strict=True))]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)


def _numbered(block: pa.Table, most_docs: int, most_chars: int) -> pa.Table:
    block = block.sort_by("place")
    chars = block["chars"].to_numpy()
    ends, _ = batch_ends(chars, most_docs, most_chars)
    mark = np.zeros(len(chars), np.int64)
    at = taken_by(block["open_docs"][0].as_py(), block["open_chars"][0].as_py(), chars, most_docs, most_chars)
    while at < len(chars):
        mark[at] = 1
        at = int(ends[at])
    return pa.table({"at": block["at"], "batch": pa.array(block["before"][0].as_py() - 1 + np.cumsum(mark), pa.int64())})


def _entries(answers: DataFrame, blocks: int, scratch: Scratch) -> DataFrame:
    """(block, docs, chars, before): the batch that is open when each block begins, and how many began before; by pointer doubling over blocks."""
    reached = answers.where("block = 0 and docs = 0").select("block", *_STATE, F.lit(0).cast("long").alias("before"))
    span = 1
    while span < blocks:
        at = ["block", *_STATE]
        on = reached.join(answers, at).select((F.col("block") + span).alias("block"), F.col("to_docs").alias("docs"), F.col("to_chars").alias("chars"), (F.col("before") + F.col("began")).alias("before"))
        reached = scratch.written(reached.unionByName(on.where(F.col("block") < blocks)), "block-entries")
        then = answers.select((F.col("block") - span).alias("block"), F.col("docs").alias("to_docs"), F.col("chars").alias("to_chars"), F.struct("to_docs", "to_chars", "began").alias("then"))
        answers = answers.join(then, ["block", "to_docs", "to_chars"])
        answers = answers.select(*at, F.col("then.to_docs").alias("to_docs"), F.col("then.to_chars").alias("to_chars"), (F.col("began") + F.col("then.began")).alias("began"))
        answers = scratch.written(answers, "block-answers")
        span *= 2
    return reached


def batches_by_size(docs: DataFrame, most_docs: int, most_chars: int, chars: str = "n_chars", order: str = "doc_pos", key: str = "doc_id", block_docs: int | None = None) -> DataFrame:
    """(at, batch): (order, key) of every document and its batch, from 0.

    A document opens a batch if the open one holds ``most_docs`` documents or would hold more than ``most_chars`` characters
    with it; so a longer document is a batch of its own. Null and negative lengths count as 0; no documents, no rows.
    """
    if most_docs < 1:
        raise ValueError("a batch holds one document at least")
    size, scratch = max(block_docs or BLOCK_DOCS, most_docs), Scratch(docs.sparkSession)
    length = F.greatest(F.coalesce(F.col(chars).cast("long"), F.lit(0)), F.lit(0)).alias("chars")
    lengths = docs.select(*(F.col(c) for c in dict.fromkeys((order, key))), length)
    rows = written(numbered(lengths, order, key, carried=("chars",)).withColumn("block", F.floor(F.col("place") / size)), "documents-in-blocks")
    blocks = rows.agg(F.max("block")).first()[0]
    slim = rows.select("block", "place", "chars")
    states = slim.groupBy("block").applyInArrow(lambda block: _batches_at_end(block, most_docs, most_chars), _STATES)
    answers = slim.groupBy("block").cogroup(states.groupBy("block")).applyInArrow(lambda block, open_: _answers(block, open_, most_docs, most_chars), _ANSWERS)
    entries = _entries(scratch.written(answers, "block-answers"), (blocks if blocks is not None else -1) + 1, scratch)
    entries = written(entries.withColumnsRenamed({"docs": "open_docs", "chars": "open_chars"}), "block-entries")
    scratch.clear()
    told = rows.join(F.broadcast(entries), "block")  # a row a block
    out = rows.select("at").withColumn("batch", F.lit(0).cast("long")).schema
    return told.groupBy("block").applyInArrow(lambda block: _numbered(block, most_docs, most_chars), out)
