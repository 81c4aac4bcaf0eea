"""Best-fit packing of token sequences with certified bin counts.

Texts are tokenised once, in Arrow batches, into pieces of at most ``capacity`` tokens; only
lengths and checksums go on. Each partition packs its pieces by best-fit decreasing and
computes dual-feasible-function lower bounds on the number of bins that its lengths need.
Where count and bound agree the partition is certified and final, but for its emptiest bin.
Partitions with a gap settle their full bins; the rest, and the emptiest bins, exchange their
pieces: they are dealt anew and packed again. No partition holds more than about
``pieces_a_partition`` pieces, whatever stays open. The rounds end when one partition is left,
when everything is certified, or with a round that lowers the number of open bins no more.

Token ids are those of ``tokenizers`` for the JSON file, its added tokens included where their
strings stand in a text, with no others added. The same merges are read from the rank file
beside it, which encodes about four times as fast; tests hold both encoders against each other.
That encoder fails at about a million blanks in a row, so texts with a run of ``BLANK_RUN`` or
more are encoded from the JSON file, as are all texts where the file's added tokens have rules
of their own (blanks around them, whole words, normalised text).

Defined results: a null or empty text is one piece of the end token alone; rows that repeat
a doc_id, and rows with a null one, are packed each and dealt by a number of their own, so
they don't meet in a task; texts of any length are encoded whole; equal lengths are taken in
order of doc_id and piece; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import itertools
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenar.llm.memory import lean
from lumenar.storage import Scratch, table, written

CAPACITY = 2048
PIECES_A_PARTITION = 40_000
BLANK_RUN = 100_000
_BLANKS = re.compile(r"\s+")
PIECE_SCHEMA = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def whole_encoder(path: str):
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def encoder(path: str):
    """The rank file's encoder with the JSON file's added tokens; none, if they are not plain strings."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as text:
        added = json.load(text)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        return None
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})


def encoded(path: str, text: str) -> list[int]:
    fast = encoder(path)
    if fast is None or len(text) >= BLANK_RUN and max(map(len, _BLANKS.findall(text)), default=0) >= BLANK_RUN:
        return whole_encoder(path).encode(text, add_special_tokens=False).ids
    return fast.encode(text, allowed_special="all")


def pieces_of(ids: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of a document; all but the first are full."""
    array = np.array(ids, "<u4")
    n = -(-len(array) // capacity)
    cuts = [0, *(len(array) - capacity * np.arange(n - 1, -1, -1)).tolist()]
    return [(a, b - a, zlib.crc32(array[a:b].tobytes())) for a, b in zip(cuts, cuts[1:], strict=False)]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, row (a number of the document's row), piece, start, length, ids_crc32 of every piece of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i in range(len(batch)):
                ids = encoded(path, batch.column(1)[i].as_py() or "")
                ids.append(end_id)
                rows.extend((i, k, *piece) for k, piece in enumerate(pieces_of(ids, capacity)))
            at, piece, start, length, crc = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 2)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "row", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(lean(run), PIECE_SCHEMA)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of two families of dual feasible functions, in exact integers."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    sizes = np.arange(capacity + 1)
    best = -(-int((count * sizes).sum()) // capacity)
    number, amount = np.cumsum(count), np.cumsum(count * sizes)
    for small in range(1, capacity // 2 + 1):  # lengths under `small` count nothing, over capacity - small a whole bin
        large = int(number[-1] - number[capacity - small])
        middle = int(amount[capacity - small] - amount[small - 1])
        best = max(best, large - (-middle // capacity))
    for k in range(1, 33):  # rounded down to multiples of 1/k, but for exact multiples of 1/(k + 1)
        exact = (k + 1) * sizes % capacity == 0
        value = np.where(exact, k * sizes, capacity * ((k + 1) * sizes // capacity))
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, fill of each bin) of lengths that come in descending order.

    Open bins lie in stacks by room left; an integer's bits tell which stacks have bins, so
    the tightest bin is found without a search.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, bins = 0, 0
    at, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        fits = open_rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            stack = rooms[room]
            chosen = stack.pop()
            if not stack:
                open_rooms ^= 1 << room
        else:
            room, chosen = capacity, bins
            bins += 1
        at[i], offset[i] = chosen, capacity - room
        left = room - length
        if left:
            if not rooms[left]:
                open_rooms |= 1 << left
            rooms[left].append(chosen)
    return at, offset, np.bincount(at, weights=lengths, minlength=bins).astype(np.int64)


def pack(pieces: DataFrame, capacity: int = CAPACITY, pieces_a_partition: int = PIECES_A_PARTITION) -> DataFrame:
    """``pieces`` (doc_id, row, piece, length, ...) with sequence_id, offset, and bins and bound of the partition that packed them."""
    columns = pieces.columns
    schema = pieces.select(*columns, F.lit(0).alias("dealt"))._jdf.schema().toDDL() + ", bin long, offset long, bins long, bound long, final boolean, open_bins long"

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable")
        lengths = group["length"].to_numpy()
        at, offset, fill = best_fit(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        settled = np.full(len(fill), True) if len(fill) == bound else fill == capacity
        if fill[(emptiest := int(np.argmin(fill)))] < capacity:
            settled[emptiest] = False
        return group.assign(bin=at, offset=offset, bins=len(fill), bound=bound, final=settled[at], open_bins=int((~settled).sum()))

    waiting, open_bins, done = pieces, None, []
    for turn in itertools.count():
        parts = max(1, -(-waiting.count() // pieces_a_partition))
        dealt = waiting.withColumn("dealt", F.pmod(F.xxhash64("row", "piece", F.lit(turn)), F.lit(parts)).cast("int"))
        packed = written(dealt.groupBy("dealt").applyInPandas(solve, schema), f"packed{turn}")
        # one row a partition
        sums = packed.groupBy("dealt").agg(F.first("bins").alias("bins"), F.first("open_bins").alias("open")).agg(F.sum("bins").alias("bins"), F.sum("open").alias("open")).first()
        last = parts == 1 or not sums["open"] or open_bins is not None and sums["bins"] >= open_bins
        number = F.lit(turn).cast("long") * F.lit(1 << 56) + F.col("dealt").cast("long") * F.lit(1 << 28) + F.col("bin")
        settled = packed if last else packed.where("final")
        done.append(settled.select(*columns, number.alias("sequence_id"), "offset", "bins", "bound"))
        if last:
            break
        waiting, open_bins = packed.where("not final").select(*columns), sums["open"]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pieces of every document with the sequence and the offset each is packed at."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession)
    packed = pack(scratch.written(token_pieces(slim, path or vocabulary_path(), capacity), "pieces"), capacity).drop("row")
    scratch.clear()  # the packed tables hold all of them
    return packed


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
