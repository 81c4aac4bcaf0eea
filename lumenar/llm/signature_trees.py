"""Signature trees over members of lists, and their dual traversal, as tables.

A tree holds the members of one list. Its nodes carry the bitwise OR of their members' token bitmaps, the
range of their set sizes, the most tokens that any member's bitmap lost to collisions, and their label (the component
known so far) if they have but one. Leaves hold members of one class of sizes, of one label where a label
has many, else of several; eight leaves have a parent, eight parents one, up to the root.

A dual traversal goes down pairs of nodes from (root, root), one level of all trees a step. A pair of nodes is
left when no two of their members can be similar: their size ranges are too far apart, or the maximum possible
overlap (common bits, and the collisions of the poorer side) is less than the least overlap that a link of
their smallest sizes needs. Two nodes of one and the same label are never paired, so near copies cost nodes, not pairs.

Pairs of leaves that remain, and trees of few members, which are one leaf, are tasks. In a task members are first held
against each other by short marks (a lower bound of what two sets differ in), so that only sets that may be similar
are moved; these are compared exactly, and a task of a large tree returns a spanning forest of its links.

Nothing is a self-join of a list: children meet through the pair of their parents, and a node has about eight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lumenar.llm.hot_keys import join_facts
from lumenar.llm.memory import lean
from lumenar.llm.sets import Forest, overlaps, verified
from lumenar.storage import Scratch

#: Bits of a bitmap; that of Spark's own bitmap functions.
BITS = 1 << 15
FAN_OUT = 8
#: A leaf holds at most about so many members, and so many tokens of them.
LEAF_ROWS, LEAF_TOKENS = 1024, 1 << 22
#: A tree of at most so many members is one leaf, and its pairs are few.
SMALL_TREE = 64
#: Bits of a mark. What may be similar beyond twice as many differences is left to the exact comparison.
MARK_BITS = 1 << 11

_BITS_SCHEMA = "rep long, bits binary, excess long"


def bitmaps(members: DataFrame) -> DataFrame:
    """(rep, bits, excess) of members (rep, shingles); the excess is how many tokens have a bit that another one has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                size = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                bit = part.column(1).flatten().to_numpy() & (BITS - 1)
                out = np.zeros((part.num_rows, BITS), bool)
                out[np.repeat(np.arange(part.num_rows), size), bit] = True
                packed = np.packbits(out, axis=1, bitorder="little")
                excess = size - out.sum(1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(excess.astype(np.int64))], ["rep", "bits", "excess"])

    return members.select("rep", "shingles").mapInArrow(lean(run), _BITS_SCHEMA)


def marks(members: DataFrame) -> DataFrame:
    """(rep, n, mark) of members (rep, n, shingles): for each bit whether the number of its tokens is odd, so that tokens of both sets cancel out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                size = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                bit = part.column(2).flatten().to_numpy() & (MARK_BITS - 1)
                tokens = np.bincount(np.repeat(np.arange(part.num_rows), size) * MARK_BITS + bit, minlength=part.num_rows * MARK_BITS)
                packed = np.packbits((tokens & 1).astype(bool).reshape(-1, MARK_BITS), axis=1, bitorder="little")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in packed], pa.binary())], ["rep", "n", "mark"])

    return members.select("rep", "n", "shingles").mapInArrow(lean(run), "rep long, n long, mark binary")


@F.pandas_udf(LongType())
def differing_bits(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = (np.frombuffer(b"".join(s), np.uint64).reshape(-1, MARK_BITS // 64) for s in (a, b))
    return pd.Series(np.bitwise_count(x ^ y).sum(1, dtype=np.int64))


def marks_allow(a: str, b: str, percent: int) -> Column:
    """Whether two sets may be similar by (n, mark) with the prefixes: each bit that differs is that of a token that differs."""
    most = F.floor((F.col(f"{a}n") + F.col(f"{b}n")) * (100 - percent) / F.lit(100.0 + percent) + 1e-9)
    return differing_bits(f"{a}mark", f"{b}mark") <= most


@F.pandas_udf(LongType())
def common_bits(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.zeros(len(a), np.int64)
    for at in range(0, len(a), 512):
        x, y = (np.frombuffer(b"".join(s.iloc[at : at + 512]), np.uint64).reshape(-1, BITS // 64) for s in (a, b))
        out[at : at + 512] = np.bitwise_count(x & y).sum(1)
    return pd.Series(out)


def sizes_may_link(prefix_a: str, prefix_b: str, percent: int) -> Column:
    """Whether two ranges hold two sizes of which one is at least ``percent`` of the other."""
    low_a, high_a, low_b, high_b = (F.col(f"{p}_{c}") for p in (prefix_a, prefix_b) for c in ("low", "high"))
    return (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)


def _may_link(percent: int) -> Column:
    """Whether the maximum possible overlap of two nodes is at least what a link of their smallest fitting sizes needs."""
    low_a = F.greatest("a_low", F.ceil(F.col("b_low") * percent / F.lit(100.0)))
    low_b = F.greatest("b_low", F.ceil(F.col("a_low") * percent / F.lit(100.0)))
    needed = F.ceil((low_a + low_b) * percent / F.lit(100.0 + percent) - 1e-9)
    return common_bits("a_bits", "b_bits") + F.least("a_excess", "b_excess") >= needed


def _facts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("excess").alias("excess"), F.bitmap_or_agg("bits").alias("bits"), F.min("first").alias("first"), F.max("last").alias("last"))


def _side(nodes: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return nodes.withColumnsRenamed({c: f"{prefix}_{c}" for c in nodes.columns if c not in keys})


class Trees:
    """The nodes of all trees of ``listed`` (tree, rep, n, label), written to the shared folder."""

    def __init__(self, listed: DataFrame, members: DataFrame, percent: int, scratch: Scratch) -> None:
        total = listed.count()
        # sizes of similar sets are at most one class apart
        sized = listed.withColumn("class", F.floor(F.log("n") / F.log(F.lit(100 / percent + 1e-9))).cast("int")).withColumn("cell", F.struct("tree", "class", "label"))
        labels = sized.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens"))
        many = (F.col("rows") > LEAF_ROWS / 2) | (F.col("tokens") > LEAF_TOKENS / 2)
        labels = labels.withColumn("own", F.when(many, F.col("cell.label"))).withColumn("kind", F.struct("cell.tree", "cell.class", "own"))
        labels = scratch.written(labels, "label-sizes")
        parts = F.ceil(F.greatest(F.sum("rows") / LEAF_ROWS, F.sum("tokens") / LEAF_TOKENS)).cast("int").alias("parts")
        kinds = labels.groupBy("kind").agg(parts, F.count(F.lit(1)).alias("labels"))
        facts = join_facts(labels, kinds, "kind", "labels", total).select("cell", "rows", "own", "parts")
        placed = join_facts(sized, scratch.written(facts, "leaf-counts"), "cell", "rows", total)
        part = F.pmod(F.when(F.col("own").isNull(), F.xxhash64("label")).otherwise(F.xxhash64("rep")), F.col("parts"))
        placed = placed.select("tree", "rep", "n", "label", F.xxhash64("tree", "class", "own", part).alias("leaf"))
        self.placed = scratch.written(placed, "tree-members")
        marked = self.placed.join(bitmaps(members), "rep").select("tree", "leaf", F.col("n").alias("low"), F.col("n").alias("high"), "excess", "bits", F.col("label").alias("first"), F.col("label").alias("last"))
        leaves = scratch.written(_facts(marked, "tree", "leaf"), "tree-leaves")

        wide = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("leaves"))
        depth = F.greatest(F.lit(0), F.ceil(F.log(F.col("leaves") / FAN_OUT) / F.log(F.lit(float(FAN_OUT))) - 1e-9)).cast("int")
        leaves = join_facts(leaves, wide.select("tree", "leaves", depth.alias("depth")), "tree", "leaves", total)
        # the slot of a leaf on the lowest level of its tree; one digit less a level up
        leaves = leaves.withColumn("slot", F.pmod(F.xxhash64("leaf"), F.pow(F.lit(FAN_OUT), F.col("depth")).cast("long")))
        up = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth"))))
        up = up.withColumn("id", F.floor(F.col("slot") / F.pow(F.lit(FAN_OUT), F.col("depth") - F.col("level"))).cast("long"))
        slots = _facts(up, "tree", "level", "id").select("*", F.floor(F.col("id") / FAN_OUT).cast("long").alias("parent"), F.lit(False).alias("is_leaf"))
        lowest = leaves.withColumn("level", F.col("depth") + 1).withColumn("parent", F.col("slot")).withColumn("id", F.col("leaf")).withColumn("is_leaf", F.lit(True))
        self.nodes = scratch.written(slots.unionByName(lowest.select(*slots.columns)), "tree-nodes")

    def leaf_pairs(self, percent: int, scratch: Scratch) -> DataFrame:
        """(tree, a, b): leaves that may hold a link, or one leaf twice."""
        on = ["tree", "level"]
        a, b = (_side(self.nodes, p, on) for p in "ab")
        front = self.nodes.where("level = 0").select("tree", F.lit(1).alias("level"), F.col("id").alias("pa"), F.col("id").alias("pb"))
        found = []
        while not front.isEmpty():
            met = front.join(a.withColumnRenamed("a_parent", "pa"), [*on, "pa"]).join(b.withColumnRenamed("b_parent", "pb"), [*on, "pb"])
            once = (F.col("pa") < F.col("pb")) | (F.col("a_id") <= F.col("b_id"))  # within one parent each pair once
            one_label = (F.col("a_first") == F.col("b_last")) & (F.col("a_last") == F.col("b_first"))
            met = met.where(once & ~one_label & sizes_may_link("a", "b", percent))
            kept = met.where((F.col("a_id") == F.col("b_id")) | _may_link(percent))
            kept = scratch.written(kept.select("tree", "level", "a_id", "b_id", "a_is_leaf"), "node-pairs")
            found.append(kept.where("a_is_leaf").select("tree", F.col("a_id").alias("a"), F.col("b_id").alias("b")))
            front = kept.where("not a_is_leaf").select("tree", (F.col("level") + 1).alias("level"), F.col("a_id").alias("pa"), F.col("b_id").alias("pb"))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out


def _sides(side: np.ndarray) -> np.ndarray:
    """Which rows meet: of two sides (0 and 1) each with the other one's, of one leaf (2) all."""
    return (side[:, None] != side[None, :]) | (side == 2)[:, None]


def _may_be_similar(n: np.ndarray, mark: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Of pairs of rows those that sizes and marks allow: each bit that differs is that of a token that differs."""
    out = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    at = np.flatnonzero(out)
    for k in range(0, len(at), 1 << 15):
        some = at[k : k + (1 << 15)]
        differ = np.bitwise_count(mark[i[some]] ^ mark[j[some]]).sum(1, dtype=np.int64)
        out[some] = differ <= (100 - percent) * (n[i[some]] + n[j[some]]) // (100 + percent)
    return out


def suspects(label: np.ndarray, n: np.ndarray, mark: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """The rows of a leaf, or of a pair of leaves, that may be similar to one of another label."""
    meet, found = _sides(side), np.zeros(len(n), bool)
    for i in range(len(n)):
        j = np.flatnonzero(meet[i, i + 1 :] & (label[i + 1 :] != label[i])) + i + 1
        j = j[_may_be_similar(n, mark, np.full(len(j), i), j, percent)]
        found[j] = True
        found[i] |= len(j) > 0
    return np.flatnonzero(found)


def leaf_links(rep: np.ndarray, label: np.ndarray, n: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows that meet and have different labels."""
    may = _sides(side) & (label[:, None] != label[None, :])
    may &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    i, j = np.nonzero(np.triu(may, 1))
    if not len(i):
        return []
    if len(i) > 2000:
        every = np.arange(len(rep))
        both = overlaps(sets, every, every)[i, j].astype(np.int64)
    else:
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    linked = 100 * both >= percent * (n[i] + n[j] - both)
    forest = Forest(len(rep))
    return [(int(rep[x]), int(rep[y])) for x, y in zip(i[linked].tolist(), j[linked].tolist(), strict=True) if forest.join(x, y)]


def _marks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, MARK_BITS // 64)


def _likely_pairs(small: DataFrame, percent: int) -> DataFrame:
    """(rep, hub) of small trees (rep, n, label, mark lists a row) that may be similar and have different labels; many trees at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                held = batch.column(0).slice(at, 1024)
                size = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = held.flatten()
                rep, n, label = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("rep", "n", "label"))
                mark = _marks(flat.field("mark"))
                first = np.repeat(np.cumsum(size) - size, size)  # of each member: where its tree begins
                later = first + np.repeat(size, size) - 1 - np.arange(len(rep))  # how many members of its tree come after it
                i = np.repeat(np.arange(len(rep)), later)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
                differ = label[i] != label[j]
                i, j = i[differ], j[differ]
                may = _may_be_similar(n, mark, i, j, percent)
                u, v = rep[i[may]], rep[j[may]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["rep", "hub"])

    return small.mapInArrow(lean(run), "rep long, hub long")


def tree_links(listed: DataFrame, members: DataFrame, told: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (u, v) between different labels of each tree of listed (tree, rep, n, label) that connect what all its links connect.

    ``members`` (rep, n, shingles) has the sets, ``told`` their ``marks``. A member is listed once a tree.
    """
    sizes = listed.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))
    sized = scratch.written(join_facts(listed, sizes, "tree", "size", listed.count()), "sized-trees")
    marked = told.select("rep", "mark")
    held = sized.where(F.col("size") <= SMALL_TREE).join(marked, "rep")
    held = held.groupBy("tree").agg(F.collect_list(F.struct("rep", "n", "label", "mark")).alias("held")).select("held")  # SMALL_TREE members at most
    pairs = scratch.written(_likely_pairs(held, percent).distinct().withColumn("copies", F.lit(1)), "likely-pairs")
    links = verified(pairs, members, percent)
    large = sized.where(F.col("size") > SMALL_TREE).drop("size")
    if large.isEmpty():
        return links

    trees = Trees(large, members, percent, scratch)
    leaves = scratch.written(trees.leaf_pairs(percent, scratch), "leaf-pairs")
    task, itself = F.xxhash64("tree", "a", "b").alias("task"), F.col("a") == F.col("b")
    duties = leaves.select(task, F.col("a").alias("leaf"), F.when(itself, 2).otherwise(0).alias("side"))
    duties = duties.unionByName(leaves.where(~itself).select(task, F.col("b").alias("leaf"), F.lit(1).alias("side")))
    rows = trees.placed.join(duties, "leaf").join(marked, "rep").select("task", "rep", "n", "label", "mark", "side")

    def select(group: pd.DataFrame) -> pd.DataFrame:
        mark = np.frombuffer(b"".join(group["mark"]), np.uint64).reshape(-1, MARK_BITS // 64)
        found = suspects(group["label"].to_numpy(), group["n"].to_numpy(), mark, group["side"].to_numpy(), percent)
        return group.iloc[found][["task", "rep", "n", "label", "side"]]

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        found = leaf_links(group["rep"].to_numpy(), group["label"].to_numpy(), group["n"].to_numpy(), group["side"].to_numpy(), list(group["shingles"]), percent)
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    few = scratch.written(rows.groupBy("task").applyInPandas(select, "task long, rep long, n long, label long, side int"), "suspects")
    whole = few.join(members.select("rep", "shingles"), "rep").select("task", "rep", "n", "label", "side", "shingles")
    return links.unionByName(whole.groupBy("task").applyInPandas(solve, "u long, v long"))
