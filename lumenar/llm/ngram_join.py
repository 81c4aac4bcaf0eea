"""N-gram Jaccard join by a forest of signature trees, exact for every pair.

1. Each text's shingle set is hashed once; equal sets are collapsed to their smallest doc_id, so copies
   cost nothing later.
2. Roots. Sets are taken in overlapping ranges of sizes such that any two similar sets share a range. Within a
   range two similar sets differ in at most d tokens, so of d + 1 parts of the token space at least one holds
   the same tokens of both: a range, a part and the hash of a set's tokens in it name the root of a tree, and
   every pair that may link meets in a tree. No estimate and no frequency of tokens is involved, and a
   passage that many texts share does not put them under one root, since it is spread over the parts. Trees
   with the same members are one tree.
3. Pivots. Each tree has up to two, and its members are held against them, by marks of their sets first (a lower bound of
   what differs) and then exactly; a pivot's set is dealt in
   copies, so a tree with a third of all rows is many tasks. Components of these links are the labels of
   the members; near copies of each other now have one label.
4. Trees that still hold several labels are built out (``signature_trees``): nodes with OR-combined token bitmaps and
   size ranges; a dual traversal leaves pairs of nodes whose maximum possible overlap is too low, and compares
   the leaves that remain exactly.
5. Components of all links give each document its group.

Work grows with the square only of members of one tree that carry different labels and whose bitmaps overlap.

Defined results: null, empty and blank texts have no shingles and link with nothing; texts with fewer words than a
shingle have their whole word sequence as one; doc_id is the key: rows that repeat it count as one document; rows with
a null doc_id take their set's group, or null; texts of any length are taken whole; ties do not matter; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenar.llm.bitmaps import maybe_members
from lumenar.llm.components import components
from lumenar.llm.hot_keys import join_facts
from lumenar.llm.memory import lean
from lumenar.llm.sets import DIGEST, digests, each_slice, full_sets, groups_oracle, list_column, met, similar_sizes, verified, with_components
from lumenar.llm.shingles import mix
from lumenar.llm.signature_trees import marks, marks_allow, tree_links
from lumenar.storage import Scratch, table, written

#: Members that meet a copy of their pivot's set in a task.
MEMBERS_A_COPY = 256

PARTS_SCHEMA = "doc_id long, n long, s1 long, s2 long, parts array<long>"


def size_borders() -> np.ndarray:
    """First sizes of the classes, each half as large again as the one before."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out, np.int64)


def ranges_of(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, range, parts) of the size ranges that sets of the sizes belong to.

    A set belongs to its class, and to a range across a border if a similar set may lie beyond it. The parts are one
    more than two similar sets of the range can differ in: their symmetric difference is at most
    (100 - percent) / (100 + percent) of the sum of their sizes.
    """
    borders, row = size_borders(), np.flatnonzero(n)  # an empty set is in none
    n = n[row]
    at = np.searchsorted(borders, n, "right") - 1
    low, high = borders[at], borders[at + 1]

    def parts(most: np.ndarray) -> np.ndarray:
        return (100 - percent) * most // (100 + percent) + 1

    under = percent * n <= 100 * (low - 1)  # a smaller one below this class
    over = 100 * n >= percent * high  # a larger one above it
    kinds = (
        (row, 2 * at, parts(2 * (high - 1))),
        (row[under], 2 * at[under] - 1, parts(low - 1 + 100 * (low - 1) // percent)[under]),
        (row[over], 2 * at[over] + 1, parts(high - 1 + 100 * (high - 1) // percent)[over]),
    )
    rows, which, count = (np.concatenate(c) for c in zip(*kinds, strict=True))
    several = count > 1  # with one part, only equal sets are similar
    return rows[several], which[several], count[several]


def part_keys(bounds: np.ndarray, value: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, keys) of each row's parts in all its ranges. ``value`` holds sorted tokens of the rows."""
    n = np.diff(bounds)
    row, which, parts = ranges_of(n, percent)
    size = n[row]
    owner = np.repeat(np.arange(len(row)), size)  # of each token: its row in a range
    token = value[np.repeat(bounds[row] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(owner))] if len(row) else value[:0]
    first = np.concatenate([[0], np.cumsum(parts)])
    # parts are intervals of hashes, so the tokens of one are neighbours
    slot = first[:-1][owner] + (((token >> np.uint64(32)) * parts[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    held = np.bincount(slot, minlength=int(first[-1]))
    ends = np.cumsum(held)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(token ^ np.uint64(0x5851F42D4C957F2D)))])
    place = np.arange(int(first[-1])) - np.repeat(first[:-1], parts)
    name = mix(np.repeat(which, parts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) + np.uint64(1))
    key = mix(total[ends] - total[ends - held] + name)
    order = np.argsort(np.repeat(row, parts), kind="stable")
    count = np.zeros(len(n), np.int64)
    np.add.at(count, row, parts)
    return np.concatenate([[0], np.cumsum(count)]), key[order]


def partial_signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (set digest), parts (keys of the set's trees) of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bounds, value in each_slice(batches, words):
            s1, s2 = digests(value, bounds)
            keys = list_column(*part_keys(bounds, value, percent))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds)), pa.array(s1), pa.array(s2), keys], ["doc_id", "n", "s1", "s2", "parts"])

    return docs.mapInArrow(lean(run), PARTS_SCHEMA)


def _trees(rows: DataFrame, reps: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Trees (tree, size, pivots) of two members or more, one for each group of members, and their members (tree, rep, n)."""
    keys = rows.where("n > 0 and doc_id is not null").select(*DIGEST, F.explode("parts").alias("tree"))
    # copies share all keys; different sets have different digests
    shared = keys.groupBy("tree").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low <> high").select("tree")
    shared = scratch.written(shared, "shared-parts")
    listed = maybe_members(keys, "tree", shared, "tree").distinct()
    listed = scratch.written(listed.join(reps.select(*DIGEST, "rep"), DIGEST).select("tree", "rep", "n"), "part-members")
    ends = [end(F.struct(F.xxhash64(F.lit(7), "rep"), "rep", "n")) for end in (F.min, F.max)]
    told = listed.groupBy("tree").agg(*(e.alias(f"e{i}") for i, e in enumerate(ends)), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(3), "rep")).alias("y"))
    told = told.where("size > 1").groupBy("size", "x", "y").agg(F.min("tree").alias("tree"), F.first("e0").alias("e0"), F.first("e1").alias("e1"))
    pivots = F.transform(F.array("e0", "e1"), lambda e: F.struct(e["rep"].alias("rep"), e["n"].alias("n")))
    trees = scratch.written(told.select("tree", "size", pivots.alias("pivots")), "trees")
    members = join_facts(listed, trees.select("tree", "size"), "tree", "size", listed.count()).select("tree", "rep", "n")
    return trees, scratch.written(members, "tree-lists")


def _pivot_links(trees: DataFrame, listed: DataFrame, members: DataFrame, told_of: DataFrame, total: int, percent: int, scratch: Scratch) -> DataFrame:
    """The links (u, v) of members with the pivots v of their trees; sets are moved where their marks allow a link."""
    told = join_facts(listed, trees, "tree", "size", total).select("rep", "n", F.ceil(F.col("size") / MEMBERS_A_COPY).cast("int").alias("copies"), F.explode("pivots").alias("pivot"))
    told = told.where((F.col("rep") != F.col("pivot.rep")) & similar_sizes(F.col("n"), F.col("pivot.n"), percent))
    pairs = told.select("rep", F.col("pivot.rep").alias("hub"), "copies").groupBy("rep", "hub").agg(F.max("copies").alias("copies"))
    near = met(scratch.written(pairs, "pivot-pairs"), told_of).where(marks_allow("", "hub_", percent)).select("rep", "hub", "copies")
    return verified(scratch.written(near, "likely-pairs"), members, percent)


def _links(docs: DataFrame, rows: DataFrame, reps: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Verified links (u, v) between representatives that connect what all links connect."""
    trees, listed = _trees(rows, reps, scratch)
    candidates = scratch.written(listed.select("rep").distinct(), "candidates")
    wanted = maybe_members(docs, "doc_id", candidates, "rep")
    sets = full_sets(wanted, words).groupBy(F.col("doc_id").alias("rep"), "s1", "s2").agg(F.first("shingles").alias("shingles"))
    members = scratch.written(reps.join(candidates, "rep").select("rep", "n", "s1", "s2").join(sets, ["rep", "s1", "s2"]).select("rep", "n", "shingles"), "members")
    told_of, total = scratch.written(marks(members), "marks"), listed.count()
    links = scratch.written(_pivot_links(trees, listed, members, told_of, total, percent, scratch), "pivot-links")
    stars = scratch.written(components(links, "pivot-components").withColumnsRenamed({"node": "u", "component": "v"}), "pivot-stars")
    told = listed.join(stars.select(F.col("u").alias("rep"), F.col("v").alias("label")), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    told = scratch.written(told, "labelled-members")
    still = told.groupBy("tree").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high and size > 2")  # of two members one is a pivot
    still = scratch.written(still.select("tree", "size"), "open-trees")
    rest = scratch.written(join_facts(told, still, "tree", "size", total).select("tree", "rep", "n", "label"), "open-members")
    return stars.unionByName(tree_links(rest, members, told_of, percent, scratch))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row. Links: 100 * intersection >= percent * union; percent is 80 to 100."""
    if not 80 <= percent <= 100:
        raise ValueError("the size classes hold for a similarity of 0.8 or more")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(partial_signatures(slim, words, percent), "partial-signatures")
    reps = written(rows.where("n > 0").groupBy(*DIGEST).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "set-reps")
    scratch = Scratch(docs.sparkSession)
    links = components(_links(slim, rows, reps.where("rep is not null"), words, percent, scratch), "links")  # reads the links once
    scratch.clear()
    return with_components(rows.select("doc_id", *DIGEST), reps, links, rows.count())


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents")).drop("kept")


ORACLE = f"SELECT * EXCLUDE (kept) FROM ({groups_oracle(3, 90)})"
