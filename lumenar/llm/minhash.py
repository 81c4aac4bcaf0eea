"""Near-duplicate groups from bottom-k sketches of one hash function, verified exactly.

1. Each text's shingle set is hashed once; its k smallest hashes are its sketch. Texts with
   equal sets are collapsed to their smallest doc_id, so copies cost nothing later.
2. Inverted lists of the retained values. Two sets with a Jaccard similarity of 0.8 or more
   share 20 of k = 64 retained values (a pair of huge sets at exactly 0.8 shares fewer with a
   chance of 4e-18, less than that of two shingles of a text with one 64-bit hash; for sets
   smaller than k the bound is exact), so of each sketch only its rarest values, one more than it
   may miss, need lists: passages that many documents share come last in that order.
3. Every list has up to four hubs, and its members are held against them: sizes first, then the
   similarity estimated from the bottom-k sketch of the union, then the exact overlap of the full
   sets. A hub's set is dealt in copies, so a list with a third of all rows is many tasks.
4. Members that such links connect need no comparison with each other. Lists in which members
   other than hubs are not all connected stay open; those of one first hub are taken together, cut
   into blocks by component and size, and pairs of blocks that hold different components of
   compatible sizes are tasks: overlap counts of the sketches and estimates select pairs, exact
   overlaps verify them, and a task returns a spanning forest of its links, never all pairs. Work
   is thus linear in the size of a group of near copies; it grows with the square only of what
   shares rare values without being similar, or connected by the hubs.
5. Components of the links give each document its group.

Defined results: null, empty and blank texts have no shingles and link with nothing; texts
with fewer words than a shingle have their whole word sequence as one shingle; doc_id is the
key: rows that repeat it count as one document; rows with a null doc_id take their set's
group, or null; ties do not matter; an empty table gives no rows; further columns are
ignored by ``near_duplicates`` and carried through by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenar.llm.bitmaps import maybe_members
from lumenar.llm.components import components
from lumenar.llm.hot_keys import join_facts
from lumenar.llm.memory import lean
from lumenar.llm.shingles import buffers, mix, shingle_sets, signed, slices
from lumenar.storage import Scratch, table, written

K = 64
#: Of a full sketch, the share of values that a linked sketch has as well; of a whole small set, the share by the threshold.
MISS_FULL, MISS_SMALL = 0.3125, 0.7
#: Pairs whose union-sketch estimate is lower are not verified. It is the same event as above: fewer than 20 of 64 values shared.
LEAST_ESTIMATE = 0.3125
#: Two blocks of an open list hold at most about so many rows together.
BLOCK_ROWS = 256
#: Members that meet a copy of their hub's set in a task.
MEMBERS_A_COPY = 256

SKETCH_SCHEMA = "doc_id long, n long, s1 long, s2 long, sketch array<long>"
SET_SCHEMA = "doc_id long, s1 long, s2 long, shingles array<long>"


def _bounds(row: np.ndarray, rows: int) -> np.ndarray:
    return np.searchsorted(row, np.arange(rows + 1))


def _sums(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value))])
    return total[bounds[1:]] - total[bounds[:-1]]


def _digest(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set: equal sets, equal digests."""
    return _sums(value, bounds).view(np.int64), _sums(value ^ np.uint64(0xA0761D6478BD642F), bounds).view(np.int64)


def _each(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """ids, bounds and hashes of each slice of rows."""
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        for first, last in slices(offsets):
            row, value = shingle_sets(data, offsets[first : last + 1], words)
            yield batch.column(0).slice(first, last - first), _bounds(row, last - first), value


def _lists(bounds: np.ndarray, value: np.ndarray, most: int | None = None) -> pa.ListArray:
    size = np.diff(bounds)
    if most is not None and (size > most).any():
        place = np.arange(len(value)) - np.repeat(bounds[:-1], size)
        value, size = value[place < most], np.minimum(size, most)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(value)))


def sketches(docs: DataFrame, words: int, k: int = K) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (set digest), sketch of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bounds, value in _each(batches, words):
            s1, s2 = _digest(value, bounds)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds)), pa.array(s1), pa.array(s2), _lists(bounds, value, k)], ["doc_id", "n", "s1", "s2", "sketch"])

    return docs.mapInArrow(lean(run), SKETCH_SCHEMA)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bounds, value in _each(batches, words):
            s1, s2 = _digest(value, bounds)
            yield pa.RecordBatch.from_arrays([ids, pa.array(s1), pa.array(s2), _lists(bounds, value)], ["doc_id", "s1", "s2", "shingles"])

    return docs.mapInArrow(lean(run), SET_SCHEMA)


def _alone(values: DataFrame) -> DataFrame:
    """(rep, alone): how many of each one's values (rep, v) no other one holds; such a value's group names its only holder."""
    single = values.groupBy("v").agg(F.count(F.lit(1)).alias("freq"), F.min("rep").alias("rep")).where("freq = 1")
    return single.groupBy("rep").agg(F.count(F.lit(1)).alias("alone"))


def _needed(m: Column, k: int) -> Column:
    """How many of the m values of a sketch a linked sketch has as well."""
    return F.when(m >= k, F.ceil(m * MISS_FULL)).otherwise(F.ceil(m * MISS_SMALL))


def _candidates(reps: DataFrame, k: int) -> DataFrame:
    """(rep) of the sketches of whose values others hold as many as a linked one would."""
    alone = _alone(reps.select("rep", F.explode("sketch").alias("v")))
    m = F.size("sketch")
    return reps.join(alone, "rep", "left").where(m - F.coalesce("alone", F.lit(0)) >= _needed(m, k)).select("rep")


def _covered(members: DataFrame, percent: int) -> DataFrame:
    """(rep) of the members of whose shingles a share of ``percent`` occurs in other members."""
    alone = _alone(members.select("rep", F.explode("shingles").alias("v")))
    held = F.col("n") - F.coalesce("alone", F.lit(0))
    return members.select("rep", "n").join(alone, "rep", "left").where(100 * held >= percent * F.col("n")).select("rep")


def _retained(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, n, m, v, freq) of the values of each sketch that others hold as well."""
    values = members.select("rep", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("v"))
    shared = scratch.written(values.groupBy("v").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1"), "shared-values")
    return join_facts(values, shared, "v", "freq", members.agg(F.sum(F.size("sketch"))).first()[0] or 0)


def _rarest(retained: DataFrame, k: int) -> DataFrame:
    """(rep, n, v): of each sketch the shared values that must be listed for no link to be missed."""
    mine = Window.partitionBy("rep")
    left = F.count(F.lit(1)).over(mine) - _needed(F.col("m"), k) + 1
    return retained.withColumn("left", left).withColumn("place", F.row_number().over(mine.orderBy("freq", "v"))).where("place <= left").select("rep", "n", "v")


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _codes(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, code) of the values that occur in two rows or more."""
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    often = count > 1
    renumber = np.cumsum(often) - 1
    keep = often[code]
    return row[keep], renumber[code[keep]], int(often.sum())


def _overlaps(lists: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each left with each right row's list."""
    row, code, n = _codes(lists)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, n, columns):
        a, b = np.searchsorted(code, [at, at + columns])
        m = np.zeros((len(lists), min(columns, n - at)), np.float32)
        m[row[a:b], code[a:b] - at] = 1
        out += m[left] @ m[right].T
    return out


def _estimates(sketch: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Share of the union's k smallest values that both sketches have. sketch: rows padded with the largest integer."""
    out = np.zeros(len(a))
    top = np.iinfo(np.int64).max
    for at in range(0, len(a), 8192):
        i, j = a[at : at + 8192], b[at : at + 8192]
        both = np.sort(np.concatenate([sketch[i], sketch[j]], axis=1), axis=1)
        twice = np.zeros(both.shape, bool)
        twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != top)
        rank = np.cumsum(~twice, axis=1)
        most = np.where((size[i] < k) & (size[j] < k), 2 * k, k)  # two whole sets: their whole union
        real = (both != top) & (rank <= most[:, None])
        out[at : at + 8192] = (twice & real).sum(1) / np.maximum((~twice & real).sum(1), 1)
    return out


def block_links(rep: np.ndarray, label: np.ndarray, n: np.ndarray, side: np.ndarray, sketch: list[np.ndarray], sets: list[np.ndarray], percent: int, k: int = K) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows of the two sides (0 and 1, or 2 for a block with itself) with different labels."""
    left, right = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
    if not len(left) or not len(right):
        return []
    share = _overlaps(sketch, left, right)
    size = np.array([len(x) for x in sketch])
    need = np.where(size >= k, np.ceil(size * MISS_FULL), np.ceil(size * MISS_SMALL))
    may = share >= np.minimum(need[left][:, None], need[right][None, :])
    may &= label[left][:, None] != label[right][None, :]
    may &= 100 * np.minimum(n[left][:, None], n[right][None, :]) >= percent * np.maximum(n[left][:, None], n[right][None, :])
    if (side == 2).any():
        may &= left[:, None] < right[None, :]
    i, j = np.nonzero(may)
    a, b = left[i], right[j]
    padded = np.full((len(rep), k), np.iinfo(np.int64).max)
    for r, x in enumerate(sketch):
        padded[r, : len(x)] = x
    keep = _estimates(padded, size, a, b, k) >= LEAST_ESTIMATE
    a, b, i, j = a[keep], b[keep], i[keep], j[keep]
    if not len(a):
        return []
    if len(a) > 2000:
        both = _overlaps(sets, left, right)[i, j].astype(np.int64)
    else:
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
    linked = 100 * both >= percent * (n[a] + n[b] - both)
    forest = _Forest(len(rep))
    return [(int(rep[x]), int(rep[y])) for x, y in zip(a[linked].tolist(), b[linked].tolist(), strict=True) if forest.join(x, y)]


def _likely(su: Column, sv: Column, k: int) -> Column:
    """Whether the union's k smallest values (all of them, for two whole sets) hold enough that are in both sketches."""
    union = F.array_sort(F.array_union(su, sv))
    most = F.when((F.size(su) < k) & (F.size(sv) < k), F.lit(2 * k)).otherwise(F.lit(k))
    bottom = F.slice(union, F.lit(1), most)
    return F.size(F.array_intersect(bottom, F.array_intersect(su, sv))) >= LEAST_ESTIMATE * F.size(bottom)


def _similar(nu: Column, nv: Column, percent: int) -> Column:
    return 100 * F.least(nu, nv) >= percent * F.greatest(nu, nv)


def _hub_links(lists: DataFrame, hubs: DataFrame, members: DataFrame, total: int, percent: int, k: int, scratch: Scratch) -> DataFrame:
    """The links (u, v) of members with the hubs v of their lists."""
    told = join_facts(lists, hubs, "v", "size", total).withColumn("is_hub", F.exists("hubs", lambda h: h["rep"] == F.col("rep")))
    met = told.select("rep", "n", "is_hub", F.ceil(F.col("size") / MEMBERS_A_COPY).cast("int").alias("copies"), F.explode("hubs").alias("hub"))
    met = met.where((F.col("rep") != F.col("hub.rep")) & (~F.col("is_hub") | (F.col("rep") < F.col("hub.rep"))))  # two hubs meet once
    met = met.where(_similar(F.col("n"), F.col("hub.n"), percent)).select("rep", F.col("hub.rep").alias("hub"), "copies")
    pairs = scratch.written(met.groupBy("rep", "hub").agg(F.max("copies").alias("copies")), "hub-pairs")
    # sketches first: most pairs go before any full set is moved
    near = _met(pairs, members.select("rep", "n", "sketch")).where(_likely(F.col("sketch"), F.col("hub_sketch"), k)).select("rep", "hub", "copies")
    both = _met(scratch.written(near, "likely-pairs"), members.select("rep", "n", "shingles"))
    both = both.select("rep", "hub", "n", "hub_n", F.size(F.array_intersect("shingles", "hub_shingles")).cast("long").alias("both"))
    return both.where(100 * F.col("both") >= percent * (F.col("n") + F.col("hub_n") - F.col("both"))).select(F.col("rep").alias("u"), F.col("hub").alias("v"))


def _met(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """pairs (rep, hub, copies) with the facts of both, those of the hub as ``hub_...``.

    A hub's facts are dealt in as many copies as its largest list asks for; a pair goes to one of
    the copies that its own lists ask for.
    """
    hubs = pairs.groupBy("hub").agg(F.max("copies").alias("most")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("most") - 1)))
    right = hubs.select("hub", "copy").join(facts.withColumnsRenamed({c: "hub" if c == "rep" else f"hub_{c}" for c in facts.columns}), "hub")
    left = pairs.join(facts, "rep").withColumn("copy", F.pmod(F.xxhash64("rep"), F.col("copies")).cast("int"))
    return left.join(right, ["hub", "copy"])


def _between_components(listed: DataFrame, members: DataFrame, percent: int, k: int, scratch: Scratch) -> DataFrame:
    """Links between different labels of each group g of (g, rep, n, label), by pairs of blocks."""
    half = BLOCK_ROWS // 2
    # sizes of linked sets are at most one class apart
    sized = listed.withColumn("class", F.floor(F.log("n") / F.log(F.lit(100 / percent + 1e-9))).cast("int"))
    counts = sized.groupBy("g", "label", "class").agg(F.count(F.lit(1)).alias("rows"))
    small = F.col("rows") <= half
    kind = F.when(small, F.lit(None)).otherwise(F.col("label")).alias("own")  # a large component has blocks of its own
    parts = counts.groupBy("g", "class", kind).agg(F.ceil(F.sum("rows") / half).cast("int").alias("parts"))
    cells = counts.select("g", "label", "class", kind).join(parts.select("g", "class", F.col("own").alias("o"), "parts").withColumnRenamed("class", "c").withColumnRenamed("g", "h"), (F.col("g") == F.col("h")) & (F.col("class") == F.col("c")) & F.col("own").eqNullSafe(F.col("o")))
    placed = sized.join(cells.select("g", "label", "class", "own", "parts"), ["g", "label", "class"])
    part = F.pmod(F.when(F.col("own").isNull(), F.xxhash64("label")).otherwise(F.xxhash64("rep")), F.col("parts")).cast("int")
    placed = placed.select("g", "rep", "label", "class", "own", F.xxhash64("class", "own", part).alias("block"))
    placed = scratch.written(placed, "blocks")
    blocks = placed.groupBy("g", "block").agg(F.first("class").alias("class"), F.first("own").alias("own"))
    other = blocks.withColumnsRenamed({"block": "b", "own": "o", "class": "c"})
    pairs = blocks.join(other, "g").where((F.abs(F.col("class") - F.col("c")) <= 1) & F.coalesce(F.col("own") != F.col("o"), F.lit(True)))
    side = F.when(F.col("block") == F.col("b"), 2).when(F.col("block") < F.col("b"), 0).otherwise(1)
    pairs = pairs.select("g", "block", F.least("block", "b").alias("bi"), F.greatest("block", "b").alias("bj"), side.alias("side"))
    rows = placed.select("g", "block", "rep", "label").join(pairs, ["g", "block"]).join(members, "rep")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        found = block_links(group["rep"].to_numpy(), group["label"].to_numpy(), group["n"].to_numpy(), group["side"].to_numpy(), list(group["sketch"]), list(group["shingles"]), percent, k)
        return pd.DataFrame(found, columns=["u", "w"], dtype="int64")

    slim = rows.select("g", "bi", "bj", "rep", "label", "n", "side", "sketch", "shingles")
    return slim.groupBy("g", "bi", "bj").applyInPandas(solve, "u long, w long").withColumnRenamed("w", "v")


def _links(docs: DataFrame, reps: DataFrame, words: int, percent: int, k: int, scratch: Scratch) -> DataFrame:
    """Verified links (u, v) between representatives that connect what all links connect."""
    candidates = scratch.written(_candidates(reps, k), "candidates")
    wanted = maybe_members(docs, "doc_id", candidates, "rep")
    sets = full_sets(wanted, words).groupBy(F.col("doc_id").alias("rep"), "s1", "s2").agg(F.first("shingles").alias("shingles"))
    members = scratch.written(reps.join(candidates, "rep").join(sets, ["rep", "s1", "s2"]).select("rep", "n", "sketch", "shingles"), "candidate-sets")
    members = scratch.written(members.join(scratch.written(_covered(members, percent), "covered"), "rep", "left_semi"), "members")

    lists = scratch.written(_rarest(_retained(members, scratch), k), "postings")
    total = lists.count()
    ends = [end(F.struct(F.xxhash64(F.lit(seed), "rep"), "rep", "n")) for seed in (0, 1) for end in (F.min, F.max)]
    hubs = lists.groupBy("v").agg(F.array_distinct(F.transform(F.array(*ends), lambda x: F.struct(x["rep"].alias("rep"), x["n"].alias("n")))).alias("hubs"), F.count(F.lit(1)).alias("size")).where("size > 1")
    hubs = scratch.written(hubs, "hubs")
    links = scratch.written(_hub_links(lists, hubs, members, total, percent, k, scratch), "hub-links")
    stars = scratch.written(components(links, "hub-components").withColumnsRenamed({"node": "u", "component": "v"}), "hub-stars")

    wide = hubs.where(F.col("size") > F.size("hubs") + 1)  # in others, every pair has a hub
    told = join_facts(lists, wide, "v", "size", total).where(~F.exists("hubs", lambda h: h["rep"] == F.col("rep")))
    told = told.join(stars.select(F.col("u").alias("rep"), F.col("v").alias("label")), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    told = scratch.written(told.select("v", "rep", "n", "label", F.col("hubs")[0]["rep"].alias("g")), "not-hubs")
    still = told.groupBy("v").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("others")).where("low <> high").select("v", "others")
    still = scratch.written(still, "open-lists")
    if still.isEmpty():
        return stars
    rest = join_facts(told, still, "v", "others", told.count()).select("g", "rep", "n", "label").distinct()
    return stars.unionByName(_between_components(scratch.written(rest, "open-members"), members, percent, k, scratch))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row. Links: 100 * intersection >= percent * union; percent is 80 or more."""
    if percent < 80:
        raise ValueError("the candidate bounds hold for a similarity of 0.8 or more")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(sketches(slim, words, k), "sketches")
    same = ["n", "s1", "s2"]
    some = rows.where("n > 0")
    reps = written(some.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")), "reps")
    scratch = Scratch(docs.sparkSession)
    links = components(_links(slim, reps.where("rep is not null"), words, percent, k, scratch), "links")  # reads the links once
    scratch.clear()
    groups = reps.select(*same, "rep", "copies").join(links.select(F.col("node").alias("rep"), "component"), "rep", "left")
    key = F.concat_ws(":", *same).alias("key")
    groups = groups.select(key, "copies", F.coalesce("component", "rep").alias("component"))
    placed = join_facts(some.select("doc_id", "n", key), groups, "key", "copies", rows.count()).select("doc_id", "n", "component")
    placed = placed.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))
    component = F.col("component")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of one document of each group, with all their columns; rows with a null doc_id stay."""
    gone = near_duplicates(docs, id_col, text_col, words, percent).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)
