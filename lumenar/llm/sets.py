"""Shingle sets of texts as columns, and their exact comparison in pairs that have been selected.

Each text's set is hashed once, in slices of its Arrow batch. Sets with equal digests (two independent
64-bit sums and the size) are one set with copies; a copy never takes part in a comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenar.llm.hot_keys import join_facts
from lumenar.llm.memory import lean
from lumenar.llm.shingles import buffers, mix, shingle_sets, signed, slices

SET_SCHEMA = "doc_id long, s1 long, s2 long, shingles array<long>"
#: What equal sets have in common.
DIGEST = ["n", "s1", "s2"]


def set_bounds(row: np.ndarray, rows: int) -> np.ndarray:
    return np.searchsorted(row, np.arange(rows + 1))


def _sums(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value))])
    return total[bounds[1:]] - total[bounds[:-1]]


def digests(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set: equal sets, equal digests."""
    return _sums(value, bounds).view(np.int64), _sums(value ^ np.uint64(0xA0761D6478BD642F), bounds).view(np.int64)


def each_slice(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """ids, bounds and hashes of each slice of rows."""
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        for first, last in slices(offsets):
            row, value = shingle_sets(data, offsets[first : last + 1], words)
            yield batch.column(0).slice(first, last - first), set_bounds(row, last - first), value


def list_column(bounds: np.ndarray, value: np.ndarray, most: int | None = None) -> pa.ListArray:
    size = np.diff(bounds)
    if most is not None and (size > most).any():
        place = np.arange(len(value)) - np.repeat(bounds[:-1], size)
        value, size = value[place < most], np.minimum(size, most)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(value)))


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bounds, value in each_slice(batches, words):
            s1, s2 = digests(value, bounds)
            yield pa.RecordBatch.from_arrays([ids, pa.array(s1), pa.array(s2), list_column(bounds, value)], ["doc_id", "s1", "s2", "shingles"])

    return docs.mapInArrow(lean(run), SET_SCHEMA)


def similar_sizes(nu: Column, nv: Column, percent: int) -> Column:
    return 100 * F.least(nu, nv) >= percent * F.greatest(nu, nv)


def met(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """pairs (rep, hub, copies) with the facts of both, those of the hub as ``hub_...``.

    A hub's facts are dealt in as many copies as its largest list asks for; a pair goes to one of
    the copies that its own lists ask for.
    """
    hubs = pairs.groupBy("hub").agg(F.max("copies").alias("most")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("most") - 1)))
    right = hubs.select("hub", "copy").join(facts.withColumnsRenamed({c: "hub" if c == "rep" else f"hub_{c}" for c in facts.columns}), "hub")
    left = pairs.join(facts, "rep").withColumn("copy", F.pmod(F.xxhash64("rep"), F.col("copies")).cast("int"))
    return left.join(right, ["hub", "copy"])


def verified(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The links (u, v) among the pairs (rep, hub, copies), by the exact overlap of their sets."""
    both = met(pairs, members.select("rep", "n", "shingles"))
    both = both.select("rep", "hub", "n", "hub_n", F.size(F.array_intersect("shingles", "hub_shingles")).cast("long").alias("both"))
    return both.where(100 * F.col("both") >= percent * (F.col("n") + F.col("hub_n") - F.col("both"))).select(F.col("rep").alias("u"), F.col("hub").alias("v"))


def _codes(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, code) of the values that occur in two rows or more."""
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    often = count > 1
    renumber = np.cumsum(often) - 1
    keep = often[code]
    return row[keep], renumber[code[keep]], int(often.sum())


def overlaps(lists: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
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


class Forest:
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


def with_components(rows: DataFrame, reps: DataFrame, links: DataFrame, total: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of rows (doc_id, n, s1, s2): sets (n, s1, s2, rep, copies) give their component to all copies."""
    groups = reps.select(*DIGEST, "rep", "copies").join(links.select(F.col("node").alias("rep"), "component"), "rep", "left")
    key = F.concat_ws(":", *DIGEST).alias("key")
    groups = groups.select(key, "copies", F.coalesce("component", "rep").alias("component"))
    placed = join_facts(rows.where("n > 0").select("doc_id", "n", key), groups, "key", "copies", total).select("doc_id", "n", "component")
    placed = placed.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))
    component = F.col("component")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def groups_oracle(words: int, percent: int) -> str:
    """DuckDB: documents by reachability over links of all pairs that share a shingle."""
    return f"""
WITH RECURSIVE
tokens AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
parts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 1}, least(len(w), 1)) + 1)) AS i FROM tokens),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + {words - 1}], ' ') AS s FROM parts),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT u, v FROM pairs JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * common >= {percent} * (a.n + b.n - common)),
ways AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM tokens UNION SELECT doc_id, v FROM reached JOIN ways ON u = other),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM tokens LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""
