"""Schema discovery over a document store, with rules that tell when enough documents were read.

Documents are visited in batches; a processor (a model, or ground truth) gives the features
or the schema each batch shows. A batch is one distributed job, and only features, never
documents, reach the driver: there are as many as the schema has tables and attributes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenar.operators.similarity import entropy_stops, minimum_samples
from lumenar.storage import written

Schema = dict[str, list[str]]


def features_of(schema: Schema) -> set[str]:
    out = set()
    for table, attributes in schema.items():
        out.add(f"table:{table}")
        for a in attributes:
            out |= {f"{table}.{a}", f"attr:{a}"}
    return out


def entropy(now: set[str], before: set[str] | None) -> float:
    """Share of features that changed; the first schema and two empty ones have entropy 1."""
    union = now | (before or set())
    return 1.0 if before is None or not union else len(now ^ before) / len(union)


def streak(entropies: list[float], limit: float) -> int:
    n = 0
    for e in reversed(entropies):
        if e >= limit:
            break
        n += 1
    return n


def batches(lengths: Iterable[tuple[str, int]], most_docs: int, most_chars: int) -> list[list[str]]:
    """Ids in order, at most ``most_docs`` and ``most_chars`` a batch; a longer document is a batch of its own."""
    out: list[list[str]] = []
    chars = 0
    for doc, n in lengths:
        if not out or len(out[-1]) >= most_docs or (out[-1] and chars + n > most_chars):
            out.append([])
            chars = 0
        out[-1].append(doc)
        chars += n
    return out


def numbered(docs: DataFrame, order: str = "doc_pos", key: str = "doc_id", buckets: int = 200, carried: tuple[str, ...] = ()) -> DataFrame:
    """(at, place, carried columns): (order, key) of every document and its place in the order, from 0.

    Only these columns are read. Their ranges are numbered apart and offset by prefix counts
    (one row per range), so no task sees all documents. Ties of the order go by the key, then by what is carried.
    """
    at = F.struct(F.col(order).alias("o"), F.col(key).alias("k")).alias("at")
    keys = docs.select(at, *carried).repartitionByRange(buckets, "at", *carried)
    placed = written(keys.withColumn("_range", F.spark_partition_id()), "batch-keys")  # sampled ranges may differ from run to run
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("at", *carried)) - 1
    return placed.join(F.broadcast(before), "_range").select("at", (F.col("_before") + inside).alias("place"), *carried)


def batched(docs: DataFrame, size: int, order: str = "doc_pos", key: str = "doc_id", buckets: int = 200) -> DataFrame:
    """(at, batch): (order, key) of every document and the number of its batch of ``size`` documents in order."""
    return numbered(docs, order, key, buckets).select("at", F.floor(F.col("place") / size).alias("batch"))


def batch_bounds(docs: DataFrame, size: int, order: str = "doc_pos", key: str = "doc_id", buckets: int = 200) -> DataFrame:
    """(batch, docs, lo, hi): the first and the last (order, key) of every batch of ``batched``."""
    return batched(docs, size, order, key, buckets).groupBy("batch").agg(F.count(F.lit(1)).alias("docs"), F.min("at").alias("lo"), F.max("at").alias("hi"))


def in_batch(docs: DataFrame, lo, hi, order: str = "doc_pos", key: str = "doc_id") -> DataFrame:
    """The documents between two bounds; the plain comparison of the order reaches the scan, where statistics skip row groups."""
    at = F.struct(F.col(order).alias("o"), F.col(key).alias("k"))
    first, last = (F.struct(F.lit(b["o"]).alias("o"), F.lit(b["k"]).alias("k")) for b in (lo, hi))
    return docs.where(F.col(order).between(lo["o"], hi["o"]) & (at >= first) & (at <= last))


def _in_order(docs: DataFrame, size: int, order: str) -> Iterator[tuple[DataFrame, int]]:
    """(documents, how many) of each batch; the next bounds are read only when asked for."""
    bounds = written(batch_bounds(docs, size, order), "batches")
    for i in range(bounds.count()):
        row = bounds.where(F.col("batch") == i).first()
        yield in_batch(docs, row["lo"], row["hi"], order), row["docs"]


def with_halving(items: list, process: Callable[[list], list], single: Callable[[object], object]) -> list:
    """process(items); a batch that fails is cut in two, a single item that fails goes to ``single``."""
    if not items:
        return []
    try:
        return process(items)
    except Exception:  # noqa: BLE001 - a processor's own failure is what this recovers from
        if len(items) == 1:
            return [single(items[0])]
        half = len(items) // 2
        return with_halving(items[:half], process, single) + with_halving(items[half:], process, single)


def folded(current: Schema, seen: Schema) -> Schema:
    """The union, in order of appearance."""
    out = {t: list(a) for t, a in current.items()}
    for t, attributes in seen.items():
        out[t] = list(dict.fromkeys([*out.get(t, []), *attributes]))
    return out


def grown(current: Schema, ask: Callable[[Schema], Schema], tries: int = 10) -> Schema:
    """A processor's next schema, which may not lose features; after ``tries`` attempts the union with the last one."""
    answer = current
    for _ in range(tries):
        answer = ask(current)
        if features_of(current) <= features_of(answer):
            return answer
    return folded(current, answer)


def schema_of(cells: DataFrame) -> Schema:
    """Tables and attributes of long cells: one row per (table, attribute) reaches the driver."""
    rows = cells.select("table_id", "column_name").distinct().orderBy("table_id", "column_name").collect()
    out: Schema = {}
    for r in rows:
        out.setdefault(r["table_id"], []).append(r["column_name"])
    return out


def schema_rows(cells: DataFrame) -> DataFrame:
    """(table_id, attributes): the union of what was seen of each table, sorted."""
    return cells.groupBy("table_id").agg(F.sort_array(F.collect_set("column_name")).alias("attributes"))


def frequent_tables(assigned: DataFrame, more_than: int = 5) -> DataFrame:
    """Tables assigned in more than ``more_than`` documents."""
    return assigned.groupBy("table_id").agg(F.countDistinct("doc_id").alias("docs")).where(F.col("docs") > more_than)


@dataclass
class EntropyRule:
    """Stop once the last ``needed`` entropies are under ``limit``, ``least`` documents were read and an unseen feature is unlikely."""

    limit: float = 0.05
    needed: int = 3
    least: int = 10
    epsilon: float = 0.05
    delta: float = 0.05
    entropies: list[float] = field(default_factory=list)
    last: set[str] | None = None
    read: int = 0

    def see(self, now: set[str], docs: int) -> bool:
        self.entropies.append(entropy(now, self.last))
        self.last = now
        self.read += docs
        return entropy_stops(streak(self.entropies, self.limit), self.read, max(len(now), 1), self.needed, self.least, self.epsilon, self.delta)

    @property
    def documents_needed(self) -> int:
        return minimum_samples(len(self.last or ()), self.epsilon, self.delta)


@dataclass
class MissingMassRule:
    """Stop once the share of features seen in one document only, over documents, is under ``delta``."""

    delta: float = 0.05
    least: int = 10
    counts: Counter = field(default_factory=Counter)
    read: int = 0

    def see(self, counts: dict[str, int], docs: int) -> bool:
        self.counts.update(counts)
        self.read += docs
        return self.read >= self.least and self.missing_mass < self.delta

    @property
    def missing_mass(self) -> float:
        return sum(c == 1 for c in self.counts.values()) / self.read if self.read else 1.0


@dataclass
class Discovery:
    schema: Schema
    documents: int = 0
    batches: int = 0
    stopped: bool = False
    entropies: list[float] = field(default_factory=list)


def discover(docs: DataFrame, process: Callable[[DataFrame], DataFrame], rule: EntropyRule | None = None, size: int = 100, order: str = "doc_pos", features: Callable[[Schema], set[str]] = features_of) -> Discovery:
    """Read batches in order until the rule stops. process: documents -> cells (doc_id, table_id, column_name); features: what counts as a change."""
    rule = rule or EntropyRule()
    out = Discovery({})
    for batch, n in _in_order(docs, size, order):
        out.schema = folded(out.schema, schema_of(process(batch)))
        out.stopped = rule.see(features(out.schema), n)
        out.batches, out.documents, out.entropies = out.batches + 1, out.documents + n, rule.entropies
        if out.stopped:
            break
    return out


def discover_by_missing_mass(docs: DataFrame, process: Callable[[DataFrame], DataFrame], rule: MissingMassRule | None = None, size: int = 100, order: str = "doc_pos") -> Discovery:
    """As ``discover``, stopping by how often features were seen in documents."""
    rule = rule or MissingMassRule()
    out = Discovery({})
    for batch, n in _in_order(docs, size, order):
        found = process(batch).groupBy("table_id", "column_name").agg(F.countDistinct("doc_id").alias("n")).orderBy("table_id", "column_name").collect()  # one row per attribute
        for r in found:
            out.schema = folded(out.schema, {r["table_id"]: [r["column_name"]]})
        out.stopped = rule.see({f"{r['table_id']}.{r['column_name']}": r["n"] for r in found}, n)
        out.batches, out.documents = out.batches + 1, out.documents + n
        if out.stopped:
            break
    return out


def tailored(docs: DataFrame, schema: Schema, wanted: Callable[[Schema, DataFrame], Schema], rank: str, rule: EntropyRule | None = None, size: int = 20) -> Discovery:
    """A general schema fitted to one query: documents by rank, best first and unranked ones last, until the schema holds still."""
    ranked = docs.withColumn("_rank", F.coalesce(-F.col(rank).cast("double"), F.lit(float("inf"))))
    rule = rule or EntropyRule()
    out = Discovery(schema)
    for batch, n in _in_order(ranked, size, "_rank"):
        out.schema = wanted(out.schema, batch)
        out.stopped = rule.see(features_of(out.schema), n)
        out.batches, out.documents, out.entropies = out.batches + 1, out.documents + n, rule.entropies
        if out.stopped:
            break
    return out
