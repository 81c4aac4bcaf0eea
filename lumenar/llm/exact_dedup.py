"""Exact deduplication over a log-structured merge index (DataFrame functions only).

Ingest: every scan task is a memtable. Its (digest -> smallest id, largest id, copies)
entries are flushed as a run sorted by digest, written with Parquet bloom filters on
the digest. Compaction merges ``fan_in`` runs at a time until one level is left and
keeps the smallest and the largest identifier of each digest; a merge of sorted runs is, in
DataFrame terms, an aggregation by digest. A bitmap of the digests that occur more than
once (the hit filter, of a bounded size) lets a second scan fetch the texts of possible hits
only; each of them is compared byte for byte with the text of its group's keeper. The bloom
filters of the runs serve ``lookup``. Entries of hot digests are broadcast to their rows. Rows of one digest with different bytes are grouped anew by
(digest, text), so results stay exact even if the digest collides.

Defined results: null text counts as empty, so all null and empty texts are one group;
texts are equal when identical after lower-casing ASCII letters only; rows that repeat
both doc_id and text count as separate copies, of which one row is kept; a null doc_id
loses against any other id; an empty table gives an empty result; further columns of the
input, whatever their names, are ignored by ``dedup_report`` and carried through by ``drop_copies``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenar.llm.bitmaps import marked_members, maybe_members
from lumenar.llm.hot_keys import join_facts
from lumenar.storage import Scratch, remove, table, written, written_at

FAN_IN = 64
#: Copies of one text that meet in a task for their comparison; larger groups are dealt over more.
ROWS_A_SALT = 256


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    folded = docs.select(F.col(id_col).alias("doc_id"), fold_ascii(F.col(text_col)).alias("folded"))
    return folded.select(
        "doc_id",
        F.unhex(F.sha2(F.col("folded").cast("binary"), 256)).alias("digest"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def _flush(entries: DataFrame, level: int) -> tuple[DataFrame, str]:
    """Write runs sorted by digest; the shuffle of the preceding aggregation already co-locates each run's digests."""
    return written_at(entries.sortWithinPartitions("run", "digest"), f"lsm-level{level}", **{"parquet.bloom.filter.enabled#digest": "true"})


def build_index(digests: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """digest -> (first, last, copies): flushed runs, compacted level by level. first and last hold doc_id and row_no."""
    spark = digests.sparkSession
    row = F.struct("doc_id", "row_no")
    low = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")  # nulls sort first
    runs, path = _flush(digests.groupBy("run", "digest").agg(F.min(low).alias("first"), F.max(row).alias("last"), F.count(F.lit(1)).alias("copies")), 0)
    most = runs.agg(F.max("run")).first()[0] or 0
    level = 0
    while True:
        level, most, older = level + 1, most // fan_in, path
        merged = (
            runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy("run", "digest")
            .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("copies").alias("copies"))
        )
        runs, path = _flush(merged, level)
        remove(spark, older)
        if most == 0:
            return runs.drop("run")


def lookup(index: DataFrame, digest: bytes) -> DataFrame:
    """One digest's entry: pushed to the scan, where min/max statistics and bloom filters skip row groups."""
    return index.where(F.col("digest") == F.lit(bytearray(digest)))


def _possible_hits(docs: DataFrame, index: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, folded) of rows whose digest passes the hit filter."""
    scan = docs.select(F.col(id_col).alias("doc_id"), fold_ascii(F.col(text_col)).alias("folded"))
    scan = scan.withColumn("digest", F.unhex(F.sha2(F.col("folded").cast("binary"), 256)))
    return maybe_members(scan, "digest", index.where("copies > 1"), "digest")


def _collisions(docs: DataFrame, index: DataFrame, total: int, id_col: str, text_col: str, largest: bool, scratch: Scratch) -> DataFrame:
    """Byte verification: rows whose bytes differ from those of their group's keeper (none, unless SHA-256 collides)."""
    keeper = F.col("last.doc_id") if largest else F.col("first.doc_id")
    shared = index.where("copies > 1").select("digest", keeper.alias("keep_id"), "copies")
    possible = _possible_hits(docs, index, id_col, text_col)
    hits = scratch.written(join_facts(possible, shared, "digest", "copies", total), "hits")  # read twice: one scan of the texts
    hits = hits.withColumn("salts", F.ceil(F.col("copies") / ROWS_A_SALT).cast("int"))
    hits = hits.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("salts")).cast("int"))
    kept = hits.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("folded").alias("kept_text"), F.first("salts").alias("salts"))
    kept = kept.select("digest", "kept_text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return hits.join(kept, ["digest", "salt"]).where(F.col("folded") != F.col("kept_text")).select("digest").distinct()


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. keep: ``smallest`` or ``largest`` doc_id."""
    largest = keep == "largest"
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    digests = written(_digests(docs, id_col, text_col), "digests")
    total = digests.count()
    index = build_index(digests, fan_in)
    side = "last" if largest else "first"
    entries = index.select("digest", F.col(side).alias("keeper"), "copies")
    rows = join_facts(digests.select("doc_id", "row_no", "digest"), entries, "digest", "copies", total)
    scratch = Scratch(docs.sparkSession)
    clashes = written(_collisions(docs, index, total, id_col, text_col, largest, scratch), "clashes")
    scratch.clear()
    if clashes.isEmpty():
        return rows.select(
            "doc_id",
            F.col("keeper.doc_id").alias("keep_id"),
            F.col("copies").alias("group_size"),
            (F.col("keeper.row_no") == F.col("row_no")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    return _regrouped(docs, rows, clashes, id_col, text_col, largest)


def _regrouped(docs: DataFrame, rows: DataFrame, clashes: DataFrame, id_col: str, text_col: str, largest: bool) -> DataFrame:
    """The report where digests collide: rows of those digests are grouped by their whole text."""
    plain = rows.join(clashes, "digest", "left_anti").select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("copies").alias("group_size"), (F.col("keeper.row_no") == F.col("row_no")).alias("kept"), "digest"
    )
    text = docs.select(F.col(id_col).alias("doc_id"), fold_ascii(F.col(text_col)).alias("folded"))
    text = text.withColumn("digest", F.unhex(F.sha2(F.col("folded").cast("binary"), 256))).withColumn("row_no", F.monotonically_increasing_id())
    text = written(text.join(clashes, "digest", "left_semi"), "clashing")
    low = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")
    pick = (F.max(F.struct("doc_id", "row_no")) if largest else F.min(low)).alias("keeper")
    groups = text.groupBy("digest", "folded").agg(pick, F.count(F.lit(1)).alias("copies"))
    split = text.join(groups, ["digest", "folded"]).select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("copies").alias("group_size"), (F.col("keeper.row_no") == F.col("row_no")).alias("kept"), "digest"
    )
    return plain.unionByName(split).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows that stay, with all their columns. Of rows that repeat the kept doc_id and text, one stays.

    Only rows whose id may be that of a row that goes are shuffled; the others pass as they are scanned.
    """
    report = written(dedup_report(docs, id_col, text_col, keep), "copies")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), "text_sha256")
    touched = report.groupBy(key.alias("_key"), F.col("doc_id").alias("_id")).agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_rows")).where("not (_kept and _rows = 1)")
    touched = written(touched, "copies-gone")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    row_id = F.col("_row")[id_col]
    held = marked_members(held, row_id, touched.select("_id").distinct(), "_id", "_maybe")
    sure = held.where("not _maybe").select("_row.*")
    sha = F.sha2(fold_ascii(F.col("_row")[text_col]).cast("binary"), 256)
    maybe = held.where("_maybe").select("_row", F.concat_ws(":", F.coalesce(row_id.cast("string"), F.lit("~")), sha).alias("_key"))
    judged = join_facts(maybe, touched.drop("_id"), "_key", "_rows", report.count(), "left")
    stay = judged.where("_kept is null").select("_row.*")
    one = judged.where("_kept").dropDuplicates(["_key"]).select("_row.*")
    return sure.unionByName(stay).unionByName(one)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"), keep="largest")


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(folded) AS text_sha256
FROM d WINDOW g AS (PARTITION BY folded)
"""
