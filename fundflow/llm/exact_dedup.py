"""Exact deduplication against a persistent digest index (native: SQL functions only).

Two texts are equal when they are identical after every character of
``[\\x20\\x09-\\x0D]`` is deleted; the digest is the SHA-256 of that text.  The
index is a table with one row for each digest, bucketed and sorted by digest, so a
new batch finds what is already known by a sort-merge anti-join that does
not shuffle the index; the digests it brings are appended under the batch's
name.  Rows of the same batch are not "already known": a job that fails after
the append and runs again decides as it did the first time.  One writer at a
time; ``compact`` makes each bucket one sorted file again.

Only digests (never texts) are shuffled, and a batch is reduced to one row a
digest by a map-side combined aggregate before it meets the index, so a text
that a third of all rows share costs no task more than another.  Joining the
outcome to the rows is a plain equi-join, which adaptive execution splits
where one digest is hot.

Defined results: a null text counts as empty; all empty texts are equal.  Of
equal texts the row with the most code points in the original text stays,
then the smallest doc_id, null ids last; of fully repeated rows one stays.
An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fundflow.llm.rows import keyed_rows
from fundflow.session import scratch_path

WHITE_SPACE = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row_key: str | None = None) -> DataFrame:
    """(row_key, doc_id, digest, n_points) of every row, stored in the shared folder.

    ``row_key`` tells repeated rows apart; storing the rows fixes it for all
    later steps, also if an executor is lost.  It is made here unless a
    column of stored keys is named.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "digests")
    (docs.select((F.col(row_key) if row_key else F.monotonically_increasing_id()).alias("row_key"),
                 F.col(doc_id).cast("long").alias("doc_id"),
                 F.sha2(normalised(F.col(text)), 256).alias("digest"),
                 F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_points"))
     .write.parquet(path))
    return spark.read.parquet(path)


def survivors(rows: DataFrame) -> DataFrame:
    """One row for each digest: the row that stays and the number of equal rows."""
    # (fewest missing points, id, null ids last) as one number: a fixed-width key keeps the aggregate a hash aggregate
    order = F.expr("cast(2147483647 - n_points as decimal(10,0)) * 36893488147419103232BD"
                   " + coalesce(cast(doc_id as decimal(20,0)) + 9223372036854775808BD, 18446744073709551616BD)")
    return rows.groupBy("digest").agg(
        F.min_by("doc_id", order).alias("keep_id"),
        # of rows equal in both, any: the choice is stored before it is used
        F.min_by("row_key", order).alias("keep_key"), F.count("*").alias("group_size"))


class DigestIndex:
    """A table of known digests: (digest, keep_id, batch), bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table = spark, table
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(table):
            if spark.catalog.tableExists(self._compacted):  # a compaction that stopped between its last two steps
                spark.sql(f"ALTER TABLE {self._compacted} RENAME TO {table}")
            else:
                self._write(spark.createDataFrame([], "digest string, keep_id long, batch string"), table)

    @classmethod
    def fresh(cls, spark: SparkSession) -> "DigestIndex":
        return cls(spark, f"digest_index_{uuid.uuid4().hex}")

    @property
    def _compacted(self) -> str:
        return f"{self.table}__compacted"

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def earlier(self, batch: str) -> DataFrame:
        """What other batches have brought."""
        return self.read().filter(F.col("batch") != batch).select("digest", F.col("keep_id").alias("old_id"))

    def unknown(self, rows: DataFrame, batch: str) -> DataFrame:
        """Rows (one a digest) whose digest no other batch has brought."""
        return rows.join(self.earlier(batch).select("digest").hint("merge"), "digest", "left_anti")

    def append(self, rows: DataFrame, batch: str) -> None:
        """Add rows (one a digest, none known) under the batch's name; those it has there already stay as they are."""
        there = self.read().filter(F.col("batch") == batch).select("digest")
        new = rows.select("digest", "keep_id").join(there.hint("merge"), "digest", "left_anti")
        self._write(new.withColumn("batch", F.lit(batch)), self.table)

    def compact(self) -> None:
        """One sorted file a bucket.  Stopped at any point, the table is whole under one of two names."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._compacted}")
        self._write(self.read(), self._compacted)
        self.spark.sql(f"DROP TABLE {self.table}")
        self.spark.sql(f"ALTER TABLE {self._compacted} RENAME TO {self.table}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def _write(self, rows: DataFrame, table: str) -> None:
        # the digest as an expression: for rows of a bucketed table Spark would leave out a shuffle by the column
        (rows.repartition(self.buckets, F.substring("digest", 1, 64)).write.format("parquet").mode("append")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(table))


def batch_name(rows: DataFrame) -> str:
    """A name that the same digest rows always have: their number and two sums of hashes."""
    one = F.xxhash64("doc_id", "digest", "n_points")
    n, a, b = rows.agg(F.count("*"), F.sum(one.cast("decimal(20,0)")),
                       F.sum(F.xxhash64(F.lit(1), one).cast("decimal(20,0)"))).first()
    return f"{n}:{a}:{b}"


def dedup_batch(index: DigestIndex, rows: DataFrame, batch: str | None = None) -> DataFrame:
    """Deduplicate digest rows among themselves and against the index; then add them to it.

    ``rows`` come from ``digests``.  ``batch`` names them in the index; by
    default the name follows from the rows, so the same rows are the same
    batch.  Returns a row for each of them: row_key, doc_id, digest, keep_id
    (of the row that stays, perhaps one of an earlier batch), group_size
    (within this batch) and kept.
    """
    batch = batch or batch_name(rows)
    best = survivors(rows)
    known = (best.join(index.earlier(batch).hint("merge"), "digest")
             .select("digest", F.col("old_id").alias("keep_id"),
                     F.lit(None).cast("long").alias("keep_key"), "group_size"))
    # stored: every later step, also the append of a second run, works on one set of decisions
    path = scratch_path(index.spark, "batch-digests")
    index.unknown(best, batch).unionByName(known).write.parquet(path)
    decided = index.spark.read.parquet(path)
    index.append(decided.filter("keep_key is not null"), batch)
    return (rows.join(decided, "digest")
            .select("row_key", "doc_id", "digest", "keep_id", "group_size",
                    F.coalesce(F.col("row_key") == F.col("keep_key"), F.lit(False)).alias("kept")))


def _decided(spark: SparkSession, rows: DataFrame, index: DigestIndex | None, batch: str | None) -> DataFrame:
    """``dedup_batch``; without an index against an empty one, which goes when the decisions are stored."""
    used = index or DigestIndex.fresh(spark)
    out = dedup_batch(used, rows, batch)
    if index is None:
        used.drop()
    return out


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _decided(docs.sparkSession, digests(docs, doc_id, text), index, batch).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def kept_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
              index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    ``docs`` is read once: digests and kept rows both come from the stored rows.
    """
    keyed = keyed_rows(docs, "exact-dedup-rows")
    keys = (_decided(docs.sparkSession, digests(keyed, f"row.{doc_id}", f"row.{text}", "row_key"), index, batch)
            .filter("kept").select("row_key"))
    return keyed.join(keys, "row_key", "left_semi").select("row.*")
