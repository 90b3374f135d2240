"""Ledger sources (S1): parquet / any file format, catalog table, JDBC.

All readers end in ``contract.normalise`` so downstream operators see one
schema.  Filters applied later (period, funds, custodians) are pushed into
the scan by Catalyst: parquet gets ``PushedFilters`` and, when the table is
partitioned by a date column, partition pruning; JDBC gets a WHERE clause.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from fundflow.params import FilterParams
from fundflow.sources.contract import PARTITION_COLUMN, normalise
from fundflow.sources.sinks import SUMMARY


def read_ledger(spark: SparkSession, path: str, fmt: str = "parquet",
                rename: dict[str, str] | None = None,
                period: tuple[dt.date, dt.date] | None = None, **options) -> DataFrame:
    """Read a ledger stored as files (parquet by default).

    For a ledger written by ``sinks.write_ledger`` (partitioned by
    ``dt_part``), ``period=(start, end)`` prunes whole partitions before any
    file is opened; the exact period filter (F1) is still applied later.
    """
    raw = spark.read.format(fmt).options(**options).load(path)
    if period is not None and PARTITION_COLUMN in raw.columns:
        raw = raw.filter(partition_filter(raw, *period))
    return normalise(raw, rename)


def partition_filter(raw: DataFrame, start: dt.date, end: dt.date) -> F.Column:
    """Partition-key range covering calendar dates ``start..end``.

    Keys are ``yyyy-MM`` (monthly layout) or ``yyyy-MM-dd`` (daily); both
    sort as text, and a month key sorts just before its own days.
    """
    part = F.col(PARTITION_COLUMN).cast("string")
    lower = (part >= F.lit(start.strftime("%Y-%m-%d"))) | (part == F.lit(start.strftime("%Y-%m")))
    return lower & (part <= F.lit(end.strftime("%Y-%m-%d")))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """(dt_part, nmfundo, fonte, n) of a ledger written by ``sinks.write_ledger``; a key may have several rows.

    F4-F6 (``filters.available_funds`` and the others) take it in place of the
    ledger: it holds the same names and no lines.
    """
    return spark.read.parquet(os.path.join(path, SUMMARY))


def _days(part: str) -> tuple[dt.date, dt.date]:
    """First and last date of a partition key."""
    if len(part) > 7:
        return dt.date.fromisoformat(part), dt.date.fromisoformat(part)
    first = dt.date.fromisoformat(f"{part}-01")
    return first, (first + dt.timedelta(days=31)).replace(day=1) - dt.timedelta(days=1)


def newest_partition(spark: SparkSession, path: str, p: FilterParams) -> str | None:
    """The oldest partition that can hold one of the newest ``p.limit`` lines of the filters (O1).

    Counts come from the summary; partitions that the period covers in part
    count as empty, so the cutoff is never too late.  None where the summary
    gives no cutoff.  The list on the driver has an entry for each partition.
    """
    if not p.limit or p.end_date < p.start_date:
        return None
    rows = read_summary(spark, path)
    rows = rows.filter(F.col("nmfundo").isin(*p.funds)) if p.funds else rows
    rows = rows.filter(F.col("fonte").isin(*p.custodians)) if p.custodians else rows
    counts = rows.filter(F.col(PARTITION_COLUMN).isNotNull()).groupBy(PARTITION_COLUMN).agg(F.sum("n").alias("n"))
    found = 0
    for row in sorted(counts.collect(), key=lambda r: r[PARTITION_COLUMN], reverse=True):
        first, last = _days(row[PARTITION_COLUMN])
        if p.start_date <= first and last <= p.end_date:
            found += row["n"]
            if found >= p.limit:
                return row[PARTITION_COLUMN]
    return None


def read_newest(spark: SparkSession, path: str, p: FilterParams, rename: dict[str, str] | None = None) -> DataFrame:
    """The part of a stored ledger that holds the newest ``p.limit`` lines of the filters: its last partitions.

    The cutoff is a plain partition filter, so older partitions are not even
    listed for reading.  Filters and the exact newest-N follow
    (``extract.extract``).
    """
    raw = spark.read.parquet(path)
    raw = raw.filter(partition_filter(raw, p.start_date, p.end_date))
    cutoff = newest_partition(spark, path, p)
    if cutoff is not None:
        raw = raw.filter(F.col(PARTITION_COLUMN).cast("string") >= cutoff)
    return normalise(raw, rename)


def read_ledger_table(spark: SparkSession, name: str,
                      rename: dict[str, str] | None = None) -> DataFrame:
    """Read a ledger registered in the catalog (table or view)."""
    return normalise(spark.table(name), rename)


def read_ledger_jdbc(spark: SparkSession, url: str, table: str, *,
                     lower: dt.date, upper: dt.date, num_partitions: int = 64,
                     partition_column: str = "dt_lancamento",
                     rename: dict[str, str] | None = None,
                     properties: dict[str, str] | None = None) -> DataFrame:
    """Read the statement view over JDBC as ``num_partitions`` parallel range scans.

    Without ``partitionColumn`` and bounds a JDBC read is a single task, so
    the bounds are mandatory here.  Bounds only split the ranges; rows
    outside them are still read (by the first and last partitions).
    """
    reader = (spark.read.format("jdbc")
              .option("url", url)
              .option("dbtable", table)
              .option("partitionColumn", partition_column)
              .option("lowerBound", str(lower))
              .option("upperBound", str(upper))
              .option("numPartitions", str(num_partitions))
              .option("fetchsize", "10000"))
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    return normalise(reader.load(), rename)
