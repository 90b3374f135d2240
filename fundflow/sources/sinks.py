"""Result sinks (S4): batch writes of result tables.

Writes are whole-DataFrame jobs; a lost executor only re-runs its tasks.
Intermediates that several jobs reuse are materialised under the shared
``spark.checkpoint.dir`` (never a machine-local folder, never
``localCheckpoint``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from fundflow.session import scratch_path
from fundflow.sources.contract import PARTITION_COLUMN


def write_result(df: DataFrame, path: str, mode: str = "overwrite",
                 partition_by: tuple[str, ...] | list[str] = (), fmt: str = "parquet",
                 cluster: bool = True, **options) -> str:
    """Write ``df``; with ``partition_by`` the rows are first clustered on the
    partition columns, so that a value goes to few files; adaptive execution
    splits a value that holds a large share of the rows."""
    if partition_by and cluster:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).format(fmt).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


#: Lines by partition, fund and custodian, kept with a stored ledger; hidden from its readers by the underscore.
SUMMARY = "_summary"


def write_ledger(ledger: DataFrame, path: str, granularity: str = "month", num_files: int | None = None,
                 mode: str = "overwrite", row_group_bytes: int | None = None) -> str:
    """Store a ledger for fast period / fund queries.

    * partitioned by ``dt_part`` (``yyyy-MM`` or ``yyyy-MM-dd``), so a period
      filter prunes whole directories;
    * range-partitioned on posting time and line id (Spark samples the
      keys), so every write task gets an even slice whatever the fund skew or
      the number of lines of one date-only posting time, and touches only a
      few partition directories;
    * clustered by fund and custodian inside each file, so row-group statistics
      and dictionaries (Bloom filters where a row group has too many names for
      one) let F2 and F3 skip most row groups; ``row_group_bytes`` sets their size;
    * with a summary beside it (``read_summary``): the number of lines by
      partition, fund and custodian.  Pickers (F4-F6) and the newest-N cutoff (O1)
      read it instead of lines.  It is written after the lines it counts: stopped in
      between, it counts too few, never too many.
    """
    fmt = {"month": "yyyy-MM", "day": "yyyy-MM-dd"}[granularity]
    n = num_files or int(ledger.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = ledger.withColumn(PARTITION_COLUMN, F.date_format("dt_lancamento", fmt))
    writer = (out.repartitionByRange(n, "dt_lancamento", "id_origem")
              .sortWithinPartitions(PARTITION_COLUMN, "nmfundo", "fonte", "dt_lancamento")
              .write.mode(mode).partitionBy(PARTITION_COLUMN)
              .option("parquet.bloom.filter.enabled#nmfundo", "true")
              .option("parquet.bloom.filter.enabled#fonte", "true"))
    if row_group_bytes:
        writer = writer.option("parquet.block.size", str(row_group_bytes))
    writer.parquet(path)
    # whole ledgers are counted from the stored columns, appended lines as they came
    lines = ledger.sparkSession.read.parquet(path) if mode == "overwrite" else out
    (lines.withColumn(PARTITION_COLUMN, F.col(PARTITION_COLUMN).cast("string"))
     .groupBy(PARTITION_COLUMN, "nmfundo", "fonte").agg(F.count(F.lit(1)).alias("n"))
     .write.mode(mode).parquet(os.path.join(path, SUMMARY)))
    return path


def write_result_table(df: DataFrame, name: str, mode: str = "overwrite",
                       partition_by: tuple[str, ...] | list[str] = ()) -> str:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)
    return name


def write_result_jdbc(df: DataFrame, url: str, table: str, mode: str = "append",
                      batch_size: int = 10000, **properties) -> str:
    (df.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table)
     .option("batchsize", str(batch_size)).options(**properties).save())
    return table


def materialise(spark: SparkSession, df: DataFrame, name: str,
                partition_by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Write ``df`` to a fresh folder under the shared checkpoint dir and read it back."""
    path = write_result(df, scratch_path(spark, name), partition_by=partition_by)
    return spark.read.parquet(path)
