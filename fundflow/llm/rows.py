"""Rows with stored keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fundflow.session import scratch_path


def keyed_rows(docs: DataFrame, name: str) -> DataFrame:
    """(row_key, row): every row of ``docs`` as a struct with a unique key, written once and read from there.

    A key assigned while reading holds for that read only: splits, and so the
    numbers, can differ on the next.  The written key names the same row on
    every read, also if an executor is lost or joins.
    """
    path = scratch_path(docs.sparkSession, name)
    (docs.select(F.monotonically_increasing_id().alias("row_key"), F.struct("*").alias("row"))
     .write.parquet(path))
    return docs.sparkSession.read.parquet(path)
