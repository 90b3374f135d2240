"""Every ledger line with its fund's previous balance, whatever the skew.

``previous_balance = LAG(saldo) OVER (PARTITION BY nmfundo ORDER BY
dt_lancamento, id_origem)`` -- the partition spans custodians.

A window by fund would sort a fund's whole history in one task.  Here the lines
are range-partitioned on the whole order (fund, posting time, id), so a hot
fund, a day of date-only postings and sparse ids spread alike.  One scan takes
each sorted partition in Arrow batches and shifts the balances; what it cannot
know, the balance before its first line, is the last one of the partition
before.  The scan's output is stored under the shared checkpoint folder with
one more row a partition, its last fund and balance, and these rows carry over
by a join on the partition's number.

Range bounds come from a sample, so two runs of the exchange could cut
differently; all later steps read the one stored outcome, which stays the same
if tasks or executors are lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from fundflow.functions.money import flow, saldo
from fundflow.session import scratch_path

#: What a stored row is: a line, the first line of its partition, the partition's last state.
LINE, FIRST, LAST = 0, 1, 2


def _shifted(column: pa.Array, before: pa.Scalar) -> pa.Array:
    """The column one row down, ``before`` on top."""
    return pa.concat_arrays([pa.array([before.as_py()], column.type), column.slice(0, len(column) - 1)])


def _lagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition's lines with the balance before each of its fund's lines, and its last state."""
    part, fund, balance, schema = TaskContext.get().partitionId(), None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        funds, balances = batch.column("nmfundo"), batch.column("balance")
        n = batch.num_rows
        kind = [LINE] * n
        if fund is None:
            fund, balance, schema = pa.scalar(None, funds.type), pa.scalar(None, balances.type), batch.schema
            kind[0] = FIRST
        above = _shifted(funds, fund)
        same = pc.or_(pc.fill_null(pc.equal(funds, above), False), pc.and_(pc.is_null(funds), pc.is_null(above)))
        previous = pc.if_else(same, _shifted(balances, balance), pa.scalar(None, balances.type))
        fund, balance = funds[n - 1], balances[n - 1]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, previous, pa.array(kind, pa.int32()), pa.array([part] * n, pa.int32())],
            names=[*batch.schema.names, "previous_balance", "_kind", "_part"])
    if schema is not None:
        state = {"nmfundo": fund.as_py(), "balance": balance.as_py()}
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([state.get(f.name)], f.type) for f in schema), pa.nulls(1, schema.field("balance").type),
             pa.array([LAST], pa.int32()), pa.array([part], pa.int32())],
            names=[*schema.names, "previous_balance", "_kind", "_part"])


def balance_evolution(lf: DataFrame, partitions: int | None = None) -> DataFrame:
    """Date, nmfundo, fonte, daily_change, balance, previous_balance, dt_lancamento, id_origem of every line.

    ``partitions`` is the number of ranges, by default the session's shuffle
    partitions (``session.scale_conf``); any number gives the same result.
    """
    spark = lf.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = lf.select("nmfundo", "fonte", "id_origem", "dt_lancamento",
                      flow().alias("daily_change"), saldo().alias("balance"))
    order = (F.col("nmfundo").asc_nulls_first(), F.col("dt_lancamento").asc_nulls_first(),
             F.col("id_origem").asc_nulls_first())
    # equal keys would share a task: lines of one id differ in what they say
    spread = F.xxhash64("fonte", "daily_change", "balance").alias("_spread")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in lines.schema.fields] + [
        T.StructField("previous_balance", lines.schema["balance"].dataType),
        T.StructField("_kind", T.IntegerType()), T.StructField("_part", T.IntegerType())])
    path = scratch_path(spark, "balance-evolution")
    (lines.select("*", spread).repartitionByRange(n, *order, F.col("_spread"))
     .sortWithinPartitions(*order, F.col("_spread")).drop("_spread")
     .mapInArrow(_lagged, schema).write.parquet(path))
    stored = spark.read.schema(schema).parquet(path)

    ends = stored.filter(F.col("_kind") == LAST)
    held = sorted(r["_part"] for r in ends.select("_part").collect())  # one number a range
    following = spark.createDataFrame(list(zip(held, held[1:])), "_part int, _next int")
    carry = ends.join(following, "_part").select(
        F.col("_next").alias("_part"), F.lit(FIRST).alias("_kind"), F.col("nmfundo").alias("_fund"),
        F.col("balance").alias("_carried"))
    carried = F.when(F.col("nmfundo").eqNullSafe(F.col("_fund")), F.col("_carried"))
    return (stored.filter(F.col("_kind") != LAST)
            .join(F.broadcast(carry), ["_part", "_kind"], "left")  # at most a row a range
            .select(F.to_date("dt_lancamento").alias("date"), "nmfundo", "fonte", "daily_change", "balance",
                    F.coalesce("previous_balance", carried).alias("previous_balance"),
                    "dt_lancamento", "id_origem"))
