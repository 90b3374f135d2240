"""The order each result is shown in.

Analyses return unordered DataFrames (a global sort is a range-partitioned
shuffle, worth paying only when a result is displayed).  ``ordered``
applies the display order of a result, made total with its key columns so
paging is deterministic.  Results are small (aggregates) except the
extract and W1, whose order is a distributed range sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _orders() -> dict[str, tuple[Column, ...]]:
    # Fixed values that must equal the reference's display orders:
    #   extract: posting time descending, then fund
    #   liquidity metrics: entries + exits descending
    #   daily metrics: date descending, then fund (re-sorted date, fund ascending for charts)
    #   concentration: share descending
    #   operation summary: |net amount| descending
    #   balance evolution: posting time, then fund; evolution data: fund, then date
    fund, fonte = F.col("nmfundo").asc_nulls_first(), F.col("fonte").asc_nulls_first()
    return {
        "extract": (F.col("dt_lancamento").desc(), fund, F.col("id_origem")),
        "liquidity_metrics": ((F.col("total_entries") + F.col("total_exits")).desc(), fund, fonte),
        "daily_metrics": (F.col("date").desc(), fund, fonte),
        "daily_trends": (F.col("date").asc(), fund, fonte),
        "concentration": (F.col("concentration_pct").desc(), fund, fonte),
        "operation_summary": (F.abs(F.col("net_amount")).desc(), F.col("categoria")),
        "balance_evolution": (F.col("dt_lancamento"), fund, F.col("id_origem")),
        "balance_pct_change": (fund, F.col("date"), fonte),
    }


def ordered(name: str, df: DataFrame) -> DataFrame:
    """``df`` sorted in the display order of result ``name``."""
    return df.orderBy(*_orders()[name])


def page(name: str, df: DataFrame, size: int, number: int = 1) -> DataFrame:
    """The rows of one page of a result in its display order (O2, O5), pages counted from 1.

    A page needs a top-k of ``number * size`` rows, never a sort of the whole result.
    """
    top = ordered(name, df).limit(number * size)
    return top.offset((number - 1) * size) if number > 1 else top
