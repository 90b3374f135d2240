"""Per-fund status operators derived from A1 / A3 results.

C5 (liquidity status), W4 (the reference keys its metrics by fund while
the results have one row per fund and custodian, so the *last* row of
each fund in result order survives), C5b (chart ratio), C5c (fund
concentration metric), A19 and A20 (overall stats).  Inputs are
aggregates with one row per (fund, custodian), so these are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fundflow.functions import classify as C
from fundflow.functions.money import ratio, ratio_or_inf
from fundflow.operators.evolution import last_per_fund
from fundflow.params import Thresholds


def liquidity_status(a1: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """C5 at (fund, custodian) grain: ratio = entries / |exits| (+inf when no exits)."""
    r = ratio_or_inf(F.col("total_entries"), F.abs(F.col("total_exits")))
    return a1.withColumns({
        "liquidity_ratio": r,
        "status": C.liquidity_status(r, t),
        "severity": C.liquidity_severity(r, t),
    })


def liquidity_status_by_fund(status: DataFrame) -> DataFrame:
    """W4 over C5: A1 is ordered by entries + exits descending, so the
    fund's smallest-volume custodian is the row that survives."""
    total = F.col("total_entries") + F.col("total_exits")
    return last_per_fund(status, total.asc(), F.col("fonte").desc_nulls_last())


def liquidity_chart(a1: DataFrame) -> DataFrame:
    """The chart's ratio -- infinite ratios shown as 0, 0/0 stays NULL."""
    e, x = F.col("total_entries"), F.abs(F.col("total_exits"))
    r = (F.when(x == 0, F.when(e == 0, F.lit(None).cast("double")).otherwise(F.lit(0.0)))
         .otherwise(ratio(e, x)))
    return a1.select("nmfundo", "fonte", "operation_count", "total_entries", "total_exits",
                     r.alias("liquidity_ratio"))


def liquidity_stats(a1: DataFrame) -> DataFrame:
    """Row count of A1 ("total_funds") and sum(entries) / |sum(exits)| or 0."""
    e, x = F.sum("total_entries"), F.abs(F.sum("total_exits"))
    return a1.agg(
        F.count(F.lit(1)).alias("total_funds"),
        F.coalesce(F.when(x != 0, ratio(e, x)), F.lit(0.0)).alias("avg_liquidity_ratio"))


def concentration_metrics(a3: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """C5c + W4: funds whose (rounded) share exceeds 20%; within a fund the
    row kept is the last in A3 order (share descending), i.e. the smallest."""
    pct = F.col("concentration_pct")
    hot = a3.filter(pct > t.concentration_watch).withColumns({
        "status": F.col("concentration_level"),
        "severity": F.when(pct > t.concentration_threshold, C.CRITICAL).otherwise(C.WARNING),
    })
    return last_per_fund(hot, pct.asc(), F.col("fonte").desc_nulls_last())


def concentration_overall(a3: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Maximum share, rows above the threshold, row count, status, severity."""
    mx = F.max("concentration_pct")
    high = mx > t.concentration_threshold
    return a3.agg(
        F.coalesce(mx, F.lit(0.0)).alias("max_concentration"),
        F.count_if(F.col("concentration_pct") > t.concentration_threshold)
        .alias("funds_above_threshold"),
        F.count(F.lit(1)).alias("total_funds"),
        F.when(high, C.HIGH).otherwise("Normal").alias("status"),
        F.when(high, C.WARNING).otherwise(C.INFO).alias("severity"))

