"""Balance evolution: running flow (W2), its percent change (W3), the
per-fund evolution metrics (A21, C8), their stats (A22), the last-row-per-
fund picks (W4) and the multi-horizon evolution (X3).

Windows here run over *daily aggregates* (one row per date x fund x
custodian), never over raw lines, so a fund's window partition is bounded
by its calendar span times its custodians.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from fundflow.functions import classify as C
from fundflow.functions.money import dbl, rnd
from fundflow.operators.filters import apply_filters
from fundflow.operators.flows import daily_metrics
from fundflow.params import EVOLUTION_HORIZONS, FilterParams, Thresholds

PCT_DIGITS = 6


def with_pct_change(daily: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """W2 + W3 over A2 rows.

    ``cumulative_flow``: running sum of ``daily_net_flow`` per fund in
    (date, custodian) order, a ROWS frame spanning custodians.
    ``pct_change``: ``(c / previous c - 1) * 100``; the first row, a zero
    previous value (infinite ratio) and 0/0 give 0.  Rows of the NULL fund
    get a NULL running flow and 0 change (they form no group).
    """
    order = Window.partitionBy(*keys, "nmfundo").orderBy(
        "date", F.col("fonte").asc_nulls_first())
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.col("nmfundo").isNotNull()
    cum = F.sum("daily_net_flow").over(running)
    out = daily.withColumn("cumulative_flow", F.when(known, cum))
    prev = F.lag("cumulative_flow").over(order)
    change = (F.try_divide(dbl(F.col("cumulative_flow")), dbl(prev)) - 1) * 100
    return out.withColumn("pct_change",
                          F.when(known, F.coalesce(change, F.lit(0.0))).otherwise(F.lit(0.0)))


def balance_pct_change(lf: DataFrame) -> DataFrame:
    return with_pct_change(daily_metrics(lf))


def evolution_metrics(evo: DataFrame, t: Thresholds = Thresholds(),
                      keys: tuple[str, ...] = ()) -> DataFrame:
    """A21 (+C8): per fund with more than one daily row."""
    g = (evo.filter(F.col("nmfundo").isNotNull())
         .groupBy(*keys, "nmfundo").agg(
             F.sum("pct_change").alias("_total"),
             F.stddev_samp("pct_change").alias("_std"),
             F.count(F.lit(1)).alias("periods"))
         .filter(F.col("periods") > 1))
    total = F.col("_total")
    return g.select(
        *keys, "nmfundo",
        rnd(total, PCT_DIGITS).alias("total_variation"),
        rnd(F.col("_std"), PCT_DIGITS).alias("volatility"),
        "periods",
        C.trend(total).alias("trend"),
        F.when(F.abs(total) > t.evolution_variation, C.WARNING).otherwise(C.INFO).alias("severity"))


def evolution_stats(evo: DataFrame) -> DataFrame:
    """Distinct dates and distinct funds, the NULL fund counting as one."""
    return evo.agg(
        F.countDistinct("date").alias("total_periods"),
        (F.countDistinct("nmfundo")
         + F.coalesce(F.max(F.col("nmfundo").isNull().cast("int")), F.lit(0)))
        .cast("long").alias("funds_analyzed"))


def evolution_by_horizon(ledger: DataFrame, p: FilterParams, as_of: dt.date,
                         horizons: dict[str, int] = EVOLUTION_HORIZONS,
                         t: Thresholds = Thresholds()) -> DataFrame:
    """A21 for each horizon ``as_of - n .. as_of``.

    The ledger is scanned and aggregated to days once for the widest
    horizon; each daily row is then tagged with every horizon containing
    it, and one window pass runs per (horizon, fund).
    """
    widest = max(horizons.values())
    lf = apply_filters(ledger, p.with_range(as_of - dt.timedelta(days=widest), as_of))
    daily = daily_metrics(lf)
    tags = F.array(*[
        F.when(F.col("date") >= F.lit(as_of - dt.timedelta(days=n)),
               F.struct(F.lit(name).alias("horizon"), F.lit(n).alias("horizon_days")))
        for name, n in horizons.items()])
    tagged = (daily.withColumn("_h", F.explode(F.array_compact(tags)))
              .select("_h.horizon", "_h.horizon_days", *daily.columns))
    evo = with_pct_change(tagged, keys=("horizon", "horizon_days"))
    return evolution_metrics(evo, t, keys=("horizon", "horizon_days"))


def last_per_fund(df: DataFrame, *order: F.Column) -> DataFrame:
    """The row a dict keyed by fund would keep (the last one in input order).

    ``order`` is the *reverse* of the input order, so the kept row is the first.
    Groups are one fund's custodians -- small.
    """
    w = Window.partitionBy("nmfundo").orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
