"""Extract-page breakdowns: A16 (credit / debit totals), A17 (by category),
A18 (by custodian) and O3 (top-10 concentration rows).  They read the
enriched extract; each is one aggregation (tiny shuffle after map-side
combining) or a bounded top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fundflow.functions import classify as C
from fundflow.functions.formatting import currency_br, percent_br

TOP_CONCENTRATION = 10


def extract_metrics(en: DataFrame) -> DataFrame:
    """Credits, |debits|, final balance and the line counts behind them."""
    kind, v = F.col("tipo_lancamento"), F.col("valor")
    zero = F.lit(0).cast(en.schema["valor"].dataType)
    return en.agg(
        F.coalesce(F.sum(F.when(kind == C.CREDIT, v)), zero).alias("creditos"),
        F.abs(F.coalesce(F.sum(F.when(kind == C.DEBIT, v)), zero)).alias("debitos"),
        F.coalesce(F.sum(v), zero).alias("saldo_final"),
        F.count_if(kind == C.CREDIT).alias("n_creditos"),
        F.count_if(kind == C.DEBIT).alias("n_debitos"),
        F.count(F.lit(1)).alias("n_total"))


def extract_metrics_display(m: DataFrame) -> DataFrame:
    """A16 as the cards show it (Brazilian currency text)."""
    return m.select(
        currency_br(F.col("creditos")).alias("creditos"),
        currency_br(F.col("debitos")).alias("debitos"),
        currency_br(F.col("saldo_final")).alias("saldo_final"),
        "n_creditos", "n_debitos", "n_total")


def category_breakdown(en: DataFrame) -> DataFrame:
    """Per extract category, sum / count of ``valor`` and |sum|."""
    return en.groupBy("categoria").agg(
        F.sum("valor").alias("valor_sum"),
        F.count("valor").alias("valor_count"),
        F.abs(F.sum("valor")).alias("valor_abs"))


def custodian_comparison(en: DataFrame) -> DataFrame:
    """Per custodian (NULL custodian dropped) sum, |sum| and distinct funds."""
    return (en.filter(F.col("fonte").isNotNull()).groupBy("fonte").agg(
        F.sum("valor").alias("valor"),
        F.abs(F.sum("valor")).alias("valor_abs"),
        F.countDistinct("nmfundo").alias("n_funds")))


def concentration_top10(a3: DataFrame, n: int = TOP_CONCENTRATION) -> DataFrame:
    """O3: the ``n`` largest shares (ties broken by fund, custodian)."""
    return a3.orderBy(F.col("concentration_pct").desc(), F.col("nmfundo").asc_nulls_first(),
                      F.col("fonte").asc_nulls_first()).limit(n)


def concentration_display(a3: DataFrame) -> DataFrame:
    """A3 rows as the concentration table shows them (BR currency and percent)."""
    return a3.select("nmfundo", "fonte",
                     currency_br(F.col("total_volume")).alias("total_volume"),
                     percent_br(F.col("concentration_pct")).alias("concentration_pct"),
                     "concentration_level")
