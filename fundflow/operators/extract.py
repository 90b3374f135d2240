"""Extract (S2), enriched extract (S3) and the ordered / limited extract (O1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fundflow.functions import classify as C
from fundflow.functions.money import entrada, flow, saida, saldo

BASE_COLUMNS = ("id_origem", "fonte", "id_carteira", "nmfundo", "cnpj", "dt_lancamento",
                "entrada", "saida", "saldo", "lancamento")
DERIVED_COLUMNS = ("valor", "tipo_lancamento", "categoria", "data", "mes_ano", "ano", "mes")
# newest first; id_origem makes the order total so a limit is deterministic
def extract_order() -> tuple[F.Column, ...]:
    return (F.col("dt_lancamento").desc(), F.col("nmfundo").asc_nulls_first(),
            F.col("id_origem").asc())


def newest_cutoff(lf: DataFrame, limit: int) -> F.Column:
    """Midnight of the earliest date that can hold one of the newest ``limit``
    lines (of year 1 when the period has fewer lines), as a scalar subquery.

    Per-day line counts are folded newest-first until they reach ``limit``.
    The folded array has one entry per calendar day of the requested period
    that has lines -- bounded by the period, not by the data volume.
    """
    per_day = lf.groupBy(F.to_date("dt_lancamento").alias("d")).agg(
        F.count(F.lit(1)).alias("n"))
    start = F.struct(F.lit(0).cast("long").alias("cum"), F.lit(None).cast("date").alias("d"))
    days = F.sort_array(F.collect_list(F.struct("d", "n")), asc=False)
    folded = F.aggregate(days, start, lambda acc, x: F.when(acc["cum"] >= limit, acc).otherwise(
        F.struct((acc["cum"] + x["n"]).alias("cum"), x["d"].alias("d"))))
    day = F.coalesce(F.when(folded["cum"] >= limit, folded["d"]), F.lit("0001-01-01").cast("date"))
    return per_day.select(day.cast("timestamp_ntz")).scalar()


def extract(lf: DataFrame, limit: int | None = None) -> DataFrame:
    """The ten ledger columns with NULL money read as 0.

    With ``limit`` it keeps the newest ``limit`` rows: lines before the
    ``newest_cutoff`` date are dropped first, so the distributed top-k
    (TakeOrderedAndProject) merges about ``limit`` lines plus one day's
    instead of ``limit`` per scan task.  Without ``limit`` no global sort is
    done -- ordering is a presentation concern (see ``ordered``).
    """
    if limit:
        # the raw column against one value: the scan gets it as a filter once the subquery has run
        lf = lf.filter(F.col("dt_lancamento") >= newest_cutoff(lf, int(limit)))
    df = lf.select("id_origem", "fonte", "id_carteira", "nmfundo", "cnpj", "dt_lancamento",
                   entrada().alias("entrada"), saida().alias("saida"), saldo().alias("saldo"),
                   "lancamento")
    if limit:
        df = df.orderBy(*extract_order()).limit(int(limit))
    return df


def ordered(df: DataFrame) -> DataFrame:
    """O1/O2 presentation order of the extract."""
    return df.orderBy(*extract_order())


def enrich(ex: DataFrame) -> DataFrame:
    """S3: the seven derived columns of the enriched extract."""
    ts = F.col("dt_lancamento")
    return ex.withColumns({
        "valor": flow(),
        "tipo_lancamento": C.operation_type(F.col("entrada"), F.col("saida")),
        "categoria": C.extract_category(F.col("lancamento")),
        "data": F.to_date(ts),
        "mes_ano": F.date_format(ts, "yyyy-MM"),
        "ano": F.year(ts),
        "mes": F.month(ts),
    })


def enriched_extract(lf: DataFrame, limit: int | None = None) -> DataFrame:
    return enrich(extract(lf, limit))
