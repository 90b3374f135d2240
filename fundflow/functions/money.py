"""Money and numeric column expressions.

Money stays DECIMAL inside aggregations (exact, order independent) and is
cast to double at the output edge.  Ratios are computed in double with
``try_divide`` (Spark 4 is ANSI: a bare ``/`` by zero raises).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fundflow.sources.contract import MONEY


def zero() -> Column:
    return F.lit(0).cast(MONEY)


def inf() -> Column:
    return F.lit(float("inf"))


def money(name: str) -> Column:
    """NULL money reads as 0 (the reference's COALESCE(x, 0) / fillna(0))."""
    return F.coalesce(F.col(name), zero())


def entrada() -> Column:
    return money("entrada")


def saida() -> Column:
    return money("saida")


def saldo() -> Column:
    return money("saldo")


def flow() -> Column:
    """Signed amount of a line: inflow minus outflow (the reference's ``valor``)."""
    return entrada() - saida()


def gross_volume() -> Column:
    """|inflow| + |outflow| of a line."""
    return F.abs(entrada()) + F.abs(saida())


def dbl(c: Column) -> Column:
    return c.cast("double")


def rnd(c: Column, digits: int) -> Column:
    """Round half away from zero on ``c * 10^digits`` (same IEEE steps in any engine)."""
    scale = 10 ** digits
    return F.round(c.cast("double") * scale) / scale


def ratio(num: Column, den: Column) -> Column:
    """num / den in double; NULL when den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_inf(num: Column, den: Column) -> Column:
    """num / den in double; +inf when den is 0 (the reference's float('inf'))."""
    return F.when(den == 0, inf()).otherwise(ratio(num, den))


def mean(total: Column, n: Column) -> Column:
    """Mean as exact sum / count in double (engine-independent, unlike avg(decimal))."""
    return ratio(total, n)


def to_output(df: DataFrame) -> DataFrame:
    """Output edge: DECIMAL money columns become double, everything else as is."""
    return df.select([F.col(f.name).cast("double").alias(f.name)
                      if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
                      for f in df.schema.fields])
