"""Filters F1-F6.

The period filter is written as a half-open timestamp range
(``dt >= start 00:00 AND dt < end+1 00:00``) -- the same rows as
``DATE(dt) BETWEEN start AND end`` -- so it is a plain column/literal
comparison that reaches the parquet scan as ``PushedFilters`` and prunes
date partitions.  Fund / custodian lists become ``IN``, pushed too, whatever
their length (Spark keeps a long list as a hash set).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F, types as T

from fundflow.params import FilterParams


def _ts(d: dt.date) -> F.Column:
    # a DATE literal cast to timestamp_ntz is midnight with no time-zone step
    # (a Python datetime literal would pass through the driver's local zone)
    return F.lit(d).cast(T.TimestampNTZType())


def period(ledger: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """calendar dates ``start..end``, both ends inclusive, time of day ignored."""
    c = F.col("dt_lancamento")
    return ledger.filter((c >= _ts(start)) & (c < _ts(end + dt.timedelta(days=1))))


def _member(ledger: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    return ledger.filter(F.col(column).isin(*dict.fromkeys(values)))


def funds(ledger: DataFrame, names: tuple[str, ...] | None) -> DataFrame:
    """fund IN-list, only when the list is non-empty (NULL funds never match)."""
    return _member(ledger, "nmfundo", names) if names else ledger


def custodians(ledger: DataFrame, names: tuple[str, ...] | None) -> DataFrame:
    """custodian IN-list, only when the list is non-empty."""
    return _member(ledger, "fonte", names) if names else ledger


def apply_filters(ledger: DataFrame, p: FilterParams) -> DataFrame:
    """F1 + F2 + F3 (``limit`` is honoured by the extract and KPI operators)."""
    return custodians(funds(period(ledger, p.start_date, p.end_date), p.funds), p.custodians)


def _distinct_names(ledger: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return (ledger.select(c).filter(c.isNotNull() & (c != ""))
            .distinct())


def available_funds(ledger: DataFrame, limit: int | None = None) -> DataFrame:
    """distinct non-null, non-empty fund names, sorted; a picker may show the first ``limit``."""
    names = _distinct_names(ledger, "nmfundo").orderBy("nmfundo")
    return names.limit(limit) if limit else names


def available_custodians(ledger: DataFrame) -> DataFrame:
    """distinct non-null, non-empty custodians, sorted."""
    return _distinct_names(ledger, "fonte").orderBy("fonte")


def fund_search(fund_names: DataFrame, term: str | None) -> DataFrame:
    """case-insensitive literal substring search over a fund list (F4's output)."""
    if not term:
        return fund_names
    return fund_names.filter(F.lower(F.col("nmfundo")).contains(term.lower()))
