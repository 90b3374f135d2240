"""Adapters from the driver's test tables to the ledger contract.

Adapter A maps orders x customer x nation (25 funds x 5 custodians);
adapter B maps the events table (10 funds x 5 custodians plus a NULL and
an empty-string fund).  Both only project and join; normalisation happens
in ``contract.normalise``.  Join strategies are left to Catalyst / AQE,
which broadcast the dimension side only when its measured size is under
the broadcast threshold.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from fundflow.sources.contract import MONEY, normalise


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _taxid(key) -> F.Column:
    return F.when(key % 10 == 0, F.lit(None).cast("string")).otherwise(
        F.lpad(key.cast("string"), 14, "0"))


def orders_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter A: one ledger line per order."""
    o = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority")
    c = _read(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    status, price = F.col("o_orderstatus"), F.col("o_totalprice").cast(MONEY)
    inflow = (status == "O") | ((status == "P") & (F.col("o_orderkey") % 2 == 0))
    desc = (F.when(F.col("o_orderpriority") == "1-URGENT", "TAXA de administração")
            .when(F.col("o_orderpriority") == "2-HIGH", "Aporte inicial")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "Resgate parcial")
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Transferência entre contas"))
    return normalise(j.select(
        F.col("o_orderkey").alias("id_origem"),
        F.col("c_mktsegment").alias("fonte"),
        F.col("o_custkey").alias("id_carteira"),
        F.col("n_name").alias("nmfundo"),
        _taxid(F.col("c_custkey")).alias("cnpj"),
        F.col("o_orderdate").alias("dt_lancamento"),
        F.when(inflow, price).alias("entrada"),
        F.when(status == "F", price).alias("saida"),
        F.col("c_acctbal").cast(MONEY).alias("saldo"),
        desc.alias("lancamento"),
    ))


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter B: one ledger line per event."""
    e = _read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    user, kind, value = F.col("user_id"), F.col("event_type"), F.col("value").cast(MONEY)
    fund = (F.when(user == 7, F.lit(None).cast("string"))
            .when(user == 13, F.lit(""))
            .otherwise(F.concat(F.lit("FUNDO_"), (user % 10).cast("string"))))
    desc = (F.when(kind == "purchase", "COMPRA de ativo")
            .when(kind == "signup", "Aporte inicial")
            .when(kind == "click", "Tarifa bancária")
            .when(kind == "view", "Resgate / saque"))
    return normalise(e.select(
        F.col("event_id").alias("id_origem"),
        F.concat(F.lit("C"), (F.col("event_id") % 5).cast("string")).alias("fonte"),
        user.alias("id_carteira"),
        fund.alias("nmfundo"),
        _taxid(user).alias("cnpj"),
        F.col("ts").alias("dt_lancamento"),
        F.when(kind.isin("purchase", "signup"), value).alias("entrada"),
        F.when(kind.isin("click", "view"), value).alias("saida"),
        (value - F.lit(20).cast(MONEY)).alias("saldo"),
        desc.alias("lancamento"),
    ))


def export_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter B as a careless text export: every column is text, some ids, times and amounts do not parse,
    some amounts overflow or have a third decimal.  Read with the rescue column."""
    e = _read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    key, kind, value = F.col("event_id"), F.col("event_type"), F.col("value").cast(MONEY).cast("string")
    amount = (F.when(key % 97 == 0, F.lit("n/a")).when(key % 101 == 0, F.lit("1e18"))
              .when(key % 103 == 0, F.concat(value, F.lit("9"))).otherwise(value))
    return normalise(e.select(
        F.when(key % 211 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(key.cast("string")).alias("id_origem"),
        F.concat(F.lit("C"), (key % 5).cast("string")).alias("fonte"),
        F.col("user_id").cast("string").alias("id_carteira"),
        F.concat(F.lit("FUNDO_"), (F.col("user_id") % 10).cast("string")).alias("nmfundo"),
        F.lit(None).cast("string").alias("cnpj"),
        F.when(key % 199 == 0, F.lit("sometime")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .alias("dt_lancamento"),
        F.when(kind.isin("purchase", "signup"), amount).alias("entrada"),
        F.when(kind.isin("click", "view"), amount).alias("saida"),
        value.alias("saldo"),
        kind.alias("lancamento"),
    ), rescue=True)


ADAPTERS = {"orders": orders_ledger, "events": events_ledger, "export": export_ledger}
