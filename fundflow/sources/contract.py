"""The ledger contract: one typed row per bank-statement line.

Any source (parquet, table, JDBC, an adapter over other tables) is
normalised to ``LEDGER_SCHEMA`` by ``normalise``.  Money is DECIMAL(18,2)
inside every operator so sums are exact and independent of partitioning;
it is cast to double only at the output edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

MONEY = T.DecimalType(18, 2)
MONEY_COLUMNS = ("entrada", "saida", "saldo")

LEDGER_SCHEMA = T.StructType([
    T.StructField("id_origem", T.LongType(), False),       # source row id (tie-breaker)
    T.StructField("fonte", T.StringType(), True),          # custodian
    T.StructField("id_carteira", T.LongType(), True),      # portfolio
    T.StructField("nmfundo", T.StringType(), True),        # fund name
    T.StructField("cnpj", T.StringType(), True),           # tax id
    T.StructField("dt_lancamento", T.TimestampNTZType(), False),  # posting time
    T.StructField("entrada", MONEY, True),                 # inflow
    T.StructField("saida", MONEY, True),                   # outflow
    T.StructField("saldo", MONEY, True),                   # balance
    T.StructField("lancamento", T.StringType(), True),     # description
])
LEDGER_COLUMNS = tuple(f.name for f in LEDGER_SCHEMA.fields)
# partition key of a stored ledger (see sinks.write_ledger / readers.read_ledger)
PARTITION_COLUMN = "dt_part"


#: Raw values that the contract cannot hold as they are, by column.
RESCUE_COLUMN = "_rescued"
_WIDE = T.DecimalType(38, 10)


def _typed(c: Column, source: T.DataType, target: T.DataType, source_zone: str | None) -> Column:
    """``c`` in the contract's type; a value that does not fit is NULL, never an error."""
    if source == target:
        return c
    if isinstance(target, T.TimestampNTZType):
        if isinstance(source, T.StringType):
            return F.try_to_timestamp(c).cast(target)
        if isinstance(source, T.TimestampType) and source_zone:
            return F.convert_timezone(None, F.lit(source_zone), c)  # the wall clock of the books
    return c.try_cast(target)


def _kept(name: str, c: Column, typed: Column, source: T.DataType, target: T.DataType) -> Column | None:
    """Condition that a raw value is lost or changed by its type; None where no value can be."""
    if source == target or isinstance(target, T.StringType):
        return None
    lost = c.isNotNull() & typed.isNull()
    if name in MONEY_COLUMNS:  # money is kept to the cent, the rest of the number is not
        if isinstance(source, (T.FloatType, T.DoubleType)):
            changed = typed.cast(source) != c
        else:
            changed = typed.cast(_WIDE) != c.try_cast(_WIDE)
        return lost | F.coalesce(changed, F.lit(False))
    return lost


def normalise(df: DataFrame, rename: dict[str, str] | None = None, rescue: bool = False,
              source_zone: str | None = None) -> DataFrame:
    """Rename (``{source_name: contract_name}``) and cast ``df`` to the contract.

    A value that its column's type cannot hold (junk text, an overflow) is
    NULL; NULL money is read as 0 by every operator, like the reference's fill.
    With ``rescue`` a column ``_rescued`` maps the name of each such column, and
    of money that was rounded to the cent, to the raw value's text (NULL where
    the row has none).  ``source_zone`` names the zone whose wall clock an
    instant (``timestamp``) is booked by; without it the session's zone counts.

    Only the contract columns survive, so column pruning reaches the scan.
    """
    if rename:
        df = df.select([F.col(c).alias(rename.get(c, c)) for c in df.columns])
    types = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in LEDGER_COLUMNS if c not in types]
    if missing:
        raise ValueError(f"ledger source lacks columns {missing}")
    cols, raws = [], []
    for f in LEDGER_SCHEMA.fields:
        c, src = F.col(f.name), types[f.name]
        typed = _typed(c, src, f.dataType, source_zone)
        cols.append(typed.alias(f.name))
        kept = _kept(f.name, c, typed, src, f.dataType)
        if kept is not None:
            raws.append(F.when(kept, F.struct(F.lit(f.name).alias("key"), c.cast("string").alias("value"))))
    if rescue:
        entries = F.array_compact(F.array(*raws)) if raws else F.array().cast(
            "array<struct<key:string,value:string>>")
        cols.append(F.when(F.size(entries) > 0, F.map_from_entries(entries)).alias(RESCUE_COLUMN))
    return df.select(cols)


def normalise_observed(df: DataFrame, rename: dict[str, str] | None = None, source_zone: str | None = None,
                       name: str = "ledger-contract") -> tuple[DataFrame, Observation]:
    """The rescued ledger and an ``Observation`` that counts, while any job reads it, the lines
    (``rows``) and for each column the values rescued (``rescued_<column>``)."""
    seen = Observation(name)
    ledger = normalise(df, rename, rescue=True, source_zone=source_zone)
    has = lambda c: F.coalesce(F.map_contains_key(RESCUE_COLUMN, F.lit(c)), F.lit(False))
    return ledger.observe(seen, F.count(F.lit(1)).alias("rows"),
                          *(F.count_if(has(c)).alias(f"rescued_{c}") for c in LEDGER_COLUMNS)), seen


def rescued_values(ledger: DataFrame) -> DataFrame:
    """A row for each rescued value of a ledger read with ``rescue``: id_origem, column, raw."""
    return ledger.select("id_origem", F.explode(RESCUE_COLUMN).alias("column", "raw"))


def contract_violations(ledger: DataFrame) -> DataFrame:
    """One row of counts a loader should look at (rows are never altered)."""
    return ledger.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("dt_lancamento").isNull()).alias("null_dt_lancamento"),
        F.count_if(F.col("saida") < 0).alias("negative_saida"),
        F.count_if(F.col("entrada") < 0).alias("negative_entrada"),
        F.count_if(F.col("nmfundo").isNull()).alias("null_nmfundo"),
        F.count_if(F.col("nmfundo") == "").alias("empty_nmfundo"),
    )
