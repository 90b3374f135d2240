"""Ledger sources, adapters and sinks."""

from fundflow.sources.adapters import ADAPTERS, events_ledger, orders_ledger
from fundflow.sources.contract import LEDGER_COLUMNS, LEDGER_SCHEMA, contract_violations, normalise
from fundflow.sources.readers import read_ledger, read_ledger_jdbc, read_ledger_table
from fundflow.sources.sinks import (
    materialise, write_ledger, write_result, write_result_jdbc, write_result_table,
)

__all__ = [
    "ADAPTERS", "LEDGER_COLUMNS", "LEDGER_SCHEMA", "contract_violations", "events_ledger",
    "materialise", "normalise", "orders_ledger", "read_ledger", "read_ledger_jdbc",
    "read_ledger_table", "write_ledger", "write_result", "write_result_jdbc", "write_result_table",
]
