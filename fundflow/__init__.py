"""Spark-native analytics over fund bank-statement ledgers.

Every operator is a pure function ``DataFrame (+ params) -> DataFrame``
built from Spark SQL built-ins; nothing is collected to the driver.

Sub-packages:

* ``sources``   -- ledger contract, readers (parquet / table / JDBC), adapters, sinks
* ``functions`` -- column expressions: money, classifications, formatting
* ``operators`` -- filters, extract, flows, evolution, KPIs, breakdowns, alerts
* ``plans``     -- rule packs, custom SQL analyses, analysis bundles and the
                   one-scan dashboard refresh (daily cube)
* ``streaming`` -- incremental (Structured Streaming) refresh of the daily metrics
"""

from fundflow.params import FilterParams, Thresholds, preset_range

__all__ = ["FilterParams", "Thresholds", "preset_range"]
