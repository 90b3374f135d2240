"""DataFrame operators: filters, extract, flows, evolution, status, KPIs,
breakdowns and alerts.  Each is ``DataFrame (+ params) -> DataFrame``."""
