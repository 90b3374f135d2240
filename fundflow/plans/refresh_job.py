"""Batch job: one dashboard refresh over a stored ledger, results written out.

    spark-submit --py-files fundflow.zip fundflow/plans/refresh_job.py \\
        --ledger PATH --out PATH --start 2024-01-01 --end 2024-01-31 \\
        [--as-of 2024-01-31] [--funds A,B] [--custodians X,Y] [--config app.yaml]

(or ``python -m fundflow.plans.refresh_job ...`` against a local session).
Reads the ledger with partition pruning, builds the daily cube once (stored
under ``spark.checkpoint.dir``), derives every daily-grained analysis and
publishes them as one version under ``--out`` (S4, ``sources.publish``): readers
see the set of the last finished refresh.  The stored cube is removed then.
Only the one-row KPI summary comes back to the driver, to be printed at the end.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import SparkSession

from fundflow.params import FilterParams, Thresholds
from fundflow.plans import dashboard
from fundflow.session import configure
from fundflow.sources.publish import publish
from fundflow.sources.readers import read_ledger


def _list(text: str | None) -> tuple[str, ...] | None:
    return tuple(x.strip() for x in text.split(",") if x.strip()) if text else None


def parse(argv: list[str]) -> argparse.Namespace:
    ap = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    ap.add_argument("--ledger", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--start", required=True, type=dt.date.fromisoformat)
    ap.add_argument("--end", required=True, type=dt.date.fromisoformat)
    ap.add_argument("--as-of", type=dt.date.fromisoformat, default=None)
    ap.add_argument("--funds")
    ap.add_argument("--custodians")
    ap.add_argument("--config", help="YAML with an 'analytics' section of thresholds")
    return ap.parse_args(argv)


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, str]:
    configure(spark)
    thresholds = Thresholds()
    if args.config:
        import yaml
        with open(args.config, encoding="utf-8") as fh:
            thresholds = Thresholds.from_mapping((yaml.safe_load(fh) or {}).get("analytics"))
    p = FilterParams(args.start, args.end, _list(args.funds), _list(args.custodians))
    ledger = read_ledger(spark, args.ledger, period=(p.start_date, p.end_date))
    dash = dashboard.refresh(spark, ledger, p, args.as_of or p.end_date, thresholds)
    done = publish(spark, dash.results(), args.out)
    dash.release(spark)
    return {name: done.path(name) for name in dash.frames}


def main(argv: list[str] | None = None) -> int:
    args = parse(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("fundflow-refresh").getOrCreate()
    written = run(spark, args)
    k = spark.read.parquet(written["kpis"]).first()
    print({key: k[key] for key in ("operation_count", "total_volume", "liquidity_risk_level",
                                   "concentration_risk_level", "data_quality_score")})
    return 0


if __name__ == "__main__":
    sys.exit(main())
