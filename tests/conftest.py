import datetime as dt
import decimal
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from fundflow.params import FilterParams  # noqa: E402
from fundflow.session import local_session  # noqa: E402
from fundflow.sources.contract import LEDGER_SCHEMA  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session(8)
    yield s


def _d(x):
    return None if x is None else decimal.Decimal(str(x))


# FIXTURES.md section 3: eight hand-checked lines; row 8 falls outside January.
MICRO_ROWS = [
    (1, "btg", 10, "Alfa", "11", dt.datetime(2024, 1, 1, 9, 0), 100, None, 100, "Aporte inicial"),
    (2, "btg", 10, "Alfa", "11", dt.datetime(2024, 1, 2, 10, 0), None, 250, -150,
     "TAXA de administração"),
    (3, "daycoval", 10, "Alfa", "11", dt.datetime(2024, 1, 2, 11, 0), 50, 0, -100, "Compra com taxa"),
    (4, "btg", 20, "Beta", "22", dt.datetime(2024, 1, 1, 23, 59, 59), 300, None, 300,
     "Rendimento juros"),
    (5, "btg", 20, "Beta", "22", dt.datetime(2024, 1, 3, 0, 0), 100, 100, 300, "Transferência"),
    (6, "master", 20, "Beta", None, dt.datetime(2024, 1, 5, 12, 0), None, None, None, None),
    (7, "btg", 30, None, "33", dt.datetime(2024, 1, 4, 0, 0), 40, None, 40, "Venda"),
    (8, "fidd", 40, "Gama", "44", dt.datetime(2024, 2, 1, 0, 0), 999, None, 999, "Resgate"),
]
MICRO_PARAMS = FilterParams(dt.date(2024, 1, 1), dt.date(2024, 1, 31))
MICRO_AS_OF = dt.date(2024, 1, 31)


@pytest.fixture(scope="session")
def micro(spark):
    rows = [r[:6] + (_d(r[6]), _d(r[7]), _d(r[8]), r[9]) for r in MICRO_ROWS]
    return spark.createDataFrame(rows, LEDGER_SCHEMA)


@pytest.fixture(scope="session")
def micro_lf(micro):
    from fundflow.operators.filters import apply_filters
    return apply_filters(micro, MICRO_PARAMS)
