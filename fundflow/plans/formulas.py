"""Metric formulas of rule packs (X2) as columns.

A ``calculation`` is an arithmetic expression over a fund's totals and its days:

* totals: ``total_entries``, ``total_exits``, ``net_flow``, ``operation_count``,
  ``active_days``;
* per day, inside an aggregate: ``daily_volume``, ``daily_balance_change``,
  ``daily_entries``, ``daily_exits``, ``daily_operations``;
* aggregates SUM, AVG, MIN, MAX, COUNT, STDDEV (of the population, as in MySQL),
  STDDEV_POP, STDDEV_SAMP, VARIANCE;
* functions ABS, ROUND, SQRT, COALESCE, NULLIF, GREATEST, LEAST;
* numbers, parentheses, ``+ - * /``.

The text has the shape of a Python expression, so ``ast`` reads it and a walk
over the tree gives the column.  Every division, wherever it stands, has no
value where the divisor is zero, and what is computed from it has none
either.  Sums stay exact decimals and become doubles as results.  Anything else
is a ``FormulaError`` that names the formula and the part at fault.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from fundflow.functions.money import dbl

DAILY = ("daily_volume", "daily_balance_change", "daily_entries", "daily_exits", "daily_operations")
TOTALS: dict[str, Callable[[], Column]] = {
    "total_entries": lambda: dbl(F.sum("daily_entries")),
    "total_exits": lambda: dbl(F.sum("daily_exits")),
    "net_flow": lambda: dbl(F.sum("daily_balance_change")),
    "operation_count": lambda: F.sum("daily_operations"),
    "active_days": lambda: F.count(F.lit(1)),
}
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "SUM": lambda x: dbl(F.sum(x)),
    "AVG": lambda x: F.try_divide(dbl(F.sum(x)), F.count(x)),
    "MIN": lambda x: dbl(F.min(x)),
    "MAX": lambda x: dbl(F.max(x)),
    "COUNT": F.count,
    "STDDEV": F.stddev_pop, "STDDEV_POP": F.stddev_pop, "STD": F.stddev_pop, "STDDEV_SAMP": F.stddev_samp,
    "VARIANCE": F.var_pop, "VAR_POP": F.var_pop,
}
#: Results of these, and of sums of quotients, depend in their last digits on the order of merging.
UNSTABLE = {"STDDEV", "STDDEV_POP", "STD", "STDDEV_SAMP", "VARIANCE", "VAR_POP"}
#: Function and the numbers of arguments it takes.
FUNCTIONS: dict[str, tuple[Callable[..., Column], range]] = {
    "ABS": (F.abs, range(1, 2)),
    "SQRT": (lambda x: F.when(dbl(x) >= 0, F.sqrt(dbl(x))), range(1, 2)),
    "ROUND": (lambda x, d=None: F.round(dbl(x), 0 if d is None else d), range(1, 3)),
    "COALESCE": (F.coalesce, range(1, 100)),
    "NULLIF": (F.nullif, range(2, 3)),
    "GREATEST": (F.greatest, range(2, 100)),
    "LEAST": (F.least, range(2, 100)),
}
_OPERATORS: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(dbl(a), dbl(b)),
}


class FormulaError(ValueError):
    """A calculation that cannot be read; the text says which and why."""


def metric(calculation: str) -> tuple[Column, bool]:
    """The aggregate column of a formula over (fund, date) rows, and whether its last digits are unstable."""
    text = re.sub(r"\(\s*\*\s*\)", "(1)", str(calculation).strip())  # COUNT(*)

    def fail(why: str):
        raise FormulaError(f"calculation {calculation!r}: {why}")

    try:
        tree = ast.parse(text, mode="eval").body
    except SyntaxError as exc:
        raise FormulaError(f"calculation {calculation!r}: not an arithmetic expression ({exc.msg})") from None
    unstable = False

    def walk(node: ast.expr, inside: str | None) -> Column:
        nonlocal unstable
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(node.value)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            value = walk(node.operand, inside)
            return -value if isinstance(node.op, ast.USub) else value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](walk(node.left, inside), walk(node.right, inside))
        if isinstance(node, ast.Name):
            name = node.id.lower()
            if name in TOTALS and inside is None:
                return TOTALS[name]()
            if name in DAILY and inside is not None:
                return F.col(name)
            if name in TOTALS:
                fail(f"{node.id} is a total of the fund and cannot stand inside {inside}()")
            if name in DAILY:
                fail(f"{node.id} is a value per day and must stand inside an aggregate such as SUM()")
            fail(f"unknown name {node.id}; known are {', '.join([*TOTALS, *DAILY])}")
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            name = node.func.id.upper()
            if name in AGGREGATES:
                if inside is not None:
                    fail(f"{name}() inside {inside}()")
                if len(node.args) != 1:
                    fail(f"{name}() takes one argument")
                unstable |= name in UNSTABLE or name in ("SUM", "AVG") and any(
                    isinstance(x, ast.Div) for x in ast.walk(node.args[0]))
                return AGGREGATES[name](walk(node.args[0], name))
            if name in FUNCTIONS:
                make, counts = FUNCTIONS[name]
                if len(node.args) not in counts:
                    fail(f"{name}() cannot take {len(node.args)} arguments")
                if name == "ROUND" and len(node.args) == 2 and not isinstance(node.args[1], ast.Constant):
                    fail("ROUND() takes a number of digits")
                return make(*(walk(x, inside) for x in node.args))
            fail(f"unknown function {node.func.id}; known are {', '.join([*AGGREGATES, *FUNCTIONS])}")
        fail(f"{ast.unparse(node)} is not a number, a name, a function call or + - * /")

    return walk(tree, None), unstable
