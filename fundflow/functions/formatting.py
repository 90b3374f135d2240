"""Display formatting as column expressions (Brazilian currency / percent, dates).

These only shape text for presentation; analyses never parse them back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Fixed values that must equal the reference's display formats:
#   currency "R$ 1.234,50" (NULL/NaN -> "R$ 0,00"); percent "12,34%"
#   (NULL/NaN -> "0,00%"); date label "dd/mm/YYYY".
ZERO_CURRENCY = "R$ 0,00"
ZERO_PERCENT = "0,00%"


def _missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x.cast("double"))


def currency_br(x: Column) -> Column:
    swapped = F.translate(F.format_number(x, 2), ",.", ".,")
    return F.when(_missing(x), F.lit(ZERO_CURRENCY)).otherwise(F.concat(F.lit("R$ "), swapped))


def percent_br(x: Column) -> Column:
    text = F.translate(F.format_string("%.2f", x.cast("double")), ".", ",")
    return F.when(_missing(x), F.lit(ZERO_PERCENT)).otherwise(F.concat(text, F.lit("%")))


def date_label(d: Column) -> Column:
    return F.date_format(d, "dd/MM/yyyy")


def py_number(x: Column, spec: str = ".2f") -> Column:
    """Text of a double the way Python's ``format(x, spec)`` shows it.

    Supports ``[,][.N]f`` specs; infinities and NaN print as Python does
    (``inf``/``-inf``/``nan``) and NULL as ``None``.  Java rounds exact
    binary ties half-up where Python rounds half-even, so a value such as
    0.125 can differ in the last digit.
    """
    m = re.fullmatch(r"(,?)(?:\.(\d+))?f", spec)
    if not m:
        raise ValueError(f"unsupported format spec {spec!r}")
    java = "%" + m.group(1) + "." + (m.group(2) or "6") + "f"
    d = x.cast("double")
    return (F.when(d.isNull(), F.lit("None"))
            .when(F.isnan(d), F.lit("nan"))
            .when(d == float("inf"), F.lit("inf"))
            .when(d == float("-inf"), F.lit("-inf"))
            .otherwise(F.format_string(java, d)))


def py_text(x: Column) -> Column:
    """``str(x)`` of a string value, NULL shown as ``None``."""
    return F.coalesce(x.cast("string"), F.lit("None"))


_FIELD = re.compile(r"\{(\w+)(?::([^}]*))?\}")


def render_template(template: str, columns: dict[str, Column]) -> Column:
    """Fill a Python ``str.format`` style template from columns.

    ``{name}`` inserts the column as text; ``{name:.2f}`` / ``{name:,.2f}``
    format numbers.  Literal text is escaped for ``format_string``.
    """
    pieces: list[Column] = []
    pos = 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            pieces.append(F.lit(template[pos:m.start()]))
        col = columns[m.group(1)]
        pieces.append(py_number(col, m.group(2)) if m.group(2) else py_text(col))
        pos = m.end()
    if pos < len(template):
        pieces.append(F.lit(template[pos:]))
    return F.concat(*pieces) if pieces else F.lit("")
