"""Driver-side parameter objects (no data passes through them)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# Fixed values that must equal the reference's (analytics defaults and presets).
# analytics: liquidity_ratio_min 0.8, liquidity_ratio_max 1.5,
#            concentration_threshold 30.0, default_period_days 45
# hard-coded in the analyses: critical liquidity below 0.5; a fund's
#            concentration is reported above 20 (%); an evolution alert fires
#            above 20 (%) total variation
# period presets (label -> days back from as_of; -1 means a custom range):
#   "Hoje" 0, "Últimos 7 dias" 7, "Últimos 30 dias" 30, "Últimos 45 dias" 45,
#   "Personalizado" -1
# evolution horizons (days): short 7, medium 30, long 45
# UI extract row limit: 10000
PERIOD_PRESETS = {
    "Hoje": 0,
    "Últimos 7 dias": 7,
    "Últimos 30 dias": 30,
    "Últimos 45 dias": 45,
    "Personalizado": -1,
}
EVOLUTION_HORIZONS = {"short": 7, "medium": 30, "long": 45}
DEFAULT_PERIOD_DAYS = 45
MAX_RECORDS_DISPLAY = 10000


def _as_tuple(values) -> tuple[str, ...] | None:
    if not values:  # None and [] both mean "no filter"
        return None
    return tuple(values)


@dataclass(frozen=True)
class FilterParams:
    """Period (both ends inclusive, by calendar date), fund and custodian lists.

    An empty list means "no filter", like ``None``.  ``limit`` keeps the
    newest ``limit`` rows of the extract (the UI passes 10000); analyses
    other than the extract and the KPI block ignore it.
    """

    start_date: dt.date
    end_date: dt.date
    funds: tuple[str, ...] | None = None
    custodians: tuple[str, ...] | None = None
    limit: int | None = None

    def __post_init__(self):
        object.__setattr__(self, "funds", _as_tuple(self.funds))
        object.__setattr__(self, "custodians", _as_tuple(self.custodians))
        if self.limit is not None and int(self.limit) <= 0:
            object.__setattr__(self, "limit", None)

    @property
    def period_days(self) -> int:
        return (self.end_date - self.start_date).days

    def with_range(self, start: dt.date, end: dt.date) -> "FilterParams":
        return FilterParams(start, end, self.funds, self.custodians, self.limit)


@dataclass(frozen=True)
class Thresholds:
    liquidity_ratio_min: float = 0.8
    liquidity_ratio_max: float = 1.5
    liquidity_critical: float = 0.5
    concentration_threshold: float = 30.0
    concentration_watch: float = 20.0
    evolution_variation: float = 20.0
    extras: dict = field(default_factory=dict)

    @classmethod
    def from_mapping(cls, cfg: dict | None) -> "Thresholds":
        """From an ``analytics`` config section (unknown keys kept in ``extras``)."""
        cfg = dict(cfg or {})
        known = {k: float(cfg.pop(k)) for k in list(cfg)
                 if k in cls.__dataclass_fields__ and k != "extras"}
        return cls(**known, extras=cfg)


def preset_range(as_of: dt.date, preset: str | int = DEFAULT_PERIOD_DAYS,
                 custom: tuple[dt.date, dt.date] | None = None) -> tuple[dt.date, dt.date]:
    """Period preset -> (start, end).  ``start = as_of - n days``, ``end = as_of``.

    ``preset`` is a label of ``PERIOD_PRESETS`` or a number of days.  The
    custom preset takes ``custom=(start, end)``.
    """
    days = PERIOD_PRESETS[preset] if isinstance(preset, str) else int(preset)
    if days < 0:
        if custom is None:
            return as_of - dt.timedelta(days=DEFAULT_PERIOD_DAYS), as_of
        start, end = custom
        return start, end
    return as_of - dt.timedelta(days=days), as_of


def period_filter(as_of: dt.date, preset: str | int = DEFAULT_PERIOD_DAYS, **kw) -> FilterParams:
    start, end = preset_range(as_of, preset, kw.pop("custom", None))
    return FilterParams(start, end, **kw)
