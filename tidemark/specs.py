"""Declarative descriptions the operators take: rules, predicates, cleaning steps, feature specs, segments, tests."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

# The closed vocabularies.
TRADABLE_AT = ("next_open_after", "same_date_open", "next_trading_day_open")
PREDICATE_OPS = ("==", "!=", "<", "<=", ">", ">=", "isna", "notna", "isin", "notin", "before", "on_or_after",
                 ">col", "<col")
CLEANING_OPS = ("drop_duplicates", "drop_rows", "flag_rows", "missing_indicator")
FEATURE_OPS = ("field", "ratio", "diff", "log1p", "change", "growth", "surprise", "rolling_mean", "rolling_sum",
               "rolling_std", "peer_relative", "rank", "residualize")
HORIZONS = (1, 2, 5, 10, 20, 40, 60)
CONTROLS = ("size", "reversal", "momentum", "beta", "dollar_adv", "sector")


@dataclass(frozen=True)
class AvailabilityRule:
    """Which column makes a record public and at which session's open it may first be used."""

    source: str
    tradable_at: str = "next_open_after"
    source_timezone: str = "America/New_York"
    extra_lag: int = 0
    value_vintage: str = "not_applicable"   # as_of_date | latest | not_applicable

    def __post_init__(self):
        if self.tradable_at not in TRADABLE_AT:
            raise ValueError(f"tradable_at must be one of {TRADABLE_AT}, got {self.tradable_at!r}")
        if self.extra_lag < 0:
            raise ValueError("extra_lag counts sessions and cannot be negative")


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    value: object = None


@dataclass(frozen=True)
class CleaningStep:
    op: str
    table: str
    columns: tuple[str, ...] = ()
    where: tuple[Predicate, ...] = ()
    flag_name: str | None = None
    order_by: tuple[str, ...] = ()   # decides which duplicate is the first


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    op: str
    inputs: tuple[str, ...]
    window: int | None = None
    group: str | None = None


@dataclass(frozen=True)
class ViewRoles:
    """Which columns of a table are its entity, its source time, its values and its quality flags."""

    entity: str
    time: str
    values: tuple[str, ...]
    flags: tuple[str, ...] = ()


@dataclass(frozen=True)
class PanelSpec:
    """Where the universe is formed and which dates the panel covers (ISO dates, both ends included)."""

    formation: tuple[str, str]
    start: str
    end: str
    scale_field: str
    universe_n: int = 1000
    adv_window: int = 20
    adv_min: int = 5


@dataclass(frozen=True)
class Split:
    """Segments as (first, last) ISO dates, in order, separated by an embargo of sessions."""

    discovery: tuple[str, str]
    validation: tuple[str, str]
    test: tuple[str, str]

    def bounds(self, segment: str) -> tuple[str, str]:
        return getattr(self, segment)


@dataclass(frozen=True)
class RobustnessTest:
    """kind: restrict_universe (drop_illiquid_tercile, price_ge_5, large_caps, exclude_sector), subperiod,
    add_controls."""

    name: str
    kind: str
    universe: str | None = None
    sector: str | None = None
    period: tuple[str, str] | None = None
    controls: tuple[str, ...] = ()
    standard: bool = False           # part of the battery every finding faces
    target: str | None = None        # the finding it attacks; None attacks all


@dataclass(frozen=True)
class Finding:
    name: str
    feature: str
    horizon: int
    sign: int = 1
    controls: tuple[str, ...] = ()
    claimed_ic: float | None = None


@dataclass(frozen=True)
class ControlWindows:
    """Sessions (window, least observations) of each control; the defaults are the daily ones."""

    reversal: tuple[int, int] = (5, 4)
    momentum: tuple[int, int] = (232, 150)
    momentum_skip: int = 20
    beta: tuple[int, int] = (252, 120)
    adv: tuple[int, int] = (20, 10)
    vol: tuple[int, int] = (20, 10)
    roll: tuple[int, int] = (60, 40)
    quote: tuple[int, int] = (20, 5)


def definition_hash(obj) -> str:
    """Twelve hex digits that name a definition (specs, steps, meta)."""
    def plain(x):
        return asdict(x) if hasattr(x, "__dataclass_fields__") else x
    body = [plain(x) for x in obj] if isinstance(obj, (list, tuple)) else plain(obj)
    return hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()[:12]


__all__ = ["AvailabilityRule", "Predicate", "CleaningStep", "FeatureSpec", "PanelSpec", "ViewRoles", "Split", "RobustnessTest",
           "Finding", "ControlWindows", "definition_hash"]
