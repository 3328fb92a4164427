"""Settings: privacy levels, guard knobs, resource caps.

Values come from Spark's configuration (``spark.hazard.<name>``), then from the
environment (``HAZARD_<NAME>``), then from the defaults.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from .errors import UserInputError

# The factor of the admission bound, the least event count per
# time, the significant figures and the risk-set floor of each level.
LEVELS = {
    "minimal": (1, 1, None, None),
    "standard": (10, 2, 6, 50),
    "strict": (20, 5, 4, 100),
}

# Figures of exchanged aggregates, rows per unit of the risk-set
# floor, evaluations, the tolerances and the held share that draws a warning.
WIRE_FIGURES = 7
FLOOR_FACTOR = 3
MAX_ROUNDS = 20
STEP_TOLERANCE = 1e-6
STABLE_STEP_TOLERANCE = 1e-3
HELD_WARNING = 0.25


@dataclass(frozen=True)
class Settings:
    """Guards of a site.

    threshold: rows and events must exceed it. risk_change (k): tail cut and
    least change of a released risk set; up to 1 turns both off. bin_width:
    width of time bins. row_factor: admission bound in units of k.
    time_events (m): least event count per released time. figures: of released
    aggregates. risk_size: floor of released risk sets.
    """

    threshold: int = 10
    risk_change: int = 5
    bin_width: float | None = None
    level: str = "standard"
    row_factor: int = LEVELS["standard"][0]
    time_events: int = LEVELS["standard"][1]
    figures: int | None = LEVELS["standard"][2]
    risk_size: int | None = LEVELS["standard"][3]

    def __post_init__(self) -> None:
        if self.level not in LEVELS:
            raise UserInputError(f"privacy level must be one of {sorted(LEVELS)}")
        if self.threshold < 0 or self.risk_change < 1 or self.row_factor < 1 or self.time_events < 1:
            raise UserInputError("guard settings must be positive integers")
        if self.bin_width is not None and not self.bin_width > 0:
            raise UserInputError("bin_width must be positive")
        if any(v is not None and v < 1 for v in (self.figures, self.risk_size)):
            raise UserInputError("figures and risk_size must be positive")
        if self.threshold + 1 < self.risk_change:
            raise UserInputError("threshold + 1 must reach risk_change, or an admitted site could not be cut")

    @classmethod
    def at(cls, level: str, **knobs) -> Settings:
        """The preset of a level, with some knobs set otherwise."""
        name = level.strip().lower()
        if name not in LEVELS:
            raise UserInputError(f"privacy level must be one of {sorted(LEVELS)}")
        factor, events, figures, size = LEVELS[name]
        return cls(**{"level": name, "row_factor": factor, "time_events": events, "figures": figures, "risk_size": size} | knobs)

    @property
    def admission(self) -> int:
        """Rows that a site, and a category, must have."""
        floor = FLOOR_FACTOR * self.risk_size if self.risk_change > 1 and self.risk_size else 0
        return max(self.row_factor * self.risk_change, floor)

    @property
    def released_figures(self) -> int:
        return min(self.figures or WIRE_FIGURES, WIRE_FIGURES)


#: Every guard off: plain statistics, for validation.
OPEN = Settings.at("minimal", threshold=0, risk_change=1)


@dataclass(frozen=True)
class Limits:
    """Caps of one fit. held_share None: never abort. curve_figures None: exact times."""

    terms: int = 20
    grid: int = 1000
    curve_figures: int | None = 6
    held_share: float | None = 0.5

    def __post_init__(self) -> None:
        if self.terms < 1 or self.grid < 1:
            raise UserInputError("caps must be positive integers")
        if self.held_share is not None and not 0 < self.held_share <= 1:
            raise UserInputError("held_share must be in (0, 1]")
        if self.curve_figures is not None and self.curve_figures < 1:
            raise UserInputError("curve_figures must be positive")


def _lookup(spark, name: str) -> str | None:
    value = spark.conf.get(f"spark.hazard.{name}", None) if spark is not None else None
    return value if value is not None else os.environ.get(f"HAZARD_{name.upper()}")


def _number(name: str, text: str, kind=int):
    try:
        return kind(text.strip())
    except ValueError:
        raise UserInputError(f"setting {name} must be a number") from None


def load_settings(spark=None) -> Settings:
    """Settings as configured; an empty figures or risk_size turns that guard off."""
    level = (_lookup(spark, "level") or "standard").strip().lower()
    if level not in LEVELS:
        raise UserInputError(f"privacy level must be one of {sorted(LEVELS)}")
    knobs: dict = {}
    for name in ("threshold", "risk_change", "row_factor", "time_events"):
        text = _lookup(spark, name)
        if text is not None and text.strip():
            knobs[name] = _number(name, text)
    for name in ("figures", "risk_size"):
        text = _lookup(spark, name)
        if text is not None:
            knobs[name] = _number(name, text) if text.strip() else None
    text = _lookup(spark, "bin_width")
    if text and text.strip():
        knobs["bin_width"] = _number("bin_width", text, float)
    return Settings.at(level, **knobs)


def load_limits(spark=None) -> Limits:
    """Caps as configured; an empty curve_figures or held_share turns it off."""
    knobs: dict = {}
    for name in ("terms", "grid"):
        text = _lookup(spark, f"max_{name}")
        if text and text.strip():
            knobs[name] = _number(name, text)
    for name, kind in (("curve_figures", int), ("held_share", float)):
        text = _lookup(spark, name)
        if text is not None:
            knobs[name] = _number(name, text, kind) if text.strip() else None
    return Limits(**knobs)


def load_collect_timeout(spark=None) -> float:
    """Seconds that collecting triples may take."""
    text = _lookup(spark, "collect_timeout")
    seconds = _number("collect_timeout", text, float) if text and text.strip() else 60.0
    if not seconds > 0:
        raise UserInputError("collect_timeout must be positive")
    return seconds


@dataclass(frozen=True)
class SchemaChoice:
    """Where the ontology schema lies: a URL (with ``{tag}``) if it is remote, a path otherwise and where that fails."""

    remote: bool = False
    url: str | None = None
    tag: str | None = None
    path: str | None = None


def load_schema_choice(spark=None) -> SchemaChoice:
    """As configured: use_remote_schema (true or false), schema_url, schema_tag, schema_path."""
    remote = (_lookup(spark, "use_remote_schema") or "false").strip().lower()
    if remote not in ("true", "false"):
        raise UserInputError("use_remote_schema must be true or false")
    url, tag, path = ((_lookup(spark, f"schema_{n}") or "").strip() or None for n in ("url", "tag", "path"))
    return SchemaChoice(remote == "true", url, tag, path)
