"""Run configuration: one frozen dataclass instead of scattered switches."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

_TRUE = {"1", "true", "yes"}


@dataclass(frozen=True)
class EngineConfig:
    precision_mode: bool = False
    facts_sources: str = "ast"
    disable_facts: bool = False
    hard_block_precision: float = 0.15
    confidence_threshold: int = 80
    precision_floor: float = 0.30
    rule_strength_tau: float = 0.05
    unknown_overlap: float = 0.80
    struct_gates: bool = False
    citation_check: bool = False
    citation_overlap: float = 0.70
    adversarial: bool = False
    adversarial_threshold: int = 90
    adversarial_with_facts: bool = False
    evidence_review: bool = False
    review_floor: int = 70
    detect_calls: int = 1
    detect_only: bool = False
    skip_missing: bool = False
    skip_class_level: bool = False
    use_trophies: bool = False
    hints_version: str = "curated"
    hints_hybrid: bool = False
    drop_always_check: bool = False
    adaptive_cap: bool = False
    missing_cap: int = 7
    no_think: bool = False
    gate_mode: str = "intended"

    @classmethod
    def from_env(cls, prefix: str = "CHANGELENS_", env: dict | None = None) -> "EngineConfig":
        """Read overrides such as ``CHANGELENS_PRECISION_MODE=1``.

        A value that does not parse as a number leaves the default in place.
        """
        env = os.environ if env is None else env
        values = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is None or raw == "":
                continue
            if isinstance(f.default, bool):
                values[f.name] = raw.lower() in _TRUE
            elif isinstance(f.default, (int, float)):
                try:
                    values[f.name] = type(f.default)(raw)
                except ValueError:
                    continue
            else:
                values[f.name] = raw
        if "missing_cap" in values:
            values["missing_cap"] = max(1, values["missing_cap"])
        return cls(**values)

    @property
    def suppress_thinking(self) -> bool:
        return self.no_think or self.precision_mode


# Up to how many detected labels, and what the cap then is beyond its base (None: any number).
CAP_STEPS = [(0, 0), (2, -2), (5, 0), (10, 3), (None, 5)]
LEAST_CAP = 4


def cap_steps(base: int = 7) -> list[tuple[int | None, int]]:
    """Candidate caps that grow with the number of detected labels: ``(up to, cap)``."""
    return [(limit, max(LEAST_CAP, base + more) if more < 0 else base + more) for limit, more in CAP_STEPS]


def adaptive_cap(detected: int, base: int = 7) -> int:
    return next(cap for limit, cap in cap_steps(base) if limit is None or detected <= limit)
