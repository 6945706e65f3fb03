"""Job parameters. Nothing reads the wall clock: the year of validation is given."""

from __future__ import annotations

from dataclasses import dataclass

# What a failed extraction may carry instead of an identifier.
FAILED_MARKERS = ("all_methods_failed", "failed", "")


@dataclass(frozen=True)
class ValidationConfig:
    as_of_year: int = 26
    past: int = 5
    future: int = 1

    @property
    def years(self) -> range:
        y = self.as_of_year % 100
        return range(max(0, y - self.past), y + self.future + 1)


@dataclass(frozen=True)
class FilingConfig:
    window: int = 2
    max_distance: int = 2
    shield: float = 0.75
    gate: float = 0.70
    near: float = 1.0
    far: float = 0.3
    outlier: float = 0.1


@dataclass(frozen=True)
class TrustConfig:
    threshold: float = 0.85
    low_confidence: float = 0.70
    force_manual: bool = False


@dataclass(frozen=True)
class FusionConfig:
    detector_weight: float = 0.35
    reader_weight: float = 0.65
    default_detector: float = 0.70
    color_boost: float = 0.10
