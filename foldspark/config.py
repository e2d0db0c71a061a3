"""Parameters of the plans, validated when they are made.

The names of the fields and their defaults are fixed values: configurations are written with them, and results depend on
them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields

#: Fixed values of the reference data: the quality bits that reject a cadence, the epoch of the time column, and the
#: factor from a median absolute deviation to a standard deviation.
QUALITY_BITMASK = 1130799
TIME_OFFSET = 2454833.0
MAD_TO_SIGMA = 1.4826
LABEL_POLICY = "dr25_clean_v2"


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class SelectionConfig:
    """A seeded subset of labelled signals."""

    seed: int = 42
    limit: int = 20
    stratify_by_label: bool = True
    include_excluded: bool = False

    def __post_init__(self):
        _require(self.limit >= 1, "limit must be at least 1")


@dataclass(frozen=True)
class ProductConfig:
    """Which light-curve products a source keeps, and the limits on fetching them."""

    author: str = "Kepler"
    exptime_seconds: int = 1800
    flux_column: str = "PDCSAP_FLUX"
    quarters: tuple[int, ...] | None = None
    max_targets: int = 3
    max_products_per_target: int = 18
    max_total_download_mb: float = 250.0

    def __post_init__(self):
        _require(self.flux_column in ("PDCSAP_FLUX", "SAP_FLUX"), f"unknown flux column {self.flux_column}")
        _require(self.quarters is None or all(0 <= q <= 17 for q in self.quarters), "quarters must be within 0..17")
        _require(min(self.max_targets, self.max_products_per_target) >= 1, "limits must be at least 1")
        _require(self.max_total_download_mb > 0, "the download budget must be positive")


@dataclass(frozen=True)
class DetrendConfig:
    """Trend removal by a running median or a clipped spline."""

    enabled: bool = True
    method: str = "running_median"
    window_days: float = 1.5
    knot_spacing_days: float = 0.3
    sigma_lower: float = 3.0
    sigma_upper: float = 3.0
    max_iter: int = 3
    gap_days: float = 0.5
    min_points: int = 10
    mask_known_transits: bool = False
    mask_duration_factor: float = 2.0

    def __post_init__(self):
        _require(self.method in ("running_median", "robust_spline"), f"unknown trend method {self.method}")
        positive = (self.window_days, self.knot_spacing_days, self.sigma_lower, self.sigma_upper, self.gap_days, self.mask_duration_factor)
        _require(all(v > 0 for v in positive), "windows, gaps, clips and factors must be positive")
        _require(self.max_iter >= 1 and self.min_points >= 1, "max_iter and min_points must be at least 1")


@dataclass(frozen=True)
class PreprocessingConfig:
    quality_bitmask: int = QUALITY_BITMASK
    detrend: DetrendConfig = field(default_factory=DetrendConfig)
    clip_upper_sigma: float | None = 5.0

    def __post_init__(self):
        _require(self.quality_bitmask >= 0, "the bit mask can't be negative")
        _require(self.clip_upper_sigma is None or self.clip_upper_sigma > 0, "clip_upper_sigma must be positive")


@dataclass(frozen=True)
class StarSelectionConfig:
    seed: int = 42
    all_eligible: bool = False
    n_stars: int = 0
    include_kepids: tuple[int, ...] = ()

    def __post_init__(self):
        _require(self.n_stars >= 0, "n_stars can't be negative")


@dataclass(frozen=True)
class RepresentationConfig:
    """Fixed-length folded views and the thresholds that an example must reach."""

    global_bins: int = 2048
    local_bins: int = 201
    local_half_width_durations: float = 2.0
    local_bin_width_durations: float = 0.16
    min_valid_points: int = 1000
    min_global_coverage: float = 0.5
    min_transit_coverage: float = 0.5
    max_mask_window_days: float = 2.0

    def __post_init__(self):
        _require(self.global_bins >= 16 and self.local_bins >= 11, "too few bins")
        _require(self.local_half_width_durations > 0 and self.local_bin_width_durations > 0, "widths must be positive")
        _require(0 <= self.min_global_coverage <= 1 and 0 <= self.min_transit_coverage <= 1, "coverages must be within 0..1")
        _require(self.min_valid_points >= 1 and self.max_mask_window_days > 0, "thresholds must be positive")


@dataclass(frozen=True)
class SplitConfig:
    """Assignment of whole stars to train, val and test."""

    name: str = "kic_grouped_v1"
    seed: int = 42
    label_policy: str = LABEL_POLICY
    train_fraction: float = 0.70
    val_fraction: float = 0.15
    test_fraction: float = 0.15

    def __post_init__(self):
        parts = list(self.fractions.values())
        _require(min(parts) > 0 and math.isclose(math.fsum(parts), 1.0, rel_tol=0, abs_tol=1e-9), "splits must be parts of one whole")

    @property
    def fractions(self) -> dict[str, float]:
        """The part of each split by name, in the order of the fields."""
        end = "_fraction"
        return {f.name.removesuffix(end): getattr(self, f.name) for f in fields(self) if f.name.endswith(end)}


@dataclass(frozen=True)
class SearchConfig:
    """Grid and objective of the box period search."""

    min_period_days: float = 0.5
    max_period_days: float = 50.0
    min_transits: int = 3
    durations_hours: tuple[float, ...] = (1.0, 2.0, 3.0, 4.0, 6.0, 8.0)
    oversample: float = 3.0
    phase_oversample: int = 10
    objective: str = "likelihood"
    max_grid_size: int = 2_000_000
    #: Periods that one task searches at once; the result doesn't depend on it.
    chunk: int = 4096

    def __post_init__(self):
        _require(0 < self.min_period_days < self.max_period_days, "max_period_days must exceed min_period_days")
        _require(len(self.durations_hours) > 0 and min(self.durations_hours) > 0, "durations must be positive and present")
        _require(max(self.durations_hours) / 24.0 < self.min_period_days, "every duration must be shorter than the least period")
        _require(self.min_transits >= 2 and self.oversample > 0 and self.max_grid_size >= 100, "grid limits out of range")
        _require(self.objective in ("likelihood", "snr"), f"unknown objective {self.objective}")


@dataclass(frozen=True)
class NoiseConfig:
    severities: tuple[float, ...] = (0.0, 0.5, 1.0, 2.0)
    seed: int = 42

    def __post_init__(self):
        _require(all(0 <= s < float("inf") for s in self.severities), "severities must be finite and at least 0")


@dataclass(frozen=True)
class DatasetConfig:
    preprocessing: PreprocessingConfig = field(default_factory=PreprocessingConfig)
    representation: RepresentationConfig = field(default_factory=RepresentationConfig)
    stars: StarSelectionConfig = field(default_factory=StarSelectionConfig)
    splits: SplitConfig = field(default_factory=SplitConfig)
    #: Most stars of a sampled build; None for a full one.
    max_stars: int | None = 300
