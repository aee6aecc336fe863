"""Parameters of an analysis, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass

#: Gas constant in kcal / (mol K).
GAS = 0.001987204259

#: name -> (least, most) allowed
_RANGES = {
    "temperature_celsius": (0.0, 100.0),
    "max_structures": (1, 10**9),
    "min_hairpin": (0, 10),
    "max_basins": (3, 500),
    "min_basin_size": (1, 100),
    "alpha": (0.0, 0.1),
    "num_modes": (1, 200),
    "gap_threshold": (1e2, 1e12),
    "prefactor": (1e-300, 1e300),
    "epsilon": (0.0, 0.2),
    "delta": (0.01, 0.5),
    "tolerance": (1e-12, 1e-6),
    "sigma": (1e-6, 1e-3),
    "num_runs": (1, 100),
    "num_null": (1, 10**6),
    "swaps_per_edge": (1, 100),
}
NULL_MODELS = ("none", "full_analysis", "topo_shuffle", "energy_shuffle", "nt_shuffle", "random_basins")


@dataclass(frozen=True)
class Params:
    temperature_celsius: float = 37.0
    energy_window: float = 50.0
    max_structures: int = 100_000
    min_hairpin: int = 3
    seed: int = 43
    max_basins: int = 500
    min_basin_size: int = 5
    alpha: float = 0.001
    num_modes: int = 50
    gap_threshold: float = 1e6
    prefactor: float = 1.0
    sigma: float = 1e-4
    epsilon: float = 0.05
    delta: float = 0.1
    tolerance: float = 1e-9
    num_runs: int = 5
    null_model: str = "nt_shuffle"
    num_null: int = 100
    swaps_per_edge: int = 10
    ensemble_row: bool = False

    def __post_init__(self):
        for name, (low, high) in _RANGES.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be between {low} and {high}, not {getattr(self, name)}")
        if not self.energy_window > 0:
            raise ValueError("energy_window must be positive, or infinite for none")
        if self.epsilon >= self.delta:
            raise ValueError("epsilon must be less than delta")
        if self.null_model not in NULL_MODELS:
            raise ValueError(f"null_model must be one of {NULL_MODELS}")

    @property
    def rt(self) -> float:
        """Gas constant times absolute temperature."""
        return GAS * (self.temperature_celsius + 273.15)
