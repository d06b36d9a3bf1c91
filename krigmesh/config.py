"""Settings of a run: a frozen record of defaults, and checked overrides."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    code_col: str = "code"
    lat_col: str = "lat"
    lon_col: str = "lon"
    target_field: str = "auto"
    utm_epsg: str = "32649"
    export_epsg: int = 4326
    variogram_mode: str = "auto_select"
    variogram_model: str = "Exp"
    manual_nugget: float = 0.10
    manual_psill: float = 0.80
    manual_range: float = 4000.0
    variogram_cutoff: float = 12000.0
    variogram_width: float = 1000.0
    variogram_models: tuple[str, ...] = ("Exp", "Sph", "Gau")
    variogram_range_min: float = 1000.0
    variogram_range_max: float = 8000.0
    range_factors: tuple[float, ...] = (0.2, 0.4, 0.6)
    nmax_neighbors: int = 12
    search_radius: float = 12000.0
    auto_neighbors: bool = True
    auto_neighbor_nmax_candidates: tuple[int, ...] = (8, 12, 16, 20, 24, 32)
    auto_neighbor_search_radius_candidates: tuple[float, ...] = (6000.0, 8000.0, 10000.0, 12000.0, 15000.0, 18000.0)
    auto_neighbor_max_candidates: int = 50
    auto_neighbor_cv_method: str = "spatial_kmeans"
    clamp_to_sample_range: bool = True
    target_transform: str = "auto"
    log_backtransform_bias_correction: bool = False
    run_cross_validation: bool = True
    cv_k_folds: int = 5
    cv_seed: int = 42
    cv_methods: tuple[str, ...] = ("random", "spatial_kmeans")
    cv_refit_variogram: bool = True
    cv_require_neighbors: bool = True
    min_points_warning: int = 80
    min_pairs_per_bin: int = 20
    min_bins_warning: int = 8
    min_r2_warning: float = 0.20
    max_practical_range_factor: float = 0.80
    max_nugget_sill_warning: float = 0.75

    def with_overrides(self, overrides: dict) -> Config:
        """A copy with the given settings; upper-case names are accepted, unknown ones are an error."""
        known = {f.name: f for f in fields(self)}
        own = {k.lower(): v for k, v in overrides.items()}
        if unknown := sorted(set(own) - set(known)):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return replace(self, **{k: tuple(v) if isinstance(v, list) else v for k, v in own.items()})


DEFAULT = Config()
