"""Parameters of a run. One frozen value is handed to every operator; nothing is kept in module state."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # They must be these for results to be the expected ones.
    sea_level_m: float = 0.0
    sea_padding_m: float = -50.0
    base_mm: float = 2.0
    z_mm_per_m: float = 0.002
    min_component_pixels: int = 1000
    step: int = 3
    mm_per_pixel: float = 0.25
    mask_sigma: float = 10.0
    mask_threshold: float = 0.3
    dem_sigma: float = 4.5
    dem_blend: float = 0.6
    peak_m: float = 50.0
    peak_keep: float = 0.8
    target_faces: int = 100_000
    simplify_degrees: float = 0.02
    star_radius_mm: float = 4.0
    star_inner: float = 0.45
    star_points: int = 4
    star_height_mm: float = 2.0
    global_scale: float = 0.33
    lake_min_km2: float = 100.0
    merged_lake_min_km2: float = 50.0
    island_min_km2: float = 900.0
    bridge_width_km: float = 25.0
    bridge_max_km: float = 275.0
    bridge_height_mm: float = 1.5
    km_per_degree: float = 111.0
    min_ring_points: int = 10
    max_missing_pct: float = 5.0
    stair_threshold: float = 0.15
    smooth_threshold: float = 0.5
    border_km: float = 50.0

    def with_(self, **changes) -> Params:
        return replace(self, **changes)


DEFAULT = Params()
