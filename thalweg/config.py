"""Settings of a watershed run."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed values that shape results.
PIXELS_PER_DEGREE = 1200
HALF_PIXEL = 0.000416667
PIXEL_AREA_DEG2 = 6.95e-7
SLIVER_DEGREES = 1e-5
SEARCH_STEP = 0.01
MAX_SEARCH_DIST = 0.25


@dataclass(frozen=True)
class Settings:
    """One immutable value per run; invalid combinations never get past construction."""

    high_res: bool = True
    low_res_threshold: float = 50_000.0
    search_dist: float = 0.0
    fill: bool = True
    fill_threshold: int = 100
    simplify: bool = False
    simplify_tolerance: float = 0.0008
    match_areas: bool = False
    area_matching_threshold: float = 0.25
    max_dist: float = 0.075
    threshold_single: int = 500
    threshold_multiple: int = 5000
    num_stream_orders: int = 3
    output_dir: str = "output"
    output_ext: str = "geojson"
    output_csv: bool = True
    make_map: bool = True
    map_folder: str = "map"
    map_rivers: bool = True

    def __post_init__(self) -> None:
        if isinstance(self.search_dist, bool) or not isinstance(self.search_dist, (int, float)):
            raise TypeError(f"search_dist must be a number, got {self.search_dist!r}")
        if not 0 <= self.search_dist <= MAX_SEARCH_DIST:
            raise ValueError(f"search_dist is in degrees and must lie in [0, {MAX_SEARCH_DIST}], got {self.search_dist}")

    def search_ladder(self) -> list[float]:
        """Half-widths of the growing search box: one step at a time, the last one being the first past max_dist."""
        steps, width = [SEARCH_STEP], SEARCH_STEP
        while width <= self.max_dist:
            width += SEARCH_STEP
            steps.append(width)
        return steps

    def fill_area(self) -> float:
        """The hole size limit in square degrees."""
        return self.fill_threshold * PIXEL_AREA_DEG2
