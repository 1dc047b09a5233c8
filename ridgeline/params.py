"""Query parameters with their defaults."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Grid:
    rows: int
    cols: int
    cell_m: float = 25.0
    origin_e: float = 0.0
    origin_n: float = 0.0


@dataclass(frozen=True)
class Wind:
    """Direction the wind comes from, in degrees."""

    from_deg: float = 180.0
    speed_kmh: float = 8.0


@dataclass(frozen=True)
class Discovery:
    slope_min: float = 22.0
    slope_max: float = 38.0
    max_roughness_m: float = 1.5
    arc: tuple[float, float] = (90.0, 270.0)
    arc_half_width: float = 45.0
    dedupe_radius_m: float = 100.0
    max_launches: int = 200


@dataclass(frozen=True)
class Glide:
    ratio: float = 8.0
    buffer_m: float = 15.0
    takeoff_agl_m: float = 10.0
    airspeed_ms: float = 10.0
    wind: Wind | None = None


@dataclass(frozen=True)
class Hike:
    sac: str = "T2"
    max_seconds: float = 6.0 * 3600


@dataclass(frozen=True)
class Scoring:
    metric: str = "distance"  # anything but "area" is distance
    alpha: float = 1.0
    full_strength_deg: float = 15.0
