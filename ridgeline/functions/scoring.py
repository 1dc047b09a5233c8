"""Times, wind factors, scores and parameter buckets as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions.geo import angle_diff_deg, norm_deg
from ridgeline.params import Glide, Scoring

#: Multiplier on hiking time by class of path.
SAC_MULTIPLIER = {"T1": 1.0, "T2": 1.2, "T3": 1.5, "T4": 2.0, "T5": 3.0}
#: The eight moves on a grid: rows, columns, length in cells.
MOVES = [(dr, dc, math.hypot(dr, dc)) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]


def tobler_kmh(slope: Column) -> Column:
    """Walking speed for a slope given as a fraction."""
    return 6 * F.exp(-3.5 * F.abs(slope + 0.05))


def edge_seconds(z_from: Column, z_to: Column, length_m: Column, multiplier: float) -> Column:
    speed = F.greatest(tobler_kmh((z_to - z_from) / length_m), F.lit(0.05))
    return length_m / (speed / 3.6) * multiplier


def signpost_seconds(length_m: Column, climb_m: Column, multiplier: float = 1.0) -> Column:
    flat = length_m / 4000
    steep = F.when(climb_m > 0, climb_m / 400).otherwise(-climb_m / 600)
    return (F.greatest(flat, steep) + F.least(flat, steep) / 2) * 3600 * multiplier


def wind_factor(aspect: Column, wind_from: Column, full: float = 15.0) -> Column:
    beyond = F.abs(angle_diff_deg(aspect, wind_from)) - full
    return F.when(beyond <= 0, 1.0).when(beyond >= 90, 0.0).otherwise(F.greatest(F.lit(0.0), F.cos(F.radians(beyond))))


def launch_score(distance_m: Column, area_m2: Column, hike_s: Column, factor: Column, p: Scoring = Scoring()) -> Column:
    """Reach over hiking time; an unreached launch has infinite time. What isn't finite becomes 0."""
    value = area_m2 if p.metric == "area" else distance_m
    score = F.try_divide(value.cast("double"), F.pow(F.greatest(hike_s, F.lit(1.0)), F.lit(float(p.alpha)))) * factor
    return F.when(F.isnan(score) | (F.abs(score) == float("inf")), 0.0).otherwise(F.coalesce(score, F.lit(0.0)))


def ground_ratios(p: Glide) -> list[tuple[int, int, float, float]]:
    """(rows, columns, length, glide ratio over ground) of the moves that the wind lets through."""
    sink = max(0.01, p.airspeed_ms / max(p.ratio, 0.1))
    speed = p.wind.speed_kmh / 3.6 if p.wind and p.wind.speed_kmh > 0 else 0.0
    to = math.radians(p.wind.from_deg + 180) if speed else 0.0
    out = []
    for dr, dc, length in MOVES:
        ground = p.airspeed_ms + (speed * math.cos(math.atan2(dc, -dr) - to) if speed else 0.0)
        if ground >= 0.5:
            out.append((dr, dc, length, ground / sink))
    return out


def bucket(ratio: Column, wind_from: Column, speed_kmh: Column) -> tuple[Column, Column, Column]:
    """Keys of the flood cache: glide ratio in halves, direction in tens, speed in twos; still air is -1, -1."""
    gr = (F.round(F.least(F.greatest(ratio, F.lit(2.0)), F.lit(20.0)) * 2)).cast("int")
    windy = speed_kmh > 0.5
    direction = F.when(windy, F.floor(norm_deg(wind_from) / 10) * 10).otherwise(-1)
    return gr, direction.cast("int"), F.when(windy, F.floor(speed_kmh / 2) * 2).otherwise(-1).cast("int")
