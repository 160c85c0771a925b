"""Radius and nearest-neighbour search around one point, by great-circle distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.functions.geo import EARTH_KM, haversine_km, valid_point

#: Kilometres of a degree in the narrow box of ``mode="strict_box"`` (a fixed value of that mode).
STRICT_KM_PER_DEGREE = 111.32
DISTANCE = "__km"


def _center_ok(lon0: float, lat0: float) -> bool:
    return math.isfinite(lon0) and math.isfinite(lat0) and abs(lon0) <= 180 and abs(lat0) <= 90


def box(lon: Column, lat: Column, lon0: float, lat0: float, km: float) -> Column:
    """A box that surely holds the circle, for pruning: around the poles and the 180th meridian too."""
    angle = km / EARTH_KM
    dlat = math.degrees(angle) + 1e-9
    inside = lat.between(lat0 - dlat, lat0 + dlat)
    if angle >= math.pi / 2 or abs(lat0) + dlat >= 90:
        return inside
    dlon = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat0))))) + 1e-9
    west, east = lon0 - dlon, lon0 + dlon
    if west < -180:
        return inside & ((lon >= west + 360) | (lon <= east))
    if east > 180:
        return inside & ((lon >= west) | (lon <= east - 360))
    return inside & lon.between(west, east)


def strict_box(lon: Column, lat: Column, lon0: float, lat0: float, km: float) -> Column:
    """The narrow box without wrapping that ``mode="strict_box"`` asks for; it can lose points of the circle."""
    dlat = km / STRICT_KM_PER_DEGREE
    dlon = km / (STRICT_KM_PER_DEGREE * max(math.cos(math.radians(lat0)), 1e-12))
    return lon.between(lon0 - dlon, lon0 + dlon) & lat.between(lat0 - dlat, lat0 + dlat)


def radius(df: DataFrame, lon: str, lat: str, lon0: float, lat0: float, km: float, ties: list[str], mode: str = "circle", keep: bool = False) -> DataFrame:
    """Rows at most ``km`` away, nearest first (``ties`` break ties). A null or invalid place is never near."""
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    if not _center_ok(lon0, lat0) or not km >= 0:
        found = df.filter(F.lit(False)).withColumn(DISTANCE, F.lit(0.0))
    else:
        d = df.filter(valid_point(y, x)).filter((box if mode == "circle" else strict_box)(x, y, lon0, lat0, km))
        found = d.withColumn(DISTANCE, haversine_km(y, x, F.lit(lat0), F.lit(lon0))).filter(F.col(DISTANCE) <= km)
    found = found.orderBy(DISTANCE, *ties)
    return found if keep else found.drop(DISTANCE)


def nearest(df: DataFrame, lon: str, lat: str, lon0: float, lat0: float, k: int, ties: list[str], keep: bool = False) -> DataFrame:
    """The ``k`` nearest rows; each task keeps its best ``k``, so nothing else is sorted or shuffled."""
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    d = df.filter(valid_point(y, x)) if _center_ok(lon0, lat0) else df.filter(F.lit(False))
    found = d.withColumn(DISTANCE, haversine_km(y, x, F.lit(lat0), F.lit(lon0))).orderBy(DISTANCE, *ties).limit(k)
    return found if keep else found.drop(DISTANCE)


def place_key(name: Column, country: Column) -> Column:
    return F.concat_ws("_", F.coalesce(name, F.lit("Unknown")), F.coalesce(country, F.lit("Unknown")))
