"""Coordinates: Web Mercator, a metric grid, geodesic lengths and tile arithmetic."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# WGS 84 axis and flattening, the mean radius, and the Bessel 1841 ellipsoid and Krovak cone of the national grid.
RADIUS, FLATTENING, MEAN_RADIUS = 6378137.0, 1 / 298.257223563, 6371008.8
BESSEL_AXIS, BESSEL_E2 = 6377397.155, 0.006674372230614
CONE_LATITUDE, CONE_AXIS, CONE_PARALLEL, CONE_SCALE, CONE_MERIDIAN = 49.5, 30.28813975277778, 78.5, 0.9999, 42.5 - 17.666666666666668
WORLD = 2 * math.pi * RADIUS


def longitude(x: Column) -> Column:
    return F.degrees(x / RADIUS)


def latitude(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)


def tile_envelope(z: Column, x: Column, y: Column) -> Column:
    """Bounds of a tile in Web Mercator metres."""
    size = F.lit(WORLD) / F.pow(F.lit(2.0), z)
    left, top = x * size - WORLD / 2, F.lit(WORLD / 2) - y * size
    return F.struct(left.alias("xmin"), (top - size).alias("ymin"), (left + size).alias("xmax"), top.alias("ymax"))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres on the mean sphere: up to about half a percent off the spheroid."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * MEAN_RADIUS * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def haversine_length(way: Column) -> Column:
    """Fast length of a Web Mercator line; 0 for fewer than two points, null for null."""
    def leg(i: Column) -> Column:
        p, q = F.get(way, i), F.get(way, i + 1)
        return haversine(longitude(p["x"]), latitude(p["y"]), longitude(q["x"]), latitude(q["y"]))

    legs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(way) - 2, F.lit(0))), leg)
    return F.when(way.isNull(), F.lit(None).cast("double")).when(F.size(way) < 2, 0.0).otherwise(F.aggregate(legs, F.lit(0.0), lambda a, b: a + b))


def vincenty(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Geodesic metres on the spheroid, in degrees: the inverse iteration of Vincenty (1975), all pairs at once."""
    f, b = FLATTENING, RADIUS * (1 - FLATTENING)
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    diff = np.radians(lon2 - lon1)
    lam = diff.copy()
    for _ in range(60):
        sin_s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
        cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
        sigma = np.arctan2(sin_s, cos_s)
        with np.errstate(invalid="ignore", divide="ignore"):
            sin_a = np.where(sin_s > 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / sin_s, 0)
            cos2_a = 1 - sin_a**2
            cos_m = np.where(cos2_a > 1e-15, cos_s - 2 * np.sin(u1) * np.sin(u2) / cos2_a, 0)
        c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
        new = diff + (1 - c) * f * sin_a * (sigma + c * sin_s * (cos_m + c * cos_s * (2 * cos_m**2 - 1)))
        done = np.all(np.abs(new - lam) < 1e-13)
        lam = new
        if done:
            break
    k = cos2_a * (RADIUS**2 - b**2) / b**2
    big_a = 1 + k / 16384 * (4096 + k * (k * (320 - 175 * k) - 768))
    big_b = k / 1024 * (256 + k * (k * (74 - 47 * k) - 128))
    change = big_b * sin_s * (cos_m + big_b / 4 * (cos_s * (2 * cos_m**2 - 1) - big_b / 6 * cos_m * (4 * sin_s**2 - 3) * (4 * cos_m**2 - 3)))
    return b * big_a * (sigma - change)


@F.pandas_udf(T.DoubleType())
def geodesic_length(way: pd.Series) -> pd.Series:
    """Length of each Web Mercator line on the spheroid; 0 for fewer than two points, null for null."""
    out = np.full(len(way), np.nan)
    legs: list[tuple[int, float, float, float, float]] = []
    for i, line in enumerate(way):
        if line is None:
            continue
        out[i] = 0
        points = [(p["x"], p["y"]) for p in line]
        legs += [(i, *p, *q) for p, q in zip(points, points[1:], strict=False)]
    if legs:
        owner, x1, y1, x2, y2 = map(np.array, zip(*legs, strict=True))
        lat = [np.degrees(2 * np.arctan(np.exp(y / RADIUS)) - np.pi / 2) for y in (y1, y2)]
        np.add.at(out, owner, vincenty(np.degrees(x1 / RADIUS), lat[0], np.degrees(x2 / RADIUS), lat[1]))
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def krovak(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eastings and northings of the national metric grid from degrees; the datum shift, a few hundred metres that move
    neighbours alike, is left out, since only distances count."""
    e = math.sqrt(BESSEL_E2)
    phi_c, psi_p, alpha_c = math.radians(CONE_LATITUDE), math.radians(CONE_PARALLEL), math.radians(CONE_AXIS)
    a = BESSEL_AXIS * math.sqrt(1 - BESSEL_E2) / (1 - BESSEL_E2 * math.sin(phi_c) ** 2)
    b = math.sqrt(1 + BESSEL_E2 * math.cos(phi_c) ** 4 / (1 - BESSEL_E2))
    gamma = math.asin(math.sin(phi_c) / b)
    t0 = math.tan(math.pi / 4 + gamma / 2) * ((1 + e * math.sin(phi_c)) / (1 - e * math.sin(phi_c))) ** (e * b / 2) / math.tan(math.pi / 4 + phi_c / 2) ** b
    n, r0 = math.sin(psi_p), CONE_SCALE * a / math.tan(psi_p)
    phi, v = np.radians(lat), b * np.radians(CONE_MERIDIAN - lon)
    u = 2 * (np.arctan(t0 * np.tan(phi / 2 + np.pi / 4) ** b / ((1 + e * np.sin(phi)) / (1 - e * np.sin(phi))) ** (e * b / 2)) - np.pi / 4)
    t = np.arcsin(np.clip(math.cos(alpha_c) * np.sin(u) + math.sin(alpha_c) * np.cos(u) * np.cos(v), -1, 1))
    d = np.arcsin(np.clip(np.cos(u) * np.sin(v) / np.cos(t), -1, 1))
    r = r0 * math.tan(psi_p / 2 + math.pi / 4) ** n / np.tan(t / 2 + np.pi / 4) ** n
    return -r * np.sin(n * d), -r * np.cos(n * d)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
def to_metric(way: pd.Series) -> pd.Series:
    """Web Mercator lines in the metric grid."""
    def one(line: list | None) -> list | None:
        if line is None:
            return None
        x, y = (np.array([p[c] for p in line], float) for c in "xy")
        east, north = krovak(np.degrees(x / RADIUS), np.degrees(2 * np.arctan(np.exp(y / RADIUS)) - np.pi / 2))
        return [{"x": float(a), "y": float(b)} for a, b in zip(east, north, strict=True)]

    return way.map(one)


def bbox(way: Column) -> Column:
    """Bounds of a line; nulls for a null or empty one."""
    xs, ys = F.transform(way, lambda p: p["x"]), F.transform(way, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def overlaps(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmax"]) & (a["xmax"] >= b["xmin"]) & (a["ymin"] <= b["ymax"]) & (a["ymax"] >= b["ymin"])
