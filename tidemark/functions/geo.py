"""Geographic expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


_A, _F = 6378137.0, 1 / 298.257223563  # WGS84
_N = _F / (2 - _F)
_RADIUS, _SCALE, _EAST = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64), 0.9996, 500000.0
# Krueger's series to the third order, forward, backward, and from conformal to geographic latitude.
_ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240]
_BETA = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480]
_DELTA = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15]


def _atanh(v: Column) -> Column:
    return 0.5 * F.log((1 + v) / (1 - v))


def utm(lon: Column, lat: Column, central: float = 123.0) -> Column:
    """struct(x, y) in metres: transverse Mercator on the WGS84 ellipsoid by Krueger's series, northern hemisphere."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = F.radians(lat), F.radians(lon - central)
    t = F.sinh(_atanh(F.sin(phi)) - e * _atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), _atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, k in enumerate(_ALPHA, 1):
        x = x + k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((_EAST + _SCALE * _RADIUS * x).alias("x"), (_SCALE * _RADIUS * y).alias("y"))


def utm_arrays(lon: np.ndarray, lat: np.ndarray, central: float = 123.0) -> tuple[np.ndarray, np.ndarray]:
    """x, y in metres as utm() gives them, for arrays inside a task: as an expression over the points of a line, the series is
    evaluated anew wherever Spark puts it, and so in every filter that it infers."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = np.radians(lat), np.radians(lon - central)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    x, y = eta.copy(), xi.copy()
    for j, k in enumerate(_ALPHA, 1):
        x += k * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        y += k * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return _EAST + _SCALE * _RADIUS * x, _SCALE * _RADIUS * y


def utm_inverse(x: Column, y: Column, central: float = 123.0) -> Column:
    """struct(x, y) in degrees (longitude, latitude) of metres as utm() gives them; the way there and back errs by less than a millimetre."""
    xi, eta = y / (_SCALE * _RADIUS), (x - _EAST) / (_SCALE * _RADIUS)
    a, b = xi, eta
    for j, k in enumerate(_BETA, 1):
        a = a - k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for j, k in enumerate(_DELTA, 1):
        lat = lat + k * F.sin(2 * j * chi)
    return F.struct((F.degrees(F.atan2(F.sinh(b), F.cos(a))) + central).alias("x"), F.degrees(lat).alias("y"))


def utm_inverse_arrays(x: np.ndarray, y: np.ndarray, central: float = 123.0) -> tuple[np.ndarray, np.ndarray]:
    """Degrees as utm_inverse() gives them, for arrays inside a task."""
    xi, eta = y / (_SCALE * _RADIUS), (x - _EAST) / (_SCALE * _RADIUS)
    a, b = xi.copy(), eta.copy()
    for j, k in enumerate(_BETA, 1):
        a -= k * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        b -= k * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    chi = np.arcsin(np.sin(a) / np.cosh(b))
    lat = chi.copy()
    for j, k in enumerate(_DELTA, 1):
        lat += k * np.sin(2 * j * chi)
    return np.degrees(np.arctan2(np.sinh(b), np.cos(a))) + central, np.degrees(lat)


def rounded(coords: Column, digits: int = 5) -> Column:
    """An array of struct(x, y) with rounded coordinates."""
    return F.transform(coords, lambda c: F.struct(F.round(c["x"], digits).alias("x"), F.round(c["y"], digits).alias("y")))


def corridor_steps(lon1: Column, lat1: Column, lon2: Column, lat2: Column, step_m: float = 350.0) -> Column:
    """Steps of about ``step_m`` along a line, from 2 to 120."""
    return F.least(F.lit(120), F.greatest(F.lit(2), F.ceil(haversine_km(lat1, lon1, lat2, lon2) * 1000 / step_m))).cast("int")
