"""Ellipsoidal Albers equal-area projection after Snyder, "Map Projections: A Working Manual" (1987).

The parameters are those of EPSG:5070. NAD83 and WGS84 are taken as the same datum.
"""

from __future__ import annotations

import numpy as np

# GRS80 ellipsoid and the parameters of EPSG:5070 in degrees.
SEMI_MAJOR = 6378137.0
FLATTENING = 1.0 / 298.257222101
PARALLEL_1, PARALLEL_2, ORIGIN_LAT, ORIGIN_LON = 29.5, 45.5, 23.0, -96.0
SRIDS = (4326, 5070)

_E2 = FLATTENING * (2.0 - FLATTENING)
_E = np.sqrt(_E2)


def _q(lat):
    sin = np.sin(lat)
    return (1 - _E2) * (sin / (1 - _E2 * sin**2) - np.log((1 - _E * sin) / (1 + _E * sin)) / (2 * _E))


def _m(lat):
    return np.cos(lat) / np.sqrt(1 - _E2 * np.sin(lat) ** 2)


_P1, _P2, _LAT0, _LON0 = np.radians([PARALLEL_1, PARALLEL_2, ORIGIN_LAT, ORIGIN_LON])
_N = (_m(_P1) ** 2 - _m(_P2) ** 2) / (_q(_P2) - _q(_P1))
_C = _m(_P1) ** 2 + _N * _q(_P1)
_RHO0 = SEMI_MAJOR * np.sqrt(_C - _N * _q(_LAT0)) / _N


def to_albers(lonlat: np.ndarray) -> np.ndarray:
    """Degrees (longitude, latitude) to metres."""
    lon, lat = np.radians(lonlat).T
    rho = SEMI_MAJOR * np.sqrt(_C - _N * _q(lat)) / _N
    theta = _N * (lon - _LON0)
    return np.column_stack([rho * np.sin(theta), _RHO0 - rho * np.cos(theta)])


def from_albers(xy: np.ndarray) -> np.ndarray:
    """Metres to degrees (longitude, latitude), by Newton steps on the authalic function."""
    x, y = np.asarray(xy, dtype=float).T
    rho = np.hypot(x, _RHO0 - y)
    q = (_C - (rho * _N / SEMI_MAJOR) ** 2) / _N
    lat = np.arcsin(np.clip(q / 2, -1, 1))
    for _ in range(8):
        lat = lat + (q - _q(lat)) / (2 * (1 - _E2) * np.cos(lat) / (1 - _E2 * np.sin(lat) ** 2) ** 2)
    lon = _LON0 + np.arctan2(x, _RHO0 - y) / _N
    return np.degrees(np.column_stack([lon, lat]))


def reproject(points: np.ndarray, source: int, target: int) -> np.ndarray:
    if source not in SRIDS or target not in SRIDS:
        raise ValueError(f"unsupported SRID pair {source}, {target}")
    if source == target:
        return points
    return to_albers(points) if target == 5070 else from_albers(points)
