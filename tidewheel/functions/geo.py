"""Distances and bearings on the globe; the sphere natively, the ellipsoid as an Arrow-batched function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, DoubleType

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in km."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial spherical bearing in (0, 360]; due north is 360."""
    d = F.radians(lon2) - F.radians(lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    b = F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))
    return F.when(b == 0, F.lit(360.0)).otherwise(b)


def vincenty(lat1, lon1, lat2, lon2, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Kilometres and initial azimuth in (0, 360] on WGS84, vectorised; NaN where the iteration doesn't settle."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    p1, p2, l = np.radians(lat1), np.radians(lat2), np.radians(np.asarray(lon2) - np.asarray(lon1))
    u1, u2 = np.arctan((1 - f) * np.tan(p1)), np.arctan((1 - f) * np.tan(p2))
    lam, done = l.copy(), np.zeros(l.shape, bool)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            s, c = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(np.cos(u2) * s, np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * c)
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * c
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s > 0, np.cos(u1) * np.cos(u2) * s / np.where(sin_s > 0, sin_s, 1), 0)
            cos2a = 1 - sin_a**2
            cos_m = np.where(cos2a > 1e-15, cos_s - 2 * np.sin(u1) * np.sin(u2) / np.where(cos2a > 1e-15, cos2a, 1), 0)
            k = f / 16 * cos2a * (4 + f * (4 - 3 * cos2a))
            new = l + (1 - k) * f * sin_a * (sigma + k * sin_s * (cos_m + k * cos_s * (2 * cos_m**2 - 1)))
            done |= np.abs(new - lam) < 1e-12
            lam = new
            if done.all():
                break
        u = cos2a * (a**2 - b**2) / b**2
        big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        d = big_b * sin_s * (cos_m + big_b / 4 * (cos_s * (2 * cos_m**2 - 1) - big_b / 6 * cos_m * (4 * sin_s**2 - 3) * (4 * cos_m**2 - 3)))
        km = b * big_a * (sigma - d) / 1000
        az = np.degrees(np.arctan2(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))) % 360
    return np.where(done, km, np.nan), np.where(done, np.where(az == 0, 360.0, az), np.nan)


@F.pandas_udf(StructType([StructField("km", DoubleType()), StructField("azimuth", DoubleType())]))
def geodesic(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.DataFrame:
    """km and azimuth between two points of the WGS84 ellipsoid."""
    km, az = vincenty(*(s.to_numpy(float) for s in (lat1, lon1, lat2, lon2)))
    return pd.DataFrame({"km": km, "azimuth": az})
