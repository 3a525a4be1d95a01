"""Distances between points given in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_versine(angle: Column) -> Column:
    return (1 - F.cos(angle)) / 2


def haversine_term(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Increases with the great-circle distance; equals a quarter of the squared chord."""
    a, b = F.radians(lat_a), F.radians(lat_b)
    return half_versine(a - b) + half_versine(F.radians(lon_a) - F.radians(lon_b)) * F.cos(a) * F.cos(b)


def unit_vector(lat: Column, lon: Column) -> list[Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    return [F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)]
