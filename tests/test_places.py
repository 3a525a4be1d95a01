"""Nearest places against brute force: copies, poles, the date line, dense clusters."""

import numpy as np
import pytest

from wattloom.operators import geography


def brute(a, b, k):
    out = set()
    for name, lat, lon in a:
        ranked = sorted(
            (round((1 - np.cos(np.radians(lat - y))) / 2 + (1 - np.cos(np.radians(lon - x))) / 2 * np.cos(np.radians(lat)) * np.cos(np.radians(y)), 12), n)
            for n, y, x in b
        )
        out |= {(name, n, i + 1) for i, (_, n) in enumerate(ranked[:k])}
    return out


def points(rng, prefix, n, spread):
    lat = np.clip(rng.normal(45, spread, n), -90, 90).round(3)
    lon = rng.normal(2, spread, n).round(3)
    return [(f"{prefix}{i:03d}", float(y), float((x + 180) % 360 - 180)) for i, (y, x) in enumerate(zip(lat, lon))]


@pytest.mark.parametrize("k", [1, 4, None])
def test_against_brute_force(spark, k):
    rng = np.random.default_rng(1)
    b = points(rng, "b", 60, 20) + [(f"copy{i:02d}", 45.0, 2.0) for i in range(40)]
    b += [(f"dense{i:02d}", 10 + i * 1e-4, 20.0) for i in range(30)]
    b += [("north", 90.0, 0.0), ("east", 0.0, 179.99), ("west", 0.0, -179.99)]
    a = points(rng, "a", 25, 60) + [("same", 45.0, 2.0), ("pole", 89.9, 170.0), ("line", 0.1, -180.0), ("near", 10.0005, 20.0)]
    schema = "name string, latitude double, longitude double"
    got = geography.rank_by_distance(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), k)
    assert {(r.name_a, r.name_b, r["rank"]) for r in got.collect()} == brute(a, b, k or len(b))


def test_fewer_places_than_k(spark):
    schema = "name string, latitude double, longitude double"
    a = spark.createDataFrame([("a", 1.0, 1.0)], schema)
    b = spark.createDataFrame([("x", 50.0, 100.0), ("y", -50.0, -100.0)], schema)
    assert geography.rank_by_distance(a, b, 5).count() == 2


def test_zone_search_order(spark):
    sites = spark.createDataFrame([("s1",), ("s2",)], "site string")
    one = spark.createDataFrame([("s1", "north"), ("s2", "south")], "site string, region string")
    two = spark.createDataFrame([("s1", "all"), ("s2", "all")], "site string, region string")
    assert geography.sites_of_zone(sites, [one, two], "all").count() == 2
    assert geography.sites_of_zone(sites, [one, two], "south").first().site == "s2"
    with pytest.raises(ValueError):
        geography.sites_of_zone(sites, [one, two], "west")
