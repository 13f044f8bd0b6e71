"""Nearest match against brute force over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import geo
from panelwright.operators import spatial

NAMES = dict(country="c", left_place=("lat", "lon"), right_place=("r_lat", "r_lon"))


def distance(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(
        math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6378.137 * math.asin(min(1.0, math.sqrt(a)))


def points(seed, n, crowd):
    rng = np.random.default_rng(seed)
    lat, lon = rng.uniform(-89, 89, n), rng.uniform(-180, 180, n)
    if crowd:  # a third of the places sits in one small town
        k = n // 3
        lat[:k], lon[:k] = 50 + rng.normal(size=k) * 0.01, 179.99 + rng.normal(size=k) * 0.01
        lon[lon > 180] -= 360
    country = rng.choice(["A", "B", "C"], n, p=[0.8, 0.15, 0.05])
    return [(i, str(c), float(a), float(o)) for i, (c, a, o) in enumerate(zip(country, lat, lon))]


def brute(left, right, radius=None):
    found = set()
    for i, c, lat, lon in left:
        near = [(distance(lat, lon, b, o), j) for j, d, b, o in right if d == c]
        if near:
            best = min(near)[0]
            if radius is None or best < radius:
                found |= {(i, j) for d, j in near if d <= best * (1 + 1e-12)}
    return found


@pytest.mark.parametrize("leaf", [1, 4, 64, 10_000])
@pytest.mark.parametrize("radius", [None, 200.0])
def test_nearest_equals_brute_force(spark, leaf, radius):
    left, right = points(1, 150, True), points(2, 240, True)
    ldf = spark.createDataFrame(left + [(999, "A", None, 1.0), (998, "Z", 1.0, 1.0)], "id int, c string, lat double, lon double")
    rdf = spark.createDataFrame(right, "rid int, c string, r_lat double, r_lon double")
    out = spatial.nearest_match(ldf, rdf, within_km=radius, leaf_sites=leaf, **NAMES)
    assert {(r["id"], r["rid"]) for r in out.collect()} == brute(left, right, radius)


def test_ties_and_repeated_places_are_kept(spark):
    left = spark.createDataFrame([(1, "A", 10.0, 20.0), (2, "A", 10.0, 20.0)], "id int, c string, lat double, lon double")
    right = spark.createDataFrame(
        [(1, "A", 10.0, 21.0), (2, "A", 10.0, 19.0), (3, "A", 10.0, 19.0), (4, "A", 30.0, 20.0)],
        "rid int, c string, r_lat double, r_lon double",
    )
    out = spatial.nearest_match(left, right, leaf_sites=1, **NAMES).collect()
    assert sorted((r["id"], r["rid"]) for r in out) == [(i, j) for i in (1, 2) for j in (1, 2, 3)]


def test_box_bound_never_exceeds_a_distance(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(400):
        lat, lon = rng.uniform(-90, 90), rng.uniform(-180, 180)
        a, b = np.sort(rng.uniform(-90, 90, 2)), np.sort(rng.uniform(-180, 180, 2))
        rows.append(tuple(map(float, (lat, lon, a[0], a[1], b[0], b[1], rng.uniform(*a), rng.uniform(*b)))))
    df = spark.createDataFrame(rows, "lat double, lon double, a0 double, a1 double, o0 double, o1 double, p double, q double")
    c = F.col
    gap = geo.haversine_km(c("lat"), c("lon"), c("p"), c("q")) - geo.box_lower_bound_km(
        *map(c, ("lat", "lon", "a0", "a1", "o0", "o1")))
    assert df.agg(F.min(gap)).first()[0] >= -1e-9
