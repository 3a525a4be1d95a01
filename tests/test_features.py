"""Hat rule, interactions, Gram matrix and masks against a restatement in numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators import features, stats
from wattloom.operators.features import Factor, Term

INPUTS = "name_input string, transformation string, parameter string, location string, split string, ts timestamp, value double"


def hat(x, low, high, n):
    """Node triplets, one function at a time."""
    out = np.zeros((len(x), n + 1))
    for i in range(n + 1):
        a, c, e = (low + (i + d) / n * (high - low) for d in (-1, 0, 1))
        if a == e:
            c, e = a + 1, a + 2
        f2, f3 = (x - a) / (c - a), (x - e) / (c - e)
        if i == 0:
            out[:, i] = np.maximum(f3, 0)
        elif i == 1:
            out[:, i] = np.maximum(np.minimum(f2, f3), np.minimum(0, f2))
        else:
            out[:, i] = np.maximum(np.minimum(f2, f3), 0)
    return out


def cyclic_hat(x, period, n):
    out = np.zeros((len(x), n))
    nodes = np.arange(n) / n * period
    for i in range(n):
        a, c, e = nodes[i], nodes[(i + 1) % n], nodes[(i + 2) % n]
        z = x + (x <= a) * period
        c, e = c + (c <= a) * period, e + (e <= a) * period
        out[:, i] = np.maximum(np.minimum((z - a) / (c - a), (z - e) / (c - e)), 0)
    return out


def frame(spark, columns: dict, train: int):
    from datetime import datetime, timedelta

    rows = []
    for name, values in columns.items():
        for i, v in enumerate(values):
            rows.append((name, "", "", "", "training" if i < train else "validation", datetime(2024, 1, 1) + timedelta(hours=i), float(v)))
    return spark.createDataFrame(rows, INPUTS)


def dense(design, size, n, block="t00@"):
    got = np.zeros((n, size))
    coo = features.coordinates(design).filter(F.col("block") == block)
    for r in coo.select(F.hour("ts").alias("h"), F.dayofmonth("ts").alias("d"), "idx", "value").collect():
        got[(r.d - 1) * 24 + r.h, r.idx] = r.value
    return got


def site(spark):
    return spark.createDataFrame([("s",)], "site string")


X = np.array([0.0, 1.0, 2.5, 3.3, 4.0, 9.99, 10.0, 7.5, -1.0, -4.0, 10.5, 12.0, 14.0])


@pytest.mark.parametrize("n", [1, 2, 4, 16])
def test_hats_inside_and_outside(spark, n):
    d = features.design(frame(spark, {"x": X}, 8), [Term((Factor("x", n),))], site(spark))
    want = hat(X, 0.0, 10.0, n)
    np.testing.assert_allclose(dense(d, n + 1, len(X)), want, atol=1e-12)
    np.testing.assert_allclose(want[:8].sum(axis=1), 1)


def test_constant_training_input(spark):
    x = np.array([3.0, 3.0, 3.0, 3.4, 2.0, 6.0])
    d = features.design(frame(spark, {"x": x}, 3), [Term((Factor("x", 4),))], site(spark))
    np.testing.assert_allclose(dense(d, 5, len(x)), hat(x, 3.0, 3.0, 4), atol=1e-12)


@pytest.mark.parametrize("name,period,n,x", [
    ("hour", 24, 8, np.arange(24.0)), ("year_day", 365, 128, np.array([1.0, 2, 180, 364, 365, 366])), ("week_hour", 168, 168, np.arange(0.0, 168, 7)),
])
def test_cyclic_hats(spark, name, period, n, x):
    d = features.design(frame(spark, {name: x}, len(x)), [Term((Factor(name, n),))], site(spark))
    want = cyclic_hat(x, period, n)
    np.testing.assert_allclose(dense(d, n, len(x)), want, atol=1e-12)
    if name == "year_day":
        assert want[-1].sum() == pytest.approx(0.649, abs=1e-3)


@pytest.mark.parametrize("combine", ["product", "minimum"])
def test_interactions(spark, combine):
    y = np.array([5.0, 0, 1, 2, 3, 4, 5, 2.2, -2, 1, 1, -3, 6])
    d = features.design(frame(spark, {"x": X, "y": y}, 8), [Term((Factor("x", 3), Factor("y", 2)))], site(spark), None, combine)
    a, b = hat(X, 0, 10, 3), hat(y, 0, 5, 2)
    pairs = np.minimum(a[:, :, None], b[:, None, :]) if combine == "minimum" else a[:, :, None] * b[:, None, :]
    np.testing.assert_allclose(dense(d, 12, len(X), "t00@|"), pairs.reshape(len(X), -1), atol=1e-12)


def test_powers(spark):
    d = features.design(frame(spark, {"x": X}, 8), [Term((Factor("x", "p3"),))], site(spark))
    np.testing.assert_allclose(dense(d, 3, len(X)), np.column_stack([X, X**2, X**3]))


def test_gram_is_the_matrix_product(spark):
    formula = [Term((Factor("x", 4),)), Term((Factor("hour", 6),)), Term((Factor("x", 2), Factor("hour", 6)))]
    hours = np.arange(len(X)) * 1.7 % 24
    d = features.design(frame(spark, {"x": X, "hour": hours}, len(X)), formula, site(spark))
    a, b, c = hat(X, -4, 14, 4), cyclic_hat(hours, 24, 6), hat(X, -4, 14, 2)
    x = np.hstack([a, b, (c[:, :, None] * b[:, None, :]).reshape(len(X), -1)])
    start = {"t00@": 0, "t01@": 5, "t02@|": 11}
    got = np.zeros((x.shape[1], x.shape[1]))
    for r in stats.symmetric(stats.gram(d)).collect():
        got[start[r.block1] + r.idx1, start[r.block2] + r.idx2] += r.value
    np.testing.assert_allclose(got, x.T @ x, atol=1e-10)


def test_sites_with_equal_locations_share_a_design(spark):
    sites = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "site string")
    assignment = spark.createDataFrame([("a", "x", "l1"), ("b", "x", "l1"), ("c", "x", "l2")], "site string, name_input string, location string")
    by_site, owned = features.signatures(sites, assignment)
    sig = {r.site: r.sig for r in by_site.collect()}
    assert sig["a"] == sig["b"] != sig["c"] and sig["d"] == "all"
    assert owned.count() == 2


def test_gram_of_parts_is_the_gram_of_each_design(spark):
    """Shared, assigned and doubly assigned terms; sites with one, two and no locations of their own."""
    rng = np.random.default_rng(12)
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(60)]
    places = {"hour": [""], "x": ["p", "q", "r"], "y": ["a", "b", "c"]}
    rows = [(name, "", "", place, "training" if i < 48 else "validation", t, float(i % 24) if name == "hour" else float(rng.normal()))
            for name, at in places.items() for place in at for i, t in enumerate(times)]
    inputs = spark.createDataFrame(rows, INPUTS)
    sites = spark.createDataFrame([(s,) for s in "abcd"], "site string")
    owned = [("a", "x", "p"), ("a", "x", "q"), ("b", "x", "q"), ("c", "x", "r"), ("a", "y", "a"), ("b", "y", "b"), ("c", "y", "c")]
    assignment = spark.createDataFrame(owned, "site string, name_input string, location string")
    formula = [Term((Factor("hour", 4),)), Term((Factor("x", 2),)), Term((Factor("y", "p2"),)), Term((Factor("x", 2), Factor("hour", 4))),
               Term((Factor("x", 2), Factor("y", "p1"))), Term((Factor("x", "p1"), Factor("x", 2)))]
    design = features.design(inputs, formula, sites, assignment).filter("split = 'training'")
    part_rows, units = features.parts(inputs, formula, sites, assignment)
    half = stats.gram_of_parts(part_rows.filter("split = 'training'"), units)
    place = ["sig", "block1", "idx1", "block2", "idx2"]
    got = stats.of_designs(half, units).toPandas().set_index(place).value
    want = stats.gram(design).toPandas().set_index(place).value
    assert got.index.is_unique and set(got.index) == set(want.index)
    np.testing.assert_allclose(got[want.index], want, atol=1e-9)
    shared = part_rows.filter("unit = ''")
    assert shared.count() == 60 and half.filter("unit1 = '' AND unit2 = ''").count() == 8


def test_parts_without_assignment_are_one_unit(spark):
    d = frame(spark, {"x": X}, 8)
    rows, units = features.parts(d, [Term((Factor("x", 3),))], site(spark))
    half = stats.of_designs(stats.gram_of_parts(rows, units), units).toPandas()
    want = stats.gram(features.design(d, [Term((Factor("x", 3),))], site(spark))).toPandas()
    place = ["sig", "block1", "idx1", "block2", "idx2"]
    np.testing.assert_allclose(half.set_index(place).value.sort_index(), want.set_index(place).value.sort_index())
