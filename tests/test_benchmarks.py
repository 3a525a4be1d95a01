"""Vectors of the benchmark models."""

import datetime as dt

from wattloom.operators import benchmarks

INPUTS = "name_input string, transformation string, parameter string, location string, split string, ts timestamp, value double"


def test_sites_without_assigned_inputs_keep_the_shared_ones(spark):
    times = [dt.datetime(2024, 1, 1, h) for h in range(3)]
    rows = [("hour", "", "", "", "training", t, float(t.hour)) for t in times]
    rows += [("x", "", "", "p", "training", t, 10.0 + t.hour) for t in times[:2]]
    inputs = spark.createDataFrame(rows, INPUTS)
    target = spark.createDataFrame([(s, t, 1.0) for s in "ab" for t in times], "site string, ts timestamp, value double")
    assignment = spark.createDataFrame([("a", "x", "p")], "site string, name_input string, location string")
    got = {(r.site, r.ts.hour): r.features.toArray().tolist() for r in benchmarks.site_vectors(inputs, target, assignment).collect()}
    assert got == {("a", 0): [0.0, 10.0], ("a", 1): [1.0, 11.0], ("b", 0): [0.0], ("b", 1): [1.0], ("b", 2): [2.0]}
    # with nobody assigned, x is an input of all; it has no third hour
    free = benchmarks.site_vectors(inputs, target, assignment.where("1 = 0")).collect()
    assert sorted((r.site, r.ts.hour, r.features.size) for r in free) == [(s, h, 2) for s in "ab" for h in (0, 1)]
