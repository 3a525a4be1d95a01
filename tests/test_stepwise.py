"""Hinge models against a stepwise fit by least squares on the columns themselves."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from wattloom.operators import stepwise


def error(columns, y):
    a = np.column_stack([np.ones(len(y)), *columns])
    b = np.linalg.lstsq(a, y, rcond=1e-10)[0]
    return ((y - a @ b) ** 2).sum()


def plain(x, y, knots=3, threshold=1e-3, penalty=3.0):
    """Terms (input, knot, side) of a stepwise fit, every candidate refitted."""
    at = {f: np.sort(x[:, f])[[int(np.ceil((k + 1) / (knots + 1) * len(y))) - 1 for k in range(knots)]] for f in range(x.shape[1])}
    column = {(f, k, s): np.maximum(0, (x[:, f] - at[f][k]) * (1 if s == "up" else -1)) for f in at for k in range(knots) for s in ("up", "down")}
    whole, taken = error([], y), []
    while True:
        now = error([column[t] for t in taken], y)
        gains = {(f, k): (now - error([column[t] for t in taken] + [column[f, k, s] for s in ("up", "down")], y)) / whole
                 for f in at for k in range(knots)}
        best = max(gains, key=gains.get)
        if gains[best] <= threshold:
            break
        rest = {s: error([column[t] for t in taken], column[(*best, s)]) / column[(*best, s)].var() for s in ("up", "down")}
        for s in sorted(rest, key=lambda s: -rest[s]):
            rank = np.linalg.matrix_rank(np.column_stack([np.ones(len(y))] + [column[t] for t in taken]))
            if np.linalg.matrix_rank(np.column_stack([np.ones(len(y))] + [column[t] for t in [*taken, (*best, s)]])) > rank:
                taken.append((*best, s))
    n, found = len(y), None
    while True:
        price = len(taken) + 1 + penalty * len(taken) / 2
        score = error([column[t] for t in taken], y) / (1 - price / n) ** 2 if price < n else np.inf
        if found is None or score <= found[0]:
            found = (score, list(taken))
        if not taken:
            break
        taken.remove(min(taken, key=lambda t: error([column[u] for u in taken if u != t], y)))
    return found[1], column


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_terms_are_those_of_the_plain_fit(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 4))
    y = np.maximum(0, x[:, 0] - 0.6) * 3 - np.abs(x[:, 1]) + 0.3 * x[:, 2] + 0.2 * rng.normal(size=300)
    terms, column = plain(x, y)
    z = np.column_stack([*column.values(), y, np.ones(300)])
    got = stepwise.choose(z.T @ z)
    a = np.column_stack([np.ones(300), *[column[t] for t in terms]])
    want = a @ np.linalg.lstsq(a, y, rcond=None)[0]
    keys = list(column)
    assert z[:, :-2] @ got[:-1] + got[-1] == pytest.approx(want, abs=1e-6)
    assert error([column[keys[i]] for i in np.flatnonzero(got[:-1])], y) == pytest.approx(error([column[t] for t in terms], y))


def test_all_groups_in_one_go(spark):
    rng = np.random.default_rng(9)
    rows = []
    for site in "ab":
        for i in range(200):
            x = [float(rng.integers(0, 24)), float(i % 2), 1.0]
            y = 2.0 * max(0.0, x[0] - 12) + (5.0 if site == "b" else 0.0) * x[1]
            rows.append((site, i, "training" if i < 160 else "validation", y, x))
    rows += [("c", 0, "training", 4.0, [1.0, 1.0, 1.0]), ("d", 0, "validation", 1.0, [1.0, 1.0, 1.0]), ("a", 999, "training", None, [1.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "site string, ts int, split string, target double, x array<double>")
    fitted, model = stepwise.mars(df.withColumn("features", array_to_vector("x")).drop("x"), knots=3)
    got = fitted.toPandas()
    assert set(got["site"]) == {"a", "b", "c"} and len(got) == 402
    assert got.loc[got["site"] == "c", "prediction"].tolist() == [4.0]
    known = got.dropna()
    # knots are quantiles, so the bend is met closely, not exactly
    assert ((known["target"] - known["prediction"]) ** 2).mean() < 0.02 * known["target"].var()
    used = {(r.site, r.input) for r in model.collect() if r.input is not None}
    assert ("b", 1) in used and ("a", 1) not in used and not {u for u in used if u[1] == 2}
    assert model.filter("input IS NULL").count() == 3


def test_empty_table(spark):
    df = spark.createDataFrame([], "site string, split string, target double, x array<double>").withColumn("features", array_to_vector("x")).drop("x")
    fitted, model = stepwise.mars(df)
    assert fitted.count() == 0 and model.count() == 0
