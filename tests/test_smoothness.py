"""Strengths chosen by generalised cross-validation against fits of all strengths on the rows themselves."""

import datetime as dt
from itertools import product

import numpy as np
import pytest

from wattloom.operators import features, fit, smoothness, solve
from wattloom.operators.features import Factor, Term

RNG = np.random.default_rng(21)
GRID = [10.0**k for k in range(-6, 2)]


def plain_score(x, y, q):
    """Mean squares over (1 - trace of the hat matrix / n)^2, by the rows."""
    n = len(y)
    hat = x @ np.linalg.pinv(x.T @ x / n + q) @ x.T / n
    return np.mean((y - hat @ y) ** 2) / (1 - np.trace(hat) / n) ** 2


def test_scores_of_a_singular_design_are_those_of_the_rows():
    x = RNG.normal(size=(60, 5))
    x = np.hstack([x, x[:, :2].sum(axis=1, keepdims=True)])
    y = x @ RNG.normal(size=6) + RNG.normal(size=60)
    d = solve.second_difference(6)
    q, fixed = d.T @ d, 0.02 * np.diag([1.0, 0, 0, 1, 0, 0])
    squares, edf = smoothness.scores(x.T @ x / 60, x.T @ y / 60, y @ y / 60, fixed, q, np.array(GRID))
    got = smoothness.criterion(squares, edf, 60)
    np.testing.assert_allclose(got, [plain_score(x, y, fixed + t * q) for t in GRID], rtol=1e-8)


def test_chosen_fit_per_site(spark):
    """Sites of different roughness choose different strengths; no other place on the grid is better."""
    n = 24 * 12
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(n)]
    hours, trend = np.arange(n) % 24, np.linspace(0, 1, n)
    inputs = spark.createDataFrame(
        [(name, "", "", "", "training", t, float(v)) for name, values in (("hour", hours), ("x", trend)) for t, v in zip(times, values)],
        "name_input string, transformation string, parameter string, location string, split string, ts timestamp, value double")
    rough = RNG.normal(size=24)
    y = {"rough": rough[hours] + 0.1 * RNG.normal(size=n), "flat": 0.3 * trend + RNG.normal(size=n)}
    target = spark.createDataFrame([(s, t, "training", float(v)) for s in y for t, v in zip(times, y[s])],
                                   "site string, ts timestamp, split string, normalised double")
    sites = target.select("site").distinct()
    formula = [Term((Factor("hour", 12),), "smoothing", 1e-3), Term((Factor("x", 4),), "ridge", 1e-3)]
    design = features.design(inputs, formula, sites)
    by_site, _ = features.signatures(sites, None)
    xtx, xty = fit.statistics(design, target, by_site)
    found = smoothness.chosen_fit(xtx, xty, formula, GRID).toPandas()
    coo = features.coordinates(design).toPandas()
    columns = {key: i for i, key in enumerate(sorted(set(zip(coo.block, coo.idx))))}
    x = np.zeros((n, len(columns)))
    place = {t: i for i, t in enumerate(times)}
    for r in coo.itertuples():
        x[place[r.ts.to_pydatetime()], columns[r.block, r.idx]] = r.value
    d = solve.second_difference(12)
    smooth, ridge = np.zeros((17, 17)), np.zeros((17, 17))
    smooth[:12, :12], ridge[12:, 12:] = d.T @ d, np.eye(5)
    picked = {}
    for s in y:
        mine = found[found.site == s]
        at = mine[mine.kind == "strength"].set_index("block").value
        picked[s] = at["t00"]
        scores = {(a, b): plain_score(x, y[s], a * smooth + b * ridge) for a, b in product(GRID, GRID)}
        near = [v for (a, b), v in scores.items() if a == at["t00"] or b == at["t01"]]
        assert mine[mine.kind == "score"].value.iloc[0] == pytest.approx(min(near), rel=1e-8)
        assert scores[at["t00"], at["t01"]] == pytest.approx(min(scores.values()), rel=1e-3)
        want = np.linalg.solve(x.T @ x / n + at["t00"] * smooth + at["t01"] * ridge, x.T @ y[s] / n)
        got = mine[mine.kind == "coefficient"].sort_values(["block", "idx"]).value
        np.testing.assert_allclose(got, want, atol=1e-7)
    assert picked["rough"] < picked["flat"]


def test_other_penalties_are_refused(spark):
    none = spark.createDataFrame([], "sig string, site string")
    with pytest.raises(ValueError, match="not chosen"):
        smoothness.chosen_fit(none, none, [Term((Factor("hour", 4),), "lasso", 1.0)])
