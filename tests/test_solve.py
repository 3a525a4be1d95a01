"""Solves on small random statistics, and the fits in Spark against numpy."""

import datetime as dt

import numpy as np
import pytest

from wattloom.operators import coupled, features, fit, solve
from wattloom.operators.features import Factor, Term

RNG = np.random.default_rng(5)


def problem(n=200, p=12):
    x = RNG.normal(size=(n, p))
    y = x @ np.cumsum(RNG.normal(size=p)) + RNG.normal(size=n)
    return x.T @ x / n, x.T @ y / n


def objective(a, c, b):
    return 0.5 * b @ a @ b - c @ b


def entry(p, penalty, alpha, sizes=None):
    return {"name": "t00@", "part": slice(0, p), "sizes": sizes or (p,), "penalty": penalty, "alpha": alpha, "rank": 1}


PENALTIES = [
    ("lasso", 0.3, lambda b: 0.3 * np.abs(b).sum()),
    ("elastic_net", (0.4, 0.5), lambda b: 0.5 * (0.4 * np.abs(b).sum())),
    ("total_variation", 0.3, lambda b: 0.3 * np.abs(np.diff(b)).sum()),
    ("trend_filtering", 0.3, lambda b: 0.3 * np.abs(np.diff(b, 2)).sum()),
    ("column_group_lasso", 0.7, lambda b: 0.7 * np.linalg.norm(b)),
]


@pytest.mark.parametrize("penalty,alpha,value", PENALTIES, ids=[p[0] for p in PENALTIES])
def test_no_nearby_point_is_better(penalty, alpha, value):
    a, c = problem()
    a = a + solve.quadratic(penalty, alpha, (12,))
    b = solve.solve_site(a, c, [entry(12, penalty, alpha)])
    best = objective(a, c, b) + value(b)
    for scale in (1e-1, 1e-2, 1e-3):
        for _ in range(300):
            other = b + scale * RNG.normal(size=12)
            assert objective(a, c, other) + value(other) >= best - 1e-9
    # moves along the kinks: equal neighbours, straight lines, zeros
    for j in range(12):
        for step in (np.eye(12)[j], (np.arange(12) >= j) * 1.0, np.maximum(np.arange(12) - j, 0.0)):
            for size in (1e-3, -1e-3):
                other = b + size * step
                assert objective(a, c, other) + value(other) >= best - 1e-9


def test_smoothing_solves_the_normal_equations():
    a, c = problem()
    d = np.diff(np.eye(12), 2, axis=0)
    a = a + solve.quadratic("smoothing", 0.8, (12,))
    b = solve.least_norm(a, c)
    np.testing.assert_allclose(a @ b, c, atol=1e-12)
    np.testing.assert_allclose(solve.quadratic("smoothing", 0.8, (12,)), 0.8 * d.T @ d)


def test_smoothing_of_an_interaction_adds_both_axes():
    b = RNG.normal(size=(4, 5))
    q = solve.quadratic("smoothing", 1.0, (4, 5))
    want = (np.diff(b, 2, axis=0) ** 2).sum() + (np.diff(b, 2, axis=1) ** 2).sum()
    assert b.ravel() @ q @ b.ravel() == pytest.approx(want)
    q1 = solve.quadratic("factor_smoothing", 1.0, (4, 5))
    assert b.ravel() @ q1 @ b.ravel() == pytest.approx((np.diff(b, 2, axis=0) ** 2).sum())


@pytest.mark.parametrize("wrap", [False, True])
@pytest.mark.parametrize("second", [None, 5])
def test_penalty_values_agree_with_the_matrices(spark, wrap, second):
    factors = (Factor("hour", 4),) if second is None else (Factor("hour", 4), Factor("x", second))
    terms = [Term(factors, p, 0.7, wrap=wrap) for p in ("smoothing", "factor_smoothing", "ridge")]
    b = RNG.normal(size=terms[0].size)
    rows = [("s", f"{features.term_name(i)}@", j, float(v)) for i in range(3) for j, v in enumerate(b)]
    coef = spark.createDataFrame(rows, fit.COEFFICIENTS)
    got = {r.kind: r.penalty for r in fit.penalties(coef, terms).collect()}
    for term in terms:
        q = solve.quadratic(term.penalty, 0.7, term.sizes, term.cyclic)
        assert got[term.penalty] == pytest.approx(0.5 * b @ q @ b)


def test_least_norm_of_a_singular_system():
    x = RNG.normal(size=(50, 4))
    x = np.hstack([x, x.sum(axis=1, keepdims=True)])
    a, c = x.T @ x, x.T @ RNG.normal(size=50)
    np.testing.assert_allclose(solve.least_norm(a, c), np.linalg.pinv(a) @ c, atol=1e-10)
    np.testing.assert_allclose(solve.conjugate_gradient(a, c), np.linalg.pinv(a) @ c, atol=1e-6)


def test_clipped_deviation_takes_the_cheaper_branch():
    a, c = problem()
    b = solve.solve_site(a, c, [entry(12, "clipped_deviation", (0.5, 0.1, 0.0))])
    np.testing.assert_allclose(b, solve.solve_site(a, c, [entry(12, "column_group_lasso", 0.1)]), atol=1e-6)


def test_low_rank_interaction_recovers_a_rank_one_block():
    n, p, q = 400, 4, 5
    x = RNG.normal(size=(n, p * q))
    true = np.outer(RNG.normal(size=p), RNG.normal(size=q)).ravel()
    y = x @ true
    b = solve.solve_site(x.T @ x / n, x.T @ y / n, [entry(p * q, "low_rank_interaction", 0.0, (p, q))])
    np.testing.assert_allclose(b, true, atol=1e-5)
    assert np.linalg.matrix_rank(b.reshape(p, q), tol=1e-8) == 1


def test_sesquivariate_shares_the_first_factor():
    n, p, q = 600, 3, 4
    x1, x12 = RNG.normal(size=(n, p)), RNG.normal(size=(n, p * q))
    b, m = RNG.normal(size=p), RNG.normal(size=q)
    y = x1 @ b + x12 @ np.outer(b, m).ravel()
    x = np.hstack([x1, x12])
    layout = [
        {"name": "t00@", "part": slice(0, p), "sizes": (p,), "penalty": "", "alpha": 0.0, "rank": None},
        {"name": "t01@|", "part": slice(p, p + p * q), "sizes": (p, q), "penalty": "sesquivariate", "alpha": 0.0, "rank": None, "shares": "t00@"},
    ]
    got = solve.solve_site(x.T @ x / n, x.T @ y / n, layout)
    np.testing.assert_allclose(got, np.concatenate([b, np.outer(b, m).ravel()]), atol=1e-3)


N = 240


@pytest.fixture(scope="module")
def data(spark):
    """Three sites on one calendar design of 6 hats, with its dense matrix."""
    from test_features import INPUTS, cyclic_hat

    times = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(N)]
    hours = np.arange(N) % 24
    x = cyclic_hat(hours.astype(float), 24, 6)
    y = {s: x @ RNG.normal(size=6) + 0.3 * RNG.normal(size=N) for s in "abc"}
    inputs = spark.createDataFrame([("hour", "", "", "", "training", t, float(h)) for t, h in zip(times, hours)], INPUTS)
    target = spark.createDataFrame([(s, t, "training", float(v)) for s in "abc" for t, v in zip(times, y[s])], "site string, ts timestamp, split string, normalised double")
    sites = target.select("site").distinct()
    return x, y, inputs, target, sites


def statistics(data, formula):
    x, y, inputs, target, sites = data
    rows = features.design(inputs, formula, sites)
    by_site, _ = features.signatures(sites, None)
    return rows, by_site, fit.statistics(rows, target, by_site)


def matrix(coef):
    out = {}
    for r in coef.collect():
        out.setdefault(r.site, {})[r.idx] = r.value
    return np.column_stack([[out[s][i] for i in sorted(out[s])] for s in sorted(out)])


def test_ridge_and_prediction(spark, data):
    formula = [Term((Factor("hour", 6),), "ridge", 0.01)]
    rows, by_site, (xtx, xty) = statistics(data, formula)
    coef = fit.coefficients(xtx, xty, formula)
    x, y = data[0], data[1]
    want = np.column_stack([np.linalg.solve(x.T @ x / N + 0.01 * np.eye(6), x.T @ y[s] / N) for s in "abc"])
    np.testing.assert_allclose(matrix(coef), want, atol=1e-10)
    hat = fit.predict(rows, coef, by_site).filter("site = 'b'").orderBy("ts").toPandas().prediction
    np.testing.assert_allclose(hat, x @ want[:, 1], atol=1e-10)
    # dealt into parts by the count of its rows, the prediction is the same and no part is far above the bound
    parts = fit.salts(rows, 10).first()["_salts"]
    assert parts == -(-rows.count() // 10) and fit.salts(rows).first()["_salts"] == 1
    dealt = fit.predict(rows, coef, by_site, rows_per_salt=10).filter("site = 'b'").orderBy("ts").toPandas().prediction
    np.testing.assert_allclose(dealt, hat, atol=1e-12)


def test_coupled_penalties_reach_their_optimum(spark, data):
    x, y = data[0], data[1]
    a = x.T @ x / N
    c = np.column_stack([x.T @ y[s] / N for s in "abc"])
    for term, value in [
        (Term((Factor("hour", 6),), "row_group_lasso", 0.02), lambda b: 0.02 * np.linalg.norm(b, axis=1).sum()),
        (Term((Factor("hour", 6),), "block_smoothing", (0.05, 1.1)), lambda b: 0.025 * (np.linalg.norm(np.diff(b, 2, axis=0), axis=1) ** 1.1).sum()),
    ]:
        _, _, (xtx, xty) = statistics(data, [term])
        total = lambda b: 0.5 * np.sum(b * (a @ b)) - np.sum(c * b) + value(b)
        b = matrix(coupled.row_coupled(xtx, xty, [term]))
        least = total(b)
        for size in (1e-2, 1e-4):
            for _ in range(300):
                assert total(b + size * RNG.normal(size=b.shape)) >= least - 1e-12


def test_rows_across_sites_are_exactly_zero_or_meet_their_condition(spark, data, monkeypatch):
    """Optimality by the gradient: |row| = alpha along the coefficients, or zero and below alpha; in small groups too."""
    x, y = data[0], data[1]
    a = x.T @ x / N
    c = np.column_stack([x.T @ y[s] / N for s in "abc"])
    free = np.linalg.norm(c, axis=1)
    alpha = float(np.sort(free)[2] * 0.9)
    formula = [Term((Factor("hour", 6),), "row_group_lasso", alpha)]
    _, _, (xtx, xty) = statistics(data, formula)
    monkeypatch.setattr(fit, "SITES_PER_GROUP", 1)
    b = matrix(coupled.row_coupled(xtx, xty, formula))
    gradient = c - a @ b
    zero = ~b.any(axis=1)
    assert 0 < zero.sum() < 6
    assert (np.linalg.norm(gradient[zero], axis=1) <= alpha * (1 + 1e-8)).all()
    norms = np.linalg.norm(b, axis=1, keepdims=True)
    np.testing.assert_allclose(gradient[~zero], (alpha * b / np.where(norms > 0, norms, 1))[~zero], atol=1e-8)


def test_row_norms_beside_other_terms(spark, data):
    """A smoothed block and a row-lasso block that both sum to one: X'X is singular."""
    x, y, inputs, target, sites = data
    formula = [Term((Factor("hour", 6),), "block_smoothing", (0.05, 1.5)), Term((Factor("hour", 4),), "row_group_lasso", 0.01)]
    _, _, (xtx, xty) = statistics(data, formula)
    coef = coupled.row_coupled(xtx, xty, formula).toPandas()
    from test_features import cyclic_hat

    both = np.column_stack([x, cyclic_hat((np.arange(N) % 24).astype(float), 24, 4)])
    a, c = both.T @ both / N, np.column_stack([both.T @ y[s] / N for s in "abc"])
    b = np.column_stack([coef[coef.site == s].sort_values(["block", "idx"]).value for s in "abc"])
    gradient = c - a @ b
    rows = np.linalg.norm(b[6:], axis=1, keepdims=True)
    on = rows[:, 0] > 0
    np.testing.assert_allclose(gradient[6:][on], (0.01 * b[6:] / np.where(rows > 0, rows, 1))[on], atol=1e-7)
    assert (np.linalg.norm(gradient[6:][~on], axis=1) <= 0.01 * (1 + 1e-7)).all()
    d = np.diff(np.eye(6), 2, axis=0)
    bend = d @ b[:6]
    slopes = 0.025 * 1.5 * np.linalg.norm(bend, axis=1, keepdims=True) ** (1.5 - 2) * bend
    np.testing.assert_allclose(gradient[:6], d.T @ slopes, atol=1e-7)


def test_rows_across_sites_raise_when_rounds_run_out(spark, data):
    formula = [Term((Factor("hour", 6),), "block_smoothing", (0.05, 1.1))]
    _, _, (xtx, xty) = statistics(data, formula)
    with pytest.raises(solve.NotConverged):
        coupled.row_coupled(xtx, xty, formula, rounds=1)
    with pytest.raises(ValueError, match="cannot be fitted together"):
        coupled.row_coupled(xtx, xty, [Term((Factor("hour", 6),), "lasso", 0.05)])


def test_sum_consistent_solves_the_joint_system(spark, data):
    formula = [Term((Factor("hour", 6),), "ridge", 0.01)]
    _, _, (xtx, xty) = statistics(data, formula)
    groups = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "h")], "site string, group string")
    got = matrix(fit.sum_consistent(xtx, xty, groups, formula))
    x, y = data[0], data[1]
    a, q = x.T @ x / N, 0.01 * np.eye(6)
    c = {s: x.T @ y[s] / N for s in "abc"}
    w = 0.5
    joint = np.block([[a + q + w * a, w * a], [w * a, a + q + w * a]])
    both = np.linalg.solve(joint, np.concatenate([c["a"] + w * (c["a"] + c["b"]), c["b"] + w * (c["a"] + c["b"])]))
    np.testing.assert_allclose(got[:, 0], both[:6], atol=1e-9)
    np.testing.assert_allclose(got[:, 1], both[6:], atol=1e-9)
    np.testing.assert_allclose(got[:, 2], np.linalg.solve(2 * a + q, 2 * c["c"]), atol=1e-9)


def test_low_rank_across_sites_has_its_rank(spark, data):
    formula = [Term((Factor("hour", 6),), "ridge", 1e-6)]
    _, _, (xtx, xty) = statistics(data, formula)
    x, y = data[0], data[1]
    a = x.T @ x / N + 1e-6 * np.eye(6)
    c = np.column_stack([x.T @ y[s] / N for s in "abc"])
    b = matrix(coupled.low_rank_across_sites(xtx, xty, formula, rank=2))
    assert np.linalg.matrix_rank(b, tol=1e-8) == 2
    # optimum by the singular values of the whitened solution
    root = np.linalg.cholesky(a)
    u, s, vt = np.linalg.svd(np.linalg.solve(root, c))
    want = np.linalg.solve(root.T, (u[:, :2] * s[:2]) @ vt[:2])
    value = lambda b: 0.5 * np.sum(b * (a @ b)) - np.sum(c * b)
    assert value(b) == pytest.approx(value(want), abs=1e-12)
    np.testing.assert_allclose(b, want, atol=1e-9)


def test_large_groups_of_sites_are_split(spark, data, monkeypatch):
    formula = [Term((Factor("hour", 6),), "ridge", 0.01)]
    _, _, (xtx, xty) = statistics(data, formula)
    whole = matrix(fit.coefficients(xtx, xty, formula))
    monkeypatch.setattr(fit, "SITES_PER_GROUP", 1)
    left, right = fit.grouped(xtx, xty)
    assert left.select("bucket").distinct().count() == 3
    np.testing.assert_allclose(matrix(fit.coefficients(xtx, xty, formula)), whole, atol=1e-12)


def test_mixed_penalties_are_solved_together():
    a, c = problem(p=24)
    layout = [
        {**entry(12, "lasso", 0.3), "name": "t00@"},
        {**entry(12, "column_group_lasso", 50.0), "name": "t01@", "part": slice(12, 24)},
    ]
    b = solve.solve_site(a, c, layout)
    assert not b[12:].any()
    np.testing.assert_allclose(b[:12], solve.solve_site(a[:12, :12], c[:12], layout[:1]), atol=1e-8)
    layout[1]["alpha"] = 0.4
    b = solve.solve_site(a, c, layout)
    value = lambda b: objective(a, c, b) + 0.3 * np.abs(b[:12]).sum() + 0.4 * np.linalg.norm(b[12:])
    for _ in range(300):
        assert value(b + 1e-3 * RNG.normal(size=24)) >= value(b) - 1e-10


def test_blocks_of_given_rank_refuse_other_penalties():
    a, c = problem(p=24)
    layout = [entry(12, "lasso", 0.3), {**entry(12, "low_rank_interaction", 0.0, (3, 4)), "part": slice(12, 24)}]
    with pytest.raises(ValueError, match="cannot be fitted together"):
        solve.solve_site(a, c, layout)


@pytest.mark.parametrize("penalty,order", [("total_variation", 1), ("trend_filtering", 2)])
def test_differences_of_an_interaction_go_down_its_first_axis(spark, penalty, order):
    a, c = problem(p=12)
    value = lambda b: objective(a, c, b) + 0.3 * np.abs(np.diff(b.reshape(4, 3), order, axis=0)).sum()
    b = solve.solve_site(a, c, [entry(12, penalty, 0.3, (4, 3))])
    for _ in range(300):
        assert value(b + 1e-2 * RNG.normal(size=12)) >= value(b) - 1e-9
    term = Term((Factor("hour", 4), Factor("x", 3)), penalty, 0.3)
    coef = spark.createDataFrame([("s", f"{features.term_name(0)}@", j, float(v)) for j, v in enumerate(b[:term.size])], fit.COEFFICIENTS)
    sizes = term.sizes
    if term.size == 12:
        want = 0.3 * np.abs(np.diff(b.reshape(sizes), order, axis=0)).sum()
        assert fit.penalties(coef, [term]).first().penalty == pytest.approx(want)


def test_a_solve_without_enough_rounds_raises():
    a, c = problem()
    with pytest.raises(solve.NotConverged):
        solve.coordinate_lasso(a, c, np.full(12, 0.1), rounds=1)
    with pytest.raises(solve.NotConverged):
        solve.proximal(a, c, [(slice(0, 12), 0.1)], rounds=1)


def test_a_site_with_missing_targets_has_the_statistics_of_its_own_rows(spark, data):
    from pyspark.sql import functions as F

    x, y, inputs, target, sites = data
    start = dt.datetime(2024, 1, 1)
    gone = F.col("ts") < F.lit(start + dt.timedelta(hours=100))
    gapped = target.withColumn("normalised", F.when(~((F.col("site") == "b") & gone), F.col("normalised"))).filter(
        ~((F.col("site") == "c") & (F.col("ts") == F.lit(start + dt.timedelta(hours=7)))))
    formula = [Term((Factor("hour", 6),), "ridge", 0.01)]
    _, _, (xtx, xty) = statistics((x, y, inputs, gapped, sites), formula)
    keep = {"a": np.ones(N, bool), "b": np.arange(N) >= 100, "c": np.arange(N) != 7}
    want = []
    for s, k in keep.items():
        n = k.sum()
        want.append(np.linalg.solve(x[k].T @ x[k] / n + 0.01 * np.eye(6), x[k].T @ y[s][k] / n))
    np.testing.assert_allclose(matrix(fit.coefficients(xtx, xty, formula)), np.column_stack(want), atol=1e-10)
    with pytest.raises(ValueError, match="one design"):
        coupled.low_rank_across_sites(xtx, xty, formula, rank=1)
