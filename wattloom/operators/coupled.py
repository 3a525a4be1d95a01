"""Fits whose penalties couple the sites: norms of rows across sites, and low rank across sites.

Both need no more of the sites than sums of the size of the formula. Row norms are found by
Newton steps on one number a row, with value, gradient and curvature from one aggregate over the
sites a round; low rank comes from one such aggregate and the eigenvectors of its result.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import solve
from .features import Term, term_name
from .fit import _ITERATIVE, COEFFICIENTS, _layout, _matrix, _quadratic_part, grouped, one_design
from .solve import NotConverged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Matrices of so many rows at most come to the driver: rows coupled, or columns of the design.
MOST_ROWS = 4096
_SUMS = "kind string, i int, j int, value double"


class Rows:
    """The coupled rows of a formula: of each, block, number, weight ``beta`` and power.

    A row K b across the sites has the penalty s |K b|^p, 1 <= p < 2. It is the least over eta > 0 of
    (beta / 2) |K b|^2 / eta + rest eta^q with beta = s p, rest = s (1 - p / 2), q = p / (2 - p),
    which is convex in b and eta together. For given eta every site is a linear system of its own.
    """

    def __init__(self, blocks: Sequence[str], formula: Sequence[Term]):
        terms = {term_name(i): t for i, t in enumerate(formula)}
        self.of: list[tuple[str, int]] = []
        strength, power = [], []
        for block in sorted(blocks):
            term = terms[block.split("@", 1)[0]]
            if term.penalty not in COUPLED:
                continue
            if term.penalty == "block_smoothing" and len(term.factors) > 1:
                raise ValueError("block smoothing applies to blocks of one input")
            s, p = (term.alpha, 1.0) if term.penalty == "row_group_lasso" else (term.alpha[0] / 2, term.alpha[1])
            if not 1 <= p < 2:
                raise ValueError(f"power {p} of a row norm; 1 or more and below 2 is needed")
            count = len(_operator(term))
            self.of += [(block, i) for i in range(count)]
            strength += [s] * count
            power += [p] * count
        if len(self.of) > MOST_ROWS:
            raise ValueError(f"{len(self.of)} rows across sites, {MOST_ROWS} at most")
        s, self.power = np.array(strength), np.array(power)
        self.beta, self.rest, self.q = s * self.power, s * (1 - self.power / 2), self.power / (2 - self.power)
        self.place = {row: i for i, row in enumerate(self.of)}


COUPLED = ("block_smoothing", "row_group_lasso")


def _checked(formula: Sequence[Term]) -> None:
    others = {t.penalty for t in formula} & _ITERATIVE
    if others:
        raise ValueError(f"{sorted(others)} cannot be fitted together with penalties across sites")


def _operator(term: Term) -> np.ndarray:
    if term.penalty == "row_group_lasso":
        return np.eye(term.size)
    return solve.difference_operator(term.sizes, 2, term.cyclic)


def _inverse(m: np.ndarray) -> np.ndarray:
    """Pseudo-inverse of a symmetric matrix."""
    values, vectors = np.linalg.eigh(m)
    keep = np.abs(values) > np.abs(values).max(initial=0.0) * len(m) * 1e-15
    return (vectors[:, keep] / values[keep]) @ vectors[:, keep].T


class Group:
    """The statistics of one group of sites: per number of times the matrix and the right sides."""

    def __init__(self, xtx: pd.DataFrame, xty: pd.DataFrame, formula: Sequence[Term], coupled: bool = True):
        layout, start = _layout(pd.unique(pd.concat([xtx.block1, xtx.block2])), formula)
        self.size = layout[-1]["part"].stop
        self.names = np.repeat([e["name"] for e in layout], [e["part"].stop - e["part"].start for e in layout])
        self.index = np.concatenate([np.arange(e["part"].stop - e["part"].start) for e in layout]).astype("int32")
        whole = _matrix(xtx, start, self.size)
        quadratic = _quadratic_part([{**e, "penalty": "none" if coupled and e["penalty"] in COUPLED else e["penalty"]} for e in layout], self.size)
        self.operator, self.rows = np.zeros((0, self.size)), []
        terms = {term_name(i): t for i, t in enumerate(formula)}
        for e in layout:
            if e["penalty"] in COUPLED:
                k = _operator(terms[e["name"].split("@", 1)[0]])
                part = np.zeros((len(k), self.size))
                part[:, e["part"]] = k
                self.operator = np.vstack([self.operator, part])
                self.rows += [(e["name"], i) for i in range(len(k))]
        self.parts = []
        for n, same in xty.groupby("n"):
            sites = sorted(same.site.unique())
            column = {site: k for k, site in enumerate(sites)}
            c = np.zeros((self.size, len(sites)))
            c[same.block.map(start).to_numpy() + same.idx.to_numpy(), same.site.map(column).to_numpy()] = same.value.to_numpy() / n
            self.parts.append((sites, whole / n + quadratic, c))

    def at(self, rows: Rows, eta: np.ndarray):
        """Per part: sites, right sides, coefficients, multipliers y of the rows, and the (y, y) block of the inverse.

        The system is a b + K'y = c, K b = (eta / beta) y, so eta = 0 holds K b at zero.
        """
        mine = [rows.place[r] for r in self.rows]
        ratio = eta[mine] / rows.beta[mine]
        for sites, a, c in self.parts:
            inverse = _inverse(np.block([[a, self.operator.T], [self.operator, -np.diag(ratio)]]))
            found = inverse[:, :self.size] @ c
            yield sites, c, found[:self.size], found[self.size:], inverse[self.size:, self.size:]

    def frame(self, sites: list[str], b: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({
            "site": np.repeat(sites, self.size), "block": np.tile(self.names, len(sites)),
            "idx": np.tile(self.index, len(sites)), "value": b.T.ravel()})


def _sums(kind: str, at: Sequence[int], m: np.ndarray) -> pd.DataFrame:
    i, j = np.indices(m.shape)
    at = np.asarray(at, "int32")
    return pd.DataFrame({"kind": kind, "i": at[i.ravel()], "j": at[j.ravel()], "value": m.ravel()})


def _totals(groups, run) -> pd.DataFrame:
    """Sums over all groups of what ``run`` returns of each, a number per (kind, i, j)."""
    return groups.applyInPandas(run, _SUMS).groupBy("kind", "i", "j").agg(F.sum("value").alias("value")).toPandas()


def _dense(sums: pd.DataFrame, kind: str, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    part = sums[sums.kind == kind]
    out[part.i.to_numpy(int), part.j.to_numpy(int)] = part.value.to_numpy()
    return out


def row_coupled(xtx: DataFrame, xty: DataFrame, formula: Sequence[Term], rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """Coefficients under row-group lasso and block smoothing, (site, block, idx, value).

    At the minimum every row has |y| = beta eta^((q - 1) / 2), or eta = 0 and |y| <= beta, where |y|
    is the norm across sites. Each round one aggregate over the sites gives the norms, the value and
    the curvature; the step is Newton's on the inverse norms, which are nearly linear in eta. It is
    halved where the value would rise. Rounds end when all rows meet their condition to a share of
    ``tolerance``; otherwise ``NotConverged`` is raised. Only numbers of rows reach the driver.
    """
    _checked(formula)
    left, right = grouped(xtx, xty)
    left, right = materialize(left), materialize(right)
    groups = left.groupBy("sig", "bucket").cogroup(right.groupBy("sig", "bucket"))
    rows = Rows([r["block1"] for r in left.select("block1").distinct().collect()], formula)
    size = len(rows.of)

    def measured(eta: np.ndarray):
        def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            if x.empty or y.empty:
                return pd.DataFrame({"kind": [], "i": [], "j": [], "value": []}).astype({"kind": str, "i": "int32", "j": "int32"})
            group = Group(x, y, formula)
            at = [rows.place[r] for r in group.rows]
            value, squares, bend = 0.0, np.zeros((len(at), len(at))), np.zeros((len(at), len(at)))
            for _, c, b, multipliers, inverse in group.at(rows, eta):
                value -= 0.5 * float((c * b).sum())
                outer = multipliers @ multipliers.T
                squares += outer
                bend -= outer * inverse
            return pd.concat([_sums("value", [0], np.array([[value]])), _sums("bend", at, bend), _sums("norm", at, np.diag(np.diag(squares)))])

        sums = _totals(groups, run)
        value = sums[sums.kind == "value"].value.sum() + float((rows.rest * eta**rows.q).sum())
        return value, np.sqrt(np.maximum(np.diag(_dense(sums, "norm", size)), 0.0)), _dense(sums, "bend", size)

    exact = rows.power == 1
    half = (rows.q - 1) / 2
    eta = np.where(exact, 0.0, 1.0)
    value, norm, bend = measured(eta)
    for _ in range(rounds):
        wanted = rows.beta * np.where(exact, 1.0, eta**half)
        free = (norm > 0) & ((eta > 0) | (norm > rows.beta * (1 + tolerance)))
        error = np.where(free, np.abs(norm / wanted - 1), 0.0)
        if error.max(initial=0.0) <= tolerance:
            break
        f = np.flatnonzero(free)
        gap = eta[f]**half[f] / norm[f] - 1 / rows.beta[f]
        slope = (eta[f]**half[f] / norm[f]**3)[:, None] * bend[np.ix_(f, f)] / rows.beta[f]
        curved = ~exact[f]
        slope[np.diag_indices(len(f))] += np.where(curved, half[f] * np.where(curved, eta[f], 1.0)**(half[f] - 1) / norm[f], 0.0)
        step = np.linalg.lstsq(slope, -gap, rcond=1e-14)[0]
        target = eta.copy()
        target[f] = np.where(curved, np.clip(eta[f] + step, 0.1 * eta[f], 10 * eta[f]), np.maximum(eta[f] + step, 0.0))
        share = 1.0
        while True:
            tried = eta + share * (target - eta)
            after = measured(tried)
            if after[0] <= value + 1e-13 * (1 + abs(value)):
                break
            share /= 2
            if share < 1e-6:
                raise NotConverged("rows across sites", float(error.max()))
        eta, (value, norm, bend) = tried, after
    else:
        raise NotConverged("rows across sites", float(error.max()))

    def final(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"site": [], "block": [], "idx": [], "value": []}).astype({"site": str, "block": str, "idx": "int32", "value": float})
        group = Group(x, y, formula)
        zero = np.array([rows.place[r] for r in group.rows])[None, :]
        out = []
        for sites, _, b, _, _ in group.at(rows, eta):
            held = np.flatnonzero((eta[zero[0]] == 0) & (np.abs(group.operator).sum(axis=1) == 1))
            b[np.abs(group.operator[held]).sum(axis=0) > 0] = 0.0  # exactly, not to the last digit
            out.append(group.frame(sites, b))
        return pd.concat(out)

    return groups.applyInPandas(final, COEFFICIENTS)


def low_rank_across_sites(xtx: DataFrame, xty: DataFrame, formula: Sequence[Term], rank: int) -> DataFrame:
    """Coefficients B = U V' of at most ``rank`` over the sites of one shared design, under quadratic penalties.

    With A = X'X / n and the penalties, and C the right sides of all sites, the best B is
    A^(-1/2) W W' A^(-1/2) C, W the first eigenvectors of A^(-1/2) C C' A^(-1/2). So one aggregate
    over the sites, C C', and a map of the size of the design applied to each site: no rounds.
    """
    _checked(formula)
    one_design(xty, "the low-rank fit across sites")
    left, right = grouped(xtx, xty)
    left, right = materialize(left), materialize(right)
    groups = left.groupBy("sig", "bucket").cogroup(right.groupBy("sig", "bucket"))
    columns = left.select(F.col("block1").alias("block"), F.col("idx1").alias("idx")).distinct().limit(MOST_ROWS + 1).count()
    if columns > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} columns in the design")

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"kind": [], "i": [], "j": [], "value": []}).astype({"kind": str, "i": "int32", "j": "int32"})
        group = Group(x, y, formula, coupled=False)
        roots = [_root(a) for _, a, _ in group.parts]
        outer = sum(r @ c @ c.T @ r for r, (_, _, c) in zip(roots, group.parts, strict=True))
        return _sums("outer", range(group.size), outer)

    sums = _totals(groups, run)
    size = int(sums.i.max()) + 1 if len(sums) else 0
    outer = _dense(sums, "outer", size)
    leading = np.linalg.eigh(outer)[1][:, ::-1][:, :rank]

    def final(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"site": [], "block": [], "idx": [], "value": []}).astype({"site": str, "block": str, "idx": "int32", "value": float})
        group = Group(x, y, formula, coupled=False)
        out = []
        for sites, a, c in group.parts:
            root = _root(a)
            out.append(group.frame(sites, root @ (leading @ (leading.T @ (root @ c)))))
        return pd.concat(out)

    return groups.applyInPandas(final, COEFFICIENTS)


def _root(a: np.ndarray) -> np.ndarray:
    """Inverse square root of a symmetric matrix on its range."""
    values, vectors = np.linalg.eigh(a)
    keep = values > values[-1] * len(a) * 1e-14
    return (vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T
