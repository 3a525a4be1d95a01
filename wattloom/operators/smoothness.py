"""Strength of the penalties chosen from the data by generalised cross-validation.

Fits, residuals and degrees of freedom of any strength follow from X'X, X'Y and Y'Y, so the
choice needs no second read of the rows.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from . import solve
from .features import Term
from .fit import _layout, _matrix, grouped

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Strengths tried: half powers of ten.
GRID = tuple(10.0 ** (k / 2) for k in range(-18, 7))
CHOSEN = ("smoothing", "factor_smoothing", "ridge")
_COLUMNS = "site string, kind string, block string, idx int, value double"


def diagonal(m: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P and s with P'mP = diag(s) and P'qP = diag(1 - s), on the range of m + q (both semi-definite)."""
    values, vectors = np.linalg.eigh(m + q)
    keep = values > values[-1] * len(m) * 1e-14
    root = vectors[:, keep] / np.sqrt(values[keep])
    s, turn = np.linalg.eigh(root.T @ m @ root)
    return root @ turn, np.clip(s, 0.0, 1.0)


def scores(a: np.ndarray, c: np.ndarray, yy: float, fixed: np.ndarray, q: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per strength t of the grid, with b the minimum under the penalty (fixed + t q): the generalised
    cross-validation score rss / (1 - edf / n)^2 without its n, as (mean squares, edf).

    One diagonalisation serves all strengths. ``a`` is X'X / n, ``c`` X'Y / n, ``yy`` Y'Y / n.
    """
    p, s = diagonal(a + fixed, q)
    d = s[:, None] + grid * (1 - s)[:, None]
    d = np.where(d > 1e-13, d, np.inf)
    own = p.T @ a @ p
    w = (p.T @ c)[:, None] / d
    squares = yy - 2 * (p.T @ c) @ w + np.einsum("ig,ij,jg->g", w, own, w)
    return squares, (np.diag(own)[:, None] / d).sum(axis=0)


def criterion(squares: np.ndarray, edf: np.ndarray, n: float) -> np.ndarray:
    left = 1 - edf / n
    return np.where(left > 1e-9, np.maximum(squares, 0.0) / np.maximum(left, 1e-9)**2, np.inf)


def strengths(a: np.ndarray, c: np.ndarray, yy: float, n: float, base: np.ndarray, parts: list[np.ndarray], grid: np.ndarray,
              start: Sequence[float]) -> tuple[np.ndarray, float, float]:
    """Grid strengths of the penalties ``parts`` beside the fixed ``base``, their score and degrees of freedom.

    One strength is moved at a time to its best place on the grid, until none improves the score; each
    move lowers it, so on a finite grid this ends.
    """
    at = [int(np.abs(np.log(grid) - np.log(max(x, grid[0]))).argmin()) for x in start]
    best, freedom = np.inf, 0.0
    while True:
        before = best
        for j, q in enumerate(parts):
            fixed = base + sum((grid[at[k]] * parts[k] for k in range(len(parts)) if k != j), np.zeros_like(base))
            squares, edf = scores(a, c, yy, fixed, q, grid)
            value = criterion(squares, edf, n)
            i = int(value.argmin())
            if value[i] < best * (1 - 1e-12):
                best, freedom, at[j] = float(value[i]), float(edf[i]), i
        if not best < before:
            return grid[at], best, freedom


def _solver(formula: Sequence[Term], grid: Sequence[float]):
    def run(xtx: pd.DataFrame, xty: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"site": [], "kind": [], "block": [], "idx": [], "value": []}).astype(
            {"site": str, "kind": str, "block": str, "idx": "int32", "value": float})]
        if xtx.empty or xty.empty:
            return out[0]
        layout, start = _layout(pd.unique(pd.concat([xtx.block1, xtx.block2])), formula)
        size = layout[-1]["part"].stop
        whole = _matrix(xtx, start, size)
        by_term: dict[str, np.ndarray] = {}
        first: dict[str, float] = {}
        for e in layout:
            if e["penalty"] in CHOSEN:
                name = e["name"].split("@", 1)[0]
                q = by_term.setdefault(name, np.zeros((size, size)))
                q[e["part"], e["part"]] = solve.quadratic(e["penalty"], 1.0, e["sizes"], e["cyclic"])
                first[name] = e["alpha"]
        names = sorted(name for name, q in by_term.items() if q.any())
        parts = [by_term[name] for name in names]
        columns = np.repeat([e["name"] for e in layout], [e["part"].stop - e["part"].start for e in layout])
        index = np.concatenate([np.arange(e["part"].stop - e["part"].start) for e in layout]).astype("int32")
        for site, rows in xty.groupby("site"):
            n = float(rows.n.iloc[0])
            a, c = whole / n, np.zeros(size)
            c[rows.block.map(start).to_numpy() + rows.idx.to_numpy()] = rows.value.to_numpy() / n
            yy = float(rows.yty.iloc[0]) / n
            chosen, value, freedom = strengths(a, c, yy, n, np.zeros((size, size)), parts, np.asarray(grid), [first[x] for x in names])
            b = solve.least_norm(a + sum((t * q for t, q in zip(chosen, parts, strict=True)), np.zeros((size, size))), c)
            out.append(pd.DataFrame({"site": site, "kind": "coefficient", "block": columns, "idx": index, "value": b}))
            out.append(pd.DataFrame({"site": site, "kind": "strength", "block": names, "idx": 0, "value": chosen}))
            out.append(pd.DataFrame({"site": site, "kind": ["score", "freedom"], "block": "", "idx": 0, "value": [value, freedom]}))
        return pd.concat(out).astype({"idx": "int32"})

    return run


def chosen_fit(xtx: DataFrame, xty: DataFrame, formula: Sequence[Term], grid: Sequence[float] = GRID) -> DataFrame:
    """(site, kind, block, idx, value) with each term's strength chosen per site by generalised cross-validation.

    ``kind`` is coefficient (block and idx tell which), strength (of the term named in block), score (mean
    squares over (1 - freedom / n)^2) or freedom. Terms are under ridge or smoothing penalties; their alphas
    are where the search begins. All statistics come from ``fit.statistics``; one task has the
    sites of one group of ``fit.grouped``.
    """
    others = {t.penalty for t in formula} - set(CHOSEN) - {""}
    if others:
        raise ValueError(f"strengths of {sorted(others)} are not chosen; {CHOSEN} are")
    left, right = grouped(xtx, xty)
    return left.groupBy("sig", "bucket").cogroup(right.groupBy("sig", "bucket")).applyInPandas(_solver(formula, grid), _COLUMNS)
