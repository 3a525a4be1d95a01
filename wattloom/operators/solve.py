"""Small dense solves on sufficient statistics, run inside grouped tasks.

Everything here has the size of the formula and never that of the data. ``a`` is
X'X / n plus quadratic penalties, ``c`` is X'Y / n.
"""

from __future__ import annotations

import numpy as np

DENSE_LIMIT = 2000


def second_difference(size: int, cyclic: bool = False) -> np.ndarray:
    if size <= 2:
        return np.zeros((0, size))
    if cyclic:
        eye = np.eye(size)
        return np.roll(eye, -1, 1) - 2 * eye + np.roll(eye, 1, 1)
    d = np.zeros((size - 2, size))
    rows = np.arange(size - 2)
    d[rows, rows], d[rows, rows + 1], d[rows, rows + 2] = 1.0, -2.0, 1.0
    return d


def difference_operator(sizes: tuple[int, ...], axes: int, cyclic: tuple[bool, ...] = (False, False)) -> np.ndarray:
    """Second differences along the first ``axes`` axes of a block, stacked."""
    if len(sizes) == 1:
        return second_difference(sizes[0], cyclic[0])
    first = np.kron(second_difference(sizes[0], cyclic[0]), np.eye(sizes[1]))
    if axes == 1:
        return first
    return np.vstack([first, np.kron(np.eye(sizes[0]), second_difference(sizes[1], cyclic[1]))])


def quadratic(penalty: str, alpha, sizes: tuple[int, ...], cyclic: tuple[bool, ...] = (False, False)) -> np.ndarray:
    """Matrix Q of a penalty 1/2 b'Qb on one block; zero for penalties of another kind."""
    p = int(np.prod(sizes))
    if penalty == "ridge":
        return alpha * np.eye(p)
    if penalty in ("smoothing", "factor_smoothing"):
        d = difference_operator(sizes, 1 if penalty == "factor_smoothing" else 2, cyclic)
        return alpha * d.T @ d
    if penalty == "elastic_net":
        share, strength = alpha
        return strength * (1 - share) * np.eye(p)
    return np.zeros((p, p))


def least_norm(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Solution of a b = c of least norm, where descent from zero also arrives.

    Bases that each sum to one make ``a`` singular, so no factorisation of a
    regular matrix is tried. Large systems go by conjugate gradient.
    """
    if len(a) <= DENSE_LIMIT:
        values, vectors = np.linalg.eigh(a)
        keep = values > values[-1] * len(a) * 1e-14
        return vectors[:, keep] @ ((vectors[:, keep].T @ c).T / values[keep]).T
    return conjugate_gradient(a, c)


def conjugate_gradient(a: np.ndarray, c: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    columns = c.reshape(len(c), -1)
    out = np.zeros_like(columns)
    for j in range(columns.shape[1]):
        x, r = out[:, j], columns[:, j].copy()
        d, rr = r.copy(), r @ r
        stop = tolerance**2 * rr
        for _ in range(100 * len(a)):
            if rr <= stop:
                break
            ad = a @ d
            step = rr / (d @ ad)
            x += step * d
            r -= step * ad
            rr, old = r @ r, rr
            d = r + rr / old * d
        else:
            raise NotConverged("conjugate gradient", float(rr))
    return out.reshape(c.shape)


class NotConverged(ArithmeticError):
    """A solve that ran out of rounds; its last point is not handed on as a solution."""


def coordinate_lasso(a: np.ndarray, c: np.ndarray, weights: np.ndarray, rounds: int = 100_000, tolerance: float = 1e-11) -> np.ndarray:
    """Minimise 1/2 b'ab - c'b + sum w|b| one coordinate at a time.

    Now and then the signs found so far are taken as final and the linear system they
    leave is solved; if its solution has these signs and meets the optimality conditions
    elsewhere, it is the minimum, however slowly the steps approach it.
    """
    b = np.zeros(len(c))
    ab = np.zeros(len(c))
    diagonal = np.diag(a)
    moved = 0.0
    for turn in range(1, rounds + 1):
        moved = 0.0
        for j in np.flatnonzero(diagonal > 0):
            free = c[j] - ab[j] + diagonal[j] * b[j]
            new = np.sign(free) * max(abs(free) - weights[j], 0.0) / diagonal[j]
            delta = new - b[j]
            if delta != 0.0:
                ab += a[:, j] * delta
                b[j] = new
                moved = max(moved, abs(delta) * np.sqrt(diagonal[j]))
        if moved < tolerance:
            return b
        if turn % 50 == 0:
            done = _with_signs(a, c, weights, b)
            if done is not None:
                return done
    raise NotConverged("coordinate descent", float(moved))


def _with_signs(a: np.ndarray, c: np.ndarray, weights: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The minimum, if it has the signs of ``b``."""
    used = (b != 0) | ((weights == 0) & (np.diag(a) > 0))
    out = np.zeros(len(c))
    if used.any():
        out[used] = least_norm(a[np.ix_(used, used)], (c - weights * np.sign(b))[used])
    gradient = c - a @ out
    slack = 1e-9 * (1 + np.abs(c).max(initial=0.0))
    same = (np.sign(out) == np.sign(b))[used & (weights > 0)].all()
    meets = (np.abs(gradient - weights * np.sign(out))[used] <= slack).all() and (np.abs(gradient) <= weights + slack)[~used].all()
    return out if same and meets else None


def shrink(v: np.ndarray, by: float) -> np.ndarray:
    norm = np.linalg.norm(v)
    return v * max(0.0, 1 - by / norm) if norm > 0 else v


def proximal(a: np.ndarray, c: np.ndarray, groups: list[tuple[slice, object]], rounds: int = 500_000, tolerance: float = 1e-11) -> np.ndarray:
    """Accelerated proximal gradient with restarts; one group per (slice, slope).

    ``slope`` is a number, or a function of the group's norm for a slope chosen anew
    each round; an array gives each coefficient of the slice its own absolute-value weight.
    """
    step = 1.0 / max(np.linalg.eigvalsh(a)[-1], 1e-300)
    b = np.zeros(len(c))
    y, momentum = b.copy(), 1.0
    for _ in range(rounds):
        z = y - step * (a @ y - c)
        for part, slope in groups:
            if isinstance(slope, np.ndarray):
                z[part] = np.sign(z[part]) * np.maximum(np.abs(z[part]) - step * slope, 0.0)
                continue
            weight = slope(np.linalg.norm(b[part])) if callable(slope) else slope
            z[part] = shrink(z[part], step * weight)
        nxt = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        if (y - z) @ (z - b) > 0:
            y, momentum = z.copy(), 1.0
        else:
            y, momentum = z + (momentum - 1) / nxt * (z - b), nxt
        moved = np.abs(z - b).max(initial=0.0)
        b = z
        if moved < tolerance:
            return b
    raise NotConverged("proximal gradient", float(moved))


def cumulative_basis(sizes: tuple[int, ...], order: int) -> tuple[np.ndarray, np.ndarray]:
    """B = C d with d the differences of order 1 or 2 down the first axis; also which d are free."""
    p = sizes[0]
    c = np.tril(np.ones((p, p)))
    free = np.zeros(p, bool)
    free[:order] = True
    if order == 2:
        rows, columns = np.indices((p, p))
        c = np.maximum(rows - columns + 1, 0).astype(float)
        c[:, 0] = 1.0
        c[:, 1:2] = np.arange(p)[:, None]
    if len(sizes) == 1:
        return c, free
    return np.kron(c, np.eye(sizes[1])), np.repeat(free, sizes[1])


ABSOLUTE = {"lasso", "elastic_net", "total_variation", "trend_filtering"}
GROUPED = {"column_group_lasso", "clipped_deviation"}
ALTERNATED = {"low_rank_interaction", "sesquivariate"}


def solve_site(a: np.ndarray, c: np.ndarray, layout: list[dict]) -> np.ndarray:
    """Coefficients of one site; ``layout`` lists slice, sizes, penalty and alpha per block.

    Penalties on absolute values and on norms of blocks may be mixed; blocks of given rank
    or with a shared factor stand alone beside quadratic penalties.
    """
    kinds = {b["penalty"] for b in layout}
    alternated = [b["penalty"] for b in layout if b["penalty"] in ALTERNATED]
    if alternated and (kinds & (ABSOLUTE | GROUPED) or len(set(alternated)) > 1 or alternated.count("sesquivariate") > 1):
        raise ValueError(f"{sorted(set(alternated))} cannot be fitted together with {sorted(kinds - set(alternated))}")
    if "low_rank_interaction" in kinds:
        return alternate_low_rank(a, c, layout)
    if "sesquivariate" in kinds:
        return alternate_shared_factor(a, c, layout)
    if not kinds & (ABSOLUTE | GROUPED):
        return least_norm(a, c)
    change, weights, groups = np.eye(len(c)), np.zeros(len(c)), []
    for b in layout:
        part, kind = b["part"], b["penalty"]
        if kind == "lasso":
            weights[part] = b["alpha"]
        elif kind == "elastic_net":
            weights[part] = b["alpha"][0] * b["alpha"][1]
        elif kind in ("total_variation", "trend_filtering"):
            basis, free = cumulative_basis(b["sizes"], 1 if kind == "total_variation" else 2)
            change[part, part] = basis
            weights[part] = np.where(free, 0.0, b["alpha"])
        elif kind == "column_group_lasso":
            groups.append((part, b["alpha"]))
        elif kind == "clipped_deviation":
            groups.append((part, _clipped(*b["alpha"])))
    if not kinds & GROUPED:
        return change @ coordinate_lasso(change.T @ a @ change, change.T @ c, weights)
    if kinds & ABSOLUTE:
        groups += [(b["part"], weights[b["part"]]) for b in layout if b["penalty"] in ABSOLUTE]
    return change @ proximal(change.T @ a @ change, change.T @ c, groups)


def _clipped(low: float, high: float, offset: float):
    return lambda norm: low if low * norm < high * norm + offset else high


def alternate_low_rank(a: np.ndarray, c: np.ndarray, layout: list[dict], rounds: int = 50, tolerance: float = 1e-10) -> np.ndarray:
    """Interactions L R' of given rank: L and R in turn, all other blocks with both."""
    b = least_norm(a, c)
    blocks = [x for x in layout if x["penalty"] == "low_rank_interaction"]
    rest = np.ones(len(c), bool)
    right = {}
    for x in blocks:
        rest[x["part"]] = False
        left, values, vt = np.linalg.svd(b[x["part"]].reshape(x["sizes"]), full_matrices=False)
        right[x["name"]] = (vt[: x["rank"]].T, (left * values)[:, : x["rank"]])
    before = np.inf
    for turn in range(rounds):
        columns = [np.eye(len(c))[:, rest]]
        for x in blocks:
            p, q = x["sizes"]
            r, left = right[x["name"]]
            t = np.kron(np.eye(p), r) if turn % 2 == 0 else np.kron(left, np.eye(q))
            full = np.zeros((len(c), t.shape[1]))
            full[x["part"]] = t
            columns.append(full)
        t = np.hstack(columns)
        d = least_norm(t.T @ a @ t, t.T @ c)
        b = t @ d
        at = int(rest.sum())
        for x in blocks:
            p, q = x["sizes"]
            r, left = right[x["name"]]
            width = (p if turn % 2 == 0 else q) * r.shape[1]
            piece = d[at : at + width]
            at += width
            right[x["name"]] = (r, piece.reshape(p, -1)) if turn % 2 == 0 else (piece.reshape(-1, q).T, left)
        value = 0.5 * b @ a @ b - c @ b
        if turn % 2 and before - value < tolerance:
            break
        before = value if turn % 2 else before
    return b


def alternate_shared_factor(a: np.ndarray, c: np.ndarray, layout: list[dict], rounds: int = 100, tolerance: float = 1e-10) -> np.ndarray:
    """Interaction b x m, with b also the coefficients of the first input's own block."""
    inter = next(x for x in layout if x["penalty"] == "sesquivariate")
    own = next(x for x in layout if x["name"] == inter["shares"])
    p, q = inter["sizes"]
    rest = np.ones(len(c), bool)
    rest[inter["part"]] = rest[own["part"]] = False
    keep = np.eye(len(c))[:, rest]
    m, b = np.zeros(q), least_norm(a[own["part"], own["part"]], c[own["part"]])
    full, before = np.zeros(len(c)), np.inf
    for _ in range(rounds):
        t = np.zeros((len(c), p))
        t[own["part"]] = np.eye(p)
        t[inter["part"]] = np.kron(np.eye(p), m[:, None])
        t = np.hstack([keep, t])
        d = least_norm(t.T @ a @ t, t.T @ c)
        b = d[keep.shape[1] :]
        fixed = np.zeros(len(c))
        fixed[own["part"]] = b
        t = np.zeros((len(c), q))
        t[inter["part"]] = np.kron(b[:, None], np.eye(q))
        t = np.hstack([keep, t])
        d = least_norm(t.T @ a @ t, t.T @ (c - a @ fixed))
        m = d[keep.shape[1] :]
        full = t @ d + fixed
        value = 0.5 * full @ a @ full - c @ full
        if before - value < tolerance:
            break
        before = value
    return full
