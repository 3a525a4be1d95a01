"""Additive hinge models (MARS of degree one) of all groups, chosen on their statistics.

Every input gets a pair of hinges at each knot. Batches of rows give their part of the products of
all hinges and the target; Spark sums them by group and cell, so the data are read once. Terms are
chosen on the sums, whose size is that of the formula, by the sweep operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: a column counts as spanned by others below this share of its variance
SPANNED = 1e-9
#: R squared a pair of hinges must add, and the price of a term in cross-validation
THRESHOLD = 1e-3
PENALTY = 3.0


def hinge_vectors(rows: DataFrame, knots: int, group: str, train: str) -> DataFrame:
    """``_h``: per input and knot max(0, x - t) and max(0, t - x); ``_t`` holds the knots per input.

    Knots are quantiles of the group's training rows; equal ones are kept once for each place, so
    all groups with the same number of inputs have vectors of the same length.
    """
    points = [(i + 1) / (knots + 1) for i in range(knots)]
    spread = rows.filter(train).select(F.col(group).alias("_group"), F.posexplode(vector_to_array("features")).alias("f", "v"))
    found = spread.groupBy("_group", "f").agg(F.percentile_approx("v", points, 100_000).alias("t"))
    every = found.groupBy("_group").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("_c")).select("_group", F.col("_c.t").alias("_t"))
    pairs = F.zip_with(vector_to_array("features"), "_t", lambda x, ts: F.flatten(F.transform(
        ts, lambda t: F.array(F.greatest(x - t, F.lit(0.0)), F.greatest(t - x, F.lit(0.0))))))
    joined = rows.withColumn("_group", F.col(group)).join(every, "_group")
    return joined.withColumn("_h", F.flatten(pairs)).drop("features")


def _products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells on and above the diagonal of Z'Z by group, Z = (hinges, target, 1)."""
    for batch in batches:
        for group, rows in batch.groupby("_group"):
            z = np.column_stack([np.stack(rows["_h"]), rows["target"], np.ones(len(rows))])
            i, j = np.triu_indices(z.shape[1])
            yield pd.DataFrame({"_group": group, "i": i, "j": j, "v": (z.T @ z)[i, j]})


def sweep(s: np.ndarray, k: int) -> None:
    """Take column ``k`` into the regression: what is left of all products, in place."""
    s -= np.outer(s[:, k], s[k]) / s[k, k]


def pair_gains(s: np.ndarray) -> np.ndarray:
    """Squared error that each pair of columns (0, 1), (2, 3), ... would explain; the target is last."""
    d, y = np.diag(s)[:-1], s[:-1, -1]
    even = np.arange(0, len(d), 2)
    first = np.where(d[even] >= d[even + 1], even, even + 1)
    second = even + (even + 1 - first)
    a, cross = d[first], s[first, second]
    with np.errstate(divide="ignore", invalid="ignore"):
        left = d[second] - cross**2 / a
        one = np.where(a > SPANNED, y[first] ** 2 / a, 0.0)
        two = np.where((a > SPANNED) & (left > SPANNED), (y[second] - cross * y[first] / a) ** 2 / left, 0.0)
    return one + two


def forward(s: np.ndarray, threshold: float) -> list[int]:
    """Columns of the pairs taken one after the other, until none adds ``threshold`` to R squared.

    ``s`` is the correlation matrix of hinges and target. Ties go to the first pair.
    """
    s, taken = s.copy(), []
    while s.shape[0] > 1:
        gains = pair_gains(s)
        best = int(gains.argmax())
        if gains[best] <= threshold:
            break
        for k in sorted((2 * best, 2 * best + 1), key=lambda c: -s[c, c]):
            if s[k, k] > SPANNED:
                sweep(s, k)
                s[k, :] = s[:, k] = 0.0
                taken.append(k)
    return taken


def backward(s: np.ndarray, taken: list[int], rows: float, penalty: float) -> list[int]:
    """The subset of least generalised cross-validation on the way from all terms to none."""
    def score(terms: list[int], error: float) -> float:
        price = len(terms) + 1 + penalty * len(terms) / 2
        return error / (1 - price / rows) ** 2 if price < rows else np.inf

    best, terms = ([], score([], 1.0)), list(taken)
    while terms:
        inverse = np.linalg.inv(s[np.ix_(terms, terms)])
        b = inverse @ s[terms, -1]
        value = score(terms, max(1 - b @ s[terms, -1], 0.0))
        if value < best[1]:
            best = (list(terms), value)
        terms.pop(int((b**2 / np.diag(inverse)).argmin()))
    return best[0]


def choose(sums: np.ndarray, threshold: float = THRESHOLD, penalty: float = PENALTY) -> np.ndarray:
    """Coefficients of all hinges and, last, the constant, from Z'Z; zero where a term is not in the model."""
    rows, mean = sums[-1, -1], sums[-1, :-1] / sums[-1, -1]
    cov = sums[:-1, :-1] / rows - np.outer(mean, mean)
    spread = np.diag(cov) > 1e-12 * np.maximum(np.diag(sums)[:-1] / rows, 1e-300)
    scale = np.where(spread, np.sqrt(np.where(spread, np.diag(cov), 1.0)), 1.0)
    s = cov / np.outer(scale, scale) * np.outer(spread, spread)
    out = np.zeros(len(mean))
    if spread[-1]:
        terms = sorted(backward(s, forward(s, threshold), rows, penalty))
        if terms:
            out[terms] = np.linalg.solve(s[np.ix_(terms, terms)], s[terms, -1]) * scale[-1] / scale[terms]
    out[-1] = mean[-1] - out[:-1] @ mean[:-1]
    return out


def mars(rows: DataFrame, knots: int = 3, group: str = "site", train: str = "split = 'training'", output: str = "prediction",
         threshold: float = THRESHOLD, penalty: float = PENALTY) -> tuple[DataFrame, DataFrame]:
    """``rows`` (without ``features``) and their predictions; the model as (group, input, knot, side, t, coefficient).

    The constant has null in all places. Null targets are not learned from; groups without a
    training row have no result.
    """
    known = f"({train}) AND target IS NOT NULL"
    hinged = materialize(hinge_vectors(rows, knots, group, known))
    cells = hinged.filter(known).select("_group", "_h", "target").mapInPandas(_products, "_group string, i int, j int, v double")
    sums = cells.groupBy("_group", "i", "j").agg(F.sum("v").alias("v"))

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf["i"].max() + 1
        z = np.zeros((size, size))
        z[pdf["i"], pdf["j"]] = z[pdf["j"], pdf["i"]] = pdf["v"]
        return pd.DataFrame({"_group": [pdf["_group"].iloc[0]], "_b": [choose(z, threshold, penalty)]})

    found = materialize(sums.groupBy("_group").applyInPandas(solved, "_group string, _b array<double>"))
    terms = F.zip_with("_h", F.expr("slice(_b, 1, size(_b) - 1)"), lambda h, b: h * b)
    fitted = hinged.join(found, "_group").withColumn(output, F.aggregate(terms, F.element_at("_b", -1), lambda a, v: a + v))
    places = hinged.select("_group", "_t").dropDuplicates(["_group"]).join(found, "_group").select("_group", "_t", F.posexplode("_b").alias("i", "coefficient"))
    inside = F.col("i") < 2 * knots * F.size("_t")
    at = F.when(inside, F.floor(F.col("i") / (2 * knots)).cast("int"))
    knot = F.when(inside, (F.floor(F.col("i") / 2) % knots).cast("int"))
    model = places.filter((F.col("coefficient") != 0) | ~inside).select(
        F.col("_group").alias(group), at.alias("input"), knot.alias("knot"), F.when(inside, F.when(F.col("i") % 2 == 0, "up").otherwise("down")).alias("side"),
        F.get(F.get("_t", at), knot).alias("t"), "coefficient")
    return fitted.drop("_group", "_t", "_h", "_b"), model
