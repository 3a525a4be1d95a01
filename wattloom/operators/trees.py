"""Regression trees, forests and boosted trees of all groups together.

Values are sorted into bins at the quantiles of each group's training rows. Nodes that hold many
rows are split level by level: one aggregate over (group, tree, node, feature, bin) serves all
nodes of all trees of all groups. A node of at most ``local_rows`` rows is finished inside one
task. The cuts are the same either way, so the bound moves work and not results. The rows of all
parts travel through the tree together; those without a target or with weight 0 only get the
prediction of their leaf.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

BINS = 256
LOCAL_ROWS = 20_000
#: a split must lower the squared error by more than this share of the node's sum of squares
LEAST_GAIN = 1e-12
NODE = ["_group", "_tree", "_node"]


def cut_points(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """(_group, _cuts): per feature, the middles between neighbouring quantiles of the training rows.

    With at most ``bins`` training rows the quantiles are all values, so a tree is the exact one.
    """
    points = [i / (bins - 1) for i in range(bins)]
    spread = rows.filter("_w > 0").select("_group", F.posexplode("_x").alias("f", "v"))
    levels = spread.groupBy("_group", "f").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", points, 100 * bins))).alias("q"))
    ends = F.expr("zip_with(slice(q, 1, size(q) - 1), slice(q, 2, size(q) - 1), (a, b) -> (a + b) / 2)")
    return levels.groupBy("_group").agg(F.sort_array(F.collect_list(F.struct("f", ends.alias("c")))).alias("_c")).select("_group", F.col("_c.c").alias("_cuts"))


def binned(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """Rows with ``_bins``: for each feature the number of cuts below the value. Groups without training rows are left out."""
    below = F.zip_with("_x", "_cuts", lambda x, cuts: F.size(F.filter(cuts, lambda c: c < x)))
    return rows.join(cut_points(rows, bins), "_group").withColumn("_bins", below).drop("_x", "_cuts")


def best_splits(state: DataFrame) -> DataFrame:
    """(group, tree, node, feature, bin): the split of the largest gain of every node that has one.

    Ties go to the smaller feature, then the smaller bin.
    """
    weighted = state.filter("_w > 0").select(*NODE, "_w", (F.col("_w") * F.col("_y")).alias("_wy"), F.posexplode("_bins").alias("f", "b"))
    cells = weighted.groupBy(*NODE, "f", "b").agg(F.sum("_w").alias("n"), F.sum("_wy").alias("s"))
    whole = Window.partitionBy(*NODE, "f")
    upto = whole.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = cells.select(*NODE, "f", "b", F.sum("n").over(whole).alias("n"), F.sum("s").over(whole).alias("s"),
                        F.sum("n").over(upto).alias("nl"), F.sum("s").over(upto).alias("sl")).filter("nl < n")
    right = (F.col("s") - F.col("sl")) ** 2 / (F.col("n") - F.col("nl"))
    gain = F.col("sl") ** 2 / F.col("nl") + right - F.col("s") ** 2 / F.col("n")
    best = sums.select(*NODE, F.struct(gain.alias("gain"), (-F.col("f")).alias("f"), (-F.col("b")).alias("b")).alias("_s"))
    return best.groupBy(*NODE).agg(F.max("_s").alias("_s")).select(*NODE, F.col("_s.gain").alias("gain"), (-F.col("_s.f")).alias("f"), (-F.col("_s.b")).alias("b"))


def grow(state: DataFrame, depth: int | None = None, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """``state`` (_group, _tree, _w, _y, _bins, and any other columns) with ``_fit``, the mean of the row's leaf.

    ``depth`` None grows until the nodes are pure. A node without a split is a leaf.
    """
    columns = state.columns
    state = state.withColumn("_node", F.lit("")).withColumn("_fit", F.lit(None).cast("double"))
    finished, level = [], 0
    while True:
        sizes = materialize(state.groupBy(*NODE).agg(
            F.count(F.lit(1)).alias("_rows"), (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("_mean"),
            F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("_ss")))
        large = sizes.filter(F.col("_rows") > local_rows)
        small = state.join(sizes.filter(F.col("_rows") <= local_rows).select(*NODE), NODE, "left_semi")
        left = None if depth is None else depth - level
        finished.append(_finish_locally(small, left).select(*columns, "_fit"))
        if large.isEmpty():
            break
        rows = state.join(large.drop("_rows"), NODE).withColumn("_fit", F.col("_mean"))
        if left == 0:
            finished.append(rows.select(*columns, "_fit"))
            break
        splits = best_splits(rows.drop("_mean", "_ss")).join(large, NODE).filter(F.col("gain") > LEAST_GAIN * F.col("_ss")).select(*NODE, "f", "b")
        moved = rows.drop("_mean", "_ss").join(splits, NODE, "left")
        side = F.when(F.get("_bins", "f") > F.col("b"), "1").otherwise("0")
        moved = materialize(moved.withColumn("_node", F.when(F.col("f").isNotNull(), F.concat("_node", side))))
        finished.append(moved.filter("_node IS NULL").select(*columns, "_fit"))
        state = moved.filter("_node IS NOT NULL").select(*columns, "_node", "_fit")
        level += 1
    return reduce(DataFrame.unionByName, finished)


def _finish_locally(rows: DataFrame, depth: int | None) -> DataFrame:
    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["_bins"]).astype(np.int64)
        return pdf.assign(_fit=tree(x, pdf["_y"].to_numpy(float), pdf["_w"].to_numpy(float), depth))

    return rows.groupBy(*NODE).applyInPandas(finish, rows.schema)


def tree(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int | None) -> np.ndarray:
    """Prediction of every row by the tree of the rows with weight; x holds bins."""
    out = np.empty(len(y))
    y = np.where(w > 0, y, 0.0)
    width = int(x.max(initial=0)) + 1
    cells = x + np.arange(x.shape[1]) * width
    todo = [(np.arange(len(y)), depth)]
    while todo:
        rows, left = todo.pop()
        wy = w[rows] * y[rows]
        n, s = w[rows].sum(), wy.sum()
        out[rows] = s / n
        split = None if left == 0 else _best_split(cells[rows], w[rows], wy, n, s, (wy * y[rows]).sum(), width)
        if split:
            goes = x[rows, split[0]] > split[1]
            todo += [(part, None if left is None else left - 1) for part in (rows[goes], rows[~goes])]
    return out


def _best_split(cells, w, wy, n, s, ss, width):
    features = cells.shape[1]
    flat = cells.ravel()
    nl, sl = (np.bincount(flat, np.repeat(v, features), features * width).reshape(features, width).cumsum(axis=1) for v in (w, wy))
    inner = (nl > 0) & (nl < n)
    if not inner.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(inner, sl**2 / nl + (s - sl) ** 2 / (n - nl) - s**2 / n, -np.inf)
    best = int(gain.argmax())
    return divmod(best, width) if gain.flat[best] > LEAST_GAIN * ss else None


def _prepared(rows: DataFrame, group: str, train: str, bins: int) -> DataFrame:
    """All columns of ``rows`` in ``_row``, beside group, target, weight and bins."""
    columns = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "features"]).alias("_row")
    weight = F.when(F.expr(f"({train}) AND target IS NOT NULL"), 1.0).otherwise(0.0)
    base = rows.select(columns, F.col(group).alias("_group"), weight.alias("_w"), F.col("target").alias("_y"), vector_to_array("features").alias("_x"))
    return materialize(binned(base, bins))


def bootstrap(rows: DataFrame, trees: int, seed: int) -> DataFrame:
    """One copy of the rows a tree, the weight multiplied by a Poisson(1) count from a hash of row, tree and seed."""
    u = (F.xxhash64(F.to_json("_row"), F.col("_tree"), F.lit(seed)).bitwiseAND(0xFFFFFFFF)) / F.lit(2.0**32)
    mass = np.cumsum(np.exp(-1) / np.concatenate([[1.0], np.cumprod(np.arange(1.0, 12.0))]))
    count = reduce(lambda a, b: a + b, [(u >= F.lit(float(m))).cast("double") for m in mass])
    copies = rows.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    return copies.withColumn("_w", F.col("_w") * count)


def forest(rows: DataFrame, trees: int = 100, depth: int | None = None, group: str = "site", train: str = "split = 'training'",
           output: str = "prediction", seed: int = 7, bins: int = BINS, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """``rows`` (without ``features``) and the mean over trees on bootstrapped training rows; one tree uses them as they are.

    Groups without a training row have no result; null targets are not learned from. Equal rows
    are drawn equally often in a tree.
    """
    state = _prepared(rows, group, train, bins)
    if trees == 1:
        fitted = grow(state.withColumn("_tree", F.lit(0)), depth, local_rows)
        return fitted.select("_row.*", F.col("_fit").alias(output))
    numbered = materialize(state.withColumn("_id", F.monotonically_increasing_id()))
    drawn = bootstrap(numbered, trees, seed)
    alive = drawn.groupBy("_group", "_tree").agg(F.sum("_w").alias("_n")).filter("_n > 0").select("_group", "_tree")
    fitted = grow(drawn.join(alive, ["_group", "_tree"], "left_semi").drop("_row"), depth, local_rows)
    means = fitted.groupBy("_id").agg(F.avg("_fit").alias(output))
    return numbered.join(means, "_id").select("_row.*", output)


def boosted(rows: DataFrame, trees: int = 100, depth: int = 6, step: float = 0.3, group: str = "site", train: str = "split = 'training'",
            output: str = "prediction", bins: int = BINS, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """``rows`` (without ``features``) and the sum of the training mean and ``trees`` trees, each on what the ones before left.

    Groups up to ``local_rows`` run all rounds in one task; larger ones share one job a level and round.
    """
    state = _prepared(rows, group, train, bins)
    sizes = state.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.col("_w") * F.col("_y")).alias("_s"), F.sum("_w").alias("_n"))
    state = state.join(sizes.select("_group", "_rows", (F.col("_s") / F.col("_n")).alias("_sum")), "_group")
    state = materialize(state.withColumn("_y", F.col("_y") - F.col("_sum")).withColumn("_tree", F.lit(0)))
    small, large = state.filter(F.col("_rows") <= local_rows), state.filter(F.col("_rows") > local_rows)

    def rounds(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, w = np.stack(pdf["_bins"]).astype(np.int64), pdf["_y"].to_numpy(float), pdf["_w"].to_numpy(float)
        total = pdf["_sum"].to_numpy(float)
        for _ in range(trees):
            change = step * tree(x, y, w, depth)
            y, total = y - change, total + change
        return pdf.assign(_sum=total)[["_id", "_sum"]]

    def locally(part: DataFrame) -> DataFrame:
        part = materialize(part.withColumn("_id", F.monotonically_increasing_id()))
        sums = part.drop("_row").groupBy("_group").applyInPandas(rounds, "_id long, _sum double")
        return part.drop("_sum").join(sums, "_id")

    if not large.isEmpty():
        for _ in range(trees):
            fitted = grow(large, depth, local_rows)
            large = materialize(fitted.withColumn("_y", F.col("_y") - step * F.col("_fit")).withColumn("_sum", F.col("_sum") + step * F.col("_fit")).select(state.columns))
        parts = [locally(small), large]
    else:
        parts = [locally(small)]
    return reduce(DataFrame.unionByName, [p.select("_row.*", F.col("_sum").alias(output)) for p in parts])
