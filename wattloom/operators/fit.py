"""Penalised additive models: statistics in Spark, one small solve per site.

Objective per site, without intercept:
(1 / 2n) |Y - X B|^2 + the penalties of the formula.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import features, solve, stats
from .features import Term, term_name

# the solves reach the executors inside the tasks, without installing the package there
for _module in (features, solve, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)

SITES_PER_GROUP = 256
COEFFICIENTS = "site string, block string, idx int, value double"


def statistics(
    design: DataFrame, target: DataFrame, by_site: DataFrame, value: str = "normalised", parts: tuple[DataFrame, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """X'X per design and X'Y per site on the training rows, written once each.

    With ``parts`` (of ``features.parts``) the products of shared features are formed once for all
    designs, and not once for each.

    A site that lacks targets at some times of its design gets a ``sig`` of its own, with
    the X'X of its own times: that of the design less that of the missing ones.
    """
    train_x = design.filter("split = 'training'")
    train_y = target.filter(F.col("split") == "training").filter(F.col(value).isNotNull())
    if parts is None:
        whole = materialize(stats.gram(train_x))
    else:
        blocks = materialize(stats.gram_of_parts(parts[0].filter("split = 'training'"), parts[1]))
        whole = materialize(stats.of_designs(blocks, parts[1]))
    gaps = materialize(_missing_times(train_x, train_y, by_site))
    broken = gaps.select("site", "sig").distinct()
    missing = stats.gram(gaps.join(train_x, ["sig", "ts"]), ["sig", "site"])
    place = ["block1", "idx1", "block2", "idx2"]
    own = whole.join(broken, "sig").join(missing.withColumnRenamed("value", "_less"), ["sig", "site", *place], "left").select(
        _own_sig().alias("sig"), *place, (F.col("value") - F.coalesce("_less", F.lit(0.0))).alias("value"))
    xtx = materialize(whole.unionByName(own))
    renamed = by_site.join(broken.select("site", F.lit(True).alias("_broken")), "site", "left").select(
        "site", "sig", F.when(F.col("_broken"), _own_sig()).otherwise(F.col("sig")).alias("_new"))
    xty = stats.cross(train_x, train_y, by_site, value).join(renamed, ["site", "sig"]).select(
        F.col("_new").alias("sig"), "site", "block", "idx", "value")
    return xtx, materialize(xty.join(stats.norms(train_y, value), "site"))


def _own_sig():
    return F.concat_ws("#", "sig", "site")


def _missing_times(train_x: DataFrame, train_y: DataFrame, by_site: DataFrame) -> DataFrame:
    """(sig, site, ts): times of a site's design at which it has no target.

    Counts tell complete sites from others, so only the latter meet all their times.
    """
    times = train_x.select("sig", "ts").distinct()
    long = times.groupBy("sig").agg(F.count("*").alias("_times"))
    have = train_y.join(by_site, "site").join(times, ["sig", "ts"], "left_semi").select("sig", "site", "ts").distinct()
    counted = have.groupBy("sig", "site").agg(F.count("*").alias("_have"))
    lacking = counted.join(long, "sig").filter("_have < _times").select("sig", "site")
    return lacking.join(times, "sig").join(have, ["sig", "site", "ts"], "left_anti")


def one_design(xty: DataFrame, what: str) -> None:
    """Fits that couple sites need one design and complete targets for all of them."""
    if xty.select("sig").distinct().limit(2).count() > 1:
        raise ValueError(f"{what} needs one design shared by all sites, without missing targets")


def grouped(xtx: DataFrame, xty: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Key both statistics by (sig, bucket), at most about 256 sites each.

    X'X is copied once per bucket and not once per site; a design shared by very
    many sites is spread over many tasks.
    """
    sites = xty.select("sig", "site").distinct()
    counts = sites.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / SITES_PER_GROUP).alias("_buckets"))
    right = xty.join(counts, "sig").withColumn("bucket", F.pmod(F.xxhash64("site"), F.col("_buckets")))
    left = xtx.join(counts, "sig").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("_buckets") - 1)))
    return left.drop("_buckets"), right.drop("_buckets")


def _layout(blocks: Sequence[str], formula: Sequence[Term]) -> tuple[list[dict], dict[str, int]]:
    terms = {term_name(i): term for i, term in enumerate(formula)}
    layout, start, at = [], {}, 0
    for block in sorted(blocks):
        term = terms[block.split("@", 1)[0]]
        layout.append({
            "name": block, "part": slice(at, at + term.size), "sizes": term.sizes,
            "penalty": term.penalty, "alpha": term.alpha, "rank": term.structure,
            "cyclic": term.cyclic,
        })
        start[block] = at
        at += term.size
    for entry in layout:
        if entry["penalty"] == "sesquivariate":
            head, places = entry["name"].split("@", 1)
            shared = terms[head].factors[0]
            owner = next(k for k, t in terms.items() if t.factors == (shared,))
            entry["shares"] = f"{owner}@{places.split('|')[0]}"
    return layout, start


def _matrix(xtx: pd.DataFrame, start: dict[str, int], size: int) -> np.ndarray:
    i = xtx.block1.map(start).to_numpy() + xtx.idx1.to_numpy()
    j = xtx.block2.map(start).to_numpy() + xtx.idx2.to_numpy()
    a = np.zeros((size, size))
    a[i, j] = xtx.value.to_numpy()
    a[j, i] = xtx.value.to_numpy()
    return a


def _quadratic_part(layout: list[dict], size: int) -> np.ndarray:
    q = np.zeros((size, size))
    for entry in layout:
        part = entry["part"]
        q[part, part] = solve.quadratic(entry["penalty"], entry["alpha"], entry["sizes"], entry["cyclic"])
    return q


def _solver(formula: Sequence[Term]):
    """Function of (X'X, X'Y) of one group, in pandas, to the coefficients."""

    def run(xtx: pd.DataFrame, xty: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"site": [], "block": [], "idx": [], "value": []})
        if xtx.empty or xty.empty:
            return out.astype({"site": str, "block": str, "idx": "int32", "value": float})
        layout, start = _layout(pd.unique(pd.concat([xtx.block1, xtx.block2])), formula)
        size = layout[-1]["part"].stop
        names = np.repeat([e["name"] for e in layout], [e["part"].stop - e["part"].start for e in layout])
        index = np.concatenate([np.arange(e["part"].stop - e["part"].start) for e in layout]).astype("int32")
        whole = _matrix(xtx, start, size)
        plain = not any(e["penalty"] in _ITERATIVE for e in layout)
        pieces = []
        for n, same in xty.groupby("n"):
            sites = sorted(same.site.unique())
            column = {site: k for k, site in enumerate(sites)}
            c = np.zeros((size, len(sites)))
            rows = same.block.map(start).to_numpy() + same.idx.to_numpy()
            c[rows, same.site.map(column).to_numpy()] = same.value.to_numpy() / n
            a = whole / n + _quadratic_part(layout, size)
            b = solve.least_norm(a, c) if plain else np.column_stack([solve.solve_site(a, c[:, k], layout) for k in range(len(sites))])
            pieces.append(pd.DataFrame({
                "site": np.repeat(sites, size), "block": np.tile(names, len(sites)),
                "idx": np.tile(index, len(sites)), "value": b.T.ravel(),
            }))
        return pd.concat(pieces)

    return run


_ITERATIVE = {
    "lasso", "elastic_net", "total_variation", "trend_filtering", "column_group_lasso",
    "clipped_deviation", "low_rank_interaction", "sesquivariate",
}


def coefficients(xtx: DataFrame, xty: DataFrame, formula: Sequence[Term]) -> DataFrame:
    """(site, block, idx, value): one grouped solve per design and bucket of sites."""
    left, right = grouped(xtx, xty)
    return left.groupBy("sig", "bucket").cogroup(right.groupBy("sig", "bucket")).applyInPandas(
        _solver(formula), COEFFICIENTS
    )


def second_differences(coef: DataFrame, term: Term, axis: int = 0) -> DataFrame:
    """(site, block, idx, difference); ``idx`` numbers the rows of the difference."""
    if len(term.sizes) == 1:
        line, position = F.lit(0), F.col("idx")
    else:
        width = term.sizes[1]
        i, j = F.floor(F.col("idx") / width), F.col("idx") % width
        line, position = (j, i) if axis == 0 else (i, j)
    w = Window.partitionBy("site", "block", "_line").orderBy("_position")
    rows = coef.withColumns({"_line": line, "_position": position})
    value = F.col("value")
    if term.cyclic[axis]:
        line_ = Window.partitionBy("site", "block", "_line")
        before = F.coalesce(F.lag(value, 1).over(w), F.max_by("value", "_position").over(line_))
        after = F.coalesce(F.lead(value, 1).over(w), F.min_by("value", "_position").over(line_))
        out, first = rows.withColumn("difference", before - 2 * value + after), F.col("_position")
        length = term.sizes[axis]
    else:
        diff = value - 2 * F.lag(value, 1).over(w) + F.lag(value, 2).over(w)
        out, first = rows.withColumn("difference", diff).filter("_position >= 2"), F.col("_position") - 2
        length = term.sizes[axis] - 2
    if len(term.sizes) == 1:
        index = first
    elif axis == 0:
        index = first * term.sizes[1] + F.col("_line")
    else:
        index = F.col("_line") * length + first
    return out.select("site", "block", index.cast("int").alias("idx"), "difference")


def penalties(coef: DataFrame, formula: Sequence[Term]) -> DataFrame:
    """(block, penalty): value of each block's penalty for given coefficients."""
    parts = []
    for position, term in enumerate(formula):
        rows = coef.filter(F.col("block").startswith(f"{term_name(position)}@"))
        parts.append(_penalty(rows, term).select("block", F.lit(term.penalty).alias("kind"), "penalty"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _penalty(rows: DataFrame, term: Term) -> DataFrame:
    value, alpha = F.col("value"), term.alpha
    per_block = rows.groupBy("block")
    if term.penalty == "ridge":
        return per_block.agg((0.5 * alpha * F.sum(value * value)).alias("penalty"))
    if term.penalty == "lasso":
        return per_block.agg((alpha * F.sum(F.abs(value))).alias("penalty"))
    if term.penalty == "elastic_net":
        share, strength = alpha
        return per_block.agg((strength * F.sum(share * F.abs(value) + (1 - share) / 2 * value * value)).alias("penalty"))
    if term.penalty in ("row_group_lasso", "column_group_lasso", "clipped_deviation"):
        inner = ["block", "idx"] if term.penalty == "row_group_lasso" else ["block", "site"]
        norms = rows.groupBy(*inner).agg(F.sqrt(F.sum(value * value)).alias("norm"))
        norm = F.col("norm")
        if term.penalty == "clipped_deviation":
            low, high, offset = alpha
            return norms.groupBy("block").agg(F.sum(F.least(low * norm, high * norm + offset)).alias("penalty"))
        return norms.groupBy("block").agg((alpha * F.sum(norm)).alias("penalty"))
    if term.penalty in ("total_variation", "trend_filtering"):
        width = term.sizes[1] if len(term.sizes) > 1 else 1
        w = Window.partitionBy("site", "block", F.col("idx") % width).orderBy("idx")
        step = value - F.lag(value, 1).over(w)
        if term.penalty == "trend_filtering":
            step = value - 2 * F.lag(value, 1).over(w) + F.lag(value, 2).over(w)
        return rows.withColumn("_d", F.abs(step)).groupBy("block").agg((alpha * F.sum("_d")).alias("penalty"))
    axes = [0] if term.penalty == "factor_smoothing" or len(term.sizes) == 1 else [0, 1]
    sums = None
    for axis in axes:
        if term.sizes[axis] <= 2:
            continue
        diff = second_differences(rows, term, axis)
        if term.penalty == "block_smoothing":
            norms = diff.groupBy("block", "idx").agg(F.sqrt(F.sum(F.pow("difference", F.lit(2.0)))).alias("norm"))
            part = norms.groupBy("block").agg((0.5 * alpha[0] * F.sum(F.pow("norm", F.lit(alpha[1])))).alias("penalty"))
        else:
            part = diff.groupBy("block").agg((0.5 * alpha * F.sum(F.pow("difference", F.lit(2.0)))).alias("penalty"))
        sums = part if sums is None else sums.unionByName(part)
    if sums is None:
        return per_block.agg(F.lit(0.0).alias("penalty"))
    return sums.groupBy("block").agg(F.sum("penalty").alias("penalty"))


ROWS_PER_SALT = 100_000


def salts(design: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """(sig, _salts): into how many parts the rows of each design are dealt, from their count."""
    return design.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / rows_per_salt).cast("int").alias("_salts"))


def predict(
    design: DataFrame, coef: DataFrame, by_site: DataFrame, without_terms: Sequence[int] = (), rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """(site, split, ts, prediction): sum of value x coefficient over the features.

    Coefficients are packed per site into one array per block, so a prediction is
    a fold over the features of a design row, without exploding them. The join on
    ``sig`` is salted by time in proportion to the rows of the design, because one may serve
    very many; a small design gets one salt, so its coefficients are not copied.
    """
    dropped = [term_name(i) for i in without_terms]
    used = coef.filter(~F.split("block", "@")[0].isin(dropped)) if dropped else coef
    entries = F.map_from_entries(F.collect_list(F.struct("idx", "value")))
    dense = F.transform(
        F.sequence(F.lit(0), F.max("idx")), lambda i: F.coalesce(F.element_at(entries, i), F.lit(0.0))
    )
    blocks = used.groupBy("site", "block").agg(dense.alias("_b"))
    packed = blocks.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("block", "_b"))).alias("_coef"))
    dealt = salts(design, rows_per_salt)
    signed = packed.join(by_site, "site").join(dealt, "sig").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    rows = design.join(dealt, "sig").withColumn("_salt", F.pmod(F.xxhash64("ts"), F.col("_salts")).cast("int")).drop("_salts")

    def add(total, f):
        return total + f["value"] * F.coalesce(F.get(F.element_at("_coef", f["block"]), f["idx"]), F.lit(0.0))

    return rows.join(signed, ["sig", "_salt"]).select(
        "site", "split", "ts", F.aggregate("features", F.lit(0.0), add).alias("prediction")
    )


def fit_term(df: DataFrame, target: str = "target", prediction: str = "prediction", keys: Sequence[str] = ("site",)) -> DataFrame:
    error = F.col(target) - F.col(prediction)
    return df.groupBy(*keys).agg((0.5 * F.avg(error * error)).alias("fit"))


def mean_baseline(df: DataFrame, value: str = "value") -> DataFrame:
    """Fit term per split, summed over sites, with the training mean as prediction."""
    means = df.filter("split = 'training'").groupBy("site").agg(F.avg(value).alias("_mean"))
    error = F.col(value) - F.col("_mean")
    per_site = df.join(means, "site").groupBy("site", "split").agg((0.5 * F.avg(error * error)).alias("fit"))
    return per_site.groupBy("split").agg(F.sum("fit").alias("fit"))


def objective(fitted: DataFrame, coef: DataFrame, formula: Sequence[Term]) -> DataFrame:
    """One row: fit term summed over sites, penalty, and their sum."""
    total = fit_term(fitted).agg(F.sum("fit").alias("fit"))
    penalty = penalties(coef, formula).agg(F.coalesce(F.sum("penalty"), F.lit(0.0))).scalar()
    return total.withColumn("penalty", penalty).withColumn("objective", F.col("fit") + F.col("penalty"))


def sum_consistent(xtx: DataFrame, xty: DataFrame, groups: DataFrame, formula: Sequence[Term]) -> DataFrame:
    """Fit with the extra term (1/2) w (1/n) |sum over the group of (Y - X B)|^2.

    ``groups`` is (site, group); w is 1 / (sites of the group). For a design shared
    by the group the sum S of its coefficients solves a system of its own, with the
    statistics summed over the group, and each site then follows from S.
    """
    one_design(xty, "the sum-consistent fit")
    counts = groups.groupBy("group").agg(F.count(F.lit(1)).alias("members"))
    keyed = xty.join(groups, "site")
    totals = keyed.groupBy("sig", "group", "block", "idx").agg(F.sum("value").alias("total"))
    per_site = keyed.select("sig", "site", "n", "yty", "group").distinct().join(counts, "group")
    right = (
        per_site.join(totals, ["sig", "group"])
        .join(xty.select("site", "block", "idx", "value"), ["site", "block", "idx"], "left")
        .withColumn("value", F.coalesce("value", F.lit(0.0)))
    )
    left, right = grouped(xtx, right)

    def run(xtx_rows: pd.DataFrame, xty_rows: pd.DataFrame) -> pd.DataFrame:
        layout, start = _layout(pd.unique(pd.concat([xtx_rows.block1, xtx_rows.block2])), formula)
        size = layout[-1]["part"].stop
        names = np.repeat([e["name"] for e in layout], [e["part"].stop - e["part"].start for e in layout])
        index = np.concatenate([np.arange(e["part"].stop - e["part"].start) for e in layout]).astype("int32")
        whole, q = _matrix(xtx_rows, start, size), _quadratic_part(layout, size)
        pieces = []
        for site, rows in xty_rows.groupby("site"):
            n, members = rows.n.iloc[0], rows.members.iloc[0]
            at = rows.block.map(start).to_numpy() + rows.idx.to_numpy()
            c, total = np.zeros(size), np.zeros(size)
            c[at], total[at] = rows.value.to_numpy() / n, rows.total.to_numpy() / n
            a, w = whole / n, 1.0 / members
            joint = 1 + w * members
            s = solve.least_norm(joint * a + q, joint * total)
            b = solve.least_norm(a + q, c + w * (total - a @ s))
            pieces.append(pd.DataFrame({"site": site, "block": names, "idx": index, "value": b}))
        return pd.concat(pieces)

    return left.groupBy("sig", "bucket").cogroup(right.groupBy("sig", "bucket")).applyInPandas(run, COEFFICIENTS)
