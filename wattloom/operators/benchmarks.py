"""Tree, hinge and smooth benchmark models on the same inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees as grown
from .features import KEY, Factor, Term


def standardise(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(value - mean) / std per key, with training mean and sample std on all splits."""
    keys = list(keys)
    stats = df.filter("split = 'training'").groupBy(*keys).agg(
        F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std")
    )
    scale = F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)
    return df.join(stats, keys).withColumn(value, (F.col(value) - F.col("_mean")) / scale).drop("_mean", "_std")


def site_inputs(inputs: DataFrame, sites: DataFrame, assignment: DataFrame) -> DataFrame:
    """(site, name_input, transformation, parameter, location): inputs each site may use.

    Inputs that are not assigned go to every site; their list has the length of
    the formula, so it is attached as an array and not joined.
    """
    listed = inputs.select(*KEY, "location").distinct()
    names = assignment.select("name_input").distinct()
    free = listed.join(names, "name_input", "left_anti")
    common = free.agg(F.collect_list(F.struct(*KEY, "location"))).scalar()
    shared = sites.select("site", F.explode(common).alias("_i")).select("site", "_i.*")
    owned = listed.join(assignment, ["name_input", "location"]).select("site", *KEY, "location")
    return shared.unionByName(owned)


def distinct_counts(inputs: DataFrame) -> DataFrame:
    return inputs.groupBy(*KEY, "location").agg(F.countDistinct("value").alias("n_distinct"))


def site_vectors(inputs: DataFrame, target: DataFrame, assignment: DataFrame, value: str = "value") -> DataFrame:
    """(site, split, ts, target, features): one vector per site and time.

    Shared inputs are collected once per time; a site adds its own, if it has any. Rows whose
    inputs are not all there, or that have none, are dropped.
    """
    names = assignment.select("name_input").distinct()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*KEY, "location", "value"))), lambda s: s["value"])
    known = inputs.filter("value IS NOT NULL")
    shared = known.join(names, "name_input", "left_anti").groupBy("split", "ts").agg(ordered.alias("_shared"))
    owned = known.join(assignment, ["name_input", "location"]).groupBy("site", "split", "ts").agg(ordered.alias("_own"))
    times = known.select("split", "ts").distinct()
    rows = target.select("site", "ts", F.col(value).alias("target")).join(times, "ts")
    none = F.array().cast("array<double>")
    both = rows.join(shared, ["split", "ts"], "left").join(owned, ["site", "split", "ts"], "left").select(
        "site", "split", "ts", "target", F.concat(F.coalesce("_shared", none), F.coalesce("_own", none)).alias("_all"))
    lengths = both.groupBy("site").agg(F.max(F.size("_all")).alias("_length")).filter("_length > 0")
    full = both.join(lengths, "site").filter(F.size("_all") == F.col("_length"))
    return full.select("site", "split", "ts", "target", array_to_vector("_all").alias("features"))


def tree_benchmark(vectors: DataFrame, kind: str, trees: int = 100) -> DataFrame:
    """Predictions of all sites: forests and single trees grow until their leaves are pure."""
    if kind == "random_forest":
        return grown.forest(vectors, trees)
    if kind == "regression_tree":
        return grown.forest(vectors, 1)
    if kind == "boosted_trees":
        return grown.boosted(vectors, trees)
    raise ValueError(f"unknown model {kind!r}")


def knots(inputs: DataFrame, count: int, approximate: bool = False) -> DataFrame:
    """Inner quantiles of each input on the training rows."""
    points = [(i + 1) / (count + 1) for i in range(count)]
    function = F.percentile_approx if approximate else F.percentile
    wanted = points if approximate else F.array(*[F.lit(p) for p in points])
    return inputs.filter("split = 'training'").groupBy(*KEY, "location").agg(function("value", wanted).alias("knots"))


def hinges(inputs: DataFrame, knot_table: DataFrame) -> DataFrame:
    """max(0, x - t) and max(0, t - x) at every knot, as further inputs."""
    rows = inputs.join(knot_table, [*KEY, "location"]).select(
        *KEY, "location", "split", "ts", "value", F.posexplode("knots").alias("k", "t")
    )
    up = F.greatest(F.lit(0.0), F.col("value") - F.col("t"))
    down = F.greatest(F.lit(0.0), F.col("t") - F.col("value"))
    sided = rows.withColumn("_side", F.explode(F.array(
        F.struct(F.lit("up").alias("s"), up.alias("v")), F.struct(F.lit("down").alias("s"), down.alias("v"))
    )))
    return sided.select(
        "name_input", "transformation",
        F.concat_ws(":", "parameter", "_side.s", F.col("k").cast("string")).alias("parameter"),
        "location", "split", "ts", F.col("_side.v").alias("value"),
    )


def gam_formula(
    univariate: dict[tuple[str, str, str], str], bivariate: dict[tuple, str],
    constant: set[tuple[str, str, str]] = frozenset(), intervals: int = 8, alpha: float = 1e-3,
) -> list[Term]:
    """Terms of a smooth model: ``s`` smooth, '' linear, ``by`` smooth x indicator,
    ``te`` tensor. A constant input enters linearly."""
    def factor(key, smooth: bool, n: int = intervals) -> Factor:
        name, transformation, parameter = key
        return Factor(name, n if smooth and key not in constant else "p1", transformation, parameter)

    terms = []
    for key, kind in univariate.items():
        f = factor(key, kind == "s")
        terms.append(Term((f,), "smoothing" if isinstance(f.nodes, int) else "ridge", alpha if isinstance(f.nodes, int) else 1e-8))
    for (one, two), kind in bivariate.items():
        pair = (factor(one, True), factor(two, kind != "by", 4))
        terms.append(Term(pair, "smoothing", alpha))
    return terms
