"""Separate models on ranges of one input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import fit
from .features import Term
from .split import bucket_by_training_range


def fit_and_predict(
    design: DataFrame, target: DataFrame, by_site: DataFrame, place: DataFrame, buckets: int,
    formula: Sequence[Term], value: str = "normalised",
) -> DataFrame:
    """One model per bucket of ``place`` (split, ts, value), predictions stitched.

    The bucket becomes part of the key of the statistics and of the solve, so all
    buckets of all sites are fitted in one job.
    """
    where = bucket_by_training_range(place, "value", buckets).select("ts", F.concat(F.lit("#"), "bucket").alias("_b"))
    names = where.select("_b").distinct().agg(F.collect_list("_b")).scalar()
    rows = design.join(where, "ts").withColumn("sig", F.concat("sig", "_b")).drop("_b")
    own = target.join(where, "ts").withColumn("site", F.concat("site", "_b")).drop("_b")
    keyed = by_site.withColumn("_b", F.explode(names)).select(
        F.concat("site", "_b").alias("site"), F.concat("sig", "_b").alias("sig")
    )
    coef = materialize(fit.coefficients(*fit.statistics(rows, own, keyed, value), formula))
    hat = fit.predict(rows, coef, keyed)
    return hat.withColumn("site", F.substring_index("site", "#", 1))


def predicted_more_than_once(predictions: DataFrame) -> DataFrame:
    """Rows predicted by several models; none is expected."""
    return predictions.groupBy("site", "ts").agg(F.count(F.lit(1)).alias("times")).filter("times <> 1")
