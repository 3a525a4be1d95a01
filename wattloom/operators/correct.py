"""Repair of flagged values by regression on the sites without flags."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import trees as grown

R2_TRAIN = 0.9
R2_TEST = 0.5
RIDGE = 0.03


def covariates(load: DataFrame, flags: DataFrame) -> DataFrame:
    """Values of all sites without any flag, long."""
    return load.join(flags.select("site").distinct(), "site", "left_anti")


def known_rows(load: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows of the flagged sites with ``known``: 1 if the point itself has no flag."""
    bad = load.join(flags.select("site").distinct(), "site", "left_semi")
    marks = flags.select("site", "ts", F.lit(0).alias("_flag"))
    return bad.join(marks, ["site", "ts"], "left").withColumn("known", F.coalesce("_flag", F.lit(1))).drop("_flag")


def known_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("site").agg(
        F.sum("known").alias("n_known"), F.sum(1 - F.col("known")).alias("n_unknown")
    )


def repairable(rows: DataFrame) -> DataFrame:
    """Drop the sites without any known row."""
    keep = known_counts(rows).filter("n_known > 0").select("site")
    return rows.join(keep, "site", "left_semi")


def train_test(rows: DataFrame) -> DataFrame:
    """``part``: train or test (one tenth, by MD5 of site and time) or unknown."""
    digest = F.md5(F.concat_ws("|", "site", F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")))
    tenth = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10 == 9
    return rows.withColumn("part", F.when(F.col("known") == 0, "unknown").when(tenth, "test").otherwise("train"))


def z_scores(df: DataFrame, keys: list[str], value: str, train: str) -> DataFrame:
    """Add ``mean``, ``std`` (of the rows where ``train`` holds) and ``z``."""
    stats = df.filter(train).groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    scale = F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)
    return df.join(stats, keys).withColumn("z", (F.col(value) - F.col("mean")) / scale)


def vectors(rows: DataFrame, good: DataFrame) -> DataFrame:
    """Covariate vector at each time joined to the rows, all standardised on the site's training rows.

    The good sites have a value at every time, so the vectors have one length and
    no pivot over site names is needed.
    """
    bad = z_scores(rows, ["site"], "value", "part = 'train'").withColumnRenamed("z", "target")
    sorted_values = F.transform(F.array_sort(F.collect_list(F.struct("site", "value"))), lambda s: s["value"])
    wide = good.groupBy("ts").agg(array_to_vector(sorted_values).alias("_raw"))
    joined = bad.join(wide, "ts")
    scale = joined.filter("part = 'train'").groupBy("site").agg(Summarizer.metrics("mean", "std").summary(F.col("_raw")).alias("_s")).select(
        "site", F.arrays_zip(vector_to_array("_s.mean").alias("m"), vector_to_array("_s.std").alias("d")).alias("_scale"))
    scaled = F.zip_with(vector_to_array("_raw"), "_scale", lambda x, s: (x - s["m"]) / F.when(s["d"] > 0, s["d"]).otherwise(1.0))
    return joined.join(scale, "site").withColumn("features", array_to_vector(scaled)).drop("_raw", "_scale")


def impute(rows: DataFrame, good: DataFrame, kind: str = "random_forest", trees: int = 100) -> DataFrame:
    """(site, ts, value, part, prediction) of every row of the repairable sites."""
    ready = vectors(train_test(repairable(rows)), good)
    if kind == "ridge":
        fitted = ridge_each(ready)
    elif kind == "random_forest":
        fitted = grown.forest(ready, trees, train="part = 'train'", output="z_hat")
    elif kind == "boosted_trees":
        fitted = grown.boosted(ready, trees, train="part = 'train'", output="z_hat")
    else:
        raise ValueError(f"unknown imputer {kind!r}")
    return fitted.select(
        "site", "ts", "value", "part", (F.col("z_hat") * F.col("std") + F.col("mean")).alias("prediction")
    )


def ridge_each(ready: DataFrame, strength: float = RIDGE) -> DataFrame:
    """Ridge without intercept, (X'X + n strength I) b = X'y, for all sites in one job.

    Each batch of rows gives its part of X'X, X'y and n; Spark sums them by site and cell, and
    one small system per site is solved on the sums.
    """
    train = ready.filter("part = 'train'").select("site", "target", vector_to_array("features").alias("x"))
    cells = train.mapInPandas(_products, "site string, i int, j int, v double").groupBy("site", "i", "j").agg(F.sum("v").alias("v"))

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf["i"].max() + 1
        sums = np.zeros((size, size))
        sums[pdf["i"], pdf["j"]] = pdf["v"]
        p, n = size - 2, sums[-1, -1]
        found = np.linalg.solve(sums[:p, :p] + n * strength * np.eye(p), sums[:p, p])
        return pd.DataFrame({"site": [pdf["site"].iloc[0]], "_b": [found]})

    fitted = cells.groupBy("site").applyInPandas(solved, "site string, _b array<double>")
    products = F.zip_with(vector_to_array("features"), "_b", lambda x, c: x * c)
    return ready.join(fitted, "site").withColumn("z_hat", F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).drop("_b")


def _products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells of Z'Z by site for Z = (covariates, target, 1)."""
    for batch in batches:
        for site, rows in batch.groupby("site"):
            z = np.column_stack([np.stack(rows["x"]), rows["target"], np.ones(len(rows))])
            i, j = np.indices((z.shape[1], z.shape[1])).reshape(2, -1)
            yield pd.DataFrame({"site": site, "i": i, "j": j, "v": (z.T @ z).ravel()})


def r_squared(df: DataFrame, keys: list[str], value: str = "value", prediction: str = "prediction") -> DataFrame:
    error = F.col(value) - F.col(prediction)
    return df.groupBy(*keys).agg((1 - F.avg(error * error) / F.var_samp(value)).alias("r2"))


def quality_gate(r2: DataFrame, train_limit: float = R2_TRAIN, test_limit: float = R2_TEST) -> DataFrame:
    """(site, kept, reason) from (site, part, r2) on train and test rows."""
    sides = r2.groupBy("site").agg(
        F.max(F.when(F.col("part") == "train", F.col("r2"))).alias("train"),
        F.max(F.when(F.col("part") == "test", F.col("r2"))).alias("test"),
    )
    kept = (F.coalesce("train", F.lit(-1.0)) > train_limit) & (F.coalesce("test", F.lit(-1.0)) > test_limit)
    reason = F.when(kept, "").when(F.coalesce("train", F.lit(-1.0)) <= train_limit, "low r2 on training rows").otherwise("low r2 on test rows")
    return sides.select("site", kept.cast("int").alias("kept"), reason.alias("reason"))


def overwrite(load: DataFrame, flags: DataFrame, predictions: DataFrame) -> DataFrame:
    """Flagged values replaced by their predictions; everything else unchanged."""
    marked = flags.select("site", "ts", F.lit(1).alias("_flag"))
    hat = predictions.select("site", "ts", F.col("prediction").alias("_hat"))
    joined = load.join(marked, ["site", "ts"], "left").join(hat, ["site", "ts"], "left")
    return joined.withColumn("value", F.when(F.col("_flag") == 1, F.coalesce("_hat", "value")).otherwise(F.col("value"))).drop("_flag", "_hat")


def correct(load: DataFrame, flags: DataFrame, kind: str = "random_forest", train_limit: float = R2_TRAIN, test_limit: float = R2_TEST) -> tuple[DataFrame, DataFrame]:
    """Repaired load without the sites that fail, and the dropped sites with a reason.

    A flagged site that cannot be predicted at all (no row without a flag, or no site without
    any flag to learn from) is dropped too.
    """
    predictions = materialize(impute(known_rows(load, flags), covariates(load, flags), kind))
    gate = quality_gate(r_squared(predictions.filter("part <> 'unknown'"), ["site", "part"]), train_limit, test_limit)
    bad = flags.select("site").distinct()
    fate = bad.join(gate, "site", "left").select("site", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("reason", F.lit("not predicted")).alias("reason"))
    dropped = fate.filter("kept = 0").select("site", "reason")
    repaired = overwrite(load, flags, predictions).join(dropped, "site", "left_anti")
    return repaired, dropped
