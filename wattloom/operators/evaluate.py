"""Normalisation of the target and scores of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import seconds, with_halo

DIGITS = 8


def training_means(df: DataFrame, site: str = "site", value: str = "value") -> DataFrame:
    return df.filter("split = 'training'").groupBy(site).agg(F.avg(value).alias("mean_train"))


def normalise(df: DataFrame, site: str = "site", value: str = "value") -> DataFrame:
    """(value - mean) / mean per site, with the training mean on all splits."""
    joined = df.join(training_means(df, site, value), site)
    return joined.withColumn("normalised", (F.col(value) - F.col("mean_train")) / F.col("mean_train"))


def denormalise(df: DataFrame, column: str, name: str = "prediction") -> DataFrame:
    return df.withColumn(name, F.col(column) * F.col("mean_train") + F.col("mean_train"))


def null_counts(df: DataFrame, target: str = "target", prediction: str = "prediction") -> DataFrame:
    return df.agg(
        F.count_if(F.col(target).isNull()).alias("null_targets"),
        F.count_if(F.col(prediction).isNull()).alias("null_predictions"),
    )


def performances(
    df: DataFrame, keys: Sequence[str] = ("site",), target: str = "target", prediction: str = "prediction",
    digits: int | None = DIGITS,
) -> DataFrame:
    """mse, mae, score, mape and nmse per key, in one aggregate without a second pass.

    Rows without a target or a prediction count in none of them; the mape takes the rows
    with a non-zero target.
    """
    both = F.col(target).isNotNull() & F.col(prediction).isNotNull()
    y, p = F.when(both, F.col(target)), F.when(both, F.col(prediction))
    error = y - p
    out = df.groupBy(*keys).agg(
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.sum(error * error) / (F.var_pop(y) * F.count(y))).alias("score"),
        (100 * F.avg(F.abs(error / F.nullif(y, F.lit(0.0))))).alias("mape"),
        (F.avg(error * error) / F.pow(F.avg(y), 2.0)).alias("nmse"),
    )
    if digits is None:
        return out
    return out.select(*keys, *[F.round(c, digits).alias(c) for c in ("mse", "mae", "score", "mape", "nmse")])


def overall_error(scores: DataFrame, digits: int = DIGITS, keys: Sequence[str] = ()) -> DataFrame:
    """100 sqrt of the mean over sites of nmse, per ``keys``."""
    return scores.groupBy(*keys).agg(F.round(100 * F.sqrt(F.avg("nmse")), digits).alias("rmnmse"))


def aggregated(df: DataFrame, ts: str = "ts", target: str = "target", prediction: str = "prediction", extra: Sequence[str] = ()) -> DataFrame:
    """Sum over the sites at each time."""
    return df.groupBy(ts, *extra).agg(F.sum(target).alias(target), F.sum(prediction).alias(prediction))


def good_days(df: DataFrame) -> DataFrame:
    """Rows that are neither on a holiday nor in a Christmas break."""
    return df.filter(F.col("holidays") + F.col("xmas") == 0)


def weekly_naive(
    df: DataFrame, keys: Sequence[str] = ("site", "split"), ts: str = "ts", value: str = "value",
    period_rows: int = 168, step: int = 3600,
) -> DataFrame:
    """Prediction = value one period earlier, within each split; first period dropped.

    On a complete grid, ``period_rows`` rows back is a fixed distance in time.
    """
    back = period_rows * step
    halo, _ = with_halo(df, ts, back, 0, step)
    w = Window.partitionBy(*keys, "chunk").orderBy(seconds(ts)).rangeBetween(-back, -back)
    return (
        halo.withColumn("prediction", F.first(value).over(w))
        .filter(F.col("owned") & F.col("prediction").isNotNull() & F.col(value).isNotNull())
        .withColumnRenamed(value, "target")
        .drop("chunk", "owned")
    )


def summary(scores: DataFrame, metrics: Sequence[str] = ("score", "mape", "nmse"), approximate: bool = False) -> DataFrame:
    """mean, median, max and min over the sites for each metric."""
    middle = F.percentile_approx if approximate else F.percentile
    long = scores.select("site", *metrics).unpivot(["site"], list(metrics), "metric", "v")
    return long.groupBy("metric").agg(
        F.avg("v").alias("mean"), middle("v", F.lit(0.5)).alias("median"), F.max("v").alias("max"), F.min("v").alias("min")
    )


def quantiles(scores: DataFrame, metric: str = "mape", points: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    packed = scores.agg(F.percentile(metric, F.array(*[F.lit(p) for p in points])).alias("q"))
    return packed.select(*[F.col("q")[i].alias(f"q{int(p * 100)}") for i, p in enumerate(points)])
