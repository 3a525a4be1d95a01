"""Detection of bad values in regular series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import seconds

WEEK_HOURS = 168
HALF_WINDOW = 5
LOW_RATIO = 0.2
CHUNK_PERIODS = 104


def indexed(df: DataFrame, ts: str, step: int) -> DataFrame:
    """Row number and row count on a complete grid, by arithmetic on the time."""
    span = df.agg(F.struct(F.min(seconds(ts)).alias("lo"), F.max(seconds(ts)).alias("hi")).alias("s")).scalar()
    return df.withColumn("idx", F.floor((seconds(ts) - span["lo"]) / step)).withColumn(
        "n", F.floor((span["hi"] - span["lo"]) / step) + 1
    )


def point_error(value: str):
    column = F.col(value)
    return F.when(column.isNull(), "null").when(column == 0, "zero").when(column < 0, "neg")


def point_flags(df: DataFrame, site: str = "site", ts: str = "ts", value: str = "value", step: int = 3600) -> DataFrame:
    """Null, zero and negative points."""
    return (
        indexed(df, ts, step)
        .withColumn("error_type", point_error(value))
        .filter("error_type IS NOT NULL")
        .select(site, ts, "idx", "error_type")
    )


def window_statistics(
    df: DataFrame, site: str = "site", ts: str = "ts", value: str = "value", step: int = 3600,
    period: int = WEEK_HOURS, half: int = HALF_WINDOW,
) -> DataFrame:
    """Valid points and trimmed mean of the same hour in the weeks around each row.

    A full window has ``half`` past points, the row and ``half - 1`` later ones;
    near the end of the series it shrinks to less than (n - i) div period ahead.
    Rows are partitioned by (site, phase in the period, chunk of periods), with a
    copy of ``half`` periods on both sides.
    """
    base = indexed(df, ts, step).withColumn("point_error", point_error(value))
    turn = F.floor(F.col("idx") / period)
    first = F.floor((turn - (half - 1)) / CHUNK_PERIODS)
    last = F.floor((turn + half) / CHUNK_PERIODS)
    halo = (
        base.withColumn("_chunk", F.explode(F.sequence(first, last)))
        .withColumn("_own", F.col("_chunk") == F.floor(turn / CHUNK_PERIODS))
        .withColumn("_phase", F.col("idx") % period)
    )
    w = Window.partitionBy(site, "_phase", "_chunk").orderBy("idx").rowsBetween(-half, half - 1)
    usable = F.when(F.col("point_error").isNull(), F.struct(F.col("idx").alias("i"), F.col(value).alias("v")))
    limit = F.col("idx") + period * F.least(F.lit(half), F.floor((F.col("n") - F.col("idx")) / period))
    near = halo.withColumn("_near", F.collect_list(usable).over(w)).filter("_own")
    values = F.array_sort(F.transform(F.filter("_near", lambda p: p["i"] < limit), lambda p: p["v"]))
    out = near.withColumn("_values", values).withColumn("n_valid", F.size("_values"))
    inner = F.slice("_values", F.lit(2), F.greatest(F.col("n_valid") - 2, F.lit(0)))
    mean = F.aggregate(inner, F.lit(0.0), lambda acc, v: acc + v) / (F.col("n_valid") - 2)
    return out.withColumn("trimmed_mean", F.when(F.col("n_valid") > 2, mean)).select(
        site, ts, value, "idx", "point_error", "n_valid", "trimmed_mean"
    )


def detect_errors(
    df: DataFrame, site: str = "site", ts: str = "ts", value: str = "value", step: int = 3600,
    period: int = WEEK_HOURS, half: int = HALF_WINDOW, low_ratio: float = LOW_RATIO,
) -> DataFrame:
    """All flags: ``null``, ``zero``, ``neg``, ``bad_win`` and ``too_low``; one per row at most."""
    stats = window_statistics(df, site, ts, value, step, period, half)
    error = (
        F.when(F.col("point_error").isNotNull(), F.col("point_error"))
        .when(F.col("n_valid") <= 2, "bad_win")
        .when(F.col(value) < low_ratio * F.col("trimmed_mean"), "too_low")
    )
    return stats.withColumn("error_type", error).filter("error_type IS NOT NULL").select(site, ts, "idx", "error_type")


def affected_sites(flags: DataFrame, site: str = "site") -> DataFrame:
    return flags.groupBy("error_type").agg(F.countDistinct(site).alias("n_sites"))
