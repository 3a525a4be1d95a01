"""Training and validation periods, and sub-models by range of an input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_periods(df: DataFrame, ts: str, first: str, training: str, validation: str) -> DataFrame:
    """Add ``split``: [first, first + training), then [.., .. + validation).

    Lengths are SQL intervals such as ``3 years``; rows outside both are dropped.
    """
    start = F.lit(first).cast("timestamp")
    middle = start + F.expr(f"INTERVAL {training}")
    end = middle + F.expr(f"INTERVAL {validation}")
    label = F.when((F.col(ts) >= start) & (F.col(ts) < middle), "training").when(
        (F.col(ts) >= middle) & (F.col(ts) < end), "validation"
    )
    return df.filter((F.col(ts) >= start) & (F.col(ts) < end)).withColumn("split", label)


def equal_width_bucket(x: Column, low: Column, high: Column, buckets: int) -> Column:
    position = F.floor((x - low) / (high - low) * buckets)
    return F.least(F.greatest(F.coalesce(position, F.lit(0)), F.lit(0)), F.lit(buckets - 1)).cast("int")


def bucket_by_training_range(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Add ``bucket``: equal widths of the training range, end buckets open."""
    bounds = df.filter("split = 'training'").agg(
        F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("b")
    ).scalar()
    return df.withColumn("bucket", equal_width_bucket(F.col(column), bounds["lo"], bounds["hi"], buckets))
