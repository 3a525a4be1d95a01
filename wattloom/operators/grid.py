"""Regular time grids, gap filling and alignment of series (long form)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import CHUNK_STEPS, nearest_known, row_index, seconds, with_halo


def regular_grid(
    df: DataFrame, keys: Sequence[str], ts: str, step: int, pad_steps: int = 0
) -> DataFrame:
    """All series on every step between the global first and last time.

    The grid is unrolled in two stages, chunks first, and spread over the tasks
    in between, so that one long series is not generated by one task.
    """
    keys = list(keys)
    span = df.agg(F.struct(F.min(seconds(ts)).alias("lo"), F.max(seconds(ts)).alias("hi")).alias("s")).scalar()
    last = F.floor((span["hi"] - span["lo"]) / step) + pad_steps
    pieces = (
        df.select(*keys)
        .distinct()
        .withColumn("_lo", span["lo"])
        .withColumn("_last", last)
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), F.floor(F.col("_last") / CHUNK_STEPS))))
        .repartition(*keys, "_piece")
    )
    start = F.col("_piece") * CHUNK_STEPS
    stop = F.least(F.col("_last"), start + CHUNK_STEPS - 1)
    return pieces.withColumn("_i", F.explode(F.sequence(start, stop))).select(
        *keys, F.timestamp_seconds(F.col("_lo") + F.col("_i") * step).alias(ts)
    )


def reindex(df: DataFrame, keys: Sequence[str], ts: str, step: int, pad_steps: int = 0) -> DataFrame:
    """Put every series on the full grid; times without a row get nulls."""
    grid = regular_grid(df, keys, ts, step, pad_steps)
    return grid.join(df, [*keys, ts], "left")


def backfill(df: DataFrame, keys: Sequence[str], ts: str, value: str, step: int) -> DataFrame:
    columns = df.columns
    out = nearest_known(df, keys, ts, value, step)
    return out.withColumn(value, F.col("next_value")).select(*columns)


def interpolate(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, step: int, fill_start: bool = False
) -> DataFrame:
    """Linear inside, last value held at the end, null before the first known point.

    ``fill_start`` back-fills that leading gap in the same pass.
    """
    columns = df.columns
    near = nearest_known(df, keys, ts, value, step)
    share = (seconds(ts) - F.col("prev_ts")) / (F.col("next_ts") - F.col("prev_ts"))
    line = F.col("prev_value") + (F.col("next_value") - F.col("prev_value")) * share
    start = F.col("next_value") if fill_start else F.lit(None).cast("double")
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(F.col("prev_ts").isNull(), start)
        .when(F.col("next_ts").isNull(), F.col("prev_value"))
        .otherwise(line)
    )
    return near.withColumn(value, filled).select(*columns)


def irregular_steps(
    df: DataFrame, keys: Sequence[str], ts: str, step: int, period: int = 24
) -> DataFrame:
    """Count, per series, the steps that are not one step, and the spans of
    ``period`` rows that are not ``period`` steps. Both zero on a clean grid.

    On a clean grid the row ``period`` places back lies exactly at the edge of the
    halo; if it is not inside the halo, the span is longer and counts as bad.
    """
    keys = list(keys)
    indexed = row_index(df.select(*keys, ts), keys, ts, step)
    halo, _ = with_halo(indexed, ts, before=period * step, after=0, step=step)
    w = Window.partitionBy(*keys, "chunk").orderBy(ts)
    at = seconds(ts)
    spans = halo.withColumns({"_one": at - F.lag(at, 1).over(w), "_many": at - F.lag(at, period).over(w)}).filter("owned")

    def bad(rows_back: int, column: str) -> Column:
        return (F.col("idx") >= rows_back) & (F.col(column).isNull() | (F.col(column) != rows_back * step))

    return spans.groupBy(*keys).agg(
        F.count_if(bad(1, "_one")).alias("bad_steps"),
        F.count_if(bad(period, "_many")).alias("bad_spans"),
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of each key in the given order, by an aggregate.

    ``min_by`` combines on the map side, so many copies of one key never meet in
    one window partition.
    """
    keys, rest = list(keys), [c for c in df.columns if c not in keys]
    packed = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def long_to_wide(df: DataFrame, ts: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Wide edge: one row per time and one column per series."""
    return df.groupBy(ts).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))


def wide_to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def drop_empty_series(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    keep = df.groupBy(*keys).agg(F.count(value).alias("n")).filter("n > 0").select(*keys)
    return df.join(keep, list(keys), "left_semi")


def late_series(df: DataFrame, keys: Sequence[str], ts: str, value: str, seconds_allowed: int) -> DataFrame:
    """Series whose first known value comes later than allowed after the global start."""
    start = df.agg(F.min(seconds(ts))).scalar()
    first = df.groupBy(*keys).agg(F.min(F.when(F.col(value).isNotNull(), seconds(ts))).alias("first_known"))
    return first.filter(F.col("first_known").isNull() | (F.col("first_known") - start > seconds_allowed)).select(*keys)


def constant_series(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    spread = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return spread.filter(F.col("lo").isNull() | (F.col("lo") == F.col("hi"))).select(*keys)


def incomplete_stations(df: DataFrame, station: str, quantity: str) -> DataFrame:
    """Stations that lack some of the quantities found anywhere."""
    total = df.agg(F.countDistinct(quantity)).scalar()
    have = df.groupBy(station).agg(F.countDistinct(quantity).alias("n"))
    return have.filter(F.col("n") < total).select(station)


def without(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is not in ``keys`` (all its columns form the key)."""
    return df.join(keys.distinct(), keys.columns, "left_anti")


def within(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys.distinct(), keys.columns, "left_semi")


def common_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def alignment_differences(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values found on one side only; no rows means aligned."""
    left, right = a.select(column).distinct(), b.select(column).distinct()
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("right"))
    )


def with_source(df: DataFrame, source: str = "observed") -> DataFrame:
    return df.withColumn("source", F.lit(source))

