"""From raw series to prepared tables: the chains for load and weather."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import correct, detect, grid
from .chunks import seconds

HOUR = 3600
PAD_STEPS = 2
LATE = 24 * HOUR


def prepare_load(
    raw: DataFrame, kind: str = "random_forest", step: int = HOUR, period: int = detect.WEEK_HOURS,
    train_limit: float = correct.R2_TRAIN, test_limit: float = correct.R2_TEST,
) -> tuple[DataFrame, DataFrame]:
    """(site, ts, value) on the full grid, gaps back-filled, flagged values repaired; and the
    dropped sites with a reason.

    What stays null at the end of a series is flagged and repaired like any other bad value.
    """
    load = materialize(grid.backfill(grid.reindex(raw, ["site"], "ts", step), ["site"], "ts", "value", step))
    flags = materialize(detect.detect_errors(load, step=step, period=period))
    return correct.correct(load, flags, kind, train_limit, test_limit)


def usable_series(raw: DataFrame, late: int = LATE) -> tuple[DataFrame, DataFrame]:
    """(station, quantity) to keep, and the dropped stations, from one aggregate of the raw rows.

    Series without a value, with one value only, or whose first value comes more than ``late``
    seconds after the first time of all go. A station that then lacks a quantity that some
    station has goes whole. Dropped stations are those and the ones with a late series.
    """
    start = raw.agg(F.min(seconds("ts"))).scalar()
    known = F.when(F.col("value").isNotNull(), seconds("ts"))
    series = materialize(raw.groupBy("station", "quantity").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), (F.min(known) - start > late).alias("late")))
    usable = series.filter("NOT late AND lo < hi")
    lacking = grid.incomplete_stations(usable, "station", "quantity")
    trash = series.filter("late").select("station").union(lacking).distinct()
    return usable.select("station", "quantity").join(lacking, "station", "left_anti"), trash


def prepare_weather(raw: DataFrame, step: int = HOUR, pad_steps: int = PAD_STEPS, late: int = LATE) -> tuple[DataFrame, DataFrame]:
    """(station, quantity, ts, value, source) on the padded grid without gaps; and the dropped stations.

    ``raw`` has one row per station, quantity and time (``grid.first_per_key``). Inner gaps are
    linear, the end holds the last value, the start takes the first one. Which series stay is
    known before the gaps are filled, so dropped series are never filled.
    """
    keys = ["station", "quantity"]
    keep, trash = usable_series(raw, late)
    whole = grid.within(grid.reindex(raw, keys, "ts", step, pad_steps), keep)
    return grid.with_source(grid.interpolate(whole, keys, "ts", "value", step, fill_start=True)), trash
