"""Transformations of a series: (location, ts, value) in, the same out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import seconds, smoothing, with_halo

HOUR = 3600


def _framed(df: DataFrame, keys: Sequence[str], ts: str, before: int, after: int, step: int, frame, expression, name: str) -> DataFrame:
    halo, _ = with_halo(df, ts, before, after, step)
    w = Window.partitionBy(*keys, "chunk").orderBy(seconds(ts)).rangeBetween(*frame)
    return halo.withColumn(name, expression(w)).filter("owned").drop("chunk", "owned")


def one_hot(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """One 0/1 series per distinct value of a series; the value becomes ``category``."""
    keys = list(keys)
    categories = df.select(*keys, F.col(value).alias("category")).filter("category IS NOT NULL").distinct()
    return df.join(categories, keys).withColumn(
        value, F.coalesce((F.col(value) == F.col("category")).cast("int"), F.lit(0))
    )


def lag(df: DataFrame, keys: Sequence[str], ts: str, value: str, hours: int, step: int = HOUR, name: str | None = None) -> DataFrame:
    """Value ``hours`` earlier (later if negative).

    For a positive lag the row at the smallest time >= t - lag is used, so the
    first rows repeat the first value. A lead past the end is null.
    """
    name, p = name or value, hours * 3600
    if p >= 0:
        return _framed(df, keys, ts, p, 0, step, (-p, 0), lambda w: F.first(value).over(w), name)
    return _framed(df, keys, ts, 0, -p, step, (-p, -p), lambda w: F.first(value).over(w), name)


def difference(df: DataFrame, keys: Sequence[str], ts: str, value: str, hours: int, step: int = HOUR, name: str | None = None) -> DataFrame:
    out = lag(df, keys, ts, value, hours, step, "_lagged")
    return out.withColumn(name or value, F.col(value) - F.col("_lagged")).drop("_lagged")


def rolling(df: DataFrame, keys: Sequence[str], ts: str, value: str, hours: int, function, step: int = HOUR, name: str | None = None) -> DataFrame:
    """``function`` over the left-open window (t - hours, t], nulls skipped."""
    reach = hours * 3600 - 1
    return _framed(df, keys, ts, reach, 0, step, (-reach, 0), lambda w: function(value).over(w), name or value)


def transform_input(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, transformation: str, parameter=None, step: int = HOUR
) -> DataFrame:
    """Dispatch on the name of the transformation; hours or alpha as parameter."""
    if transformation == "":
        return df
    if transformation == "binary":
        return one_hot(df, keys, ts, value)
    if transformation == "lag":
        return lag(df, keys, ts, value, parameter, step)
    if transformation == "smoothing":
        return smoothing(df, keys, ts, value, parameter, step, "_smoothed").withColumn(value, F.col("_smoothed")).drop("_smoothed")
    if transformation == "difference":
        return difference(df, keys, ts, value, parameter, step)
    if transformation == "minimum":
        return rolling(df, keys, ts, value, parameter, F.min, step)
    if transformation == "maximum":
        return rolling(df, keys, ts, value, parameter, F.max, step)
    raise ValueError(f"unknown transformation {transformation!r}")


#: Transformations that are one window frame each.
FRAMED = ("lag", "difference", "minimum", "maximum")


def _reach(transformation: str, hours: int) -> tuple[int, int]:
    """Seconds of rows that a frame needs before and after its own time."""
    p = hours * 3600
    if transformation in ("minimum", "maximum"):
        return p - 1, 0
    return max(p, 0), max(-p, 0)


def _over(value: str, transformation: str, hours: int, base) -> Column:
    p = hours * 3600
    if transformation in ("minimum", "maximum"):
        function = F.min if transformation == "minimum" else F.max
        return function(value).over(base.rangeBetween(1 - p, 0))
    lagged = F.first(value).over(base.rangeBetween(-p, 0) if p >= 0 else base.rangeBetween(-p, -p))
    return F.col(value) - lagged if transformation == "difference" else lagged


def framed(df: DataFrame, keys: Sequence[str], ts: str, value: str, requests: Sequence[tuple[str, object]], step: int = HOUR) -> DataFrame:
    """(keys, ts, transformation, parameter, value) of all requests in one pass over the series.

    Lags, differences, minima and maxima share one halo, as wide as the widest of them, one
    shuffle and one sort. The plain value ('' as transformation) comes along.
    """
    reaches = [_reach(t, p) for t, p in requests if t] or [(0, 0)]
    halo, _ = with_halo(df.select(*keys, ts, value), ts, max(b for b, _ in reaches), max(a for _, a in reaches), step)
    base = Window.partitionBy(*keys, "chunk").orderBy(seconds(ts))
    columns = {f"_f{i}": _over(value, t, p, base) if t else F.col(value) for i, (t, p) in enumerate(requests)}
    entries = F.array(*[
        F.struct(F.lit(t).alias("transformation"), F.lit("" if p is None else str(p)).alias("parameter"), F.col(f"_f{i}").cast("double").alias(value))
        for i, (t, p) in enumerate(requests)])
    return halo.withColumns(columns).filter("owned").select(*keys, ts, F.inline(entries))


def all_transformations(df: DataFrame, keys: Sequence[str], ts: str, value: str, hours: int, step: int = HOUR) -> DataFrame:
    """Lag, lead, difference, minimum and maximum in one pass: one halo, one shuffle, one sort."""
    p = hours * 3600
    halo, _ = with_halo(df, ts, p, p, step)
    base = Window.partitionBy(*keys, "chunk").orderBy(seconds(ts))
    lagged = F.first(value).over(base.rangeBetween(-p, 0))
    return (
        halo.withColumns({
            "lagged": lagged,
            "lead": F.first(value).over(base.rangeBetween(p, p)),
            "difference": F.col(value) - lagged,
            "minimum": F.min(value).over(base.rangeBetween(-p + 1, 0)),
            "maximum": F.max(value).over(base.rangeBetween(-p + 1, 0)),
        })
        .filter("owned")
        .drop("chunk", "owned")
    )


def label(value: Column) -> Column:
    """Text of a number, without decimals if it is whole."""
    whole = value.cast("long")
    return F.when(value == whole, whole.cast("string")).otherwise(value.cast("string"))


def unfold(sources: dict[str, DataFrame], wanted: Sequence[tuple[str, str, object]], step: int = HOUR) -> DataFrame:
    """Long input table from (name, transformation, parameter) triples, duplicates dropped.

    ``sources`` maps an input name to (location, ts, value). All lags, differences, minima and
    maxima of a source, and its plain values, come from one pass.
    """
    by_name: dict[str, list] = {}
    for name, transformation, parameter in dict.fromkeys(wanted):
        by_name.setdefault(name, []).append((transformation, parameter))
    blocks = []
    for name, requests in by_name.items():
        together = [r for r in requests if r[0] in FRAMED or r[0] == ""]
        if any(r[0] in FRAMED for r in together):
            out = framed(sources[name], ["location"], "ts", "value", together, step)
            blocks.append(out.select(F.lit(name).alias("name_input"), "transformation", "parameter", "location", "ts", "value"))
        else:
            together = []
        for transformation, parameter in requests:
            if (transformation, parameter) in together:
                continue
            out = transform_input(sources[name], ["location"], "ts", "value", transformation, parameter, step)
            location = label(F.col("category")) if transformation == "binary" else F.col("location")
            blocks.append(out.select(
                F.lit(name).alias("name_input"), F.lit(transformation).alias("transformation"),
                F.lit("" if parameter is None else str(parameter)).alias("parameter"),
                location.alias("location"), "ts", F.col("value").cast("double").alias("value"),
            ))
    return reduce(DataFrame.unionByName, blocks)
