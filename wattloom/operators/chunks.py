"""Splitting a series into pieces of time, so that one long series is many groups.

A window partitioned by series alone is only as parallel as there are series,
and one series may hold a third of all rows. Every window operator of the
package therefore partitions by (series, chunk), where a chunk is a fixed span
of time. Two ways keep the results exact at the chunk borders:

* ``with_halo`` copies the rows near a border into the neighbouring chunk, for
  frames of bounded length;
* ``nearest_known`` and ``smoothing`` summarise each chunk in one row and carry
  the summaries over, for unbounded look-back.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_STEPS = 4096


def seconds(ts: str | Column) -> Column:
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_seconds(column.cast("timestamp"))


def chunk_of(ts: str | Column, length: int) -> Column:
    return F.floor(seconds(ts) / F.lit(length))


def by_chunk(df: DataFrame, keys: Sequence[str], name: str, ts: str, length: int) -> DataFrame:
    """Add the chunk and shuffle by (series, chunk), once for all that follows.

    The window and the chunk summaries both start from this shuffle, so Spark
    runs it, and the plan below it, a single time.
    """
    return df.withColumn(name, chunk_of(ts, length)).repartition(*keys, name)


def with_halo(df: DataFrame, ts: str, before: int, after: int, step: int) -> tuple[DataFrame, int]:
    """Add ``chunk`` and ``owned``; rows needed by a neighbour appear there too.

    ``before`` and ``after`` are the seconds a frame reaches back and ahead.
    The chunk is at least four times that reach, so that the copies stay below
    half of the rows. After the window, keep ``owned`` rows only.
    """
    length = max(CHUNK_STEPS * step, 4 * (before + after))
    at = seconds(ts)
    first = F.floor((at - after) / length)
    last = F.floor((at + before) / length)
    out = df.withColumn("chunk", F.explode(F.sequence(first, last)))
    return out.withColumn("owned", F.col("chunk") == F.floor(at / length)), length


def nearest_known(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, step: int
) -> DataFrame:
    """Add the last known point at or before, and the first at or after, each row.

    New columns: ``prev_ts, prev_value, next_ts, next_value`` (epoch seconds and
    value), null where there is none. Inside a chunk this is a running window;
    across chunks one summary row per (series, chunk) is carried.
    """
    keys = list(keys)
    length = CHUNK_STEPS * step
    at = seconds(ts)
    df = by_chunk(df, keys, "chunk", ts, length)
    known = F.when(F.col(value).isNotNull(), F.struct(at.alias("t"), F.col(value).alias("v")))
    known_at = F.when(F.col(value).isNotNull(), at)
    up = Window.partitionBy(*keys, "chunk").orderBy(F.col(ts)).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "chunk").orderBy(F.col(ts).desc()).rowsBetween(Window.unboundedPreceding, 0)
    inner = df.withColumn("_prev", F.last(known, True).over(up)).withColumn(
        "_next", F.last(known, True).over(down)
    )

    per_chunk = df.groupBy(*keys, "chunk").agg(
        F.min(known_at).alias("first_t"),
        F.min_by(F.col(value), known_at).alias("first_v"),
        F.max(known_at).alias("last_t"),
        F.max_by(F.col(value), known_at).alias("last_v"),
    )
    first_point = F.when(F.col("first_t").isNotNull(), F.struct(F.col("first_t").alias("t"), F.col("first_v").alias("v")))
    last_point = F.when(F.col("last_t").isNotNull(), F.struct(F.col("last_t").alias("t"), F.col("last_v").alias("v")))
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(
        *keys,
        "chunk",
        F.last(last_point, True).over(earlier).alias("_carry_prev"),
        F.last(first_point, True).over(later).alias("_carry_next"),
    )
    joined = inner.join(carry, [*keys, "chunk"])
    prev, nxt = F.coalesce("_prev", "_carry_prev"), F.coalesce("_next", "_carry_next")
    return (
        joined.withColumn("prev_ts", prev["t"])
        .withColumn("prev_value", prev["v"])
        .withColumn("next_ts", nxt["t"])
        .withColumn("next_value", nxt["v"])
        .drop("_prev", "_next", "_carry_prev", "_carry_next", "chunk")
    )


def row_index(df: DataFrame, keys: Sequence[str], ts: str, step: int, name: str = "idx") -> DataFrame:
    """0-based row number per series without a window over the whole series."""
    keys = list(keys)
    df = by_chunk(df, keys, "chunk", ts, CHUNK_STEPS * step)
    sizes = df.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select(*keys, "chunk", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*keys, "chunk").orderBy(ts)) - 1
    return (
        df.withColumn("_inside", inside)
        .join(offset, [*keys, "chunk"])
        .withColumn(name, (F.col("_offset") + F.col("_inside")).cast("long"))
        .drop("_inside", "_offset", "chunk")
    )


def smoothing(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, alpha: float, step: int,
    name: str = "smoothed", block: int = 128,
) -> DataFrame:
    """Exponential smoothing y(0) = x(0), y(t) = (1 - alpha) y(t-1) + alpha x(t).

    A block of rows is an affine map of the value before it, so each block folds
    its own rows starting from zero. Blocks are composed inside their chunk; one
    summary row per chunk is carried over as far back as the weights stay above
    double precision, and the carry is added with its decay. A missing value keeps the previous level, and the weight of
    older values goes on decaying through the gap, relative to the next one.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    keys = list(keys)
    beta = 1.0 - alpha
    at = seconds(ts)
    # gap between consecutive known rows, in steps: 1 on a complete grid
    known = nearest_before(df, keys, ts, value, step).withColumn("_block", F.floor(at / (block * step)))
    gap = ((at - F.col("_before")) / step).cast("double")
    decay_gap = F.pow(F.lit(beta), gap)
    missing, first = F.col(value).isNull(), F.col("_before").isNull()
    factor = F.when(missing, 1.0).when(first, 0.0).otherwise(decay_gap / (decay_gap + alpha))
    term = (
        F.when(missing, 0.0)
        .when(first, F.col(value))
        .otherwise(alpha * F.col(value) / (decay_gap + alpha))
    )
    mapped = known.withColumn("_a", factor).withColumn("_b", term)

    # blocks lie inside chunks, so (series, chunk, block) needs no further shuffle
    in_block = Window.partitionBy(*keys, "_chunk", "_block").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    maps = F.collect_list(F.struct(F.col("_a").alias("a"), F.col("_b").alias("b"))).over(in_block)
    local = mapped.withColumn("_fold", compose(maps))
    blocks = local.groupBy(*keys, "_chunk", "_block").agg(
        F.max_by("_fold", ts).alias("_whole"), F.count(value).alias("_known")
    )
    # one map from the start of the chunk to each block, and one for the whole chunk
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy("_block")
    blocks = blocks.withColumns({
        "_start": compose(F.collect_list("_whole").over(in_chunk.rowsBetween(Window.unboundedPreceding, -1))),
        "_through": compose(F.collect_list("_whole").over(in_chunk.rowsBetween(Window.unboundedPreceding, 0))),
    })
    summary = blocks.groupBy(*keys, "_chunk").agg(
        F.max_by("_through", "_block").alias("_whole"), F.sum("_known").alias("_known")
    )
    # every known row shrinks older weights by at least beta: count known rows back
    reach = CHUNK_STEPS + (0 if beta == 0 else math.ceil(40.0 / -math.log(beta)))
    last = Window.partitionBy(*keys).orderBy("_chunk")
    counted = summary.filter("_known > 0").withColumn(
        "_upto", F.sum("_known").over(last.rowsBetween(Window.unboundedPreceding, 0))
    )
    near = Window.partitionBy(*keys).orderBy("_upto").rangeBetween(-reach, 0)
    history = counted.select(*keys, "_chunk", compose(F.collect_list("_whole").over(near))["b"].alias("_level"))
    earlier = summary.select(*keys, "_chunk").join(history, [*keys, "_chunk"], "left").select(
        *keys, "_chunk",
        F.last("_level", True).over(last.rowsBetween(Window.unboundedPreceding, -1)).alias("_before_chunk"),
    )
    entering = F.col("_start")["b"] + F.col("_start")["a"] * F.coalesce("_before_chunk", F.lit(0.0))
    carried = blocks.join(earlier, [*keys, "_chunk"]).select(*keys, "_chunk", "_block", entering.alias("_carry"))
    level = F.col("_fold")["b"] + F.col("_fold")["a"] * F.coalesce("_carry", F.lit(0.0))
    started = F.col("_before").isNotNull() | F.col(value).isNotNull()
    return (
        local.join(carried, [*keys, "_chunk", "_block"])
        .withColumn(name, F.when(started, level))
        .drop("_fold", "_a", "_b", "_before", "_chunk", "_block", "_carry")
    )


def compose(maps: Column) -> Column:
    """Fold a list of affine maps y -> a y + b, oldest first, into one."""
    return F.aggregate(
        maps,
        F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")),
        lambda acc, m: F.struct((m["a"] * acc["a"]).alias("a"), (m["a"] * acc["b"] + m["b"]).alias("b")),
    )


def nearest_before(df: DataFrame, keys: Sequence[str], ts: str, value: str, step: int) -> DataFrame:
    """Add ``_before``: epoch seconds of the last known point strictly before the row,
    and ``_chunk``, by which the result is partitioned."""
    keys = list(keys)
    known_at = F.when(F.col(value).isNotNull(), seconds(ts))
    df = by_chunk(df, keys, "_chunk", ts, CHUNK_STEPS * step)
    strictly = Window.partitionBy(*keys, "_chunk").orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    tails = df.groupBy(*keys, "_chunk").agg(F.max(known_at).alias("_tail"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*keys, "_chunk", F.max("_tail").over(earlier).alias("_carry_t"))
    return (
        df.withColumn("_near", F.max(known_at).over(strictly))
        .join(carry, [*keys, "_chunk"])
        .withColumn("_before", F.coalesce("_near", "_carry_t"))
        .drop("_near", "_carry_t")
    )
