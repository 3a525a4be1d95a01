"""Weighted rendezvous hashing of record keys over shards, and gapless places in them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered, pick

#: Rows whose places are counted in one task, on average.
ROWS_PER_BUCKET = 50_000


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """Shard of ``key`` among ``weights``, by highest random weight.

    Each (key, shard) pair has a uniform draw u in (0, 1) made from a hash; the shard
    with the smallest -ln(u) / weight takes the key, so shards get keys in proportion
    to their weights. Adding a shard moves keys only into it, removing one moves only
    its own keys. A null key counts as a key of its own.
    """
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("each shard needs a positive weight")
    known = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    draws = []
    for shard, weight in sorted(weights.items()):
        bits = F.shiftrightunsigned(F.xxhash64(known, F.lit(int(shard))), 11)
        u = (bits.cast("double") + F.lit(0.5)) * F.lit(math.ldexp(1.0, -53))
        draws.append(F.struct((-F.ln(u) / F.lit(float(weight))).alias("cost"), F.lit(int(shard)).alias("shard")))
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def placed(rows: DataFrame, shard: str = "shard", row_id: str = "rid") -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 within each shard.

    ``rows`` must be a written table with a unique row id. A shard is divided into
    buckets by a hash of that id, whose number follows the number of rows, so neither a
    large shard nor a repeated key becomes one task; a running sum of the bucket counts
    gives each bucket its first slot.
    """
    shards = max(1, rows.select(shard).distinct().count())
    buckets = max(1, math.ceil(rows.count() / ROWS_PER_BUCKET / shards))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(row_id), F.lit(buckets)))
    in_shard = Window.partitionBy(shard).orderBy("_bucket")
    first = (
        dealt.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
        .select(shard, "_bucket", (F.sum("_n").over(in_shard) - F.col("_n")).alias("_first"))
    )
    in_bucket = Window.partitionBy(shard, "_bucket").orderBy(row_id)
    return (
        dealt.withColumn("_place", F.row_number().over(in_bucket) - 1)
        .join(first, [shard, "_bucket"])
        .withColumn("slot", F.col("_first") + F.col("_place"))
        .drop("_bucket", "_first", "_place")
    )


def shard_documents(docs: DataFrame, weights: dict[int, float], grown: dict[int, float] | None = None,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size, text_crc32, shard, slot and, with ``grown``, the
    shard it would have among those.

    A null text has size 1 and checksum 0, as an empty one. A null key is a key like any
    other. Repeated rows share a shard and get slots of their own.
    """
    text_or_none = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, key=key, text=text).select(
        F.col("key").alias("doc_id"),
        (F.octet_length(text_or_none) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text_or_none, "UTF-8")).alias("text_crc32"),
        rendezvous(F.col("key"), weights).cast("int").alias("shard"),
        (rendezvous(F.col("key"), grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    return placed(numbered(rows)).drop("rid")


def moved(docs: DataFrame, before: dict[int, float], after: dict[int, float], key: str = "doc_id") -> DataFrame:
    """Keys whose shard differs between two sets of weights: (doc_id, shard, new_shard)."""
    keys = pick(docs, doc_id=key)
    both = keys.withColumn("shard", rendezvous(F.col("doc_id"), before)).withColumn("new_shard", rendezvous(F.col("doc_id"), after))
    return both.where("shard != new_shard")


def write_shards(docs: DataFrame, weights: dict[int, float], path: str, key: str = "doc_id") -> DataFrame:
    """Writes ``docs`` with one folder per shard, several files for a large one, and reads it back."""
    names = docs.columns
    where = docs.toDF(*[f"_{i}" for i in range(len(names))])
    sharded = where.withColumn("shard", rendezvous(F.col(f"_{names.index(key)}"), weights).cast("int"))
    plain = [f"_{i}" for i in range(len(names))]
    clash = "shard" in [n.lower() for n in names]
    renamed = sharded.select(*[F.col(p).alias(n) for p, n in zip(plain, names, strict=True) if n.lower() != "shard"], "shard")
    if clash:
        raise ValueError("a column named shard would be lost")
    return materialize(renamed, path, by="shard")
