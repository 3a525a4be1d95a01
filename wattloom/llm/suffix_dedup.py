"""Removal of repeated passages: every byte covered by a long string that also starts earlier."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parted, pick
from .induced_sort import suffix_order

#: Bytes of a repeated string, and of the grams that find its anchor.
LENGTH = 100
GRAM = 24
_WIDE = LENGTH - GRAM + 1
#: On one side of the anchor gram a repeated string has so many bytes at least.
SIDE = (LENGTH - GRAM) // 2
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BASE = np.uint64(0xD6E8FEB86659FD93)
#: Bytes sorted by one task, and contexts of one anchor beyond which they are not sorted together.
SHARD_BYTES = 4 << 20
HOT = 20_000
#: Bits of a place inside a block, and bytes whose contexts are found at once; places must fit.
_PLACE_BITS = 24
_BLOCK = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _M2
    x ^= x >> np.uint64(29)
    x *= _M3
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64."""
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up[1:], down[1:] = _BASE, inverse
    return np.cumprod(up), np.cumprod(down)


def contexts(data: bytes, ends: np.ndarray, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Contexts of all strings of LENGTH bytes inside the texts of ``data`` that stop at ``ends``.

    The anchor of such a string is the place of its gram of smallest hash, the first of
    equals; it depends on the string alone. A context is a run of consecutive starts with
    one anchor. Returned: anchor hash, hash of the context's bytes, first start, number of starts,
    and two hashes of 16 bits, of the SIDE bytes left and right of the anchor gram (0 where the
    context has fewer), put together to a number of 32 bits less 2^31, and the gram's place in the context.
    """
    n = len(data)
    empty = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    if n < LENGTH:
        return empty
    if n > 1 << _PLACE_BITS:
        raise ValueError(f"{n} bytes at once, {1 << _PLACE_BITS} at most")
    padded = np.frombuffer(data + b"\0" * 8, np.uint8)
    eight = np.ndarray((n,), "<u8", padded, strides=(1,))
    whole = _mixed(eight + _M1)
    grams = n - GRAM + 1
    h = _mixed(whole[:grams] + whole[8:8 + grams] * _M1 + (whole[16:16 + grams] ^ _M2) * _BASE)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = (h & ~low) | np.arange(grams, dtype=np.uint64)
    width = 1
    while 2 * width <= _WIDE:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < _WIDE:
        least = np.minimum(least[:len(least) - (_WIDE - width)], least[_WIDE - width:])
    at = (least & low).astype(np.int64)
    inside = np.zeros(len(at), bool)
    begin = 0
    for end in ends.tolist():
        inside[begin:max(begin, end - LENGTH + 1)] = True
        begin = end
    starts = np.flatnonzero(inside)
    if not len(starts):
        return empty
    anchors = at[starts]
    breaks = np.flatnonzero((anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first = starts[np.r_[0, breaks]]
    count = np.diff(np.r_[0, breaks, len(starts)])
    up, down = powers
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(whole * up[:n], out=sums[1:])
    stop = first + count - 1 + LENGTH - 7  # grams of eight bytes inside the context
    prints = _mixed((sums[stop] - sums[first]) * down[first] + count.astype(np.uint64))
    place = at[first]
    left, right = place - SIDE, place + GRAM
    has_left, has_right = left >= first, right + SIDE <= first + count - 1 + LENGTH
    left, right = np.maximum(left, 0), np.minimum(right, n - SIDE)
    sides = [(_mixed((sums[at_ + SIDE - 7] - sums[at_]) * down[at_]) % np.uint64(65_535)).astype(np.int64) + 1 for at_ in (left, right)]
    return h[place], prints, first, count, (np.where(has_left, sides[0], 0) << 16) + np.where(has_right, sides[1], 0) - (1 << 31), place - first


def context_table(rows: DataFrame) -> DataFrame:
    """(anchor, print, sides, inner, ord, rid, start, n, again) of every context of ``rows`` (ord, rid, text as bytes).

    Equal contexts of one block of texts already meet here: all but the earliest are marked
    ``again`` and need not be shuffled. A text longer than a block is cut into pieces that
    overlap by LENGTH - 1 bytes, so each of its strings is in one of them.
    """
    names = ["anchor", "print", "sides", "inner", "ord", "rid", "start", "n", "again"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(_BLOCK)
        for batch in parts:
            order, rid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            group, held = [], 0
            for i, text in enumerate(batch.column(2)):
                text = text.as_py()
                for at in range(0, max(1, len(text) - LENGTH + 1), _BLOCK - LENGTH + 1):
                    piece = text[at:at + _BLOCK]
                    if group and held + len(piece) > _BLOCK:
                        yield made(group, order, rid, powers)
                        group, held = [], 0
                    group.append((i, at, piece))
                    held += len(piece)
            if group:
                yield made(group, order, rid, powers)

    def made(group: list, order: np.ndarray, rid: np.ndarray, powers: tuple) -> pa.RecordBatch:
        data, which = b"".join(t for _, _, t in group), np.array([i for i, _, _ in group])
        ends = np.cumsum([len(t) for _, _, t in group])
        begin = np.array([at for _, at, _ in group]) - np.r_[0, ends[:-1]]
        anchor, prints, first, count, sides, inner = contexts(data, ends, powers)
        doc = np.searchsorted(ends, first, side="right")
        start = first + begin[doc]
        o, r = order[which[doc]], rid[which[doc]]
        by = np.lexsort((start, r, o, prints, anchor))
        new = np.r_[True, (anchor[by][1:] != anchor[by][:-1]) | (prints[by][1:] != prints[by][:-1])] if len(by) else np.zeros(0, bool)
        head = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))] if len(by) else by
        same_row = (o[by] == o[head]) & (r[by] == r[head]) & (start[by] == start[head])
        kept = new | ~same_row
        by, again = by[kept], ~new[kept]
        return pa.RecordBatch.from_arrays([
            pa.array(anchor[by].view(np.int64)), pa.array(prints[by].view(np.int64)), pa.array(sides[by].astype(np.int32)),
            pa.array(inner[by].astype(np.int8)), pa.array(o[by]), pa.array(r[by]), pa.array(start[by].astype(np.int64)), pa.array(count[by].astype(np.int32)), pa.array(again)], names)

    return rows.select("ord", "rid", "text").mapInArrow(
        batches, "anchor bigint, print bigint, sides int, inner tinyint, ord bigint, rid bigint, start bigint, n int, again boolean")


def shared_contexts(table: DataFrame) -> DataFrame:
    """Contexts whose anchor occurs elsewhere: ``first`` is whether no equal one is earlier,
    ``several`` whether a context that differs may share a string. Written once.

    A string of LENGTH bytes has LENGTH - GRAM outside its anchor gram, so at least SIDE of them
    on the left or on the right of it: contexts that share a string agree in the hash of those.
    Where only one side's hash recurs, only the starts remain whose strings reach that far.
    """
    equal = Window.partitionBy("anchor", "print").orderBy("ord", "rid", "start")
    anchor = Window.partitionBy("anchor")
    dealt = table.where("NOT again").drop("again").repartition("anchor")
    ranked = dealt.withColumn("place", F.rank().over(equal))
    counted = ranked.withColumn("times", F.count("*").over(anchor)).withColumn(
        "several", F.min("print").over(anchor) != F.max("print").over(anchor))
    shared = counted.where("times > 1 AND (place > 1 OR several)")
    for name, hashed in (("left", F.shiftrightunsigned(F.col("sides") + F.lit(1 << 31).cast("long"), 16)),
                         ("right", (F.col("sides") + F.lit(1 << 31).cast("long")).bitwiseAND(F.lit(65_535).cast("long")))):
        shared = shared.withColumn(name, hashed)
        met = F.sum(F.when(F.col("place") == 1, 1)).over(Window.partitionBy("anchor", name)) > 1
        shared = shared.withColumn(name, (F.col(name) > 0) & F.coalesce(met, F.lit(False)))
    first, differs = F.col("place") == 1, F.col("several") & (F.col("left") | F.col("right"))
    skipped = F.when(first & ~F.col("left"), F.greatest(F.lit(0), F.col("inner") - (SIDE - 1))).otherwise(0)
    left = F.when(first & ~F.col("right"), F.least(F.col("n"), F.col("inner") - SIDE)).otherwise(F.col("n"))
    kept = shared.withColumn("several", differs).where("place > 1 OR several").select(
        "anchor", "ord", "rid", (F.col("start") + skipped).alias("start"), (left - skipped).cast("int").alias("n"), first.alias("first"), "several")
    return materialize(kept.where("n > 0"))


def sorted_shard(shard: pd.DataFrame) -> pd.DataFrame:
    """Starts of strings of LENGTH bytes that are not the earliest of their kind, as runs.

    The shard's contexts, parted by a symbol below all bytes, are put in suffix order; a
    class of equal strings is a stretch of neighbours with LENGTH bytes in common.
    """
    blocks = shard["bytes"].tolist()
    sizes = np.array([len(b) for b in blocks], np.int64)
    n, begin = shard["n"].to_numpy(np.int64), np.r_[0, np.cumsum(sizes + 1)[:-1]]
    text = np.ones(int(sizes.sum()) + len(blocks) + 1, np.int32)
    text[np.arange(sizes.sum()) + np.repeat(np.arange(len(blocks)), sizes)] = np.frombuffer(b"".join(blocks), np.uint8).astype(np.int32) + 2
    text[-1] = 0
    places, common = suffix_order(text)
    block = np.repeat(np.arange(len(blocks)), sizes + 1)
    block = np.r_[block, len(blocks) - 1]
    offset = np.arange(len(text)) - begin[block]
    kind = np.cumsum(common < LENGTH)
    whole = offset[places] < n[block[places]]
    places, kind = places[whole], kind[whole]
    of = block[places]
    columns = {c: shard[c].to_numpy(np.int64) for c in ("ord", "rid", "start")}
    start, rid, first = columns["start"][of] + offset[places], columns["rid"][of], columns["ord"][of]
    order = np.lexsort((start, rid, first, kind))
    fresh = np.r_[True, kind[order][1:] != kind[order][:-1]] if len(order) else np.zeros(0, bool)
    head = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))] if len(order) else order
    later = (start[order] != start[head]) | (rid[order] != rid[head]) | (first[order] != first[head])
    gone = np.zeros(len(text) + 1, bool)
    gone[places[order[later]]] = True
    edge = np.flatnonzero(gone[1:] != gone[:-1]) + 1
    if gone[0]:
        edge = np.r_[0, edge]
    at, to = edge[::2], edge[1::2]
    return pd.DataFrame({
        "ord": columns["ord"][block[at]], "rid": columns["rid"][block[at]],
        "start": columns["start"][block[at]] + offset[at], "n": (to - at).astype(np.int64)})


_RUN = "ord bigint, rid bigint, start bigint, n bigint"


def later_strings(contexts_: DataFrame, rows: DataFrame, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """Runs (ord, rid, start, n) of starts, in contexts that differ but share an anchor, whose string is not its earliest.

    Equal strings have one anchor, so shards by anchor need no look at each other. An anchor
    with more than ``hot`` different contexts would be one shard alone; its strings are
    grouped one by one instead, with partial minima, which is exact as well.
    """
    apart = contexts_.where("first AND several")
    many = materialize(apart.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > hot).select("anchor"))
    cut = F.expr(f"substring(text, CAST(start + 1 AS INT), CAST(n + {LENGTH - 1} AS INT))").alias("bytes")
    held = parted(rows, apart.select("rid"), "rid")[0]  # other texts need not move
    slices = materialize(apart.join(held, ["ord", "rid"]).select("anchor", "ord", "rid", "start", "n", cut))
    total = slices.agg(F.sum(F.col("n") + LENGTH)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    usual = slices.join(many, "anchor", "left_anti").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    dealt = usual.select("shard", "ord", "rid", "start", "n", "bytes").repartition(shards, "shard")  # few shards a task
    found = dealt.groupBy("shard").applyInPandas(sorted_shard, _RUN)
    strings = slices.join(many, "anchor", "left_semi").select(
        "ord", "rid", "start", "bytes", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select(
        F.struct("ord", "rid", (F.col("start") + F.col("i")).alias("start")).alias("at"),
        F.expr(f"substring(bytes, i + 1, {LENGTH})").alias("string"))
    earliest = strings.groupBy("string").agg(F.min("at").alias("least"))
    loose = strings.join(earliest, "string").where("at != least").select(
        "at.ord", "at.rid", "at.start", F.lit(1).cast("long").alias("n"))
    return found.union(loose)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep``,
    the remaining bytes (kept) and the removed spans as (start, end).

    ``key`` must hold whole numbers; a null key comes before all others. Null and empty
    texts have no bytes. Rows of equal key are told apart by a hash of their text, in whose
    order they come; rows equal in both count as one document.
    """
    text_bytes = F.coalesce("text", F.lit("")).cast("binary")
    rows = pick(docs, doc_id=key, text=text).select("doc_id", text_bytes.alias("text")).select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("ord"), F.xxhash64("text").alias("rid"), "text")
    table = materialize(context_table(rows))
    shared = shared_contexts(table)
    runs = (
        table.where("again").select("ord", "rid", "start", F.col("n").cast("long"))
        .union(shared.where("NOT first").select("ord", "rid", "start", F.col("n").cast("long")))
        .union(later_strings(shared, rows.select("ord", "rid", "text")))
    )
    spans = materialize(runs.groupBy("ord", "rid").agg(
        F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n") + LENGTH - 1).alias("end")))).alias("spans")))
    maybe, whole = parted(rows, spans, "rid")
    joined = maybe.join(spans, ["ord", "rid"], "left").select("doc_id", "text", "spans.start", "spans.end").unionByName(
        whole.select("doc_id", "text", *[F.lit(None).cast("array<bigint>").alias(c) for c in ("start", "end")]))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "removed"] * keep
    span_list = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = [_cut(t.as_py(), a.as_py() or [], b.as_py() or []) for t, a, b in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True)]
            columns = [
                batch.column(0), pa.array([len(t) for t in batch.column(1).to_pylist()], pa.int64()),
                pa.array([sum(e - s for s, e in m) for _, m in found], pa.int64()),
                pa.array([len(m) for _, m in found], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k, _ in found], pa.string())]
            if keep:
                columns += [pa.array([k for k, _ in found], pa.binary()),
                            pa.array([[{"start": s, "end": e} for s, e in m] for _, m in found], span_list)]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    schema += ", kept binary, removed array<struct<start:bigint,end:bigint>>" * keep
    return joined.mapInArrow(batches, schema)


def _cut(text: bytes, starts: list[int], ends: list[int]) -> tuple[bytes, list[tuple[int, int]]]:
    """What remains of ``text`` and the removed spans, touching ones as one."""
    merged: list[list[int]] = []
    for s, e in zip(starts, ends, strict=True):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    kept, at = [], 0
    for s, e in merged:
        kept.append(text[at:s])
        at = e
    return b"".join([*kept, text[at:]]), [(s, e) for s, e in merged]
