"""Packing token sequences into bins by best fit and a local search over swaps."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick
from .encoding import encoder

LIMIT = 2048
END = 0
#: Pieces packed by one task.
ROWS_PER_GROUP = 20_000


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut from
    its end into pieces of ``limit`` where it is longer, so only its first piece may be shorter.

    Null and empty texts are the end id alone.
    """
    rows = pick(docs, doc_id=key, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    last = np.array([end], "<u4").tobytes()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer)
        for batch in parts:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                of, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(model.encode([t or "" for t in some.column(1).to_pylist()])):
                    ids += last
                    n = len(ids) // 4
                    bounds = [0, *range(n % limit or limit, n + 1, limit)]
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        of.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[4 * a:4 * b]))
                yield pa.RecordBatch.from_arrays([
                    some.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names)

    return rows.mapInArrow(batches, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(sizes: np.ndarray, limit: int) -> list[list[int]]:
    """Bins of item numbers: items from the largest down, each into the fullest bin with room."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(limit + 1)]
    open_rooms: list[int] = []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        at = bisect_left(open_rooms, size)
        if at == len(open_rooms):
            bins.append([])
            left, which = limit, len(bins) - 1
        else:
            left = open_rooms[at]
            which = room[left].pop()
            if not room[left]:
                open_rooms.pop(at)
        bins[which].append(item)
        if not room[left - size]:
            insort(open_rooms, left - size)
        room[left - size].append(which)
    return bins


def improve(bins: list[list[int]], sizes: np.ndarray, limit: int, patience: int = 16) -> list[list[int]]:
    """Local search: moves, one-for-one and two-for-one exchanges between underfull bins.

    Bins are taken from the emptiest up. One is emptied into the others by changes that
    each raise the sum of squared fills: an item moves to a fuller bin with room, or an
    exchange leaves the fuller bin fuller. Each change raises a bounded whole number, so
    the search ends; it stops early once the bins are as few as the total size allows, or
    after ``patience`` bins in a row could not be emptied.
    """
    size = [int(s) for s in sizes]
    fill = [sum(size[i] for i in b) for b in bins]
    least = -(-sum(fill) // limit)
    under = sorted((i for i in range(len(bins)) if fill[i] < limit), key=lambda i: fill[i])
    alive, failed = len(bins), 0
    for low in under:
        if alive <= least or failed >= patience:
            break
        changed = True
        while changed and bins[low]:
            changed = False
            for high in reversed(under):
                if high == low or not bins[high] or fill[high] < fill[low] or fill[high] == limit:
                    continue
                change = _change(bins[low], bins[high], size, limit - fill[high])
                if change:
                    give, take = change
                    for i in give:
                        bins[low].remove(i)
                        bins[high].append(i)
                    for i in take:
                        bins[high].remove(i)
                        bins[low].append(i)
                    by = sum(size[i] for i in give) - sum(size[i] for i in take)
                    fill[low] -= by
                    fill[high] += by
                    changed = True
                    break
        failed = failed + 1 if bins[low] else 0
        alive -= not bins[low]
    return [b for b in bins if b]


def _change(low: list[int], high: list[int], size: list[int], room: int) -> tuple[list[int], list[int]] | None:
    """Items that go from the emptier to the fuller bin and back, with 0 < net gain <= room."""
    for i in low:
        if size[i] <= room:
            return [i], []
    for i in low:
        for j in high:
            if 0 < size[i] - size[j] <= room:
                return [i], [j]
    for a, i in enumerate(low):
        for k in low[a + 1:]:
            for j in high:
                if 0 < size[i] + size[k] - size[j] <= room:
                    return [i, k], [j]
    for i in low:
        for a, j in enumerate(high):
            for k in high[a + 1:]:
                if 0 < size[i] - size[j] - size[k] <= room:
                    return [i], [j, k]
    return None


def packed(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``rows`` of ``pieces`` with sequence_id and offset.

    ``rows`` must be a written table with a number of its own for each row in ``row``. Full
    pieces are sequences of their own. The others are dealt by a hash of that number into groups
    of some 20,000, each packed in one task, so a group wastes one bin at most and no task grows
    with the input, however many rows are equal.
    """
    short = rows.where(F.col("length") < limit)
    groups = max(1, -(-short.count() // ROWS_PER_GROUP))
    dealt = short.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        sizes = group["length"].to_numpy()
        bins = improve(best_fit(sizes, limit), sizes, limit)
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for number, members in enumerate(bins):
            ends = np.cumsum(sizes[members])
            sequence[members], offset[members] = number, ends - sizes[members]
        return group[columns].assign(sequence_id=sequence * groups + int(group["group"].iloc[0]), offset=offset)

    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id bigint, offset bigint"
    full = rows.where(F.col("length") == limit).select(
        *columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return dealt.groupBy("group").applyInPandas(pack, schema).union(full)


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of every document with its sequence and place in it. Sequences of full
    pieces have negative numbers. Repeated rows are packed each."""
    return packed(materialize(pieces(docs, tokenizer, limit, end, key, text).withColumn("row", F.monotonically_increasing_id())), limit)
