"""Ranked lexical search, reversed: the items are indexed and the documents stream through them.

The inverted index over the items' terms is broadcast. Each document's counts of those terms
go through it once and update one bounded heap an item; the heaps of all tasks are merged.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, pick

#: Documents returned of each item, and the part of a term's damping that follows the length, in hundredths.
BEST, LENGTH_SHARE = 10, 75
#: Pairs of item and term in one broadcast index, at most; more items go through in further blocks.
POSTINGS = 500_000
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Capitals to small letters, all separators to a space.
_TABLE = bytes.maketrans(UPPER.encode() + _SEPARATORS, LOWER.encode() + b" " * len(_SEPARATORS))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order; none of null."""
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


class Index:
    """Postings of a block of items: per term the items that hold it and how often."""

    def __init__(self, rows: list[tuple[int, Counter]]):
        self.items = [number for number, _ in rows]
        names = sorted({t for _, found in rows for t in found})
        self.places = {t: i for i, t in enumerate(names)}
        lists: list[list[tuple[int, int]]] = [[] for _ in names]
        for at, (_, found) in enumerate(rows):
            for t, times in found.items():
                lists[self.places[t]].append((at, times))
        self.starts = np.cumsum([0, *map(len, lists)])
        flat = np.array([x for part in lists for x in part], np.int64).reshape(-1, 2)
        self.posted, self.times = flat[:, 0], flat[:, 1]

    def scores(self, places: np.ndarray, worth: np.ndarray) -> np.ndarray:
        """Score of every item for a document whose terms at ``places`` are worth so much."""
        begin = self.starts[places]
        sizes = self.starts[places + 1] - begin
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + sizes, sizes)
        out = np.zeros(len(self.items), np.int64)
        np.add.at(out, self.posted[at], np.repeat(worth, sizes) * self.times[at])
        return out


def blocks(items: DataFrame, most: int) -> Iterator[Index]:
    """Indexes over ``items`` (number, text), each of at most ``most`` postings (more if one item has more)."""
    rows: list[tuple[int, Counter]] = []
    held = 0
    for row in items.toLocalIterator():
        found = Counter(terms(row["text"]))
        if rows and held + len(found) > most:
            yield Index(rows)
            rows, held = [], 0
        if found:
            rows.append((row["number"], found))
            held += len(found)
    if rows:
        yield Index(rows)


def term_counts(docs: DataFrame, index) -> DataFrame:
    """(doc_id, n, places, times): all terms of each document with one, and the counts of the indexed ones."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value.places
        for batch in parts:
            sizes, places, times = [], [], []
            for value in batch.column(1):
                found = Counter(terms(value.as_py()))
                sizes.append(found.total())
                hits = [(known[t], c) for t, c in found.items() if t in known]
                places.append([p for p, _ in hits])
                times.append([c for _, c in hits])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))],
                ["doc_id", "n", "places", "times"])

    return docs.mapInArrow(batches, "doc_id bigint, n bigint, places array<int>, times array<bigint>").where("n > 0")


def task_heaps(counts: DataFrame, index, weights, documents: int, length: int, best: int) -> DataFrame:
    """(number, doc_id, score): of each item the ``best`` documents of every task."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = index.value, weights.value
        heaps: list[list] = [[] for _ in known.items]
        floor = np.ones(len(heaps), np.int64)  # a score above 0, and from then on the least of a full heap
        for batch in parts:
            columns = (batch.column(i).to_pylist() for i in range(4))
            for doc_id, n, places, times in zip(*columns, strict=True):
                if not places:
                    continue
                damp = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // length
                at, tf = np.array(places), np.array(times, np.int64)
                scores = known.scores(at, weight[at] * (1_000_000_000 * tf // (1000 * tf + 8 * damp)))
                for item in np.flatnonzero(scores >= floor).tolist():
                    entry, heap = (int(scores[item]), -math.inf if doc_id is None else -doc_id), heaps[item]
                    if len(heap) < best:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == best:
                        floor[item] = heap[0][0]
        rows = [(known.items[i], None if e[1] == -math.inf else -e[1], e[0]) for i, heap in enumerate(heaps) for e in heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))],
                                         ["number", "doc_id", "score"])

    return counts.select("doc_id", "n", "places", "times").mapInArrow(batches, "number bigint, doc_id bigint, score bigint")


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST, postings: int = POSTINGS, key: str = "doc_id", text: str = "text",
           item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of each row of ``items`` with a score above 0.

    ``key`` holds whole numbers; equal scores go by ascending id, null ids last, and repeated
    rows of documents rank one after the other. Null, empty and term-free texts are no
    documents and score nothing; items without terms have no rows, repeated ones have theirs
    each. Empty tables give none. Items are a set of queries: they are read through the driver
    in blocks of at most ``postings`` pairs of item and term, each block with its own pass.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=key, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    asked = materialize(pick(items, item_id=item_key, text=item_text).withColumn("number", F.monotonically_increasing_id()))
    found = None
    for block in blocks(asked.select("number", "text"), postings):
        index = spark.sparkContext.broadcast(block)
        counts = materialize(term_counts(rows, index))
        documents, length = counts.agg(F.count("*"), F.sum("n")).first()
        weight = np.zeros(len(block.places), np.int64)
        for place, held in counts.select(F.explode("places").alias("place")).groupBy("place").count().collect():
            weight[place] = math.floor(1000 * math.log((2 * documents + 2) / (2 * held + 1)))
        heaps = task_heaps(counts, index, spark.sparkContext.broadcast(weight), documents, length or 1, best)
        found = heaps if found is None else found.union(heaps)
    if found is None:
        found = spark.createDataFrame([], "number bigint, doc_id bigint, score bigint")
    first = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    merged = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= best)
    return merged.join(asked.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
