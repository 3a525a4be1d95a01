"""Near duplicates by SimHash: pigeonhole blocks of the fingerprint, then Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, by_place, materialize, named, parted, pick
from .components import components
from .resemblance import SHARE, similar_classes
from .resemblance import SHINGLE as WORDS

SHINGLE = 3
DISTANCE = 3
#: Fingerprints are cut into this many blocks; two of them survive three differing bits.
BLOCKS = 5
#: Buckets up to this size are joined with themselves, larger ones are searched in numpy.
PAIR_BUCKET = 64
#: Buckets above this size are first divided by blocks of their remaining bits.
SEARCH_BUCKET = 20_000
_STEP = 1 << 15
_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text as an unsigned integer; 0 without words."""
    words = text.encode("utf-8", "replace").translate(_TABLE).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    lo, hi = starts[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        hashes = np.array([digest(joined[i:j], 42) for i, j in zip(lo[at:at + _STEP], hi[at:at + _STEP], strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null and empty texts have 0."""
    rows = pick(docs, doc_id=key, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(batches, f"doc_id {kind}, fp bigint")


def masks(free: int, blocks: int = BLOCKS, shared: int = BLOCKS - DISTANCE) -> list[int]:
    """Masks over the bits of ``free`` such that two values that differ in at most
    ``blocks - shared`` of these bits agree under one of them."""
    places = [i for i in range(64) if free >> i & 1]
    cut = [sum(1 << i for i in part.tolist()) for part in np.array_split(places, blocks)]
    return [sum(chosen) for chosen in combinations(cut, shared)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keyed(rows: DataFrame, mask_lists: dict[int, list[int]]) -> DataFrame:
    """A row per mask of the row's path: (fp, path * 16 + mask number, fp under all masks so far)."""
    out = None
    for path, found in mask_lists.items():
        keys = F.explode(F.array(*[
            F.struct(F.lit(path * 16 + i).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("block"))
            for i, m in enumerate(found)]))
        part = rows.where(F.col("path") == path).select("fp", keys.alias("k"))
        out = part if out is None else out.union(part)
    return out.select("fp", "k.path", "k.block")


def close_pairs(a: Column, b: Column, distance: int = DISTANCE) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that join all fingerprints of ``prints`` (distinct ``fp``) within reach.

    Fingerprints at three or fewer differing bits agree on two of five blocks, so they
    meet in one of ten buckets. Small buckets give all their close pairs. A larger bucket
    gives a star per component instead of its pairs, found inside the bucket; buckets too
    large for that are divided again by two of five blocks of the bits still free, which
    loses no close pair for the same reason. No bucket is capped.
    """
    first = masks((1 << 64) - 1)
    rows = materialize(_keyed(prints.select("fp", F.lit(0).alias("path")), {0: first}))
    sizes = rows.groupBy("path", "block").agg(F.count("*").alias("n")).where("n > 1")
    sized = materialize(rows.join(sizes, ["path", "block"]))
    small = sized.where(F.col("n") <= PAIR_BUCKET)
    x, y = small.alias("x"), small.alias("y")
    pairs = x.join(y, F.expr("x.path = y.path AND x.block = y.block AND x.fp < y.fp") & close_pairs(F.col("x.fp"), F.col("y.fp")))
    medium = sized.where((F.col("n") > PAIR_BUCKET) & (F.col("n") <= SEARCH_BUCKET))
    large = sized.where(F.col("n") > SEARCH_BUCKET)
    whole = (1 << 64) - 1
    deeper = {i: [m | sub for sub in masks(whole & ~m)] for i, m in enumerate(first)}
    divided = _keyed(large.select("fp", "path"), deeper)
    searched = medium.select("fp", "path", "block").union(divided).groupBy("path", "block").applyInPandas(_stars, "a bigint, b bigint")
    return pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).union(searched)


def _stars(bucket: pd.DataFrame) -> pd.DataFrame:
    """One edge from the first found member of each component inside a bucket to every other.

    Each fingerprint is compared once with those not yet reached, so memory stays that of
    the bucket however many of its pairs are close.
    """
    rest = np.sort(bucket["fp"].to_numpy(np.int64).view(np.uint64))
    roots, members = [], []
    while len(rest):
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= DISTANCE
            if near.any():
                found, rest = rest[near], rest[~near]
                queue.extend(found)
                roots.append(np.full(len(found), root, np.uint64))
                members.append(found)
    if not roots:
        return pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})
    return pd.DataFrame({"a": np.concatenate(roots).view(np.int64), "b": np.concatenate(members).view(np.int64)})


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable
    over links of three or fewer differing bits.

    Texts without words, null ones too, all have fingerprint zero and are linked to each
    other and to what is close to zero. Equal fingerprints meet before any join, so
    groups of copies cost one row. A null doc_id gets the class of its fingerprint.
    """
    of_docs = materialize(fingerprints(docs, key, text))
    prints = materialize(of_docs.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(prints))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = materialize(rooted.join(least, "root").select("fp", "component_id"))
    return of_docs.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE, size: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the smallest id, of equal ids one.

    Classes are those of ``similar_classes``; fingerprints of three bits reach only texts that are
    almost equal. Null, empty and word-free texts are one class; a null id comes before all others;
    repeated rows are one class, of which one stays. All columns are kept. Rows go by a digest of id and
    text, so ``docs``, which is read several times, is not written once more.
    """
    placed, at = by_place(docs, doc_id=key, text=text)
    name, empty = F.col(at["doc_id"]).cast("string"), F.lit("")
    whole = F.concat_ws("\0", F.coalesce(F.length(name), F.lit(-1)).cast("string"), F.coalesce(name, empty), F.coalesce(at["text"], empty))
    rows = placed.withColumn("rid", F.unhex(F.md5(whole)))
    picked = rows.select("rid", F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"))
    judged = similar_classes(picked, share, size).groupBy("rid").agg(F.first("first_rid").alias("first_rid"), F.count("*").alias("n"))
    odd = materialize(judged.where("rid != first_rid OR n > 1"))
    maybe, first = parted(rows, odd, "rid")
    kept = maybe.dropDuplicates(["rid"]).join(odd.where("rid != first_rid"), "rid", "left_anti")
    return named(kept.unionByName(first), docs.columns)
