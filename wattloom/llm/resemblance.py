"""Near duplicates by Jaccard similarity of word shingles: wide SimHash fingerprints that agree in a block
and differ in few bits, then the shingles themselves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, numbered, parted
from .components import components

#: Words of a shingle, and the similarity of near duplicates.
SHINGLE = 5
SHARE = 0.8
#: A pair of similarity ``share`` agrees in none of the blocks with at most this probability.
MISS = 5e-8
#: Fingerprints of a bucket on average, at most, and the fewest bits of a block.
CROWD, NARROW = 1024, 6
#: Bits that are compared inside a bucket, in words of 64, and their columns.
BITS = 192
PRINT = [f"p{i}" for i in range(BITS // 64)]
#: Standard deviations of the differing bits that are allowed above their mean.
SPREAD = 6.3
#: Members of a bucket that one task compares.
BUCKET = 2_000
_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Shingles whose bits are added in bytes.
_STEP = 255
#: Pairs compared at once.
_PAIRS = 1 << 18


def blocks_for(n: int, share: float = SHARE) -> tuple[int, int, int]:
    """Bits of a block, blocks, and differing bits of ``BITS`` allowed, for ``n`` texts.

    Sets of similarity s have a cosine of 2s / (1 + s) or more, and a bit of their fingerprints
    differs with the angle's share of a half turn. Blocks get a bit more when the texts
    double, so that buckets stay as they are, and there are as many as ``MISS`` needs.
    """
    apart = math.acos(min(1.0, 2 * share / (1 + share))) / math.pi
    width = max(NARROW, math.ceil(math.log2(max(n, 1) / CROWD)))
    agree = (1 - apart) ** width
    blocks = math.ceil(math.log(MISS) / math.log1p(-agree)) if agree < 1 else 1
    return width, blocks, int(BITS * apart + SPREAD * math.sqrt(BITS * apart * (1 - apart)))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a shorter text is one shingle, none without words."""
    words = text.encode("utf-8", "replace").translate(_TABLE).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j]) for i, j in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n))


def wide_print(found: np.ndarray, bits: int) -> np.ndarray:
    """The fingerprint of a set of hashes, a 0 or 1 for each of ``bits`` bits (a multiple of 64):
    1 where over half of the hashes, each drawn out to that many bits, have a 1."""
    salts = np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(bits, np.int64)
    for at in range(0, len(found), _STEP):
        drawn = found[at:at + _STEP, None] + salts
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            drawn ^= drawn >> np.uint64(shift)
            drawn *= np.uint64(times)
        drawn ^= drawn >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(drawn.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return (2 * ones > len(found)).astype(np.uint8)


def signed(rows: DataFrame, size: int, width: int, blocks: int) -> DataFrame:
    """(doc_id, same, p0 and on, blocks): ``same`` tells equal sets of shingles; then the first ``BITS``
    bits of the fingerprint, and its blocks of ``width`` bits, none without words."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    bits = -(-max(BITS, width * blocks) // 64) * 64
    powers = 1 << np.arange(width, dtype=np.int64)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            sets = [shingles(t.as_py(), size) for t in batch.column(1)]
            prints = [wide_print(s, bits) for s in sets]
            firsts = np.array([np.packbits(p[:BITS], bitorder="little").view("<i8") for p in prints], np.int64).reshape(-1, len(PRINT))
            cut = [p[:width * blocks].reshape(blocks, width) @ powers if len(s) else [] for s, p in zip(sets, prints, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                *map(pa.array, firsts.T), pa.array(cut, pa.list_(pa.int32()))], ["doc_id", "same", *PRINT, "blocks"])

    words = ", ".join(f"{p} bigint" for p in PRINT)
    return rows.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, same binary, {words}, blocks array<int>")


def differing(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Differing bits of each fingerprint of ``some`` (a row of words) from each of ``others``."""
    return sum(np.bitwise_count(some[:, k, None] ^ others[None, :, k]) for k in range(some.shape[1]))


def met_before(apart: np.ndarray, width: int, blocks: int) -> np.ndarray:
    """Whether the pairs of these differing bits (a row of words each) agree in one of their first ``blocks`` blocks."""
    bits = np.unpackbits(apart.view(np.uint8), axis=1, bitorder="little")
    return ~bits[:, :blocks * width].reshape(len(bits), blocks, width).any(axis=2).all(axis=1)


def close_members(bucket: pd.DataFrame, distance: int, width: int) -> pd.DataFrame:
    """(key, node): groups of the members of a bucket that pairs yet to be compared link to each other.

    Such a pair differs in ``distance`` or fewer bits, is not in one class already, and agrees in no
    earlier block (as far as the compared bits reach), where it has been looked at. ``key`` tells the
    group's members, so a group found in several buckets is one.
    """
    bucket = bucket.sort_values("node")
    nodes, roots = bucket["node"].to_numpy(np.int64), bucket["root"].fillna(bucket["node"]).to_numpy(np.int64)
    prints = np.ascontiguousarray(bucket[PRINT].to_numpy(np.int64)).view(np.uint64)
    earlier = min(int(bucket["at"].iat[0]), BITS // width)

    def pending(some, others) -> np.ndarray:
        a, b = prints[some], prints[others]
        near = (differing(a, b) <= distance) & (roots[some][:, None] != roots[others])
        i, j = np.nonzero(near)
        if earlier and len(i):
            near[i, j] = ~met_before(a[i] ^ b[j], width, earlier)
        return near

    n, paired = len(nodes), np.zeros(len(nodes), bool)
    step = max(1, _PAIRS // max(n, 1))
    for at in range(0, n, step):
        near = pending(slice(at, at + step), slice(at, n))
        paired[at:at + step] |= near.any(axis=1)
        paired[at:] |= near.any(axis=0)
    rest, keys, members = np.flatnonzero(paired), [], []
    while len(rest):
        queue, rest, group = [rest[0]], rest[1:], [rest[:1]]
        while queue and len(rest):
            near = pending([queue.pop()], rest)[0]
            found, rest = rest[near], rest[~near]
            group.append(found)
            queue.extend(found.tolist())
        members.append(nodes[np.sort(np.concatenate(group))])
        keys.append(np.full(len(members[-1]), xxhash.xxh64_intdigest(members[-1].tobytes()), np.uint64).view(np.int64))
    none = [np.zeros(0, np.int64)]
    return pd.DataFrame({"key": np.concatenate(keys or none), "node": np.concatenate(members or none)})


def linked(bucket: pd.DataFrame, share: float, size: int) -> pd.DataFrame:
    """One edge from the first found member of each component inside a bucket to every other.

    Each member is compared, by its shingles, once with those not yet reached.
    """
    nodes = bucket["node"].to_numpy(np.int64)
    order = np.argsort(nodes)
    nodes, sets = nodes[order], [shingles(t, size) for t in bucket["text"].to_numpy()[order]]
    sizes = np.array([len(s) for s in sets], np.int64)
    known, codes = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.r_[0, np.cumsum(sizes)]
    owner = np.repeat(np.arange(len(sets)), sizes)
    rest_codes, rest = codes, np.ones(len(sets), bool)
    roots, members = [], []
    for root in range(len(sets)):
        if not rest[root]:
            continue
        rest[root] = False
        queue = [root]
        while queue and rest.any():
            at = queue.pop()
            mine = np.zeros(len(known), bool)
            mine[codes[begin[at]:begin[at + 1]]] = True
            shared = np.bincount(owner[mine[rest_codes]], minlength=len(sets))
            near = np.flatnonzero(rest & (shared >= share * (sizes[at] + sizes - shared) - 1e-9))
            if len(near):
                rest[near] = False
                queue.extend(near.tolist())
                roots.append(np.full(len(near), root))
                members.append(near)
                live = rest[owner]
                owner, rest_codes = owner[live], rest_codes[live]
    if not roots:
        return pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})
    return pd.DataFrame({"a": nodes[np.concatenate(roots)], "b": nodes[np.concatenate(members)]})


def rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``members`` (node, ...) with ``root``, the class found for the node so far; null for a node in none."""
    if roots is None:
        return members.withColumn("root", F.lit(None).cast("long"))
    return members.join(roots, "node", "left")


def mixed_buckets(members: DataFrame) -> DataFrame:
    """``members`` (key, node, root) of the buckets that hold several classes, with the bucket's size ``n``
    and its first node ``least``; ``root`` is the node itself where it was null."""
    members = members.withColumn("root", F.coalesce("root", "node"))
    lists = members.groupBy("key").agg(
        F.count("*").alias("n"), F.min("node").alias("least"), F.min("root").alias("low"), F.max("root").alias("high"))
    return members.join(lists.where("low != high").select("key", "n", "least"), "key")


def compared(groups: DataFrame, names: DataFrame, texts: DataFrame, distance: int, width: int, share: float, size: int) -> DataFrame:
    """Edges of the groups (key, at, node, root, p0 and on): members of close fingerprints, then by their shingles.

    Only texts of members with a pair to compare move, one of equal rows. ``names`` has the nodes' rows.
    """
    held = groups.groupBy("key").applyInPandas(lambda b: close_members(b, distance, width), "key bigint, node bigint")
    wanted = materialize(held.distinct().join(names, "node"))
    moved = parted(texts, wanted.select("rid"), "rid")[0].groupBy("rid").agg(F.first("text").alias("text")).join(wanted, "rid")
    return materialize(moved.select("key", "node", "text").groupBy("key").applyInPandas(
        lambda b: linked(b, share, size), "a bigint, b bigint"))


def similar_classes(rows: DataFrame, share: float = SHARE, size: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """(rid, first_rid) of ``rows`` (rid, doc_id, text): first_rid is the row of the smallest
    (doc_id, rid) reachable over pairs whose shingles have a Jaccard similarity of ``share`` or more.

    Texts with equal shingles meet before any join, those without words (null, empty) too; null
    ids come first, repeated rows are in one class; rows of one ``rid`` have one id and text. ``rows``
    are read several times and not written again, so give them from a written table. The others meet where
    their SimHash fingerprints agree in a block; those of few differing bits are compared by their shingles.
    Blocks are gone through in rounds: pairs already in one class or met in an earlier block need
    no look, so near copies are compared about once. A bucket of more than ``bucket`` members is searched
    in parts of that size: each part with the bucket's first member, then those outside that one's
    class, part by part, with all parts. So no task gets more than two parts, and none of the
    bucket's links is lost.
    """
    width, blocks, distance = blocks_for(rows.count(), share)
    of_rows = materialize(signed(rows.select(F.struct("doc_id", "rid").alias("doc_id"), "text"), size, width, blocks))
    kinds = numbered(of_rows.groupBy("same").agg(
        F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in (*PRINT, "blocks")]), "node")
    names, texts = kinds.select("node", "first.rid"), rows.select("rid", "text")
    roots, zero = None, F.lit(0).cast("long")
    links = lambda groups: compared(groups, names, texts, distance, width, share, size)
    member = ["at", "node", "root", *PRINT]
    for first, last in ((0, 1), (1, 4), (4, blocks)):
        if first >= blocks:
            break
        keyed = rooted(kinds, roots).select(
            "node", "root", *PRINT, F.posexplode(F.slice("blocks", first + 1, last - first)).alias("at", "block")).withColumn(
            "at", F.col("at") + first).select((F.col("at") * F.lit(1 << width).cast("long") + F.col("block")).alias("key"), *member)
        sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where(F.col("n") > bucket))
        if sizes.isEmpty():
            roots = joined_roots(links(keyed), roots)
            continue
        maybe, small = parted(keyed, sizes, "key")
        held = materialize(maybe.join(sizes, "key", "left"))
        small = small.union(held.where("n IS NULL").select("key", *member))
        large = held.where("n IS NOT NULL").withColumn("parts", F.ceil(F.col("n") / bucket))
        part = F.pmod(F.xxhash64("node"), F.col("parts"))
        lead = large.where("node = least").select("key", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("i"), *member)
        rest = large.where("node != least").select("key", part.alias("i"), *member)
        parts = lead.union(rest).select(F.xxhash64("key", "i").alias("key"), *member)
        roots = joined_roots(links(small.union(parts)), roots)
        again = rooted(large.select("key", *member).drop("root"), roots)
        again = materialize(mixed_buckets(again).withColumn("parts", F.ceil(F.col("n") / bucket)))
        leaders = again.where("node = least").select("key", F.col("root").alias("lead"))
        apart = again.join(leaders, "key").where("root != lead")
        counts = apart.groupBy("key").agg(F.ceil(F.count("*") / bucket).alias("few"))
        one = apart.join(counts, "key").select(
            "key", F.pmod(F.xxhash64("node"), F.col("few")).alias("i"), F.explode(F.sequence(zero, F.col("parts") - 1)).alias("j"), *member)
        other = again.join(counts, "key").select(
            "key", F.explode(F.sequence(zero, F.col("few") - 1)).alias("i"), part.alias("j"), *member)
        both = one.union(other).select(F.xxhash64("key", "i", "j").alias("key"), *member).distinct()
        roots = joined_roots(links(both), roots)
    found = rooted(kinds.select("same", "first", "node"), roots).withColumn("root", F.coalesce("root", "node"))
    least = found.groupBy("root").agg(F.min("first").alias("least"))
    classes = materialize(found.join(least, "root").select("same", F.col("least.rid").alias("first_rid")))
    return of_rows.join(classes, "same").select(F.col("doc_id.rid").alias("rid"), "first_rid")


def joined_roots(edges: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(node, root) over the classes so far and the new edges."""
    if edges.isEmpty() and roots is not None:
        return roots
    known = edges if roots is None else edges.union(roots.select("root", "node"))
    return materialize(components(known))
