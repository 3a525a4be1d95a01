"""Suffix order and common prefixes of one shard by external induced sorting.

The shard's text is numbers with a unique smallest end. Suffixes that are smaller than
their left neighbour and follow a larger one (seeds) are sorted by recursion on their
names; two scans then induce all others. A scan reads suffixes in order and pushes each
one's left neighbour into a priority queue keyed by its first symbol; equal symbols leave
the queue in the order in which they came. Queue blocks beyond a memory bound lie in a
temporary file of the task, which vanishes with it; a lost task is run anew by Spark.

Everything is done in batches: as many smallest symbols as can't be disturbed by pushes
of the same batch are popped at once.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Common prefixes are exact up to this length.
CAP = 120
#: Suffixes per bucket of the queue, on average, and bytes of blocks kept in memory.
PER_BUCKET = 4_000
MEMORY = 64 << 20


class BucketQueue:
    """Blocks of (symbol, place, common prefix) by range of symbols, in order of arrival."""

    def __init__(self, buckets: int, memory: int = MEMORY):
        self.blocks: list[list] = [[] for _ in range(buckets)]
        self.limit, self.held, self.file, self.spilled = memory, 0, None, 0

    def push(self, bucket: np.ndarray, symbol: np.ndarray, place: np.ndarray, common: np.ndarray) -> None:
        if not len(bucket):
            return
        order = np.argsort(bucket, kind="stable")
        rows = np.stack([symbol[order], place[order], common[order]]).astype(np.int32)
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for which, part in zip(bucket[order][np.r_[0, cuts]].tolist(), np.split(rows, cuts, axis=1), strict=True):
            part = np.ascontiguousarray(part)
            self.blocks[which].append(part)
            self.held += part.nbytes
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        """All blocks in memory go to the file, those popped last first."""
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for blocks in reversed(self.blocks):
            for i, block in enumerate(blocks):
                if isinstance(block, np.ndarray):
                    at = self.file.tell()
                    self.file.write(block.tobytes())
                    blocks[i] = (at, block.shape[1])
                    self.spilled += block.nbytes
        self.held = 0

    def pop(self, bucket: int) -> np.ndarray:
        out = []
        for block in self.blocks[bucket]:
            if isinstance(block, np.ndarray):
                self.held -= block.nbytes
                out.append(block)
            else:
                self.file.seek(block[0])
                out.append(np.frombuffer(self.file.read(12 * block[1]), np.int32).reshape(3, -1))
        self.blocks[bucket] = []
        return np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int32)

    def close(self) -> None:
        if self.file:
            self.file.close()


def suffix_order(text: np.ndarray, common: bool = True, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray | None]:
    """Places of all suffixes in order, and the common prefix of each with the one before.

    ``text`` ends in its only and smallest 0.
    """
    text = text.astype(np.int32)
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.int32)
    step = np.sign(text[1:] - text[:-1])
    change = np.where(step != 0, np.arange(n - 1, dtype=np.int32), n)
    change = np.minimum.accumulate(change[::-1])[::-1]
    rises = np.r_[step[change] > 0, True]
    runs = np.r_[change - np.arange(n - 1, dtype=np.int32) + 1, 1].astype(np.int32)
    seeds = (np.flatnonzero(rises[1:] & ~rises[:-1]) + 1).astype(np.int32)
    order = seeds[_named_order(text, seeds, memory)]
    falls = ~rises
    shared = _direct(text, order) if common else None
    places, common_l = _scan(text, falls, order, shared, runs, memory)
    falling = falls[places]
    l_places = places[falling][::-1]
    l_common = None
    if common:
        starts = np.flatnonzero(falling)
        between = np.minimum.reduceat(common_l, np.r_[0, starts[:-1] + 1]) if len(starts) else common_l[:0]
        l_common = np.r_[0, between[1:][::-1]].astype(np.int32) if len(starts) else between
    top = int(text.max())
    inner = rises.copy()
    inner[-1] = False
    down, common_s = _scan(top - text, inner, l_places, l_common, runs, memory)
    out = np.r_[n - 1, down[::-1]].astype(np.int32)
    return out, (np.r_[0, 0, common_s[1:][::-1]].astype(np.int32) if common else None)


def _named_order(text: np.ndarray, seeds: np.ndarray, memory: int) -> np.ndarray:
    """Order of the seeds' suffixes: by name where names differ, else by recursion on the names."""
    ranks = _names(text, seeds)
    order = np.argsort(ranks, kind="stable")
    sorted_ranks = ranks[order]
    fresh = np.r_[True, sorted_ranks[1:] != sorted_ranks[:-1]]
    if fresh.all():
        return order
    names = np.empty(len(ranks), np.int32)
    names[order] = np.cumsum(fresh) - 1
    return suffix_order(names, False, memory)[0]


def _names(text: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Rank of each seed's string up to and with the next seed's symbol; equal strings rank equal.

    Strings are compared a word of packed symbols at a time, only among those still equal.
    Where one ends, what goes on is smaller, hence the filling above all symbols.
    """
    fill = int(text.max()) + 1
    bits = fill.bit_length()
    per = max(1, 62 // bits)
    lengths = np.r_[np.diff(seeds) + 1, 1]
    ranks, active, offset = np.zeros(len(seeds), np.int64), np.arange(len(seeds)), 0
    while len(active):
        key = np.zeros(len(active), np.int64)
        for k in range(per):
            at = offset + k
            there = at < lengths[active]
            value = np.full(len(active), fill, np.int64)
            value[there] = text[seeds[active[there]] + at]
            key = (key << bits) | value
        order = np.lexsort((key, ranks[active]))
        old, words = ranks[active][order], key[order]
        group = np.r_[True, old[1:] != old[:-1]]
        fresh = group | np.r_[True, words[1:] != words[:-1]]
        index = np.arange(len(order))
        first_of_group = np.maximum.accumulate(np.where(group, index, 0))
        first_of_equal = np.maximum.accumulate(np.where(fresh, index, 0))
        ranks[active[order]] = old + (first_of_equal - first_of_group)
        offset += per
        sizes = np.diff(np.r_[np.flatnonzero(fresh), len(order)])
        tied = np.repeat(sizes > 1, sizes)
        still = active[order][tied]
        active = still[lengths[still] > offset]
    return ranks


def _direct(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of neighbours in ``order``, up to CAP, a word of packed symbols at a time.

    The only 0 ends the text, so two suffixes differ before either is over.
    """
    n, bits = len(text), int(text.max()).bit_length()
    per = max(1, 62 // max(1, bits))
    words = np.zeros(n + per, np.int64)
    words[:n] = text
    packed = words[:n].copy()
    for k in range(1, per):
        packed <<= bits
        packed |= words[k:n + k]
    out, live = np.zeros(len(order), np.int32), np.arange(1, len(order))
    for k in range(0, CAP, per):
        apart = packed[order[live - 1] + k] ^ packed[order[live] + k]
        for j in range(1, per + 1):
            out[live] += apart >> (bits * (per - j)) == 0
        live = live[apart == 0]
        if not len(live):
            break
    return np.minimum(out, CAP)


def _scan(text: np.ndarray, target: np.ndarray, seeds: np.ndarray, shared: np.ndarray | None, runs: np.ndarray,
          memory: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Seeds and all target suffixes in ascending order of ``text``'s symbols, targets before
    the seeds of their symbol; with ``shared`` the common prefix of each with the one before."""
    track = shared is not None
    symbols = int(text.max()) + 1
    counts = np.bincount(text, minlength=symbols)
    bucket_of = (np.cumsum(counts) - counts) // PER_BUCKET if symbols > 512 else np.arange(symbols)
    bucket_of = np.unique(bucket_of, return_inverse=True)[1].astype(np.int32)
    queue = BucketQueue(int(bucket_of[-1]) + 1, memory)
    since = np.full(symbols if track else 0, CAP, np.int32)  # least common prefix since the last push of a symbol
    pushed = np.zeros(symbols if track else 0, bool)
    last_target = np.full(symbols if track else 0, -1, np.int32)
    seed_symbols = text[seeds]
    seed_bucket = bucket_of[seed_symbols]
    seed_cut = np.searchsorted(seed_bucket, np.arange(int(bucket_of[-1]) + 2))
    out_place, out_common = [], []

    for bucket in range(int(bucket_of[-1]) + 1):
        s_at, s_end = int(seed_cut[bucket]), int(seed_cut[bucket + 1])
        waiting = queue.pop(bucket)
        while waiting.shape[1] or s_at < s_end:
            s_sym = seed_symbols[s_at:s_end]
            sym = np.r_[waiting[0], s_sym]
            place = np.r_[waiting[1], seeds[s_at:s_end]]
            left = place - 1
            good = left >= 0
            good[good] = target[left[good]]
            pred = text[left]
            inside = good & (bucket_of[pred] == bucket)
            bound = int(pred[inside].min()) if inside.any() else symbols
            take_w = waiting[0] <= bound
            n_seeds = int(np.searchsorted(s_sym, bound, side="left"))
            w = waiting[:, take_w]
            kind = np.r_[np.zeros(w.shape[1], np.int8), np.ones(n_seeds, np.int8)]
            b_sym = np.r_[w[0], s_sym[:n_seeds]]
            order = np.argsort(b_sym.astype(np.int64) * 2 + kind, kind="stable")
            b_sym, b_place, kind = b_sym[order], np.r_[w[1], seeds[s_at:s_at + n_seeds]][order], kind[order]
            if track:
                own = np.r_[w[2], shared[s_at:s_at + n_seeds]][order]
                own = _bordered(own, b_sym, b_place, kind, runs, last_target)
                out_common.append(own)
            out_place.append(b_place)
            left = b_place - 1
            good = left >= 0
            good[good] = target[left[good]]
            at = np.flatnonzero(good)
            new_place = left[at]
            new_sym = text[new_place]
            new_common = _carried(own, at, new_sym, since, pushed) if track else np.zeros(len(at), np.int32)
            here = bucket_of[new_sym] == bucket
            queue.push(bucket_of[new_sym[~here]], new_sym[~here], new_place[~here], new_common[~here])
            again = np.stack([new_sym[here], new_place[here], new_common[here]]).astype(np.int32)
            waiting = np.concatenate([waiting[:, ~take_w], again], axis=1)
            s_at += n_seeds
    queue.close()
    empty = np.zeros(0, np.int32)
    return (np.concatenate(out_place) if out_place else empty), (np.concatenate(out_common or [empty]) if track else None)


def _bordered(own: np.ndarray, symbol: np.ndarray, place: np.ndarray, kind: np.ndarray, runs: np.ndarray,
              last_target: np.ndarray) -> np.ndarray:
    """Common prefixes with the one before, mended where targets of a symbol end and its seeds begin:
    one falls below, the other rises above the symbol after its run, so the shorter run counts."""
    first_seed = (kind == 1) & np.r_[True, (symbol[1:] != symbol[:-1]) | (kind[1:] != kind[:-1])]
    targets = kind == 0
    ends = targets & np.r_[(symbol[1:] != symbol[:-1]) | (kind[1:] != kind[:-1]), True]
    last_target[symbol[ends]] = place[ends]
    own = own.copy()
    at = np.flatnonzero(first_seed)
    before = last_target[symbol[at]]
    # a seed whose neighbour before has the same symbol and is a seed of an earlier batch keeps its value
    met = before >= 0
    own[at[met]] = np.minimum(np.minimum(runs[before[met]], runs[place[at[met]]]), CAP)
    last_target[symbol[at]] = -1
    return own


def _carried(own: np.ndarray, at: np.ndarray, symbol: np.ndarray, since: np.ndarray, pushed: np.ndarray) -> np.ndarray:
    """Common prefix of each pushed suffix with the one pushed before it under the same symbol:
    one more than the least common prefix scanned since then."""
    n = len(own)
    out = np.zeros(len(at), np.int32)
    if len(at):
        table = [own]
        while 2 << (len(table) - 1) <= n:
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        order = np.argsort(symbol, kind="stable")
        s, where = symbol[order], at[order]
        first = np.r_[True, s[1:] != s[:-1]]
        low = np.where(first, 0, np.r_[0, where[:-1] + 1])
        least = _range_least(table, low, where)
        least[first] = np.minimum(least[first], since[s[first]])
        found = np.minimum(least + 1, CAP)
        found[first & ~pushed[s]] = 0
        out[order] = found
        last = np.r_[s[1:] != s[:-1], True]
        tail = where[last] + 1
        rest = np.full(len(tail), CAP, np.int32)
        some = tail < n
        rest[some] = _range_least(table, tail[some], np.full(int(some.sum()), n - 1))
        np.minimum(since, own.min(), out=since)
        since[s[last]] = rest
        pushed[s[last]] = True
    elif n:
        np.minimum(since, own.min(), out=since)
    return out


def _range_least(table: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value of table[0] between places low and high, both included."""
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), np.int32)
    for k in np.unique(level).tolist():
        these = level == k
        out[these] = np.minimum(table[k][low[these]], table[k][high[these] - (1 << k) + 1])
    return out
