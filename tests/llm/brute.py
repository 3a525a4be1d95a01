"""Plain versions of the operators, to hold the Spark ones against."""

import hashlib
import math
import re
import zlib
from collections import defaultdict
from itertools import combinations

import xxhash

SPACE_WORD = re.compile("[^\x20\x09-\x0d]+")
ASCII_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quality_counts(text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def binomial_tail(k, n, rate):
    return sum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1))


def crc(text):
    return zlib.crc32((text or "").encode())


def fingerprint(text):
    words = SPACE_WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Smallest id reachable over links of at most three bits; prints: [(id, fingerprint)]."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return [least[find(i)] for i in range(len(prints))]


def overlap(docs, items, length=10):
    """(n_words, n_hit, sorted ids) of each text."""
    windows = {}
    for item, text in items:
        words = ASCII_WORD.findall((text or "").translate(LOWER))
        if words:
            for i in range(max(1, len(words) - length + 1)):
                windows.setdefault(tuple(words[i:i + length]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for text in docs:
        words = ASCII_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                at = windows.get(tuple(words[i:i + n]))
                if at:
                    hit.update(range(i, i + n))
                    found |= at
        out.append((len(words), len(hit), sorted(map(str, found))))
    return out


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return [(k, s, e) for s, k, e in sorted(out)]


def without_repeats(texts):
    """(n_removed, n_spans, sha256) of each text, in order."""
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            w = data[s:s + 100]
            if w in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, x in zip(data, gone, strict=True) if not x)
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingle_sets(texts):
    worded = [SPACE_WORD.findall((t or "").translate(LOWER)) for t in texts]
    return [frozenset(" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in worded]


def similar_pairs(sets, share=0.8):
    """All pairs of sets, both with members, of Jaccard similarity ``share`` or more."""
    by, common = defaultdict(list), defaultdict(int)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for at in by.values():
        for pair in combinations(at, 2):
            common[pair] += 1
    return [(a, b) for (a, b), n in common.items() if n >= share * (len(sets[a]) + len(sets[b]) - n)]


def one_of_each(ids, texts):
    """Sorted ids that are the smallest of their class over all pairs; texts without words are one class."""
    sets, least = shingle_sets(texts), [int(i) for i in ids]
    pairs = similar_pairs(sets) + list(combinations([i for i, s in enumerate(sets) if not s], 2))
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                moved = True
    return sorted(int(d) for d, low in zip(ids, least, strict=True) if d == low)
