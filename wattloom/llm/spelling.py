"""Spelling variants: words one edit apart, found by pivotal grams.

Each word chooses two disjoint bigrams among its rarest ones; one edit leaves one of them whole.
So a near word holds that gram among its own rarest grams, at the same place from the left (the
edit lies to the right) or from the right (it lies to the left). Pivots are looked up among the
other words' gram prefixes by gram and place, and every pair found is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, pick

#: Code points of a word, and its occurrences, at least.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One of so many occurrences loses a code point; a form is so many times as frequent.
DROP_EVERY, FORM_TIMES = 31, 10
#: Bigrams of a pivot, pivots of a word (edits + 1) and grams of its prefix (2 * edits + 1).
GRAM, PIVOTS, PREFIX = 2, 2, 3
#: Letters are a-z and U+00C0 to U+00FF, so there are no more bigrams than this.
GRAMS = (26 + 64) ** 2
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Distinct words a task holds before it hands them on.
_HELD = 200_000


def _words_of(doc_id, text: str) -> Iterator[str]:
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run in _RUN.findall(text.encode("utf-8", "replace").translate(_TABLE).decode()):
        h = zlib.crc32(run.encode(), seed)
        if h % DROP_EVERY:
            yield run
        elif len(run) > LEAST_LENGTH:
            at = h % len(run)
            yield run[:at] + run[at + 1:]


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the distinct words of all texts with ``LEAST_COUNT`` or more occurrences.

    Null and empty texts have none; a null id counts as an empty one; repeated rows count again.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def emptied() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in parts:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if value.is_valid:
                    held.update(_words_of(doc_id, value.as_py()))
                if len(held) > _HELD:
                    yield emptied()
        yield emptied()

    counted = pick(docs, doc_id=key, text=text).mapInArrow(batches, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def gram_order(found: DataFrame) -> dict[str, tuple[int, int]]:
    """Place in the order of rarity and number of words of each bigram; at most ``GRAMS`` of them."""
    grams = F.expr(f"transform(sequence(1, length(word) - 1), i -> substring(word, i, {GRAM}))")
    counted = found.select(F.explode(grams).alias("gram")).groupBy("gram").count().limit(GRAMS + 1).collect()
    if len(counted) > GRAMS:
        raise ValueError("words with other letters than those of the run pattern")
    return {r["gram"]: (i, r["count"]) for i, r in enumerate(sorted(counted, key=lambda r: (r["count"], r["gram"])))}


def chosen_pivots(places: list[int], weights: list[int]) -> list[int]:
    """``PIVOTS`` disjoint grams of smallest total weight, of grams at increasing ``places``.

    ``best[j]`` holds the least weight of j disjoint grams among those that end before the
    current one, and the choice.
    """
    best = [[(0, ())] * (len(places) + 1)] + [[(float("inf"), ())] * (len(places) + 1) for _ in range(PIVOTS)]
    for i, (place, weight) in enumerate(zip(places, weights, strict=True)):
        free = next((k for k in range(i, 0, -1) if places[k - 1] + GRAM <= place), 0)
        for j in range(1, PIVOTS + 1):
            before, chosen = best[j - 1][free]
            best[j][i + 1] = min(best[j][i], (before + weight, (*chosen, place)))
    return list(best[PIVOTS][len(places)][1])


def gram_prefix(word: str, order: dict[str, tuple[int, int]]) -> tuple[int, list[int], list[int]]:
    """(order of the last gram of the prefix, places of the pivots, places of the prefix).

    The prefix has the three rarest grams and all others equal to the last of them.
    """
    ranked = sorted((order[word[i:i + GRAM]][0], i) for i in range(len(word) - 1))
    last = ranked[PREFIX - 1][0]
    first = sorted(place for _, place in ranked[:PREFIX])
    pivots = chosen_pivots(first, [order[word[i:i + GRAM]][1] for i in first])
    return last, pivots, [place for rank, place in ranked if rank <= last]


def place_keys(word: str, place: int, other: int, pivot_side: bool) -> Iterator[str]:
    """Keys under which ``word`` meets words of ``other`` code points that share the gram at ``place``.

    The edit lies on one side of the gram, so the other side is equal. Of the side with the
    edit, its first or its last half (of the shorter word) is equal too.
    """
    n = len(word)
    pair = f"{n},{other}" if pivot_side else f"{other},{n}"
    after = min(n, other) - place - GRAM
    if after >= 0 and max(n, other) > place + GRAM:
        half = after // 2
        yield f"{pair},r{place},{word[:place + GRAM + half]}"
        yield f"{pair},R{place},{word[:place + GRAM]},{word[n - after + half:]}"
    kept = n - place
    before = min(n, other) - kept
    if before >= 0 and max(n, other) > kept:
        half = before // 2
        yield f"{pair},l{kept},{word[:half]},{word[place:]}"
        yield f"{pair},L{kept},{word[place - before + half:]}"


def keyed(found: DataFrame, order, pivot_side: bool) -> DataFrame:
    """(key, word, last) for each key of a word's pivots, or of its gram prefix."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        known = order.value
        for batch in parts:
            for at in range(0, batch.num_rows, 4096):
                keys, names, lasts = [], [], []
                for word in batch.column(0).slice(at, 4096).to_pylist():
                    last, pivots, prefix = gram_prefix(word, known)
                    mine = {digest(key) - (1 << 63) for place in (pivots if pivot_side else prefix)
                            for other in (len(word) - 1, len(word), len(word) + 1) for key in place_keys(word, place, other, pivot_side)}
                    keys.extend(mine)
                    names.extend([word] * len(mine))
                    lasts.extend([last] * len(mine))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(names, pa.string()), pa.array(lasts, pa.int32())], ["key", "word", "last"])

    return found.select("word").mapInArrow(batches, "key bigint, word string, last int")


def near_pairs(found: DataFrame) -> DataFrame:
    """(a, b), a before b: all pairs of the distinct words of ``found`` that are one edit apart.

    Of two near words, the pivots of the one whose prefix ends earlier in the order of grams
    occur in the prefix of the other.
    """
    spark = found.sparkSession
    order = spark.sparkContext.broadcast(gram_order(found))
    r, s = keyed(found, order, True).alias("r"), keyed(found, order, False).alias("s")
    met = r.join(s, F.expr("r.key = s.key AND r.last <= s.last AND r.word != s.word AND levenshtein(r.word, s.word, 1) = 1"))
    return met.select(F.expr("least(r.word, s.word)").alias("a"), F.expr("greatest(r.word, s.word)").alias("b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form) by doubling: each round follows twice as many forms.

    A form is ten times as frequent as its word, so there are no circles and few rounds.
    """
    links = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = materialize(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``words``.

    ``form`` is the most frequent near word (of equal ones the first in code-point order) if it
    is ten times as frequent, else null; ``root`` ends the chain of forms, the word itself
    without one. Empty tables and texts without words give no rows.
    """
    found = materialize(words(docs, key, text))
    pairs = materialize(near_pairs(found))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counts = found.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    most = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = both.join(counts, "near").groupBy("word").agg(F.count("*").alias("n_near"), most.alias("most"))
    is_form = -F.col("most.less") >= FORM_TIMES * F.col("n")
    formed = materialize(found.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("most.near")).alias("form"), F.when(is_form, -F.col("most.less")).alias("form_n")))
    ends = roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
