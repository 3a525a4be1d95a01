"""Exact token counts of every prefix of a text, by dynamic programming over its bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick
from .encoding import Encoder, encoder, parts_of

#: Runs that a byte-level tokenizer never joins across, white space apart.
_RUNS = regex.compile(r"(\s+)|(?<! )'(?:[sdmt]|ll|ve|re)|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+")
_LONG = 64
#: Parts remembered per task in each of two generations, and states of beginnings.
REMEMBERED = 700_000
BEGINNINGS = 100_000
_STOPS = (5, 8, 11, 14)


class PrefixCounts:
    """Counts of all prefixes of texts under one byte-level tokenizers file.

    The encoding of a prefix ends in exactly one token, and what stands before it is the
    encoding of the shorter prefix. So the last token of each prefix follows from those of
    shorter ones: it is the only token that ends there and whose pair with the token
    before it encodes to that pair. The count is one more than the shorter prefix's.
    """

    def __init__(self, model: Encoder):
        if model.fast is None:
            raise ValueError("prefix counts need a byte-level tokenizer whose ids follow its merges")
        self.model, self.ranks = model, model.ranks
        self.longest = max(map(len, self.ranks))
        if self.longest > 128:
            raise ValueError("tokens above 128 bytes don't fit the stored differences")
        self.word = {i: b for b, i in self.ranks.items()}
        self.base = max(self.word) + 2
        self.tails = {b[i:] for b in self.ranks for i in range(len(b))}
        self.begun: dict[bytes, tuple[list[int], list[int], int]] = {}
        self.pairs: dict[int, bool] = {}
        #: Of pieces and of parts of several pieces; what was not used since the last turn is in ``older``.
        self.known: dict[str, tuple[bytes, int]] = {}
        self.older: dict[str, tuple[bytes, int]] = {}

    def _follows(self, pair: int) -> bool:
        """Whether a token can stand after another (or first), and remember it; the pair is (a + 1) * base + b."""
        a, b = divmod(pair, self.base)
        whole, wanted = (self.word[a - 1] + self.word[b], [a - 1, b]) if a else (self.word[b], [b])
        known = self.pairs[pair] = self.model.fast._encode_single_piece(whole) == wanted
        return known

    def piece(self, text: str) -> tuple[bytes, int]:
        """Differences and total of a piece that is never split before encoding.

        The token that ends at a place is looked for first where the one before began, then
        from the shortest up, while what stands there still ends some token. Words that begin
        alike share the states of their beginning.
        """
        found = self.known.get(text) or self.older.get(text)
        if found is not None:
            self.known[text] = found
            return found
        data = text.encode("utf-8")
        n = len(data)
        get, pairs, base, tails = self.ranks.get, self.pairs, self.base, self.tails
        last, count, begin = [0], [0], 0
        for stop in reversed(_STOPS):
            if stop < n and (state := self.begun.get(data[:stop])):
                last, count, begin = state[0].copy(), state[1].copy(), state[2]
                break
        for end in range(len(last), n + 1):
            token = get(data[begin:end])
            if token is not None:
                pair = last[begin] * base + token
                fits = pairs.get(pair)
                if self._follows(pair) if fits is None else fits:
                    last.append(token + 1)
                    count.append(count[begin] + 1)
                    continue
            start = end
            while start:
                start -= 1
                tail = data[start:end]
                if tail not in tails:
                    raise AssertionError(f"no token ends at byte {end} of {text!r}")
                token = get(tail)
                if token is None or start == begin:
                    continue
                pair = last[start] * base + token
                fits = pairs.get(pair)
                if self._follows(pair) if fits is None else fits:
                    begin = start
                    last.append(token + 1)
                    count.append(count[start] + 1)
                    break
            if end in _STOPS and end < n and len(self.begun) < BEGINNINGS:
                self.begun[data[:end]] = (last.copy(), count.copy(), begin)
        if len(text) == len(data):
            out = bytes([(b - a) & 255 for a, b in zip(count, count[1:], strict=False)])
        else:
            ends = [i for i in range(1, len(data) + 1) if i == len(data) or data[i] & 192 != 128]
            at = [0, *(count[i] for i in ends)]
            out = bytes([(b - a) & 255 for a, b in zip(at, at[1:], strict=False)])
        if len(text) <= _LONG:
            self.known[text] = (out, count[-1])
        return out, count[-1]

    def counts(self, text: str) -> list[int]:
        """Token counts of the prefixes of a piece at each code point."""
        return list(accumulate(d - 256 if d > 127 else d for d in self.piece(text)[0]))

    def part(self, text: str) -> tuple[bytes, int]:
        """Differences and total of a text without special strings.

        In a run of white space every prefix is one piece; if something follows, the run's
        last character leaves it, a space joining what follows. A contraction's prefixes are
        an apostrophe and a word.
        """
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return self.piece(text)
        if text[-1:] in (".", ",") and text[1:-1].isalpha() and (text[0] == " " or text[0].isalpha()):
            word, mark = self.piece(text[:-1]), self.piece(text[-1])
            return word[0] + mark[0], word[1] + mark[1]
        out: list[int] = []
        base, held = 0, ""
        for m in _RUNS.finditer(text):
            run = m.group()
            if m.lastindex:
                counts = self.counts(run)
                out.extend(base + c for c in counts)
                if m.end() == len(text):
                    break
                before = counts[-2] if len(run) > 1 else 0
                if run[-1] == " ":
                    base, held = base + before, " "
                else:
                    base += before + self.piece(run[-1])[1] if len(run) > 1 else counts[-1]
                continue
            if run[0] == "'" and len(run) > 1 and run[1:] in ("s", "d", "m", "t", "ll", "ve", "re") and not held:
                mark, rest = self.piece("'")[1], self.counts(run[1:])
                out.extend([base + mark, *(base + mark + c for c in rest[:-1]), base + self.piece(run)[1]])
                base += self.piece(run)[1]
                continue
            counts = self.counts(held + run)
            out.extend(base + c for c in counts[len(held):])
            base, held = base + counts[-1], ""
        return bytes([(b - a) & 255 for a, b in zip([0, *out], out, strict=False)]), out[-1] if out else 0

    def differences(self, text: str) -> tuple[bytes, int]:
        """Count of each prefix less that of the one before, a signed byte per code point; and the total."""
        specials = [s for s in self.model.special if s in text]
        if specials:
            return self._with_specials(text, specials)
        found, total = [], 0
        for part in parts_of(text):
            known = self.known.get(part)
            if known is None:
                known = self.older.get(part) or self.part(part)
                if not part.isascii() and not self.model.plain(part):
                    known = self._settled(part, *known)
                if len(part) <= _LONG and not part.endswith((".", ",")):
                    self.known[part] = known
            found.append(known[0])
            total += known[1]
        return b"".join(found), total

    def _settled(self, part: str, differences: bytes, total: int) -> tuple[bytes, int]:
        """The last count as the library has it, whose tables of letters may be of another age."""
        now = len(self.model.library.encode(part, add_special_tokens=False).ids)
        return differences[:-1] + bytes([(differences[-1] + now - total) & 255]), now

    def _with_specials(self, text: str, specials: list[str]) -> tuple[bytes, int]:
        cut = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")").split(text)
        found, total = [], 0
        for plain, special in zip(cut[::2], [*cut[1::2], ""], strict=True):
            here, count = self.differences(plain) if plain else (b"", 0)
            found.append(here)
            if special:
                inside = [count, *(self.differences(plain + special[:k])[1] for k in range(1, len(special))), count + 1]
                found.append(np.diff(np.array(inside)).astype(np.int8).tobytes())
                count += 1
            total += count
        return b"".join(found), total

    def forget(self) -> None:
        """Bounds the memory of a task on texts of ever new words."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        if len(self.begun) >= BEGINNINGS:
            self.begun.clear()
        if len(self.pairs) > 2 * REMEMBERED:
            self.pairs.clear()


_COUNTERS: dict[str, PrefixCounts] = {}


def counter(path: str) -> PrefixCounts:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounts(encoder(path))
    return _COUNTERS[path]


def within(differences: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    fits = np.cumsum(np.frombuffer(differences, np.int8), dtype=np.int64) <= budget
    return len(fits) - int(fits[::-1].argmax()) if fits.any() else 0


def tokens_at(differences: bytes, length: int) -> int:
    """Tokens of the prefix of ``length`` code points."""
    return int(np.frombuffer(differences, np.int8)[:length].sum(dtype=np.int64))


def prefix_counts(docs: DataFrame, tokenizer: str, budget: int, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_chars_within): one row per document.

    n_chars_within is the longest prefix of at most ``budget`` tokens. With ``keep`` the
    column ``differences`` holds the count of every prefix, a byte per code point, for
    later questions by ``answered``. Special strings in a text count as one token, as the
    library has them. Null and empty texts have no tokens.
    """
    rows = pick(docs, doc_id=key, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_tokens", "n_chars_within"] + ["differences"] * keep

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer)
        for batch in parts:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = [t or "" for t in some.column(1).to_pylist()]
                found = [counts.differences(t) for t in texts]
                columns = [
                    some.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                    pa.array([n for _, n in found], pa.int64()),
                    pa.array([within(d, budget) for d, _ in found], pa.int64())]
                if keep:
                    columns.append(pa.array([d for d, _ in found], pa.binary()))
                counts.forget()
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, n_bytes bigint, n_tokens bigint, n_chars_within bigint" + ", differences binary" * keep
    return rows.mapInArrow(batches, schema)


def answered(stored: DataFrame, budgets: list[int], lengths: list[int]) -> DataFrame:
    """Answers from a kept table, without encoding again: (doc_id, chars_within, tokens_at), an
    array with a value per budget and one per length in code points."""
    kind = stored.schema["doc_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([[within(d, b) for b in budgets] for d in found], pa.list_(pa.int64())),
                pa.array([[tokens_at(d, n) for n in lengths] for d in found], pa.list_(pa.int64()))],
                ["doc_id", "chars_within", "tokens_at"])

    return stored.select("doc_id", F.col("differences")).mapInArrow(
        batches, f"doc_id {kind}, chars_within array<bigint>, tokens_at array<bigint>")
