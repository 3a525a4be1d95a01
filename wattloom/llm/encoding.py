"""Encoding texts with a public tokenizers file, each distinct part once per task."""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Fixed value: the split of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A lone space between characters that no tokenizer takes for space: always a token border.
BORDER = re.compile(r"(?<=[^\s\u180e\u200b\ufeff]) (?=[^\s\u180e\u200b\ufeff])")
#: Parts remembered per task; at this number they are forgotten and learned anew.
REMEMBERED = 300_000
_PLAIN = re.compile(r"[\u0000-\u024f]*")


def parts_of(text: str) -> list[str]:
    """``text`` cut at its borders; the spaces go with what follows."""
    first, *rest = BORDER.split(text)
    return [first, *[f" {x}" for x in rest]]


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in vocabulary files: itself where printable, else the
    characters from 256 on in order."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts by a byte-level tokenizers file.

    Parts in Latin letters without special strings go to the same vocabulary as ranks,
    several times faster; all others to the tokenizers library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.special = [t["content"] for t in told["added_tokens"]]
        self.ranks = ranks_of(told)
        self.fast = None
        if self.ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def plain(self, part: str) -> bool:
        return self.fast is not None and _PLAIN.fullmatch(part) is not None and not any(s in part for s in self.special)

    def ids_of(self, part: str) -> list[int]:
        if self.plain(part):
            return self.fast.encode_ordinary(part)
        return self.library.encode(part, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        cut = [parts_of(text) for text in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for parts in cut:
            for part in parts:
                if part not in known:
                    known[part] = np.array(self.ids_of(part), "<u4").tobytes()
        return [b"".join([known[part] for part in parts]) for parts in cut]


def ranks_of(told: dict) -> dict[bytes, int] | None:
    """The vocabulary as ranks of bytes, if the file is byte-level and its ids follow its merges."""
    before, model = told.get("pre_tokenizer") or {}, told["model"]
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    if told.get("normalizer") or model["type"] != "BPE" or model.get("ignore_merges"):
        return None
    vocab = model["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        return None
    stands = byte_alphabet()
    special = {t["content"] for t in told["added_tokens"]}
    return {bytes(stands[c] for c in word): i for word, i in vocab.items() if word not in special}


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
