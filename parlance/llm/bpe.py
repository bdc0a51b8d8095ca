"""Byte-level BPE ids inside tasks, equal to those of the ``tokenizers`` library for the same file.

A text is cut before every space that a character outside white space follows; the vocabulary's pattern
always begins a token there, so the parts can be encoded one by one and frequent parts are remembered.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken

# Fixed value: the pattern that splits text before the merges of this kind of vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 300_000

_MIXED = re.compile(r" \s| $")
_encoders: dict[str, "Encoder"] = {}


def byte_of_symbol() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder(dict):
    """Maps a part of a text to its ids (little-endian 32-bit); parts not yet seen are encoded on access."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbols = byte_of_symbol()
        ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self._bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._added = {text: np.array([i], "<u4").tobytes() for text, i in added.items()}
        self._split = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None

    def __missing__(self, part: str) -> bytes:
        ids = np.array(self._bpe.encode_ordinary(part), "<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(part) <= 64:
            self[part] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        if _MIXED.search(text):
            return np.array(self._bpe.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        out = [self[first]] if first else []
        out += [self[" " + part] for part in rest]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self._split is None or not self._split.search(text):
            return self._plain(text)
        return b"".join(self._added[p] if p in self._added else self._plain(p) for p in self._split.split(text) if p)


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
