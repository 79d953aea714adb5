"""Cutting texts into the pieces that a byte-level BPE tokenizer encodes one by one, and reading such a tokenizer's file."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import regex

#: Pieces, and units of a blank and what follows it, that a worker remembers before it starts anew (about 80 MB each).
PIECE_CACHE = 500_000
#: Fixed value: English endings, letters, numbers and other signs (each with one blank before), white space.
PIECE = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
TWO_SPACES = re.compile(r"\s\s")
SPACE = regex.compile(r"\s")


class Units(dict):
    """What follows a blank up to the next one -> ``of(blank + it)``. No piece goes beyond a single blank, so a text is the
    concatenation of its units, and texts of known words are encoded by look-up. When full, entries used since the last
    time are kept for another round: frequent words stay."""

    def __init__(self, of: Callable[[str], bytes]):
        self.of, self.before = of, {}

    def __missing__(self, unit: str) -> bytes:
        value = self.before.get(unit)
        if value is None:
            value = self.of(" " + unit)
        if len(self) >= PIECE_CACHE:
            self.before = dict(self)
            self.clear()
        self[unit] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.before = {}

    def whole(self, text: str) -> bytes:
        """The joined values of a text's units."""
        if not text:
            return b""
        first, *rest = units_of(text)
        return self.of(first) + b"".join(map(self.__getitem__, rest)) if first else b"".join(map(self.__getitem__, rest))


def units_of(text: str) -> list[str]:
    """What lies between a text's single blanks: its beginning, then what follows each; runs of white space stay within one unit."""
    parts = text.split(" ")
    return _merged(parts) if TWO_SPACES.search(text) else parts


def _merged(parts: list[str]) -> list[str]:
    """Parts between blanks, joined again where the blank between them touches other white space."""
    out = parts[:1]
    for p in parts[1:]:
        if not p or p[0].isspace() or not out[-1] or out[-1][-1].isspace():
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: visible Latin-1 signs for themselves, the rest from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def read_bpe(path: str) -> tuple[list[bytes], list[tuple[int, int, int]], dict[str, int]]:
    """Bytes of each id, merges as (left id, right id, new id) by rank, and added tokens."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    letters, vocab = byte_letters(), data["model"]["vocab"]
    added = {t["content"]: t["id"] for t in data["added_tokens"]}
    of = [b""] * (1 + max([*vocab.values(), *added.values()]))
    for text, i in vocab.items():
        of[i] = bytes(letters[c] for c in text)
    for text, i in added.items():
        of[i] = text.encode()
    merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
    return of, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], added


def added_pattern(added: dict[str, int]) -> re.Pattern:
    """Added tokens are cut out of a text first, the longest where several start."""
    return re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
