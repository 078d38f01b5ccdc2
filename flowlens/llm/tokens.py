"""Words of many texts at once, as arrays of 64-bit keys: no Python step per word."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np

from .common import WORD, splitmix

#: Characters that are worked on at once (about); a longer word is not cut.
SPAN = 500_000
_TURNS = 1 << 16


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point whether ``WORD`` takes it, and a number; a factor for each place in a word."""
    inside = np.zeros(0x110000, dtype=bool)
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
        for m in WORD.finditer("".join(map(chr, range(lo, hi)))):
            inside[lo + m.start() : lo + m.end()] = True
    number = splitmix(np.arange(0x110000, dtype=np.uint64))
    return inside, number, splitmix(np.arange(_TURNS, dtype=np.uint64) + np.uint64(1 << 40)) | np.uint64(1)


def keys_of_codes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, start) of each word of lower-case code points that end outside a word."""
    inside, number, factor = _tables()
    word = inside[codes]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate([[0], edge])
    starts, long = edge[0::2], edge[1::2] - edge[0::2]
    if not len(starts):
        return np.zeros(0, np.int64), starts
    first = np.cumsum(long) - long
    place = np.arange(long.sum(), dtype=np.int32) - np.repeat(first.astype(np.int32), long)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(number[codes[word]] * factor[place & (_TURNS - 1)], first)
        keys = splitmix(sums + long.astype(np.uint64)).view(np.int64)
    keys[keys == 0] = 1
    return keys, starts


def word_keys(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all words, text by text, and how many each text has. A key is
    never 0; words are those of ``WORD`` in the lower-case text."""
    keys, counts = [np.zeros(0, np.int64)], np.zeros(len(texts), dtype=np.int64)
    inside = _tables()[0]
    at, held, held_chars = 0, [], 0

    def flush() -> None:
        codes = np.frombuffer("\n".join([*held, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum([len(t) + 1 for t in held])
        mine, lo = counts[at - len(held) : at], 0
        while lo < len(codes):
            hi = min(lo + SPAN, len(codes))
            while hi < len(codes) and inside[codes[hi - 1]]:
                hi += 1
            k, starts = keys_of_codes(codes[lo:hi])
            keys.append(k)
            mine += np.diff(np.searchsorted(starts, ends - lo), prepend=0)
            lo = hi

    for text in texts:
        held.append(text.lower())
        held_chars += len(held[-1])
        at += 1
        if held_chars > SPAN:
            flush()
            held, held_chars = [], 0
    if held:
        flush()
    return np.concatenate(keys), counts
