"""Benchmark passages in documents by q-gram lemma filtering (operator 6).

Texts are composed (NFC) and reduced to lower-case letters and digits, with every
run of anything else one space; a map leads back to the text's code points. A pattern of length L within e edits of a region shares
at least L + 1 - q - q*e q-grams with it (the q-gram lemma), and those lie on at
most e + 1 neighbouring diagonals. So the q-grams that a document shares with a
pattern are counted in overlapping bands of 2(e + 1) diagonals, every other band
shifted by e + 1. Common q-grams are counted only where the others reach a bound that
is lower by as many; bands that reach the full bound are verified by banded alignment.

An item up to ``WHOLE`` characters is one pattern; a longer one is cut into
patterns of ``PIECE`` characters every ``STRIDE``, so that a part of a long item
is found too: every verbatim run of PIECE + STRIDE - 1 = 95 reduced characters. A pattern matches within ``EDITS`` of its length, fewer for very
short patterns so that the bound stays at one q-gram. The patterns are handed to
the tasks in portions of bounded size; a larger benchmark takes more passes over
the documents.

Defined results: null and empty texts match nothing; items shorter than q after
reduction cannot be told from chance and match nothing; repeated documents and
items give repeated findings, one per pair of ids; null ids are dropped; of an item's
regions in a text that with the fewest edits counts, of those the first that was found;
texts of any length are read whole; without documents or without items nothing is found.
Columns other than doc_id, text, item_id, whatever their names, are not read; ``remove``
keeps them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import restrict, saved, small_batches, total

Q, EDITS = 8, 0.1
WHOLE, PIECE, STRIDE = 96, 64, 32
#: Characters of patterns in one portion that is sent to the tasks.
PORTION = 4_000_000
#: Bits of the table that tells which q-grams occur in any pattern.
BITS = 22


def code_table() -> np.ndarray:
    """Code of each code point of the basic plane: 32 for what is neither letter
    nor digit, else its lower case folded to 16 bits."""
    out = np.full(1 << 16, 32, dtype=np.uint16)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isalnum():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else cp
    return out


CODES = code_table()


def reduce(text: str) -> np.ndarray:
    return mapped(text)[0]


def mapped(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The reduced text, and where each of its codes starts and ends in ``text``."""
    bounds = None
    if not unicodedata.is_normalized("NFC", text):
        whole = [m.span() for m in regex.finditer(r"\X", text)]
        parts = [unicodedata.normalize("NFC", text[a:b]) for a, b in whole]
        bounds = np.repeat(np.array(whole, dtype=np.int64), [len(p) for p in parts], axis=0)
        text = "".join(parts)
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(cps < 1 << 16, CODES[np.minimum(cps, 0xFFFF)], (cps & 0xFFFF).astype(np.uint16))
    blank = codes == 32
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    at = np.flatnonzero(keep)
    return (codes[at], at, at + 1) if bounds is None else (codes[at], bounds[at, 0], bounds[at, 1])


def located(patterns: Patterns, text: str) -> list[tuple[int, int, int, int]]:
    """What ``patterns.find`` finds, with start and end in code points of ``text``."""
    codes, starts, ends = mapped(text)
    return [(i, int(starts[a]), int(ends[b - 1]), e) for i, a, b, e in patterns.find(codes) if a < b]


def qgrams(codes: np.ndarray) -> np.ndarray:
    """64-bit keys of all q-grams (q = 8), by doubling."""
    if len(codes) < Q:
        return np.zeros(0, dtype=np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        g = codes.astype(np.uint64)
        g = (g[:-1] << np.uint64(16)) | g[1:]
        g = (g[:-2] << np.uint64(32)) | g[2:]
        g = g * mix
        return (g[:-4] ^ (g[:-4] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + g[4:]


class Patterns:
    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.codes = [], []
        self.windows: dict[tuple[int, int], np.ndarray] = {}
        for item, text in items:
            codes = reduce(text)
            solid = np.flatnonzero(codes != 32)
            codes = codes[solid[0] : solid[-1] + 1] if len(solid) else codes[:0]
            if len(codes) < Q:
                continue
            starts = [0] if len(codes) <= WHOLE else [*range(0, len(codes) - PIECE, STRIDE), len(codes) - PIECE]
            for s in starts:
                self.item.append(item)
                self.codes.append(codes if len(codes) <= WHOLE else codes[s : s + PIECE])
        size = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.size = size
        self.edits = np.maximum(np.minimum((EDITS * size).astype(np.int64), (size - Q) // Q), 0)
        self.bound = size + 1 - Q - Q * self.edits
        self.whole, self.whole_bound = [qgrams(c) for c in self.codes], self.bound.copy()
        keys = list(self.whole)
        n = np.array([len(k) for k in keys], dtype=np.int64)
        # q-grams that many patterns share cost most and tell least: each pattern
        # leaves out some of its own and lowers its bound by as many
        if keys:
            kinds, inverse, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            common = np.split(times[inverse], np.cumsum(n)[:-1])
            for i, shared in enumerate(common):
                worst = np.argsort(-shared, kind="stable")[: self.bound[i] // 2]
                keys[i] = np.stack([keys[i], np.arange(n[i], dtype=np.uint64)])
                keys[i] = np.delete(keys[i], worst[shared[worst] > 3], axis=1)
                self.bound[i] -= n[i] - keys[i].shape[1]
            offsets = np.concatenate([k[1] for k in keys]).astype(np.int64)
            n = np.array([k.shape[1] for k in keys], dtype=np.int64)
            keys = [k[0] for k in keys]
        else:
            offsets = np.zeros(0, dtype=np.int64)
        flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
        order = np.argsort(flat, kind="stable")
        self.keys, self.first, self.n = np.unique(flat[order], return_index=True, return_counts=True)
        self.owner = np.repeat(np.arange(len(n)), n)[order]
        self.offset = offsets[order]
        self.seen = np.zeros(1 << BITS, dtype=bool)
        self.seen[(self.keys >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, position - offset) of every shared q-gram."""
        at = np.flatnonzero(self.seen[(keys >> np.uint64(64 - BITS)).astype(np.int64)])
        where = np.searchsorted(self.keys, keys[at])
        where = np.minimum(where, len(self.keys) - 1)
        ok = self.keys[where] == keys[at]
        at, where = at[ok], where[ok]
        n = self.n[where]
        entry = np.repeat(self.first[where] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.owner[entry], np.repeat(at, n) - self.offset[entry]

    def find(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits): the best region of each item in a reduced text."""
        if not len(self.keys) or len(codes) < Q:
            return []
        grams = qgrams(codes)
        owner, diagonal = self.hits(grams)
        if not len(owner):
            return []
        step = self.edits[owner] + 1
        band = np.floor_divide(diagonal, step)
        span = np.int64(len(codes) + 2 * self.size.max() + 4)
        base = span // 2 - len(codes) // 2 + 1
        # a diagonal in step k lies in the bands that begin at steps k and k - 1
        key = np.concatenate([owner * span + band + base, owner * span + band - 1 + base])
        slot, n = np.unique(key, return_counts=True)
        pattern, begin = slot // span, slot % span - base
        ok = n >= self.bound[pattern]
        best: dict[int, tuple[int, int, int]] = {}
        done: set[tuple[int, int]] = set()
        for p, b, _ in sorted(zip(pattern[ok].tolist(), begin[ok].tolist(), n[ok].tolist(), strict=True), key=lambda x: (x[0], -x[2])):
            e = int(self.edits[p])
            if (p, b - 1) in done or (p, b + 1) in done:
                continue
            if self.item[p] in best and best[self.item[p]][2] == 0:
                continue
            if self.kept(p, grams, b * (e + 1), 2 * (e + 1)) < self.whole_bound[p]:
                continue
            found = exact(self.codes[p], codes, b * (e + 1), 2 * (e + 1)) or align(self.codes[p], codes, b * (e + 1), 2 * (e + 1), e)
            if found:
                done.add((p, b))
                start, end, edits = found
                item = self.item[p]
                if item not in best or edits < best[item][2]:
                    best[item] = found
        return [(i, *v) for i, v in best.items()]


    def kept(self, p: int, grams: np.ndarray, diagonal: int, width: int) -> int:
        """How many of all q-grams of a pattern, common ones too, stand in the text on
        ``width`` diagonals from ``diagonal`` on."""
        mine = self.whole[p]
        lo, hi = diagonal, diagonal + len(mine) + width - 1
        part = grams[max(lo, 0) : max(hi, 0)]
        part = np.concatenate([np.zeros(max(-lo, 0), grams.dtype), part, np.zeros(max(hi - max(len(grams), lo, 0), 0), grams.dtype)])[: hi - lo]
        at = self.windows.setdefault((len(mine), width), np.add.outer(np.arange(len(mine)), np.arange(width)))
        return int((part[at] == mine[:, None]).any(axis=1).sum())


def exact(pattern: np.ndarray, codes: np.ndarray, diagonal: int, width: int) -> tuple[int, int, int] | None:
    """``pattern`` itself on one of the diagonals."""
    lo = max(diagonal, 0)
    at = codes[lo : max(lo, diagonal + width + len(pattern))].tobytes().find(pattern.tobytes())
    return (lo + at // 2, lo + at // 2 + len(pattern), 0) if at >= 0 and at % 2 == 0 else None


def align(pattern: np.ndarray, codes: np.ndarray, diagonal: int, width: int, most: int) -> tuple[int, int, int] | None:
    """Least edits of ``pattern`` against a region of ``codes`` whose alignment
    starts on one of ``width`` diagonals from ``diagonal`` on: (start, end, edits),
    or None above ``most``. The band is ``most`` wider on either side."""
    lo, w = diagonal - most, width + 2 * most
    lane = np.arange(w)
    far = np.int64(1 << 30)
    cost = np.where((lane + lo >= 0) & (lane + lo <= len(codes)), 0, far)
    origin = lane + lo
    padded = np.concatenate([np.full(max(0, -lo), 1 << 20, dtype=np.int64), codes[max(0, lo) : max(0, lo + w + len(pattern))].astype(np.int64)])
    padded = np.concatenate([padded, np.full(max(0, w + len(pattern) - len(padded)), 1 << 20, dtype=np.int64)])
    for i, c in enumerate(pattern.tolist()):
        # lane j of row i stands for position i + lo + j of the text
        put = cost + (padded[i : i + w] != c)
        drop = np.concatenate([cost[1:], [far]]) + 1
        take = drop < put
        new = np.where(take, drop, put)
        src = np.where(take, np.concatenate([origin[1:], [0]]), origin)
        # insertions run along the row: prefix minimum of cost - lane
        slid = new - lane
        low = np.minimum.accumulate(slid)
        pick = np.maximum.accumulate(np.where(slid == low, lane, 0))
        cost, origin = low + lane, src[pick]
        if cost.min() > most:
            return None
    ends = lane + lo + len(pattern)
    cost = np.where((ends >= 0) & (ends <= len(codes)), cost, far)
    j = int(cost.argmin())
    return (int(max(origin[j], 0)), int(ends[j]), int(cost[j])) if cost[j] <= most else None


def portions(benchmark: DataFrame, key: str, most: int = PORTION) -> Iterator[list[tuple[int, str]]]:
    """The items in portions of about ``most`` characters."""
    items = benchmark.where(F.col(key).isNotNull() & (F.length("text") > 0)).select(F.col(key).cast("long").alias("item"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-size // most)
    for k in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()]


def find(docs: DataFrame, benchmark: DataFrame, key: str = "item_id", portion: int = PORTION) -> DataFrame:
    """doc_id, item_id, start, end, edits: one row per document and item found in
    it, with the region (code points) of its best pattern."""
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def one(items: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Patterns(items))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            patterns = shared.value
            for batch in batches:
                out = [(i, *f) for i, t in zip(batch["doc_id"], batch["text"], strict=True) for f in located(patterns, t)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "start", "end", "edits"])

        return texts.mapInPandas(run, "doc_id long, item_id long, start int, `end` int, edits int")

    found = total(one(items) for items in portions(benchmark, key, portion))
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, start int, `end` int, edits int")
    return found.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start", "end")).alias("f")).select("doc_id", "item_id", "f.start", "f.end", "f.edits")


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a passage of the benchmark."""
    found = saved(find(docs, benchmark, **options).select("doc_id").distinct(), "leaks")
    return restrict(docs, found, "left_anti").select(docs.columns)
