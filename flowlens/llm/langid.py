"""Language identification with spans (operator 7).

The script of a word (by code point ranges) narrows its candidate languages to
those that use the script in the training texts; within them the word is scored
by character trigrams, and Viterbi over a document's words, with a penalty for
each switch of language, labels the spans of mixed-language text. The document's
language is the one that holds most letters.

The trigram model is fitted on a bounded sample of labelled rows: about ``SAMPLE``
documents of each language, chosen by a hash of doc_id, and ``GRAMS`` trigrams of
each language. Everything else runs over all rows and whole texts.

Defined results: null text, or text without a letter, is ``und`` with score 0;
words in a script that no training text uses count for no language, and a text of
such words only gets the first learned language with score 0; ties go to the
smaller language name; without any training row all texts are ``und``; texts of any
length are labelled whole; rows are independent, so repeated rows give repeated results
and an empty table an empty one, though a row that is repeated among those learned from
counts as often. Columns other than doc_id, text and lang, whatever their names, are not
read; ``keep_identified`` keeps them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import restrict, saved, small_batches

SAMPLE, GRAMS = 3_000, 20_000
SWITCH, FOREIGN, SMOOTH = 12.0, -40.0, 0.1
#: A script counts for a language that writes at least this share of its letters in it.
SCRIPT_SHARE = 0.01
#: Words whose scores are kept; tokens and rows of one Viterbi batch.
KNOWN, TOKENS, ROWS = 150_000, 800_000, 10_000
WORD = re.compile(r"[^\W\d_]+")

#: First code point of ranges and the script written in them (Unicode blocks).
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB10, "other"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"),
    (0x20000, "han"), (0x32000, "other"),
)
STARTS = [s for s, _ in SCRIPTS]


def script(word: str) -> str:
    return SCRIPTS[bisect_right(STARTS, ord(word[0])) - 1][1]


def letters(word: str) -> int:
    return len(word) if word.isalpha() else sum(c.isalpha() for c in word)


def grams(word: str) -> Iterator[str]:
    s = f"^{word.lower()}$"
    return (s[i : i + 3] for i in range(len(s) - 2))


class Model:
    def __init__(self, counts: list[tuple[str, str, int]], scripts: list[tuple[str, str, int]]):
        self.langs = sorted({lang for lang, _, _ in scripts})
        at = {lang: i for i, lang in enumerate(self.langs)}
        n = defaultdict(lambda: np.zeros(len(self.langs)))
        for lang, gram, k in counts:
            n[gram][at[lang]] += k
        total = sum(n.values(), np.zeros(len(self.langs)))
        norm = np.log(total + SMOOTH * max(len(n), 1))
        names = sorted(n)
        at_key = np.array([self.key(*(ord(c) for c in g)) for g in names], dtype=np.int64)
        order = np.argsort(at_key)
        self.keys = at_key[order]
        seen = np.array([n[g] for g in names]).reshape(len(names), len(self.langs))[order]
        self.gram = np.log(np.concatenate([seen, np.zeros((1, len(self.langs)))]) + SMOOTH) - norm  # last: unseen
        share: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(self.langs)))
        for lang, name, k in scripts:
            share[name][at[lang]] += k
        whole = sum(share.values(), np.zeros(len(self.langs)))
        self.uses = {name: v / whole >= SCRIPT_SHARE for name, v in share.items()}

    @staticmethod
    def key(a, b, c):
        return (a << 42) | (b << 21) | c

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: log-likelihoods below the best candidate language,
        FOREIGN for languages that do not use its script, zeros where none does."""
        if not words or not len(self.keys):
            return np.zeros((len(words), len(self.langs)), np.float32)
        padded = [f"^{w.lower()}$" for w in words]
        size = np.array([len(w) for w in padded]) - 2
        c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(size + 2)[:-1]])
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        at = np.arange(int(size.sum())) + np.repeat(first - begin, size)
        key = self.key(c[at], c[at + 1], c[at + 2])
        row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        row = np.where(self.keys[row] == key, row, len(self.keys))
        out = np.add.reduceat(self.gram[row], begin, axis=0)
        none = np.zeros(len(self.langs), dtype=bool)
        uses = np.array([self.uses.get(script(w), none) for w in words])
        best = np.where(uses, out, -np.inf).max(axis=1, keepdims=True)
        return np.where(uses.any(1, keepdims=True), np.where(uses, out - np.where(np.isfinite(best), best, 0), FOREIGN), 0).astype(np.float32)


def viterbi(scores: np.ndarray, tokens: np.ndarray, lens: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every token. ``tokens`` holds the documents one after another
    (rows of ``scores``), ``lens`` their lengths, longest first: each step
    advances all documents that are long enough."""
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
    live = len(lens) - np.searchsorted(lens[::-1], np.arange(int(lens[0])), side="right")
    value = scores[tokens[starts]].copy()
    stay = np.ones((len(tokens), scores.shape[1]), dtype=bool)
    best = np.zeros(len(tokens), dtype=np.int16)
    for t in range(1, int(lens[0])):
        n = live[t]
        v, at = value[:n], starts[:n] + t
        top = v.argmax(1)
        jump = (v[np.arange(n), top] - switch)[:, None]
        keep = v >= jump
        stay[at], best[at] = keep, top
        value[:n] = np.where(keep, v, jump) + scores[tokens[at]]
    path = np.empty(len(tokens), dtype=np.int16)
    state = value.argmax(1)
    for t in range(int(lens[0]) - 1, -1, -1):
        n = live[t]
        at = starts[:n] + t
        path[at] = state[:n]
        if t:
            state[:n] = np.where(stay[at, state[:n]], state[:n], best[at])
    return path


def fit(docs: DataFrame, lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on rows of ``docs`` whose ``lang`` is not null."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    n = known.groupBy("lang").count()
    share = n.select("lang", (F.lit(float(sample)) / F.col("count")).alias("share"))
    u = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.join(F.broadcast(share), "lang").where(u < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words: dict[str, Counter] = defaultdict(Counter)
            for name, text in zip(batch["lang"], batch["text"], strict=True):
                words[name].update(WORD.findall(text or ""))
            for name, found in words.items():
                g, s = Counter(), Counter({"": 0})
                for w, k in found.items():
                    s[script(w)] += k * letters(w)
                    for x in grams(w):
                        g[x] += k
                if g:
                    yield pd.DataFrame({"lang": name, "kind": "g", "key": list(g), "n": list(g.values())})
                yield pd.DataFrame({"lang": name, "kind": "s", "key": list(s), "n": list(s.values())})

    counts = saved(chosen.mapInPandas(count, "lang string, kind string, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "grams")
    w = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= GRAMS)
    rows = top.select("lang", "kind", "key", "n").collect()
    return Model([(r[0], r[2], r[3]) for r in rows if r[1] == "g"], [(r[0], r[2], r[3]) for r in rows if r[1] == "s"])


def label(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score (share of the letters that lie in spans of
    lang_pred, letters of unknown scripts counting for none), spans (array of
    lang, start, end in code points)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        width = max(len(model.langs), 1)
        known_scripts = {name for name, uses in model.uses.items() if uses.any()}
        known: dict[str, int] = {}
        table, sizes = np.zeros((0, len(model.langs)), np.float32), np.zeros((0, 2), np.int64)

        def number(words: list[str]) -> list[int]:
            try:
                return [known[w] for w in words]
            except KeyError:
                return [known.setdefault(w, len(known)) for w in words]

        def grow() -> None:
            """Score the words that are new since the last batch, all at once."""
            nonlocal table, sizes
            new = list(islice(known, len(table), None))
            n = np.array([letters(w) for w in new], dtype=np.int64)
            used = np.array([script(w) in known_scripts for w in new], dtype=bool)
            table = np.concatenate([table, model.scores(new)])
            sizes = np.concatenate([sizes, np.stack([n, n * used], 1)]) if new else sizes

        def forget() -> None:
            nonlocal table, sizes
            if len(known) > KNOWN:
                known.clear()
                table, sizes = table[:0], sizes[:0]

        def flush(ids: list, texts: list, tokens: list[np.ndarray]) -> pd.DataFrame:
            order = sorted((i for i, t in enumerate(tokens) if len(t)), key=lambda i: -len(tokens[i]))
            langs, score, spans = ["und"] * len(ids), [0.0] * len(ids), [[] for _ in ids]
            grow()
            if order and model.langs:
                flat, lens = np.concatenate([tokens[i] for i in order]), np.array([len(tokens[i]) for i in order])
                path = viterbi(table, flat, lens, switch)
                size = sizes[flat]
                doc = np.repeat(np.arange(len(order)), lens)
                held = np.bincount(doc * width + path, weights=size[:, 1], minlength=len(order) * width).reshape(-1, width)
                whole = np.bincount(doc, weights=size[:, 0])
                edge = np.flatnonzero((np.diff(path) != 0) | (np.diff(doc) != 0)) + 1
                first = np.concatenate([[0], edge])
                last = np.concatenate([edge, [len(path)]]) - 1
                by_doc = np.searchsorted(doc[first], np.arange(len(order) + 1))
                starts = np.concatenate([[0], np.cumsum(lens)])
                for k, i in enumerate(order):
                    if not whole[k]:
                        continue
                    top = int(held[k].argmax())
                    langs[i], score[i] = model.langs[top], float(held[k, top] / whole[k])
                    mine = range(by_doc[k], by_doc[k + 1])
                    if len(mine) == 1:
                        a = WORD.search(texts[i]).start()
                        b = len(texts[i]) - re.search(r"[^\W\d_]", texts[i][::-1]).start()
                        spans[i] = [(model.langs[path[starts[k]]], a, b)]
                    else:
                        at = [m.span() for m in WORD.finditer(texts[i])]
                        spans[i] = [(model.langs[path[first[j]]], at[first[j] - starts[k]][0], at[last[j] - starts[k]][1]) for j in mine]
            return pd.DataFrame({"doc_id": ids, "lang_pred": langs, "score": score, "spans": spans})

        ids, texts, tokens, n = [], [], [], 0
        for batch in batches:
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids.append(i)
                texts.append(text or "")
                tokens.append(np.array(number(WORD.findall(text)) if text else [], dtype=np.int32))
                n += len(tokens[-1])
                if n > TOKENS or len(ids) >= ROWS:
                    yield flush(ids, texts, tokens)
                    ids, texts, tokens, n = [], [], [], 0
                    forget()
        if ids:
            yield flush(ids, texts, tokens)

    small_batches(docs.sparkSession)
    schema = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,start:int,`end`:int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows with a doc_id that are not held out, label all rows."""
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return label(docs, model).withColumn("held_out", held_out())


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """``docs`` without the documents that have no letters, or whose best language
    holds less than ``least`` of their letters."""
    found = saved(identify(docs).where((F.col("lang_pred") == "und") | (F.col("score") < least)).select("doc_id"), "rejected")
    return restrict(docs, found, "left_anti").select(docs.columns)
