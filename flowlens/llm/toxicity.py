"""Toxicity scores from a lexicon, misspellings included (operator 2).

Learning, on a bounded sample of labelled rows (``SAMPLE``): words are counted by label,
and those whose share of toxic documents, drawn towards the overall share by ``PULL``
documents, is high enough make up the lexicon with their log odds as weight. All of it
becomes one trie; a Levenshtein automaton runs over all terms at once (its states are
sets of trie node and edits, built on demand), so a word is matched in time linear in its
length, within the edits that its term's length allows (``edits_for``).

What an edited match is worth the sample says too. Every word of the sample that the
automaton matches with edits has a record of its own (toxic and clean documents), every
term has one of its near misses by edits, and all terms together have one by edits; each
is drawn towards the next by ``PULL`` documents, the last one towards a part of the
term's own weight, the smaller the more edits. So a near miss that clean documents use
weighs nothing, one that only toxic documents use weighs much, and one that the sample
never had weighs what its term's other near misses do.

Each match is scored in its context window: inside quotation marks, or near words that
report speech, it counts as quotation, else as abuse. A logistic model on the summed
weights of abusive terms, of misspellings that the sample has, of other misspellings and
of quoted matches, each word once, gives the score; its weights start where ``START`` says and are fitted with each document's own counts taken
out of every record. For the fit alone sums are rounded to a tenth, so that documents that
look alike are counted together.

Defined results: null and empty texts score like a text without matches; texts of any
length are matched whole; without labels of both kinds every score is the share of
toxic labels (0 if there are none); of repeated labels for a doc_id the largest
counts, of equal texts one teaches; a word that fits several terms alike takes the
first by name; rows are independent, so repeated rows give repeated results and an
empty table an empty one; a null doc_id is scored, and not held out; a label without
document teaches nothing. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import restrict, saved, small_batches

#: Labelled documents that are learned from, at most (about).
SAMPLE = 30_000
#: Documents that draw a record to the one above it; log odds a term needs; toxic
#: documents a term needs.
PULL, LEAST, SUPPORT = 5.0, 1.5, 3
#: Weights of abusive terms, misspellings of the sample, others, and quoted matches before learning.
START = (1.0, 1.0, 0.5, 0.1)
#: Words to either side that make up the context window.
WINDOW = 6
WORD = re.compile(r"[^\W_]+")
#: Digits and signs often written for letters.
LOOKS_LIKE = str.maketrans("013457", "oieast")
#: Words that report speech.
REPORTING = frozenset("said says say called calls quote quoted quotes quoting wrote writes word words term reported reports alleged allegedly insult insults slur dijo dice dit disait sagte sagt".split())
QUOTES = "\"“”«»„‟‘"


def plain(word: str) -> str:
    word = word.lower()
    return word.translate(LOOKS_LIKE) if not word.isalpha() and any(c.isalpha() for c in word) else word


def edits_for(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """All terms' Levenshtein automata in one, over the lexicon's trie: whole words match
    within the edits that their length allows."""

    def __init__(self, words: Iterable[str], edits: Callable[[str], int] = edits_for):
        self.next: list[dict[str, int]] = [{}]
        self.word: dict[int, str] = {}
        self.most = [0]
        self.edits = {w: edits(w) for w in words}
        for term, k in self.edits.items():
            node = 0
            self.most[0] = max(self.most[0], k)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.most.append(0)
                node = self.next[node][c]
                self.most[node] = max(self.most[node], k)
            self.word[node] = term
        self.reset()

    def reset(self) -> None:
        """States by number; 0 is the one that nothing matches from."""
        self.ids: dict[tuple, int] = {(): 0}
        self.states: list[dict[int, int]] = [{}]
        self.moves: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[str, int]]] = [[]]
        self.start = self.number({0: 0})

    def number(self, state: dict[int, int]) -> int:
        todo = list(state)
        while todo:  # letters of the term that the word leaves out
            node = todo.pop()
            for child in self.next[node].values():
                e = state[node] + 1
                if e <= self.most[child] and e < state.get(child, 99):
                    state[child] = e
                    todo.append(child)
        key = tuple(sorted(state.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            self.ends.append([(w, e) for n, e in state.items() if (w := self.word.get(n)) is not None and e <= self.edits[w]])
        return self.ids[key]

    def move(self, at: int, c: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.states[at].items():
            if e < self.most[node] and e + 1 < out.get(node, 99):
                out[node] = e + 1
            for letter, child in self.next[node].items():
                k = e + (letter != c)
                if k <= self.most[child] and k < out.get(child, 99):
                    out[child] = k
        self.moves[at][c] = self.number(out)
        return self.moves[at][c]

    def fits(self, word: str) -> list[tuple[str, int]]:
        """(term, edits) of the terms that match."""
        if len(self.states) > 50_000:
            self.reset()
        at, moves = self.start, self.moves
        for c in word:
            step = moves[at]
            at = step[c] if c in step else self.move(at, c)
            if not at:
                return []
        return self.ends[at]

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the closest term, or None."""
        return min(self.fits(word), key=lambda f: (f[1], f[0]), default=None)


def logit(p: float) -> float:
    return math.log(p / (1 - p))


Record = tuple[int, int]


@dataclass
class Model:
    """Toxic and clean documents: of each term, of each near miss, of a term's near misses by
    edits, and of all near misses by edits."""

    terms: dict[str, Record] = field(default_factory=dict)
    slips: dict[str, Record] = field(default_factory=dict)
    near: dict[tuple[str, int], Record] = field(default_factory=dict)
    all_near: dict[int, Record] = field(default_factory=dict)
    base: float = 0.0
    weights: np.ndarray | None = None
    misspellings: bool = True

    def weight(self, term: str, edits: int = 0, word: str = "", own: Record = (0, 0)) -> float:
        """Log odds of a match above the base, less an allowance for few documents, with
        some documents taken out."""
        share, allowed = self.base, 0.0
        if edits:
            share = 1 / (1 + math.exp(-logit(self.base) - self.weight(term) / (1 + edits)))
        for record in [self.all_near.get(edits), self.near.get((term, edits)), self.slips.get(word)] if edits else [self.terms.get(term)]:
            t, c = (max(0, n - k) for n, k in zip(record or (0, 0), own, strict=True))
            if t + c:
                share, allowed = (t + PULL * share) / (t + c + PULL), 1 / math.sqrt(t) if t else math.inf
        return max(0.0, logit(share) - logit(self.base) - allowed)


class Matcher:
    """Finds matches in texts; what is known of a word is kept up to a fixed number."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most
        self.automaton = Automaton(model.terms, edits_for if model.misspellings else lambda _: 0)
        self.known: set[str] = set()
        self.hit: dict[str, tuple[str, int]] = {}

    def look_up(self, word: str) -> tuple[str, int] | None:
        """The term whose match weighs most for a word, if it weighs anything."""
        word = plain(word)
        if not (fits := self.automaton.fits(word)):
            return None
        best = min((f for t, e in fits if (f := (-self.model.weight(t, e, word), e, t))[0] < 0), default=None)
        return best and (best[2], best[1])

    def matches(self, text: str | None) -> list[tuple[int, int, str, int, bool]]:
        """(start, end, term, edits, quoted) of every match."""
        if not text or not self.model.terms:
            return []
        words = WORD.findall(text)
        own = set(words)
        new = own - self.known
        if new:
            if len(self.known) > self.most:
                self.known.clear()
                self.hit.clear()
                new = own
            for w in new:
                if found := self.look_up(w):
                    self.hit[w] = found
            self.known |= new
        if own.isdisjoint(self.hit):
            return []
        hits = [i for i, w in enumerate(words) if w in self.hit]
        spans = list(WORD.finditer(text))
        return [(spans[i].start(), spans[i].end(), *self.hit[words[i]], self.quoted(text, spans, i)) for i in hits]

    @staticmethod
    def quoted(text: str, spans: list[re.Match], i: int) -> bool:
        lo, hi = spans[max(0, i - WINDOW)].start(), spans[min(len(spans) - 1, i + WINDOW)].end()
        before, after = text[lo : spans[i].start()], text[spans[i].end() : hi]
        if any(c in QUOTES for c in before) and any(c in QUOTES for c in after):
            return True
        near = (m[0].lower() for m in spans[max(0, i - WINDOW) : i + 1 + WINDOW // 2])
        return not REPORTING.isdisjoint(near)


def features(model: Model, text: str | None, found: list[tuple[int, int, str, int, bool]], own: Record = (0, 0)) -> list[float]:
    """One, and the summed weights of abusive terms, of misspellings that the sample has, of
    other misspellings, and of quoted matches; each word counts once in each of them."""
    best: dict[tuple[int, str], float] = {}
    for start, end, term, e, quoted in found:
        word = plain(text[start:end])
        t, c = model.slips.get(word, (0, 0))
        kind = 3 if quoted else 0 if not e else 1 if t > own[0] or c > own[1] else 2
        best[kind, word] = max(best.get((kind, word), 0.0), model.weight(term, e, word, own))
    sums = [0.0] * 4
    for (kind, _), w in best.items():
        sums[kind] += w
    return [1.0, *sums]


def fit_logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Newton steps; weights are drawn towards where they start."""
    w, keep = start.copy(), np.eye(x.shape[1]) * ridge

    def cost(v: np.ndarray) -> float:
        z = x @ v
        return float((np.logaddexp(0, z) - y * z).sum() + (v - start) @ keep @ (v - start) / 2)

    now = cost(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ (w - start))
        size = 1.0
        while (new := cost(w + size * step)) > now and size > 1e-6:
            size /= 2
        if new >= now:
            break
        w, now = w + size * step, new
    return w


def terms_of(text: str) -> set[str]:
    return {w for w in map(plain, set(WORD.findall(text))) if len(w) > 2}


def as_record(row: Row) -> Record:
    return row["toxic"], row["clean"]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    small_batches(docs.sparkSession)
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("mark"))
    n = marks.count()
    if n > sample:
        marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id").where("text IS NOT NULL")
    # of equal texts one is learned from
    one = texts.groupBy(F.xxhash64("text").alias("k"), "mark").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    texts = saved(restrict(texts, one, "left_semi").select("mark", "text"), "labelled")
    sizes = {r["mark"]: r["count"] for r in texts.groupBy("mark").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model(base=float(toxic > 0))
    base = toxic / (toxic + clean)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = {0: Counter(), 1: Counter()}
            for mark, text in zip(batch["mark"], batch["text"], strict=True):
                seen[mark].update(terms_of(text))
            if keys := list(seen[0] | seen[1]):
                yield pd.DataFrame({"term": keys, "toxic": [seen[1][k] for k in keys], "clean": [seen[0][k] for k in keys]})

    words = texts.mapInPandas(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    words = saved(words, "words")
    t, c = F.col("toxic"), F.col("clean")
    odds = F.log((t + PULL * base) / (c + PULL * (1 - base))) - logit(base) - 1 / F.sqrt(t)
    # what is collected is bounded by the sample
    kept = words.where((t >= SUPPORT) & (odds >= LEAST)).orderBy("term").collect()
    model = Model({r["term"]: as_record(r) for r in kept}, base=base)
    names = list(model.terms)

    def misses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The sample's words that match a term with edits."""
        automaton = Automaton(names)
        for batch in batches:
            rows = [(w, term, e, t, c) for w, t, c in zip(batch["term"], batch["toxic"], batch["clean"], strict=True) for term, e in automaton.fits(w) if e]
            if rows:
                yield pd.DataFrame(rows, columns=["word", "term", "edits", "toxic", "clean"])

    close = saved(words.mapInPandas(misses, "word string, term string, edits int, toxic long, clean long"), "misses")
    # a word that is a term itself says nothing about other words near it
    close = close.join(F.broadcast(close.sparkSession.createDataFrame([(n,) for n in names], "word string")), "word", "left_anti")
    total = [F.sum(k).alias(k) for k in ("toxic", "clean")]
    model.slips = {r["word"]: as_record(r) for r in close.select("word", "toxic", "clean").distinct().collect()}
    model.near = {(r["term"], r["edits"]): as_record(r) for r in close.groupBy("term", "edits").agg(*total).collect()}
    model.all_near = {r["edits"]: as_record(r) for r in close.select("word", "edits", "toxic", "clean").distinct().groupBy("edits").agg(*total).collect()}

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(model)
        for batch in batches:
            x = [[round(v, 1) for v in features(model, t, matcher.matches(t), (m, 1 - m))] for m, t in zip(batch["mark"], batch["text"], strict=True)]
            yield pd.DataFrame({"mark": batch["mark"], "x": x})

    # documents with equal features count together, which bounds what is collected
    data = texts.mapInPandas(measure, "mark int, x array<double>").groupBy("mark", "x").count().collect()
    x = np.array([r["x"] for r in data])
    y, k = np.array([float(r["mark"]) for r in data]), np.array([r["count"] for r in data])
    start = np.array([logit(base), *START])
    model.weights = fit_logistic(np.repeat(x, k, axis=0), np.repeat(y, k), start)
    # evidence never speaks against itself
    model.weights[1:] = np.maximum(model.weights[1:], 0.0)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, matches (array of start, end, term, edits, quoted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        matcher = Matcher(model)
        for batch in batches:
            found = [matcher.matches(t) for t in batch["text"]]
            if model.weights is None:
                s = np.full(len(batch), model.base)
            else:
                s = 1 / (1 + np.exp(-np.clip(np.array([features(model, t, f) for t, f in zip(batch["text"], found, strict=True)]) @ model.weights, -30, 30)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": s, "predicted": (s >= 0.5).astype(np.int32), "matches": found})

    small_batches(docs.sparkSession)
    schema = "doc_id long, score double, predicted int, matches array<struct<start:int,`end`:int,term:string,edits:int,quoted:boolean>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels that are not held out, score all documents."""
    return score(docs, fit(docs.where(~held_out()), labels.where(~held_out()))).withColumn("held_out", held_out())
