"""Quality scores from hashed word n-grams (operator 11).

A text is a row of tokens: words (letters, marks and digits of any script, with their
case) and runs of signs. Features are hashed to ``SPACE`` places: single words and pairs
of neighbours, and pairs and triples of shapes. A word's shape says whether it is in
capitals, begins with one, has digits and repeats the word before it; a run of signs is
its own shape. Shapes are what n-grams of words that no labelled text has still share.
A feature's value is the square root of its share among the n-grams of its kind, so that
values do not grow with the length of a text.

Logistic regression is trained with follow-the-regularised-leader updates (per-place
rates, L1 and L2), one labelled document after the other, on at most about ``SAMPLE``
labelled documents, half of them of each label where there are as many, each standing
for as many as its label has. The sample is dealt over ``SHARDS`` parts; each part
updates its own copy, the copies are averaged, and ``ROUNDS`` times so. Scores are sparse
dot products over whole texts of all documents.

Defined results: null and empty texts have no feature and score the bias alone; texts of
any length are read whole; without labels of both kinds every score is the share of label
1 (0 if there are none); of repeated labels for a doc_id the largest counts, of equal
texts with equal labels one teaches; a null doc_id is scored and not held out; rows are
independent, so repeated rows give repeated results and an empty table an empty one; a
label without document teaches nothing. Columns other than doc_id, text and quality are
not read, and no label, lang, source or doc_id enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, discard, restrict, saved, small_batches, splitmix

#: Labelled documents that are learned from, at most (about).
SAMPLE = 8_000
#: Places of features; parts and rounds of the training.
SPACE, SHARDS, ROUNDS = 1 << 18, 8, 4
#: Rate, its offset, and the weights of L1 and L2 in the updates.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: Scores from here on are predicted 1.
ACCEPT = 0.3
#: Characters whose tokens are found at once (about).
SPAN = 500_000
_TURNS = 1 << 16


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point its kind (0 blank, 1 sign, 2 word, +4 capital, +8 digit) and a number; a factor for each place."""
    kind = np.ones(0x110000, dtype=np.uint8)
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
        text = "".join(map(chr, range(lo, hi)))
        for m in WORD.finditer(text):
            kind[lo + m.start() : lo + m.end()] = 2
        for i, c in enumerate(text):
            if c.isspace() or c == "\0":
                kind[lo + i] = 0
            elif c.isupper():
                kind[lo + i] |= 4
            elif c.isdigit():
                kind[lo + i] |= 8
    return kind, splitmix(np.arange(0x110000, dtype=np.uint64)), splitmix(np.arange(_TURNS, dtype=np.uint64) + np.uint64(1 << 41)) | np.uint64(1)


def tokens(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Key and shape of each token."""
    kinds, number, factor = _tables()
    keys, shapes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    at = 0
    while at < len(text):
        end = min(at + SPAN, len(text))
        while end < len(text) and not text[end - 1].isspace():
            end += 1
        codes = np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = end
        kind = kinds[codes]
        base = kind & 3
        starts = np.concatenate([[0], np.flatnonzero(base[1:] != base[:-1]) + 1])
        long = np.diff(np.append(starts, len(codes)))
        place = np.arange(len(codes)) - np.repeat(starts, long)
        with np.errstate(over="ignore"):
            key = splitmix(np.add.reduceat(number[codes] * factor[place & (_TURNS - 1)], starts) + long.astype(np.uint64))
        capitals = np.add.reduceat((kind & 4) > 0, starts, dtype=np.int64)
        form = np.where(capitals == 0, 0, np.where((capitals == long) & (long > 1), 1, np.where((kind[starts] & 4) > 0, 2, 3)))
        form += 4 * (np.add.reduceat((kind & 8) > 0, starts, dtype=np.int64) > 0)
        own = base[starts] > 0
        word = base[starts] == 2
        keys.append(key[own])
        shapes.append(np.where(word, form.astype(np.uint64), key | np.uint64(64))[own])
    keys, shapes = np.concatenate(keys), np.concatenate(shapes)
    words = np.flatnonzero(shapes < 64)
    again = words[1:][keys[words[1:]] == keys[words[:-1]]]
    shapes[again] += np.uint64(16)
    return keys, shapes


def grams(parts: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Places of the n-grams of a row of keys."""
    if len(parts) < n:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        key = np.full(len(parts) - n + 1, salt, np.uint64)
        for i in range(n):
            key = splitmix(key * np.uint64(0x9E3779B97F4A7C15) + parts[i : len(parts) - n + 1 + i])
    return (key >> np.uint64(44)).astype(np.int64) % SPACE


def features(text: str | None, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text, or of those of its places for which ``only`` holds;
    a place occurs once for each kind of n-gram that is hashed to it."""
    places, values = [np.zeros(0, np.int64)], [np.zeros(0)]
    keys, shapes = tokens(text or "")
    for salt, (parts, n) in enumerate(((keys, 1), (keys, 2), (shapes, 2), (shapes, 3))):
        found = grams(parts, n, salt + 1)
        place, times = np.unique(found if only is None else found[only[found]], return_counts=True)
        places.append(place)
        values.append(np.sqrt(times / max(1, len(found))))
    return np.concatenate(places).astype(np.int32), np.concatenate(values).astype(np.float32)


class Learner:
    """Follow the regularised leader, place by place; the last place is the bias, which is not regularised."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z = np.zeros(SPACE + 1) if z is None else z.copy()
        self.n = np.zeros(SPACE + 1) if n is None else n.copy()

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        free = np.where(np.arange(SPACE + 1)[at] == SPACE, 0.0, 1.0)
        w = -(z - np.sign(z) * L1 * free) / ((BETA + np.sqrt(n)) / ALPHA + L2 * free)
        return np.where(np.abs(z) <= L1 * free, 0.0, w)

    def learn(self, places: np.ndarray, values: np.ndarray, label: float, weight: float) -> None:
        at, inverse = np.unique(places, return_inverse=True)
        x = np.append(np.bincount(inverse, values, len(at)), 1.0)
        at = np.append(at, SPACE)
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


@dataclass
class Model:
    share: float
    weights: np.ndarray | None = None

    @cached_property
    def counts(self) -> np.ndarray:
        return self.weights != 0

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.share
        places, values = features(text, self.counts)
        return float(1 / (1 + np.exp(-np.clip(self.weights[places] @ values + self.weights[SPACE], -30, 30))))


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, tuple[int, float]]]:
    """The features of the sample (shard, turn, mark, places, values); how many documents of
    each label it has, and how many labels each of them stands for."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("mark"))
    sizes = {r["mark"]: r["count"] for r in marks.groupBy("mark").count().collect()}
    few = min(sizes.values(), default=0)
    room = {m: max(sample // 2, sample - few) for m in sizes} if few < sample // 2 else {m: sample // 2 for m in sizes}
    part = {m: min(1.0, room[m] / n) for m, n in sizes.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 30))
    chosen = [marks.where((F.col("mark") == m) & (draw < int(p * (1 << 30)))) for m, p in part.items()]
    small = marks.limit(0)
    for c in chosen:
        small = small.union(c)
    # bounded by ``sample``
    texts = saved(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(small), "doc_id").where("text IS NOT NULL"), "texts")
    one = texts.groupBy(F.xxhash64("text").alias("k"), "mark").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places, values = zip(*map(features, batch["text"]), strict=True) if len(batch) else ((), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "mark": batch["mark"], "places": places, "values": values})

    turn = F.xxhash64("doc_id", F.lit(37))
    found = restrict(texts, one, "left_semi").mapInPandas(measure, "doc_id long, mark int, places array<int>, values array<float>")
    found = saved(found.select(F.pmod(turn, F.lit(SHARDS)).cast("int").alias("shard"), turn.alias("turn"), "mark", "places", "values"), "labelled")
    discard(texts)
    have = {r["mark"]: r["count"] for r in found.groupBy("mark").count().collect()}
    return found, {m: (k, sizes[m] / k) for m, k in have.items()}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    small_batches(spark)
    found, have = labelled(docs, labels, sample)
    ones, noughts = (k * each for k, each in (have.get(m, (0, 0.0)) for m in (1, 0)))
    share = ones / (ones + noughts) if ones + noughts else 0.0
    if not ones or not noughts:
        return Model(share)
    mean = (ones + noughts) / sum(k for k, _ in have.values())
    weight = {m: each / mean for m, (_, each) in have.items()}
    dealt = found.repartition(SHARDS, "shard").sortWithinPartitions("shard", "turn")
    z, n = np.zeros(SPACE + 1), np.zeros(SPACE + 1)
    for _ in range(ROUNDS):
        z, n = average(spark, dealt, z, n, weight)
    return Model(share, Learner(z, n).weights())


def average(spark: SparkSession, dealt: DataFrame, z: np.ndarray, n: np.ndarray, weight: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """One round: every part goes on from the common state with its own documents; then their mean."""
    state = spark.sparkContext.broadcast((z, n))

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, learner = None, None

        def out() -> pd.DataFrame:
            at = np.flatnonzero((learner.z != state.value[0]) | (learner.n != state.value[1]))
            return pd.DataFrame({"place": at, "z": learner.z[at] - state.value[0][at], "n": learner.n[at] - state.value[1][at]})

        for batch in batches:
            for shard, mark, places, values in zip(batch["shard"], batch["mark"], batch["places"], batch["values"], strict=True):
                if shard != now:
                    if learner:
                        yield out()
                    now, learner = shard, Learner(*state.value)
                learner.learn(places, values, float(mark), weight[mark])
        if learner:
            yield out()

    moved = dealt.mapInPandas(train, "place int, z double, n double").groupBy("place").agg(F.sum("z").alias("z"), F.sum("n").alias("n"))
    # bounded by SPACE
    rows = moved.toPandas()
    place = rows["place"].to_numpy()
    z, n = z.copy(), n.copy()
    z[place] += rows["z"].to_numpy() / SHARDS
    n[place] += rows["n"].to_numpy() / SHARDS
    state.unpersist()
    return z, n


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = np.array([shared.value.score(t) for t in batch["text"]], dtype=np.float64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": s, "predicted": (s >= ACCEPT).astype(np.int32)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, score double, predicted int")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels that are not held out, score all documents."""
    return score(docs, fit(docs.where(~held_out()), labels.where(~held_out()))).withColumn("held_out", held_out())
