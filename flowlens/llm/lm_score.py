"""Cross-entropy difference of matched n-gram models (operator 3).

A target and a background bigram model of the same form, over one shared
vocabulary, give each token two losses; a document's score is the mean of
background loss minus target loss, so that text like the target scores high.

Each document is scored with its own counts left out of its corpus's model, so
that the target's documents do not recognise themselves.

p(w | v) = (c(v, w) + MASS * p(w)) / (c(v) + MASS),   p(w) = (c(w) + 1) / (N + V)

V is the number of distinct words of the whole corpus and two (the start of a text
and an unknown word): every word counts for itself. (``most`` makes the commonest
words the vocabulary if a caller asks for that; the others then share one entry.)
All counts cover all documents; a word is known by a 64-bit key.

Three passes read the texts. The first counts all words. The ``COMMON`` commonest
become a table of fixed size that every task holds. The second counts the pairs of
the ``HEAVY`` commonest, another table of fixed size. The third sums what a document
needs from these tables and exchanges the rest, its distinct pairs: a pair whose
second word is common goes where its own key leads, any other pair goes where its
second word leads, so that this word's count comes together with those of its pairs.
No key of the exchange can be hot: a word there has at most 1/COMMON of all tokens,
and of the pairs those of heavy words, the frequent ones, are not exchanged. The
exchange has one bucket for each of its partitions, however many tokens there are: a
batch's pairs for one of them travel as one row of packed arrays, so that a pair costs
the same few bytes at any size, and get one row back. A task holds its bucket's rows as
they are packed, some twelve bytes a pair, and works on finer buckets of about ``BUCKET``
tokens one after the other; spark.sql.shuffle.partitions has to suit the input, as for
any exchange.

Defined results: a text without words (or null) has zero tokens, null losses and
a null score; rows with a repeated doc_id count as one document with their sums
taken together; a null doc_id is dropped; if the target or the background is
empty its model is uniform; an empty table gives an empty result. Texts of any
length are read whole. Other columns of ``docs``, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bounded, saved, small_batches, splitmix
from .tokens import word_keys

HEAVY, COMMON, MASS = 1024, 65_536, 8.0
#: Distinct words that a task keeps between batches; tokens that it scores at once;
#: pairs of one bucket (about).
KNOWN, AT_ONCE, BUCKET = 200_000, 400_000, 250_000
#: Tokens at once for each bucket of the exchange, so that a row stays about 50 KB, and at least.
EACH, LEAST_AT_ONCE = 4_000, 200_000
START = 0


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def vocabulary(texts: DataFrame, most: int) -> list[str]:
    """The commonest words, commonest first; ties by name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Counter()
        for batch in batches:
            for text in batch["text"]:
                found.update(words(text))
            if len(found) > KNOWN:
                yield pd.DataFrame({"word": list(found), "n": list(found.values())})
                found = Counter()
        if found:
            yield pd.DataFrame({"word": list(found), "n": list(found.values())})

    counted = texts.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r[0] for r in counted.orderBy(F.desc("n"), "word").limit(most).select("word").collect()]


class Ids:
    """Word numbers of a closed vocabulary: 0 for the start of a text, 1 for other words."""

    def __init__(self, vocab: list[str]):
        self.of = {w: i + 2 for i, w in enumerate(vocab)}
        self.size = len(vocab) + 2

    def __call__(self, text: str) -> np.ndarray:
        get = self.of.get
        return np.array([START, *(get(w, 1) for w in words(text))], dtype=np.int64)


def reader(ids) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """A function that gives the keys of texts, each led by START, and their numbers."""

    def closed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [ids.value(t) for t in texts]
        return np.concatenate(found), np.array([len(a) for a in found])

    def open_(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = word_keys(texts)
        return np.insert(keys, np.cumsum(counts) - counts, START), counts + 1

    return closed if ids is not None else open_


def sums_by_key(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    names, at = np.unique(keys, return_inverse=True)
    return names, *(np.bincount(at, w, len(names)) for w in weights)


def word_counts(texts: DataFrame, ids) -> DataFrame:
    """(key, b, t): background and target count of every word and of the starts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = reader(ids)
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            return sums_by_key(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for batch in batches:
            if len(batch):
                keys, long = read(batch["text"].tolist())
                t = np.repeat(batch["target"].to_numpy(dtype=float), long)
                held.append(sums_by_key(keys, 1 - t, t))
                if sum(len(h[0]) for h in held) > 4 * KNOWN:
                    held = [merged()]
                    if len(held[0][0]) > KNOWN:
                        yield pd.DataFrame(dict(zip(("key", "b", "t"), held.pop(), strict=True)))
        if held:
            yield pd.DataFrame(dict(zip(("key", "b", "t"), merged(), strict=True)))

    rows = texts.select("target", "text").mapInPandas(run, "key long, b double, t double")
    return rows.groupBy("key").agg(F.sum("b").cast("long").alias("b"), F.sum("t").cast("long").alias("t"))


@dataclass
class Model:
    """Tables of fixed size: ``keys`` of the common words in order, their place among
    the heavy ones (-1: none), their counts and those of pairs of heavy words by
    corpus (0 background, 1 target); all tokens by corpus, size of the vocabulary."""

    keys: np.ndarray
    heavy: np.ndarray
    one: np.ndarray
    whole: tuple[float, float]
    size: int
    mass: float
    two: np.ndarray | None = None

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key in the table of common words, or -1."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    @property
    def side(self) -> int:
        return int(self.heavy.max()) + 1

    def prior(self, c: int, count: np.ndarray, long: np.ndarray) -> np.ndarray:
        return self.mass * (count + 1) / (self.whole[c] - long + self.size)


def common_words(counted: DataFrame, heavy: int, common: int, mass: float, size: int | None) -> Model:
    whole = counted.agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0)), F.count_if(F.col("key") != START)).first()
    top = counted.orderBy(F.col("key") != START, F.desc(F.col("b") + F.col("t")), "key").limit(common).toArrow()  # at most ``common`` rows
    keys = top["key"].to_numpy()
    rank = np.where(np.arange(len(keys)) < heavy, np.arange(len(keys)), -1)
    order = np.argsort(keys)
    one = np.stack([top["b"].to_numpy(), top["t"].to_numpy()]).astype(float)
    return Model(keys[order], rank[order], one[:, order], (float(whole[1]), float(whole[2])), whole[3] + 2 if size is None else size, mass)


def heavy_pairs(texts: DataFrame, ids, model) -> np.ndarray:
    """Counts of the pairs of heavy words by corpus."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, m = reader(ids), model.value
        n = m.side
        two = np.zeros((2, n * n), dtype=np.int64)
        for batch in batches:
            if not len(batch):
                continue
            keys, long = read(batch["text"].tolist())
            at = m.place(keys)
            h = np.where(at >= 0, m.heavy[at], -1)
            doc = np.repeat(np.arange(len(long)), long)
            both = np.flatnonzero((h[:-1] >= 0) & (h[1:] >= 0) & (doc[:-1] == doc[1:]))
            target = batch["target"].to_numpy(dtype=bool)[doc[both]]
            code = h[both] * n + h[both + 1]
            for c in (0, 1):
                names, k = np.unique(code[target == bool(c)], return_counts=True)
                two[c, names] += k
        for c in (0, 1):
            at = np.flatnonzero(two[c])
            yield pd.DataFrame({"c": c, "key": at, "n": two[c][at]})

    rows = texts.select("target", "text").mapInPandas(run, "c int, key long, n long").groupBy("c", "key").agg(F.sum("n").alias("n"))
    got, n = rows.toArrow(), model.value.side  # at most 2 * HEAVY ** 2 rows
    two = np.zeros((2, n * n), dtype=np.float32)
    two[got["c"].to_numpy(), got["key"].to_numpy()] = got["n"].to_numpy()
    return two


#: Arrays of a row: of a batch's pairs for one bucket (documents by their place in the
#: batch, their lengths, negative in the background, light words, those that end a document;
#: pairs under light words, the others), of what the fixed tables give a batch's documents,
#: and of a bucket's reply. "index" is as wide as it needs to be; "rising" numbers are
#: written as their steps, as wide as these need to be.
PAIRS = ("index", "i4", "i8", "i8", "u4", "u2", "rising", "index", "index", "u4", "u2", "u2", "index", "index", "index")
OWN, REPLY = ("i8", "i8", "f4", "f4"), ("index", "f4", "f4")


def narrow(a: np.ndarray) -> np.ndarray:
    most = int(a.max()) if a.size else 0
    return a.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")


def pack(kinds: tuple[str, ...], arrays: Sequence[np.ndarray]) -> bytes:
    """Arrays as one value."""
    out = [np.array([len(a) for a in arrays], dtype=np.int32)]
    for kind, a in zip(kinds, arrays, strict=True):
        out.append(narrow(np.diff(a, prepend=0)) if kind == "rising" else narrow(a) if kind == "index" else a.astype("<" + kind))
    wide = np.array([a.itemsize for a in out[1:]], dtype=np.int8)
    return b"".join([wide.tobytes(), *(a.tobytes() for a in out)])


def unpack(kinds: tuple[str, ...], data: bytes) -> list[np.ndarray]:
    n = len(kinds)
    wide, sizes = np.frombuffer(data, np.int8, n), np.frombuffer(data, np.int32, n, n)
    at, out = n * 5, []
    for kind, w, size in zip(kinds, wide, sizes, strict=True):
        a = np.frombuffer(data, f"<u{w}" if kind in ("index", "rising") else "<" + kind, size, at)
        a = a.astype(np.float64 if kind == "f4" else np.int64)
        out.append(np.cumsum(a) if kind == "rising" else a)
        at += int(w) * int(size)
    return out


def finer(key: np.ndarray, parts: int) -> np.ndarray:
    """The finer bucket of keys, by bits that the exchange has not used."""
    return (splitmix(key.astype(np.int64).view(np.uint64) ^ np.uint64(0x5BD1E995)) % np.uint64(parts)).astype(np.int64)


def split(data: bytes, parts: int) -> list[tuple[int, bytes]]:
    """The rows of the finer buckets that a row of pairs holds."""
    docs, signed, closing, lights, *light, klo, khi, w, place, n, o = unpack(PAIRS, data)
    lo, hi, which, where, times = light
    of_light, of_far = finer(lights, parts), finer(klo | khi << 32, parts)
    shut_doc, shut_word = (closing // len(lights), closing % len(lights)) if len(closing) else (closing, closing)
    out = []
    for k in range(parts):
        s, f, own = np.flatnonzero(of_light[which] == k), np.flatnonzero(of_far == k), np.flatnonzero(of_light == k)
        if not len(s) + len(f):
            continue
        at = np.unique(np.concatenate([where[s], place[f]]))
        c = np.flatnonzero(of_light[shut_word] == k)
        ends = np.searchsorted(at, shut_doc[c]) * len(own) + np.searchsorted(own, shut_word[c])
        out.append((k, pack(PAIRS, [
            docs[at], signed[at], np.sort(ends), lights[own], lo[s], hi[s], np.searchsorted(own, which[s]), np.searchsorted(at, where[s]), times[s],
            klo[f], khi[f], w[f], np.searchsorted(at, place[f]), n[f], o[f],
        ])))
    return out


def summed(data: Sequence[bytes]) -> bytes:
    """Replies to one batch, added up."""
    place, t, b = (np.concatenate(x) for x in zip(*(unpack(REPLY, d) for d in data), strict=True))
    at, where = np.unique(place, return_inverse=True)
    return pack(REPLY, [at, np.bincount(where, t, len(at)), np.bincount(where, b, len(at))])


def exchange(texts: DataFrame, ids, model, buckets: int) -> DataFrame:
    """(batch, bucket, data): a batch's pairs for a bucket, or (bucket null) what the
    fixed tables give of its documents' losses."""

    def pieces(batch: int, m: Model, i: np.ndarray, mark: np.ndarray, keys: np.ndarray, long: np.ndarray) -> Iterator[pd.DataFrame]:
        u, a = np.unique(keys, return_inverse=True)
        at, wide = m.place(u), len(u)
        h, known = np.where(at >= 0, m.heavy[at], -1), at >= 0
        d = np.repeat(np.arange(len(long)), long)
        ends = np.cumsum(long) - 1
        names, own = np.unique(d * wide + a, return_counts=True)
        lead = own.copy()  # how often each word of a document is the first of a pair
        lead[np.searchsorted(names, np.arange(len(long)) * wide + a[ends])] -= 1
        inner = np.delete(np.arange(len(a)), ends)
        pairs, n = np.unique((d[inner] * wide + a[inner]) * wide + a[inner + 1], return_counts=True)
        dv, w = pairs // wide, pairs % wide
        d, v = dv // wide, dv % wide
        o = own[np.searchsorted(names, d * wide + w)]
        light = ~known[w]
        far = ~light & ~((h[v] >= 0) & (h[w] >= 0))
        near = ~light & ~far
        nd, nw = names // wide, names % wide
        under = known[nw] & (lead > 0)
        sums = []
        for c in (0, 1):
            mine = (mark == bool(c)).astype(float)
            p = m.prior(c, m.one[c][at[w[near]]] - mine[d[near]] * o[near], mine[d[near]] * long[d[near]])
            loss = -n[near] * np.log(m.two[c][h[v[near]] * m.side + h[w[near]]] - mine[d[near]] * n[near] + p)
            first = lead[under] * np.log(m.one[c][at[nw[under]]] - mine[nd[under]] * own[under] + m.mass)
            sums.append(np.bincount(d[near], loss, len(long)) + np.bincount(nd[under], first, len(long)))
        rows: list[tuple] = [(batch, None, pack(OWN, [i, long - 1, sums[1], sums[0]]))]

        pair = splitmix(u[v].view(np.uint64) ^ splitmix(u[w].view(np.uint64) + np.uint64(17)))
        key = np.stack([pair & np.uint64(0xFFFFFFFF), (pair >> np.uint64(32)) & np.uint64(0xFFFF)])  # within a bucket 48 bits do
        last = (w == a[ends][d]) & light
        goes = splitmix(np.where(light, u[w].view(np.uint64), pair)) % np.uint64(buckets)
        goes = goes.astype(np.int64)
        rest = np.flatnonzero(light | far)
        rest = rest[np.lexsort((w[rest], ~light[rest], goes[rest]))]
        signed = np.where(mark, long, -long)
        cuts = np.flatnonzero(np.diff(goes[rest], prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            r = rest[lo:hi]
            docs, place = np.unique(d[r], return_inverse=True)
            low = light[r]
            s, f = r[low], r[~low]
            lights, which = np.unique(w[s], return_inverse=True)
            closing = np.flatnonzero(last[s])
            rows.append((batch, int(goes[r[0]]), pack(PAIRS, [
                docs, signed[docs], np.unique(place[low][closing] * len(lights) + which[closing]) if len(closing) else closing,
                u[lights], *key[:, s], which, place[low], n[s], *key[:, f], at[w[f]], place[~low], n[f], o[f],
            ])))
        yield pd.DataFrame(rows, columns=["batch", "bucket", "data"]).astype({"bucket": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, m = reader(ids), model.value
        held: list[tuple] = []
        most = min(AT_ONCE, max(LEAST_AT_ONCE, EACH * buckets))
        numbers = count(TaskContext.get().partitionId() << 32)

        def done() -> Iterator[pd.DataFrame]:
            yield from pieces(next(numbers), m, *(np.concatenate(x) for x in zip(*held, strict=True)))

        for batch in batches:
            if len(batch):
                held.append((batch["doc_id"].to_numpy(dtype=np.int64), batch["target"].to_numpy(dtype=bool), *read(batch["text"].tolist())))
                if sum(len(h[2]) for h in held) > most:
                    yield from done()
                    held = []
        if held:
            yield from done()

    return texts.select("doc_id", "target", "text").mapInPandas(run, "batch long, bucket long, data binary")


def replies(m: Model, batches: list[int], data: list[bytes]) -> pd.DataFrame:
    """What the pairs of one bucket add to the losses of each batch's documents."""
    parts = [unpack(PAIRS, x) for x in data]
    at = np.cumsum([0, *(len(p[0]) for p in parts)])
    words_at = np.cumsum([0, *(len(p[3]) for p in parts)])
    signed, lights = (np.concatenate([p[j] for p in parts]) for j in (1, 3))
    long, mark, size = np.abs(signed), signed > 0, len(signed)  # a document counts once for each batch
    loss = {0: np.zeros(size), 1: np.zeros(size)}

    def joined(j: int, by: np.ndarray | None = None) -> np.ndarray:
        return np.concatenate([p[j] + (0 if by is None else by[k]) for k, p in enumerate(parts)])

    def pair_counts(key: np.ndarray, n: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        where = np.unique(key, return_inverse=True)[1]
        return [np.bincount(where, n * (mark[d] == bool(c)))[where] if len(where) else where for c in (0, 1)]

    # under light words: their own counts come from their pairs
    key, d, n = joined(4) | joined(5) << 32, joined(7, at), joined(8)
    number = np.unique(lights, return_inverse=True)[1]
    word = number[joined(6, words_at)]
    pairs = pair_counts(key, n, d)
    places, where = np.unique(word * size + d, return_inverse=True)
    own = np.bincount(where, n, len(places))
    pw, pd_ = places // max(size, 1), places % max(size, 1)
    shut = np.zeros(len(places))
    for k, p in enumerate(parts):
        if len(p[2]):
            last_doc, last_word = p[2] // len(p[3]) + at[k], p[2] % len(p[3]) + words_at[k]
            shut[np.searchsorted(places, number[last_word] * size + last_doc)] = 1
    for c in (0, 1):
        mine = (mark == bool(c)).astype(float)
        count = np.bincount(pw, own * mine[pd_], int(pw.max()) + 1 if len(pw) else 0)
        prior = m.prior(c, count[word] - mine[d] * own[where], mine[d] * long[d])
        loss[c] += np.bincount(d, -n * np.log(pairs[c] - mine[d] * n + prior), size)
        loss[c] += np.bincount(pd_, (own - shut) * np.log(count[pw] - mine[pd_] * own + m.mass), size)
    # under their own keys: the second word is in the table
    key, w, d, n, o = joined(9) | joined(10) << 32, joined(11), joined(12, at), joined(13), joined(14)
    pairs = pair_counts(key, n, d)
    for c in (0, 1):
        mine = (mark == bool(c)).astype(float)
        prior = m.prior(c, m.one[c][w] - mine[d] * o, mine[d] * long[d])
        loss[c] += np.bincount(d, -n * np.log(pairs[c] - mine[d] * n + prior), size)
    out = [pack(REPLY, [p[0], loss[1][lo:hi], loss[0][lo:hi]]) for p, lo, hi in zip(parts, at[:-1], at[1:], strict=True)]
    return pd.DataFrame({"batch": batches, "first": False, "data": out})


def score(docs: DataFrame, target: DataFrame, most: int | None = None, heavy: int = HEAVY, mass: float = MASS, common: int = COMMON, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score. ``target`` lists the
    doc_ids of the target corpus; all other documents are the background."""
    spark = docs.sparkSession
    small_batches(spark)
    marks = target.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("target", F.lit(True))
    texts = (
        docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(bounded(marks), "doc_id", "left")
        .withColumn("target", F.coalesce("target", F.lit(False)))
    )
    ids, size = None, None
    if most is not None:
        known = Ids(vocabulary(texts, most))
        ids, size = spark.sparkContext.broadcast(known), known.size
    counted = saved(word_counts(texts, ids), "words")
    m = common_words(counted, heavy, min(common, 65_536), mass, size)
    everyone = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    if not len(m.keys):
        return everyone.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), *(F.lit(None).cast("double").alias(c) for c in ("loss_target", "loss_background", "score")))
    m.two = heavy_pairs(texts, ids, spark.sparkContext.broadcast(m))
    model = spark.sparkContext.broadcast(m)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, int(np.ceil(sum(m.whole) / (bucket * buckets))))
    rows = exchange(texts, ids, model, buckets)

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows of a bucket, held as they are packed, split into finer ones that are
        worked on one after the other; a batch gets one row back."""
        held: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            own = batch["bucket"].isna()
            if own.any():
                yield batch.loc[own, ["batch", "data"]].assign(first=True)
            for name, data in batch.loc[~own, ["batch", "data"]].itertuples(index=False, name=None):
                for k, part in split(data, parts) if parts > 1 else [(0, data)]:
                    held.setdefault(k, []).append((name, part))
        back: dict[int, list[bytes]] = {}
        for k in sorted(held):
            out = replies(model.value, *map(list, zip(*held.pop(k), strict=True)))
            for name, data in zip(out["batch"], out["data"], strict=True):
                mine = back.setdefault(name, [])
                mine.append(data)
                if len(mine) > 4:
                    back[name] = [summed(mine)]
        for name in list(back):
            yield pd.DataFrame({"batch": [name], "first": False, "data": [summed(back.pop(name))]})

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a batch follow each other, what the fixed tables gave first."""
        at, out = None, None
        for batch in batches:
            for name, data in batch[["batch", "data"]].itertuples(index=False, name=None):
                if name != at:
                    if out:
                        yield pd.DataFrame(out)
                    at, out = name, dict(zip(("doc_id", "n", "t", "b"), unpack(OWN, data), strict=True))
                else:
                    place, t, b = unpack(REPLY, data)
                    out["t"][place] += t
                    out["b"][place] += b
        if out:
            yield pd.DataFrame(out)

    # rows without a bucket need no place of their own: any will do
    dealt = rows.repartitionById(buckets, F.coalesce("bucket", F.col("batch") % buckets).cast("int"))
    back = dealt.mapInPandas(answer, "batch long, first boolean, data binary")
    back = back.repartition("batch").sortWithinPartitions("batch", F.desc("first"))
    sums = back.mapInPandas(gather, "doc_id long, n long, t double, b double").groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.sum("t").alias("t"), F.sum("b").alias("b"))
    per = lambda c: F.when(F.col("n_tokens") > 0, c / F.col("n_tokens"))
    return everyone.join(sums, "doc_id", "left").select(
        "doc_id",
        F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"),
        per(F.col("t")).alias("loss_target"),
        per(F.col("b")).alias("loss_background"),
        per(F.col("b") - F.col("t")).alias("score"),
    )
