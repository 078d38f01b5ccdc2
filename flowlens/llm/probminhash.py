"""Near-duplicate documents by ProbMinHash (operator 10).

A document is a weighted set: its shingles of five words, weighted by how often
they occur in it. Similarity is the probability Jaccard of two weighted sets,

    J_P(a, b) = sum over common i of 1 / sum_j max(a_j / a_i, b_j / b_i),

which for sets without repeats is plain Jaccard. Every shingle starts a Poisson
process with its weight as rate; each arrival falls into a random register, a
register keeps the shingle of its earliest arrival, and a process ends as soon as
it is later than all registers of its document. Two documents agree in a register
with probability J_P. Registers are grouped into bands; documents that share a
band are candidates and are verified with exact J_P.

Defined results: case and punctuation are ignored; a text of one to four words is
one shingle; a text without words (null, empty, only signs) has no shingle and is
its own group; rows with a repeated doc_id count as one document (its smallest
text key); a null doc_id is dropped; of documents that meet as many in a bucket the one
with the smaller doc_id is its head; texts of any length are read whole; an empty table
gives an empty one. Columns other than doc_id and text, whatever their names, are not
read; ``keep_one`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, components, restrict, saved, small_batches, splitmix, words_of

SHINGLE, THRESHOLD = 5, 0.8
#: 24 bands of 4: a pair at J_P = 0.8 shares a band with probability 0.999997.
BANDS, ROWS = 24, 4
#: Shingles held at once while arrivals are drawn.
CHUNK = 400_000
#: Documents of one block when what the stars leave apart is compared.
BLOCK = 256
#: Documents that one slot of a bucket's head is compared with (about).
DEAL = 64


class Shingler:
    """Shingle keys of texts; word keys are cached up to a fixed number."""

    def __init__(self, width: int = SHINGLE, most: int = 300_000):
        self.width, self.most, self.known = width, most, {}

    def keys(self, words: list[str]) -> np.ndarray:
        """uint64 key of every shingle in order, repeats included."""
        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            ids = [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            ids = [known[w] for w in words]
        a = np.array(ids, dtype=np.uint64)
        n = len(a) - self.width + 1
        if n < 1:
            parts, n = [a[i : i + 1] for i in range(len(a))], 1
        else:
            parts = [a[i : i + n] for i in range(self.width)]
        out = np.full(n, len(parts), dtype=np.uint64)
        for p in parts:
            out = splitmix(out ^ p)
        return out


def registers(elem: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m winning elements; every document has at least one element."""
    first = np.full(n_docs * m, np.inf)
    won = np.zeros(n_docs * m, dtype=np.uint64)
    late = np.full(n_docs, np.inf)
    time = np.zeros(len(elem))
    turn = 0
    while len(elem):
        r = splitmix(elem ^ splitmix(np.full(1, turn, dtype=np.uint64)))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        live = time < late[doc]
        elem, weight, doc, time, r = elem[live], weight[live], doc[live], time[live], r[live]
        at = doc * m + (splitmix(r) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, time)
        best = first[at] == time
        won[at[best]] = elem[best]
        late = first.reshape(n_docs, m).max(axis=1)
        turn += 1
    return won.reshape(n_docs, m)


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact J_P of two shingle sequences (keys with repeats)."""
    both, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(inverse[: len(a)], minlength=len(both)).astype(float)
    y = np.bincount(inverse[len(a) :], minlength=len(both)).astype(float)
    common = (x > 0) & (y > 0)
    ratio, n = np.unique(np.stack([x[common], y[common]]), axis=1, return_counts=True)
    return float(sum(k / np.maximum(x / p, y / q).sum() for (p, q), k in zip(ratio.T, n, strict=True)))


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_key, bands): bands is empty for texts without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, m = Shingler(), bands * rows
        salt = splitmix(np.arange(bands, dtype=np.uint64))

        def flush(ids, keys, held):
            out = [[] for _ in ids]
            full = [i for i, h in enumerate(held) if h is not None]
            if full:
                doc = np.repeat(np.arange(len(full)), [len(held[i][0]) for i in full])
                elem = np.concatenate([held[i][0] for i in full])
                weight = np.concatenate([held[i][1] for i in full]).astype(float)
                won = registers(elem, weight, doc, len(full), m).reshape(len(full), bands, rows)
                key = np.broadcast_to(salt, won.shape[:2])
                for j in range(rows):
                    key = splitmix(key ^ won[:, :, j])
                for i, k in zip(full, key.view(np.int64), strict=True):
                    out[i] = k
            return pd.DataFrame({"doc_id": ids, "text_key": keys, "bands": out})

        for batch in batches:
            ids, keys, held, n = [], [], [], 0
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = words_of(text)
                ids.append(i)
                if words:
                    keys.append(xxhash.xxh128_hexdigest(" ".join(words)))
                    held.append(np.unique(shingler.keys(words), return_counts=True))
                    n += len(held[-1][0])
                else:
                    keys.append(None)
                    held.append(None)
                if n > CHUNK:
                    yield flush(ids, keys, held)
                    ids, keys, held, n = [], [], [], 0
            if ids:
                yield flush(ids, keys, held)

    small_batches(docs.sparkSession)
    cols = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInPandas(run, "doc_id long, text_key string, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) for each pair of document ids. The pairs of one ``a`` are dealt to
    slots of about ``DEAL``; its text goes once to each of them, ahead of the texts that it
    is compared with, so that neither a frequent ``a`` nor copies of its text meet in a task."""
    slots = F.ceil(F.col("n") / DEAL)
    sized = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("n")), "a")
    dealt = saved(sized.select("a", F.pmod(F.xxhash64("b", F.lit(43)), slots).cast("int").alias("slot"), "b"), "dealt")
    left = dealt.select("a", "slot").distinct().join(texts.toDF("a", "text"), "a").select("a", "slot", F.col("a").alias("b"), F.lit(True).alias("head"), "text")
    right = dealt.join(texts.toDF("b", "text"), "b").select("a", "slot", "b", F.lit(False).alias("head"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, left = Shingler(), None
        for batch in batches:
            out = []
            for a, b, head, text in zip(batch["a"], batch["b"], batch["head"], batch["text"], strict=True):
                keys = shingler.keys(words_of(text))
                if head:
                    left = keys
                else:
                    out.append((a, b, probability_jaccard(left, keys)))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    small_batches(texts.sparkSession)
    rows = left.unionByName(right).repartition("a", "slot").sortWithinPartitions("a", "slot", F.desc("head"))
    return rows.select("a", "b", "head", "text").mapInPandas(run, "a long, b long, similarity double")


def merges(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], left: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links between documents with different labels that join what they connect;
    if ``left`` marks some documents, only pairs of a marked and an unmarked one
    are looked at. Overlaps come from one matrix product over the shingles that
    two documents share at least; for documents without repeated shingles they
    give J_P itself, for others a bound, and exact J_P decides."""
    kinds = [np.unique(k, return_counts=True) for k in sets]
    size = np.array([len(k) for k, _ in kinds], dtype=float)
    plain = np.array([(n == 1).all() for _, n in kinds])
    doc = np.repeat(np.arange(len(ids)), size.astype(int))
    weight = np.concatenate([n / n.sum() for _, n in kinds])
    names, code, df = np.unique(np.concatenate([k for k, _ in kinds]), return_inverse=True, return_counts=True)
    keep = df[code] > 1
    doc, weight, code = doc[keep], weight[keep], (np.cumsum(df > 1) - 1)[code[keep]]
    common, share = np.zeros((len(ids), len(ids)), np.float32), np.zeros((len(ids), len(ids)), np.float32)
    for lo in range(0, int((df > 1).sum()), 4096):
        at = (code >= lo) & (code < lo + 4096)
        x, w = np.zeros((2, len(ids), 4096), np.float32)
        x[doc[at], code[at] - lo] = 1
        w[doc[at], code[at] - lo] = weight[at]
        common += x @ x.T
        share += w @ x.T
    apart = labels[:, None] != labels[None]
    apart &= (left[:, None] & ~left[None]) if left.any() else np.triu(np.ones_like(apart), 1)
    both = plain[:, None] & plain[None]
    sure = apart & both & (common / np.maximum(size[:, None] + size[None] - common, 1) >= threshold - 1e-6)
    maybe = apart & ~both & (np.minimum(share, share.T) >= threshold - 1e-4)
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for hit, known in ((sure, True), (maybe, False)):
        r, c = np.nonzero(hit)
        if known and len(r):  # one pair for each two labels
            _, first = np.unique(np.stack([labels[r], labels[c]], 1), axis=0, return_index=True)
            r, c = r[first], c[first]
        for i, j in zip(r.tolist(), c.tolist(), strict=True):
            u, v = find(int(labels[i])), find(int(labels[j]))
            if u != v and (probability_jaccard(sets[i], sets[j]) >= threshold):
                root[u] = v
                out.append((int(ids[i]), int(ids[j])))
    return out


def residual(members: DataFrame, groups: DataFrame, texts: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Links (src, dst) that join documents which share buckets but are in
    different groups so far. Documents that hang together over such buckets are
    dealt to blocks of bounded size, and every two blocks meet in one task."""
    far = members.join(groups.toDF("doc", "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    apart = far.groupBy("bucket").agg((F.min("component") != F.max("component")).alias("apart"), F.min("doc").alias("first")).where("apart").select("bucket", "first")
    far = saved(far.join(apart, "bucket").select("doc", "component", "first"), "far")
    if far.isEmpty():
        return far.select(F.col("doc").alias("src"), F.col("doc").alias("dst")).limit(0)
    pile = components(far, "doc", "first").toDF("doc", "pile")
    docs = saved(far.select("doc", "component").distinct().join(pile, "doc"), "piles")
    sizes = docs.groupBy("pile").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    docs = docs.join(sizes, "pile").withColumn("slot", F.pmod(F.xxhash64("doc", F.lit(41)), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("slot")).alias("i"), F.greatest(k, F.col("slot")).alias("j")))
    dealt = docs.select("pile", "doc", "component", "slot", F.explode(pairs).alias("at")).join(texts.toDF("doc", "text"), "doc")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc")
        shingler = Shingler()
        sets = [shingler.keys(words_of(t)) for t in rows["text"]]
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        left = ((rows["slot"] == i) & (i != j)).to_numpy()
        found = [] if i != j and (left.all() or not left.any()) else merges(rows["doc"].to_numpy(), rows["component"].to_numpy(), sets, left, threshold)
        return pd.DataFrame(found, columns=["src", "dst"])

    tasks = dealt.select("pile", "at.i", "at.j", "doc", "component", "slot", "text").groupBy("pile", "i", "j")
    return saved(tasks.applyInPandas(run, "src long, dst long"), "rest")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (smallest doc_id with the same words), component_id
    (smallest doc_id reachable over links), kept (doc_id = component_id).

    Equal texts collapse to one representative first, so copies cost one row
    each. Within a band bucket every member is verified against the one that meets
    most documents over all bands, which is linear in the bucket; documents of one
    bucket that this leaves in different groups are then compared in blocks, so no
    link that a bucket holds is lost.
    """
    sketches = saved(sketch(docs, bands, rows), "sketch")
    one = sketches.groupBy("doc_id").agg(F.min("text_key").alias("text_key"))
    reps = saved(
        sketches.where("text_key IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("class_id"), F.min_by("bands", "doc_id").alias("bands")),
        "classes",
    )
    slots = reps.select("class_id", F.explode("bands").alias("bucket"))
    shared = slots.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = saved(slots.join(shared, "bucket").select("bucket", F.col("class_id").alias("doc"), "n"), "met")
    degree = met.groupBy("doc").agg(F.sum("n").alias("degree"))
    ranked = met.join(degree, "doc").select("bucket", "doc", F.struct("degree", (-F.col("doc")).alias("less")).alias("rank"))
    members = saved(ranked.join(ranked.groupBy("bucket").agg((-F.max("rank")["less"]).alias("head")), "bucket").select("bucket", "head", "doc"), "members")

    pairs = saved(members.where("doc != head").select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    plain = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = saved(restrict(plain, wanted, "left_semi").groupBy("doc_id").agg(F.first("text").alias("text")), "texts")
    links = saved(verified(pairs, texts).where(F.col("similarity") >= threshold).select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")
    groups = saved(components(links), "groups")
    rest = residual(members.select("bucket", "doc"), groups, texts, threshold)
    if not rest.isEmpty():
        groups = saved(components(groups.toDF("src", "dst").union(rest)), "groups")

    of = reps.select("text_key", "class_id").join(groups.toDF("class_id", "component_id"), "class_id", "left")
    return (
        one.join(of, "text_key", "left")
        .withColumn("class_id", F.coalesce("class_id", "doc_id"))
        .withColumn("component_id", F.coalesce("component_id", "class_id"))
        .select("doc_id", "class_id", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group; rows without
    doc_id pass, and of rows that repeat a doc_id one stays."""
    found = near_duplicates(docs, **options)
    gone = saved(found.where(~F.col("kept")).select("doc_id"), "gone")
    left = docs.join(bounded(gone), "doc_id", "left_anti").select(docs.columns)
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if not again.isEmpty():
        left = left.where("doc_id IS NULL").unionByName(left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    return left
