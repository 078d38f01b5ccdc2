"""Near-duplicate embeddings by an inverted multi-index (operator 4).

Vectors are scaled to length one and cut into halves; each half has its own
codebook, and the two codebooks span a product grid of cells. A vector is stored
in the cell of its nearest centroids. A search walks the cells in the order of a
multi-sequence traversal, nearest first: the cost of a cell is the sum, over the
halves, of the squared distance from the vector to the border of that cell's
region. The walk ends at a cost that was calibrated on a sample so that a partner
exactly at the threshold lies in a visited cell with the target probability.
What shares a cell is verified with cosines in double precision.

Equal vectors with equal labels are searched for once and counted as often as
they occur. A pair is looked for from the vector in the smaller cell only, and by
blocks of bounded size, so that a hot cell is many small tasks. Blocks emit a
count per vector and links that span the block's groups, never its pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and vectors with a null label, link with nothing; vectors of
different length never link, and every length has a grid of its own; rows with a
repeated vec_id count once (the largest label and vector); a null vec_id is dropped; an
empty table gives an empty one; ties do not arise, as a pair links or does not. Columns
other than vec_id, label and embedding, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, saved

THRESHOLD, RECALL = 0.98, 0.995
#: Vectors that the codebooks and the calibration are fitted on, at most; beyond
#: SAMPLE / FEW centroids (3 billion vectors of one length) FEW for each centroid.
SAMPLE, FEW = 20_000, 8
#: Vectors per cell that the grid is laid out for; rows of one block.
CELL, BLOCK = 512, 1024


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def borders(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, and its squared distance to the border
    between that centroid's region and each other region."""
    d = (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T
    near = d.argmin(1)
    # distances of centroids, for the rows' own ones only: no table of all pairs of centroids
    size = (c * c).sum(1)
    gap = np.sqrt(np.maximum(size[near][:, None] + size - 2 * c[near] @ c.T, 1e-18))
    m = (d - d[np.arange(len(x)), near][:, None]) / (2 * gap)
    return near, np.maximum(m, 0) ** 2


class Grid:
    """Two codebooks and the calibrated cost at which a walk ends."""

    def __init__(self, x: np.ndarray, k: int, threshold: float, recall: float):
        self.half = x.shape[1] // 2
        self.books = [kmeans(x[:, : self.half], k), kmeans(x[:, self.half :], k)]
        noise = np.random.default_rng(11).normal(size=x.shape)
        noise -= (noise * x).sum(1)[:, None] * x
        noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
        other = threshold * x + np.sqrt(1 - threshold**2) * noise
        (i, j), (p, q) = self.cells(other)[0], self.cells(x)[1]
        at = np.arange(len(x))
        self.reach = float(np.quantile(p[at, i] + q[at, j], recall)) + 1e-12

    def cells(self, x: np.ndarray):
        (i, p), (j, q) = borders(x[:, : self.half], self.books[0]), borders(x[:, self.half :], self.books[1])
        return (i, j), (p, q)

    def walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cell of each row, and (row, cell) of the visited cells above it.
        Each half's list is sorted; the second list is cut where the sum passes
        the reach, which visits what a heap would pop up to that cost."""
        (i, j), (p, q) = self.cells(x)
        width = len(self.books[1])
        home = i * width + j
        rows, cells = [home[:0]], [home[:0]]
        a, b = np.argsort(p, axis=1, kind="stable"), np.argsort(q, axis=1, kind="stable")
        ps, qs = np.take_along_axis(p, a, 1), np.take_along_axis(q, b, 1)
        for s in range(p.shape[1]):
            if not (ps[:, s] <= self.reach).any():
                break
            ok = ps[:, s : s + 1] + qs <= self.reach
            r, t = np.nonzero(ok)
            cell = a[r, s] * width + b[r, t]
            up = cell > home[r]
            rows.append(r[up])
            cells.append(cell[up])
        return home, np.concatenate(rows), np.concatenate(cells)


def units(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def block_links(ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray, y: np.ndarray, same: bool, threshold: float, copies: np.ndarray | None = None, other_copies: np.ndarray | None = None):
    """Links of one block of pairs: (id, count) and linked (id, id) that connect
    whatever the block connects. Each row stands for one vector, or for ``copies``."""
    hit = x @ y.T >= threshold
    if same:
        hit = np.triu(hit, 1)
    r, c = np.nonzero(hit)
    if not len(r):
        return None
    copies, other_copies = (np.ones(len(i), np.int64) if k is None else k for i, k in ((ids, copies), (other_ids, other_copies)))
    # whole numbers below 2 ** 53 are exact in double precision
    n = tuple(np.bincount(at, w, minlength=len(i)).astype(np.int64) for at, w, i in ((r, other_copies[c], ids), (c, copies[r], other_ids)))
    # a row's links all meet in its first column; columns first linked to one row meet there
    first = hit.argmax(1)[np.unique(r)]
    edges = [np.stack([ids[np.unique(r)], other_ids[first]], 1)]
    top = hit.argmax(0)[np.unique(c)]
    edges.append(np.stack([ids[top], other_ids[np.unique(c)]], 1))
    # rows and columns that these two stars leave apart although they are linked
    root: dict = {}

    def find(v):
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for u, v in np.concatenate(edges).tolist():
        root[find(u)] = find(v)
    names_r = np.array([find(v) if k else -1 for v, k in zip(ids.tolist(), n[0], strict=True)], dtype=np.int64)
    names_c = np.array([find(v) if k else -1 for v, k in zip(other_ids.tolist(), n[1], strict=True)], dtype=np.int64)
    apart = np.unique(np.stack([names_r[r], names_c[c]], 1)[names_r[r] != names_c[c]], axis=0)
    edges.append(apart.reshape(-1, 2))
    e = np.unique(np.concatenate(edges), axis=0)
    counts = [(ids[n[0] > 0], n[0][n[0] > 0]), (other_ids[n[1] > 0], n[1][n[1] > 0])]
    return np.concatenate([k for k, _ in counts]), np.concatenate([v for _, v in counts]), e


def usable(label: str = "label", embedding: str = "embedding") -> Column:
    """Whether a vector can link at all."""
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & (F.size(embedding) > 0) & finite & F.exists(embedding, lambda v: v != 0), F.lit(False))


def links(sound: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(kind, a, b): kind 'n' says that vector a has b links in some block, kind
    'e' that a and b are linked or reach each other over links. ``sound`` has
    usable vectors: vec_id, label, dim, embedding and copies, for how many equal
    vectors a row stands."""
    spark = sound.sparkSession
    # a row for each length that occurs
    sizes = {r["dim"]: r["count"] for r in sound.groupBy("dim").count().collect()}
    grids = {}
    for dim, n in sizes.items():
        if dim < 2 or n <= block:
            continue
        part = sound.where(F.col("dim") == dim)
        # cells stay of one size however many vectors there are; a centroid is fitted on FEW of the sample at least
        k = max(2, int(np.ceil(np.sqrt(n / cell))))
        most = max(sample, FEW * k)
        if n > most:
            part = part.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 40)) < int(most / n * 0.97 * (1 << 40))).limit(most)
        grids[dim] = Grid(units(r[0] for r in part.select("embedding").toLocalIterator()), k, threshold, recall)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                x = units(part["embedding"])
                base = pd.DataFrame({"label": part["label"].to_numpy(), "dim": dim, "vec_id": part["vec_id"].to_numpy()})
                if dim in grids:
                    home, rows, cells = grids[dim].walk(x)
                else:
                    home, rows, cells = np.zeros(len(x), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                yield base.assign(cell=home, home=True)
                if len(rows):
                    yield base.iloc[rows].assign(cell=cells, home=False)

    key = ["label", "dim", "cell"]
    # cells hold ids; a vector joins them again only when its blocks are dealt
    placed = saved(sound.select("vec_id", "label", "dim", "embedding").mapInPandas(place, "label int, dim int, vec_id long, cell long, home boolean"), "cells")
    # blocks: home rows of a cell are dealt to nh blocks, its visitors to nv; a task
    # compares one block of homes with one block of homes or visitors
    counts = placed.groupBy(key).agg(F.count_if("home").alias("nh"), F.count_if(~F.col("home")).alias("nv")).where("nh > 0 AND nh + nv > 1")
    counts = counts.select(*key, F.ceil(F.col("nh") / block).cast("int").alias("nh"), F.ceil(F.col("nv") / block).cast("int").alias("nv"))
    dealt = placed.join(counts, key)
    slot = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.when(F.col("home"), F.col("nh")).otherwise(F.greatest(F.col("nv"), F.lit(1)))).cast("int")
    upto = F.col("nh") - 1
    dealt = dealt.withColumn("slot", slot).select(
        *key,
        "vec_id",
        "home",
        "slot",
        F.explode(
            F.when(
                F.col("home"),
                F.concat(
                    F.transform(F.sequence(F.lit(0), upto), lambda s: F.struct(F.least(s, F.col("slot")).alias("i"), F.greatest(s, F.col("slot")).alias("j"), F.lit(True).alias("own"))),
                    F.when(F.col("nv") > 0, F.transform(F.sequence(F.lit(0), F.col("nv") - 1), lambda s: F.struct(F.col("slot").alias("i"), s.alias("j"), F.lit(False).alias("own")))).otherwise(F.array()),
                ),
            ).otherwise(F.transform(F.sequence(F.lit(0), upto), lambda s: F.struct(s.alias("i"), F.col("slot").alias("j"), F.lit(False).alias("own"))))
        ).alias("pair"),
    )
    dealt = dealt.select(*key, "vec_id", "home", "slot", "pair.i", "pair.j", "pair.own").withColumn("task", F.xxhash64(*key, "i", "j", "own"))
    dealt = dealt.join(sound.select("vec_id", "embedding", "copies"), "vec_id")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(rows: pd.DataFrame):
            i, j, own = rows["i"].iloc[0], rows["j"].iloc[0], rows["own"].iloc[0]
            ids, copies = rows["vec_id"].to_numpy(), rows["copies"].to_numpy()
            left = (rows["slot"] == i).to_numpy() if own else rows["home"].to_numpy()
            same = bool(own and i == j)
            right = left if same else ~left
            if not left.any() or not right.any():
                return None
            x = units(rows["embedding"])
            found = block_links(ids[left], x[left], ids[right], x[right], same, threshold, copies[left], copies[right])
            if found is None:
                return None
            who, n, e = found
            return pd.DataFrame({"kind": ["n"] * len(who) + ["e"] * len(e), "a": np.concatenate([who, e[:, 0]]), "b": np.concatenate([n, e[:, 1]])})

        held: list[pd.DataFrame] = []
        names = ["task", *key, "i", "j", "own"]
        last = None
        for batch in batches:
            start = 0
            ids = batch["task"].to_numpy()
            cuts = np.flatnonzero(np.diff(ids)) + 1
            for stop in [*cuts.tolist(), len(batch)]:
                part = batch.iloc[start:stop]
                if held and ids[start] != last:
                    yield from (f for _, g in pd.concat(held).groupby(names, sort=False) if (f := done(g)) is not None)
                    held = []
                held.append(part)
                last, start = ids[start], stop
        if held:
            yield from (f for _, g in pd.concat(held).groupby(names, sort=False) if (f := done(g)) is not None)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = dealt.repartition(n, "task").sortWithinPartitions("task").mapInPandas(compare, "kind string, a long, b long")
    return saved(out, "links")


def near_duplicates(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept: see the module."""
    kept = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    one = (
        vectors.where("vec_id IS NOT NULL")
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast(kept).alias("embedding"))
        .groupBy("vec_id")
        .agg(F.max(F.struct("label", "embedding")).alias("v"))
        .select("vec_id", "v.*")
    )
    # equal vectors of a label are one class, known by two keys of 64 bits and named by its smallest vec_id
    one = one.withColumns({"dim": F.when(usable(), F.size("embedding")), "k1": F.xxhash64(F.lit(1), "embedding"), "k2": F.xxhash64(F.lit(2), "embedding")})
    one = saved(one, "vectors")
    same = ["label", "dim", "k1", "k2"]
    classes = saved(one.where("dim IS NOT NULL").groupBy(*same).agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies")), "classes")
    sound = one.join(classes.select(F.col("class_id").alias("vec_id"), "copies"), "vec_id").select("vec_id", "label", "dim", "embedding", "copies")
    found = links(saved(sound, "sound"), **options)
    n = found.where("kind = 'n'").groupBy(F.col("a").alias("class_id")).agg(F.sum("b").alias("n"))
    groups = components(found.where("kind = 'e'"), "a", "b").toDF("class_id", "component_id")
    results = classes.join(n, "class_id", "left").join(groups, "class_id", "left")
    results = results.select(*same, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id"))
    return (
        one.select("vec_id", *same)
        .join(results, same, "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
            (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
        )
    )
