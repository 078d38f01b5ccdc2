"""A forest over wide vectors.

Spark ML's forest sends features x bins x classes for every node from every partition,
however few rows the node has: with hundreds of features and trees of depth 15 that is
far more than the rows themselves. Here a node is split that way only while it has more
than ``SMALL`` rows; the rows of a smaller one meet in one task, which grows the rest of
its branch. The trees are those of Spark ML: bins from a bounded sample, rows weighted by a
Poisson draw for each tree, classes balanced, a third of the features for each node, Gini.

Rows are kept in small blocks, one byte for each feature: 2 * bin + label, so that neither
a page of the table nor a batch that goes to Python grows with the rows. Nodes are numbered as
in a heap (root 1, children 2i and 2i + 1).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import shared_table

#: Bins of a feature; rows that they are taken from, at about.
BINS, SAMPLE = 32, 20_000
#: Bytes of a block at most, if a row is not longer. Spark's readers, writers and Arrow batches count rows, some
#: thousands at once: with long ones an executor would hold all that its tasks read.
BLOCK = 4_096
#: Rows that a task handles at once (about what a core's cache holds).
ROWS = 32_768
#: Rows of a node whose branch one task may grow.
SMALL = 50_000
#: Nodes whose counts a task holds in one pass (about 25 KB each for 100 features looked at).
OPEN = 4_000
#: Rows that are sent to branches in one pass, each once for every tree that drew it.
SENT = 40_000_000

#: A Poisson(1) draw for each of 65,536 equally likely numbers.
POISSON = np.searchsorted(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)])), np.arange(65_536) / 65_536, side="right").astype(np.uint8)


def drawn(seed: int, tree: int, node: int, size: int, looked: int) -> np.ndarray:
    """The features that a node looks at."""
    return np.sort(np.random.default_rng((seed, tree, node)).permutation(size)[:looked])


def bag(seed: int, tree: int, numbers: np.ndarray) -> np.ndarray:
    """How often a tree drew each of the rows, by their numbers (splitmix64, started anew for each tree)."""
    x = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.random.default_rng((seed, tree)).integers(0, 2**64, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return POISSON[(x ^ (x >> np.uint64(31))) >> np.uint64(48)]


def reached(codes: np.ndarray, rows: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node that each of ``rows`` has come to in a tree."""
    flat, start = codes.reshape(-1), rows * codes.shape[1]
    node, live, at = np.ones(len(rows), np.int64), np.arange(len(rows)), np.ones(len(rows), np.int64)
    while True:
        f = feature.take(at)
        on = f >= 0
        if not on.all():
            node[live[~on]] = at[~on]
            live, start, at, f = live[on], start[on], at[on], f[on]
        if not len(live):
            return node
        at = 2 * at + (flat.take(start + f) >> 1 > cut.take(at))


def counts(codes: np.ndarray, rows: np.ndarray, looked: np.ndarray) -> np.ndarray:
    """Rows by looked-at feature, bin and label."""
    start = np.arange(len(looked)) * (2 * BINS)
    out = np.zeros(len(looked) * 2 * BINS, np.int64)
    for i in range(0, len(rows), 2_048):
        out += np.bincount((codes[rows[i : i + 2_048]].take(looked, axis=1) + start).ravel(), minlength=len(out))
    return out


def best_split(n: np.ndarray, weight: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """(place of the feature, last bin of the left side, rows by label on the left and on the
    right) of least weighted Gini impurity, none if no split lowers it."""
    n = n.reshape(-1, BINS, 2)
    left = np.cumsum(n, axis=1)
    both = left[0, -1]
    a, b = left[:, :-1, 0] * weight[0], left[:, :-1, 1] * weight[1]
    p, q = both * weight
    s, r = a + b, p + q - a - b
    sides = left[:, :-1].sum(axis=2)
    ok = (sides > 0) & (sides < both.sum())
    cost = np.full(a.shape, np.inf)
    np.divide(a * b, s, out=cost, where=ok)
    cost += np.divide((p - a) * (q - b), r, out=np.zeros(a.shape), where=ok)
    i, j = np.unravel_index(np.argmin(cost), cost.shape)
    if not cost[i, j] < p * q / (p + q) * (1 - 1e-9):
        return None
    return int(i), int(j), left[i, j], both - left[i, j]


def grown(codes: np.ndarray, times: np.ndarray, root: int, last: int, looks: Callable[[int], np.ndarray], weight: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(node, feature or -1, last bin of the left side, share of label 1) of the branch below
    ``root``; nodes from ``last`` on are leaves."""
    out, open_ = [], [(root, np.repeat(np.arange(len(codes)), times))]
    while open_:
        node, rows = open_.pop()
        ones = int((codes[rows, 0] & 1).sum())
        p, q = (len(rows) - ones) * weight[0], ones * weight[1]
        split = None
        if node < last and 0 < ones < len(rows):
            looked = looks(node)
            split = best_split(counts(codes, rows, looked), weight)
        if split is None:
            out.append((node, -1, 0, q / (p + q) if p + q else 0.0))
            continue
        feature = int(looked[split[0]])
        right = codes[rows, feature] >> 1 > split[1]
        out.append((node, feature, split[1], q / (p + q)))
        open_ += [(2 * node, rows[~right]), (2 * node + 1, rows[right])]
    return out


def cut_points(train: DataFrame, size: int, rows: int) -> np.ndarray:
    """(feature, BINS - 1): ascending values, a row's bin is how many of them lie below its
    value. They part values next to each other in the sample, all of them if these are few,
    else about as many rows each."""

    def of(g: pd.DataFrame) -> pd.DataFrame:
        v, n = np.unique(g["col"].to_numpy("float64"), return_counts=True)
        at = np.arange(len(v) - 1)
        if len(v) > BINS:
            at = np.unique(np.searchsorted(np.cumsum(n), np.arange(1, BINS) * n.sum() / BINS).clip(max=len(v) - 2))
        return pd.DataFrame({"pos": g["pos"].iloc[:1], "cuts": [((v[at] + v[at + 1]) / 2).tolist()]})

    some = train if rows <= SAMPLE else train.sample(withReplacement=False, fraction=SAMPLE / rows, seed=1)
    out = np.full((size, BINS - 1), np.inf)
    for r in some.select(F.posexplode("features")).groupBy("pos").applyInPandas(of, "pos int, cuts array<double>").collect():
        out[r["pos"], : len(r["cuts"])] = r["cuts"]
    return out


def binned(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(c, v) for c, v in zip(cuts, values.T, strict=True)], axis=1).astype(np.uint8)


def blocks_of(train: DataFrame, cuts: np.ndarray) -> DataFrame:
    """first, codes: the rows of ``train`` (features, label) in blocks, with the number of a
    block's first row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 33, len(cuts)
        for b in batches:
            if b.num_rows:
                values = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                codes = 2 * binned(values, cuts) + b.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)[:, None]
                starts = range(0, b.num_rows, max(1, BLOCK // size))
                blocks = [codes[i : i + starts.step].tobytes() for i in starts]
                yield pa.RecordBatch.from_arrays([pa.array([number + i for i in starts], pa.int64()), pa.array(blocks, pa.binary())], ["first", "codes"])
                number += b.num_rows

    return train.select("features", "label").mapInArrow(of, "first long, codes binary")


def together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of a task, about ROWS rows at once: codes and numbers of the rows."""
    step = max(1, ROWS // max(1, BLOCK // size))
    for b in batches:
        for i in range(0, b.num_rows, step):
            some = b.slice(i, step)
            blocks = some.column(1).to_pylist()
            n = np.array([len(x) // size for x in blocks])
            codes = np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, size)
            yield codes, np.repeat(some.column(0).to_numpy() - (np.cumsum(n) - n), n) + np.arange(len(codes))


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query has shuffled goes from the disks when the query ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Forest:
    """100 trees of depth 15 are at most 46 MB, which is what passes through the driver."""

    def __init__(self, cuts: np.ndarray, trees: int, depth: int):
        nodes = 2 << depth
        self.cuts = cuts
        self.feature = np.full((trees, nodes), -1, np.int16)
        self.cut = np.zeros((trees, nodes), np.uint8)
        self.share = np.zeros((trees, nodes), np.float32)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds probability, as Spark ML's models do: the mean over the trees."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def positive(features: pd.Series) -> pd.Series:
            f = shared.value
            if not len(features):
                return pd.Series([], dtype="float64")
            codes = 2 * binned(np.stack(features), f.cuts)
            each = np.arange(len(codes))
            return pd.Series(sum(s[reached(codes, each, k, c)].astype("float64") for k, c, s in zip(f.feature, f.cut, f.share, strict=True)) / len(f.feature))

        p = positive(F.transform("features", lambda v: F.coalesce(v, F.lit(0.0).cast("float"))))
        return rows.withColumn("_p", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), "_p"))).drop("_p")


def packs(items: list[tuple[int, int]], sizes: list[int], most: int) -> Iterator[list[tuple[int, int]]]:
    """``items`` in runs of at most ``most`` in all, one at least."""
    run, total = [], 0
    for item, n in zip(items, sizes, strict=True):
        if run and total + n > most:
            yield run
            run, total = [], 0
        run.append(item)
        total += n
    if run:
        yield run


def fit(train: DataFrame, trees: int, depth: int, y: str, seed: int) -> Forest:
    """``train``: features (array) and ``y`` (0 or 1)."""
    train = train.select(F.transform("features", lambda v: F.coalesce(v, F.lit(0.0)).cast("float")).alias("features"), F.col(y).cast("int").alias("label"))
    got = train.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("ones"), F.max(F.size("features")).alias("size")).first()
    rows, size = got["n"], got["size"] or 0
    if not rows:
        raise ValueError("no rows to train on")
    looked = -(-size // 3)
    weight = np.array([rows / (2.0 * max(rows - got["ones"], 1)), rows / (2.0 * max(got["ones"], 1))])
    forest = Forest(cut_points(train, size, rows), trees, depth)
    context = train.sparkSession.sparkContext
    # a task for each core also where the table is long: each sends the counts of a pass's nodes
    cores = context.defaultParallelism
    blocks = shared_table(blocks_of(train, forest.cuts).repartition(cores)).coalesce(cores)
    last = 1 << depth

    def found(nodes: list[tuple[int, int]]) -> tuple[Callable, Broadcast]:
        """For a task: the rows that its trees' ``nodes`` have drawn and hold, node by node,
        a row once for each time that it was drawn. The trees go from the executors when the
        pass is over."""
        slots = {t: [n for u, n in nodes if u == t] for t in dict.fromkeys(t for t, _ in nodes)}
        shared = context.broadcast({t: (forest.feature[t], forest.cut[t], n) for t, n in slots.items()})

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, Iterator[tuple[int, np.ndarray]]]]:
            for codes, numbers in together(batches, size):
                for t, (feature, cut, mine) in shared.value.items():
                    times = bag(seed, t, numbers)
                    all_ = np.flatnonzero(times)
                    slot = np.full(len(feature), -1, np.int32)
                    slot[mine] = np.arange(len(mine))
                    at = slot[reached(codes, all_, feature, cut)]
                    held, at = np.repeat(all_[at >= 0], times[all_[at >= 0]]), np.repeat(at[at >= 0], times[all_[at >= 0]])
                    held = held[np.argsort(at, kind="stable")]
                    ends = np.cumsum(np.bincount(at, minlength=len(mine)))
                    yield t, codes, ((n, held[a:b]) for n, a, b in zip(mine, [0, *ends[:-1]], ends, strict=True) if b > a)

        return of, shared

    def split(nodes: list[tuple[int, int]]) -> list:
        of, shared = found(nodes)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            looks: dict[tuple[int, int], np.ndarray] = {}
            for t, codes, held in of(batches):
                for n, r in held:
                    if (t, n) not in sums:
                        looks[t, n], sums[t, n] = drawn(seed, t, n, size, looked), np.zeros(looked * 2 * BINS, np.int32)
                    sums[t, n] += counts(codes, r, looks[t, n]).astype(np.int32)
            for (t, n), c in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([n], pa.int32()), pa.array([c.tobytes()], pa.binary())], ["tree", "node", "counts"])

        def best(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            t, n = map(int, key)
            c = sum(np.frombuffer(b, np.int32).astype(np.int64) for b in g["counts"])
            p, q = c.reshape(-1, BINS, 2)[0].sum(axis=0)
            s = best_split(c, weight) if p and q else None
            row = (t, n, p, q, -1, 0, 0, 0) if s is None else (t, n, p, q, drawn(seed, t, n, size, looked)[s[0]], s[1], *s[2])
            return pd.DataFrame([row], columns=["tree", "node", "p", "q", "feature", "cut", "left_p", "left_q"])

        sums = blocks.mapInArrow(partial, "tree int, node int, counts binary")
        got = sums.groupBy("tree", "node").applyInPandas(best, "tree int, node int, p long, q long, feature int, cut int, left_p long, left_q long").collect()
        shared.destroy()
        return got

    def branches(nodes: list[tuple[int, int]], sent: int) -> list:
        of, shared = found(nodes)

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, codes, held in of(batches):
                out = [(n, *np.unique(r, return_counts=True)) for n, r in held]
                if out:
                    columns = [pa.array([t] * len(out), pa.int32()), pa.array([n for n, _, _ in out], pa.int32())]
                    columns += [pa.array([codes[r].tobytes() for _, r, _ in out], pa.binary()), pa.array([k.astype(np.uint8).tobytes() for _, _, k in out], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["tree", "node", "codes", "times"])

        def grow(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            t, n = map(int, key)
            codes = np.frombuffer(b"".join(g["codes"]), np.uint8).reshape(-1, size)
            out = grown(codes, np.frombuffer(b"".join(g["times"]), np.uint8), n, last, lambda i: drawn(seed, t, i, size, looked), weight)
            node, feature, cut, share = (np.array(v, k).tobytes() for v, k in zip(zip(*out, strict=True), ("int32", "int16", "uint8", "float32"), strict=True))
            return pd.DataFrame({"tree": [t], "node": [node], "feature": [feature], "cut": [cut], "share": [share]})

        tasks = max(4 * cores, sent * size >> 26)
        dealt = blocks.mapInArrow(parts, "tree int, node int, codes binary, times binary").repartition(tasks, "tree", "node")
        got = dealt.groupBy("tree", "node").applyInPandas(grow, "tree int, node binary, feature binary, cut binary, share binary").collect()
        shared.destroy()
        return got

    small: dict[tuple[int, int], int] = {}
    open_ = {(t, 1): rows for t in range(trees)}
    with cleaned(train.sparkSession):
        while open_:
            small |= {k: n for k, n in open_.items() if n <= SMALL}
            large = sorted(k for k, n in open_.items() if n > SMALL)
            open_ = {}
            for nodes in packs(large, [1] * len(large), OPEN):
                for r in split(nodes):
                    t, n = r["tree"], r["node"]
                    forest.share[t, n] = r["q"] * weight[1] / (r["p"] * weight[0] + r["q"] * weight[1])
                    if r["feature"] < 0:
                        continue
                    forest.feature[t, n], forest.cut[t, n] = r["feature"], r["cut"]
                    for child, p, q in ((2 * n, r["left_p"], r["left_q"]), (2 * n + 1, r["p"] - r["left_p"], r["q"] - r["left_q"])):
                        forest.share[t, child] = q * weight[1] / (p * weight[0] + q * weight[1])
                        if child < last and p and q:
                            open_[t, child] = p + q
        nodes = sorted(small)
        for some in packs(nodes, [small[k] for k in nodes], SENT):
            for r in branches(some, sum(small[k] for k in some)):
                node, feature, cut, share = (np.frombuffer(r[c], k) for c, k in (("node", "int32"), ("feature", "int16"), ("cut", "uint8"), ("share", "float32")))
                forest.feature[r["tree"], node], forest.cut[r["tree"], node], forest.share[r["tree"], node] = feature, cut, share
    return forest
