"""Whitening of embeddings, each distinct vector once (operator 13).

An entry c becomes the integer x = floor(64 c) + 1,000,000. Identical x vectors are
grouped and counted; their count is the weight in the fit (``weights="count"``: the fit
list is all vectors), or each weighs one (``weights="one"``: the distinct vectors).
Sums are exact integers; the covariance is a weighted GEMM of entries centred before
they are multiplied, (n x - S) / n with an exact numerator, added up within each task and
then over the tasks row by row of the matrix. Its eigenvectors are the components. Each
distinct vector is projected once, and rows get their vector's result back by a join on
128 bits of its hash, of narrow rows, that Spark may split where one vector is frequent.

What reaches the driver, and every task, is the size of the dimension squared, whatever
the number of rows.

Defined results: rows whose vector is null or holds null, NaN or infinite entries are
dropped; vectors of another length than the most frequent one (the longer of two as
frequent) are dropped too, being in no space with the others; empty vectors have no
component. Components whose variance is not above 1e-11 of the largest cannot be scaled
to 1 and don't exist, so vectors that are all equal, and a single one, give no rows, and
an empty table none. Entries beyond 2^62 in size count as that; a deviation beyond 64
bits is null. Rows without vec_id and repeated rows are rows like others; equal
eigenvalues leave the choice of their components open. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Components returned at most; variance a component needs, as a share of the largest.
COMPONENTS, RANK = 32, 1e-11
STEP, ORIGIN, FAR = 64.0, 1_000_000, float(1 << 62)
#: Partial matrices that are added up in one group at first.
FAN = 64
#: Entries of vectors that are worked on at once.
ENTRIES = 4_000_000


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, x and the two halves of its key, of the vectors that count."""
    v = F.col("v")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(v.isNotNull() & ~bad)
    x = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * STEP, F.lit(FAR)), F.lit(-FAR))) + F.lit(ORIGIN).cast("long"))
    return whole.select("vec_id", x.alias("x")).withColumns({"k1": F.xxhash64("x"), "k2": F.xxhash64(F.lit(13), "x")})


def rows_of(column: pa.Array, long: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, long)


def blocks(batches: Iterator[pa.RecordBatch], column: str, long: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(vectors, weights, rows) of a bounded number of entries."""
    step = max(1, ENTRIES // max(1, long))
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            yield rows_of(part.column(column), long), part.column("weight").to_numpy(), part


@dataclass
class Centre:
    """n, and the exact sum of each dimension."""

    n: int
    total: list[int]

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly; Python's integers where 64 bits might not hold it."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, *(abs(s) for s in self.total))
        kind = np.int64 if most < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.total, dtype=kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.numerators(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        d = self.numerators(x)
        if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 63:
            return (d * d).sum(axis=1).tolist()
        return [s if s < 1 << 63 else None for s in (sum(int(y) ** 2 for y in row) for row in d)]


def centre(distinct: DataFrame, long: int) -> Centre:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(long, dtype=object)
        for x, w, _ in blocks(batches, "x", long):
            kind = np.int64 if int(np.abs(x).max(initial=0)) * int(w.sum()) < 1 << 62 else object
            n, total = n + int(w.sum()), total + (w.astype(kind) @ x.astype(kind)).astype(object)
        if n:
            yield pa.RecordBatch.from_pydict({"pos": pa.array(range(-1, long), pa.int32()), "total": [str(s) for s in (n, *total)]})

    rows = distinct.select("x", "weight").mapInArrow(sums, "pos int, total string")
    found = {r["pos"]: int(r["total"]) for r in rows.groupBy("pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    return Centre(found.get(-1, 0), [found.get(i, 0) for i in range(long)])


def added(rows: DataFrame) -> np.ndarray:
    """Partial matrices, row by row as (part, pos, values), added up: ``FAN`` parts first, then the rest."""

    def add(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        values = np.stack([np.asarray(v) for v in group.column("values").to_pylist()]).sum(axis=0)
        return pa.table({"part": pa.array([key[1].as_py()], pa.int32()), "pos": pa.array([key[0].as_py()], pa.int32()), "values": pa.array([values.tolist()], pa.list_(pa.float64()))})

    for part in (F.floor(F.col("part") / FAN).cast("int"), F.lit(0)):
        rows = rows.withColumn("to", part).groupBy("pos", "to").applyInArrow(lambda key, group: add(key, group), "part int, pos int, values array<double>")
    return np.array([r["values"] for r in sorted(rows.select("pos", "values").collect(), key=lambda r: r["pos"])])


def partial(values: np.ndarray) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_pydict(
        {"part": pa.array([part] * len(values), pa.int32()), "pos": pa.array(range(len(values)), pa.int32()), "values": pa.array(values.tolist(), pa.list_(pa.float64()))}
    )


def covariance(vectors: DataFrame, column: str, long: int, n: int, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Weighted, divisor n, of entries that are centred before they are multiplied."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((long, long))
        for x, w, _ in blocks(batches, column, long):
            d = centred(x)
            out += (d * w[:, None]).T @ d
        yield partial(out)

    return added(vectors.select(column, "weight").mapInArrow(products, "part int, pos int, values array<double>")) / n


def mean(vectors: DataFrame, column: str, long: int, n: int) -> np.ndarray:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((1, long))
        for x, w, _ in blocks(batches, column, long):
            out += w.astype(np.float64) @ x
        yield partial(out)

    return added(vectors.select(column, "weight").mapInArrow(sums, "part int, pos int, values array<double>"))[0] / n


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, weights: str = "count", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    if weights not in ("count", "one"):
        raise ValueError(f"weights is 'count' or 'one', not {weights!r}")
    spark = embeddings.sparkSession
    rows = quantised(embeddings)
    distinct = saved(rows.groupBy("x", "k1", "k2").agg(F.count("*").alias("copies")), "distinct")
    longs = distinct.groupBy(F.size("x").alias("long")).agg(F.sum("copies").alias("copies")).orderBy(F.desc("copies"), F.desc("long")).first()
    if not longs or not longs["long"]:
        return spark.createDataFrame([], SCHEMA)
    long = longs["long"]
    distinct = distinct.where(F.size("x") == long).withColumn("weight", F.col("copies") if weights == "count" else F.lit(1).cast("long"))

    at = centre(distinct, long)
    v = covariance(distinct, "x", long, at.n, at.centred)
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > RANK * max(e[0], 0.0)).sum())) if e[0] > 0 else 0
    if not k:
        return spark.createDataFrame([], SCHEMA)
    explained = (e[:k] / np.trace(v)).tolist()
    model = spark.sparkContext.broadcast((at, u[:, :k], np.sqrt(e[:k])))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, u, scale = model.value
        for x, w, part in blocks(batches, "x", long):
            white = at.centred(x) @ u / scale
            yield pa.RecordBatch.from_pydict(
                {
                    **{c: part.column(c) for c in ("k1", "k2")},
                    "weight": pa.array(w),
                    "deviation": pa.array(at.deviations(x), pa.int64()),
                    "white": pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1, dtype=np.int32) * k), pa.array(white.ravel())),
                }
            )

    white = saved(distinct.select("x", "weight", "k1", "k2").mapInArrow(project, "k1 long, k2 long, weight long, deviation long, white array<double>"), "white")
    middle = mean(white, "white", k, at.n)
    error = float(np.abs(covariance(white, "white", k, at.n, lambda x: x - middle) - np.eye(k)).max())

    back = rows.select("vec_id", "k1", "k2").join(white.drop("weight"), ["k1", "k2"])
    out = back.select("vec_id", "deviation", F.posexplode("white").alias("pos", "whitened"))
    return out.select(
        "vec_id",
        (F.col("pos") + 1).alias("component"),
        F.lit(at.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*map(F.lit, explained)), F.col("pos") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
