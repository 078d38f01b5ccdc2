"""What the operators of this subpackage share: scratch tables, guarded
broadcasts, word splitting and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that may be broadcast. Beyond them the same join runs as a shuffle join.
BROADCAST_BYTES = 16 << 20

#: A word: letters, marks or digits of any script.
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of 1,000 rows and at most 16 MB, where the
    session keeps the defaults, so that long texts do not add up in a worker."""
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "268435456", str(16 << 20))):
        if str(spark.conf.get(key, default)).rstrip("bB") == default:
            spark.conf.set(key, value)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where a
    local session names none (tests, single machine)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and
    survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the scratch table behind a frame that ``saved`` returned."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, width: int = 16) -> DataFrame:
    """``df`` with a broadcast hint if its rows, ``width`` bytes each (two long columns, if
    nothing is said), fit ``BROADCAST_BYTES``, else as it is."""
    rows = BROADCAST_BYTES // width
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def restrict(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """Keep (left_semi) or drop (left_anti) the rows of ``docs`` listed in ``ids``.
    Texts are shuffled only if the list is too long to broadcast."""
    return docs.join(bounded(ids.select(key).distinct()), key, how)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def unit_interval(key: Column, salt: str) -> Column:
    """A reproducible number in [0, 1) for each key, the same in any SQL engine
    that has md5: the first 52 bits of md5(salt:key)."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def total(parts: Iterable[DataFrame]) -> DataFrame:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an undirected edge list; the component
    is its smallest node. Alternating large-star and small-star steps; only a
    count and a checksum reach the driver. The minima, one row for each node, are
    written before they are joined: the join then has exchanges of its own, not
    those of the aggregate, so that adaptive execution can split a hub's edges.
    Nulls are dropped, loops ignored."""
    e = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    e = saved(e, "edges")
    mark = None
    while True:
        # large star: neighbours above u are tied to the smallest of u's neighbourhood
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = saved(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: neighbours below u, and u, are tied to the smallest of them
        low = saved(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u")
        nxt = saved(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .union(low.select("u", "m"))
            .distinct(),
            "edges",
        )
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        for done in (e, least, large, low):
            discard(done)
        e = nxt
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select("v", "v").distinct().toDF("node", "component")
    )
