"""Readers and writers."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions.columns import extract_seed

#: What is read of a metric log.
LOG = ("seed", "name", "f1", "precision", "recall", "optimal_threshold")


def read_flows(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Flows from CSV (header) or Parquet, by the ending of the path. Columns are
    declared; only those asked for are parsed."""
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        out = spark.read.schema(schema.FLOW).option("header", True).option("enforceSchema", False).csv(path)
    else:
        out = spark.read.parquet(path)
    return out.select(*columns) if columns else out


def write_day(flows: DataFrame, path: str, kind: str = "parquet") -> None:
    flows.write.mode("overwrite").option("header", True).format(kind).save(path)


def read_raw_flowmeter(spark: SparkSession, path: str) -> DataFrame:
    """A dirty day file: every column a string, repeated header rows included."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def write_splits(rows: DataFrame, path: str) -> None:
    rows.repartition("split", F.pmod(F.xxhash64(*rows.columns), F.lit(16))).write.mode("overwrite").partitionBy("split").parquet(path)


def write_snapshots(table: DataFrame, path: str) -> None:
    """By split, sorted by window, in ranges of windows so that a read of few windows skips files."""
    table.repartitionByRange("split", "window_id").sortWithinPartitions("split", "window_id").write.mode("overwrite").partitionBy("split").parquet(path)


def read_snapshots(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    return (out.where(F.col("split") == split) if split else out).orderBy("split", "window_id")


def write_hosts(hosts: DataFrame, path: str) -> None:
    hosts.write.mode("overwrite").parquet(path)


def read_hosts(spark: SparkSession, path: str, inverted: bool = False) -> DataFrame:
    """ip, global_id; inverted: global_id, ip."""
    out = spark.read.parquet(path)
    return out.select("global_id", "ip") if inverted else out.select("ip", "global_id")


def extend_scaler(states: DataFrame, path: str) -> None:
    """Save the moments of one or more chunks (``profile.moments`` by the column ``chunk``),
    each for itself: a chunk that is saved again takes the place of what it left before."""
    states.repartition("chunk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)


def load_scaler_state(spark: SparkSession, path: str) -> DataFrame:
    """The moments of every chunk, to be merged or extended."""
    return spark.read.schema(schema.MOMENTS).parquet(path)


def append_run(log: str, record: DataFrame) -> None:
    """Append runs. An append is a folder named by a digest of its rows, whatever their
    order, and takes the place of that folder alone: an append that is repeated, or that
    ran twice, leaves its runs once, one that dies half-way leaves nothing that is read,
    and writers at the same time do not touch each other's folders."""
    h = F.xxhash64(F.to_json(F.struct(*record.columns), {"ignoreNullFields": "false"}))
    d = record.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("sum"), F.bit_xor(h).alias("xor"), F.lit(",".join(record.columns)).alias("columns"))
    one = F.broadcast(d.select(F.sha2(F.concat_ws(":", "n", F.coalesce("sum", F.lit(0)), F.coalesce("xor", F.lit(0)), "columns"), 256).alias("append")))
    record.crossJoin(one).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("append").parquet(log)


def read_run_log(spark: SparkSession, log: str, run: Sequence[str] = ()) -> DataFrame:
    """All runs; columns that later runs added are null in earlier ones. With the columns
    ``run`` that identify a run, one row of each: that of the latest append."""
    out = spark.read.option("mergeSchema", True).option("basePath", log).parquet(log)
    if not run:
        return out.drop("append")
    names = [c for c in out.columns if c != "append"]
    age = F.struct(F.col("_metadata.file_modification_time").alias("at"), "append")
    last = out.select(*names, age.alias("_age")).groupBy(*run).agg(F.max_by(F.struct(*[c for c in names if c not in run]), "_age").alias("_r"))
    return last.select(*run, "_r.*").select(*names)


def write_buckets(table: DataFrame, name: str, path: str, buckets: int, key: str = "window_id") -> None:
    """A catalogue table in buckets of ``key``, sorted by it within each bucket, so that
    tables with as many buckets are joined and grouped by it without an exchange."""
    table.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)


@contextmanager
def colocated(spark: SparkSession) -> Iterator[None]:
    """Within it, a join on more columns than the bucket key still uses the buckets."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_histories(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Histories, one JSON document (or a list of them) to a file, under one directory
    for each experiment; experiment is the directory's name."""
    out = spark.read.schema(schema.HISTORY).option("multiLine", True).json(f"{folder}/*/{pattern}")
    return out.withColumn("experiment", F.element_at(F.split("_metadata.file_path", "/"), -2))


def read_metric_logs(spark: SparkSession, folder: str, names: DataFrame, pattern: str = "metrics_newth_*.csv") -> DataFrame:
    """experiment, seed, f1, precision, recall, optimal_threshold and Model (the
    display name) of all logs. A file's own header says what its columns are: names
    count without case and outer blanks, those that a file lacks are null. The seed
    is its own column, or stands in the model's name (the first column, if none is
    called model_name); score and threshold are the first columns whose names hold
    f1 and th."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, path in zip(batch["value"], batch["path"], strict=True):
                rows = [r for r in csv.reader(text.splitlines()) if r]
                if len(rows) < 2:
                    continue
                head = [c.strip().lower() for c in rows[0]]
                # the first of equal names counts
                at = {c: i for i, c in reversed(list(enumerate(head)))}
                first = lambda part: next((i for i, c in enumerate(head) if part in c), None)  # noqa: B023, E731
                places = [at.get("seed"), at.get("model_name", 0), first("f1"), at.get("precision"), at.get("recall"), first("th")]
                out = [[r[i] if i is not None and i < len(r) else None for i in places] for r in rows[1:]]
                yield pd.DataFrame(out, columns=LOG, dtype=object).assign(path=path)

    files = spark.read.text(f"{folder}/*/{pattern}", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    raw = files.mapInPandas(run, ", ".join(f"{c} string" for c in (*LOG, "path")))
    number = lambda c: F.trim(c).try_cast("double").alias(c)
    seed = F.coalesce(F.trim("seed").try_cast("int"), extract_seed("name")).alias("seed")
    out = raw.select(F.element_at(F.split("path", "/"), -2).alias("experiment"), seed, *[number(c) for c in LOG[2:]])
    return out.join(names.toDF("experiment", "_m"), "experiment", "left").withColumn("Model", F.coalesce("_m", "experiment")).drop("_m")


def save_thresholds(thresholds: DataFrame, path: str) -> None:
    thresholds.write.mode("overwrite").parquet(path)


def load_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.THRESHOLDS).parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").parquet(path)


def write_test_metrics(tables: Sequence[DataFrame], path: str) -> None:
    """All tables' rows in one; columns that a table lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    out.write.mode("overwrite").parquet(path)


def typed(rows: DataFrame, kinds: T.StructType) -> DataFrame:
    """``rows`` with the columns of ``kinds``, texts that do not parse as null."""
    return rows.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in kinds])
