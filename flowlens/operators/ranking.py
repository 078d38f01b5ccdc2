"""Global ranks and running sums without a single-partition window.

Rows are range-partitioned and written once, so that partition numbers hold for
both passes; each partition's totals (a few rows) give the offsets, and a window
within the partition does the rest.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one where a local session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = f"{shared_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered_parts(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` in ranges of ``order``, with the number of each range as ``part``."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shared_table(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))


def offsets(parts: DataFrame, sums: dict[str, object]) -> DataFrame:
    """Per part the sum over the parts before it; one row for each part."""
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = parts.groupBy("part").agg(*[c.alias(k) for k, c in sums.items()])
    return F.broadcast(per.select("part", *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(f"{k}_before") for k in sums]))


def dense_ranks(rows: DataFrame, order: list) -> DataFrame:
    """``rank`` 0, 1, ... over rows whose order keys are distinct."""
    parts = ordered_parts(rows, order)
    w = Window.partitionBy("part").orderBy(*order)
    return parts.withColumn("in_part", F.row_number().over(w)).join(offsets(parts, {"n": F.count("*")}), "part").withColumn("rank", F.col("n_before") + F.col("in_part") - 1).drop("part", "in_part", "n_before")


def running_sums(rows: DataFrame, order: list, values: list[str]) -> DataFrame:
    """cum_<value>: inclusive running sums over rows whose order keys are distinct."""
    parts = ordered_parts(rows, order)
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(offsets(parts, {v: F.sum(v) for v in values}), "part")
    return out.withColumns({f"cum_{v}": F.sum(v).over(w) + F.col(f"{v}_before") for v in values}).drop("part", *[f"{v}_before" for v in values])


def previous(parts: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Adds prev_<c>: the column in the row before, of the same keys, null for a key's
    first row. ``parts`` is what ``ordered_parts`` returned for [*keys, *order], whose
    values are distinct. The last row of each part is carried to the next one that has
    rows (one row for each part), so that a key's rows may lie in any number of parts."""
    here = Window.partitionBy("part").orderBy(*keys, *order)
    row = F.struct(*keys, *columns)
    ends = parts.groupBy("part").agg(F.max_by(row, F.struct(*keys, *order)).alias("end"))
    carried = F.broadcast(ends.select("part", F.lag("end").over(Window.orderBy("part")).alias("_carried")))
    rows = parts.withColumn("_p", F.lag(row).over(here)).join(carried, "part").withColumn("_p", F.coalesce("_p", "_carried"))
    same = F.col("_p").isNotNull()
    for k in keys:
        same &= F.col(f"_p.{k}").eqNullSafe(F.col(k))
    return rows.withColumns({f"prev_{c}": F.when(same, F.col(f"_p.{c}")) for c in columns}).drop("_p", "_carried")


def with_previous(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    return previous(ordered_parts(rows, [*keys, *order]), keys, order, columns).drop("part")


def islands(rows: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of a key's rows: from 1, one more wherever ``starts`` holds, which may
    speak of the rows' columns and of prev_<order>, null for a key's first row; that row
    always starts a run. Order and sums are distributed as in ``running_sums``."""
    rows = previous(ordered_parts(rows, [*keys, *order]), keys, order, order)
    rows = rows.withColumn("_new", (F.col(f"prev_{order[0]}").isNull() | F.coalesce(starts, F.lit(False))).cast("long"))
    here = Window.partitionBy("part").orderBy(*keys, *order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.join(offsets(rows, {"_n": F.sum("_new")}), "part").withColumn("_cum", F.sum("_new").over(here) + F.col("_n_before"))
    # the sums run on over all keys: what came before a key's first row goes off
    base = summed.groupBy(*keys).agg(F.min(F.col("_cum") - F.col("_new")).alias("_base"))
    out = summed.join(base, keys) if keys else summed.crossJoin(F.broadcast(base))
    return out.withColumn(name, F.col("_cum") - F.col("_base")).drop("part", "_new", "_n_before", "_cum", "_base", *[f"prev_{c}" for c in order])


def quantiles(counts: DataFrame, value: str, shares: dict[str, float], keys: list[str] = ()) -> DataFrame:
    """Exact quantiles (linear between neighbours) of values with their counts ``n``,
    by keys without nulls: one column for each name in ``shares``. The values are
    ranked in ranges, so no task holds those of a key."""
    keys = list(keys)
    summed = running_sums(counts.where(F.col(value).isNotNull()), [*keys, value], ["n"])
    own = summed.groupBy(*keys).agg(F.min(F.col("cum_n") - F.col("n")).alias("_before"), F.sum("n").alias("_all"))
    rows = summed.join(own, keys) if keys else summed.crossJoin(F.broadcast(own))
    upto = F.col("cum_n") - F.col("_before")

    def at(place: Column) -> Column:
        return F.min(F.when(upto > place, F.col(value)))

    place = {k: F.lit(p) * (F.col("_all") - 1) for k, p in shares.items()}
    both = rows.groupBy(*keys).agg(F.max("_all").alias("_all"), *[c for k in shares for c in (at(F.floor(place[k])).alias(f"{k}_lo"), at(F.ceil(place[k])).alias(f"{k}_hi"))])
    part = {k: place[k] - F.floor(place[k]) for k in shares}
    return both.select(*keys, *[(F.col(f"{k}_lo") + part[k] * (F.col(f"{k}_hi") - F.col(f"{k}_lo"))).alias(k) for k in shares])
