"""Time windows, splits and their integrity checks."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import valid_ips
from .ranking import with_previous

MS = "FLOW_START_MILLISECONDS"
TRAIN_SHARE, VAL_SHARE = 0.70, 0.85


def slice_day(flows: DataFrame, date: str) -> DataFrame:
    """One calendar day (UTC). The predicate is a range on the raw column, so that it is pushed to the scan."""
    start = int(datetime.fromisoformat(date).replace(tzinfo=UTC).timestamp() * 1000)
    kept = flows.where((F.col(MS) >= start) & (F.col(MS) < start + 86_400_000))
    return kept.withColumn("FLOW_START_TIME", F.timestamp_millis(MS))


def extent(flows: DataFrame, after_filter: bool = False) -> DataFrame:
    """One row: start_ms, end_ms. The anchor is the first of all flows; with
    ``after_filter`` the first of those with valid addresses."""
    rows = flows.where(valid_ips()) if after_filter else flows
    return rows.agg(F.min(MS).alias("start_ms"), F.max(MS).alias("end_ms"))


def assign_window(flows: DataFrame, seconds: int = 30, anchor: DataFrame | None = None) -> DataFrame:
    """window_id: tumbling, anchored at the first flow. The anchor is one row."""
    one = F.broadcast((anchor or extent(flows)).select("start_ms"))
    return flows.crossJoin(one).withColumn("window_id", F.expr(f"({MS} - start_ms) div {seconds * 1000}")).drop("start_ms")


def window_start_ms(seconds: int, start: Column, window: Column | str = "window_id") -> Column:
    return start + F.col(window) * (seconds * 1000) if isinstance(window, str) else start + window * (seconds * 1000)


def resample(rows: DataFrame, width_s: int, ms: str = MS, **aggs: Column) -> DataFrame:
    """Clock-anchored tumbling windows from the first to the last, with zeros
    where nothing happened: window_ms and the given aggregates."""
    width = width_s * 1000
    binned = rows.withColumn("window_ms", F.expr(f"{ms} div {width}") * width)
    sums = binned.groupBy("window_ms").agg(*[c.alias(k) for k, c in (aggs or {"flows": F.count("*")}).items()])
    ends = binned.agg(F.min("window_ms").alias("a"), F.max("window_ms").alias("b")).where("a IS NOT NULL")
    spine = ends.select(F.explode(F.sequence("a", "b", F.lit(width).cast("long"))).alias("window_ms"))
    return spine.join(sums, "window_ms", "left").fillna(0)


def fill_empty_windows(windowed: DataFrame) -> DataFrame:
    """window_id from 0 to the last, flows, is_empty."""
    n = windowed.groupBy("window_id").agg(F.count("*").alias("flows"))
    spine = windowed.agg(F.max("window_id").alias("last")).where("last IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("window_id"))
    return spine.join(n, "window_id", "left").select("window_id", F.coalesce("flows", F.lit(0)).cast("long").alias("flows"), F.col("flows").isNull().alias("is_empty"))


def split_limits(flows: DataFrame, after_filter: bool = False) -> DataFrame:
    """One row: start_us, train_end_us, val_end_us, end_us; integer microseconds."""
    e = extent(flows, after_filter).select((F.col("start_ms") * 1000).alias("start_us"), (F.col("end_ms") * 1000).alias("end_us"))
    span = F.col("end_us") - F.col("start_us")
    cut = lambda share: F.col("start_us") + F.expr(f"(end_us - start_us) * {round(share * 100)} div 100")
    return e.where(span.isNotNull()).select("start_us", cut(TRAIN_SHARE).alias("train_end_us"), cut(VAL_SHARE).alias("val_end_us"), "end_us")


def split_of(us: Column) -> Column:
    return F.when(us < F.col("train_end_us"), "train").when(us < F.col("val_end_us"), "val").otherwise("test")


def split_by_flow(flows: DataFrame, limits: DataFrame) -> DataFrame:
    """Split by the flow's own time."""
    return flows.crossJoin(F.broadcast(limits)).withColumn("split", split_of(F.col(MS) * 1000)).drop(*limits.columns)


def split_by_window(windowed: DataFrame, limits: DataFrame, seconds: int = 30) -> DataFrame:
    """Split by the start of the window: a window goes as a whole."""
    start = F.col("start_us") + F.col("window_id") * (seconds * 1_000_000)
    return windowed.crossJoin(F.broadcast(limits)).withColumn("split", split_of(start)).drop(*limits.columns)


def snapshot_ordinal(spine: DataFrame) -> DataFrame:
    """Graph_Window_Idx: position in the split, empty snapshots counted. The spine
    has every window once, so the position follows from the split's first id."""
    first = F.broadcast(spine.groupBy("split").agg(F.min("window_id").alias("_first")))
    return spine.join(first, "split").withColumn("Graph_Window_Idx", F.col("window_id") - F.col("_first")).drop("_first")


def check_continuity(spine: DataFrame, seconds: int = 30) -> DataFrame:
    """Per split: snapshots, empty, gaps in ids, steps in time that are not the
    width. ``spine`` has split, window_id, window_start_ms, is_empty. The windows of a
    split are compared in ranges, not in one task."""
    step = with_previous(spine.select("split", "window_id", "window_start_ms", "is_empty"), ["split"], ["window_id"], ["window_id", "window_start_ms"])
    return step.groupBy("split").agg(
        F.count("*").alias("snapshots"),
        F.count_if("is_empty").alias("empty"),
        F.count_if(F.col("window_id") - F.col("prev_window_id") != 1).alias("id_gaps"),
        F.count_if(F.col("window_start_ms") - F.col("prev_window_start_ms") != seconds * 1000).alias("time_gaps"),
    )


def check_split_leakage(spine: DataFrame, limits: DataFrame) -> DataFrame:
    """Per split: snapshots whose start lies outside the split's limits, and the first of them."""
    want = split_of(F.col("window_start_ms") * 1000)
    rows = spine.crossJoin(F.broadcast(limits)).withColumn("bad", F.col("split") != want)
    return rows.groupBy("split").agg(F.count_if("bad").alias("outside"), F.min(F.when(F.col("bad"), F.col("window_id"))).alias("example"))


def snapshot_time_range(spine: DataFrame) -> DataFrame:
    return spine.groupBy("split").agg(F.count("*").alias("snapshots"), F.min("window_start_ms").alias("first_ms"), F.max("window_start_ms").alias("last_ms"))


def split_flow_counts(flows: DataFrame) -> DataFrame:
    return flows.groupBy("split").agg(F.count("*").alias("flows"), F.min(MS).alias("first_ms"), F.max(MS).alias("last_ms"))
