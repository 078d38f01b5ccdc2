"""Cleaning, profiles and grouped counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ATTACK, coerce_numeric, label_flag, log_features
from ..schema import NUMERIC
from .ranking import quantiles, shared_table


def drop_header_rows(raw: DataFrame, column: str = "Timestamp") -> DataFrame:
    """Rows that repeat the header; nulls stay."""
    return raw.where(~F.col(column).eqNullSafe(column))


def value_counts(rows: DataFrame, column: str, top: int | None = None) -> DataFrame:
    out = rows.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)
    return out.limit(top) if top else out


def is_attack() -> Column:
    return F.col("Attack") == ATTACK


def hour_distribution(flows: DataFrame, ts: str = "FLOW_START_TIME") -> DataFrame:
    """hour, benign, attack, ratio of attack to all; hours without flows do not occur."""
    out = flows.groupBy(F.hour(ts).alias("hour")).agg(F.count_if(~is_attack()).alias("benign"), F.count_if(is_attack()).alias("attack"))
    return out.withColumn("ratio", F.coalesce(F.try_divide(F.col("attack"), F.col("attack") + F.col("benign")), F.lit(0.0)))


def both_ends(rows: DataFrame, *keep: Column) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("IPV4_SRC_ADDR").alias("ip"), F.lit(True).alias("src")), F.struct(F.col("IPV4_DST_ADDR").alias("ip"), F.lit(False).alias("src"))))
    kept = rows.select(*keep, ends.alias("e"))
    return kept.select(*[c for c in kept.columns if c != "e"], "e.*")


def unique_hosts(flows: DataFrame, widths: Sequence[int] = (30, 60, 300), ms: str = "FLOW_START_MILLISECONDS") -> DataFrame:
    """width_s, window_ms (clock-anchored), distinct sources, destinations, and either. Flows
    are read once, at the first width, of which the others are multiples; a host counts
    once for each of its windows there, and the wider windows are made of these."""
    base = widths[0] * 1000
    hosts = both_ends(flows, F.expr(f"{ms} div {base} * {base}").alias("window_ms"))
    each = shared_table(hosts.groupBy("window_ms", "ip").agg(F.max("src").alias("s"), F.max(~F.col("src")).alias("d")))
    out = None
    for width in widths:
        at = F.expr(f"window_ms div {width * 1000} * {width * 1000}").alias("window_ms")
        wide = each if width == widths[0] else each.groupBy(at, "ip").agg(F.max("s").alias("s"), F.max("d").alias("d"))
        n = wide.groupBy(F.lit(width).alias("width_s"), "window_ms").agg(F.count_if("s").alias("src_hosts"), F.count_if("d").alias("dst_hosts"), F.count("*").alias("hosts"))
        out = n if out is None else out.unionByName(n)
    return out


def host_sketches(flows: DataFrame, width: int = 30, lg: int = 12, ms: str = "FLOW_START_MILLISECONDS") -> DataFrame:
    """window_ms, src, dst: theta sketches of the distinct sources and destinations."""
    at = F.expr(f"{ms} div {width * 1000} * {width * 1000}").alias("window_ms")
    return flows.groupBy(at).agg(F.theta_sketch_agg("IPV4_SRC_ADDR", F.lit(lg)).alias("src"), F.theta_sketch_agg("IPV4_DST_ADDR", F.lit(lg)).alias("dst"))


def rolled_up(sketches: DataFrame, widths: Sequence[int] = (30, 60, 300), lg: int = 12) -> DataFrame:
    """``unique_hosts`` from sketches of the first width: wider windows are unions of
    sketches, and hosts of either kind the union of both. Counts are exact up to 2^lg
    hosts in a window, and have a relative standard error of 1 / sqrt(2^lg) beyond."""
    out = None
    for width in widths:
        at = F.expr(f"window_ms div {width * 1000} * {width * 1000}").alias("window_ms")
        wide = sketches if width == widths[0] else sketches.groupBy(at).agg(*[F.theta_union_agg(c, F.lit(lg)).alias(c) for c in ("src", "dst")])
        n = wide.select(F.lit(width).alias("width_s"), "window_ms", *[F.theta_sketch_estimate(c).alias(f"{c}_hosts") for c in ("src", "dst")], F.theta_sketch_estimate(F.theta_union("src", "dst", F.lit(lg))).alias("hosts"))
        out = n if out is None else out.unionByName(n)
    return out


def flows_per_pair_window(windowed: DataFrame) -> DataFrame:
    return windowed.groupBy("window_id", "IPV4_SRC_ADDR", "IPV4_DST_ADDR").agg(F.count("*").alias("flows"))


def pair_attack_pivot(windowed: DataFrame) -> DataFrame:
    """Benign and attack flows by window and pair, in columns."""
    keys = ["window_id", "IPV4_SRC_ADDR", "IPV4_DST_ADDR"]
    return windowed.groupBy(*keys).pivot("Attack", ["Benign", ATTACK]).agg(F.count(F.lit(1))).fillna(0)


def mixed_pairs(pivot: DataFrame, only_attack: bool = False) -> DataFrame:
    benign = F.col("Benign") == 0 if only_attack else F.col("Benign") > 0
    return pivot.where((F.col(ATTACK) > 0) & benign)


def class_balance(flows: DataFrame) -> DataFrame:
    """pos, neg, pos_weight, bias; the last two null without positives."""
    y = label_flag()
    out = flows.agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    some = F.col("pos") > 0
    return out.withColumn("pos_weight", F.when(some, F.col("neg") / F.col("pos"))).withColumn("bias", F.when(some & (F.col("neg") > 0), F.log(F.col("pos") / F.col("neg"))))


def moments(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, feature, n, mean, m2 (sum of squares about the mean) of the log features: a
    state that further rows extend through ``merge_moments``. Nulls do not count."""
    logs = log_features()
    of = lambda x: F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"))
    one = rows.groupBy(*keys).agg(*[of(logs[c]).alias(c) for c in NUMERIC])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)["n"].alias("n"), F.col(c)["mean"].alias("mean"), F.col(c)["m2"].alias("m2")) for c in NUMERIC]))
    return one.select(*keys, each.alias("s")).select(*keys, "s.*")


def merge_moments(states: DataFrame) -> DataFrame:
    """feature, n, mean, m2 of all states together; what is added to the states' own sums
    of squares is how far their means lie from the common one, so nothing cancels."""
    some = states.where("n > 0")
    whole = some.groupBy("feature").agg(F.sum("n").alias("all"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("middle"))
    # a row for each feature
    both = some.join(F.broadcast(whole), "feature")
    square = F.col("m2") + F.col("n") * (F.col("mean") - F.col("middle")) ** 2
    out = both.groupBy("feature").agg(F.first("all").alias("n"), F.first("middle").alias("mean"), F.sum(square).alias("m2"))
    # a feature without a number in any state keeps its row
    return states.select("feature").distinct().join(out, "feature", "left").fillna(0, ["n"])


def scaler_of(state: DataFrame) -> DataFrame:
    """feature, mean, scale: population deviation, 0 becomes 1."""
    scale = F.sqrt(F.col("m2") / F.col("n"))
    return state.select("feature", "mean", F.when(F.col("n") > 0, F.when(scale == 0, 1.0).otherwise(scale)).alias("scale"))


def fit_scaler(train: DataFrame) -> DataFrame:
    """feature, mean, scale of the log features, in one pass."""
    return scaler_of(moments(train))


def apply_scaler(flows: DataFrame, params: DataFrame) -> DataFrame:
    """The numeric features as (log1p - mean) / scale. Parameters are 20 rows, turned into one by broadcast."""
    wide = params.groupBy().pivot("feature", list(NUMERIC)).agg(F.first(F.struct("mean", "scale")))
    logs = log_features()
    joined = flows.crossJoin(F.broadcast(wide.toDF(*[f"_{c}" for c in NUMERIC])))
    return joined.withColumns({c: (logs[c] - F.col(f"_{c}.mean")) / F.col(f"_{c}.scale") for c in NUMERIC}).drop(*[f"_{c}" for c in NUMERIC])


def null_profile(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, nulls; only columns that have some."""
    columns = list(columns or rows.columns)
    one = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "nulls").where("nulls > 0")


def labels_of_missing(rows: DataFrame, column: str, label: str = "Label") -> DataFrame:
    return rows.where(F.col(column).isNull()).groupBy(label).agg(F.count("*").alias("count"))


def non_numeric_profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value, n: the distinct texts of each column that are no numbers."""
    long = rows.unpivot([], list(columns), "column", "value")
    return long.where(F.col("value").isNotNull() & coerce_numeric("value").isNull()).groupBy("column", "value").agg(F.count("*").alias("n"))


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def describe(rows: DataFrame, column: str) -> DataFrame:
    """count, mean, std (sample), min, quartiles (linear), max."""
    first = [F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min")]
    exact = quantiles(rows.groupBy(column).agg(F.count("*").alias("n")), column, QUARTILES)
    return rows.agg(*first, F.max(column).alias("max")).crossJoin(exact).select("count", "mean", "std", "min", *QUARTILES, "max")


def quantile_sketches(rows: DataFrame, column: str, keys: Sequence[str] = (), k: int = 200) -> DataFrame:
    """keys, sketch: KLL sketches of a column, mergeable over any of the keys. With k = 200
    ranks are off by at most about 1.65 % of the rows, with 99 % confidence."""
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(k)).alias("sketch"))


def describe_sketches(sketches: DataFrame, keys: Sequence[str] = (), shares: dict[str, float] = QUARTILES, k: int = 200) -> DataFrame:
    """keys, count and quantiles of the merged sketches: values that occur in the rows."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    return merged.select(*keys, F.kll_sketch_get_n_double("sketch").alias("count"), *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(n) for n, p in shares.items()])


def content_stats(edges: DataFrame, sample: int = 50) -> DataFrame:
    """window_id, flows, attacks, attack_pct, bad (rows whose features hold null,
    NaN or an infinity), on a sample of windows chosen by the hash of their id."""
    windows = edges.select("window_id").distinct()
    chosen = windows.orderBy(F.md5(F.col("window_id").cast("string")), "window_id").limit(sample)
    bad = F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        edges.join(chosen, "window_id", "left_semi")
        .groupBy("window_id")
        .agg(F.count("*").alias("flows"), F.sum("y").alias("attacks"), (F.sum("y") * 100.0 / F.count("*")).alias("attack_pct"), F.count_if(bad).alias("bad"))
    )


def split_summary(edges: DataFrame, nodes: DataFrame, spine: DataFrame) -> DataFrame:
    """One row for each split: snapshots, flows, classes, hosts and times."""
    e = edges.groupBy("split").agg(F.count("*").alias("flows"), F.sum("y").alias("attack"))
    # distinct hosts first by host, then counted: no distinct over raw occurrences
    n = nodes.groupBy("split", "global_id").agg(F.count("*").alias("k")).groupBy("split").agg(F.sum("k").alias("node_occurrences"), F.count("*").alias("distinct_nodes"))
    s = spine.groupBy("split").agg(F.count("*").alias("snapshots"), F.count_if("is_empty").alias("empty"), F.min("window_start_ms").alias("start_ms"), F.max("window_start_ms").alias("end_ms"))
    out = s.join(e, "split", "left").join(n, "split", "left").fillna(0)
    benign = F.col("flows") - F.col("attack")
    return out.select(
        "split", "snapshots", "empty", (F.col("empty") / F.col("snapshots")).alias("empty_ratio"), "flows", "attack", benign.alias("benign"),
        F.when(F.col("flows") > 0, F.col("attack") / F.col("flows")).otherwise(0.0).alias("positive_rate"),
        "node_occurrences", "distinct_nodes", "start_ms", "end_ms",
        F.when(F.col("attack") > 0, benign / F.col("attack")).otherwise(float("inf")).alias("benign_per_attack"),
    )


def verify_entropy(edges: DataFrame, entropy: DataFrame, spine: DataFrame) -> DataFrame:
    """One row: edges without a role, range of the normalised entropies, snapshots
    with a value above 1, empty snapshots."""
    top = F.greatest("out_entropy", "in_entropy")
    e = edges.agg(F.count_if(F.forall(F.slice("features", 1, 7), lambda v: v == 0)).alias("edges_without_role"))
    h = entropy.agg(F.min(F.least("out_entropy", "in_entropy")).alias("min_entropy"), F.max(top).alias("max_entropy"))
    above = entropy.where(top > 1 + 1e-9).select("window_id").distinct().agg(F.count("*").alias("windows_above_one"))
    s = spine.agg(F.count_if("is_empty").alias("empty"))
    return e.crossJoin(h).crossJoin(above).crossJoin(s)
