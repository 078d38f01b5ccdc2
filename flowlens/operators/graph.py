"""Host-to-host graph snapshots and features of hosts and edges.

Tables are flat: ``edges`` has one row for each flow of a window, ``nodes`` one
for each host of a window. Hot hosts are aggregated by (window, host, role) or by
pair before anything joins on the host alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ROLES, decode_role
from .profile import quantile_sketches
from .ranking import dense_ranks, quantiles, shared_table

SRC, DST = "IPV4_SRC_ADDR", "IPV4_DST_ADDR"


def host_ids(windowed: DataFrame) -> DataFrame:
    """ip, global_id: dense numbers by first appearance. Windows ascend; within a
    window all sources come before all destinations, each in flow order."""
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(SRC).alias("ip")), F.struct(F.lit(1).alias("side"), F.col(DST).alias("ip"))))
    first = windowed.select("window_id", "flow_ord", ends.alias("e")).groupBy("e.ip").agg(F.min(F.struct("window_id", "e.side", "flow_ord")).alias("first"))
    return dense_ranks(first, ["first", "ip"]).select("ip", F.col("rank").alias("global_id"))


def local_ids(windowed: DataFrame, hosts: DataFrame) -> DataFrame:
    """window_id, ip, global_id, local_id: dense order of the global ids in each window."""
    both = windowed.select("window_id", F.explode(F.array(SRC, DST)).alias("ip")).distinct().join(hosts.select("ip", "global_id"), "ip")
    w = Window.partitionBy("window_id").orderBy("global_id")
    return both.withColumn("local_id", F.dense_rank().over(w) - 1).select("window_id", "ip", "global_id", "local_id")


def snapshot_edges(windowed: DataFrame, nodes: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """window_id, edge_ord, src_id, dst_id, src_local, dst_local and the columns of
    ``extra``: one join with the nodes for each end."""
    of = lambda end, p: nodes.select("window_id", F.col("ip").alias(end), F.col("global_id").alias(f"{p}_id"), F.col("local_id").alias(f"{p}_local"))
    e = windowed.join(of(SRC, "src"), ["window_id", SRC]).join(of(DST, "dst"), ["window_id", DST])
    return e.select("window_id", F.col("flow_ord").alias("edge_ord"), "src_id", "dst_id", "src_local", "dst_local", *[c.alias(k) for k, c in (extra or {}).items()])


def snapshot_nested(edges: DataFrame, nodes: DataFrame, spine: DataFrame) -> DataFrame:
    """One row for each window with its nodes and edges as arrays, empty where
    idle. A snapshot is the unit of the output, so its rows meet in one task."""
    e = edges.groupBy("window_id").agg(F.sort_array(F.collect_list(F.struct("edge_ord", "src_local", "dst_local"))).alias("edges"))
    n = nodes.groupBy("window_id").agg(F.sort_array(F.collect_list(F.struct("local_id", "global_id"))).alias("nodes"))
    out = spine.select("window_id", "is_empty").join(e, "window_id", "left").join(n, "window_id", "left")
    kinds = {c: out.schema[c].dataType for c in ("edges", "nodes")}
    return out.select("window_id", "is_empty", *[F.coalesce(c, F.array().cast(k)).alias(c) for c, k in kinds.items()])


def multigraph_stats(edges: DataFrame) -> DataFrame:
    """window_id, edges, unique pairs, most parallel edges."""
    pairs = edges.groupBy("window_id", "src_id", "dst_id").agg(F.count("*").alias("n"))
    return pairs.groupBy("window_id").agg(F.sum("n").alias("edges"), F.count("*").alias("unique_edges"), F.max("n").alias("max_parallel"))


def multigraph_summary(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count_if(F.col("max_parallel") > 1).alias("multigraph_windows"), F.max("max_parallel").alias("max_parallel"), F.sum("edges").alias("edges"), F.sum("unique_edges").alias("unique_edges"))


def attack_pairs(flows: DataFrame, top: int = 20, y: str = "y_real") -> DataFrame:
    out = flows.where(F.col(y) == 1).groupBy(SRC, DST).agg(F.count("*").alias("attacks"))
    return out.orderBy(F.desc("attacks"), SRC, DST).limit(top)


def host_profile(flows: DataFrame, candidates: DataFrame) -> DataFrame:
    """ip, out_degree, in_degree, flows_out, flows_in of the candidates. Flows are
    summed by pair first; a pair then counts once at either end."""
    pairs = flows.groupBy(SRC, DST).agg(F.count("*").alias("n"))
    ends = F.explode(F.array(F.struct(F.col(SRC).alias("ip"), F.lit(True).alias("out")), F.struct(F.col(DST).alias("ip"), F.lit(False).alias("out"))))
    each = pairs.select("n", ends.alias("e")).select("n", "e.*").join(candidates.select("ip").distinct(), "ip", "left_semi")
    count = lambda side: F.count_if(F.col("out") if side else ~F.col("out"))
    total = lambda side: F.sum(F.when(F.col("out") if side else ~F.col("out"), F.col("n")).otherwise(0))
    return each.groupBy("ip").agg(count(True).alias("out_degree"), count(False).alias("in_degree"), total(True).alias("flows_out"), total(False).alias("flows_in"))


def port_entropy(flows: DataFrame, role: str = "Port_Category", normalise: bool = True) -> DataFrame:
    """window_id, ip, out_entropy, in_entropy: Shannon entropy (bits) of the roles
    over the host's outgoing and incoming edges, 0 where it has none, divided by
    log2(7) if normalised. Counts by (window, host, role) come first, so a hot
    host is at most seven rows of a window."""
    ends = F.explode(F.array(F.struct(F.col(SRC).alias("ip"), F.lit(True).alias("out")), F.struct(F.col(DST).alias("ip"), F.lit(False).alias("out"))))
    n = flows.select("window_id", role, ends.alias("e")).groupBy("window_id", "e.ip", "e.out", role).agg(F.count("*").cast("double").alias("n"))
    # -sum(p log2 p) = log2(N) - sum(n log2 n) / N
    h = n.groupBy("window_id", "ip", "out").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    value = F.greatest(F.log2("all") - F.col("s") / F.col("all"), F.lit(0.0)) / (math.log2(len(ROLES)) if normalise else 1.0)
    side = lambda out: F.coalesce(F.max(F.when(F.col("out") if out else ~F.col("out"), value)), F.lit(0.0))
    return h.groupBy("window_id", "ip").agg(side(True).alias("out_entropy"), side(False).alias("in_entropy"))


def entropy_by_confusion(flows: DataFrame, entropy: DataFrame, kind: Column) -> DataFrame:
    """kind, n, mean and quartiles of the source's outgoing and the destination's incoming entropy."""
    e = flows.withColumn("kind", kind)
    e = e.join(entropy.select("window_id", F.col("ip").alias(SRC), "out_entropy"), ["window_id", SRC]).join(entropy.select("window_id", F.col("ip").alias(DST), "in_entropy"), ["window_id", DST])
    e = shared_table(e.groupBy("kind", "out_entropy", "in_entropy").agg(F.count("*").alias("n")))
    out = e.groupBy("kind").agg(F.sum("n").alias("n"), *[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"{c}_mean") for c in ("out_entropy", "in_entropy")])
    for c in ("out_entropy", "in_entropy"):
        out = out.join(quantiles(e.groupBy("kind", c).agg(F.sum("n").alias("n")), c, {f"{c}_p25": 0.25, f"{c}_p50": 0.5, f"{c}_p75": 0.75}, ["kind"]), "kind")
    return out


def entropy_sketches(flows: DataFrame, entropy: DataFrame, kind: Column, by: Sequence[str] = ()) -> DataFrame:
    """by, kind, side, sketch: KLL sketches of the source's outgoing and the destination's
    incoming entropy, of every flow, which ``profile.describe_sketches`` merges."""
    e = flows.select(*by, "window_id", SRC, DST, kind.alias("kind"))
    e = e.join(entropy.select("window_id", F.col("ip").alias(SRC), "out_entropy"), ["window_id", SRC]).join(entropy.select("window_id", F.col("ip").alias(DST), "in_entropy"), ["window_id", DST])
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("value")) for c in ("out_entropy", "in_entropy")]))
    return quantile_sketches(e.select(*by, "kind", sides.alias("e")).select(*by, "kind", "e.*"), "value", [*by, "kind", "side"])


def vector_sum(vector: str, size: int, weight: Column | None = None) -> Column:
    """Aggregate: the sum of the vectors in an array column, entry by entry, null entries
    as 0, times ``weight``. Its parts are plain sums, so that every task adds up what it has
    before anything is shuffled, and no vector is taken apart into rows."""

    def entry(i: int) -> Column:
        x = F.coalesce(F.get(vector, F.lit(i)).cast("double"), F.lit(0.0))
        return F.coalesce(F.sum(x if weight is None else x * weight), F.lit(0.0))

    return F.array(*map(entry, range(size)))


def neighbour_mean(edges: DataFrame, size: int, vector: str = "features", src: str = "src_id", dst: str = "dst_id") -> DataFrame:
    """window_id, host, out, in: the mean vector over the host's outgoing and over its
    incoming edges, zeros where it has none. Either side is one aggregate by (window,
    host), whose partial sums make a hot host one row of a task; they are joined where
    these aggregates leave them."""

    def side(host: str, name: str) -> DataFrame:
        sums = edges.groupBy("window_id", F.col(host).alias("host")).agg(vector_sum(vector, size).alias("s"), F.count("*").alias("n"))
        return sums.select("window_id", "host", F.transform("s", lambda v: v / F.col("n")).alias(name))

    none = F.array_repeat(F.lit(0.0), size)
    both = side(src, "out").join(side(dst, "in"), ["window_id", "host"], "full")
    return both.select("window_id", "host", F.coalesce("out", none).alias("out"), F.coalesce("in", none).alias("in"))


def host_vector(means: DataFrame) -> DataFrame:
    """window_id, host, vector: outgoing and incoming means in one array."""
    return means.select("window_id", "host", F.concat("out", "in").alias("vector"))


def two_hop_mean(edges: DataFrame, hosts: DataFrame, size: int, src: str = "src_id", dst: str = "dst_id") -> DataFrame:
    """Per host the mean of its incoming neighbours' vectors (``hosts``: window_id, host,
    vector), once for each edge, zeros where there are none."""
    pairs = edges.groupBy("window_id", src, dst).agg(F.count("*").alias("n"))
    got = pairs.join(hosts.withColumnRenamed("host", src), ["window_id", src])
    sums = got.groupBy("window_id", F.col(dst).alias("host")).agg(vector_sum("vector", size, F.col("n")).alias("s"), F.sum("n").alias("n"))
    mean = sums.select("window_id", "host", F.transform("s", lambda v: v / F.col("n")).alias("hop2"))
    out = hosts.select("window_id", "host").join(mean, ["window_id", "host"], "left")
    return out.withColumn("hop2", F.coalesce("hop2", F.array_repeat(F.lit(0.0), size)))


def edge_representation(edges: DataFrame, hosts: DataFrame, src: str = "src_id", dst: str = "dst_id") -> DataFrame:
    """Edges with the columns of both ends, prefixed src_ and dst_. Tables that are bucketed
    by window (``io.write_buckets``) are joined where they lie."""
    values = [c for c in hosts.columns if c not in ("window_id", "host")]
    of = lambda end, p: hosts.select("window_id", F.col("host").alias(end), *[F.col(v).alias(f"{p}_{v}") for v in values])
    return edges.join(of(src, "src"), ["window_id", src]).join(of(dst, "dst"), ["window_id", dst])


def host_memory(hosts: DataFrame, size: int, vector: str = "vector", alpha: float = 0.5) -> DataFrame:
    """window_id, host, memory: h = alpha x + (1 - alpha) h_before over the vectors of the
    host's active windows, starting from zeros. A host's windows are cut into blocks as
    long as a weight still shows in a double; within a block the recursion is a running
    sum of scaled vectors, and the end of the block before it, scaled down, stands for all
    that came earlier, so that work for a row does not grow with the host's history."""
    reach = math.ceil(math.log(2**-60) / math.log(1 - alpha)) if 0 < alpha < 1 else 1
    w = Window.partitionBy("host").orderBy("window_id")
    r = hosts.withColumn("r", F.row_number().over(w) - 1).withColumns({"block": F.floor(F.col("r") / reach), "at": F.col("r") % reach})
    keep = lambda n: F.pow(F.lit(1.0 - alpha), n)
    inside = Window.partitionBy("host", "block").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    scaled = [F.sum(F.coalesce(F.get(vector, F.lit(i)).cast("double"), F.lit(0.0)) * (alpha / keep(F.col("at")))).over(inside) for i in range(size)]
    own = r.select("host", "window_id", "at", F.array(*scaled).alias("s")).withColumn("own", F.transform("s", lambda v: v * keep(F.col("at"))))
    before = F.last(F.when(F.col("at") == reach - 1, F.col("own")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    both = F.zip_with("own", "before", lambda a, b: a + b * keep(F.col("at") + 1))
    return own.withColumn("before", before).select("window_id", "host", F.when(F.col("before").isNull(), F.col("own")).otherwise(both).alias("memory"))


def roles_of(edges: DataFrame) -> DataFrame:
    return edges.withColumn("Port_Category", decode_role("features"))
