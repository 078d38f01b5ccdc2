"""Distributed order, mergeable state, idempotent writes, sketches and bucketed joins."""

import math
import random
import threading
import uuid

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from flowlens.functions import columns as C
from flowlens.functions import sql
from flowlens.operators import experiments, graph, metrics, profile, ranking, threat, windows
from flowlens.plans import report_queries
from flowlens.plans.fixtures import Tables
from flowlens.schema import NUMERIC
from flowlens.sources import io

from .conftest import SF


@pytest.fixture
def ranges(spark):
    """Many small ranges, so that runs of rows cross their boundaries."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "13")
    yield spark
    spark.conf.set(key, before)


def path(spark, name):
    return f"{ranking.shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def test_islands_cross_every_range(ranges):
    rng = random.Random(3)
    rows = [("a", i) for i in range(120)] + [("b", i) for i in range(0, 400, 5)] + [("c", 7), ("d", 1), ("d", 50)]
    rows += [("e", w) for w in sorted(rng.sample(range(500), 90))] + [(None, 1), (None, 2), (None, 9)]
    frame = ranges.createDataFrame(rows, "k string, w long")
    parts = ranking.ordered_parts(frame, ["k", "w"])
    assert parts.select("part").distinct().count() > 8
    assert parts.where("k = 'a'").select("part").distinct().count() > 2  # one island over several ranges
    last, number, want = {}, {}, {}
    for k, w in rows:
        number[k] = number.get(k, 0) + (k not in last or w - last[k] > 4)
        want[k, w] = (last.get(k), number[k])
        last[k] = w
    got = {(r["k"], r["w"]): r["prev_w"] for r in ranking.with_previous(frame, ["k"], ["w"], ["w"]).collect()}
    assert got == {k: v[0] for k, v in want.items()}
    whole = frame.where("k IS NOT NULL")
    got = {(r["k"], r["w"]): r["island"] for r in ranking.islands(whole, ["k"], ["w"], F.col("w") - F.col("prev_w") > 4).collect()}
    assert got == {k: v[1] for k, v in want.items() if k[0]}
    # no keys: one order over all rows
    assert {r["w"]: r["island"] for r in ranking.islands(frame.where("k = 'e'").select("w"), [], ["w"], F.col("w") - F.col("prev_w") > 4).collect()} == {w: v[1] for (k, w), v in want.items() if k == "e"}
    assert ranking.islands(whole.limit(0), ["k"], ["w"], F.lit(False)).count() == 0


def test_instances_and_continuity_over_ranges(ranges):
    rng = random.Random(4)
    rows = [(t, w) for t in "XYZ" for w in rng.sample(range(300), 80)]
    e = ranges.createDataFrame(rows, f"{threat.TACTIC} string, {threat.IDX} long")
    want = set()
    for t in "XYZ":
        ws = sorted(w for k, w in rows if k == t)
        start = ws[0]
        for a, b in zip(ws, [*ws[1:], None], strict=True):
            if b is None or b - a > 5:
                want.add((t, start, a))
                start = b
    assert {(r[0], r["start_idx"], r["end_idx"]) for r in threat.attack_instances(e).collect()} == want
    spine = ranges.range(200).select(F.when(F.col("id") < 150, "train").otherwise("test").alias("split"), F.col("id").alias("window_id"), (F.col("id") * 300_000 + F.when(F.col("id") == 90, 1).otherwise(0)).alias("window_start_ms"), (F.col("id") % 3 == 0).alias("is_empty"))
    got = {r["split"]: (r["snapshots"], r["id_gaps"], r["time_gaps"]) for r in windows.check_continuity(spine.where("window_id NOT IN (40, 170)"), 300).collect()}
    assert got == {"train": (149, 1, 3), "test": (49, 1, 1)}


def test_scaler_of_merged_chunks_is_that_of_one_pass(spark):
    t = Tables(spark, SF)
    train = t.saved(t.windowed())
    # large values with small spread: sums of squares alone would cancel
    train = train.withColumn("IN_BYTES", F.col("flow_ord") * 1000 + 10**9)
    chunks = t.saved(profile.moments(train.withColumn("chunk", (F.col("flow_ord") % 7).cast("string")), ["chunk"]))
    where = path(spark, "scaler")
    for part in (chunks.where("chunk < '3'"), chunks.where("chunk >= '3'"), chunks.where("chunk = '5'")):
        io.extend_scaler(part, where)
    once = {r["feature"]: r for r in profile.fit_scaler(train).collect()}
    for state in (chunks, io.load_scaler_state(spark, where), profile.merge_moments(chunks.where("chunk < '3'")).unionByName(profile.merge_moments(chunks.where("chunk >= '3'")))):
        got = {r["feature"]: r for r in profile.scaler_of(profile.merge_moments(state)).collect()}
        assert got.keys() == set(NUMERIC)
        for k, r in got.items():
            assert math.isclose(r["mean"], once[k]["mean"], rel_tol=1e-9, abs_tol=1e-12) and math.isclose(r["scale"], once[k]["scale"], rel_tol=1e-6 if k == "IN_BYTES" else 1e-9)
    none = profile.merge_moments(profile.moments(train.limit(0)))
    assert {(r["n"], r["mean"]) for r in none.collect()} == {(0, None)}


def test_run_log_survives_repeats_failures_and_writers_at_once(spark):
    log = path(spark, "log")
    runs = lambda lo, hi, extra=False: spark.createDataFrame([(f"m{i}", i, i / 7, *([i * 2] if extra else [])) for i in range(lo, hi)], "model_name string, seed int, f1 double" + (", epochs int" if extra else ""))
    io.append_run(log, runs(0, 40))
    io.append_run(log, runs(0, 40).repartition(5))  # the same rows in another order
    bad = F.udf(lambda i: 1 // (55 - i), "int")
    with pytest.raises(Exception) as failed:
        io.append_run(log, runs(40, 60).repartition(4).withColumn("f1", bad("seed").cast("double")))
    assert isinstance(failed.value, PythonException) or "ZeroDivisionError" in str(failed.value)
    rows = io.read_run_log(spark, log).collect()
    assert sorted(r["seed"] for r in rows) == list(range(40))
    threads = [threading.Thread(target=io.append_run, args=(log, runs(a, a + 20, extra=a > 60))) for a in (40, 60, 80, 40)]
    for th in threads:
        th.start()
    for th in threads:
        th.join()
    rows = io.read_run_log(spark, log).collect()
    assert sorted(r["seed"] for r in rows) == list(range(100)) and {r["epochs"] is None for r in rows if r["seed"] < 80} == {True}
    # a run that is appended anew with other values is read once, as it came last
    io.append_run(log, spark.createDataFrame([("m3", 3, 9.0)], "model_name string, seed int, f1 double"))
    once = {r["seed"]: r["f1"] for r in io.read_run_log(spark, log, ["model_name", "seed"]).collect()}
    assert len(once) == 100 and once[3] == 9.0 and once[4] == 4 / 7


def test_host_sketches_are_within_their_error(spark):
    n = 40_000
    flows = spark.range(n).select((F.col("id") % 4 * 100_000).alias("FLOW_START_MILLISECONDS"), F.concat(F.lit("s"), F.col("id")).alias("IPV4_SRC_ADDR"), F.concat(F.lit("s"), F.col("id") % 20_000 + 30_000).alias("IPV4_DST_ADDR"))
    exact = {(r["width_s"], r["window_ms"]): r for r in profile.unique_hosts(flows).collect()}
    got = {(r["width_s"], r["window_ms"]): r for r in profile.rolled_up(profile.host_sketches(flows)).collect()}
    assert exact.keys() == got.keys() and {k[0] for k in got} == {30, 60, 300}
    for k in got:
        for c in ("src_hosts", "dst_hosts", "hosts"):
            assert abs(got[k][c] / exact[k][c] - 1) < 4 / math.sqrt(4096)
    assert profile.unique_hosts(flows.limit(0)).count() == 0


def test_quantile_sketches_are_within_their_error(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    x = np.sort([r["IN_BYTES"] for r in t.flows().select("IN_BYTES").collect()])

    def rank(v):
        return np.searchsorted(x, v, "left") / len(x), np.searchsorted(x, v, "right") / len(x)

    from flowlens.plans.registry import QUERIES

    got = QUERIES["a13_describe_sketch"](spark, "/root/testdata/sf0.01").first()
    assert got["count"] == len(x)
    for c, p in profile.QUARTILES.items():
        lo, hi = rank(got[c])
        assert lo - 0.0165 <= p <= hi + 0.0165
    exact = {r["kind"]: r for r in QUERIES["g09_entropy_by_confusion"](spark, SF).collect()}
    for r in QUERIES["g09_entropy_sketch"](spark, SF).collect():
        assert r["count"] == exact[r["kind"]]["n"] and r["p25"] <= r["p50"] <= r["p75"]


def test_bucketed_tables_are_joined_without_an_exchange(spark):
    t = Tables(spark, SF)
    edges, hosts = report_queries.means(t)
    names = {n: f"t_{uuid.uuid4().hex}" for n in ("edges", "hosts")}
    for n, frame in (("edges", edges), ("hosts", hosts)):
        io.write_buckets(frame, names[n], path(spark, n), 8)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # the tables are small, and would be broadcast
    try:
        with io.colocated(spark):
            rep = graph.edge_representation(spark.table(names["edges"]), spark.table(names["hosts"]))
            plan = rep._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") == 2
            assert rep.count() == edges.count()
        loose = graph.edge_representation(spark.table(names["edges"]), spark.table(names["hosts"]))
        assert "Exchange" in loose._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
        for n in names.values():
            spark.sql(f"DROP TABLE {n}")


def test_tactics_in_sql(spark):
    sql.register(spark)
    net = "'10.0.0.0/8'"
    rows = [(s, d, r) for s in ("10.0.0.1", "9.9.9.9", "1.1.1.1", "Unknown", None) for d in ("10.1.2.3", "8.8.8.8", "::1") for r in (*C.ROLES, None)]
    f = spark.createDataFrame(rows, "Source_IP string, Dest_IP string, Port_Category string")
    mine = f.selectExpr("*", f"mitre_tactic(Source_IP, Dest_IP, Port_Category, array('9.9.9.9'), array('8.8.8.8'), {net}) AS a", f"canonical_tactic(mitre_tactic(Source_IP, Dest_IP, Port_Category, array('9.9.9.9'), array('8.8.8.8'), {net})) AS b")
    ips = lambda x: spark.createDataFrame([(x,)], "ip string")
    theirs = threat.label_events(f, ips("8.8.8.8"), ips("9.9.9.9"), "10.0.0.0/8")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, mine.collect())) == sorted(map(key, theirs.select(*f.columns, "MITRE_Tactic", threat.TACTIC).collect()))


def test_rethreshold_equals_metrics_at_the_best_threshold(spark):
    rng = random.Random(6)
    rows = [(e, s, rng.randint(0, 30) / 30, int(rng.random() < 0.4 and e != "one")) for e in ("a", "b", "one") for s in (1, 2) for _ in range(40)]
    scored = spark.createDataFrame(rows, "experiment string, seed int, Probability double, y_real int")
    old = scored.select("experiment", "seed").distinct().where("NOT (experiment = 'b' AND seed = 2)").withColumn("optimal_threshold", F.lit(0.5))
    got = {(r["experiment"], r["seed"]): r.asDict() for r in metrics.rethreshold(scored, old).collect()}
    best = spark.createDataFrame([(*k, r["optimal_threshold"]) for k, r in got.items()], "experiment string, seed int, optimal_threshold double")
    for frame, prefix in ((best, ""), (old, "old_")):
        for r in metrics.apply_saved_thresholds(scored, frame).collect():
            mine = got[r["experiment"], r["seed"]]
            for c in ("TP", "FP", "TN", "FN", "Precision", "Recall", "F1", "F2", "FPR", "Total_Flows", "AUC_ROC", "AUC_PR", "optimal_threshold") if not prefix else ("Precision", "Recall", "F1", "optimal_threshold"):
                assert math.isclose(mine[prefix + c], r[c], abs_tol=1e-12), (c, r)
    assert len(got) == 6 and got["b", 2]["old_F1"] is None


def test_best_epoch_is_the_historys_own(spark):
    rows = [("e", 1, [0.5, 0.4], [0.6, 0.7], 0), ("e", 2, [0.9, 0.8, 0.7], [0.9, 0.8, 0.6], 2), ("f", 1, [], [], None)]
    h = spark.createDataFrame([(e, s, (a, b), (k,)) for e, s, a, b, k in rows], "experiment string, seed int, training struct<train_loss:array<double>,val_loss:array<double>>, early_stopping struct<best_epoch:int>")
    long = experiments.history_rows(h)
    assert {tuple(r) for r in experiments.loss_by_seed(long).collect()} == {("e", 1, 0, 0.5, 0.6, True), ("e", 1, 1, 0.4, 0.7, False), ("e", 2, 0, 0.9, 0.9, False), ("e", 2, 1, 0.8, 0.8, False), ("e", 2, 2, 0.7, 0.6, True)}
    curve = {r["epoch"]: (round(r["mean"], 6), r["seeds"]) for r in experiments.loss_curve(long, "val_loss").collect()}
    assert curve == {0: (0.75, 2), 1: (0.75, 2)}
