"""Traps and edge cases on hand-made frames, and properties against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions import columns as C
from flowlens.operators import experiments, graph, metrics, ml, profile, ranking, threat, windows
from flowlens.plans import flow_queries, report_queries  # noqa: F401
from flowlens.plans.fixtures import Tables
from flowlens.schema import NUMERIC
from flowlens.sources import io

from .conftest import SF


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {t}" for k, t in _types(cols))).select(expr.alias("x")).first()["x"]


def _types(cols):
    kinds = {int: "int", float: "double", str: "string", type(None): "string", bool: "boolean"}
    return [(k, kinds[type(v)]) for k, v in cols.items()]


def test_roles_exclusive_and_overlapping(spark):
    ports = [0, 1023, 1024, 8080, 3389, 445, 53, 3306, 5432]
    rows = spark.createDataFrame([(p,) for p in ports], "L4_DST_PORT int").select("L4_DST_PORT", C.port_role().alias("role"), *[v.alias(k) for k, v in C.port_role_flags().items()]).collect()
    by = {r["L4_DST_PORT"]: r for r in rows}
    assert [by[p]["role"] for p in (0, 1023, 1024, 8080, 3389)] == [C.ROLES[5], C.ROLES[5], C.ROLES[6], "Web", "Admin/Remote"]
    assert by[8080]["Role_Web"] == by[8080]["Role_HighPriv"] == 1 and by[0]["Role_LowPriv"] == 1


def test_protocols(spark):
    got = [r[0] for r in spark.createDataFrame([(p,) for p in (1, 2, 6, 17, 47, 58)], "PROTOCOL int").select(C.protocol_class()).collect()]
    assert got == ["ICMP", "IGMP", "TCP", "UDP", "Other", "ICMP"]


def test_log1p_null_at_and_below_minus_one(spark):
    x = spark.createDataFrame([(-1.0,), (-2.0,), (0.0,)], "v double").select(F.log1p("v").alias("l")).collect()
    assert [r["l"] for r in x] == [None, None, 0.0]


@pytest.mark.parametrize(("ip", "want"), [("172.31.0.0", True), ("172.31.255.255", True), ("172.32.0.0", False), ("Unknown", None), ("::1", None), ("1.2.3.999", None), (None, None)])
def test_cidr(spark, ip, want):
    assert one(spark, C.in_cidr("ip", "172.31.0.0/16"), ip=ip) is want


def test_unknown_host_gets_unknown_tactic(spark):
    f = spark.createDataFrame([("Unknown", "172.31.0.1", "Web")], "Source_IP string, Dest_IP string, Port_Category string")
    none = spark.createDataFrame([], "ip string")
    assert threat.label_events(f, none, none).first()["MITRE_Tactic_Base"] == "Unknown"


def test_windows_anchor_before_filter_and_fill(spark):
    f = spark.createDataFrame([(1, 1_000, "0.0.0.0", "a"), (2, 31_000, "b", "a"), (3, 130_000, "b", "a")], "flow_ord long, FLOW_START_MILLISECONDS long, IPV4_SRC_ADDR string, IPV4_DST_ADDR string")
    w = windows.assign_window(f, 30).where(C.valid_ips())
    assert [r["window_id"] for r in w.orderBy("flow_ord").collect()] == [1, 4]
    assert [(r[0], r[1], r[2]) for r in windows.fill_empty_windows(w).orderBy("window_id").collect()] == [(0, 0, True), (1, 1, False), (2, 0, True), (3, 0, True), (4, 1, False)]
    after = windows.assign_window(f.where(C.valid_ips()), 30, windows.extent(f, after_filter=True))
    assert [r["window_id"] for r in after.orderBy("flow_ord").collect()] == [0, 3]
    assert windows.fill_empty_windows(w.limit(0)).count() == 0 and windows.resample(f.limit(0), 30).count() == 0


def scored(spark, rows):
    return spark.createDataFrame([(float(s), int(y)) for s, y in rows], "Probability double, y_real int")


def brute(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    ap, last, best = 0.0, 0.0, (-1, 0)
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        p, r = tp / (tp + fp), tp / len(pos)
        ap += (r - last) * p
        last = r
        best = max(best, (2 * p * r / (p + r + 1e-10), -t))
    return ap, auc, -best[1]


def test_curves_equal_brute_force(spark):
    rng = random.Random(0)
    for _ in range(3):
        rows = [(rng.choice([0.1, 0.2, 0.3, 0.5, 0.7, 0.9]), rng.random() < 0.4) for _ in range(60)]
        points = metrics.curve(scored(spark, rows))
        ap, auc, t = brute(rows)
        assert math.isclose(metrics.average_precision(points).first()[0], ap, rel_tol=1e-9)
        assert math.isclose(metrics.roc_auc(points).first()[0], auc, rel_tol=1e-9)
        assert metrics.best_threshold_f1(metrics.pr_curve(points)).first()["threshold"] == t


def test_one_class_and_equal_threshold(spark):
    m = metrics.binary_metrics(scored(spark, [(0.7, 1), (0.9, 1)]), 0.7).first()
    assert (m["TP"], m["FN"], m["AUC_PR"], m["AUC_ROC"]) == (1, 1, 0.0, 0.5)
    assert metrics.confusion_counts(scored(spark, [(0.7, 1)]), 0.7, inclusive=True).first()["TP"] == 1
    assert metrics.binary_metrics(scored(spark, [(0.1, 0)]), 0.7).first()["Precision"] == 0.0


def test_distributed_ranks_and_sums_equal_plain_windows(spark):
    rng = np.random.default_rng(1)
    x = rng.permutation(500).tolist()
    frame = spark.createDataFrame([(i, i % 7) for i in x], "k long, v long")
    assert all(r["rank"] == r["k"] for r in ranking.dense_ranks(frame, ["k"]).collect())
    sums = np.cumsum([i % 7 for i in range(500)])
    assert all(r["cum_v"] == sums[r["k"]] for r in ranking.running_sums(frame, ["k"], ["v"]).collect())


def test_instances_gap_of_five_and_six(spark):
    e = spark.createDataFrame([("A", w) for w in (1, 6, 12, 12)] + [("B", 3)], "MITRE_Tactic_Base string, Graph_Window_Idx long")
    got = {(r[0], r[2], r[3]) for r in threat.attack_instances(e).collect()}
    assert got == {("A", 1, 6), ("A", 12, 12), ("B", 3, 3)}


def events(spark, rows):
    return spark.createDataFrame(rows, "Graph_Window_Idx long, Source_IP string, Dest_IP string, MITRE_Tactic_Base string, y_real int, y_pred int, Probability double")


def test_undetected_instances_and_tactics(spark):
    e = events(spark, [(1, "a", "b", "X", 1, 0, 0.1), (9, "a", "b", "X", 1, 1, 0.9), (2, "a", "b", "Y", 1, 0, 0.1)])
    m = {r["MITRE_Tactic_Base"]: r for r in threat.mttd(e, 60).collect()}
    assert (m["X"]["instances"], m["X"]["detected"], m["X"]["std_ttd_min"]) == (2, 1, 0.0) and m["Y"]["mttd_min"] is None
    assert [r["MITRE_Tactic_Base"] for r in threat.timeline(e, 60).collect()] == ["X"]
    assert threat.early_warning(threat.tp(e), 60).first()["first_severe_idx"] is None


def test_lateral_pairs_equal_nested_loops(spark):
    rng = random.Random(2)
    tactics = ["Lateral Movement", "Discovery", "Command & Control"]
    rows = [(rng.randint(0, 12), rng.choice("abcdef"), rng.choice("abcdef"), rng.choice(tactics), 1, 1, 0.9) for _ in range(60)]
    got = {(r["LM_Source"], r["LM_Dest"]): r for r in threat.lateral_movement_pairs(events(spark, rows), 60).collect()}
    pairs = {(s, d) for _, s, d, t, *_ in rows if t == tactics[0]}
    assert set(got) == pairs
    for a, v in pairs:
        lm = min(w for w, s, d, t, *_ in rows if (s, d, t) == (a, v, tactics[0]))
        near = [r for r in rows if {r[1], r[2]} & {a, v} and r[0] <= lm]
        first = min(r[0] for r in near)
        early = [r for r in near if r[0] == first]
        mode = min({r[3] for r in early}, key=lambda t: (-sum(r[3] == t for r in early), t))
        hit = [r for r in early if v in r[1:3]]
        received = sorted({r[1] for r in early if r[2] == v})
        text = "" if not hit else "Attacked by: " + ", ".join(received) if received else "Beaconing towards: " + ", ".join(sorted({r[2] for r in early if r[1] == v}))
        r = got[a, v]
        assert (r["Lead_Time_Min"], r["Early_Warning_Tactic"], r["Forensic_Detail"]) == (lm - first, mode, text)


def test_entropy_stays_in_range(spark):
    h = graph.port_entropy(Tables(spark, SF).windowed())
    r = h.agg(F.min("out_entropy"), F.max("in_entropy")).first()
    assert r[0] >= 0 and r[1] <= 1


def test_scaler_constant_feature_and_null(spark):
    p = {r["feature"]: r for r in profile.fit_scaler(Tables(spark, SF).windowed()).collect()}
    assert set(p) == set(NUMERIC) and p["RETRANSMITTED_OUT_PKTS"]["scale"] == 1.0


def test_early_stop_rule(spark):
    values = [0.1, 0.2, 0.20005, 0.2, 0.3] + [0.29] * 12 + [0.9]
    h = spark.createDataFrame([("e", 1, (values,)), ("e", 2, ([],)), ("e", 3, ([0.5],))], "experiment string, seed int, training struct<val_aucpr:array<double>>")
    got = {r["seed"]: (r["best_epoch"], r["stopped_epoch"]) for r in experiments.early_stop_replay(h).collect()}
    assert got == {1: (4, 14), 2: (-1, None), 3: (0, None)}


def test_champion_with_one_seed(spark):
    r = spark.createDataFrame([("A", 1, 0.5, 7)], "Architecture string, Seed long, F1_Score double, Best_Epoch int")
    assert experiments.champions_1sd(r).first()["floor"] == 0.5


def test_metric_logs_and_day_files(spark, tmp_path):
    d = tmp_path / "exp_a"
    d.mkdir()
    (d / "metrics_newth_1.csv").write_text(" F1 ,Seed\n0.5,1\nbad,2\n")
    names = spark.createDataFrame([("exp_b", "B")], "e string, n string")
    got = io.read_metric_logs(spark, f"file://{tmp_path}", names).orderBy("seed").collect()
    assert [(r["experiment"], r["Model"], r["f1"]) for r in got] == [("exp_a", "exp_a", 0.5), ("exp_a", "exp_a", None)]


def test_instance_stream_equals_batch(spark):
    from flowlens.plans.registry import QUERIES

    t = Tables(spark, SF)
    want = {tuple(r) for r in threat.attack_instances(threat.gt(t.events())).select("MITRE_Tactic_Base", "start_idx", "end_idx").collect()}
    got = {tuple(r)[:3] for r in QUERIES["st05_stream_instances"](spark, SF).collect()}
    last = {}
    for a in want:  # the last session of each tactic may still be open
        last[a[0]] = max(last.get(a[0], 0), a[2])
    assert got <= want and all(a in got or a[2] == last[a[0]] for a in want)


def test_forest_learns(spark):
    rows = spark.createDataFrame([([float(i % 2), 0.5], i % 2) for i in range(60)], "features array<float>, y int")
    out = ml.score_flows(ml.train_forest(rows, trees=5, depth=3), rows)
    assert out.where("(Probability > 0.5) != (y = 1)").count() == 0 and out.columns == ["features", "y", "Probability"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_native(spark):
    t = Tables(spark, SF)
    for df in (threat.metrics_per_tactic(t.events(), t.total()), graph.port_entropy(t.windowed()), threat.lateral_movement_pairs(threat.tp(t.events())), metrics.binary_metrics(t.windowed(), 0.7)):
        p = plan(df)
        assert "CartesianProduct" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "PushedFilters: [IsNotNull(FLOW_START_MILLISECONDS)" in plan(windows.slice_day(t.saved(t.flows()), "2024-01-03"))


def test_metric_logs_by_their_own_headers(spark, tmp_path):
    files = {
        "a/metrics_newth_1.csv": "seed,f1,precision\n1,0.9,0.1\n",
        "a/metrics_newth_2.csv": "precision, Seed ,F1,recall\n0.2,2,0.8,0.7\n",
        "b/metrics_newth_3.csv": "Model_Name,Best_F1,Optimal_Threshold\n\"net, seed_7\",0.6,0.3\nno number,0.5,x\n",
        "b/metrics_newth_4.csv": "run,threshold\nmlp_seed12,0.4\n",
        "b/metrics_newth_5.csv": "",
        "b/other.csv": "seed,f1\n9,9\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    names = spark.createDataFrame([("a", "Model A")], "experiment string, name string")
    out = sorted((tuple(r) for r in io.read_metric_logs(spark, f"file://{tmp_path}", names).collect()), key=str)
    assert out == sorted([
        ("a", 1, 0.9, 0.1, None, None, "Model A"), ("a", 2, 0.8, 0.2, 0.7, None, "Model A"), ("b", 7, 0.6, None, None, 0.3, "b"),
        ("b", None, 0.5, None, None, None, "b"), ("b", 12, None, None, None, 0.4, "b"),
    ], key=str)


def test_lateral_movement_of_one_scanner(spark):
    """A scanner with many victims and many first alerts: the rows of no step grow with their product."""
    victims, alerts = 300, 400
    rows = [(0, "scan", f"d{i}", "Discovery" if i % 3 else "Initial Access") for i in range(alerts)] + [(5, "scan", f"v{i}", "Lateral Movement") for i in range(victims)]
    rows += [(0, "scan", "v0", "Discovery"), (0, "v1", "scan", "Initial Access"), (0, "x", "v2", "Initial Access"), (0, "v2", "v2", "Lateral Movement"), (0, "w", "w", "Lateral Movement")]
    hits = spark.createDataFrame([(i, s, d, t, 1) for i, s, d, t in rows], f"{threat.IDX} long, Source_IP string, Dest_IP string, {threat.TACTIC} string, n int")
    out = {(r["LM_Source"], r["LM_Dest"]): r for r in threat.lateral_movement_pairs(hits, 60).collect()}
    assert len(out) == victims + 2
    pairs = {}
    for i, s, d, t in rows:
        if t == "Lateral Movement":
            pairs[s, d] = min(i, pairs.get((s, d), i))
    for (a, v), lm in pairs.items():
        hist = [r for r in rows if r[0] <= lm and {r[1], r[2]} & {a, v}]
        first = min(r[0] for r in hist)
        early = [r for r in hist if r[0] == first]
        count = {t: sum(r[3] == t for r in early) for t in {r[3] for r in early}}
        got = out[a, v]
        assert (got["First_Alert_Min"], got["Lateral_Movement_Min"]) == (first, lm)
        assert got["Early_Warning_Tactic"] == min(count, key=lambda t: (-count[t], t))
        by = [n for n, h in ((f"Attack_LM ({a})", a), (f"Victim_LM ({v})", v)) if any(h in r[1:3] for r in early)]
        assert got["Alert_Caused_By"] == " and ".join(by)
        received, started = (sorted({r[x] for r in early if r[y] == v}) for x, y in ((1, 2), (2, 1)))
        want = "" if len(by) == 1 and by[0].startswith("Attack") else f"Attacked by: {', '.join(received)}" if received else f"Beaconing towards: {', '.join(started)}"
        assert got["Forensic_Detail"] == want


def test_quantiles_are_those_of_numpy(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice([1.0, 2.5, 2.5, 7.0, 11.0, 40.0])) for _ in range(101)] + [("c", 3.0), ("d", None)]
    counts = spark.createDataFrame(rows, "k string, x double").groupBy("k", "x").agg(F.count("*").alias("n"))
    shares = {"lo": 0.1, "mid": 0.5, "hi": 0.9}
    got = {r["k"]: r for r in ranking.quantiles(counts, "x", shares, ["k"]).collect()}
    assert sorted(got) == ["a", "b", "c"]
    for k in got:
        assert np.allclose([got[k][n] for n in shares], np.quantile([x for a, x in rows if a == k], list(shares.values())))
    assert math.isclose(ranking.quantiles(counts.groupBy("x").agg(F.sum("n").alias("n")), "x", {"m": 0.3}).first()["m"], np.quantile([x for _, x in rows if x is not None], 0.3))


def test_keyed_curves_are_those_of_each_key(spark):
    rng = random.Random(6)
    rows = [(e, s, rng.randint(0, 30) / 30, rng.randint(0, 1)) for e in "ab" for s in (1, 2, 3) for _ in range(40)]
    scored = spark.createDataFrame(rows, "experiment string, seed int, Probability double, y_real int")
    keyed = sorted(tuple(r[c] for c in ("experiment", "seed", "threshold", "tps", "fps", "pos", "neg")) for r in metrics.curve(scored, ["experiment", "seed"]).collect())
    for e, s in {k[:2] for k in keyed}:
        part = metrics.curve(scored.where((F.col("experiment") == e) & (F.col("seed") == s)))
        assert sorted(tuple(r[c] for c in ("threshold", "tps", "fps", "pos", "neg")) for r in part.collect()) == [k[2:] for k in keyed if k[:2] == (e, s)]


def vectors(spark, seed=4, n=60, hosts=5, windows=3, size=4):
    rng = np.random.default_rng(seed)
    rows = [(int(w), int(a), int(b), [None if x < 0.1 else float(x) for x in rng.random(size)]) for w, a, b in zip(rng.integers(0, windows, n), rng.integers(0, hosts, n), rng.integers(0, hosts, n), strict=True)]
    return rows, spark.createDataFrame(rows, "window_id long, src_id long, dst_id long, features array<double>")


def test_vector_means_equal_plain_loops(spark):
    rows, edges = vectors(spark)
    plain = lambda v: np.array([x or 0.0 for x in v])
    means = graph.neighbour_mean(edges, 4)
    got = {(r["window_id"], r["host"]): np.array(r["out"] + r["in"]) for r in means.collect()}
    want = {}
    for key in {(w, h) for w, a, b, _ in rows for h in (a, b)}:
        sides = [[plain(v) for w, a, b, v in rows if (w, (a, b)[side]) == key] for side in (0, 1)]
        want[key] = np.concatenate([np.mean(s, axis=0) if s else np.zeros(4) for s in sides])
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    hosts = graph.host_vector(means)
    for r in graph.two_hop_mean(edges, hosts, 8).collect():
        near = [want[w, a] for w, a, b, _ in rows if (w, b) == (r["window_id"], r["host"])]
        assert np.allclose(r["hop2"], np.mean(near, axis=0) if near else np.zeros(8))
    assert len(graph.edge_representation(edges, hosts).collect()) == len(rows)
    assert graph.neighbour_mean(edges.limit(0), 4).count() == 0
    # one exchange for each side and none for their join, no vector in rows of its entries
    p = plan(graph.neighbour_mean(edges, 4))
    assert p.count("Exchange hashpartitioning") == 2 and "posexplode" not in p and "Python" not in p


@pytest.mark.parametrize("alpha", [0.5, 0.97, 0.2, 1.0])
def test_vector_memory_over_many_blocks(spark, alpha):
    """Histories longer than many blocks, against the recursion itself."""
    rng = np.random.default_rng(8)
    rows = [(h, int(w), rng.random(3).tolist()) for h, n in (("a", 700), ("b", 1), ("c", 60), ("d", 61)) for w in np.cumsum(rng.integers(1, 4, n))]
    frame = spark.createDataFrame(rows, "host string, window_id long, vector array<double>")
    got = {(r["host"], r["window_id"]): r["memory"] for r in graph.host_memory(frame, 3, alpha=alpha).collect()}
    h = {}
    for host, w, x in rows:
        h[host] = alpha * np.array(x) + (1 - alpha) * h.get(host, np.zeros(3))
        assert np.allclose(got[host, w], h[host], rtol=1e-12, atol=1e-15)


def test_context_of_hosts(spark):
    e = report_queries.examples(Tables(spark, SF)).limit(500)
    rich = ml.context_features(report_queries.in_context(e))
    assert rich.select(F.size("features").alias("n")).distinct().collect() == [(32 + 2 * (2 + 64 + 64),)]
    assert rich.count() == 500


def auc(rows, train, **size):
    scored = ml.score_flows(train(rows.where("split = 'train'"), **size), rows.where("split = 'test'"))
    return metrics.roc_auc(metrics.curve(scored.select("y_real", "Probability"))).first()[0]


def test_context_forest_learns(spark):
    """On the tables, whose labels don't depend on hosts, the context costs next to
    nothing; where only an end's other flows give an attack away it decides."""
    t = Tables(spark, "/root/testdata/sf0.01")
    e = t.saved(report_queries.examples(t))
    rich = t.saved(ml.context_features(report_queries.in_context(e)))
    size = {"trees": 12, "depth": 6}
    plain = auc(e, ml.train_forest, **size)
    assert plain > 0.8 and auc(rich, ml.train_context_forest, **size) > plain - 0.02
    rng = random.Random(1)
    rows = []
    for w in range(60):
        bots = set(rng.sample(range(12), 3))
        for i in range(60):
            h = rng.randrange(12)
            scan = h in bots and i % 2 == 0  # every other flow of a bot is a scan, the others look like anyone's
            y = int(h in bots and not scan)
            rows.append(("train" if w < 40 else "test", w, w * 60 + i, f"h{h}", f"s{rng.randrange(5)}", "Web", y, y, [float(scan)] + [rng.random() for _ in range(31)]))
    e = t.saved(spark.createDataFrame(rows, "split string, window_id long, flow_ord long, IPV4_SRC_ADDR string, IPV4_DST_ADDR string, Port_Category string, y_real int, y int, features array<float>"))
    rich = t.saved(ml.context_features(report_queries.in_context(e)))
    assert auc(rich, ml.train_context_forest, **size) > 0.9 > auc(e, ml.train_forest, **size) + 0.1
