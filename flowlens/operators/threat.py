"""From scored flows to threat reports. ``events`` has Graph_Window_Idx,
Source_IP, Dest_IP, Port_Category, y_real, y_pred, Probability, MITRE_Tactic and
MITRE_Tactic_Base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import INTERNAL, at_least_zero, canonical_tactic, mitre_tactic, rates, ratio, ttd_interpretation, ttd_quality
from .ranking import islands, shared_table, with_previous

TACTIC, IDX = "MITRE_Tactic_Base", "Graph_Window_Idx"
LATERAL = "Lateral Movement"


def member(flows: DataFrame, ip: str, ips: DataFrame, name: str) -> DataFrame:
    """``name``: whether ``ip`` is in the list. How the list is joined follows
    from its size."""
    marks = ips.select(F.col("ip").alias(ip)).distinct().withColumn(name, F.lit(True))
    return flows.join(marks, ip, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def with_hosts(flows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Source_IP and Dest_IP of src_id and dst_id, "Unknown" where an id has none."""
    for end, ip in (("src_id", "Source_IP"), ("dst_id", "Dest_IP")):
        flows = flows.join(hosts.select(F.col("global_id").alias(end), F.col("ip").alias(ip)), end, "left").withColumn(ip, F.coalesce(ip, F.lit("Unknown")))
    return flows


def label_events(flows: DataFrame, c2: DataFrame, attackers: DataFrame, net: str = INTERNAL) -> DataFrame:
    marked = member(member(flows, "Source_IP", attackers, "_a"), "Dest_IP", c2, "_c")
    return marked.withColumn("MITRE_Tactic", mitre_tactic("Source_IP", "Dest_IP", "Port_Category", F.col("_a"), F.col("_c"), net)).drop("_a", "_c").withColumn(TACTIC, canonical_tactic("MITRE_Tactic"))


def mitre_events(scored: DataFrame, c2: DataFrame, attackers: DataFrame, threshold: float, net: str = INTERNAL) -> DataFrame:
    """Flows that are attacks or alerts, with their tactics. True negatives go before any label is made."""
    hit = F.col("Probability") >= threshold
    relevant = scored.where(hit | (F.col("y_real") == 1)).withColumn("y_pred", hit.cast("int"))
    cols = [IDX, "Source_IP", "Dest_IP", "Port_Category", "y_real", "y_pred", "Probability", "MITRE_Tactic", TACTIC]
    return label_events(relevant, c2, attackers, net).select(*cols)


def gt(events: DataFrame) -> DataFrame:
    return events.where("y_real = 1")


def tp(events: DataFrame) -> DataFrame:
    return events.where("y_real = 1 AND y_pred = 1")


def fp(events: DataFrame) -> DataFrame:
    return events.where("y_real = 0 AND y_pred = 1")


def metrics_per_tactic(events: DataFrame, total_flows: DataFrame, ignore_unknown: bool = False) -> DataFrame:
    """Rates in percent by tactic; TN is what is left of all flows. ``total_flows`` is one row."""
    y, p = F.col("y_real") == 1, F.col("y_pred") == 1
    rows = events.where(F.col(TACTIC) != "Unknown") if ignore_unknown else events
    n = rows.groupBy(TACTIC).agg(F.count_if(y & p).alias("TP"), F.count_if(~y & p).alias("FP"), F.count_if(y & ~p).alias("FN")).where("TP + FP + FN > 0")
    n = n.crossJoin(F.broadcast(total_flows.toDF("total"))).withColumn("TN", F.col("total") - F.col("TP") - F.col("FP") - F.col("FN"))
    return n.select(TACTIC, (F.col("TP") + F.col("FN")).alias("support"), (F.col("TP") + F.col("FP")).alias("alerts"), "TP", "FP", *[(c * 100).alias(f"{k}_pct") for k, c in rates().items()])


def temporal_recall(events: DataFrame, ignore_unknown: bool = False) -> DataFrame:
    """Windows of each tactic with a detection, those without, and recall in percent;
    with the windows that hold false alarms and the precision over windows."""
    rows = events.where(F.col(TACTIC) != "Unknown") if ignore_unknown else events
    seen = gt(rows).groupBy(TACTIC, IDX).agg((F.max("y_pred") == 1).alias("hit"))
    per = seen.groupBy(TACTIC).agg(F.count_if("hit").alias("tp_windows"), F.count_if(~F.col("hit")).alias("fn_windows"))
    by = events.groupBy(IDX).agg(F.max((F.col("y_real") == 1) & (F.col("y_pred") == 1)).alias("t"), F.max((F.col("y_real") == 0) & (F.col("y_pred") == 1)).alias("f"))
    whole = by.agg(F.count_if("f").alias("global_fp_windows"), F.count_if("t").alias("t"))
    out = per.crossJoin(F.broadcast(whole))
    pct = lambda a, b: ratio(a.cast("double"), a + b) * 100
    return out.select(TACTIC, "tp_windows", "fn_windows", pct(F.col("tp_windows"), F.col("fn_windows")).alias("temporal_recall_pct"), "global_fp_windows", pct(F.col("t"), F.col("global_fp_windows")).alias("global_precision_pct"))


def window_gaps(real: DataFrame) -> DataFrame:
    """tactic, window, gap to the tactic's window before, null for its first."""
    out = with_previous(real.select(TACTIC, IDX).distinct(), [TACTIC], [IDX], [IDX])
    return out.select(TACTIC, IDX, (F.col(IDX) - F.col(f"prev_{IDX}")).alias("gap"))


def attack_instances(real: DataFrame, max_gap: int = 5) -> DataFrame:
    """Runs of a tactic's windows without a gap above ``max_gap``: tactic, instance,
    start and end. Windows are made distinct before they are ordered, and a tactic's
    windows may lie in any number of ranges."""
    rows = islands(real.select(TACTIC, IDX).distinct(), [TACTIC], [IDX], F.col(IDX) - F.col(f"prev_{IDX}") > max_gap, "instance")
    return rows.groupBy(TACTIC, "instance").agg(F.min(IDX).alias("start_idx"), F.max(IDX).alias("end_idx"))


def first_detections(instances: DataFrame, hits: DataFrame, bucket: int = 256) -> DataFrame:
    """Adds the first detection inside each instance, null where there is none.
    Ranges are cut into buckets of windows, so that tactic and bucket are an
    equi-join and the range is only checked within a bucket."""
    h = hits.select(F.col(TACTIC).alias("t"), F.col(IDX).alias("at")).distinct().withColumn("hb", F.expr(f"at div {bucket}"))
    i = instances.withColumn("b", F.explode(F.sequence(F.expr(f"start_idx div {bucket}"), F.expr(f"end_idx div {bucket}"))))
    joined = i.join(h, (F.col(TACTIC) == F.col("t")) & (F.col("b") == F.col("hb")) & F.col("at").between(F.col("start_idx"), F.col("end_idx")), "left")
    return joined.groupBy(TACTIC, "instance", "start_idx", "end_idx").agg(F.min("at").alias("first_detection_idx"))


def mttd(events: DataFrame, seconds: int = 30, max_gap: int = 5) -> DataFrame:
    minutes = seconds / 60
    found = first_detections(attack_instances(gt(events), max_gap), tp(events))
    ttd = (F.col("first_detection_idx") - F.col("start_idx")) * minutes
    out = found.withColumn("ttd", ttd).groupBy(TACTIC).agg(
        F.count("*").alias("instances"), F.count("ttd").alias("detected"), F.avg("ttd").alias("mttd_min"), F.median("ttd").alias("median_ttd_min"),
        F.max("ttd").alias("max_ttd_min"), F.coalesce(F.stddev_samp("ttd"), F.lit(0.0)).alias("std_ttd_min"), F.min(F.col("start_idx") * minutes).alias("real_start_min"),
    )
    return out.withColumn("detection_rate_pct", F.col("detected") / F.col("instances") * 100)


def timeline(events: DataFrame, seconds: int = 30) -> DataFrame:
    """Start, detections, time to detect and span by tactic; undetected tactics do not occur."""
    m = seconds / 60
    real = gt(events).groupBy(TACTIC).agg(F.min(IDX).alias("real_start_idx"), F.count_distinct(IDX).alias("real_active_windows"), F.count("*").alias("real_flows"))
    hits = tp(events).groupBy(TACTIC).agg(
        F.min(IDX).alias("first_detection_idx"), F.max(IDX).alias("last_detection_idx"), F.count("*").alias("total_alerts"), F.count_distinct(IDX).alias("active_windows"),
        F.avg("Probability").alias("mean_probability"), F.max("Probability").alias("max_probability"),
    )
    span = F.col("last_detection_idx") - F.col("first_detection_idx") + 1
    return real.join(hits, TACTIC, "left").where("first_detection_idx IS NOT NULL").withColumns({
        "real_start_min": F.col("real_start_idx") * m,
        "first_detection_min": F.col("first_detection_idx") * m,
        "last_detection_min": F.col("last_detection_idx") * m,
        "ttd_min": (F.col("first_detection_idx") - F.col("real_start_idx")) * m,
        "span_windows": span,
        "span_min": span * m,
        "window_consistency_pct": F.col("active_windows") / F.col("real_active_windows") * 100,
    })


def timeline_strict(events: DataFrame, seconds: int = 30, significant: float = 0.5) -> DataFrame:
    """The timeline with flow recall, the detection rate in the first window, and
    the first window whose rate is significant."""
    m = seconds / 60
    per = gt(events).groupBy(TACTIC, IDX).agg(F.count("*").alias("real"), F.sum("y_pred").alias("hits")).withColumn("rate", F.col("hits") / F.col("real"))
    base = timeline(events, seconds)
    strict = per.where(F.col("rate") >= significant).groupBy(TACTIC).agg(F.min(IDX).alias("first_significant_idx"))
    first = per.select(TACTIC, F.col(IDX).alias("first_detection_idx"), F.col("real").alias("first_window_real"), F.col("hits").alias("first_window_hits"), F.col("rate").alias("first_window_rate"))
    out = base.join(first, [TACTIC, "first_detection_idx"], "left").join(strict, TACTIC, "left")
    out = out.withColumns({
        "tactic_recall": F.col("total_alerts") / F.col("real_flows"),
        "ttd_min": at_least_zero("ttd_min"),
        "ttd_strict_min": at_least_zero((F.col("first_significant_idx") - F.col("real_start_idx")) * m),
        "ttd_quality": ttd_quality("first_window_rate"),
    })
    return out.withColumn("ttd_interpretation", ttd_interpretation("ttd_min", "first_window_rate"))


def early_warning(hits: DataFrame, seconds: int = 30) -> DataFrame:
    """One row: the first alert, the first lateral movement, and the lead; the latter null if there is none."""
    out = hits.agg(F.min(IDX).alias("first_alert_idx"), F.min(F.when(F.col(TACTIC) == LATERAL, F.col(IDX))).alias("first_severe_idx"))
    lead = (F.col("first_severe_idx") - F.col("first_alert_idx")) * seconds
    return out.select("first_alert_idx", (F.col("first_alert_idx") * seconds / 60).alias("first_alert_min"), "first_severe_idx", (F.col("first_severe_idx") * seconds / 60).alias("first_severe_min"), lead.alias("lead_sec"), (lead / 60).alias("lead_min"))


def lateral_movement_pairs(hits: DataFrame, seconds: int = 30) -> DataFrame:
    """For each pair in lateral movement: when it began, the earliest alert that
    touches either host up to then, its commonest tactic, who triggered it, and
    what is known of the victim. Alerts are aggregated by host, window and tactic
    before pairs look them up, so a scanner's victims never meet its alerts one by
    one: what touches either end is what touches the one and the other, less what
    runs between the two."""
    small = shared_table(hits.groupBy(IDX, "Source_IP", "Dest_IP", TACTIC).agg(F.count("*").alias("n")))
    pairs = small.where(F.col(TACTIC) == LATERAL).groupBy(F.col("Source_IP").alias("a"), F.col("Dest_IP").alias("v")).agg(F.min(IDX).alias("lm_idx"))
    ends = F.array_distinct(F.array(F.struct(F.col("Source_IP").alias("host")), F.struct(F.col("Dest_IP").alias("host"))))
    touched = shared_table(small.select(IDX, TACTIC, "n", F.explode(ends).alias("e")).groupBy("e.host", IDX, TACTIC).agg(F.sum("n").alias("n")))
    seen = touched.groupBy("host").agg(F.min(IDX).alias("first_idx"))
    # a pair's own lateral movement touches both hosts, so the earliest alert is never later
    both = shared_table(pairs.join(seen.toDF("a", "fa"), "a").join(seen.toDF("v", "fv"), "v").select("a", "v", "lm_idx", F.least("fa", "fv").alias("first_idx")))
    keys = ["a", "v", "lm_idx", "first_idx"]

    def at_end(host: str) -> DataFrame:
        return both.join(touched.withColumnsRenamed({"host": host, IDX: "first_idx"}), [host, "first_idx"]).select(*keys, TACTIC, "n", F.lit(host).alias("side"))

    # alerts between the ends count at both of them
    low, high = F.least("Source_IP", "Dest_IP").alias("low"), F.greatest("Source_IP", "Dest_IP").alias("high")
    between = small.where("Source_IP != Dest_IP").groupBy(F.col(IDX).alias("first_idx"), low, high, TACTIC).agg(F.sum("n").alias("n"))
    off = both.withColumns({"low": F.least("a", "v"), "high": F.greatest("a", "v")}).join(between, ["first_idx", "low", "high"]).select(*keys, TACTIC, (-F.col("n")).alias("n"), F.lit("both").alias("side"))
    early = shared_table(at_end("a").union(at_end("v").where("a != v")).union(off))
    by = early.groupBy(*keys).agg(F.max(F.col("side") == "a").alias("by_a"), F.max((F.col("side") == "v") | (F.col("a") == F.col("v"))).alias("by_v"))
    total = early.groupBy(*keys, TACTIC).agg(F.sum("n").alias("n")).where("n > 0")
    mode = total.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("less"), TACTIC)).alias("m"))
    # the sources of a host's first alerts, and the destinations
    # of the victims' first windows alone: what a scanner does elsewhere is not gathered
    wanted = shared_table(both.select("v", "first_idx").distinct())
    at = lambda end, host: small.select(F.col(host).alias("v"), F.col(IDX).alias("first_idx"), F.col(end).alias("peer")).join(wanted, ["v", "first_idx"], "left_semi").distinct().groupBy("v", "first_idx").agg(F.array_join(F.array_sort(F.collect_list("peer")), ", ").alias(end))
    known = both.select(*keys).join(at("Source_IP", "Dest_IP").withColumnRenamed("Source_IP", "received"), ["v", "first_idx"], "left").join(at("Dest_IP", "Source_IP").withColumnRenamed("Dest_IP", "started"), ["v", "first_idx"], "left")
    facts = by.join(known.fillna("", ["received", "started"]), keys)
    detail = F.when(~F.col("by_v"), "").when(F.col("received") != "", F.concat(F.lit("Attacked by: "), "received")).otherwise(F.concat(F.lit("Beaconing towards: "), "started"))
    who = F.array_join(F.array(F.when(F.col("by_a"), F.concat(F.lit("Attack_LM ("), "a", F.lit(")"))), F.when(F.col("by_v"), F.concat(F.lit("Victim_LM ("), "v", F.lit(")")))), " and ")
    m = seconds / 60
    return facts.join(mode, keys).select(
        F.col("a").alias("LM_Source"), F.col("v").alias("LM_Dest"), (F.col("first_idx") * m).alias("First_Alert_Min"), who.alias("Alert_Caused_By"), detail.alias("Forensic_Detail"),
        F.col(f"m.{TACTIC}").alias("Early_Warning_Tactic"), (F.col("lm_idx") * m).alias("Lateral_Movement_Min"), ((F.col("lm_idx") - F.col("first_idx")) * m).alias("Lead_Time_Min"),
    )


def lead_time_summary(pairs: DataFrame) -> DataFrame:
    """Pairs and mean lead by warning tactic, with the overall mean."""
    whole = F.broadcast(pairs.agg(F.avg("Lead_Time_Min").alias("overall_mean")))
    return pairs.groupBy("Early_Warning_Tactic").agg(F.count("*").alias("pairs"), F.avg("Lead_Time_Min").alias("mean_lead")).crossJoin(whole)


def false_alarm_profile(events: DataFrame) -> DataFrame:
    """kind (role, source, destination), value, alerts: all three in one pass."""
    rows = fp(events).groupingSets([["Port_Category"], ["Source_IP"], ["Dest_IP"]], "Port_Category", "Source_IP", "Dest_IP").agg(F.count("*").alias("alerts"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "role").when(F.col("g") == 5, "source").otherwise("destination")
    return rows.select(kind.alias("kind"), F.coalesce("Port_Category", "Source_IP", "Dest_IP").alias("value"), "alerts")


def ports_toward(events: DataFrame, ip: str) -> DataFrame:
    return fp(events).where(F.col("Dest_IP") == ip).groupBy("Port_Category").agg(F.count("*").alias("alerts"))


def soc_rules(scored: DataFrame, dns_suspicious: DataFrame, smb_whitelist: DataFrame, focus: DataFrame) -> DataFrame:
    """Adds dns_rule_applied, smb_rule_applied, focus_src, focus_dst."""
    rows = member(member(scored, "Dest_IP", dns_suspicious, "_d"), "Source_IP", smb_whitelist, "_s")
    rows = member(member(rows, "Source_IP", focus, "focus_src"), "Dest_IP", focus, "focus_dst")
    false_alarm = (F.col("y_real") == 0) & (F.col("y_pred") == 1)
    return rows.withColumns({
        "dns_rule_applied": (F.col("_d") & (F.col("Port_Category") == "DNS") & false_alarm).cast("int"),
        "smb_rule_applied": (F.col("_s") & (F.col("Port_Category") == "Windows/SMB") & false_alarm).cast("int"),
        "focus_src": F.col("focus_src").cast("int"),
        "focus_dst": F.col("focus_dst").cast("int"),
    }).drop("_d", "_s")


def apply_soc_rules(ruled: DataFrame) -> DataFrame:
    """DNS hits become real attacks, SMB hits are no alerts."""
    y = F.when(F.col("dns_rule_applied") == 1, 1).otherwise(F.col("y_real"))
    p = F.when(F.col("smb_rule_applied") == 1, 0).otherwise(F.col("y_pred"))
    return ruled.withColumns({"y_real": y, "y_pred": p})


def focus_host_check(scored: DataFrame, focus: DataFrame) -> DataFrame:
    """ip, real_attack_flows, whitelist_safe for each focus host."""
    n = scored.where("y_real = 1").groupBy(F.col("Source_IP").alias("ip")).agg(F.count("*").alias("n"))
    return focus.select("ip").distinct().join(n, "ip", "left").select("ip", F.coalesce("n", F.lit(0)).cast("long").alias("real_attack_flows"), F.col("n").isNull().alias("whitelist_safe"))


#: Names of the phases.
PHASES = ("PHASE 1: RAW MATRIX", "PHASE 2: LABEL CORRECTION DNS", "PHASE 3: SOC + WHITELIST SMB", "PHASE 3: SOC WITHOUT WHITELIST (Unsecured IPs)")


def soc_phases(ruled: DataFrame, focus: DataFrame) -> DataFrame:
    """Counts and rates of three phases: raw, DNS corrected, SMB whitelisted. The
    whitelist holds only if no focus host attacked."""
    y, p = F.col("y_real") == 1, F.col("y_pred") == 1
    one = ruled.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"), F.coalesce(F.sum("dns_rule_applied"), F.lit(0)).alias("d"), F.coalesce(F.sum("smb_rule_applied"), F.lit(0)).alias("s"))
    safe = focus_host_check(ruled, focus).agg(F.coalesce(F.bool_and("whitelist_safe"), F.lit(True)).alias("safe"))
    s = F.when(F.col("safe"), F.col("s")).otherwise(0)
    phase = lambda name, tp, fp, tn: F.struct(name.alias("Phase"), tp.alias("TP"), fp.alias("FP"), tn.alias("TN"), F.col("fn").alias("FN"))
    tp_, fp_, tn_ = F.col("tp"), F.col("fp"), F.col("tn")
    rows = F.array(
        phase(F.lit(PHASES[0]), tp_, fp_, tn_),
        phase(F.lit(PHASES[1]), tp_ + F.col("d"), fp_ - F.col("d"), tn_),
        phase(F.when(F.col("safe"), PHASES[2]).otherwise(PHASES[3]), tp_ + F.col("d"), fp_ - F.col("d") - s, tn_ + s),
    )
    return one.crossJoin(safe).select(F.explode(rows).alias("r")).select("r.*").withColumns(rates())


def post_soc_tactics(ruled: DataFrame, c2: DataFrame, attackers: DataFrame) -> DataFrame:
    """Metrics by tactic after the rules."""
    after = apply_soc_rules(ruled)
    total = ruled.agg(F.count("*").alias("total"))
    rows = after.where("y_real = 1 OR y_pred = 1")
    return metrics_per_tactic(label_events(rows, c2, attackers), total)


def relevant(threshold: float) -> Column:
    return (F.col("Probability") >= threshold) | (F.col("y_real") == 1)
