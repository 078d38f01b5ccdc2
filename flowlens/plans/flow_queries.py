"""Queries on flows: scalar functions, windows, profiles, joins and set forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import sql as sql_functions
from ..operators import experiments, profile, threat, windows
from ..operators.ranking import shared_root, with_previous
from ..schema import FLOW, NUMERIC
from ..sources import io
from .fixtures import ATTACKERS, C2, FOCUS, HOUR, duck, role_sql
from .registry import query

SRC, DST = "IPV4_SRC_ADDR", "IPV4_DST_ADDR"
DAY = "2024-01-03"
DAY_MS = 1_704_240_000_000

# scalar functions -----------------------------------------------------------


@query("p01_valid_ips", duck("SELECT count(*) AS flows, count(*) FILTER (IPV4_SRC_ADDR <> '0.0.0.0' AND IPV4_DST_ADDR <> '0.0.0.0') AS valid FROM flows", "flows"))
def _(t):
    return t.flows().agg(F.count("*").alias("flows"), F.count_if(C.valid_ips()).alias("valid"))


@query("p02_label_flag", duck("SELECT CASE WHEN Attack = 'Infilteration' THEN 1 ELSE 0 END AS y, count(*) AS n FROM flows GROUP BY 1", "flows"))
def _(t):
    return t.flows().groupBy(C.label_flag().alias("y")).agg(F.count("*").alias("n"))


@query("p03_log1p", duck("SELECT flow_ord, " + ", ".join(f"round(CASE WHEN {c} > -1 THEN ln(1e0 + {c}) END, 6) AS {c}" for c in NUMERIC) + " FROM flows", "flows"))
def _(t):
    return t.flows().select("flow_ord", *[e.alias(c) for c, e in C.log_features().items()])


@query("p04_port_role", duck(f"SELECT flow_ord, L4_DST_PORT, {role_sql()} AS role FROM flows", "flows"))
def _(t):
    return t.flows().select("flow_ord", "L4_DST_PORT", C.port_role().alias("role"))


_P = {k: ", ".join(map(str, v)) for k, v in C.ROLE_PORTS.items()}
_FIRST4 = ", ".join(_P[k] for k in ("Web", "Admin/Remote", "Windows/SMB", "DNS"))


@query(
    "p05_port_role_flags",
    duck(
        "SELECT flow_ord, " + ", ".join(f"CAST(L4_DST_PORT IN ({_P[k]}) AS INTEGER) AS {n}" for n, k in zip(("Role_Web", "Role_Admin", "Role_Win", "Role_Infra", "Role_DB"), _P, strict=True))
        + f", CAST(L4_DST_PORT < 1024 AND L4_DST_PORT NOT IN ({_FIRST4}) AS INTEGER) AS Role_LowPriv, CAST(L4_DST_PORT >= 1024 AS INTEGER) AS Role_HighPriv FROM flows",
        "flows",
    ),
)
def _(t):
    return t.flows().select("flow_ord", *[c.alias(k) for k, c in C.port_role_flags().items()])


PROTO = "CASE WHEN PROTOCOL = 6 THEN 'TCP' WHEN PROTOCOL = 17 THEN 'UDP' WHEN PROTOCOL IN (1, 58) THEN 'ICMP' WHEN PROTOCOL = 2 THEN 'IGMP' ELSE 'Other' END"


@query("p06_protocol_class", duck(f"SELECT {PROTO} AS protocol, count(*) AS n FROM flows GROUP BY 1", "flows"))
def _(t):
    return t.flows().groupBy(C.protocol_class().alias("protocol")).agg(F.count("*").alias("n"))


def _hot(value: str, classes) -> list[str]:
    return [f"CAST({value} = '{c}' AS FLOAT)" for c in classes]


SLOTS = [*_hot("role", C.ROLES), *_hot("proto", C.PROTOCOL_CLASSES), *[f"CAST(CASE WHEN {c} > -1 THEN ln(1e0 + {c}) END AS FLOAT)" for c in NUMERIC]]


@query(
    "p07_edge_features",
    duck("SELECT flow_ord, slot, round(CAST(v AS DOUBLE), 4) AS value FROM (SELECT flow_ord, unnest(range(32)) AS slot, unnest([" + ", ".join(SLOTS) + "]) AS v FROM r)", "flows", r=f"SELECT *, {role_sql()} AS role, {PROTO} AS proto FROM flows"),
)
def _(t):
    f = t.flows().select("flow_ord", F.posexplode(C.edge_features()).alias("slot", "v"))
    return f.select("flow_ord", F.col("slot").cast("long").alias("slot"), F.round(F.col("v").cast("double"), 4).alias("value"))


@query("p08_decode_role", duck(f"SELECT flow_ord, {role_sql()} AS role FROM flows", "flows"))
def _(t):
    return t.flows().select("flow_ord", C.decode_role(C.edge_features()).alias("role"))


@query("p09_drop_header_rows", duck("SELECT * FROM raw WHERE ts_text <> 'Timestamp'", "raw"))
def _(t):
    return profile.drop_header_rows(t.raw().withColumnRenamed("ts_text", "Timestamp")).withColumnRenamed("Timestamp", "ts_text")


@query("p10_coerce_numeric", duck("SELECT row_ord, TRY_CAST(flow_byts AS DOUBLE) AS value FROM raw WHERE flow_byts IS NULL OR flow_byts <> 'Infinity'", "raw"))
def _(t):
    return t.raw().where("flow_byts IS NULL OR flow_byts <> 'Infinity'").select("row_ord", C.coerce_numeric("flow_byts").alias("value"))


@query("p11_parse_day_first", duck("SELECT row_ord, strftime(try_strptime(ts_text, '%d/%m/%Y %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS ts FROM raw", "raw"))
def _(t):
    return t.raw().select("row_ord", F.date_format(C.parse_day_first("ts_text"), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("p12_hour_text", duck("SELECT DISTINCT nullif(split_part(split_part(ts_text, ' ', 2), ':', 1), '') AS hour FROM raw", "raw"))
def _(t):
    return t.raw().select(C.hour_text("ts_text").alias("hour")).distinct()


@query("p13_hour_of_day", duck("SELECT hour(FLOW_START_TIME) AS hour, count(*) AS n FROM flows WHERE hour(FLOW_START_TIME) BETWEEN 9 AND 17 GROUP BY 1", "flows"))
def _(t):
    h = F.hour("FLOW_START_TIME")
    return t.flows().where(h.between(9, 17)).groupBy(h.cast("long").alias("hour")).agg(F.count("*").alias("n"))


@query("p14_floor_time", duck("SELECT strftime(time_bucket(INTERVAL 5 MINUTE, FLOW_START_TIME), '%Y-%m-%d %H:%M') AS bin, count(*) AS n FROM flows GROUP BY 1", "flows"))
def _(t):
    return t.flows().groupBy(F.date_format(C.floor_time("FLOW_START_TIME"), "yyyy-MM-dd HH:mm").alias("bin")).agg(F.count("*").alias("n"))


NAMES = (("1-URGENT", "Simple MLP"), ("2-HIGH", "Edge GRU"))


@query("p15_base_model_name", duck("SELECT model_name, CASE split_part(model_name, '_seed', 1) WHEN '1-URGENT' THEN 'Simple MLP' WHEN '2-HIGH' THEN 'Edge GRU' ELSE split_part(model_name, '_seed', 1) END AS Model FROM runs", "runs"))
def _(t):
    return experiments.display_names(t.runs(), t.spark.createDataFrame(NAMES, "base string, name string")).select("model_name", "Model")


@query("p16_extract_seed", duck("SELECT model_name, CAST(nullif(regexp_extract(model_name, '(?i)seed_?([0-9]+)', 1), '') AS INTEGER) AS seed FROM runs", "runs"))
def _(t):
    return t.runs().select("model_name", C.extract_seed("model_name").alias("seed"))


@query("p17_in_cidr", duck("SELECT flow_ord, IPV4_SRC_ADDR LIKE '172.31.%' AS src_in, IPV4_DST_ADDR LIKE '8.8.%' AND CAST(split_part(IPV4_DST_ADDR, '.', 3) AS INTEGER) < 4 AS dst_in FROM flows", "flows"))
def _(t):
    return t.flows().select("flow_ord", C.in_cidr(SRC, "172.31.0.0/16").alias("src_in"), C.in_cidr(DST, "8.8.0.0/22").alias("dst_in"))


@query("p18_mitre_tactic", duck("SELECT flow_ord, MITRE_Tactic FROM labelled", "labelled"))
def _(t):
    return threat.label_events(t.scored(), t.ips(C2), t.ips(ATTACKERS)).select("flow_ord", "MITRE_Tactic")


@query("p19_canonical_tactic", duck("SELECT MITRE_Tactic, MITRE_Tactic_Base, count(*) AS n FROM labelled GROUP BY ALL", "labelled"))
def _(t):
    return threat.label_events(t.scored(), t.ips(C2), t.ips(ATTACKERS)).groupBy("MITRE_Tactic", "MITRE_Tactic_Base").agg(F.count("*").alias("n"))


@query("p20_relevant_flows", duck("SELECT flow_ord, y_real, y_pred FROM windowed WHERE Probability >= 0.7 OR y_real = 1", "windowed"))
def _(t):
    return t.windowed().where(C.over("Probability", 0.7) | (F.col("y_real") == 1)).select("flow_ord", "y_real", "y_pred")


KIND = "CASE WHEN y_real = 1 AND y_pred = 1 THEN 'TP' WHEN y_real = 0 AND y_pred = 1 THEN 'FP' WHEN y_real = 0 AND y_pred = 0 THEN 'TN' ELSE 'FN' END"


@query("p21_confusion_class", duck(f"SELECT flow_ord, {KIND} AS kind FROM windowed", "windowed"))
def _(t):
    return t.windowed().select("flow_ord", C.confusion_class().alias("kind"))


@query("p22_event_subsets", duck("SELECT 'gt' AS part, count(*) AS n FROM gt UNION ALL SELECT 'tp', count(*) FROM tp UNION ALL SELECT 'fp', count(*) FROM fp UNION ALL SELECT 'pred', count(*) FROM ev WHERE y_pred = 1", "gt", "tp", "fp"))
def _(t):
    y, p = F.col("y_real") == 1, F.col("y_pred") == 1
    one = t.events().agg(F.count_if(y).alias("gt"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(p).alias("pred"))
    return one.unpivot([], ["gt", "tp", "fp", "pred"], "part", "n")


@query("p23_soc_rules", duck("SELECT flow_ord, dns_rule_applied, smb_rule_applied, focus_src, focus_dst FROM ruled", "ruled"))
def _(t):
    return t.ruled().select("flow_ord", "dns_rule_applied", "smb_rule_applied", "focus_src", "focus_dst")


@query("p24_apply_soc_rules", duck("SELECT flow_ord, CASE WHEN dns_rule_applied = 1 THEN 1 ELSE y_real END AS y_real, CASE WHEN smb_rule_applied = 1 THEN 0 ELSE y_pred END AS y_pred FROM ruled", "ruled"))
def _(t):
    return threat.apply_soc_rules(t.ruled()).select("flow_ord", "y_real", "y_pred")


@query("p25_self_loops", duck("SELECT flow_ord, IPV4_SRC_ADDR FROM flows WHERE IPV4_SRC_ADDR = IPV4_DST_ADDR", "flows"))
def _(t):
    return t.flows().where(F.col(SRC) == F.col(DST)).select("flow_ord", SRC)


PIVOT = "SELECT window_id, IPV4_SRC_ADDR, IPV4_DST_ADDR, count(*) FILTER (Attack = 'Benign') AS Benign, count(*) FILTER (Attack = 'Infilteration') AS Infilteration FROM windowed GROUP BY 1, 2, 3"


@query("p26_mixed_pairs", duck("SELECT *, Benign > 0 AS mixed FROM p WHERE Infilteration > 0", "windowed", p=PIVOT))
def _(t):
    p = profile.pair_attack_pivot(t.windowed())
    both = profile.mixed_pairs(p).withColumn("mixed", F.lit(True))
    return both.union(profile.mixed_pairs(p, only_attack=True).withColumn("mixed", F.lit(False)))


@query("p27_sigmoid", duck("SELECT flow_ord, round(1 / (1 + exp(-(Probability * 8 - 4))), 6) AS p FROM flows", "flows"))
def _(t):
    return t.flows().select("flow_ord", C.sigmoid(F.col("Probability") * 8 - 4).alias("p"))


QUALITY = "CASE WHEN r <= 0.25 THEN 'Weak (<25%)' WHEN r <= 0.75 THEN 'Partial (25-75%)' ELSE 'Strong (>75%)' END"


@query("p28_ttd_quality", duck(f"SELECT flow_ord, {QUALITY} AS quality FROM (SELECT flow_ord, least(Probability, 1e0) AS r FROM flows)", "flows"))
def _(t):
    return t.flows().select("flow_ord", C.ttd_quality(F.least("Probability", F.lit(1.0))).alias("quality"))


INTERPRET = """CASE WHEN t > 0 AND r >= 0.75 THEN 'Delayed but strong detection' WHEN t > 0 AND r >= 0.25 THEN 'Delayed partial detection' WHEN t > 0 THEN 'Delayed weak detection'
 WHEN r >= 0.75 THEN 'Immediate strong detection' WHEN r >= 0.25 THEN 'Immediate partial detection' ELSE 'Nominal detection (TTD=0 misleading)' END"""


@query("p29_ttd_interpretation", duck(f"SELECT flow_ord, {INTERPRET} AS text FROM (SELECT flow_ord, Probability AS r, L4_DST_PORT % 2 AS t FROM flows)", "flows"))
def _(t):
    return t.flows().select("flow_ord", C.ttd_interpretation(F.col("L4_DST_PORT") % 2, "Probability").alias("text"))


@query("p30_clip_and_minutes", duck("SELECT flow_ord, round(greatest((window_id - 300) * 60e0, 0e0), 6) AS minutes FROM windowed", "windowed"))
def _(t):
    return t.windowed().select("flow_ord", C.at_least_zero((F.col("window_id") - 300) * 60.0).alias("minutes"))


_LISTS = "array({})".format
_NET = "'172.31.0.0/16'"


@query("u01_sql_functions", duck(f"SELECT Port_Category AS role, {PROTO} AS protocol, Source_IP LIKE '172.31.%' AS inside, MITRE_Tactic AS tactic, MITRE_Tactic_Base AS base, count(*) AS n FROM labelled GROUP BY ALL", "labelled"))
def _(t):
    sql_functions.register(t.spark)
    attackers, c2 = (_LISTS(", ".join(map(repr, ips))) for ips in (ATTACKERS, C2))
    return t.spark.sql(
        f"""SELECT role, protocol_class(PROTOCOL) AS protocol, in_cidr(Source_IP, {_NET}) AS inside, tactic, canonical_tactic(tactic) AS base, count(*) AS n
        FROM (SELECT *, mitre_tactic(Source_IP, Dest_IP, role, {attackers}, {c2}, {_NET}) AS tactic FROM (SELECT *, port_role(L4_DST_PORT) AS role FROM {{f}})) GROUP BY ALL""",
        f=t.scored(),
    )


# windows and splits ---------------------------------------------------------


@query("w01_assign_window", duck("SELECT flow_ord, (FLOW_START_MILLISECONDS - (SELECT min(FLOW_START_MILLISECONDS) FROM flows)) // 30000 AS window_id FROM flows", "flows"))
def _(t):
    return windows.assign_window(t.flows(), 30).select("flow_ord", "window_id")


@query("w02_window_start", duck("SELECT DISTINCT window_id, (SELECT min(FLOW_START_MILLISECONDS) FROM flows) + window_id * 3600000 AS window_start_ms FROM windowed", "windowed"))
def _(t):
    one = F.broadcast(windows.extent(t.flows()))
    return t.windowed().select("window_id").distinct().crossJoin(one).select("window_id", windows.window_start_ms(HOUR, F.col("start_ms")).alias("window_start_ms"))


def spine_sql(width: int, aggs: str, names: list[str]) -> str:
    return (
        f"SELECT w AS window_ms, {', '.join(f'coalesce({n}, 0) AS {n}' for n in names)} FROM (SELECT unnest(range(a, b + 1, {width})) AS w FROM (SELECT min(x) AS a, max(x) AS b FROM (SELECT FLOW_START_MILLISECONDS // {width} * {width} AS x FROM flows)))"
        f" LEFT JOIN (SELECT FLOW_START_MILLISECONDS // {width} * {width} AS w, {aggs} FROM flows GROUP BY 1) USING (w)"
    )


@query("w03_resample", duck(spine_sql(300_000, "count(*) AS flows", ["flows"]), "flows"))
def _(t):
    return windows.resample(t.flows(), 300)


FILLED = "SELECT w AS window_id, coalesce(n, 0) AS flows, n IS NULL AS is_empty FROM (SELECT unnest(range(0, (SELECT max(window_id) FROM w) + 1)) AS w) LEFT JOIN (SELECT window_id AS w, count(*) AS n FROM w GROUP BY 1) USING (w)"
W300 = "SELECT *, (FLOW_START_MILLISECONDS - (SELECT min(FLOW_START_MILLISECONDS) FROM flows)) // 300000 AS window_id FROM flows WHERE IPV4_SRC_ADDR <> '0.0.0.0' AND IPV4_DST_ADDR <> '0.0.0.0'"


@query("w04_fill_empty_windows", duck(FILLED, "flows", w=W300))
def _(t):
    return windows.fill_empty_windows(t.windowed(300))


@query("w05_split_limits", duck("SELECT * FROM limits", "limits"))
def _(t):
    return windows.split_limits(t.flows())


SPLIT = "CASE WHEN {0} < train_end_us THEN 'train' WHEN {0} < val_end_us THEN 'val' ELSE 'test' END"
BY_WINDOW = f"SELECT w.*, {SPLIT.format('(start_us + window_id * 3600000000)')} AS split FROM windowed w, limits"
BY_FLOW = f"SELECT f.*, {SPLIT.format('(FLOW_START_MILLISECONDS * 1000)')} AS split FROM windowed f, limits"


def by_window(t, seconds=HOUR):
    return windows.split_by_window(t.windowed(seconds), windows.split_limits(t.flows()), seconds)


@query("w06_split_by_window", duck("SELECT flow_ord, split FROM s", "windowed", "limits", s=BY_WINDOW))
def _(t):
    return by_window(t).select("flow_ord", "split")


@query("w07_split_by_flow", duck("SELECT flow_ord, split FROM s", "windowed", "limits", s=BY_FLOW))
def _(t):
    return windows.split_by_flow(t.windowed(), windows.split_limits(t.flows())).select("flow_ord", "split")


def spine(t, seconds=300, windowed=None):
    """Every window with its split, start and emptiness."""
    limits = windows.split_limits(t.flows())
    s = windows.split_by_window(windows.fill_empty_windows(windowed or t.windowed(seconds)), limits, seconds)
    return s.crossJoin(F.broadcast(windows.extent(t.flows()).select("start_ms"))).withColumn("window_start_ms", windows.window_start_ms(seconds, F.col("start_ms"))).drop("start_ms")


SPINE = f"SELECT f.*, {SPLIT.format('(start_us + window_id * 300000000)')} AS split, start_us // 1000 + window_id * 300000 AS window_start_ms FROM ({FILLED}) f, limits"


def spine_duck(body: str) -> str:
    return duck(body, "flows", "limits", w=W300, spine=SPINE)


@query("w08_snapshot_ordinal", spine_duck('SELECT split, window_id, window_id - min(window_id) OVER (PARTITION BY split) AS "Graph_Window_Idx" FROM spine'))
def _(t):
    return windows.snapshot_ordinal(spine(t)).select("split", "window_id", "Graph_Window_Idx")


@query("w09_check_continuity", spine_duck("SELECT split, count(*) AS snapshots, count(*) FILTER (is_empty) AS empty, count(*) FILTER (d <> 1) AS id_gaps, count(*) FILTER (m <> 300000) AS time_gaps FROM (SELECT *, window_id - lag(window_id) OVER w AS d, window_start_ms - lag(window_start_ms) OVER w AS m FROM spine WINDOW w AS (PARTITION BY split ORDER BY window_id)) GROUP BY 1"))
def _(t):
    return windows.check_continuity(spine(t), 300)


@query("w10_check_split_leakage", spine_duck(f"SELECT split, count(*) FILTER (split <> want) AS outside, min(window_id) FILTER (split <> want) AS example FROM (SELECT s.* EXCLUDE (split), CASE WHEN window_id % 1000 = 7 THEN 'test' ELSE split END AS split, {SPLIT.format('(window_start_ms * 1000)')} AS want FROM spine s, limits) GROUP BY 1"))
def _(t):
    moved = spine(t).withColumn("split", F.when(F.col("window_id") % 1000 == 7, "test").otherwise(F.col("split")))
    return windows.check_split_leakage(moved, windows.split_limits(t.flows()))


@query("w11_snapshot_time_range", spine_duck("SELECT split, count(*) AS snapshots, min(window_start_ms) AS first_ms, max(window_start_ms) AS last_ms FROM spine GROUP BY 1"))
def _(t):
    return windows.snapshot_time_range(spine(t))


@query("w12_split_flow_counts", duck("SELECT 'window' AS kind, split, count(*) AS flows, min(FLOW_START_MILLISECONDS) AS first_ms, max(FLOW_START_MILLISECONDS) AS last_ms FROM a GROUP BY 2 UNION ALL SELECT 'flow', split, count(*), min(FLOW_START_MILLISECONDS), max(FLOW_START_MILLISECONDS) FROM b GROUP BY 2", "windowed", "limits", a=BY_WINDOW, b=BY_FLOW))
def _(t):
    f = windows.split_by_flow(t.windowed(), windows.split_limits(t.flows()))
    rows = windows.split_flow_counts(by_window(t)).select(F.lit("window").alias("kind"), "*")
    return rows.union(windows.split_flow_counts(f).select(F.lit("flow").alias("kind"), "*"))


# profiles and grouped counts --------------------------------------------------


@query("a01_value_counts", duck("SELECT 'port' AS what, CAST(L4_DST_PORT AS VARCHAR) AS value, count(*) AS n FROM flows GROUP BY 2 UNION ALL SELECT 'protocol', CAST(PROTOCOL AS VARCHAR), count(*) FROM flows GROUP BY 2", "flows"))
def _(t):
    f = t.flows()
    of = lambda c, name: profile.value_counts(f, c).select(F.lit(name).alias("what"), F.col(c).cast("string").alias("value"), F.col("count").alias("n"))
    return of("L4_DST_PORT", "port").union(of("PROTOCOL", "protocol"))


@query("a02_hour_distribution", duck("SELECT CAST(hour(FLOW_START_TIME) AS INTEGER) AS hour, count(*) FILTER (Attack <> 'Infilteration') AS benign, count(*) FILTER (Attack = 'Infilteration') AS attack, round(count(*) FILTER (Attack = 'Infilteration') / CAST(count(*) AS DOUBLE), 6) AS ratio FROM flows GROUP BY 1", "flows"))
def _(t):
    return profile.hour_distribution(t.flows())


@query("a03_flows_per_window", duck(spine_sql(300_000, "count(*) FILTER (Attack = 'Benign') AS benign, count(*) FILTER (Attack = 'Infilteration') AS attack", ["benign", "attack"]), "flows"))
def _(t):
    return windows.resample(t.flows(), 300, benign=F.count_if(~profile.is_attack()), attack=F.count_if(profile.is_attack()))


_HOSTS = " UNION ALL ".join(
    f"SELECT {s} AS width_s, w AS window_ms, count(DISTINCT ip) FILTER (o) AS src_hosts, count(DISTINCT ip) FILTER (NOT o) AS dst_hosts, count(DISTINCT ip) AS hosts FROM (SELECT FLOW_START_MILLISECONDS // {s * 1000} * {s * 1000} AS w, ip, o FROM e) GROUP BY 2"
    for s in (30, 60, 300)
)
_ENDS = "SELECT FLOW_START_MILLISECONDS, IPV4_SRC_ADDR AS ip, true AS o FROM flows UNION ALL SELECT FLOW_START_MILLISECONDS, IPV4_DST_ADDR, false FROM flows"


@query("a04_unique_hosts_per_window", duck(_HOSTS, "flows", e=_ENDS))
def _(t):
    return profile.unique_hosts(t.flows())


@query("a04_host_sketches", duck(_HOSTS, "flows", e=_ENDS))
def _(t):
    """From sketches of 30 s, rolled up: exact here, as no window has over 4,096 hosts."""
    return profile.rolled_up(t.saved(profile.host_sketches(t.flows())))


@query("a05_flows_per_pair_window", duck("SELECT window_id, IPV4_SRC_ADDR, IPV4_DST_ADDR, count(*) AS flows FROM windowed GROUP BY 1, 2, 3", "windowed"))
def _(t):
    return profile.flows_per_pair_window(t.windowed())


@query("a06_pair_attack_pivot", duck("SELECT * FROM p", "windowed", p=PIVOT))
def _(t):
    return profile.pair_attack_pivot(t.windowed())


@query("a07_class_balance", duck("SELECT pos, neg, round(neg / CAST(pos AS DOUBLE), 6) AS pos_weight, round(ln(pos / CAST(neg AS DOUBLE)), 6) AS bias FROM (SELECT count(*) FILTER (y_real = 1) AS pos, count(*) FILTER (y_real = 0) AS neg FROM windowed)", "windowed"))
def _(t):
    return profile.class_balance(t.windowed())


_TRAIN = f"SELECT * FROM ({BY_WINDOW}) WHERE split = 'train'"
_SCALER = " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({x}) AS mean, CASE WHEN stddev_pop({x}) = 0 THEN 1 ELSE stddev_pop({x}) END AS scale FROM tr" for c in NUMERIC for x in [f"CASE WHEN {c} > -1 THEN ln(1e0 + {c}) END"])


def scaler_states(t):
    """Moments of the training flows, by day."""
    train = by_window(t).where("split = 'train'")
    return profile.moments(train.withColumn("chunk", F.date_format(F.timestamp_millis("FLOW_START_MILLISECONDS"), "yyyy-MM-dd")), ["chunk"])


def scaler(t):
    return profile.scaler_of(profile.merge_moments(t.saved(scaler_states(t))))


@query("a08_fit_scaler", duck("SELECT feature, round(mean, 6) AS mean, round(scale, 6) AS scale FROM sc", "windowed", "limits", tr=_TRAIN, sc=_SCALER))
def _(t):
    return scaler(t)


@query("a09_apply_scaler", duck("SELECT flow_ord, " + ", ".join(f"round(((CASE WHEN {c} > -1 THEN ln(1e0 + {c}) END) - (SELECT mean FROM sc WHERE feature = '{c}')) / (SELECT scale FROM sc WHERE feature = '{c}'), 4) AS {c}" for c in NUMERIC) + " FROM windowed", "windowed", "limits", tr=_TRAIN, sc=_SCALER))
def _(t):
    out = profile.apply_scaler(t.windowed(), scaler(t))
    return out.select("flow_ord", *[F.round(c, 4).alias(c) for c in NUMERIC])


@query("a10_null_profile", duck("SELECT * FROM (SELECT 'flow_byts' AS \"column\", count(*) FILTER (flow_byts IS NULL) AS nulls FROM raw UNION ALL SELECT 'ts_text', count(*) FILTER (ts_text IS NULL) FROM raw) WHERE nulls > 0", "raw"))
def _(t):
    return profile.null_profile(t.raw())


@query("a11_labels_of_missing", duck("SELECT Label, count(*) AS count FROM raw WHERE flow_byts IS NULL GROUP BY 1", "raw"))
def _(t):
    return profile.labels_of_missing(t.raw(), "flow_byts")


@query("a12_non_numeric_profile", duck("SELECT c AS \"column\", v AS value, count(*) AS n FROM (SELECT 'flow_byts' AS c, flow_byts AS v FROM raw UNION ALL SELECT 'Label', Label FROM raw) WHERE v IS NOT NULL AND TRY_CAST(v AS DOUBLE) IS NULL GROUP BY 1, 2", "raw"))
def _(t):
    return profile.non_numeric_profile(t.raw(), ["flow_byts", "Label"])


_DESCRIBE = "SELECT count(*) AS count, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std, min({0}) AS min, round(quantile_cont({0}, 0.25), 6) AS p25, round(quantile_cont({0}, 0.5), 6) AS p50, round(quantile_cont({0}, 0.75), 6) AS p75, max({0}) AS max FROM flows"


@query("a13_describe", duck(_DESCRIBE.format("IN_BYTES"), "flows"))
def _(t):
    return profile.describe(t.flows(), "IN_BYTES")


@query("a13_describe_sketch")
def _(t):
    """Quartiles from KLL sketches by day, merged: within the sketches' rank error, which a test checks."""
    days = t.flows().withColumn("day", F.expr("FLOW_START_MILLISECONDS div 86400000"))
    return profile.describe_sketches(t.saved(profile.quantile_sketches(days, "IN_BYTES", ["day"])))


@query("a14_distinct_values", duck("SELECT DISTINCT Attack, PROTOCOL FROM flows", "flows"))
def _(t):
    return t.flows().select("Attack", "PROTOCOL").distinct()


@query("a15_time_extent", duck("SELECT min(FLOW_START_MILLISECONDS) AS start_ms, max(FLOW_START_MILLISECONDS) AS end_ms, max(FLOW_START_MILLISECONDS) - min(FLOW_START_MILLISECONDS) AS duration_ms FROM flows", "flows"))
def _(t):
    return windows.extent(t.flows()).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


@query("a16_content_stats", duck("SELECT window_id, count(*) AS flows, CAST(sum(y_real) AS BIGINT) AS attacks, round(sum(y_real) * 100.0 / count(*), 6) AS attack_pct, count(*) FILTER (RETRANSMITTED_IN_PKTS <= -1) AS bad FROM windowed WHERE window_id IN (SELECT window_id FROM (SELECT DISTINCT window_id FROM windowed) ORDER BY md5(CAST(window_id AS VARCHAR)), window_id LIMIT 50) GROUP BY 1", "windowed"))
def _(t):
    return profile.content_stats(t.windowed().select("window_id", F.col("y_real").alias("y"), C.edge_features().alias("features")))


@query("a19_total_flows", duck("SELECT count(*) AS total FROM windowed", "windowed"))
def _(t):
    return t.total()


# sources and sinks ----------------------------------------------------------------


def _path(t, name):
    return f"{shared_root(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("s01_read_flows", duck("SELECT flow_ord, IPV4_SRC_ADDR, IN_BYTES FROM flows", "flows"))
def _(t):
    path = _path(t, "flows") + ".csv"
    full = t.flows().withColumn("Label", C.label_flag()).withColumn("FLOW_START_TIME", F.lit(None).cast("timestamp"))
    full.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FLOW]).write.option("header", True).csv(path)
    return io.read_flows(t.spark, path, ["flow_ord", SRC, "IN_BYTES"])


@query("s02_slice_day", duck(f"SELECT flow_ord, FLOW_START_MILLISECONDS FROM flows WHERE FLOW_START_MILLISECONDS >= {DAY_MS} AND FLOW_START_MILLISECONDS < {DAY_MS + 86_400_000}", "flows"))
def _(t):
    return windows.slice_day(t.flows(), DAY).select("flow_ord", "FLOW_START_MILLISECONDS")


@query("s03_day_slice_sink", duck(f"SELECT flow_ord, FLOW_START_MILLISECONDS, Attack FROM flows WHERE FLOW_START_MILLISECONDS >= {DAY_MS} AND FLOW_START_MILLISECONDS < {DAY_MS + 86_400_000}", "flows"))
def _(t):
    path = _path(t, "day")
    io.write_day(windows.slice_day(t.flows(), DAY).select("flow_ord", "FLOW_START_MILLISECONDS", "Attack"), path)
    return t.spark.read.parquet(path)


@query("s04_read_raw_flowmeter", duck("SELECT CAST(row_ord AS VARCHAR) AS row_ord, ts_text, flow_byts, Label FROM raw", "raw"))
def _(t):
    path = _path(t, "raw")
    t.raw().write.option("header", True).csv(path)
    return io.read_raw_flowmeter(t.spark, path)


@query("s05_split_sink", duck("SELECT split, count(*) AS n FROM s GROUP BY 1", "windowed", "limits", s=BY_FLOW))
def _(t):
    path = _path(t, "splits")
    io.write_splits(windows.split_by_flow(t.windowed(), windows.split_limits(t.flows())).select("flow_ord", "split", "y_real"), path)
    return t.spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))


@query("s06_snapshot_sink", spine_duck("SELECT split, window_id, flows, is_empty FROM spine WHERE split = 'val'"))
def _(t):
    path = _path(t, "snapshots")
    io.write_snapshots(spine(t).select("split", "window_id", "flows", "is_empty"), path)
    return io.read_snapshots(t.spark, path, "val").select("split", "window_id", "flows", "is_empty")


@query("s08_scaler_round_trip", duck("SELECT feature, round(mean, 6) AS mean, round(scale, 6) AS scale FROM sc", "windowed", "limits", tr=_TRAIN, sc=_SCALER))
def _(t):
    path = _path(t, "scaler")
    states = t.saved(scaler_states(t))
    even = F.substring("chunk", 10, 1).cast("int") % 2 == 0
    # later chunks extend what was saved; a chunk saved twice counts once
    for part in (states.where(even), states.where(~even), states.where(even)):
        io.extend_scaler(part, path)
    return profile.scaler_of(profile.merge_moments(io.load_scaler_state(t.spark, path)))


@query("s09_append_run", duck("SELECT model_name, Seed, F1_Score, CASE WHEN Best_Epoch >= 30 THEN Best_Epoch END AS Best_Epoch FROM runs", "runs"), exact=True)
def _(t):
    path = _path(t, "log")
    runs = t.runs()
    io.append_run(path, runs.where("Best_Epoch < 30").select("model_name", "Seed", "F1_Score"))
    for _ in range(2):  # an append that is repeated leaves its runs once
        io.append_run(path, runs.where("Best_Epoch >= 30").select("model_name", "Seed", "F1_Score", "Best_Epoch"))
    return io.read_run_log(t.spark, path).select("model_name", "Seed", "F1_Score", "Best_Epoch")


@query("s11_read_metric_logs", duck("SELECT 'd=' || replace(Architecture, ' ', '_') AS experiment, CAST(Seed AS INTEGER) AS seed, round(F1_Score, 6) AS f1, CASE WHEN Seed % 2 = 1 THEN round(Best_Epoch / 64.0e0, 6) END AS recall, CASE WHEN Architecture = '1-URGENT' THEN 'Simple MLP' ELSE 'd=' || replace(Architecture, ' ', '_') END AS \"Model\" FROM runs", "runs"))
def _(t):
    path = _path(t, "metric-logs")
    # two kinds of files: headers in other order, other case, other names
    runs = t.runs().select(F.translate("Architecture", " ", "_").alias("d"), "F1_Score", "Seed", (F.col("Best_Epoch") / 64).alias("part"))
    one = runs.where("Seed % 2 = 0").select("d", F.col("F1_Score").alias(" F1 "), F.col("Seed").alias("Seed "))
    two = runs.where("Seed % 2 = 1").select("d", F.concat(F.lit("net_seed"), "Seed").alias("Model_Name"), F.col("part").alias("Recall"), F.col("F1_Score").alias("best F1"))
    for rows in (one, two):
        rows.write.partitionBy("d").mode("append").option("header", True).option("maxRecordsPerFile", 50_000).csv(path)
    names = t.spark.createDataFrame([("d=1-URGENT", "Simple MLP")], "experiment string, name string")
    return io.read_metric_logs(t.spark, path, names, "part-*.csv").select("experiment", "seed", "f1", "recall", "Model")


@query("s12_thresholds_round_trip", duck("SELECT Architecture AS experiment, CAST(Seed AS INTEGER) AS seed, round(F1_Score, 6) AS optimal_threshold FROM runs", "runs"))
def _(t):
    path = _path(t, "thresholds")
    io.save_thresholds(t.runs().select(F.col("Architecture").alias("experiment"), F.col("Seed").cast("int").alias("seed"), F.col("F1_Score").alias("optimal_threshold")), path)
    return io.load_thresholds(t.spark, path)


@query("s13_event_sink", duck('SELECT "Graph_Window_Idx", Source_IP, Dest_IP, MITRE_Tactic_Base, count(*) AS n FROM ev GROUP BY ALL', "ev"))
def _(t):
    path = _path(t, "events")
    io.write_events(t.events(), path)
    return t.spark.read.parquet(path).groupBy("Graph_Window_Idx", "Source_IP", "Dest_IP", "MITRE_Tactic_Base").agg(F.count("*").alias("n"))


@query("s14_test_metrics_sink", duck("SELECT Architecture, Seed, round(F1_Score, 6) AS F1_Score, CASE WHEN Architecture <> '1-URGENT' THEN Best_Epoch END AS Best_Epoch FROM runs", "runs"))
def _(t):
    path = _path(t, "metrics")
    r = t.runs()
    io.write_test_metrics([r.where("Architecture = '1-URGENT'").select("Architecture", "Seed", "F1_Score"), r.where("Architecture <> '1-URGENT'").select("Architecture", "Seed", "F1_Score", "Best_Epoch")], path)
    return t.spark.read.parquet(path)


# joins, windows, sorts and sets -------------------------------------------------

FIRST = "SELECT IPV4_SRC_ADDR AS ip, min(window_id) AS first_window FROM windowed GROUP BY 1"


def first_windows(t):
    return t.windowed().groupBy(F.col(SRC).alias("ip")).agg(F.min("window_id").alias("first_window"))


@query("j01_inner_join", duck("SELECT f.flow_ord, f.window_id - h.first_window AS age FROM windowed f JOIN h ON f.IPV4_DST_ADDR = h.ip", "windowed", h=FIRST))
def _(t):
    return t.windowed().join(first_windows(t).withColumnRenamed("ip", DST), DST).select("flow_ord", (F.col("window_id") - F.col("first_window")).alias("age"))


@query("j02_left_join_drop", duck("SELECT r.MITRE_Tactic_Base, r.n AS real, d.n AS hits FROM (SELECT MITRE_Tactic_Base, count(*) AS n FROM gt GROUP BY 1) r JOIN (SELECT MITRE_Tactic_Base, count(*) AS n FROM tp GROUP BY 1) d USING (MITRE_Tactic_Base)", "gt", "tp"))
def _(t):
    e = t.events()
    r = threat.gt(e).groupBy(threat.TACTIC).agg(F.count("*").alias("real"))
    return r.join(threat.tp(e).groupBy(threat.TACTIC).agg(F.count("*").alias("hits")), threat.TACTIC, "left").where("hits IS NOT NULL")


@query("j03_left_join_fill", duck("SELECT r.*, coalesce(d.hits, 0) AS hits FROM (SELECT MITRE_Tactic_Base, \"Graph_Window_Idx\", count(*) AS real FROM gt GROUP BY 1, 2) r LEFT JOIN (SELECT MITRE_Tactic_Base, \"Graph_Window_Idx\", count(*) AS hits FROM tp GROUP BY 1, 2) d USING (MITRE_Tactic_Base, \"Graph_Window_Idx\")", "gt", "tp"))
def _(t):
    e, k = t.events(), [threat.TACTIC, threat.IDX]
    return threat.gt(e).groupBy(*k).agg(F.count("*").alias("real")).join(threat.tp(e).groupBy(*k).agg(F.count("*").alias("hits")), k, "left").fillna(0)


@query("j04_dictionary_lookup", duck("SELECT flow_ord, coalesce(CASE WHEN IPV4_SRC_ADDR LIKE '172.31.%' THEN IPV4_SRC_ADDR END, 'Unknown') AS \"Source_IP\" FROM windowed", "windowed"))
def _(t):
    f = t.windowed()
    known = f.where(F.col(SRC).startswith("172.31.")).select(SRC).distinct().withColumn("Source_IP", F.col(SRC))
    return f.join(known, SRC, "left").select("flow_ord", F.coalesce("Source_IP", F.lit("Unknown")).alias("Source_IP"))


_LISTED = ", ".join(repr(i) for i in (*ATTACKERS, *FOCUS))


@query("j05_semi_join", duck(f"SELECT flow_ord, IPV4_SRC_ADDR FROM windowed WHERE IPV4_SRC_ADDR IN ({_LISTED})", "windowed"))
def _(t):
    ips = t.ips((*ATTACKERS, *FOCUS)).withColumnRenamed("ip", SRC)
    return t.windowed().join(F.broadcast(ips), SRC, "left_semi").select("flow_ord", SRC)


@query("j06_anti_join", duck("SELECT Architecture AS experiment, Seed AS seed FROM runs WHERE Best_Epoch < 20", "runs"))
def _(t):
    runs = t.runs().select(F.col("Architecture").alias("experiment"), F.col("Seed").alias("seed"), "Best_Epoch")
    return experiments.pending_experiments(runs.drop("Best_Epoch"), runs.where("Best_Epoch >= 20"))


@query("f05_previous_snapshot", spine_duck("SELECT split, window_id, flows - lag(flows) OVER (PARTITION BY split ORDER BY window_id) AS change FROM spine"))
def _(t):
    out = with_previous(spine(t).select("split", "window_id", "flows"), ["split"], ["window_id"], ["flows"])
    return out.select("split", "window_id", (F.col("flows") - F.col("prev_flows")).alias("change"))


@query("k02_top_ports", duck("SELECT L4_DST_PORT, count(*) AS count FROM flows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "flows"))
def _(t):
    return profile.value_counts(t.flows(), "L4_DST_PORT", 10)


@query("k04_union_all", duck("SELECT split, count(*) AS n FROM (SELECT * FROM s WHERE split = 'train' UNION ALL SELECT * FROM s WHERE split = 'val' UNION ALL SELECT * FROM s WHERE split = 'test') GROUP BY 1", "windowed", "limits", s=BY_FLOW))
def _(t):
    s = windows.split_by_flow(t.windowed(), windows.split_limits(t.flows())).select("flow_ord", "split")
    return s.where("split = 'train'").unionByName(s.where("split = 'val'")).unionByName(s.where("split = 'test'")).groupBy("split").agg(F.count("*").alias("n"))


@query("k05_multiset_sum", duck("SELECT IPV4_SRC_ADDR, IPV4_DST_ADDR, count(*) AS attacks FROM windowed WHERE y_real = 1 GROUP BY 1, 2", "windowed"))
def _(t):
    s = windows.split_by_flow(t.windowed(), windows.split_limits(t.flows())).where("y_real = 1")
    per = [s.where(F.col("split") == k).groupBy(SRC, DST).agg(F.count("*").alias("attacks")) for k in ("train", "val", "test")]
    return per[0].unionByName(per[1]).unionByName(per[2]).groupBy(SRC, DST).agg(F.sum("attacks").alias("attacks"))


@query("k06_set_difference", duck('SELECT DISTINCT MITRE_Tactic_Base, "Graph_Window_Idx" FROM gt EXCEPT SELECT DISTINCT MITRE_Tactic_Base, "Graph_Window_Idx" FROM tp', "gt", "tp"))
def _(t):
    e, k = t.events(), [threat.TACTIC, threat.IDX]
    return threat.gt(e).select(*k).distinct().join(threat.tp(e).select(*k).distinct(), k, "left_anti")


@query("k07_set_union", duck("SELECT window_id, IPV4_SRC_ADDR AS ip FROM windowed UNION SELECT window_id, IPV4_DST_ADDR FROM windowed", "windowed"))
def _(t):
    w = t.windowed()
    return w.select("window_id", F.explode(F.array(SRC, DST)).alias("ip")).distinct()


@query("k08_deduplicate_pairs", duck("SELECT DISTINCT Source_IP, Dest_IP FROM tp WHERE MITRE_Tactic_Base = 'Lateral Movement'", "tp"))
def _(t):
    return threat.tp(t.events()).where(F.col(threat.TACTIC) == threat.LATERAL).select("Source_IP", "Dest_IP").dropDuplicates()
