"""Views over the driver tables that play the part of flows, runs and raw files,
from one text for Spark and DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ROLE_PORTS, ROLES, label_flag, port_role, valid_ips
from ..operators import threat, windows
from ..operators.ranking import shared_root, shared_table
from ..sources import io

MS = {
    "spark": "(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) div 1000)",
    "duck": "(epoch_us(ts) // 1000)",
}
DMY = {"spark": "date_format(ts, 'dd/MM/yyyy HH:mm:ss')", "duck": "strftime(ts, '%d/%m/%Y %H:%M:%S')"}

#: Whole-number expressions of the features that the events table lacks.
FEATURES = {
    "OUT_BYTES": "(event_id * 13 + k) % 5000",
    "IN_PKTS": "(event_id * 7 + k) % 50",
    "OUT_PKTS": "(event_id * 11 + k) % 40",
    "FLOW_DURATION_MILLISECONDS": "(event_id * 37 + k * 3) % 60000",
    "DURATION_IN": "(event_id * 5 + k) % 900",
    "DURATION_OUT": "(event_id * 3 + k) % 700",
    "SRC_TO_DST_IAT_AVG": "((event_id * 17 + k) % 1000) / 8e0",
    "DST_TO_SRC_IAT_AVG": "((event_id * 19 + k) % 1000) / 8e0",
    "SRC_TO_DST_IAT_STDDEV": "((event_id * 23 + k) % 500) / 4e0",
    "DST_TO_SRC_IAT_STDDEV": "((event_id * 29 + k) % 500) / 4e0",
    "MIN_IP_PKT_LEN": "(event_id + k) % 60",
    "MAX_IP_PKT_LEN": "60 + (event_id * 31 + k) % 1440",
    "RETRANSMITTED_IN_PKTS": "(event_id * 41 + k) % 4 - 2",
    "RETRANSMITTED_OUT_PKTS": "event_id * 0",
    "TCP_WIN_MAX_IN": "(event_id * 43 + k) % 65536",
    "TCP_WIN_MAX_OUT": "(event_id * 47 + k) % 65536",
    "TCP_FLAGS": "(event_id + k) % 64",
    "MIN_TTL": "32 + (event_id % 3) * 32",
    "MAX_TTL": "64 + (event_id % 3) * 64",
}


def flows_sql(engine: str) -> str:
    more = ",\n ".join(f"{v} AS {k}" for k, v in FEATURES.items())
    return f"""SELECT event_id AS flow_ord, ms AS FLOW_START_MILLISECONDS, ts AS FLOW_START_TIME,
 CASE WHEN event_id % 97 = 0 THEN '0.0.0.0'
      WHEN user_id % 5 = 4 THEN concat('52.', CAST(user_id % 7 AS VARCHAR(10)), '.10.', CAST(user_id % 50 + 1 AS VARCHAR(10)))
      ELSE concat('172.31.', CAST(user_id % 4 AS VARCHAR(10)), '.', CAST(user_id % 60 + 1 AS VARCHAR(10))) END AS IPV4_SRC_ADDR,
 CASE WHEN k % 10 = 7 THEN '94.182.163.51'
      WHEN k % 10 = 3 THEN concat('8.8.', CAST(k % 4 AS VARCHAR(10)), '.', CAST(k % 9 + 1 AS VARCHAR(10)))
      ELSE concat('172.31.', CAST(k % 4 AS VARCHAR(10)), '.', CAST(k % 60 + 1 AS VARCHAR(10))) END AS IPV4_DST_ADDR,
 CASE (event_id * 31 + k) % 16 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 8080 WHEN 3 THEN 22 WHEN 4 THEN 3389 WHEN 5 THEN 445
   WHEN 6 THEN 139 WHEN 7 THEN 53 WHEN 8 THEN 5355 WHEN 9 THEN 3306 WHEN 10 THEN 0 WHEN 11 THEN 999 WHEN 12 THEN 1024 WHEN 13 THEN 49152 WHEN 14 THEN 445 ELSE 53 END AS L4_DST_PORT,
 CASE event_type WHEN 'click' THEN 6 WHEN 'view' THEN 17 WHEN 'error' THEN 6 WHEN 'signup' THEN 1 ELSE 47 END AS PROTOCOL,
 CAST(floor(value * 100) AS BIGINT) AS IN_BYTES,
 {more},
 CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'Infilteration' ELSE 'Benign' END AS Attack,
 CAST((event_id * 7919 + k * 104729) % 1000 AS DOUBLE) / 1250e0
   + CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 0.2e0 ELSE 0e0 END AS Probability
FROM (SELECT *, {MS[engine]} AS ms, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) e"""


RUNS_SQL = """SELECT o_orderpriority AS Architecture, concat(o_orderpriority, '_seed', CAST(o_orderkey AS VARCHAR(20)), '_run') AS model_name,
 CAST(o_orderkey AS BIGINT) AS Seed, o_totalprice / 1000000e0 AS F1_Score, CAST(o_custkey % 60 AS INT) AS Best_Epoch
FROM orders"""


def raw_sql(engine: str) -> str:
    return f"""SELECT event_id AS row_ord,
 CASE WHEN event_id % 50 = 0 THEN 'Timestamp' WHEN event_id % 53 = 0 THEN 'bad' ELSE {DMY[engine]} END AS ts_text,
 CASE WHEN event_id % 50 = 0 THEN 'Flow Byts/s' WHEN event_id % 41 = 0 THEN 'Infinity' WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 47 = 0 THEN 'n/a'
      ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR(20)) END AS flow_byts,
 CASE WHEN event_id % 50 = 0 THEN 'Label' WHEN event_type = 'error' THEN 'Infilteration' ELSE 'Benign' END AS Label
FROM events"""


THRESHOLD, HOUR = 0.7, 3600
C2, DNS_SUSPICIOUS = ("94.182.163.51",), ("94.182.163.51",)
ATTACKERS = ("52.2.10.10", "52.3.10.25", "52.4.10.40")
FOCUS, WHITELIST = ("172.31.1.18", "172.31.2.7"), ("172.31.1.18", "172.31.2.7")


class Tables:
    """The frames that queries start from, over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, sql: str, source: str) -> DataFrame:
        return self.spark.sql(sql.replace(f"FROM {source}", "FROM {src}"), src=self.table(source))

    def flows(self) -> DataFrame:
        return self.view(flows_sql("spark"), "events")

    def runs(self) -> DataFrame:
        return self.view(RUNS_SQL, "orders")

    def raw(self) -> DataFrame:
        return self.view(raw_sql("spark"), "events")

    def ips(self, ips) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ips], "ip string")

    def windowed(self, seconds: int = HOUR) -> DataFrame:
        """Valid flows with roles, labels and windows anchored at the first of all flows."""
        flows = windows.assign_window(self.flows(), seconds).where(valid_ips())
        hit = (F.col("Probability") >= THRESHOLD).cast("int")
        return flows.withColumns({"Port_Category": port_role(), "y_real": label_flag(), "y_pred": hit})

    def scored(self) -> DataFrame:
        return self.windowed().withColumnsRenamed({"window_id": "Graph_Window_Idx", "IPV4_SRC_ADDR": "Source_IP", "IPV4_DST_ADDR": "Dest_IP"})

    def events(self) -> DataFrame:
        return threat.mitre_events(self.scored(), self.ips(C2), self.ips(ATTACKERS), THRESHOLD)

    def total(self) -> DataFrame:
        return self.windowed().agg(F.count("*").alias("total"))

    def ruled(self) -> DataFrame:
        return threat.soc_rules(self.scored(), self.ips(DNS_SUSPICIOUS), self.ips(WHITELIST), self.ips(FOCUS))

    def saved(self, df: DataFrame) -> DataFrame:
        return shared_table(df)

    def saved_colocated(self, build: Callable[..., DataFrame], *tables: DataFrame, buckets: int = 16) -> DataFrame:
        """What ``build`` makes of the tables, each written in buckets of windows first."""
        names = [f"buckets_{uuid.uuid4().hex}" for _ in tables]
        for name, table in zip(names, tables, strict=True):
            io.write_buckets(table, name, f"{shared_root(self.spark)}/{name}", buckets)
        with io.colocated(self.spark):
            out = self.saved(build(*map(self.spark.table, names)))
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
        return out


# The same frames for DuckDB, as common table expressions.

def _in(column: str, values) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def role_sql(port: str = "L4_DST_PORT") -> str:
    whens = " ".join(f"WHEN {_in(port, ports)} THEN '{role}'" for role, ports in ROLE_PORTS.items())
    return f"CASE {whens} WHEN {port} < 1024 THEN '{ROLES[5]}' ELSE '{ROLES[6]}' END"


# Tactic labels, as in columns.mitre_tactic.
def tactic_sql() -> str:
    a, b = "Source_IP LIKE '172.31.%'", "Dest_IP LIKE '172.31.%'"
    att, c2, p, high = _in("Source_IP", ATTACKERS), _in("Dest_IP", C2), "Port_Category", ROLES[6]
    return f"""CASE WHEN {att} AND {b} THEN CASE WHEN {p} IN ('Web', '{high}') THEN '1. Initial Access / Exploitation (Medium Confidence)' ELSE '1. Initial Access (Port: ' || {p} || ')' END
 WHEN {a} AND {c2} THEN CASE WHEN {p} IN ('Web', 'DNS') THEN '2. Command & Control (Stealth/Web/DNS)' WHEN {p} = '{high}' THEN '2. Command & Control (Custom/High Port)' ELSE '2. Command & Control (Port: ' || {p} || ')' END
 WHEN {a} AND {b} THEN CASE WHEN {p} IN ('Windows/SMB', 'Admin/Remote') THEN '3. Lateral Movement (' || {p} || ')' WHEN {p} = 'Database' THEN '3. Discovery / Targeting Internal Data Stores'
   WHEN {p} IN ('{ROLES[5]}', '{high}') THEN '3. Discovery / Possible Internal Reconnaissance' ELSE '3. Internal Malicious Activity (Port: ' || {p} || ')' END
 WHEN {att} THEN '4. External Malicious Infrastructure Communication' ELSE 'Unknown Malicious Activity' END"""


# Tactic names and their short forms.
BASE_SQL = """CASE WHEN starts_with(MITRE_Tactic, '1. Initial Access') THEN 'Initial Access' WHEN starts_with(MITRE_Tactic, '2. Command & Control') THEN 'Command & Control'
 WHEN starts_with(MITRE_Tactic, '3. Lateral Movement') THEN 'Lateral Movement' WHEN starts_with(MITRE_Tactic, '3. Discovery') THEN 'Discovery'
 WHEN starts_with(MITRE_Tactic, '3. Internal Malicious Activity') THEN 'Internal Malicious Activity'
 WHEN starts_with(MITRE_Tactic, '4. External Malicious Infrastructure Communication') THEN 'External Malicious Infrastructure Communication' ELSE 'Unknown' END"""

ANCHOR = "(SELECT min(FLOW_START_MILLISECONDS) FROM flows)"
CTES = {
    "flows": flows_sql("duck"),
    "windowed": f"""SELECT *, {role_sql()} AS Port_Category, CASE WHEN Attack = 'Infilteration' THEN 1 ELSE 0 END AS y_real, CAST(Probability >= 0.7 AS INTEGER) AS y_pred,
 (FLOW_START_MILLISECONDS - {ANCHOR}) // {HOUR * 1000} AS window_id FROM flows WHERE IPV4_SRC_ADDR <> '0.0.0.0' AND IPV4_DST_ADDR <> '0.0.0.0'""",
    "scored": "SELECT * EXCLUDE (IPV4_SRC_ADDR, IPV4_DST_ADDR, window_id), IPV4_SRC_ADDR AS Source_IP, IPV4_DST_ADDR AS Dest_IP, window_id AS Graph_Window_Idx FROM windowed",
    "labelled": f"SELECT *, {BASE_SQL} AS MITRE_Tactic_Base FROM (SELECT *, {tactic_sql()} AS MITRE_Tactic FROM scored)",
    "ev": "SELECT * FROM labelled WHERE y_real = 1 OR y_pred = 1",
    "gt": "SELECT * FROM ev WHERE y_real = 1",
    "tp": "SELECT * FROM ev WHERE y_real = 1 AND y_pred = 1",
    "fp": "SELECT * FROM ev WHERE y_real = 0 AND y_pred = 1",
    "limits": "SELECT s * 1000 AS start_us, s * 1000 + (e - s) * 1000 * 70 // 100 AS train_end_us, s * 1000 + (e - s) * 1000 * 85 // 100 AS val_end_us, e * 1000 AS end_us FROM (SELECT min(FLOW_START_MILLISECONDS) AS s, max(FLOW_START_MILLISECONDS) AS e FROM flows)",
    "ruled": f"""SELECT *, CAST({_in('Dest_IP', DNS_SUSPICIOUS)} AND Port_Category = 'DNS' AND y_real = 0 AND y_pred = 1 AS INTEGER) AS dns_rule_applied,
 CAST({_in('Source_IP', WHITELIST)} AND Port_Category = 'Windows/SMB' AND y_real = 0 AND y_pred = 1 AS INTEGER) AS smb_rule_applied,
 CAST({_in('Source_IP', FOCUS)} AS INTEGER) AS focus_src, CAST({_in('Dest_IP', FOCUS)} AS INTEGER) AS focus_dst FROM scored""",
    "runs": RUNS_SQL,
    "raw": raw_sql("duck"),
}
#: What each expression needs before it.
NEEDS = {"windowed": ["flows"], "scored": ["flows", "windowed"], "labelled": ["flows", "windowed", "scored"], "limits": ["flows"]}
NEEDS["ev"] = [*NEEDS["labelled"], "labelled"]
NEEDS |= {k: [*NEEDS["ev"], "ev"] for k in ("gt", "tp", "fp")} | {"ruled": [*NEEDS["scored"], "scored"]}


def duck(body: str, *ctes: str, **own: str) -> str:
    """A statement over the named expressions, with further ones of its own. Labels are
    worked out once; a predicate on them pushed into their cases takes minutes."""
    names = list(dict.fromkeys(n for c in ctes for n in (*NEEDS.get(c, []), c)))
    parts = [f"{n} AS {'MATERIALIZED ' if n == 'labelled' else ''}({CTES[n]})" for n in names] + [f"{k} AS ({v})" for k, v in own.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
