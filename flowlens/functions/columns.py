"""Scalar functions on columns: all native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NUMERIC

#: Port role names, in the order of the one-hot vector.
ROLES = ("Web", "Admin/Remote", "Windows/SMB", "DNS", "Database", "Other Privileged (< 1024)", "High Ports / Ephemeral (>= 1024)")
#: Ports of the first five roles.
ROLE_PORTS = {
    "Web": (80, 443, 8080, 8443, 81, 3128, 8545),
    "Admin/Remote": (22, 222, 2222, 23, 2323, 3389, 3390, 3394, 5900, 5901, 5555, 21, 2131),
    "Windows/SMB": (445, 135, 137, 138, 139),
    "DNS": (53, 5355, 67, 547, 123, 1900, 5060),
    "Database": (1433, 3306, 5432, 6379, 27017),
}
#: Protocol classes in the order of the one-hot vector; other numbers are Other.
PROTOCOLS = {"TCP": (6,), "UDP": (17,), "ICMP": (1, 58), "IGMP": (2,)}
PROTOCOL_CLASSES = (*PROTOCOLS, "Other")
ATTACK = "Infilteration"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_ips(src="IPV4_SRC_ADDR", dst="IPV4_DST_ADDR") -> Column:
    """Neither end is 0.0.0.0."""
    return (col(src) != "0.0.0.0") & (col(dst) != "0.0.0.0")


def label_flag(attack="Attack") -> Column:
    return F.coalesce(col(attack) == ATTACK, F.lit(False)).cast("int")


def log_features() -> dict[str, Column]:
    """log1p of the numeric features; null at or below -1."""
    return {c: F.log1p(F.col(c).cast("double")) for c in NUMERIC}


def port_role(port="L4_DST_PORT") -> Column:
    """The first role that holds the port: exclusive."""
    p = col(port)
    out = F.when(p.isNull(), None)
    for role, ports in ROLE_PORTS.items():
        out = out.when(p.isin(*ports), role)
    return out.when(p < 1024, ROLES[5]).otherwise(ROLES[6])


def port_role_flags(port="L4_DST_PORT") -> dict[str, Column]:
    """Seven flags that overlap: every port from 1024 on is high, and a database
    port below 1024 would be low as well."""
    p = col(port)
    names = ("Role_Web", "Role_Admin", "Role_Win", "Role_Infra", "Role_DB")
    hit = dict(zip(names, (p.isin(*v) for v in ROLE_PORTS.values()), strict=True))
    low = (p < 1024) & ~hit["Role_Web"] & ~hit["Role_Admin"] & ~hit["Role_Win"] & ~hit["Role_Infra"]
    return {k: v.cast("int") for k, v in {**hit, "Role_LowPriv": low, "Role_HighPriv": p >= 1024}.items()}


def protocol_class(protocol="PROTOCOL") -> Column:
    p = col(protocol)
    out = None
    for name, numbers in PROTOCOLS.items():
        out = F.when(p.isin(*numbers), name) if out is None else out.when(p.isin(*numbers), name)
    return out.otherwise(PROTOCOL_CLASSES[-1])


def one_hot(value: Column, classes: Sequence[str]) -> Column:
    return F.array(*[(value == c).cast("float") for c in classes])


def edge_features(numeric: dict[str, Column] | None = None) -> Column:
    """Role (7), protocol (5) and numeric (20) parts as one array of 32 floats."""
    numeric = numeric or log_features()
    return F.concat(one_hot(port_role(), ROLES), one_hot(protocol_class(), PROTOCOL_CLASSES), F.array(*[numeric[c].cast("float") for c in NUMERIC]))


def decode_role(features="features") -> Column:
    """Name of the largest of the first seven slots, the first of equals."""
    part = F.slice(col(features), 1, len(ROLES))
    return F.element_at(F.array(*map(F.lit, ROLES)), F.array_position(part, F.array_max(part)).cast("int"))


def coerce_numeric(text) -> Column:
    return col(text).try_cast("double")


def parse_day_first(text) -> Column:
    return F.try_to_timestamp(col(text), F.lit("dd/MM/yyyy HH:mm:ss"))


def hour_text(text) -> Column:
    """The hour as written, null where the text has no such part."""
    part = F.split_part(F.split_part(col(text), F.lit(" "), F.lit(2)), F.lit(":"), F.lit(1))
    return F.nullif(part, F.lit(""))


def floor_time(ts, width: str = "5 minutes") -> Column:
    return F.window(col(ts), width)["start"]


def base_model_name(name) -> Column:
    return F.split_part(col(name), F.lit("_seed"), F.lit(1))


def extract_seed(name) -> Column:
    return F.nullif(F.regexp_extract(col(name), r"(?i)seed_?(\d+)", 1), F.lit("")).cast("int")


def ipv4_number(ip) -> Column:
    """The address as a number; null for other texts."""
    ip = col(ip)
    parts = [F.split_part(ip, F.lit("."), F.lit(i)).try_cast("long") for i in range(1, 5)]
    ok = ip.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    for p in parts:
        ok &= p <= 255
    return F.when(ok, parts[0] * (1 << 24) + parts[1] * (1 << 16) + parts[2] * (1 << 8) + parts[3])


def in_cidr(ip, net: str) -> Column:
    """Whether the address lies in the network; null for texts that are no IPv4 address."""
    base, _, bits = net.partition("/")
    a, b, c, d = map(int, base.split("."))
    size = 1 << (32 - int(bits or 32))
    start = ((a << 24) + (b << 16) + (c << 8) + d) // size * size
    return ipv4_number(ip).between(start, start + size - 1)


INTERNAL = "172.31.0.0/16"
UNKNOWN_TACTIC = "Unknown Malicious Activity"


def mitre_tactic(src, dst, role, src_attacker: Column, dst_c2: Column, net: str = INTERNAL) -> Column:
    """Tactic label of a flow from the ends' places, list membership and the port
    role. The memberships come in as booleans so that lists can be joined."""
    role = col(role)
    a, b = F.coalesce(in_cidr(src, net), F.lit(False)), F.coalesce(in_cidr(dst, net), F.lit(False))
    known = ipv4_number(src).isNotNull() & ipv4_number(dst).isNotNull()
    web, high = role == "Web", role == ROLES[6]

    def text(before: str, after: str) -> Column:
        return F.concat(F.lit(before), role, F.lit(after))

    entry = F.when(web | high, "1. Initial Access / Exploitation (Medium Confidence)").otherwise(text("1. Initial Access (Port: ", ")"))
    command = F.when(web | (role == "DNS"), "2. Command & Control (Stealth/Web/DNS)").when(high, "2. Command & Control (Custom/High Port)").otherwise(text("2. Command & Control (Port: ", ")"))
    inside = (
        F.when(role.isin("Windows/SMB", "Admin/Remote"), text("3. Lateral Movement (", ")"))
        .when(role == "Database", "3. Discovery / Targeting Internal Data Stores")
        .when(role.isin(ROLES[5], ROLES[6]), "3. Discovery / Possible Internal Reconnaissance")
        .otherwise(text("3. Internal Malicious Activity (Port: ", ")"))
    )
    return (
        F.when(~known, UNKNOWN_TACTIC)
        .when(src_attacker & b, entry)
        .when(a & dst_c2, command)
        .when(a & b, inside)
        .when(src_attacker & ~b, "4. External Malicious Infrastructure Communication")
        .otherwise(UNKNOWN_TACTIC)
    )


#: Beginnings of tactic labels and their base names.
BASE_TACTICS = (
    ("1. Initial Access", "Initial Access"),
    ("2. Command & Control", "Command & Control"),
    ("3. Lateral Movement", "Lateral Movement"),
    ("3. Discovery", "Discovery"),
    ("3. Internal Malicious Activity", "Internal Malicious Activity"),
    ("4. External Malicious Infrastructure Communication", "External Malicious Infrastructure Communication"),
)


def canonical_tactic(tactic) -> Column:
    t = col(tactic)
    out = F.when(t.isNull(), "Unknown")
    for start, name in BASE_TACTICS:
        out = out.when(t.startswith(start), name)
    return out.otherwise("Unknown")


def confusion_class(y="y_real", p="y_pred") -> Column:
    y, p = col(y) == 1, col(p) == 1
    return F.when(y & p, "TP").when(~y & p, "FP").when(~y & ~p, "TN").otherwise("FN")


def over(score, threshold, inclusive: bool = True) -> Column:
    """Both comparisons occur: metrics use >, labelling of events uses >=."""
    return col(score) >= threshold if inclusive else col(score) > threshold


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def rates(tp="TP", fp="FP", tn="TN", fn="FN") -> dict[str, Column]:
    """Precision, Recall, F1, F2, FPR from counts; zero divisions give 0."""
    tp, fp, tn, fn = (col(c).cast("double") for c in (tp, fp, tn, fn))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"Precision": p, "Recall": r, "F1": ratio(2 * p * r, p + r), "F2": ratio(5 * p * r, 4 * p + r), "FPR": ratio(fp, fp + tn)}


def at_least_zero(x) -> Column:
    """Negative to 0; null stays null."""
    x = col(x)
    return F.when(x < 0, F.lit(0).cast("double")).otherwise(x)


def ttd_quality(rate) -> Column:
    r = col(rate)
    return F.when((r >= 0) & (r <= 0.25), "Weak (<25%)").when((r > 0.25) & (r <= 0.75), "Partial (25-75%)").when((r > 0.75) & (r <= 1), "Strong (>75%)")


def ttd_interpretation(ttd, rate) -> Column:
    t, r = col(ttd) > 0, col(rate)
    return (
        F.when(t & (r >= 0.75), "Delayed but strong detection")
        .when(t & (r >= 0.25), "Delayed partial detection")
        .when(t, "Delayed weak detection")
        .when(r >= 0.75, "Immediate strong detection")
        .when(r >= 0.25, "Immediate partial detection")
        .otherwise("Nominal detection (TTD=0 misleading)")
    )
