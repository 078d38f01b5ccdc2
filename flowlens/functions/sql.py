"""SQL forms of the scalar functions, as native SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .columns import BASE_TACTICS, PROTOCOL_CLASSES, PROTOCOLS, ROLE_PORTS, ROLES, UNKNOWN_TACTIC


def register(spark: SparkSession) -> None:
    """port_role(port), protocol_class(number), in_cidr(ip, net), canonical_tactic(label) and
    mitre_tactic(src, dst, role, attackers, c2, net), lists as arrays, for use in spark.sql."""
    roles = " ".join(f"WHEN p IN {ports} THEN '{role}'" for role, ports in ROLE_PORTS.items())
    classes = " ".join(f"WHEN p IN ({', '.join(map(str, n))}) THEN '{name}'" for name, n in PROTOCOLS.items())
    tactics = " ".join(f"WHEN startswith(t, '{start}') THEN '{name}'" for start, name in BASE_TACTICS)
    number = "CASE WHEN {0} RLIKE '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' THEN " + " + ".join(f"CAST(split_part({{0}}, '.', {i}) AS BIGINT) * {256 ** (4 - i)}" for i in range(1, 5)) + " END"
    base = number.format("split_part(net, '/', 1)")
    inside = lambda ip: f"coalesce(in_cidr({ip}, net), false)"
    known = f"({number.format('src')}) IS NOT NULL AND ({number.format('dst')}) IS NOT NULL"
    web, high, low = f"role = '{ROLES[0]}'", f"role = '{ROLES[6]}'", f"role = '{ROLES[5]}'"
    named = lambda before, after: f"concat('{before}', role, '{after}')"
    # the cascade of columns.mitre_tactic
    entry = f"CASE WHEN {web} OR {high} THEN '1. Initial Access / Exploitation (Medium Confidence)' ELSE {named('1. Initial Access (Port: ', ')')} END"
    command = f"CASE WHEN {web} OR role = 'DNS' THEN '2. Command & Control (Stealth/Web/DNS)' WHEN {high} THEN '2. Command & Control (Custom/High Port)' ELSE {named('2. Command & Control (Port: ', ')')} END"
    lateral = (
        f"CASE WHEN role IN ('Windows/SMB', 'Admin/Remote') THEN {named('3. Lateral Movement (', ')')} WHEN role = 'Database' THEN '3. Discovery / Targeting Internal Data Stores' "
        f"WHEN {low} OR {high} THEN '3. Discovery / Possible Internal Reconnaissance' ELSE {named('3. Internal Malicious Activity (Port: ', ')')} END"
    )
    attacker, listed = "coalesce(array_contains(attackers, src), false)", "coalesce(array_contains(c2, dst), false)"
    cascade = (
        f"CASE WHEN NOT ({known}) THEN '{UNKNOWN_TACTIC}' WHEN {attacker} AND {inside('dst')} THEN {entry} WHEN {inside('src')} AND {listed} THEN {command} "
        f"WHEN {inside('src')} AND {inside('dst')} THEN {lateral} WHEN {attacker} AND NOT {inside('dst')} THEN '4. External Malicious Infrastructure Communication' ELSE '{UNKNOWN_TACTIC}' END"
    )
    size = "shiftleft(1L, 32 - CAST(split_part(net, '/', 2) AS INT))"
    for name, args, returns, body in (
        ("port_role", "p INT", "STRING", f"CASE WHEN p IS NULL THEN NULL {roles} WHEN p < 1024 THEN '{ROLES[5]}' ELSE '{ROLES[6]}' END"),
        ("protocol_class", "p INT", "STRING", f"CASE {classes} ELSE '{PROTOCOL_CLASSES[-1]}' END"),
        ("canonical_tactic", "t STRING", "STRING", f"CASE {tactics} ELSE 'Unknown' END"),
        ("in_cidr", "ip STRING, net STRING", "BOOLEAN", f"({number.format('ip')}) div {size} = ({base}) div {size}"),
        ("mitre_tactic", "src STRING, dst STRING, role STRING, attackers ARRAY<STRING>, c2 ARRAY<STRING>, net STRING", "STRING", cascade),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
