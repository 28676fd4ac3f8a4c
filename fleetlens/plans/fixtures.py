"""Fleet-shaped views over the driver's tables.

Each view is a formula that means the same in Spark and in the SQL of the oracles, so it is stated once, as text.
Braces name a table. Views may use the views before them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "fx_clusters": """
        SELECT o_orderkey AS cluster_id, o_orderkey AS uid, concat('ns-', o_custkey % 25) AS namespace, concat('c', o_orderkey) AS name,
          CAST(1 + 2 * (o_orderkey % 3) AS INT) AS size, o_orderkey % 7 + 1 AS generation,
          CASE WHEN o_orderpriority = '5-LOW' THEN 'latest' ELSE concat('3.', 4 + o_custkey % 4, '.', o_custkey % 9) END AS version,
          CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'registry.local/kv' END AS image_registry, o_orderdate AS observed_at, o_custkey
        FROM {orders}""",
    "fx_workloads0": """
        SELECT cluster_id, namespace, name, CASE WHEN cluster_id % 97 = 0 THEN -1 ELSE cluster_id END AS owner_uid, cluster_id % 41 <> 0 AS is_controller,
          greatest(0, size + CASE WHEN o_custkey % 10 = 0 THEN -1 WHEN o_custkey % 10 = 1 THEN 1 ELSE 0 END) AS replicas,
          concat('registry.local/kv:3.', 4 + (o_custkey + cluster_id % 3) % 4, '.', cluster_id % 9) AS image, generation,
          generation - CASE WHEN cluster_id % 31 = 0 THEN 1 ELSE 0 END AS observed_generation, observed_at
        FROM fx_clusters WHERE cluster_id % 11 <> 0""",
    "fx_workloads": """
        SELECT *, CASE WHEN cluster_id % 13 = 0 THEN greatest(0, replicas - 1) ELSE replicas END AS ready_replicas,
          CASE WHEN cluster_id % 29 = 0 THEN replicas + 1 ELSE replicas END AS status_replicas
        FROM fx_workloads0""",
    "fx_ranked": """
        SELECT l_orderkey AS cluster_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
          l_extendedprice, l_shipdate, l_discount, l_tax) - 1 AS INT) AS ordinal, l_returnflag, l_tax, l_discount, l_extendedprice, l_quantity
        FROM {lineitem}""",
    "fx_members": """
        SELECT r.cluster_id, w.namespace, w.name, w.replicas, w.image, r.ordinal, r.ordinal AS position, r.cluster_id * 100 + r.ordinal + 1 AS member_id,
          concat(w.name, '-', r.ordinal) AS member_name, r.l_returnflag = 'R' AND r.ordinal > 0 AND r.ordinal = w.replicas - 1 AS is_learner,
          r.l_tax, r.l_discount, r.l_extendedprice, r.l_quantity
        FROM fx_ranked r JOIN fx_workloads w ON r.cluster_id = w.cluster_id
        WHERE r.ordinal < w.replicas + CASE WHEN r.cluster_id % 10 = 0 THEN 1 WHEN r.cluster_id % 10 = 1 THEN -1 ELSE 0 END""",
    "fx_members_gaps": "SELECT * FROM fx_members WHERE (cluster_id + ordinal) % 7 <> 0",
    "fx_probes": """
        SELECT cluster_id, namespace, name, ordinal, concat('http://', member_name, '.', name, '.', namespace, '.svc.cluster.local:2379') AS endpoint,
          NOT (l_tax = 0.08 AND l_discount < 0.03) AS health, NOT (l_tax = 0.08 AND l_discount < 0.01) AS has_status, concat(1 + ordinal, 'ms') AS took,
          CASE WHEN l_tax = 0.08 AND l_discount < 0.01 THEN 'context deadline exceeded' ELSE '' END AS error,
          CASE WHEN l_tax = 0.08 AND l_discount < 0.01 THEN NULL ELSE member_id END AS member_id,
          CASE WHEN l_tax = 0.08 AND l_discount < 0.01 THEN NULL WHEN cluster_id % 23 = 0 THEN -1 ELSE cluster_id * 100 + 1 END AS leader,
          CASE WHEN l_tax = 0.08 AND l_discount < 0.01 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS revision,
          CASE WHEN l_tax = 0.08 AND l_discount < 0.01 THEN NULL ELSE substr(image, 19) END AS version,
          CASE WHEN l_tax = 0.08 AND l_discount < 0.01 THEN NULL ELSE is_learner END AS is_learner
        FROM fx_members WHERE ordinal < replicas""",
    "fx_members_all": """
        SELECT r.cluster_id, c.namespace, c.name, r.ordinal, r.ordinal AS position, r.cluster_id * 100 + r.ordinal + 1 AS member_id,
          concat(c.name, '-', r.ordinal) AS member_name, concat('http://', c.name, '-', r.ordinal, '.', c.name, '.', c.namespace, '.svc.cluster.local:2379') AS endpoint,
          NOT (r.l_tax = 0.08 AND r.l_discount < 0.03) AS health
        FROM fx_ranked r JOIN fx_clusters c ON r.cluster_id = c.cluster_id""",
    "fx_version_line": """
        SELECT CAST(floor(i / 7) + 3 AS BIGINT) AS major, CASE WHEN i = 7 THEN CAST(0 AS BIGINT) ELSE i END AS minor, i AS idx
        FROM (SELECT DISTINCT r_regionkey + 5 * k AS i FROM {region}, (SELECT DISTINCT r_regionkey % 2 AS k FROM {region}) q) v WHERE i < 8""",
    "fx_kv_hashes": "SELECT cluster_id, member_name AS endpoint, CASE WHEN l_quantity = 50 THEN 1 ELSE 0 END AS hash FROM fx_members",
    "fx_certs": """
        SELECT c.cluster_id, c.uid, c.namespace, concat(c.name, '-', k.purpose, '-tls') AS secret_name, k.purpose, c.observed_at AS not_before,
          CASE WHEN c.uid % 2 = 0 THEN c.observed_at + INTERVAL '365' DAY ELSE c.observed_at + INTERVAL '90' DAY END AS not_after, 
          CASE WHEN c.uid % 29 = 0 THEN 'tls.crt' WHEN c.uid % 31 = 0 THEN 'tls.key' WHEN c.uid % 47 = 0 THEN '' ELSE 'ca.crt,tls.crt,tls.key' END AS key_names, CASE WHEN c.uid % 41 = 0 THEN 'False' ELSE 'True' END AS first_status,
          CASE WHEN c.uid % 37 = 0 THEN 'Issuing' WHEN c.uid % 43 = 0 THEN 'Denied' WHEN c.uid % 53 = 0 THEN NULL ELSE 'Ready' END AS first_condition
        FROM fx_clusters c, (SELECT DISTINCT CASE WHEN r_regionkey % 3 = 0 THEN 'client' WHEN r_regionkey % 3 = 1 THEN 'server' ELSE 'peer' END AS purpose FROM {region}) k
        WHERE NOT (c.uid % 17 = 0 AND k.purpose = 'peer')""",
    "fx_history": """
        SELECT event_id AS probe_id, ts, CAST(floor(user_id / 3) AS BIGINT) AS cluster_id, user_id % 3 AS ordinal, event_type <> 'error' AS health, event_type,
          value AS took_ms, CAST(floor(value * 100) AS BIGINT) AS revision, CASE WHEN event_type = 'error' THEN 'False' ELSE 'True' END AS status
        FROM {events}""",
    "fx_options": """
        SELECT p_partkey AS option_id, CAST(floor(p_partkey / 4) AS BIGINT) AS cluster_id,
          concat(CASE WHEN p_partkey % 5 = 0 THEN '--name' WHEN p_partkey % 35 = 3 THEN ' --data-dir ' ELSE concat('--', lower(replace(p_brand, '#', '-'))) END,
            CASE WHEN p_partkey % 3 = 0 THEN '=' WHEN p_partkey % 3 = 1 THEN ' ' ELSE '' END, CASE WHEN p_partkey % 3 = 2 THEN '' ELSE concat('v', p_size) END) AS option_text
        FROM {part}""",
    "fx_deployed": """
        SELECT cluster_id, CASE WHEN cluster_id % 5 = 0 THEN -option_id ELSE option_id END AS option_id, option_text FROM fx_options WHERE option_id % 7 <> 3
        UNION ALL SELECT cluster_id, 100000000 + cluster_id, '--extra' FROM fx_clusters WHERE cluster_id % 3 = 0""",
    "fx_texts": """
        SELECT event_id AS text_id, CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN concat(user_id, 'h', event_id % 60, 'm') WHEN 2 THEN concat(event_id % 90, '.5s') WHEN 3 THEN CASE event_id % 24 WHEN 3 THEN '0.0000001h' WHEN 11 THEN '-1.0000000019s.5us' ELSE '365d' END
            WHEN 4 THEN concat('-', event_id % 50, 'ms') WHEN 5 THEN concat(event_id, 'us', event_id % 9, 'ns') WHEN 6 THEN '1h 3m' ELSE concat(user_id, 'h') END AS duration_text,
          CASE event_id % 7 WHEN 0 THEN concat(user_id, 'Mi') WHEN 1 THEN concat(event_id % 40, 'Gi') WHEN 2 THEN concat(event_id % 90, '.5Ki') WHEN 3 THEN concat(user_id, 'M')
            WHEN 4 THEN CASE WHEN event_id % 2 = 0 THEN concat(event_id % 13, 'e3') ELSE '4e1.5' END WHEN 5 THEN CASE event_id % 8 WHEN 0 THEN 'many' WHEN 1 THEN '3Pi' WHEN 2 THEN '7Ei' WHEN 3 THEN '2P' WHEN 4 THEN '8E' WHEN 5 THEN '1500u' WHEN 6 THEN '64n' ELSE '1KI' END ELSE concat(event_id, 'm') END AS quantity_text,
          CASE event_id % 6 WHEN 0 THEN concat('v3.5.', event_id % 30) WHEN 1 THEN 'latest' WHEN 2 THEN concat('3.', event_id % 9) WHEN 3 THEN concat('3.6.', event_id % 20, '-rc.', user_id)
            WHEN 4 THEN concat('04.1.', event_id) ELSE concat(event_id % 5, '.', event_id % 8, '.', event_id) END AS version_text
        FROM {events}""",
    "fx_specs": """
        SELECT cluster_id, uid, namespace, name, CASE WHEN uid % 13 = 0 THEN NULL ELSE CAST(uid % 4 - 1 AS INT) END AS size, CASE WHEN uid % 17 = 0 THEN NULL ELSE version END AS version,
          uid % 3 <> 0 AS has_storage, CASE uid % 5 WHEN 0 THEN '1Ki' WHEN 1 THEN '1Mi' WHEN 2 THEN '2097152' WHEN 3 THEN '1048575999m' ELSE '0.25Gi' END AS request_text, CASE WHEN uid % 7 = 0 THEN '0' ELSE concat(uid, 'k') END AS limit_text,
          CASE uid % 4 WHEN 0 THEN '' WHEN 1 THEN 'ReadWriteOnce' WHEN 2 THEN 'ReadWriteMany' ELSE 'ReadOnlyMany' END AS access_mode, CASE WHEN uid % 6 < 3 THEN '' ELSE concat('pvc-', name) END AS pvc_name,
          uid % 9 <> 0 AS has_tls, CASE uid % 8 WHEN 0 THEN 'auto' WHEN 1 THEN 'cert-manager' WHEN 2 THEN 'other' ELSE '' END AS provider, uid % 10 < 7 AS has_auto, uid % 10 > 2 AS has_manager,
          CASE WHEN uid % 11 = 0 THEN NULL ELSE CASE uid % 3 WHEN 0 THEN 'Issuer' WHEN 1 THEN 'ClusterIssuer' ELSE 'Vault' END END AS issuer_kind, CASE WHEN uid % 14 = 3 THEN NULL ELSE concat('ca-', uid % 12) END AS issuer_name,
          CASE uid % 4 WHEN 0 THEN CASE WHEN uid % 16 = 0 THEN '0s' ELSE '' END WHEN 1 THEN '8760h' WHEN 2 THEN '100h' ELSE '20000h' END AS validity, CASE WHEN uid % 5 = 0 THEN '' ELSE concat(repeat('n', CAST(uid % 70 AS INT)), '.', name) END AS common_name,
          CASE WHEN uid % 6 = 0 THEN concat('*.', name, CASE WHEN uid % 12 = 0 THEN concat(',', name, '.example,b.example') ELSE '' END) ELSE NULL END AS dns_name,
          CASE WHEN uid % 4 = 2 THEN concat('10.0.', uid % 200, '.', uid % 7, CASE WHEN uid % 8 = 2 THEN ',::1' ELSE '' END) ELSE NULL END AS ip_address,
          CASE WHEN uid % 7 = 5 THEN NULL ELSE concat('org ', uid % 3, CASE WHEN uid % 2 = 0 THEN ',org b' ELSE '' END) END AS organisation
        FROM fx_clusters""",
    "fx_issuers": """
        SELECT DISTINCT CASE WHEN c_nationkey % 2 = 0 THEN 'Issuer' ELSE 'ClusterIssuer' END AS kind, CASE WHEN c_nationkey % 2 = 0 THEN concat('ns-', c_custkey % 25) ELSE NULL END AS namespace, concat('ca-', c_custkey % 9) AS name
        FROM {customer}""",
    "fx_conditions": """
        SELECT event_id AS condition_id, floor(user_id / 3) AS cluster_id, CASE event_id % 5 WHEN 0 THEN 'Available' WHEN 1 THEN 'apps.example/Ready' WHEN 2 THEN '-bad' WHEN 3 THEN CASE WHEN event_id % 15 = 3 THEN repeat('T', 317) WHEN event_id % 15 = 8 THEN NULL ELSE 'Degraded' END ELSE 'a/b/c' END AS type,
          CASE event_id % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'False' WHEN 2 THEN 'Unknown' ELSE 'yes' END AS status, CASE event_id % 3 WHEN 0 THEN 'ClusterReady' WHEN 1 THEN '9lives' ELSE CASE WHEN event_id % 9 = 2 THEN repeat('r', 1025) WHEN event_id % 9 = 5 THEN repeat('r', 1024) ELSE '' END END AS reason,
          CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS transition_at,
          repeat('m', CAST(event_id % 50 AS INT) * 700) AS message, event_id % 6 - 1 AS observed_generation
        FROM {events}""",
    "fx_answers": """
        SELECT c_custkey AS respondent, CASE WHEN c_custkey % 9 = 0 THEN 'org-shared' ELSE concat('org-', c_custkey) END AS organisation, c_custkey % 50 <> 1 AS complete, c_custkey % 25 <> 2 AS interested,
          c_custkey % 300 AS clusters, c_nationkey % 5 <> 0 AS wants_backup, c_nationkey % 3 = 0 AS wants_upgrade, c_nationkey % 2 = 0 AS wants_tls
        FROM {customer}""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def chain(name: str) -> list[str]:
    """The views that a view needs, itself last, in order."""
    need, todo = set(), [name]
    while todo:
        v = todo.pop()
        if v not in need:
            need.add(v)
            todo += [w for w in VIEWS if re.search(rf"\b{w}\b", VIEWS[v])]
    return [v for v in VIEWS if v in need]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    parts = chain(name)
    text = "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in parts) + f" SELECT * FROM {name}"
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def with_views(sql: str) -> str:
    """SQL over the views, with their text in front."""
    need = set()
    for v in VIEWS:
        if re.search(rf"\b{v}\b", sql):
            need |= set(chain(v))
    parts = [v for v in VIEWS if v in need]
    text = ", ".join(f"{v} AS ({re.sub(r'[{}]', '', VIEWS[v])})" for v in parts)
    if not parts:
        return sql
    return f"WITH {text}, {sql.strip()[5:]}" if sql.strip().upper().startswith("WITH ") else f"WITH {text} {sql}"
