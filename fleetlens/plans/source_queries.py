"""Queries of the sources: JSON files made from the fixture views by Spark, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import certificates
from fleetlens.plans.registry import exported, query
from fleetlens.sources import readers
from fleetlens.sources.shared import folder
from fleetlens.streaming.streams import run_once


def _written(texts: DataFrame, name: str) -> str:
    """Where the texts now stand, one a line."""
    path = folder(texts.sparkSession, name)
    texts.write.text(path)
    return path


@query("src_clusters", "fx_specs", sql="""
    SELECT namespace, name, CAST(uid AS VARCHAR) AS uid, size, version, concat('--name=', name) AS options, concat('t', uid % 5) AS team, CASE WHEN has_storage THEN request_text END AS request, CASE WHEN has_tls THEN provider END AS provider,
      CASE WHEN has_tls AND has_auto THEN dns_name END AS dns_names, CASE WHEN has_tls AND has_manager THEN ip_address END AS ip_addresses, CASE WHEN has_tls AND has_manager THEN organisation END AS organisations, CASE WHEN has_tls AND has_manager THEN validity END AS validity, CAST(0 AS BIGINT) AS rejected FROM fx_specs
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 2 * (SELECT count(*) FROM fx_specs WHERE uid % 50 = 0)""")
def src_clusters(c: DataFrame) -> DataFrame:
    """Single objects and lists, of every fiftieth also a cut text and an object without metadata; those are counted in a row of their own."""
    each = exported(c)
    singles = each.filter("cluster_id % 2 = 0").select("value")
    lists = each.filter("cluster_id % 2 <> 0").groupBy("namespace", F.expr("cluster_id DIV 1000")).agg(F.concat(F.lit('{"items":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value")).select("value")  # of bounded length
    cut = each.filter("cluster_id % 50 = 0").select(F.explode(F.array(F.expr("substring(value, 1, length(value) - 7)"), F.lit('{"spec":{"size":3}}'))).alias("value"))
    texts = readers.read_text(c.sparkSession, _written(singles.unionByName(lists).unionByName(cut), "clusters"), whole=False)
    join = lambda name: F.array_join(name, ",")
    auto, manager = "tls.providerCfg.autoCfg", "tls.providerCfg.certManagerCfg"
    read = readers.clusters(texts).select(
        "namespace", "name", "uid", "size", "version", join("options").alias("options"), F.col("pod_annotations")["team"].alias("team"), F.col("storage.volumeSizeRequest").alias("request"), F.col("tls.provider").alias("provider"),
        join(f"{auto}.altNames.dnsNames").alias("dns_names"), join(f"{manager}.altNames.ipAddresses").alias("ip_addresses"), join(f"{manager}.organizations").alias("organisations"), F.col(f"{manager}.validityDuration").alias("validity"), F.lit(0).cast("bigint").alias("rejected"),
    )
    bad = readers.rejected(texts, readers.cluster_schema()).agg(F.count("*").alias("rejected"))
    return read.unionByName(bad, allowMissingColumns=True)


@query("src_workloads", "fx_workloads", sql="SELECT namespace, name, CAST(owner_uid AS VARCHAR) AS owner_uid, replicas, ready_replicas, image FROM fx_workloads WHERE is_controller")
def src_workloads(w: DataFrame) -> DataFrame:
    owner = F.array(F.struct(F.col("owner_uid").cast("string").alias("uid"), F.lit("Cluster").alias("kind"), F.col("is_controller").alias("controller")))
    one = F.struct(
        F.struct("namespace", "name", "generation", owner.alias("ownerReferences")).alias("metadata"),
        F.struct(F.col("replicas"), F.struct(F.struct(F.array(F.struct("image")).alias("containers")).alias("spec")).alias("template")).alias("spec"),
        F.struct(F.col("ready_replicas").alias("readyReplicas"), F.col("status_replicas").alias("replicas"), F.col("observed_generation").alias("observedGeneration")).alias("status"),
    )
    return readers.workloads(w.select(F.to_json(one).alias("value"))).filter("is_controller").select("namespace", "name", "owner_uid", "replicas", "ready_replicas", "image")


@query("src_member_list", "fx_members", sql="SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY ordinal) - 1 AS INT) AS position, CAST(CAST(member_id AS HUGEINT) + 9223372036854775808 AS VARCHAR) AS member_id, member_name, is_learner FROM fx_members")
def src_member_list(m: DataFrame) -> DataFrame:
    big = F.col("member_id").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")
    one = F.struct("ordinal", F.struct(big.cast("decimal(20,0)").alias("ID"), F.col("member_name").alias("name"), F.col("is_learner").alias("isLearner")).alias("x"))
    lists = m.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda o: o["x"]).alias("members"))
    out = readers.member_list(lists.select("cluster_id", F.to_json(F.struct("members")).alias("value")), "cluster_id")
    return out.select("cluster_id", "position", F.col("member_id").cast("string").alias("member_id"), "member_name", "is_learner")


@query("src_probes", "fx_probes", sql="SELECT cluster_id, endpoint, health, took, has_status, member_id, leader, revision, version FROM fx_probes")
def src_probes(p: DataFrame) -> DataFrame:
    status = F.when(F.col("has_status"), F.struct(F.struct("member_id", "revision").alias("header"), "leader", "version", F.col("is_learner").alias("isLearner")))
    lists = p.groupBy("cluster_id").agg(F.to_json(F.collect_list(F.struct("endpoint", "health", "took", "error", status.alias("Status")))).alias("value"))
    out = readers.probes(lists, "cluster_id")
    return out.select("cluster_id", "endpoint", "health", "took", "has_status", F.col("member_id").cast("bigint"), F.col("leader").cast("bigint"), "revision", "version")


@query("src_kv_hashes", "fx_kv_hashes", sql="SELECT cluster_id, endpoint, hash FROM fx_kv_hashes")
def src_kv_hashes(h: DataFrame) -> DataFrame:
    lists = h.groupBy("cluster_id").agg(F.to_json(F.collect_list(F.struct(F.col("endpoint").alias("Endpoint"), F.struct("hash").alias("HashKV")))).alias("value"))
    return readers.kv_hashes(lists, "cluster_id")


@query("src_changes", "fx_history", sql="SELECT 'workload' AS kind, concat('ns-', cluster_id % 25) AS namespace, concat('c', cluster_id) AS name, arg_max(CASE WHEN event_type = 'error' THEN 'delete' ELSE 'update' END, probe_id) AS op, max(probe_id) AS version FROM fx_history GROUP BY cluster_id HAVING arg_max(event_type, probe_id) <> 'error'")
def src_changes(h: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").otherwise("update")
    feed = h.select(F.lit("workload").alias("kind"), op.alias("op"), F.concat(F.lit("ns-"), F.col("cluster_id") % 25).alias("namespace"), F.concat(F.lit("c"), "cluster_id").alias("name"), F.col("probe_id").alias("version"))
    path = _written(feed.select(F.to_json(F.struct("*")).alias("value")).repartition(4, "value"), "feed")
    live = readers.LiveTable(h.sparkSession, folder(h.sparkSession, "live"))
    run_once(readers.changes(h.sparkSession, path, files=2), folder(h.sparkSession, "changes"), live.apply)
    return live.objects().select("kind", "namespace", "name", "op", "version")


@query("src_certs", "fx_certs", sql="SELECT namespace, secret_name, not_before, not_after, len(string_split(key_names, ',')) AS keys, first_condition FROM fx_certs")
def src_certs(c: DataFrame) -> DataFrame:
    keys = F.split("key_names", ",")
    text = c.select(F.to_json(F.struct("namespace", "secret_name", "not_before", "not_after", keys.alias("data_keys"), F.array(F.struct(F.col("first_condition").alias("type"))).alias("conditions"))).alias("value"))
    out = readers.certs(c.sparkSession, _written(text, "certs"))
    return out.select("namespace", "secret_name", F.col("not_before").cast("timestamp_ntz"), F.col("not_after").cast("timestamp_ntz"), F.size("data_keys").cast("long").alias("keys"), F.get("conditions", F.lit(0))["type"].alias("first_condition"))


@query("cert_request", "fx_specs", sql="""
    SELECT cluster_id, p AS provider, CASE WHEN has_cfg THEN common_name ELSE fqdn END AS common_name,
      CASE WHEN has_cfg AND dns_name IS NOT NULL THEN dns_name ELSE concat('*.', fqdn, ',', fqdn) END AS dns_names, CASE WHEN has_cfg THEN coalesce(ip_address, '') ELSE '' END AS ip_addresses, CASE WHEN has_cfg THEN organisation END AS organisation,
      CASE WHEN has_cfg AND validity = '8760h' THEN 31536000000000000 WHEN has_cfg AND validity = '100h' THEN 360000000000000 WHEN has_cfg AND validity = '20000h' THEN 72000000000000000 WHEN p = 'auto' THEN 31536000000000000 ELSE 7776000000000000 END AS validity_ns,
      CASE WHEN has_cfg AND validity = '100h' THEN 0 WHEN has_cfg AND validity = '20000h' THEN 2 WHEN has_cfg AND validity = '8760h' OR p = 'auto' THEN 1 ELSE 0 END AS validity_years,
      CASE WHEN p = 'cert-manager' AND has_cfg THEN issuer_kind END AS issuer_kind, CASE WHEN p = 'cert-manager' AND has_cfg THEN issuer_name END AS issuer_name
    FROM (SELECT *, CASE WHEN p = 'auto' THEN has_auto ELSE has_manager END AS has_cfg FROM (SELECT *, CASE WHEN provider = '' THEN 'auto' ELSE provider END AS p, concat(name, '.', namespace, '.svc.cluster.local') AS fqdn FROM fx_specs WHERE has_tls) q) q2""")
def cert_request(c: DataFrame) -> DataFrame:
    """From exported objects, as they are read."""
    text = readers.read_text(c.sparkSession, _written(exported(c).select("value"), "specs"), whole=False)
    read = readers.clusters(text).withColumn("cluster_id", F.col("uid").cast("bigint"))
    out = certificates.requests(read).withColumn("organisation", F.array_join("organizations", ",")).drop("organizations")
    return out.withColumns({n: F.array_join(n, ",") for n in ("dns_names", "ip_addresses")})
