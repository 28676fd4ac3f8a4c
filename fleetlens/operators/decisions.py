"""Decisions: upgrade verdicts, conditions, status, next action, certificate verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.scalar import hex_id, image_tag, peer_endpoint, quorum, semver
from fleetlens.operators.members import KEY, probe_aggregates
from fleetlens.operators.rules import missing_keys, not_ready


def cases(*pairs: tuple[Column, object], otherwise=None) -> Column:
    out = F
    for cond, value in pairs:
        out = out.when(cond, value)
    return out.otherwise(otherwise)


def judged(rows: DataFrame, line: DataFrame) -> DataFrame:
    """rows(image, version, ...) with `current`, `target` and `verdict`: the image's tag against the wanted version.
    line(major, minor, idx): the versions in order, a few rows."""
    j = rows.withColumn("target", F.col("version")).withColumn("current", image_tag("image")).withColumn("c", semver("current")).withColumn("t", semver("target"))
    at = lambda side, name: line.select(F.col("major").alias(f"{side}_a"), F.col("minor").alias(f"{side}_b"), F.col("idx").alias(name))
    j = j.join(at("c", "ci"), (F.col("c.major") == F.col("c_a")) & (F.col("c.minor") == F.col("c_b")), "left")
    j = j.join(at("t", "ti"), (F.col("t.major") == F.col("t_a")) & (F.col("t.minor") == F.col("t_b")), "left")
    lower = (F.col("ti") < F.col("ci")) | ((F.col("ti") == F.col("ci")) & (F.col("t.patch") < F.col("c.patch")))
    verdict = cases(
        (F.col("current") == F.col("target"), "unchanged"), (F.col("c").isNull() | F.col("t").isNull(), "unvalidated"), (F.col("ci").isNull(), "unknown_current"),
        (F.col("ti").isNull(), "unknown_target"), (lower, "downgrade"), (F.col("ti") - F.col("ci") > 1, "skips_minor"), otherwise="supported",
    )
    return j.withColumn("verdict", verdict).drop("c", "t", "c_a", "c_b", "t_a", "t_b", "ci", "ti")


def upgrade_verdict(clusters: DataFrame, workloads: DataFrame, line: DataFrame) -> DataFrame:
    """The verdict for each cluster that has a workload."""
    return judged(clusters.select(KEY, "version").join(workloads.select(KEY, "image"), KEY), line).select(KEY, "current", "target", "verdict")


#: The feeds that make up a cluster's state, and what is used of each.
FEEDS = {
    "spec": ["uid", "namespace", "name", "size", "generation", "version"], "workload": ["replicas", "ready_replicas", "owner_uid", "is_controller", "image"],
    "member": ["position", "member_id", "member_name", "is_learner"], "probe": ["endpoint", "ordinal", "health", "has_status", "member_id", "leader", "revision", "version", "is_learner"],
}


def tagged(feeds: dict[str, DataFrame], *more: str) -> DataFrame:
    """One table of several feeds: KEY, `feed`, the columns of more, and a struct for each feed, null but for a row's own."""
    kinds = {f: F.struct(*FEEDS[f]).alias(f) for f in feeds}
    types = {f: df.select(kinds[f]).schema[f].dataType for f, df in feeds.items()}
    out = None
    for feed, df in feeds.items():
        one = df.select(KEY, F.lit(feed).alias("feed"), *more, *[kinds[f] if f == feed else F.lit(None).cast(types[f]).alias(f) for f in feeds])
        out = one if out is None else out.unionByName(one)
    return out


def gathered(rows: DataFrame) -> DataFrame:
    """One row for each cluster that has a spec, from the tagged rows of all feeds: one exchange on the cluster, for conditions, action and
    status alike. `each_member` and `each_probe` hold its members by position and its probes by endpoint."""
    probes = probe_aggregates("probe.", F.col("probe").isNotNull())
    members = [F.count("member").alias("members"), F.some(F.col("member.is_learner")).alias("any_learner")]
    lists = [F.array_sort(F.collect_list("member")).alias("each_member"), F.array_sort(F.collect_list("probe")).alias("each_probe")]
    out = rows.groupBy(KEY).agg(F.first("spec", ignorenulls=True).alias("spec"), F.first("workload", ignorenulls=True).alias("workload"), *members, *probes, *lists)
    return out.filter("spec IS NOT NULL").select(KEY, "spec.*", "workload.*", *[c for c in out.columns if c not in (KEY, "spec", "workload")])


def observed(clusters: DataFrame, workloads: DataFrame, members: DataFrame, probes: DataFrame) -> DataFrame:
    """One row for each cluster with all that conditions, status and action need."""
    return gathered(tagged({"spec": clusters, "workload": workloads, "member": members, "probe": probes}))


def conditions(state: DataFrame) -> DataFrame:
    """Three rows for each cluster: Available, Progressing, Degraded."""
    n, h, q = F.col("members"), F.col("healthy"), quorum("members")
    counts = F.concat(h.cast("string"), F.lit("/"), n.cast("string"))
    good = (n > 0) & (h >= q)
    available = F.struct(
        F.lit("Available").alias("type"), F.when(good, "True").otherwise("False").alias("status"), F.when(good, "ClusterAvailable").otherwise("ClusterNotReady").alias("reason"),
        cases((good, F.concat(F.lit("Cluster has "), counts, F.lit(" healthy members with quorum"))), (n > 0, F.concat(F.lit("Cluster has "), counts, F.lit(" healthy members, quorum requires "), q.cast("string"))), otherwise=F.lit("Cluster is not yet available")).alias("message"),
    )
    known = F.col("replicas").isNotNull()
    learner = known & F.coalesce("any_learner", F.lit(False))
    scaling, changing = known & (F.col("replicas") != F.col("size")), known & (n > 0) & (n != F.col("size"))
    progressing = F.struct(
        F.lit("Progressing").alias("type"), F.when(learner | scaling | changing, "True").otherwise("False").alias("status"),
        cases((learner, "LearnerPromotion"), (scaling, "ScalingInProgress"), (changing, "MembershipChanging"), otherwise="ClusterStable").alias("reason"),
        cases((learner, F.lit("Promoting learner to voting member")), (scaling, F.concat(F.lit("Scaling from "), F.col("replicas").cast("string"), F.lit(" to "), F.col("size").cast("string"), F.lit(" replicas"))),
              (changing, F.concat(F.lit("Membership changing from "), n.cast("string"), F.lit(" to "), F.col("size").cast("string"))), otherwise=F.lit("Cluster is stable")).alias("message"),
    )
    bad = F.coalesce(F.size("bad") > 0, F.lit(False))
    degraded = F.struct(
        F.lit("Degraded").alias("type"), F.when(bad, "True").otherwise("False").alias("status"), F.when(bad, "UnhealthyMembers").otherwise("ClusterHealthy").alias("reason"),
        F.when(bad, F.concat(F.lit("Unhealthy members: "), F.array_join("bad.id", ", "))).otherwise("All members are healthy").alias("message"),
    )
    return state.select(KEY, F.explode(F.array(available, progressing, degraded)).alias("c")).select(KEY, "c.*")


def next_action(state: DataFrame, victim: str = "last_by_text") -> DataFrame:
    """state as `judged` gives it: the first action that applies, its argument, and whether a learner is promoted or the victim leads."""
    s = state
    r, n, z = F.col("replicas"), F.col("members"), F.col("size")
    no_leader = (n > 0) & F.col("leader").isNull()
    learner = F.col("learner").isNotNull() & F.col("leader").isNotNull()
    a, b = F.col("learner.revision").cast("double"), F.col("leader.revision").cast("double")
    ready = F.when(b == 0, a > 0).otherwise(F.coalesce(F.try_divide(a, b) >= 0.9, F.lit(False)))
    missing = F.col("owner_uid").isNull()
    action = cases(
        (~missing & ~((F.col("owner_uid") == F.col("uid")) & F.col("is_controller")), "error_not_controlled"),
        (F.col("verdict").isin("unknown_current", "unknown_target", "downgrade", "skips_minor"), "error_upgrade_path"),
        (missing, "bootstrap_create"), (r.isNull(), "violation_replicas"), (r == 0, "bootstrap_one"), (F.col("probes") > F.col("healthy"), "error_unhealthy"), (r < n, "workload_grow"), (r > n, "workload_shrink"),
        (no_leader, "error_no_leader"), (learner & ~ready, "wait_learner"), (r == z, "up_to_date"), (r < z, "scale_out"), otherwise="scale_in",
    )
    s = s.withColumn("action", action)
    is_ = lambda name: F.col("action") == name
    argument = cases(
        (is_("workload_grow"), (r + 1).cast("string")), (is_("workload_shrink"), (r - 1).cast("string")), (is_("scale_out"), peer_endpoint("name", "namespace", "replicas")), (is_("scale_in"), hex_id(F.col(victim))),
    )
    deciding = F.col("action").isin("up_to_date", "scale_out", "scale_in")
    return s.select(
        KEY, "action", argument.alias("argument"), (deciding & learner & ready).alias("promote"),
        F.coalesce(is_("scale_in") & (F.col("leader.member_id") == F.col(victim)), F.lit(False)).alias("victim_is_leader"),
    )


def cluster_status(state: DataFrame, previous: Column) -> DataFrame:
    """One row for each cluster, with `members`: an array of (position, id, name, is_healthy, version, is_leader, is_learner), each
    with what its probe (by id, the first by endpoint) says; without one a member isn't healthy. previous: the version
    that stands where no probe gives one."""
    first = F.when(F.col("first_probe.has_status"), F.col("first_probe.version"))
    no = lambda c: F.coalesce(c, F.lit(False))

    def one(m: Column) -> Column:
        p = F.get(F.filter("each_probe", lambda x: x["member_id"] == m["member_id"]), F.lit(0))
        return F.struct(
            m["position"].alias("position"), hex_id(m["member_id"]).alias("id"), m["member_name"].alias("name"), no(p["health"]).alias("is_healthy"), p["version"].alias("version"),
            no(p["leader"] == p["member_id"]).alias("is_leader"), no(m["is_learner"]).alias("is_learner"),
        )

    each = F.when(F.size("each_member") > 0, F.transform("each_member", one))
    return state.select(
        KEY, F.col("generation").alias("observed_generation"), F.coalesce("replicas", F.lit(0)).alias("current_replicas"), F.coalesce("ready_replicas", F.lit(0)).alias("ready_replicas"),
        F.col("members").alias("member_count"), hex_id(F.col("leader.member_id")).alias("leader_id"), F.coalesce("leader.version", first, previous).alias("current_version"), each.alias("members"),
    )


def condition_summary(conditions: DataFrame) -> DataFrame:
    """How many clusters are in each combination of the three conditions."""
    of = lambda kind: F.max(F.when(F.col("type") == kind, F.col("status")))
    each = conditions.groupBy(KEY).agg(of("Available").alias("available"), of("Progressing").alias("progressing"), of("Degraded").alias("degraded"))
    return each.groupBy("available", "progressing", "degraded").agg(F.count("*").alias("clusters"))


def cert_verdict(expected: DataFrame, certs: DataFrame, as_of: str, strict: bool = False) -> DataFrame:
    """expected(KEY, secret_name, provider): the first failing check of each secret, in this order: missing, status (only a
    certificate manager's; strict: Ready must be True), keys, window (both ends count as valid)."""
    now = F.lit(as_of).cast("timestamp_ntz")
    there = certs.select(KEY, "secret_name", "first_condition", "first_status", "data_keys", "not_before", "not_after")
    status = F.when(F.col("provider") == "cert-manager", not_ready(strict))
    keys = missing_keys(F.col("data_keys"))
    verdict = cases(
        (F.col("data_keys").isNull(), "missing"), (status == "pending", "pending"), (status.isNotNull(), "unknown_status"), (keys.startswith("tls.crt"), "no_cert"), (keys != "", "no_key"),
        (F.col("not_before") > now, "not_yet"), (F.col("not_after") < now, "expired"), otherwise="ok",
    )
    return expected.join(there, [KEY, "secret_name"], "left").select(KEY, "secret_name", verdict.alias("verdict"))
