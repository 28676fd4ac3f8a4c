"""Per-cluster aggregation, ranking and pairing of members and probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.scalar import client_endpoint, hex_id, quorum

KEY = "cluster_id"


def probe_aggregates(of: str = "", there: Column | None = None, count_unreachable: bool = False) -> list[Column]:
    """The aggregates of `probe_summary`; of: what stands before a probe's columns; there: whether a row is a probe at all."""
    c = lambda name: F.col(f"{of}{name}")
    row = F.lit(True) if there is None else there
    leads = row & F.coalesce(c("leader") == c("member_id"), F.lit(False))
    learns = row & F.coalesce(c("is_learner"), F.lit(False))
    bad = row & ~c("health") & (F.lit(True) if count_unreachable else c("has_status"))
    first = lambda names, cond: F.min_by(F.when(cond, F.struct(*[c(n).alias(n) for n in names])), F.when(cond, c("endpoint")))
    return [
        F.count_if(row).alias("probes"), F.count_if(row & c("health")).alias("healthy"), F.every(c("health")).alias("all_healthy"),
        first(["member_id", "revision", "version"], leads).alias("leader"), first(["member_id", "revision", "ordinal"], learns).alias("learner"),
        first(["has_status", "version"], row).alias("first_probe"),
        F.max_by(c("member_id"), c("endpoint")).alias("last_by_text"), F.max_by(c("member_id"), c("ordinal")).alias("last_by_ordinal"),
        F.array_sort(F.collect_list(F.when(bad, F.struct(c("endpoint").alias("endpoint"), hex_id(F.coalesce(c("member_id"), F.lit(0))).alias("id"))))).alias("bad"),
    ]


def probe_summary(probes: DataFrame, count_unreachable: bool = False) -> DataFrame:
    """Everything that the decisions need of a cluster's probes, in one aggregation (one exchange on the cluster).

    The leader is the first probe, by endpoint text, whose status names itself; the learner likewise. Probes without a
    status are neither. Unhealthy members are those whose status is known, unless count_unreachable is set."""
    return probes.groupBy(KEY).agg(*probe_aggregates(count_unreachable=count_unreachable))


def member_summary(members: DataFrame) -> DataFrame:
    return members.groupBy(KEY).agg(F.count("*").alias("members"), F.some(F.col("is_learner")).alias("any_learner"))


def health_counts(probes: DataFrame) -> DataFrame:
    return probes.groupBy(KEY).agg(F.count_if("health").alias("healthy"), F.count("*").alias("probes"))


def quorum_state(members: DataFrame, probes: DataFrame) -> DataFrame:
    """The list of members gives the denominator, the probes the healthy ones."""
    joined = member_summary(members).join(health_counts(probes), KEY, "left").withColumn("healthy", F.coalesce("healthy", F.lit(0)))
    q = quorum("members")
    return joined.select(KEY, "members", "healthy", q.alias("quorum"), ((F.col("members") > 0) & (F.col("healthy") >= q)).alias("available"))


def learner_ready(probes: DataFrame, ratio: float = 0.9) -> DataFrame:
    """A leader at revision 0 counts as infinitely far behind its learner, unless both are at 0."""
    s = probe_summary(probes).filter("learner IS NOT NULL AND leader IS NOT NULL")
    a, b = F.col("learner.revision").cast("double"), F.col("leader.revision").cast("double")
    ready = F.when(b == 0, a > 0).otherwise(F.try_divide(a, b) >= ratio)
    return s.select(KEY, F.col("learner.revision").alias("learner_revision"), F.col("leader.revision").alias("leader_revision"), ready.alias("ready"))


def unhealthy_members(probes: DataFrame, count_unreachable: bool = False) -> DataFrame:
    s = probe_summary(probes, count_unreachable).filter(F.size("bad") > 0)
    return s.select(KEY, F.array_join("bad.id", ", ").alias("members"))


def current_version(probes: DataFrame, previous: DataFrame) -> DataFrame:
    """The leader's version, else that of the first probe if it has a status, else the previous one."""
    s = previous.join(probe_summary(probes), KEY, "left")
    first = F.when(F.col("first_probe.has_status"), F.col("first_probe.version"))
    return s.select(KEY, F.coalesce("leader.version", first, "previous").alias("version"))


def pair(members: DataFrame, probes: DataFrame, mode: str = "id") -> DataFrame:
    """Members with their probe: by member id, or ('position') the i-th member with the i-th probe by endpoint text."""
    kept = members.select(KEY, "member_id", "position", "member_name")
    if mode == "id":
        p = probes.filter("member_id IS NOT NULL").select(F.col(KEY).alias("k"), F.col("member_id").alias("pid"), "endpoint", "health")
        return kept.join(p, (kept[KEY] == p.k) & (kept.member_id == p.pid), "left").drop("k", "pid")
    place = F.row_number().over(Window.partitionBy(KEY).orderBy("endpoint")) - 1
    p = probes.select(F.col(KEY).alias("k"), place.alias("place"), "endpoint", "health")
    return kept.join(p, (kept[KEY] == p.k) & (kept.position == p.place), "left").drop("k", "place")


def pairing_audit(members: DataFrame, probes: DataFrame) -> DataFrame:
    """Members whose probe by position isn't their probe by id. Both pairings come from a cluster's probes as one sorted list (of
    one cluster: a few entries), so members and probes meet once."""
    each = F.struct("endpoint", F.col("member_id").alias("id"))
    lists = probes.groupBy(F.col(KEY).alias("k")).agg(F.array_sort(F.collect_list(each)).alias("p"))
    both = members.select(KEY, "member_id", "position").join(lists, F.col(KEY) == F.col("k"), "left")
    by_id = F.get(F.filter("p", lambda x: x["id"] == F.col("member_id")), F.lit(0))["endpoint"]
    out = both.select(KEY, "member_id", by_id.alias("by_id"), F.get("p", F.col("position").cast("int"))["endpoint"].alias("by_position"))
    return out.filter(~F.col("by_id").eqNullSafe(F.col("by_position")))


def probe_targets(workloads: DataFrame, members: DataFrame) -> DataFrame:
    """Endpoints of the first min(replicas, members) ordinals."""
    w = workloads.join(member_summary(members), KEY).withColumn("n", F.least("replicas", "members").cast("int")).filter("n > 0")
    o = w.select(KEY, "name", "namespace", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ordinal"))
    return o.select(KEY, "ordinal", client_endpoint("name", "namespace", "ordinal").alias("endpoint"))


def kv_consistency(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy(KEY).agg(F.count("*").alias("responses"), F.count_distinct("hash").alias("hashes")).withColumn("consistent", F.col("hashes") == 1)


def identity_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Members gained, lost, or with another id, between two snapshots of (cluster, member_name, member_id)."""
    a = before.select(KEY, "member_name", F.col("member_id").alias("old_id"))
    b = after.select(KEY, "member_name", F.col("member_id").alias("new_id"))
    kind = F.when(F.col("old_id").isNull(), "gained").when(F.col("new_id").isNull(), "lost").when(F.col("old_id") != F.col("new_id"), "changed")
    return a.join(b, [KEY, "member_name"], "full_outer").withColumn("kind", kind).filter("kind IS NOT NULL")


def snapshot_diff(desired: DataFrame, observed: DataFrame) -> DataFrame:
    """(cluster, member_name) rows of one side only, with the side, as often as that side has more of them: one signed count."""
    keys = desired.columns
    both = desired.withColumn("_n", F.lit(1)).unionByName(observed.select(*keys).withColumn("_n", F.lit(-1)))
    more = both.groupBy(*keys).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    side = F.when(F.col("_n") > 0, "missing").otherwise("unexpected")
    return more.select(*keys, side.alias("side"), F.explode(F.expr("sequence(1L, abs(_n))")).alias("_k")).drop("_k")


def ordinal_gaps(members: DataFrame) -> DataFrame:
    """Clusters whose ordinals aren't 0 to n - 1, with the missing ones."""
    g = members.groupBy(KEY).agg(F.max("ordinal").alias("last"), F.collect_set("ordinal").alias("have"))
    lost = F.array_sort(F.array_except(F.sequence(F.lit(0), F.col("last")), "have"))
    return g.withColumn("missing", lost).filter(F.size("missing") > 0).select(KEY, F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"))
